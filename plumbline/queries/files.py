"""Sources and sinks driven by the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.operators.cells import as_text
from plumbline.queries.profiles import text_table
from plumbline.queries.registry import query, table
from plumbline.session import fresh_path, kept_in_order
from plumbline.sources import delimited as D


@query("delimited_to_parquet", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, 0 AS discarded FROM {t}" for t in ("orders", "customer", "labels")))
def _to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {}
    for name in ("orders", "customer", "labels"):
        path = fresh_path(spark, f"{name}-text")
        text_table(spark, sf_dir, name).write.option("header", True).option("sep", ";").csv(path)
        sources[name] = path
    return D.to_parquet(spark, sources, fresh_path(spark, "columnar")).drop("path", "renamed")


@query("delimited_edge_cases", """WITH rows AS (SELECT c_custkey, c_name, c_nationkey FROM customer)
  SELECT 'repeated' AS table_name, count(*) AS rows, CAST(0 AS BIGINT) AS discarded, 'A -> A_2' AS renamed, CAST(sum(c_custkey + c_nationkey) AS BIGINT) AS keys FROM rows
  UNION ALL SELECT 'unclosed', count(*), count(*) + 2, '', CAST(sum(c_custkey + 10) AS BIGINT) FROM rows""")
def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header whose names differ in case only; and a file in which the quote of one record is never closed: as many
    good rows stand before it as lines after it."""
    customers = table(spark, sf_dir, "customer")
    repeated, unclosed, out = fresh_path(spark, "repeated"), fresh_path(spark, "unclosed"), fresh_path(spark, "edges")
    head = spark.range(1).select(F.lit("a,A,b").alias("value"), F.lit(-1).cast("long").alias("n"))
    rows = customers.select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "c_name").alias("value"), F.col("c_custkey").cast("long").alias("n"))
    head.unionByName(rows).repartitionByRange(1, "n").sortWithinPartitions("n").select("value").write.text(repeated)
    quoted = [F.concat(F.col("c_custkey").cast("string"), F.lit(',"1'), F.lit('0",x')).alias("value"), F.col("c_custkey").cast("long").alias("n")]
    after = customers.select(F.lit("7,8,9").alias("value"), (F.col("c_custkey") + F.lit(1 << 40)).alias("n"))
    breaks = spark.createDataFrame([('a,"b\n",c', -1), ('1,"never closed', 1 << 39), ('still, open', (1 << 39) + 1)], "value string, n long")
    whole = breaks.unionByName(customers.select(*quoted)).unionByName(after)
    whole.repartitionByRange(1, "n").sortWithinPartitions("n").select("value").write.text(unclosed)
    found = D.to_parquet(spark, {"repeated": repeated, "unclosed": unclosed}, out)
    sums = spark.read.parquet(f"{out}/repeated").agg(F.sum(F.col("a").cast("long") + F.col("A_2").cast("long")).alias("keys")).withColumn("t", F.lit("repeated")).unionByName(
        spark.read.parquet(f"{out}/unclosed").toDF("a", "b", "c").agg(F.sum(F.col("a").cast("long") + F.col("b").cast("long")).alias("keys")).withColumn("t", F.lit("unclosed")))
    return found.join(sums, F.col("table_name") == F.col("t")).select("table_name", "rows", "discarded", F.concat_ws(", ", "renamed").alias("renamed"), "keys")


def _broken_lines(spark: SparkSession, sf_dir: str) -> str:
    """Orders as comma-separated lines in which those with status P have a field too many, written as text files
    that each start with the header."""
    path = fresh_path(spark, "broken")
    extra = F.when(F.col("o_orderstatus") == "P", F.lit("extra"))
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")], extra)
    lines = table(spark, sf_dir, "orders").select(line.alias("o_orderkey,o_orderstatus,o_orderpriority"))
    lines.write.option("header", True).option("sep", "\x01").option("quote", "\x00").csv(path)
    return path


@query("malformed_rows", """SELECT 'good' AS part, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT 'malformed', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'P'""")
def _malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _broken_lines(spark, sf_dir)
    found = D.layout(spark, path)
    good, bad = D.split_malformed(D.read_delimited(spark, path, found), found)
    kept = good.agg(F.count("*").alias("rows"), F.sum(F.col("c0").cast("long")).alias("keys")).withColumn("part", F.lit("good"))
    key = F.substring_index("line", ",", 1).cast("long")
    lost = bad.agg(F.count("*").alias("rows"), F.sum(key).alias("keys")).withColumn("part", F.lit("malformed"))
    return kept.unionByName(lost)


@query("malformed_line_texts", "SELECT o_orderkey || ',P,' || o_orderpriority || ',extra' AS text FROM orders WHERE o_orderstatus = 'P'")
def _malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _broken_lines(spark, sf_dir)
    return D.malformed_lines(spark, path, D.layout(spark, path)).select("text")


@query("file_digests", "SELECT item_id, octet_length(encode(text)) + 1 AS bytes, sha256(text || chr(10)) AS sha256 FROM benchmark")
def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each benchmark item, hashed line by line."""
    path = fresh_path(spark, "items")
    table(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("item")).repartition("item").write.partitionBy("item").text(path)
    found = D.file_digests(spark, path)
    return found.select(F.regexp_extract("path", "/item=([0-9]+)/", 1).cast("long").alias("item_id"), "bytes", "sha256")


@query("file_flags", """WITH lines AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderkey) + 1 AS line FROM orders), bad AS (SELECT line, row_number() OVER (ORDER BY line) AS n, count(*) OVER () AS total FROM lines WHERE o_orderstatus = 'P')
  SELECT 2 AS ordinal, 'malformed_rows' AS kind, string_agg('linha ' || line, ' | ' ORDER BY n) FILTER (n <= 8) || CASE WHEN max(total) > 8 THEN ' | … e mais ' || (max(total) - 8) ELSE '' END AS items, CAST(max(total) AS INTEGER) AS n_items,
    'Estas linhas foram excluídas dos números acima; trate as métricas como incompletas.' AS action FROM bad HAVING count(*) > 0
  UNION ALL SELECT 6, 'encoding', 'windows-1252', 1, 'O código de carga gerado já informa essa codificação. Se puder, exporte em UTF-8 para evitar surpresas.'""")
def _file_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one windows-1252 file in which those with status P have a field too many."""
    from plumbline.plans.intake import profile_file

    path = fresh_path(spark, "orders-1252")
    extra = F.when(F.col("o_orderstatus") == "P", F.lit("extra"))
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.concat("o_orderpriority", F.lit(" preço")), extra)
    rows = table(spark, sf_dir, "orders").select(line.alias("chave;prioridade"), "o_orderkey").orderBy("o_orderkey").drop("o_orderkey")
    # Sorted by all tasks; the one that writes the file takes range after range as they are kept.
    kept_in_order(rows).coalesce(1).write.option("header", True).option("sep", "\x01").option("quote", "\x00").option("encoding", "windows-1252").csv(path)
    return profile_file(spark, path, "orders").flags.filter(F.col("kind").isin("malformed_rows", "encoding")).select(
        "ordinal", "kind", F.concat_ws(" | ", "items").alias("items"), "n_items", "action")


@query("safe_parameters", """WITH v AS (SELECT lower(p_brand) AS v FROM part UNION ALL SELECT 'T_' || p_partkey FROM part UNION ALL SELECT 't' || p_partkey || chr(10) FROM part UNION ALL SELECT url FROM pages UNION ALL SELECT NULL FROM region)
  SELECT coalesce(regexp_full_match(v, '[A-Za-z_][A-Za-z0-9_]{0,127}'), false) AS identifier, coalesce(regexp_full_match(v, '[A-Za-z0-9_./:@ -]{1,300}'), false) AS path, count(*) AS n FROM v GROUP BY ALL""")
def _safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, made-up table names, the same with a line end, urls, and nothing."""
    part, v = table(spark, sf_dir, "part"), "v"
    key = F.col("p_partkey").cast("string")
    values = part.select(F.lower("p_brand").alias(v)).unionByName(part.select(F.concat(F.lit("T_"), key).alias(v))).unionByName(
        part.select(F.concat(F.lit("t"), key, F.lit("\n")).alias(v))).unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias(v))).unionByName(
        table(spark, sf_dir, "region").select(F.lit(None).cast("string").alias(v)))
    return values.groupBy(N.is_identifier(F.col(v)).alias("identifier"), N.is_safe_path(F.col(v)).alias("path")).agg(F.count("*").alias("n"))


@query("content_hashes", "SELECT page_id, sha256(html) AS sha256, true AS utf8 FROM pages")
def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.is_valid_utf8("html").alias("utf8"))


def _written(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A table as quoted delimited text; texts hold line breaks, and those of documents run to 100 000 characters."""
    path = fresh_path(spark, name)
    as_text(table(spark, sf_dir, name)).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return path


@query("delimited_round_trip", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(text) AS text_md5 FROM conversations")
def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir, "conversations")
    good, _ = D.split_malformed(D.read_delimited(spark, path, found := D.layout(spark, path)), found)
    return good.toDF(*found.header).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("delimited_long_texts", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang, source FROM documents")
def _long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir, "documents")
    good, _ = D.split_malformed(D.read_delimited(spark, path, found := D.layout(spark, path)), found)
    return good.toDF(*found.header).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


@query("malformed_records_with_line_breaks", "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations WHERE role = 'user'")
def _malformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of users have a field too many; their texts hold line breaks, quotes and delimiters."""
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.lit(', "x"\n,"')))
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    extra = F.when(F.col("role") == "user", F.lit("extra"))
    line = F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string"), quoted, extra)
    path = fresh_path(spark, "records")
    # Four files, each with the header first.
    lines = rows.select((F.col("conv_id") % 4).alias("file"), F.lit(1).alias("turn"), line.alias("value")).unionByName(
        spark.range(4).select(F.col("id").alias("file"), F.lit(0).alias("turn"), F.lit("conv_id,turn,text").alias("value")))
    lines.repartition(4, "file").sortWithinPartitions("file", "turn").select("file", "value").write.partitionBy("file").text(path)
    found = D.layout(spark, path)
    cells = F.from_csv("text", F.lit("conv_id long, turn long, text string, extra string"), {"escape": '"', "ignoreTrailingWhiteSpace": "false"})
    kept = D.malformed_lines(spark, path, found).select(cells.alias("c")).select("c.*").filter("extra = 'extra'")
    return kept.select("conv_id", "turn", F.md5(F.replace("text", F.lit(', "x"\n,"'), F.lit(""))).alias("text_md5"))
