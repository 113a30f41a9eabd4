"""Catalog evidence over the given tables and over a catalog derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import types as Y
from plumbline.operators import evidence as E
from plumbline.queries.registry import query, spread, table
from plumbline.session import fresh_path
from plumbline.sources import catalogs as C

# ---- a catalog in which every part is a table with four columns ---------------------------------------------------

HIVE_TYPES = ["STRING", "INT", "BIGINT", "DOUBLE", "DECIMAL", "ARRAY", "MAP", "DATE", "CHAR", "decimal(10,2)", "string", "varchar"]
WAREHOUSE_TYPES = ["VARCHAR", "NUMBER", "FLOAT", "TIMESTAMP_TZ", "VARIANT", "OBJECT", "ARRAY", "GEOGRAPHY", "BINARY", "TIMESTAMP_NTZ"]
ORACLE_TYPES = ["VARCHAR2", "NUMBER", "FLOAT", "DATE", "TIMESTAMP", "CLOB", "BLOB", "XMLTYPE", "LONG RAW"]

TABLE_ROW = {
    "database": "p_brand", "schema": "lower(p_type)", "table_name": "concat('t_', CAST(p_partkey AS STRING))",
    "row_count": "p_partkey * 1000 + p_size", "size_gb": "CAST(p_retailprice AS DECIMAL(18,2))",
    "table_format": "CASE WHEN p_size < 10 THEN 'TEXTFILE' WHEN p_size < 30 THEN 'ORC' ELSE 'PARQUET' END",
    "table_type": "CASE WHEN p_size > 45 THEN 'TRANSIENT' ELSE 'TABLE' END",
    "clustering_key": "CASE WHEN p_size > 48 THEN concat('LINEAR(c', CAST(p_size AS STRING), ')') ELSE '' END",
}


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    partitions = F.when(F.col("p_size") > 25, F.array(F.lit("dt"))).otherwise(F.array().cast("array<string>"))
    keys = F.when(F.col("p_size") > 40, F.array(F.concat(F.lit("fk_"), "p_brand"))).otherwise(F.array().cast("array<string>"))
    return parts.selectExpr("*", *[f"{sql} AS `{n}`" for n, sql in TABLE_ROW.items()]).select(
        *TABLE_ROW, partitions.alias("partitions"), keys.alias("foreign_keys"), "p_size")


TABLES_SQL = "SELECT " + ", ".join(f'{sql.replace("STRING", "VARCHAR")} AS "{n}"' for n, sql in TABLE_ROW.items()) + ", p_size FROM part"


def catalog_columns(spark: SparkSession, sf_dir: str, pool: list[str]) -> DataFrame:
    types = F.array(*[F.lit(t) for t in pool])
    rows = catalog_tables(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select(
        "database", "schema", "table_name", F.concat(F.lit("Col"), F.col("i").cast("string")).alias("column"),
        F.get(types, (F.col("p_size") + F.col("i")) % len(pool)).alias("type"), ((F.col("p_size") + F.col("i")) % 2 == 0).alias("nullable"), "p_size", "i")


def _columns_sql(pool: list[str]) -> str:
    return f"""SELECT database, schema, table_name, 'Col' || i AS "column", ({pool!r})[(p_size + i) % {len(pool)} + 1] AS type, (p_size + i) % 2 = 0 AS nullable, p_size, i
      FROM ({TABLES_SQL}), range(4) r(i)"""


@query("catalog_tables_from_json", f"SELECT database, table_name, row_count, CAST(size_gb AS DOUBLE) AS size_gb, table_format, CAST(p_size > 25 AS INTEGER) AS partitions FROM ({TABLES_SQL})")
def _json_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir)[0].select(
        "database", "table_name", "row_count", "size_gb", "table_format", F.size("partitions").alias("partitions"))


@query("catalog_columns_from_json", f"SELECT database, table_name, \"column\", type, nullable FROM ({_columns_sql(HIVE_TYPES)})")
def _json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir)[1].select("database", "table_name", "column", "type", "nullable")


def _round_trip(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Write one JSON catalog per table and read them all back."""
    rows = catalog_tables(spark, sf_dir)
    types = F.array(*[F.lit(t) for t in HIVE_TYPES])
    columns = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(
        F.concat(F.lit("Col"), i.cast("string")).alias("name"), F.get(types, (F.col("p_size") + i) % len(HIVE_TYPES)).alias("type"),
        ((F.col("p_size") + i) % 2 == 0).alias("nullable")))
    entry = F.struct("table_name", "row_count", F.col("size_gb").cast("double").alias("size_gb"), "table_format", "partitions", columns.alias("columns"))
    docs = rows.select(F.array(F.struct(F.col("database").alias("name"), F.array(entry).alias("tables"))).alias("databases"))
    path = fresh_path(spark, "catalog")
    docs.write.json(path)
    return C.flatten_source(spark.read.schema(C.SOURCE_SCHEMA).json(path))


def _case(expr: str, table_: dict[str, str], default: str) -> str:
    whens = " ".join("WHEN '{}' THEN '{}'".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in table_.items())
    return f"CASE {expr} {whens} ELSE {default} END"


@query("hive_type_mapping", f"SELECT type, {_case('lower(trim(split_part(type, chr(40), 1)))', Y.HIVE_TO_TSQL, repr('nvarchar(max)'))} AS tsql, "
       f"{_case('type', Y.HIVE_TO_LAKE, repr('STRING'))} AS lake, count(*) AS n FROM ({_columns_sql(HIVE_TYPES)}) GROUP BY ALL")
def _hive(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.col("type")
    return catalog_columns(spark, sf_dir, HIVE_TYPES).groupBy("type").agg(F.count("*").alias("n")).select(
        "type", Y.hive_to_tsql(declared).alias("tsql"), Y.hive_to_lake(declared).alias("lake"), "n")


_WAREHOUSE_NOTE = _case("type", Y.WAREHOUSE_WARNINGS, f"CASE WHEN type IN ({', '.join(map(repr, Y.WAREHOUSE_TO_DELTA))}) THEN NULL ELSE 'Tipo desconhecido: ' || type END")


@query("warehouse_type_mapping", f"SELECT type, {_case('type', Y.WAREHOUSE_TO_DELTA, repr('STRING'))} AS delta, {_WAREHOUSE_NOTE} AS warning, count(*) AS n FROM ({_columns_sql(WAREHOUSE_TYPES)}) GROUP BY ALL")
def _warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.col("type")
    return catalog_columns(spark, sf_dir, WAREHOUSE_TYPES).groupBy("type").agg(F.count("*").alias("n")).select(
        "type", Y.warehouse_to_delta(declared).alias("delta"), Y.warehouse_warning(declared).alias("warning"), "n")


@query("oracle_type_mapping", f"SELECT type, {_case('type', Y.ORACLE_TO_DELTA, repr('STRING'))} AS delta, CASE WHEN type NOT IN ({', '.join(map(repr, Y.ORACLE_TO_DELTA))}) THEN 'Unknown type, fallback STRING' END AS warning, count(*) AS n FROM ({_columns_sql(ORACLE_TYPES)}) GROUP BY ALL")
def _oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.col("type")
    return catalog_columns(spark, sf_dir, ORACLE_TYPES).groupBy("type").agg(F.count("*").alias("n")).select(
        "type", Y.oracle_to_delta(declared).alias("delta"), Y.oracle_warning(declared).alias("warning"), "n")


_HADOOP_SQL = f"""SELECT database, table_name, "column", 'Tipo não suportado em Spark SQL: ' || type || ' (coluna ' || "column" || ')' AS warning FROM ({_columns_sql(HIVE_TYPES)})
    WHERE type NOT IN ('STRING', 'INT', 'BIGINT', 'DOUBLE', 'BOOLEAN', 'TIMESTAMP', 'DECIMAL', 'DATE')
  UNION ALL SELECT database, table_name, NULL, 'Tabela ' || table_name || ' em formato TEXT — converter para PARQUET é recomendado' FROM ({TABLES_SQL}) WHERE table_format = 'TEXTFILE'"""
_HOUSE_SQL = f"""SELECT database, table_name, "column", database || '.' || schema || '.' || table_name || '.' || "column" || ' (' || type || '): ' || note AS warning FROM (SELECT *, {_WAREHOUSE_NOTE} AS note FROM ({_columns_sql(WAREHOUSE_TYPES)})) WHERE note IS NOT NULL
  UNION ALL SELECT database, table_name, NULL, 'Tabela ' || schema || '.' || table_name || ' é TRANSIENT — sem Fail-safe; mapear para Delta table sem Time Travel estendido' FROM ({TABLES_SQL}) WHERE table_type = 'TRANSIENT'
  UNION ALL SELECT database, table_name, NULL, 'Tabela ' || schema || '.' || table_name || ' usa clustering_key ' || clustering_key || ' — avaliar Z-ORDER/liquid clustering no Delta' FROM ({TABLES_SQL}) WHERE clustering_key <> ''"""
_ORACLE_SQL = f"""SELECT database, table_name, "column", database || '.' || schema || '.' || table_name || '.' || "column" || ': Unknown type, fallback STRING' AS warning FROM ({_columns_sql(ORACLE_TYPES)}) WHERE type NOT IN ({', '.join(map(repr, Y.ORACLE_TO_DELTA))})"""


def _hadoop_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hadoop_warnings(catalog_tables(spark, sf_dir), catalog_columns(spark, sf_dir, HIVE_TYPES))


query("hadoop_warnings", _HADOOP_SQL)(_hadoop_warnings)


@query("warehouse_warnings", _HOUSE_SQL)
def _house_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.warehouse_warnings(catalog_tables(spark, sf_dir), catalog_columns(spark, sf_dir, WAREHOUSE_TYPES))


@query("oracle_warnings", _ORACLE_SQL)
def _oracle_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.oracle_warnings(catalog_columns(spark, sf_dir, ORACLE_TYPES))


@query("compatibility_report", f"""WITH w AS ({_HADOOP_SQL}) SELECT 'COMPATIBLE_WITH_WARNINGS' AS compatibility_status, (SELECT count(*) FROM w) AS warnings_count,
  string_agg(warning, ' | ' ORDER BY database, table_name, "column" NULLS LAST) AS warnings FROM (SELECT * FROM w ORDER BY database, table_name, "column" NULLS LAST, warning LIMIT 10)""")
def _compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compatibility(_hadoop_warnings(spark, sf_dir)).withColumn("warnings", F.concat_ws(" | ", "warnings"))


@query("capacity_estimate", f"""SELECT total_tables, total_databases, total_rows, total_size_gb, cu AS estimated_cu, cu * 20 AS daily_cost_usd, cu * 600 AS monthly_cost_usd FROM
  (SELECT count(*) AS total_tables, count(DISTINCT database) AS total_databases, CAST(sum(row_count) AS BIGINT) AS total_rows, CAST(sum(size_gb) AS DOUBLE) AS total_size_gb,
    CAST(greatest(4, floor(CAST(sum(size_gb) AS DOUBLE) / 100) * 2) AS BIGINT) AS cu FROM ({TABLES_SQL}))""")
def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.capacity(catalog_tables(spark, sf_dir))


_MOVE = "SELECT '{0}' AS source, CAST(floor(s / {1}) + 2 AS BIGINT) AS duration_hours, CAST(round(s * {2}, 2) AS DOUBLE) AS cost_usd FROM (SELECT CAST(sum(size_gb) AS DOUBLE) AS s FROM ({3}))"


@query("transfer_estimates", " UNION ALL ".join((_MOVE.format("hadoop", 100, "0.05::DOUBLE", TABLES_SQL), _MOVE.format("warehouse", 150, "0.04::DOUBLE", TABLES_SQL))))
def _transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = catalog_tables(spark, sf_dir)
    return E.transfer_estimate(tables).withColumn("source", F.lit("hadoop")).unionByName(
        E.transfer_estimate(tables, 150, 0.04).withColumn("source", F.lit("warehouse")))


@query("database_rollup", f"SELECT database, count(*) AS tables, CAST(sum(row_count) AS BIGINT) AS rows, CAST(sum(size_gb) AS DOUBLE) AS size_gb FROM ({TABLES_SQL}) GROUP BY database")
def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.database_rollup(catalog_tables(spark, sf_dir)).withColumn("size_gb", F.col("size_gb").cast("double"))


@query("partitioned_tables", f"SELECT database, table_name FROM ({TABLES_SQL}) WHERE p_size > 25")
def _partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.partitioned_tables(catalog_tables(spark, sf_dir)).select("database", "table_name")


@query("text_tables", f"SELECT database, table_name, row_count, CAST(size_gb AS DOUBLE) AS size_gb, CAST(size_gb * 0.9 AS DOUBLE) AS saved_gb FROM ({TABLES_SQL}) WHERE table_format = 'TEXTFILE'")
def _text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.text_tables(catalog_tables(spark, sf_dir))
    return found.withColumn("size_gb", F.col("size_gb").cast("double")).withColumn("saved_gb", F.round("saved_gb", 6).cast("double"))


@query("risk_assessment", f"""WITH t AS (SELECT sum(size_gb) AS gb, count(*) AS n, count(*) FILTER (p_size > 25) AS p FROM ({TABLES_SQL}))
  SELECT 'R001' AS risk_id, 'Data Volume' AS category, 'high' AS severity, 'Large data volume (' || CAST(CAST(gb AS DECIMAL(38,1)) AS VARCHAR) || ' GB) - migration window may exceed SLA' AS description FROM t WHERE gb > 100
  UNION ALL SELECT 'R002', 'Schema Complexity', 'medium', p || ' partitioned tables require partition pruning strategy' FROM t WHERE p > 0
  UNION ALL SELECT 'R003', 'Type Mapping', 'medium', 'Hive complex types (array, map, struct) mapped to JSON - validate application queries'
  UNION ALL SELECT 'R004', 'Dependencies', 'medium', n || ' tables may have inter-table dependencies' FROM t WHERE n > 10""")
def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.risks(catalog_tables(spark, sf_dir))


@query("plan_validation", f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER ({_case('lower(trim(split_part(type, chr(40), 1)))', Y.HIVE_TO_TSQL, repr('nvarchar(max)'))} = 'nvarchar(max)' AND type NOT IN ('string', 'varchar')) AS u FROM ({_columns_sql(HIVE_TYPES)})),
  t AS (SELECT count(*) AS n, CAST(greatest(4, floor(CAST(sum(size_gb) AS DOUBLE) / 100) * 2) * 600 AS BIGINT) AS monthly FROM ({TABLES_SQL}))
  SELECT 'Schema Coverage' AS "check", 'passed' AS status, 'All ' || n || ' tables have schema definitions' AS message FROM t
  UNION ALL SELECT 'Type Mapping', 'warning', u || ' columns mapped to default type (nvarchar(max))' FROM c
  UNION ALL SELECT 'Capacity Limits', CASE WHEN monthly > 100000 THEN 'warning' ELSE 'passed' END, CASE WHEN monthly > 100000 THEN 'High monthly cost estimate: $' || format('{{:,}}', monthly) || ' - review optimization' ELSE 'Capacity within limits: $' || format('{{:,}}', monthly) || '/month' END FROM t""")
def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.plan_validation(catalog_tables(spark, sf_dir), catalog_columns(spark, sf_dir, HIVE_TYPES))


# ---- the same catalog after a migration that changed some of it ----------------------------------------------------


def migrated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = catalog_tables(spark, sf_dir).filter("p_size <> 7")
    return tables.withColumn("row_count", F.when(F.col("p_size") == 11, F.col("row_count") - 1).otherwise(F.col("row_count"))).withColumn(
        "foreign_keys", F.when(F.col("p_size") == 44, F.array(F.lit("fk_other"))).otherwise(F.col("foreign_keys")))


def migrated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = catalog_columns(spark, sf_dir, HIVE_TYPES).filter("NOT (p_size = 20 AND i = 3)")
    return columns.withColumn("column", F.when((F.col("p_size") == 21) & (F.col("i") == 0), F.lower("column")).otherwise(F.col("column"))).withColumn(
        "nullable", F.when((F.col("p_size") == 22) & (F.col("i") == 1), ~F.col("nullable")).otherwise(F.col("nullable")))


_COUNTS_SQL = f"SELECT database, schema, table_name, row_count AS source_rows, CASE WHEN p_size = 7 THEN NULL WHEN p_size = 11 THEN row_count - 1 ELSE row_count END AS target_rows, CASE WHEN p_size IN (7, 11) THEN 'failed' ELSE 'passed' END AS status FROM ({TABLES_SQL})"


@query("catalog_row_counts", _COUNTS_SQL)
def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table_row_counts(catalog_tables(spark, sf_dir), migrated_tables(spark, sf_dir))


@query("row_count_reconciliation", f"SELECT CAST(sum(source_rows) AS BIGINT) AS source_rows, CAST(sum(target_rows) AS BIGINT) AS target_rows, count(*) FILTER (status = 'failed') AS tables_failed, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'passed' END AS status FROM ({_COUNTS_SQL})")
def _row_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.row_count_check(catalog_tables(spark, sf_dir), migrated_tables(spark, sf_dir))


@query("schema_drift", f"""SELECT database, schema, table_name, "column", 'source' AS side FROM ({_columns_sql(HIVE_TYPES)}) WHERE (p_size = 20 AND i = 3) OR (p_size = 21 AND i = 0)
  UNION ALL SELECT database, schema, table_name, lower("column"), 'target' FROM ({_columns_sql(HIVE_TYPES)}) WHERE p_size = 21 AND i = 0""")
def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.schema_drift(catalog_columns(spark, sf_dir, HIVE_TYPES), migrated_columns(spark, sf_dir))


@query("nullability_drift", f"SELECT database, schema, table_name, \"column\", nullable AS source_nullable, NOT nullable AS target_nullable FROM ({_columns_sql(HIVE_TYPES)}) WHERE p_size = 22 AND i = 1")
def _nullability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.nullability_drift(catalog_columns(spark, sf_dir, HIVE_TYPES), migrated_columns(spark, sf_dir))


@query("foreign_key_drift", f"SELECT database, schema, table_name, CASE WHEN p_size > 40 THEN 'fk_' || database ELSE '' END AS source_keys, CASE WHEN p_size = 44 THEN 'fk_other' ELSE '' END AS target_keys FROM ({TABLES_SQL}) WHERE p_size IN (7, 44)")
def _keys_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.foreign_key_drift(catalog_tables(spark, sf_dir), migrated_tables(spark, sf_dir))
    return found.select("database", "schema", "table_name", F.concat_ws(",", "source_keys").alias("source_keys"), F.concat_ws(",", "target_keys").alias("target_keys"))


RELATIONS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "supplier", "s_suppkey"), ("lineitem", "l_partkey", "orders", "o_custkey"),
]


@query("orphan_rows", " UNION ALL ".join(
    f"SELECT '{c}.{ck} -> {p}.{pk}' AS relation, count(*) AS orphan_rows, count(DISTINCT {ck}) AS orphan_keys FROM {c} WHERE {ck} IS NOT NULL AND {ck} NOT IN (SELECT {pk} FROM {p})" for c, ck, p, pk in RELATIONS))
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [E.orphans(table(spark, sf_dir, c), ck, table(spark, sf_dir, p), pk, f"{c}.{ck} -> {p}.{pk}") for c, ck, p, pk in RELATIONS]
    return reduce(DataFrame.unionByName, found)


_RUNTIME_DIGEST = "CAST(sum(CAST(CAST(('0x' || substr(md5(concat({0})), 1, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR)"


def _runtime_sql(name: str, columns: list[str], extra: int, checksum: str) -> str:
    texts = ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in columns)
    empty = " + ".join(f"count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '')" for c in columns)
    target = f"count(*) + {extra}" if extra >= 0 else "0"
    return (f"SELECT '{name}' AS table_name, 'checked' AS status, NULL AS reason, count(*) AS rows_loaded, count(*) AS expected_source_rows, {target} AS expected_target_rows, 'passed' AS row_count_status, "
            f"'{checksum}' AS checksum_status, {_RUNTIME_DIGEST.format(texts)} AS digest, {empty} AS null_cells, {_nulls_sql(columns)} AS nulls FROM {name}")


def _nulls_sql(columns: list[str]) -> str:
    return " || ', ' || ".join(f"'{c}=' || count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '')" for c in columns)


def _shown_nulls(found: DataFrame) -> DataFrame:
    text = F.transform("nulls", lambda e: F.concat(e["column"], F.lit("="), e["n"]))
    return found.withColumn("nulls", F.when(F.col("nulls").isNotNull(), F.array_join(text, ", ")))


@query("runtime_checks", " UNION ALL ".join((
    _runtime_sql("nation", ["n_nationkey", "n_name", "n_regionkey"], 0, "passed"),
    _runtime_sql("labels", ["doc_id", "quality", "toxic"], 1, "failed"),
    _runtime_sql("conversations", ["conv_id", "turn", "role", "text"], -1, "unknown"),
    "SELECT 'lineitem', 'skipped', 'csv_not_found', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL")))
def _runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(name: str, extra: int) -> DataFrame:
        return table(spark, sf_dir, name).agg((F.count("*") + extra).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")

    source = reduce(DataFrame.unionByName, [counted(n, 0) for n in ("nation", "labels", "conversations", "lineitem")])
    target = counted("nation", 0).unionByName(counted("labels", 1))
    loaded = reduce(DataFrame.unionByName, [E.loaded_stats(spread(table(spark, sf_dir, n)), n) for n in ("nation", "labels", "conversations")])
    return _shown_nulls(E.runtime_checks(source, target, loaded))


def _delivered_sql(database: str, name: str, columns: list[str], target: str, checksum: str) -> str:
    texts = ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in columns)
    empty = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
    return (f"SELECT '{database}' AS database, 't' AS table_name, 'checked' AS status, NULL AS reason, count(*) AS rows_loaded, count(*) AS expected_source_rows, {target} AS expected_target_rows, "
            f"'passed' AS row_count_status, '{checksum}' AS checksum_status, {_RUNTIME_DIGEST.format(texts)} AS digest, {empty} AS null_cells, {_nulls_sql(columns)} AS nulls FROM {name}")


@query("runtime_checks_from_files", " UNION ALL ".join((
    _delivered_sql("first", "customer", ["c_custkey", "c_name", "c_nationkey"], "count(*)", "passed"),
    _delivered_sql("second", "(SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus FROM orders)", ["o_orderkey", "o_orderstatus"], "count(*) + 1", "failed"),
    "SELECT 'second', 'lost', 'skipped', 'csv_not_found', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL",
    "SELECT 'third', 't', 'skipped', 'csv_not_found', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL",
    "SELECT 'third', 'twice', 'ambiguous', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL")))
def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of one name in two databases, tables without a file, and one that the catalog names twice."""
    from plumbline.plans.runtime import check_delivered

    root = fresh_path(spark, "delivered")
    tables = {"first": table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"),
              "second": table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"))}
    for database, df in tables.items():
        df.write.option("header", True).csv(f"{root}/{database}/t.csv")

    def listed(extra: int) -> list[DataFrame]:
        return [df.agg((F.count("*") + extra * (d == "second")).alias("row_count")).select(F.lit(d).alias("database"), F.lit("t").alias("table_name"), "row_count") for d, df in tables.items()]

    more = spark.createDataFrame([("second", "lost", 7), ("third", "t", 7), ("third", "twice", 7), ("third", "twice", 8)], "database string, table_name string, row_count long")
    return _shown_nulls(check_delivered(reduce(DataFrame.unionByName, [*listed(0), more]), reduce(DataFrame.unionByName, listed(1)), root))


@query("lineage_edges", """SELECT DISTINCT 'job_' || o_custkey AS job_name, 'input' AS direction, o_orderpriority AS dataset FROM orders
  UNION ALL SELECT DISTINCT 'job_' || o_custkey, 'output', o_orderstatus || '_' || o FROM orders, (VALUES ('raw'), ('clean')) v(o)""")
def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("job_"), F.col("o_custkey").cast("string")).alias("job_name"),
        F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("inputs"),
        F.array(*[F.struct(F.concat("o_orderstatus", F.lit(f"_{o}")).alias("name")) for o in ("raw", "clean")]).alias("outputs"))
    return E.lineage_edges(jobs)


@query("grants_per_principal", "SELECT 'user_' || user_id AS principal_name, CAST(count(*) + count(*) FILTER (value > 50) AS BIGINT) AS grants, count(DISTINCT event_type) + CAST(bool_or(value > 50) AS BIGINT) AS permissions FROM events GROUP BY user_id")
def _grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("principal_name"), F.col("event_id").cast("string").alias("resource_name"),
        F.array_compact(F.array(F.col("event_type"), F.when(F.col("value") > 50, F.lit("ALL")))).alias("permissions"))
    return E.grants_per_principal(grants)
