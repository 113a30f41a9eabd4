"""Profiles, value readings and flags over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import types as Y
from plumbline.functions import values as V
from plumbline.operators import flags as G
from plumbline.operators import profile as P
from plumbline.operators.cells import cells
from plumbline.queries.registry import query, spread, table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]

# ---- the tables as text -------------------------------------------------------------------------------------------

# Per table: its columns as text for Spark and, where the spelling differs, for DuckDB.
MONEY = "CAST(CAST({0} AS DECIMAL(18,2)) AS STRING)"
TEXT_TABLES: dict[str, dict[str, tuple[str, str]]] = {
    "orders": {
        "o_orderkey": ("CAST(o_orderkey AS STRING)",) * 2,
        "o_custkey": ("CAST(o_custkey AS STRING)",) * 2,
        "o_orderstatus": ("o_orderstatus",) * 2,
        "o_totalprice": (MONEY.format("o_totalprice"),) * 2,
        "o_orderdate": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
        "o_orderpriority": ("o_orderpriority",) * 2,
    },
    "customer": {
        "c_custkey": ("lpad(CAST(c_custkey AS STRING), 9, '0')",) * 2,
        "c_name": ("concat('  ', c_name, ' ')",) * 2,
        "c_nationkey": ("CAST(c_nationkey AS STRING)",) * 2,
        "c_acctbal": (MONEY.format("c_acctbal"),) * 2,
        "c_positive": ("CASE WHEN c_acctbal >= 0 THEN 'TRUE' ELSE 'false' END",) * 2,
        "c_mktsegment": ("CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END",) * 2,
    },
    "lineitem": {
        "l_orderkey": ("CAST(l_orderkey AS STRING)",) * 2,
        "l_partkey": ("CAST(l_partkey AS STRING)",) * 2,
        "l_suppkey": ("CAST(l_suppkey AS STRING)",) * 2,
        "l_linenumber": ("CAST(l_linenumber AS STRING)",) * 2,
        "l_quantity": ("CAST(CAST(l_quantity AS DECIMAL(18,1)) AS STRING)",) * 2,
        "l_extendedprice": ("translate(format_number(l_extendedprice, 2), ',.', '.,')",
                            "translate(format('{:,.2f}', l_extendedprice), ',.', '.,')"),
        "l_discount": (MONEY.format("l_discount"),) * 2,
        "l_tax": (MONEY.format("l_tax"),) * 2,
        "l_returnflag": ("l_returnflag",) * 2,
        "l_linestatus": ("CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linestatus END",) * 2,
        "l_shipdate": ("date_format(l_shipdate, 'dd/MM/yyyy')", "strftime(l_shipdate, '%d/%m/%Y')"),
        "l_shipday": ("date_format(l_shipdate, 'MM.dd.yyyy HH:mm')", "strftime(l_shipdate, '%m.%d.%Y %H:%M')"),
    },
    "events": {
        "event_id": ("CAST(event_id AS STRING)",) * 2,
        "ts": ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "strftime(ts, '%Y-%m-%dT%H:%M:%S')"),
        "user_id": ("CAST(user_id AS STRING)",) * 2,
        "event_type": ("event_type",) * 2,
        "value": ("CASE WHEN event_type = 'error' THEN 'n/a' ELSE " + MONEY.format("value") + " END",) * 2,
        "props": ("props",) * 2,
    },
    "documents": {
        "doc_id": ("CAST(doc_id AS STRING)",) * 2,
        "text": ("text",) * 2,
        "lang": ("lang",) * 2,
        "source": ("source",) * 2,
        "n_chars": ("CAST(n_chars AS STRING)",) * 2,
    },
    "labels": {
        "doc_id": ("CAST(doc_id AS STRING)",) * 2,
        "quality": ("CAST(quality AS STRING)",) * 2,
        "toxic": ("CAST(toxic AS STRING)",) * 2,
    },
}
WS = "'" + V.WHITESPACE + "'"


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, name))
    return rows.selectExpr(*[f"{sql} AS {column}" for column, (sql, _) in TEXT_TABLES[name].items()])


def text_table_sql(name: str) -> str:
    return "SELECT " + ", ".join(f"{sql.replace('STRING', 'VARCHAR')} AS {c}" for c, (_, sql) in TEXT_TABLES[name].items()) + f" FROM {name}"


CLASSIFY_SQL = """CASE WHEN value IS NULL THEN NULL
  WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN 'integer'
  WHEN regexp_full_match(value, '[+-]?[0-9]{1,3}([.][0-9]{3})+') THEN 'int_thousands'
  WHEN regexp_full_match(value, '[+-]?([0-9]{1,3}([.][0-9]{3})+|[0-9]+),[0-9]+') THEN 'decimal_br'
  WHEN regexp_full_match(value, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?') THEN 'decimal'
  WHEN lower(value) IN ('true', 'false') THEN 'boolean'
  WHEN day_first IS NOT NULL OR month_first IS NOT NULL THEN 'date' ELSE 'text' END"""


def readings_sql(source: str, keys: str) -> str:
    """CTEs from ``source(keys, cell)`` to ``readings``: kinds and both readings, written the DuckDB way."""
    return f"""
valued AS (SELECT {keys}, nullif(trim(cell, {WS}), '') AS value FROM {source}),
spelled AS (SELECT *, regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?)?') AS iso,
    regexp_full_match(value, '([0-9]{{1,2}}/[0-9]{{1,2}}/|[0-9]{{1,2}}[.][0-9]{{1,2}}[.]|[0-9]{{1,2}}-[0-9]{{1,2}}-)[0-9]{{4}}([ T][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)?') AS dmy
  FROM valued),
parts AS (SELECT *, regexp_extract(value, '^([0-9]+)', 1) AS p1, regexp_extract(value, '^[0-9]+[/.-]([0-9]+)', 1) AS p2,
    regexp_extract(value, '^[0-9]+[/.-][0-9]+[/.-]([0-9]+)', 1) AS p3 FROM spelled),
dated AS (SELECT *,
    CASE WHEN iso THEN try_cast(left(value, 10) AS DATE) WHEN dmy THEN try_cast(p3 || '-' || lpad(p2, 2, '0') || '-' || lpad(p1, 2, '0') AS DATE) END AS day_first,
    CASE WHEN iso THEN try_cast(left(value, 10) AS DATE) WHEN dmy THEN try_cast(p3 || '-' || lpad(p1, 2, '0') || '-' || lpad(p2, 2, '0') AS DATE) END AS month_first
  FROM parts),
kinds AS (SELECT *, {CLASSIFY_SQL} AS kind FROM dated),
texts AS (SELECT *, CASE WHEN kind IN ('integer', 'int_thousands', 'decimal') THEN value END AS us_text,
    CASE WHEN kind = 'integer' THEN value WHEN kind IN ('int_thousands', 'decimal_br') THEN replace(replace(value, '.', ''), ',', '.') END AS br_text
  FROM kinds),
readings AS (SELECT *, try_cast(us_text AS DECIMAL(38,10)) AS us, try_cast(br_text AS DECIMAL(38,10)) AS br FROM texts)"""


def _plain(expr: str) -> str:
    return f"rtrim(rtrim(CAST({expr} AS VARCHAR), '0'), '.')"


def _digits(text: str) -> str:
    return f"greatest(1, length(ltrim(split_part(split_part(lower({text}), 'e', 1), '.', 1), '+-0')))"


def _scale(text: str) -> str:
    return f"length(split_part(split_part(lower({text}), 'e', 1), '.', 2))"


def profile_sql(source_sql: str, columns: list[str], dataset: str) -> str:
    cell_rows = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name, CAST({c} AS VARCHAR) AS cell FROM src" for i, c in enumerate(columns))
    return f"""
WITH src AS ({source_sql}), cells AS ({cell_rows}),{readings_sql('cells', 'position, name')},
seen AS (SELECT position, name, count(*) AS rows, count(*) - count(value) AS nulls, coalesce(max(length(value)), 0) AS max_len,
    list_sort(list_distinct(list(kind))) AS kinds,
    min(us) AS us_low, max(us) AS us_high, min(br) AS br_low, max(br) AS br_high,
    max({_digits('us_text')}) AS us_digits, max({_scale('us_text')}) AS us_scale,
    max({_digits('br_text')}) AS br_digits, max({_scale('br_text')}) AS br_scale,
    count(DISTINCT us) AS us_distinct, count(DISTINCT br) AS br_distinct,
    count(DISTINCT CASE WHEN kind = 'boolean' THEN lower(value) ELSE value END) AS raw_distinct,
    count(DISTINCT CASE WHEN kind = 'date' THEN concat_ws('~', iso, CASE WHEN NOT iso THEN regexp_extract(value, '[/.-]') END,
      CASE WHEN iso THEN contains(value, 'T') END, length(value) - length(replace(value, ':', ''))) END) AS patterns,
    bool_or(iso) AS any_iso, bool_and(day_first IS NOT NULL) FILTER (value IS NOT NULL) AS day_order, bool_and(month_first IS NOT NULL) FILTER (value IS NOT NULL) AS month_order,
    min(day_first) AS d_low, max(day_first) AS d_high, min(month_first) AS m_low, max(month_first) AS m_high,
    bool_or(dmy AND (length(p1) < 2 OR length(p2) < 2)) AS unpadded, bool_or(iso OR (length(p1) = 2 AND length(p2) = 2)) AS padded,
    any_value(CASE WHEN kind = 'date' THEN regexp_extract(value, '[/.-]') END) AS sep,
    max(CASE WHEN kind = 'date' THEN length(value) - length(replace(value, ':', '')) END) AS colons,
    bool_or(iso AND contains(value, 'T')) AS with_t
  FROM readings GROUP BY position, name),
typed AS (SELECT *, CASE WHEN len(kinds) = 0 THEN 'empty'
    WHEN list_has_all(['integer', 'int_thousands', 'decimal', 'decimal_br'], kinds) THEN
      CASE WHEN list_contains(kinds, 'decimal') AND list_contains(kinds, 'decimal_br') THEN 'mixed'
           WHEN kinds = ['integer'] THEN 'integer' ELSE 'decimal' END
    WHEN kinds = ['date'] THEN CASE WHEN patterns = 1 AND (day_order OR month_order) THEN 'date' ELSE 'mixed' END
    WHEN len(kinds) = 1 THEN kinds[1] ELSE 'mixed' END AS type,
    list_contains(kinds, 'decimal_br') AS as_br FROM seen),
counted AS (SELECT *, CASE WHEN type IN ('integer', 'decimal') THEN CASE WHEN as_br THEN br_distinct ELSE us_distinct END
    WHEN type = 'date' AND padded AND unpadded THEN NULL ELSE raw_distinct END AS n_distinct FROM typed)
SELECT '{dataset}' AS dataset, CAST(position AS INTEGER) AS position, name, type, rows, nulls,
  CASE WHEN rows > 0 THEN nulls / rows ELSE 0.0 END AS null_ratio, CAST(n_distinct AS BIGINT) AS "distinct", false AS distinct_capped,
  coalesce(n_distinct = rows - nulls AND rows > nulls, false) AS is_key_candidate,
  CASE WHEN type IN ('integer', 'decimal') THEN {_plain('CASE WHEN as_br THEN br_low ELSE us_low END')}
    WHEN type = 'date' THEN CAST(CASE WHEN day_order THEN d_low ELSE m_low END AS VARCHAR) END AS min,
  CASE WHEN type IN ('integer', 'decimal') THEN {_plain('CASE WHEN as_br THEN br_high ELSE us_high END')}
    WHEN type = 'date' THEN CAST(CASE WHEN day_order THEN d_high ELSE m_high END AS VARCHAR) END AS max,
  CAST(max_len AS INTEGER) AS max_len,
  CAST(CASE WHEN type IN ('integer', 'decimal') THEN CASE WHEN as_br THEN br_scale ELSE us_scale END END AS INTEGER) AS max_scale,
  CAST(CASE WHEN type IN ('integer', 'decimal') THEN CASE WHEN as_br THEN br_digits ELSE us_digits END END AS INTEGER) AS max_int_digits,
  CASE WHEN type = 'date' THEN (CASE WHEN any_iso THEN 'yyyy-MM-dd' ELSE
      CASE WHEN day_order THEN CASE WHEN unpadded THEN 'd' ELSE 'dd' END || sep || CASE WHEN unpadded THEN 'M' ELSE 'MM' END
           ELSE CASE WHEN unpadded THEN 'M' ELSE 'MM' END || sep || CASE WHEN unpadded THEN 'd' ELSE 'dd' END END || sep || 'yyyy' END)
    || CASE WHEN colons = 0 THEN '' ELSE CASE WHEN with_t THEN '''T''' ELSE ' ' END || 'HH:mm' || CASE WHEN colons = 2 THEN ':ss' ELSE '' END END
  END AS date_format,
  type = 'date' AND NOT any_iso AND day_order AND month_order AS date_ambiguous,
  coalesce(type = 'date' AND colons > 0, false) AS has_time,
  CASE WHEN type = 'decimal' THEN CASE WHEN as_br THEN 'br' ELSE 'us' END END AS number_style
FROM counted"""


def _register_profile(name: str) -> None:
    @query(f"column_profile_{name}", profile_sql(text_table_sql(name), list(TEXT_TABLES[name]), name))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.profile(text_table(spark, sf_dir, name), name).drop("out_of_range", "fingerprint")


for _name in TEXT_TABLES:
    _register_profile(_name)

# ---- numbers of any precision -------------------------------------------------------------------------------------

#: Fractions of 21 digits, whole numbers of 60 digits of both signs, and powers of ten.
PRECISE = {
    "fine": "concat(CAST(l_partkey AS STRING), '.', lpad(CAST(l_orderkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 9, '0'))",
    "wide": "concat(CASE WHEN l_linenumber = 1 THEN '-' ELSE '' END, '1', lpad(CAST(l_orderkey AS STRING), 30, '0'), lpad(CAST(l_partkey AS STRING), 29, '0'))",
    "power": "concat(CAST(l_linenumber AS STRING), 'e', CAST(30 + l_suppkey % 3 AS STRING))",
}
PRECISE_SQL = "SELECT *, " + ", ".join(f"{sql.replace('STRING', 'VARCHAR')} AS {c}" for c, sql in PRECISE.items()) + " FROM lineitem"


def precise_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem")).selectExpr(*[f"{sql} AS {c}" for c, sql in PRECISE.items()])


@query("column_profile_precise_numbers", f"""WITH src AS ({PRECISE_SQL}),
fine AS (SELECT arg_min(fine, (l_partkey, l_orderkey, l_suppkey)) AS low, arg_max(fine, (l_partkey, l_orderkey, l_suppkey)) AS high, count(DISTINCT (l_partkey, l_orderkey, l_suppkey)) AS n FROM src),
wide AS (SELECT arg_min(wide, CASE WHEN l_linenumber = 1 THEN (-l_orderkey, -l_partkey) ELSE (l_orderkey, l_partkey) END) AS low, arg_max(wide, CASE WHEN l_linenumber = 1 THEN (-l_orderkey, -l_partkey) ELSE (l_orderkey, l_partkey) END) AS high,
  count(DISTINCT (l_linenumber = 1, l_orderkey, l_partkey)) AS n FROM src),
power AS (SELECT min((l_suppkey % 3, l_linenumber)) AS low, max((l_suppkey % 3, l_linenumber)) AS high, count(DISTINCT (l_suppkey % 3, l_linenumber)) AS n FROM src),
lengths AS (SELECT count(*) AS rows, max(length(fine)) AS f, max(length(wide)) AS w, max(length(power)) AS p, max(length(CAST(l_partkey AS VARCHAR))) AS d, max(length(CAST(l_linenumber AS VARCHAR))) AS l FROM src)
SELECT 0 AS position, 'fine' AS name, 'decimal' AS type, rows, n AS "distinct", rtrim(low, '0') AS min, rtrim(high, '0') AS max, CAST(f AS INTEGER) AS max_len, 21 AS max_scale, CAST(d AS INTEGER) AS max_int_digits, CAST(0 AS BIGINT) AS out_of_range FROM fine, lengths
UNION ALL SELECT 1, 'wide', 'integer', rows, n, low, high, CAST(w AS INTEGER), 0, 60, 0 FROM wide, lengths
UNION ALL SELECT 2, 'power', 'decimal', rows, n, CAST(low[2] AS VARCHAR) || repeat('0', CAST(30 + low[1] AS INTEGER)), CAST(high[2] AS VARCHAR) || repeat('0', CAST(30 + high[1] AS INTEGER)), CAST(p AS INTEGER), 0, CAST(l AS INTEGER), 0 FROM power, lengths""")
def _precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.profile(precise_numbers(spark, sf_dir), "precise")
    return found.select("position", "name", "type", "rows", "distinct", "min", "max", "max_len", "max_scale", "max_int_digits", "out_of_range")


# ---- several tables at once ---------------------------------------------------------------------------------------


def text_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: text_table(spark, sf_dir, name) for name in TEXT_TABLES}


def all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile_many(text_tables(spark, sf_dir))


ALL_COLUMNS_SQL = " UNION ALL ".join(f"(SELECT * FROM ({profile_sql(text_table_sql(n), list(TEXT_TABLES[n]), n)}))" for n in TEXT_TABLES)
DUPLICATES_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, count(*) AS rows, count(*) - count(DISTINCT {{{', '.join(repr(c) + ': ' + c for c in TEXT_TABLES[n])}}}) AS duplicate_rows FROM ({text_table_sql(n)})"
    for n in TEXT_TABLES)


@query("profile_all_tables", ALL_COLUMNS_SQL)
def _profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_columns(spark, sf_dir).drop("out_of_range", "fingerprint")


# Every column of every table as it is stored; arrays go by their text.
STORED = {"region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey",
          "part": "p_partkey p_name p_brand p_type p_size", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
          "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
          "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text"}


@query("distinct_estimates", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{c}' AS name, count(DISTINCT nullif(trim(CAST({c} AS VARCHAR), {WS}), '')) AS \"distinct\", true AS within_four_errors FROM {t}" for t, cs in STORED.items() for c in cs.split()))
def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts beside estimates, which are merged from sketches of both halves of each table."""
    found = []
    for name, columns in STORED.items():
        half = F.pmod(F.xxhash64(columns.split()[0]), F.lit(2))
        df = table(spark, sf_dir, name).select(*[F.col(c).cast("string").alias(c) for c in columns.split()], half.alias("half"))
        found.append(df.unpivot(["half"], columns.split(), "name", "cell").select(F.lit(name).alias("dataset"), "name", "half", "cell"))
    rows = reduce(DataFrame.unionByName, found)
    keys = ["dataset", "name"]
    estimates = P.distinct_estimates(P.distinct_sketches(rows, [*keys, "half"]), keys)
    exact = P.dictionary(rows, keys).groupBy(*keys).agg(F.count("value").alias("distinct"))
    off = F.abs(F.col("distinct_estimate") - F.col("distinct")) <= 4 * P.SKETCH_ERROR * F.col("distinct")
    # One row for each column.
    return exact.join(F.broadcast(estimates), keys).select(*keys, "distinct", off.alias("within_four_errors"))


@query("duplicate_rows_all_tables", DUPLICATES_SQL)
def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.duplicate_rows(text_tables(spark, sf_dir))


@query("duplicate_document_texts", "SELECT 'documents' AS dataset, count(*) AS rows, count(*) - count(DISTINCT {'t': text, 'l': lang, 's': source}) AS duplicate_rows FROM documents")
def _document_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.duplicate_rows({"documents": spread(table(spark, sf_dir, "documents").select("text", "lang", "source"))})


TOTALS_SQL = f"""SELECT c.dataset, c.rows, c.columns, c.total_cells, c.empty_cells, d.duplicate_rows,
  c.total_cells - c.empty_cells AS filled_cells, CAST(0 AS BIGINT) AS rows_discarded
  FROM (SELECT dataset, max(rows) AS rows, count(*) AS columns, CAST(sum(rows) AS BIGINT) AS total_cells,
    CAST(sum(nulls) AS BIGINT) AS empty_cells FROM ({ALL_COLUMNS_SQL}) GROUP BY dataset) c
  JOIN ({DUPLICATES_SQL}) d USING (dataset)"""


def all_totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables = text_tables(spark, sf_dir)
    columns = P.profile_many(tables)
    return columns, P.dataset_totals(columns, P.duplicate_rows(tables))


@query("dataset_totals", TOTALS_SQL)
def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_totals(spark, sf_dir)[1]


@query("quality_ratios", f"""SELECT t.dataset, filled_cells / total_cells AS completeness, (rows - duplicate_rows) / rows AS row_uniqueness,
  q.consistent / t.columns AS type_consistency, CAST(1 AS DOUBLE) AS name_compatibility, CAST(1 AS DOUBLE) AS rows_kept
  FROM ({TOTALS_SQL}) t JOIN (SELECT dataset, count(*) FILTER (type <> 'mixed') AS consistent FROM ({ALL_COLUMNS_SQL}) GROUP BY dataset) q USING (dataset)""")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quality(*all_totals(spark, sf_dir))


@query("column_notes", f"""SELECT dataset, position, name, concat_ws('; ', CASE WHEN is_key_candidate THEN 'candidata a chave (valores únicos)' END,
  CASE type WHEN 'decimal' THEN 'decimal(' || (max_int_digits + max_scale) || ',' || max_scale || ') é o mínimo observado' || CASE WHEN number_style = 'br' THEN '; vírgula decimal e ponto de milhar' ELSE '' END
    WHEN 'integer' THEN 'faixa ' || min || ' a ' || max
    WHEN 'date' THEN 'de ' || min || ' a ' || max || '; formato ' || date_format || CASE WHEN date_ambiguous THEN ' (ambíguo: dia/mês assumido)' ELSE '' END
    WHEN 'text' THEN CASE WHEN max_len > 0 THEN 'até ' || max_len || ' caracteres' END END) AS note FROM ({ALL_COLUMNS_SQL})""")
def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.column_notes(all_columns(spark, sf_dir))


# ---- flags --------------------------------------------------------------------------------------------------------

FLAGGED_COLUMNS = {
    "doc id": ("CAST(d.doc_id AS STRING)",) * 2,
    "lang": ("lang",) * 2,
    "Lang": ("CASE WHEN d.doc_id % 2 = 0 THEN lang ELSE CAST(d.doc_id AS STRING) END",) * 2,
    "language": ("lang",) * 2,
    "quality": ("CAST(quality AS STRING)",) * 2,
    "day": ("concat('0', CAST(1 + n_chars % 9 AS STRING), '/0', CAST(1 + d.doc_id % 9 AS STRING), '/2024')",) * 2,
}


def flagged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels and columns that deserve every flag a table can raise."""
    joined = table(spark, sf_dir, "documents").alias("d").join(table(spark, sf_dir, "labels").alias("l"), "doc_id", "left")
    return joined.selectExpr(*[f"{sql.replace('d.doc_id', 'doc_id')} AS `{c}`" for c, (sql, _) in FLAGGED_COLUMNS.items()])


FLAGGED_SQL = "SELECT " + ", ".join(
    f"{sql.replace('STRING', 'VARCHAR')} AS f{i}" for i, (_, sql) in enumerate(FLAGGED_COLUMNS.values())
) + " FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
_FLAGGED_PROFILE = profile_sql(FLAGGED_SQL, [f"f{i}" for i in range(len(FLAGGED_COLUMNS))], "labelled documents")


@query("quality_flags", f"""WITH p AS ({_FLAGGED_PROFILE}),
  t AS (SELECT count(*) - count(DISTINCT {{'a': f0, 'b': f1, 'c': f2, 'd': f3, 'e': f4, 'f': f5}}) AS n FROM ({FLAGGED_SQL}))
  SELECT * FROM (SELECT 'labelled documents' AS dataset, CAST(0 AS INTEGER) AS ordinal, 'column_names' AS kind, '''doc id''' AS items, CAST(1 AS INTEGER) AS n_items
  UNION ALL SELECT 'labelled documents', 1, 'duplicate_columns', 'lang, Lang', 1
  UNION ALL SELECT 'labelled documents', 3, 'identical_columns', 'lang = language', CAST(1 AS INTEGER) WHERE (SELECT count(*) FROM documents WHERE lang IS DISTINCT FROM lang) = 0
  UNION ALL SELECT 'labelled documents', 4, 'mixed_types', string_agg(CASE position WHEN 2 THEN 'Lang' ELSE name END, ' | ' ORDER BY position), CAST(count(*) AS INTEGER) FROM p WHERE type = 'mixed' HAVING count(*) > 0
  UNION ALL SELECT 'labelled documents', 5, 'ambiguous_dates', string_agg('day (assumido ' || date_format || ')', ' | '), CAST(count(*) AS INTEGER) FROM p WHERE date_ambiguous HAVING count(*) > 0
  UNION ALL SELECT 'labelled documents', 7, 'mostly_empty', string_agg('quality (' || CAST(round_even(null_ratio * 100, 0) AS INTEGER) || '% vazia)', ' | '), CAST(count(*) AS INTEGER) FROM p WHERE null_ratio > 0.5 HAVING count(*) > 0
  UNION ALL SELECT 'labelled documents', 8, 'duplicate_rows', n || ' linhas idênticas a uma anterior', CAST(1 AS INTEGER) FROM t WHERE n > 0)""")
def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged_table(spark, sf_dir)
    named = {"labelled documents": rows}
    columns = P.profile_many(named)
    totals = P.dataset_totals(columns, P.duplicate_rows(named))
    raised = G.flags(columns, totals, G.identical_columns(rows, columns))
    return raised.drop("title", "action").withColumn("items", F.concat_ws(" | ", "items"))


@query("flag_listing", """SELECT p_type AS dataset, CASE WHEN count(*) > 8 THEN string_agg(item, ' | ' ORDER BY rn) FILTER (rn <= 8) || ' | … e mais ' || (count(*) - 8)
  ELSE string_agg(item, ' | ' ORDER BY rn) END AS items, count(*) AS n_items
  FROM (SELECT p_type, p_brand AS item, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS rn FROM (SELECT DISTINCT p_type, p_brand FROM part)) GROUP BY p_type""")
def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("dataset")).agg(F.array_sort(F.collect_set("p_brand")).alias("all"))
    return brands.select("dataset", F.concat_ws(" | ", G.listed(F.col("all"))).alias("items"), F.size("all").cast("long").alias("n_items"))


# ---- values -------------------------------------------------------------------------------------------------------


def classified_cells(df: DataFrame) -> DataFrame:
    return P.classified(P.dictionary(cells(df), ["position"]))


_ORDER_CELLS = " UNION ALL ".join(f"SELECT {i} AS position, {c} AS cell FROM src" for i, c in enumerate(TEXT_TABLES["events"]))


@query("value_kinds", f"WITH src AS ({text_table_sql('events')}), cells AS ({_ORDER_CELLS}),{readings_sql('cells', 'position')} "
       "SELECT CAST(position AS INTEGER) AS position, kind, count(*) AS cells, count(DISTINCT value) AS spellings FROM readings GROUP BY ALL")
def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classified_cells(text_table(spark, sf_dir, "events"))
    return found.groupBy(F.col("position").cast("int").alias("position"), "kind").agg(
        F.sum("n").alias("cells"), F.count("value").alias("spellings"))


_DATE_CELLS = "SELECT strftime(l_shipdate, '%d/%m/%Y') AS cell FROM lineitem UNION ALL SELECT strftime(l_shipdate, '%-m-%-d-%Y %H:%M') FROM lineitem UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders"


@query("date_readings", f"WITH cells AS ({_DATE_CELLS}),{readings_sql('cells', '1 AS one')} SELECT value, CAST(day_first AS VARCHAR) AS day_first, "
       "CAST(month_first AS VARCHAR) AS month_first, count(*) AS n FROM readings GROUP BY ALL")
def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    texts = (items.select(F.date_format("l_shipdate", "dd/MM/yyyy").alias("value"))
             .union(items.select(F.date_format("l_shipdate", "M-d-yyyy HH:mm")))
             .union(orders.select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))))
    counted = texts.groupBy("value").agg(F.count("*").alias("n"))
    # Every value is a date; a filter on the reading would be pushed below its steps and repeat them all.
    return V.with_date(counted).select(
        "value", F.col("date.day_first").cast("string").alias("day_first"),
        F.col("date.month_first").cast("string").alias("month_first"), "n")


_NUMBER_CELLS = """SELECT l_returnflag, translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS cell FROM lineitem
  UNION ALL SELECT l_returnflag, lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 4, '0') FROM lineitem
  UNION ALL SELECT l_returnflag, CAST(CAST(l_extendedprice AS DECIMAL(18,3)) AS VARCHAR) FROM lineitem"""


@query("number_readings", f"""WITH cells AS ({_NUMBER_CELLS}),{readings_sql('cells', 'l_returnflag')}
  SELECT l_returnflag, kind, count(*) AS n, CAST(sum(us) AS DOUBLE) AS us_sum, CAST(sum(br) AS DOUBLE) AS br_sum,
    count(DISTINCT us) AS us_numbers, count(DISTINCT br) AS br_numbers, CAST(max({_digits('coalesce(us_text, br_text)')}) AS INTEGER) AS digits,
    CAST(max({_scale('coalesce(us_text, br_text)')}) AS INTEGER) AS scale FROM readings GROUP BY ALL""")
def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spread(table(spark, sf_dir, "lineitem"))
    texts = items.selectExpr("l_returnflag", "translate(format_number(l_extendedprice, 2), ',.', '.,') AS a",
                             "lpad(CAST(CAST(l_quantity AS INT) AS STRING), 4, '0') AS b",
                             "CAST(CAST(l_extendedprice AS DECIMAL(18,3)) AS STRING) AS c")
    rows = texts.unpivot(["l_returnflag"], ["a", "b", "c"], "source", "cell")
    found = P.classified(P.dictionary(rows, ["l_returnflag"]))
    text = F.coalesce("us_text", "br_text")
    keyed = found.withColumn("us_key", V.number_key(F.col("us_text"))).withColumn("br_key", V.number_key(F.col("br_text")))
    return keyed.groupBy("l_returnflag", "kind").agg(
        F.sum("n").alias("n"), F.sum(F.col("us") * F.col("n")).cast("double").alias("us_sum"),
        F.sum(F.col("br") * F.col("n")).cast("double").alias("br_sum"),
        F.countDistinct("us_key").alias("us_numbers"), F.countDistinct("br_key").alias("br_numbers"),
        F.max(V.integer_digits(text)).alias("digits"), F.max(V.fraction_digits(text)).alias("scale"))


# ---- names --------------------------------------------------------------------------------------------------------

_SNAKE_SQL = """(SELECT left(CASE WHEN regexp_matches(s, '^[0-9]') THEN 'c_' || s ELSE s END, 128) FROM (SELECT CASE WHEN t = '' THEN 'coluna' ELSE t END AS s
  FROM (SELECT lower(trim(regexp_replace(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g'), '[^0-9a-zA-Z]+', '_', 'g'), '_')) AS t)))"""


@query("safe_names", "SELECT name, " + _SNAKE_SQL.format("name") + " AS safe, count(*) AS n FROM "
       "(SELECT text AS name FROM documents UNION ALL SELECT p_name FROM part UNION ALL SELECT c_acctbal || ' ' || c_mktsegment || '!' FROM customer UNION ALL SELECT '***' FROM supplier) GROUP BY name")
def _safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (table(spark, sf_dir, "documents").select(F.col("text").alias("name"))
             .union(table(spark, sf_dir, "part").select("p_name"))
             .union(table(spark, sf_dir, "customer").selectExpr("concat(c_acctbal, ' ', c_mktsegment, '!')"))
             .union(table(spark, sf_dir, "supplier").select(F.lit("***"))))
    return names.groupBy("name").agg(F.count("*").alias("n")).select("name", N.snake_case(F.col("name")).alias("safe"), "n")


@query("name_keys", r"SELECT regexp_replace(lower(name), '[^\p{L}\p{N}]', '', 'g') AS name_key, count(*) AS n, count(DISTINCT name) AS spellings FROM "
       "(SELECT p_type || ' ' || p_brand AS name FROM part UNION ALL SELECT url FROM pages UNION ALL SELECT text FROM conversations) GROUP BY 1")
def _name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name"))
             .union(table(spark, sf_dir, "pages").select("url")).union(table(spark, sf_dir, "conversations").select("text")))
    return names.groupBy(N.name_key(F.col("name")).alias("name_key")).agg(
        F.count("*").alias("n"), F.countDistinct("name").alias("spellings"))


@query("table_names_from_files", r"""SELECT url, left(CASE WHEN regexp_matches(s, '^[a-z_]') THEN s ELSE 't_' || s END, 100) AS table_name FROM
  (SELECT url, CASE WHEN t = '' THEN 'dataset' ELSE t END AS s FROM (SELECT url, lower(trim(regexp_replace(regexp_replace(string_split(url, '/')[-1] || '.csv', '[.][^.]*$', ''), '[^A-Za-z0-9_]+', '_', 'g'), '_')) AS t FROM pages))""")
def _table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    file_name = F.concat(F.substring_index("url", "/", -1), F.lit(".csv"))
    return table(spark, sf_dir, "pages").select("url", N.table_name(file_name).alias("table_name"))


@query("privacy_hints", """SELECT hint, count(*) AS n FROM (SELECT CASE
  WHEN regexp_matches(name, '(^|_|\\b)(nome|name|sobrenome|surname)(_|\\b|$)', 'i') THEN 'nome de pessoa'
  WHEN regexp_matches(name, 'e-?mail', 'i') THEN 'e-mail'
  WHEN regexp_matches(name, '(^|_|\\b)(cpf|cnpj|rg|passaporte|passport)(_|\\b|$)', 'i') THEN 'documento (CPF, CNPJ, RG)'
  WHEN regexp_matches(name, 'telefone|phone|celular|fone|whatsapp', 'i') THEN 'telefone'
  WHEN regexp_matches(name, 'endere[cç]o|address|(^|_|\\b)(cep|zip|postal)(_|\\b|$)', 'i') THEN 'endereço ou CEP'
  WHEN regexp_matches(name, 'nascimento|birth|(^|_|\\b)dob(_|\\b|$)', 'i') THEN 'data de nascimento'
  WHEN regexp_matches(name, 'senha|password|token|secret', 'i') THEN 'credencial'
  WHEN regexp_matches(name, 'sal[aá]rio|salary|remunera', 'i') THEN 'remuneração' END AS hint
  FROM (SELECT lower(p_brand) || '_' || p_name AS name FROM part UNION ALL SELECT lower(c_mktsegment) || '_name' FROM customer
    UNION ALL SELECT 'supplier' || s_suppkey || '_phone' FROM supplier UNION ALL SELECT html FROM pages)) GROUP BY hint""")
def _privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (table(spark, sf_dir, "part").select(F.concat(F.lower("p_brand"), F.lit("_"), "p_name").alias("name"))
             .union(table(spark, sf_dir, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit("_name"))))
             .union(table(spark, sf_dir, "supplier").selectExpr("concat('supplier', s_suppkey, '_phone')"))
             .union(spread(table(spark, sf_dir, "pages")).select("html")))
    return names.groupBy(N.privacy_hint(F.col("name")).alias("hint")).agg(F.count("*").alias("n"))


@query("spreadsheet_safe_cells", """SELECT id, md5(CASE WHEN left(cell, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || cell ELSE cell END) AS safe_md5 FROM
  (SELECT 'd' || doc_id AS id, text AS cell FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, '=' || text FROM conversations
   UNION ALL SELECT 's' || s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) FROM supplier)""")
def _csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (table(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) AS id", "text AS cell")
            .union(table(spark, sf_dir, "conversations").selectExpr("concat('c', conv_id, '-', turn)", "concat('=', text)"))
            .union(table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey)", "CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS STRING)")))
    return rows.select("id", F.md5(N.csv_safe(F.col("cell"))).alias("safe_md5"))


_NAME_ROWS_SQL = "SELECT p_brand AS dataset, p_partkey AS position, CASE WHEN p_size < 10 THEN p_name ELSE replace(p_name, ' ', '') END AS name FROM part"


def _name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS dataset", "p_partkey AS position", "CASE WHEN p_size < 10 THEN p_name ELSE replace(p_name, ' ', '') END AS name")


@query("unsafe_column_names", f"SELECT dataset, count(*) AS n, string_agg(name, '|' ORDER BY position) AS names FROM ({_NAME_ROWS_SQL}) WHERE regexp_matches(name, '[ ,;{{}}()\\n\\t=]') GROUP BY dataset")
def _unsafe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _name_rows(spark, sf_dir).filter(N.is_unsafe_name(F.col("name")))
    return bad.groupBy("dataset").agg(F.count("*").alias("n"), F.concat_ws("|", G.in_order("position", F.col("name"))).alias("names"))


@query("clashing_column_names", f"SELECT dataset, min(position) AS p, string_agg(name, ', ' ORDER BY position) AS item FROM ({_NAME_ROWS_SQL}) GROUP BY dataset, lower(trim(name)) HAVING count(*) > 1")
def _clashing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clashing_names(_name_rows(spark, sf_dir))


# ---- types --------------------------------------------------------------------------------------------------------


@query("target_column_types", f"""SELECT dataset, name, CASE WHEN type IN ('integer', 'decimal') THEN
    'DECIMAL(' || least(38, greatest(1, max_int_digits + max_scale + 4)) || ',' || max_scale || ')' ELSE 'DECIMAL(38,10)' END AS decimal_type,
  'VARCHAR(' || (SELECT coalesce(min(b), 8000) FROM (VALUES (16), (32), (64), (128), (256), (512), (1024), (4000), (8000)) v(b) WHERE b >= greatest(max_len, 1) * 2) || ')' AS varchar_type
  FROM ({ALL_COLUMNS_SQL})""")
def _target_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_columns(spark, sf_dir).select(
        "dataset", "name", Y.decimal_type(F.col("max_int_digits"), F.col("max_scale")).alias("decimal_type"),
        Y.varchar_type(F.col("max_len")).alias("varchar_type"))


CONFLICT_SQL = """CASE WHEN s IN ('int', 'bigint', 'double', 'decimal') AND type NOT IN ('integer', 'decimal') THEN 'a coluna é ' || type || ', não numérica'
  WHEN s IN ('int', 'bigint') AND type = 'decimal' THEN 'há casas decimais que seriam perdidas'
  WHEN s = 'int' AND greatest(abs(CAST(min AS DOUBLE)), abs(CAST(max AS DOUBLE))) > 2147483647 THEN 'valores até ' || max || ' não cabem em int (use bigint)'
  WHEN s = 'boolean' AND type <> 'boolean' THEN 'a coluna é ' || type || ', não booleana'
  WHEN s IN ('date', 'timestamp') AND type <> 'date' THEN 'a coluna é ' || type || ', não tem um formato de data reconhecido'
  WHEN s = 'date' AND has_time THEN 'os valores têm hora, que se perderia em date (use timestamp)' END"""
INFERRED_SQL = """CASE WHEN type = 'integer' THEN CASE WHEN greatest(abs(CAST(min AS DOUBLE)), abs(CAST(max AS DOUBLE))) > 2147483647 THEN 'bigint' ELSE 'int' END
  WHEN type = 'date' THEN CASE WHEN has_time THEN 'timestamp' ELSE 'date' END WHEN type IN ('decimal', 'boolean') THEN type ELSE 'string' END"""
SAFE_SQL = f"""CASE WHEN s IN ('int', 'bigint') AND type = 'integer' THEN 'bigint' WHEN s IN ('int', 'bigint', 'double') AND type = 'decimal' THEN 'decimal'
  WHEN s IN ('date', 'timestamp') AND type = 'date' THEN CASE WHEN has_time THEN 'timestamp' ELSE 'date' END
  WHEN s IN ('int', 'bigint', 'double', 'decimal', 'boolean', 'date', 'timestamp') THEN 'string' ELSE {INFERRED_SQL} END"""


@query("type_conflicts", f"""SELECT dataset, name, s AS suggested, {CONFLICT_SQL} AS conflict, {INFERRED_SQL} AS inferred, {SAFE_SQL} AS safe
  FROM (SELECT * REPLACE (CASE WHEN type IN ('integer', 'decimal') THEN min END AS min, CASE WHEN type IN ('integer', 'decimal') THEN max END AS max) FROM ({ALL_COLUMNS_SQL})),
  (VALUES ('string'), ('int'), ('bigint'), ('double'), ('decimal'), ('boolean'), ('date'), ('timestamp')) v(s)""")
def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = all_columns(spark, sf_dir).withColumn("suggested", F.explode(F.array(*[F.lit(t) for t in Y.TARGET_TYPES])))
    measured = [F.col(c) for c in ("min", "max", "has_time")]
    kind, suggested = F.col("type"), F.col("suggested")
    return each.select(
        "dataset", "name", "suggested", Y.type_conflict(kind, suggested, *measured).alias("conflict"),
        Y.inferred_type(kind, *measured).alias("inferred"), Y.safe_type(kind, suggested, *measured).alias("safe"))
