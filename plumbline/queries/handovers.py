"""Mappings, typed loads and reconciliation over the given tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import load as L
from plumbline.operators import mapping as M
from plumbline.operators import profile as P
from plumbline.operators import reconcile as R
from plumbline.queries.profiles import (
    ALL_COLUMNS_SQL, CONFLICT_SQL, INFERRED_SQL, PRECISE_SQL, SAFE_SQL, TEXT_TABLES, all_columns, precise_numbers, text_table, text_table_sql,
)
from plumbline.queries.registry import query, spread, table
from plumbline.session import fresh_path

# ---- many small datasets: each customer is a dataset, each of its orders a column ---------------------------------

PROFILE_ROWS = {
    "dataset": "o_custkey", "position": "o_orderkey",
    "name": "concat('col ', CAST(o_orderkey AS STRING))",
    "type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'integer' WHEN '2-HIGH' THEN 'decimal' WHEN '3-MEDIUM' THEN 'date' WHEN '5-LOW' THEN 'text' ELSE 'boolean' END",
    "min": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '-12' END",
    "max": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(CAST(floor(o_totalprice) AS BIGINT) * 10000 AS STRING) END",
    "has_time": "o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F'",
}
MAPPING_ROWS = {
    "dataset": "o_custkey",
    "source": "CASE WHEN o_totalprice < 20000 THEN concat('ghost ', CAST(o_orderkey AS STRING)) ELSE concat('col ', CAST(o_orderkey AS STRING)) END",
    "target": "CASE WHEN o_totalprice > 480000 THEN NULL WHEN o_orderstatus = 'P' THEN concat('Field ', o_orderpriority) ELSE concat('field_', lower(o_orderstatus)) END",
    "type": "CASE WHEN o_totalprice > 450000 THEN 'money' WHEN o_orderstatus = 'O' THEN 'int' WHEN o_orderstatus = 'F' THEN 'date' ELSE 'double' END",
    "legacy": "false",
}


def _rows(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def _rows_sql(columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f'{sql.replace("STRING", "VARCHAR")} AS "{n}"' for n, sql in columns.items()) + " FROM orders"


PROFILE_SQL, MAPPING_SQL = _rows_sql(PROFILE_ROWS), _rows_sql(MAPPING_ROWS)


def profile_and_mapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _rows(spark, sf_dir, PROFILE_ROWS), _rows(spark, sf_dir, MAPPING_ROWS)


_JOINED_SQL = f"""SELECT coalesce(p.dataset, m.dataset) AS dataset, p.position, p.name, p.type, p.min, p.max, p.has_time, m.source, m.target, m.type AS s
  FROM ({PROFILE_SQL}) p FULL JOIN ({MAPPING_SQL}) m ON p.dataset = m.dataset AND p.name = m.source"""

_OFFENDERS_SQL = f"""WITH j AS ({_JOINED_SQL}) SELECT dataset, 'covers_all_columns' AS "check", position, name AS offender FROM j WHERE name IS NOT NULL AND target IS NULL
  UNION ALL SELECT dataset, 'no_unknown_columns', position, source FROM j WHERE name IS NULL
  UNION ALL SELECT dataset, 'delta_safe_names', position, name || ' → ' || target FROM j WHERE name IS NOT NULL AND target IS NOT NULL AND NOT regexp_full_match(target, '[a-z_][a-z0-9_]*')
  UNION ALL SELECT dataset, 'unique_targets', min(position), string_agg(name, ', ' ORDER BY position) || ' → ' || target FROM j WHERE name IS NOT NULL AND target IS NOT NULL GROUP BY dataset, target HAVING count(*) > 1
  UNION ALL SELECT dataset, 'valid_types', position, name || ': ''' || s || '''' FROM j WHERE name IS NOT NULL AND source IS NOT NULL AND s NOT IN ('string', 'int', 'bigint', 'double', 'decimal', 'boolean', 'date', 'timestamp')
  UNION ALL SELECT dataset, 'type_fits_data', position, name || ': ' || s || ', ' || c FROM (SELECT *, {CONFLICT_SQL} AS c FROM j) WHERE name IS NOT NULL AND source IS NOT NULL AND c IS NOT NULL"""


@query("mapping_checks", f"""WITH o AS ({_OFFENDERS_SQL}), skeleton AS (SELECT dataset, n.i AS ordinal, n.name FROM (SELECT DISTINCT dataset FROM ({PROFILE_SQL})),
  (VALUES (0, 'covers_all_columns'), (1, 'no_unknown_columns'), (2, 'delta_safe_names'), (3, 'unique_targets'), (4, 'valid_types'), (5, 'type_fits_data')) n(i, name))
  SELECT s.dataset, CAST(s.ordinal AS INTEGER) AS ordinal, s.name, CASE WHEN count(o.offender) > 0 THEN 'failed' ELSE 'passed' END AS status,
    CAST(count(o.offender) AS INTEGER) AS n_offenders
  FROM skeleton s LEFT JOIN o ON o.dataset = s.dataset AND o."check" = s.name GROUP BY ALL""")
def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.check_mapping(*profile_and_mapping(spark, sf_dir), with_offenders=False).drop("details")


OWN = M.OwnChecks()


@OWN.register("short_targets")
def _short_targets(rows: DataFrame) -> DataFrame:
    return rows.filter(F.length("target") > 7).select("dataset", "position", F.col("target").alias("offender"))


@OWN.register("positions_are_counted")
def _positions(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("position") < 0).select("dataset", "position", F.col("name").alias("offender"))


@query("own_mapping_checks", f"""WITH d AS (SELECT DISTINCT dataset FROM ({PROFILE_SQL})), long AS (SELECT dataset, count(*) AS n FROM ({MAPPING_SQL}) WHERE length(target) > 7 GROUP BY dataset)
  SELECT d.dataset, 6 AS ordinal, 'short_targets' AS name, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status, CAST(coalesce(n, 0) AS INTEGER) AS n_offenders FROM d LEFT JOIN long ON long.dataset = d.dataset
  UNION ALL SELECT dataset, 7, 'positions_are_counted', 'passed', 0 FROM d""")
def _own_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checks of the user's own beside the six; one of them fails."""
    found = M.check_mapping(*profile_and_mapping(spark, sf_dir), with_offenders=False, own=OWN)
    return found.filter("ordinal >= 6").drop("details")


@query("mapping_offenders", _OFFENDERS_SQL)
def _offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mapping_offenders(*profile_and_mapping(spark, sf_dir))


@query("mapping_pass_rates", f"""WITH f AS (SELECT DISTINCT dataset, "check" FROM ({_OFFENDERS_SQL})) SELECT d.dataset, CAST(6 AS BIGINT) AS checks,
  6 - count(f."check") AS passed, (6 - count(f."check")) / 6 AS pass_rate FROM (SELECT DISTINCT dataset FROM ({PROFILE_SQL})) d LEFT JOIN f ON f.dataset = d.dataset GROUP BY d.dataset""")
def _pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile, mapping = profile_and_mapping(spark, sf_dir)
    return M.pass_rates(profile, M.check_mapping(profile, mapping, False), ["dataset"])


@query("unknown_mapped_columns", f"SELECT m.dataset, m.source FROM ({MAPPING_SQL}) m WHERE NOT EXISTS (SELECT 1 FROM ({PROFILE_SQL}) p WHERE p.dataset = m.dataset AND p.name = m.source)")
def _unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unknown_columns(*profile_and_mapping(spark, sf_dir))


@query("uncovered_columns", f"SELECT p.dataset, p.name FROM ({PROFILE_SQL}) p WHERE NOT EXISTS (SELECT 1 FROM ({MAPPING_SQL}) m WHERE p.dataset = m.dataset AND p.name = m.source AND m.target IS NOT NULL)")
def _uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.uncovered_columns(*profile_and_mapping(spark, sf_dir))


_SNAKE = "CASE WHEN regexp_matches({0}, '^[0-9]') THEN 'c_' ELSE '' END || lower(trim(regexp_replace({0}, '[^0-9a-zA-Z]+', '_', 'g'), '_'))"
_BASE_SQL = f"""SELECT *, CASE WHEN target IS NULL THEN {_SNAKE.format('name')} WHEN NOT regexp_full_match(target, '[a-z_][a-z0-9_]*') THEN {_SNAKE.format('target')} ELSE target END AS base
  FROM ({_JOINED_SQL}) WHERE name IS NOT NULL"""
_UNIQUE_SQL = f"""SELECT *, base || CASE WHEN turn > 1 THEN '_' || turn ELSE '' END AS uniq FROM (SELECT *, row_number() OVER (PARTITION BY dataset, base ORDER BY position) AS turn FROM ({_BASE_SQL}))"""


@query("unique_target_names", f"SELECT dataset, position, uniq AS \"unique\" FROM ({_UNIQUE_SQL})")
def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    corrected, _ = M.correct_mapping(*profile_and_mapping(spark, sf_dir))
    return corrected.select("dataset", "position", F.col("target").alias("unique"))


_TYPED_SQL = f"""SELECT *, {CONFLICT_SQL.replace(' s ', ' first_type ').replace('WHEN s ', 'WHEN first_type ')} AS conflict FROM
  (SELECT *, CASE WHEN s IN ('string', 'int', 'bigint', 'double', 'decimal', 'boolean', 'date', 'timestamp') THEN s ELSE {INFERRED_SQL} END AS first_type FROM ({_UNIQUE_SQL}))"""
_FINAL_SQL = f"SELECT *, CASE WHEN conflict IS NULL THEN first_type ELSE {SAFE_SQL.replace('WHEN s ', 'WHEN first_type ')} END AS final_type FROM ({_TYPED_SQL})"


@query("corrected_mapping", f"SELECT dataset, position, name AS source, uniq AS target, final_type AS type FROM ({_FINAL_SQL})")
def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    corrected, _ = M.correct_mapping(*profile_and_mapping(spark, sf_dir))
    return corrected.drop("legacy")


@query("mapping_changes", f"""WITH f AS ({_FINAL_SQL})
  SELECT dataset, position, name AS "column", CAST(1 AS INTEGER) AS seq, 'destino' AS field, target AS "from", uniq AS "to", 'A coluna não tinha destino no mapeamento.' AS reason FROM f WHERE target IS NULL
  UNION ALL SELECT dataset, position, name, 1, 'destino', target, uniq, 'Nome fora de [a-z_][a-z0-9_]*.' FROM f WHERE NOT regexp_full_match(target, '[a-z_][a-z0-9_]*')
  UNION ALL SELECT dataset, position, name, 1, 'destino', target, uniq, 'Destino repetido.' FROM f WHERE regexp_full_match(target, '[a-z_][a-z0-9_]*') AND uniq <> target
  UNION ALL SELECT dataset, position, name, 2, 'tipo', s, first_type, 'Tipo ausente ou não suportado; inferido do perfil.' FROM f WHERE s IS NULL OR s = 'money'
  UNION ALL SELECT dataset, position, name, 3, 'tipo', first_type, final_type, upper(left(conflict, 1)) || substr(conflict, 2) || '.' FROM f WHERE conflict IS NOT NULL
  UNION ALL SELECT m.dataset, -1, m.source, 0, 'coluna', 'mapeada', NULL, 'A coluna não existe no arquivo.' FROM ({MAPPING_SQL}) m WHERE NOT EXISTS (SELECT 1 FROM ({PROFILE_SQL}) p WHERE p.dataset = m.dataset AND p.name = m.source)""")
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.correct_mapping(*profile_and_mapping(spark, sf_dir))[1]


@query("corrected_mapping_checks", f"SELECT dataset, CAST(6 AS BIGINT) AS checks, CAST(6 AS BIGINT) AS passed, CAST(1 AS DOUBLE) AS pass_rate FROM ({PROFILE_SQL}) GROUP BY dataset")
def _corrected_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile, mapping = profile_and_mapping(spark, sf_dir)
    corrected, _ = M.correct_mapping(profile, mapping)
    return M.pass_rates(profile, M.check_mapping(profile, corrected, False), ["dataset"])


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as answers: prose alone, a fenced mapping, or one between words."""
    body = ('{"col ', F.col("turn").cast("string"), '": {"target": "t', F.col("conv_id").cast("string"),
            '", "type": "int"}, "plain": "name_only"}')
    mapping = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in body])
    fenced = F.concat("text", F.lit("\n```json\n"), mapping, F.lit("\n```\n"), "text")
    inline = F.concat(F.lit("Mapping: "), mapping, F.lit(" done"))
    content = F.when(F.col("role") == "user", F.col("text")).when(F.col("turn") % 2 == 1, fenced).otherwise(inline)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", content.alias("content"))


@query("suggested_mappings", """SELECT conv_id, turn, 'col ' || turn AS source, 't' || conv_id AS target, 'int' AS type, false AS legacy FROM conversations WHERE role <> 'user'
  UNION ALL SELECT conv_id, turn, 'plain', 'name_only', NULL, true FROM conversations WHERE role <> 'user'""")
def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mapping_rows(M.parsed_answers(answers(spark, sf_dir)), ["conv_id", "turn"])


@query("unreadable_answers", "SELECT conv_id, turn, 'unparseable model output' AS error FROM conversations WHERE role = 'user'")
def _unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.parsed_answers(answers(spark, sf_dir)).filter("error is not null").select("conv_id", "turn", "error")


@query("mapping_digests", f"""SELECT dataset, sha256('[' || string_agg('{{"source":"' || source || '",' || CASE WHEN target IS NULL THEN '' ELSE '"target":"' || target || '",' END || '"type":"' || type || '"}}', ',' ORDER BY source) || ']') AS sha256
  FROM ({MAPPING_SQL}) GROUP BY dataset""")
def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.sources.catalogs import mapping_digest

    return mapping_digest(_rows(spark, sf_dir, MAPPING_ROWS), ["dataset"])


@query("exported_mapping", """SELECT '''=' || o_orderkey AS source_column, CASE WHEN o_totalprice < 50000 THEN '''-' || o_orderstatus ELSE lower(o_orderstatus) END AS target_column,
  CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'int' END AS type, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending' END AS decision FROM orders""")
def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping written as delimited files and read back."""
    from plumbline.sources.delimited import write_mapping

    rows = table(spark, sf_dir, "orders").selectExpr(
        "concat('=', o_orderkey) AS source", "CASE WHEN o_totalprice < 50000 THEN concat('-', o_orderstatus) ELSE lower(o_orderstatus) END AS target",
        "'int' AS type", "o_orderpriority = '5-LOW' AS legacy", "o_orderstatus")
    path = fresh_path(spark, "mapping-export")
    write_mapping(rows, F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending"), path)
    return spark.read.option("header", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").csv(path)


# ---- loads --------------------------------------------------------------------------------------------------------

# The approved mapping of each text table: source, target, type.
APPROVED = {
    "orders": {"o_orderkey": ("order_id", "bigint"), "o_custkey": ("customer_id", "int"), "o_orderstatus": ("status", "string"),
               "o_totalprice": ("total", "decimal"), "o_orderdate": ("placed_on", "date"), "o_orderpriority": ("priority", "string")},
    "lineitem": {"l_orderkey": ("order_id", "bigint"), "l_partkey": ("part_id", "int"), "l_suppkey": ("supplier_id", "int"),
                 "l_linenumber": ("line_no", "int"), "l_quantity": ("quantity", "double"), "l_extendedprice": ("price", "decimal"),
                 "l_discount": ("discount", "decimal"), "l_tax": ("tax", "double"), "l_returnflag": ("return_flag", "string"),
                 "l_linestatus": ("status", "string"), "l_shipdate": ("shipped_on", "date"), "l_shipday": ("shipped_at", "timestamp")},
    "customer": {"c_custkey": ("id", "int"), "c_name": ("name", "string"), "c_nationkey": ("nation", "int"), "c_acctbal": ("balance", "decimal"),
                 "c_positive": ("positive", "boolean"), "c_mktsegment": ("segment", "string")},
}


def approved(spark: SparkSession, name: str, changes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    rows = [(name, source, target, kind, False) for source, (target, kind) in {**APPROVED[name], **(changes or {})}.items()]
    return spark.createDataFrame(rows, "dataset string, source string, target string, type string, legacy boolean")


def planned(spark: SparkSession, sf_dir: str, name: str, changes: dict | None = None) -> tuple[DataFrame, list[L.ColumnPlan]]:
    raw = text_table(spark, sf_dir, name)
    return raw, L.plan_columns(P.profile(raw, name), approved(spark, name, changes))


@query("typed_load_customer", """SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS name, c_nationkey AS nation, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance,
  c_acctbal >= 0 AS positive, nullif(CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END, '') AS segment FROM customer""")
def _typed_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, plans = planned(spark, sf_dir, "customer")
    return L.typed_projection(raw, plans).withColumn("balance", F.col("balance").cast("double"))


@query("typed_load_lineitem", """SELECT l_orderkey AS order_id, CAST(l_partkey AS INTEGER) AS part_id, CAST(l_suppkey AS INTEGER) AS supplier_id, CAST(l_linenumber AS INTEGER) AS line_no, l_quantity AS quantity,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(CAST(l_discount AS DECIMAL(18,2)) AS DOUBLE) AS discount, CAST(CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE) AS tax, l_returnflag AS return_flag,
  CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_linestatus END AS status, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped_on, strftime(l_shipdate, '%Y-%m-%d %H:%M:00') AS shipped_at FROM lineitem""")
def _typed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, plans = planned(spark, sf_dir, "lineitem")
    rows = L.typed_projection(raw, plans)
    return rows.withColumns({
        "price": F.col("price").cast("double"), "discount": F.col("discount").cast("double"), "shipped_on": F.col("shipped_on").cast("string"),
        "shipped_at": F.date_format("shipped_at", "yyyy-MM-dd HH:mm:ss")})


@query("lost_values", """SELECT * FROM (SELECT 'order_id' AS target, CAST(0 AS BIGINT) AS lost UNION ALL SELECT 'customer_id', 0
  UNION ALL SELECT 'status', count(o_orderstatus) FROM orders UNION ALL SELECT 'total', count(*) FILTER (CAST(o_totalprice AS DECIMAL(18,2)) % 1 <> 0) FROM orders
  UNION ALL SELECT 'placed_on', 0 UNION ALL SELECT 'priority', count(o_orderpriority) FROM orders)""")
def _lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Casting a text such as 12.34 to an integer type loses it; so does a flag read as a date.
    raw, plans = planned(spark, sf_dir, "orders", {"o_orderstatus": ("status", "timestamp"), "o_orderpriority": ("priority", "double")})
    whole = [L.ColumnPlan(p.source, p.target, p.kind, "DECIMAL(18,2)", p.measured) if p.target == "total" else p for p in plans]
    lost = L.lost_values(raw.withColumn("o_totalprice", F.when(F.col("o_totalprice").rlike(r"\.00$"), F.col("o_totalprice"))
                                        .otherwise(F.concat(F.lit("~"), "o_totalprice"))), whole)
    return lost


@query("rounded_values", "SELECT 'balance' AS target, count(*) AS rounded FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) IS NOT NULL")
def _rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, plans = planned(spark, sf_dir, "customer")
    return L.rounded_values(raw.withColumn("c_acctbal", F.concat("c_acctbal", F.lit("7"))), plans)


@query("source_formats", f"""SELECT dataset, string_agg(name || '=' || format, ', ' ORDER BY name) AS formats FROM
  (SELECT dataset, name, CASE WHEN type = 'date' THEN date_format WHEN number_style = 'br' THEN 'br' END AS format FROM ({ALL_COLUMNS_SQL})) WHERE format IS NOT NULL GROUP BY dataset""")
def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = all_columns(spark, sf_dir)
    mapping = columns.select("dataset", F.col("name").alias("source"), F.lit(None).cast("string").alias("target"),
                             F.when(F.col("type") == "date", "date").otherwise("decimal").alias("type"))
    found = L.source_formats(columns, mapping)
    text = F.transform(F.map_entries("formats"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("dataset", F.concat_ws(", ", text).alias("formats"))


# ---- reconciliation -----------------------------------------------------------------------------------------------


def _loaded(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, list[L.ColumnPlan], int]:
    """The text table landed once, loaded through every guard and read back, with its plan and measured row count."""
    landed = fresh_path(spark, f"{name}-landed")
    text_table(spark, sf_dir, name).write.parquet(landed)
    raw = spark.read.parquet(landed)
    plans = L.plan_columns(P.profile(raw, name), approved(spark, name))
    rows = plans[0].measured["rows"]
    path = fresh_path(spark, name)
    L.load_table(raw, plans, path, rows)
    return spark.read.parquet(path), plans, rows


@cache
def _reconcile_sql(name: str) -> str:
    """The same checks counted by plain SQL on the source table."""
    checks = [("'linhas'", "CAST(count(*) AS VARCHAR)")]
    for source, (target, kind) in APPROVED[name].items():
        text = f"nullif(trim({source}), '')"
        date = "coalesce(" + ", ".join(f"try_strptime({text}, '{p}')" for p in ("%Y-%m-%d", "%d/%m/%Y", "%m.%d.%Y %H:%M")) + ")"
        number = f"CAST(CASE WHEN contains({text}, ',') THEN replace(replace({text}, '.', ''), ',', '.') ELSE {text} END AS DECIMAL(38,10))"
        value = {"string": text, "boolean": text, "date": f"CAST({date} AS DATE)", "timestamp": date}.get(kind, number)
        checks.append((f"'nulos({target})'", f"CAST(count(*) - count({text}) AS VARCHAR)"))
        checks.append((f"'distintos({target})'", f"CAST(count(DISTINCT {value}) AS VARCHAR)"))
        if kind == "string":
            checks.append((f"'tamanho_max({target})'", f"CAST(max(length({text})) AS VARCHAR)"))
        elif kind == "date":
            checks += [(f"'{f}({target})'", f"CAST({f}({value}) AS VARCHAR)") for f in ("min", "max")]
        elif kind not in ("boolean", "timestamp"):
            checks += [(f"'{f}({target})'", f"rtrim(rtrim(CAST({f}({value}) AS VARCHAR), '0'), '.')") for f in ("min", "max")]
    rows = " UNION ALL ".join(f"SELECT {name_} AS verificacao, {value} AS v FROM src" for name_, value in checks)
    return f"WITH src AS ({text_table_sql(name)}) SELECT verificacao, v AS esperado, v AS obtido, 'OK' AS status FROM ({rows})"


for _table in APPROVED:
    def _register(name: str) -> None:
        @query(f"reconciliation_{name}", _reconcile_sql(name))
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return R.reconcile(*_loaded(spark, sf_dir, name)).drop("ordinal")

    _register(_table)


@query("tampered_load_diverges", """SELECT 'linhas' AS verificacao, CAST(count(*) AS VARCHAR) AS esperado, CAST(count(*) FILTER (o_orderkey <> m) AS VARCHAR) AS obtido FROM orders, (SELECT max(o_orderkey) AS m FROM orders)
  UNION ALL SELECT 'distintos(order_id)', CAST(count(*) AS VARCHAR), CAST(count(*) - 1 AS VARCHAR) FROM orders
  UNION ALL SELECT 'max(order_id)', CAST(max(o_orderkey) AS VARCHAR), CAST(max(o_orderkey) - 1 AS VARCHAR) FROM orders
  UNION ALL SELECT 'max(total)', rtrim(rtrim(CAST(CAST(max(o_totalprice) AS DECIMAL(18,2)) AS VARCHAR), '0'), '.'), '999999999' FROM orders
  UNION ALL SELECT 'min(total)', rtrim(rtrim(CAST(CAST(min(o_totalprice) AS DECIMAL(18,2)) AS VARCHAR), '0'), '.'), '999999999' FROM orders
  UNION ALL SELECT 'distintos(total)', CAST(count(DISTINCT CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR), '1' FROM orders""")
def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, plans = planned(spark, sf_dir, "orders")
    rows = raw.count()
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("m"))
    loaded = L.typed_projection(raw, plans)
    # One row; broadcast.
    damaged = loaded.join(F.broadcast(last), F.col("order_id") != F.col("m")).drop("m").withColumn("total", F.lit(999999999).cast("decimal(18,2)"))
    found = R.reconcile(damaged, plans, rows)
    listed = ["linhas", "distintos(order_id)", "max(order_id)", "max(total)", "min(total)", "distintos(total)"]
    return found.filter((F.col("status") == "DIVERGE") & F.col("verificacao").isin(*listed)).select("verificacao", "esperado", "obtido")


_FINE = "CAST(fine AS DECIMAL(38,21))"
_SHOWN = "rtrim(rtrim(CAST({0} AS VARCHAR), '0'), '.')"


@query("tampered_precise_load", f"""WITH src AS ({PRECISE_SQL}), ranges AS (
  SELECT min({_FINE}) AS low, max({_FINE}) AS high, min((l_suppkey % 3, l_linenumber)) AS first, max((l_suppkey % 3, l_linenumber)) AS last, CAST(count(*) AS VARCHAR) AS n, CAST(count(DISTINCT {_FINE}) AS VARCHAR) AS n_fine,
    CAST(count(DISTINCT wide) AS VARCHAR) AS n_wide, CAST(count(DISTINCT (l_suppkey % 3, l_linenumber)) AS VARCHAR) AS n_power, CAST(max(length(wide)) AS VARCHAR) AS longest FROM src),
shown AS (SELECT *, CAST(first[2] AS VARCHAR) || repeat('0', CAST(30 + first[1] AS INTEGER)) AS low_power, CAST(last[2] AS VARCHAR) || repeat('0', CAST(30 + last[1] AS INTEGER)) AS high_power FROM ranges)
SELECT 'linhas' AS verificacao, n AS esperado, n AS obtido, 'OK' AS status FROM shown
{' '.join(f"UNION ALL SELECT 'nulos({c})', '0', '0', 'OK' FROM shown" for c in ("fine", "wide", "power"))}
{' '.join(f"UNION ALL SELECT 'distintos({c})', n_{c}, n_{c}, 'OK' FROM shown" for c in ("fine", "wide", "power"))}
UNION ALL SELECT 'min(fine)', {_SHOWN.format('low')}, {_SHOWN.format("low + CAST('0.000000000000001' AS DECIMAL(38,21))")}, 'DIVERGE' FROM shown
UNION ALL SELECT 'max(fine)', {_SHOWN.format('high')}, {_SHOWN.format("high + CAST('0.000000000000001' AS DECIMAL(38,21))")}, 'DIVERGE' FROM shown
UNION ALL SELECT 'tamanho_max(wide)', longest, longest, 'OK' FROM shown
UNION ALL SELECT 'min(power)', low_power, low_power, 'OK' FROM shown UNION ALL SELECT 'max(power)', high_power, high_power, 'OK' FROM shown""")
def _tampered_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number moved in its fifteenth decimal: only the ranges of that column diverge."""
    raw = precise_numbers(spark, sf_dir)
    mapping = spark.createDataFrame([("precise", "fine", "fine", "decimal", False), ("precise", "wide", "wide", "string", False), ("precise", "power", "power", "double", False)],
                                    "dataset string, source string, target string, type string, legacy boolean")
    plans = L.plan_columns(P.profile(raw, "precise"), mapping)
    loaded = L.typed_projection(raw, plans)
    moved = (F.col("fine") + F.lit("0.000000000000001").cast("decimal(22,21)")).cast(loaded.schema["fine"].dataType)
    return R.reconcile(loaded.withColumn("fine", moved), plans, raw.count()).drop("ordinal")


_DIGEST = "CAST(('0x' || substr(md5(concat({0})), 1, 15)) AS BIGINT)"


def _digest_columns(name: str) -> str:
    return ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in TEXT_TABLES[name])


@query("content_digests", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows, CAST(sum(CAST({_DIGEST.format(_digest_columns(n))} AS HUGEINT)) AS VARCHAR) AS digest FROM ({text_table_sql(n)})" for n in TEXT_TABLES))
def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [R.content_digest(text_table(spark, sf_dir, n)).select(F.lit(n).alias("table_name"), "rows", "digest") for n in TEXT_TABLES]
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


@query("checksum_reconciliation", f"""SELECT count(*) AS source_rows, count(*) AS target_rows, CAST(sum(CAST({_DIGEST.format(_digest_columns('orders'))} AS HUGEINT)) AS VARCHAR) AS source_digest,
  CAST(sum(CAST({_DIGEST.format(_digest_columns('orders'))} AS HUGEINT)) AS VARCHAR) AS target_digest, 'passed' AS status FROM ({text_table_sql('orders')})""")
def _checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.sources.delimited import text_to_parquet

    return text_to_parquet(text_table(spark, sf_dir, "orders"), fresh_path(spark, "orders-columnar"))


@query("keyed_differences", """SELECT o_orderkey, 'o_totalprice' AS "column", CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS source, (CAST(o_totalprice AS DECIMAL(18,2)) + 1)::VARCHAR AS target FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus <> 'P'
  UNION ALL SELECT o_orderkey, '(row)', 'present', NULL FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT -1 - o_orderkey, '(row)', NULL, 'present' FROM orders WHERE o_orderstatus = 'P'""")
def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = F.col("o_totalprice").cast("decimal(18,2)")
    source = table(spark, sf_dir, "orders").withColumn("o_totalprice", money)
    target = source.withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "5-LOW", (F.col("o_totalprice") + 1).cast("decimal(18,2)"))
                               .otherwise(F.col("o_totalprice")))
    moved = target.withColumn("o_orderkey", F.when(F.col("o_orderstatus") == "P", -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey")))
    return R.keyed_differences(source, moved, ["o_orderkey"])


@query("digest_tree_differences", """SELECT o_orderkey, 'o_totalprice' AS "column", CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS source, (CAST(o_totalprice AS DECIMAL(18,2)) + 1)::VARCHAR AS target FROM orders WHERE o_orderkey % 997 = 5
  UNION ALL SELECT o_orderkey, '(row)', 'present', NULL FROM orders WHERE o_orderkey % 1009 = 8 AND o_orderkey % 997 <> 5""")
def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few orders changed and few lost: only their ranges are compared row by row."""
    key = F.col("o_orderkey")
    source = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    changed = F.when(key % 997 == 5, (F.col("o_totalprice") + 1).cast("decimal(18,2)")).otherwise(F.col("o_totalprice"))
    target = source.withColumn("o_totalprice", changed).filter((key % 1009 != 8) | (key % 997 == 5))
    return R.tree_differences(source, target, ["o_orderkey"])


@query("unequal_lineitem_ranges", "SELECT count(*) AS source_rows, count(*) AS target_rows, CAST(1 AS BIGINT) AS unequal_ranges, true AS few_rows FROM lineitem")
def _one_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order's lines changed: one range differs, and it holds a small share of the rows."""
    lines = table(spark, sf_dir, "lineitem")
    last = F.broadcast(lines.agg(F.max("l_orderkey").alias("last")))  # one row
    tax = F.when(F.col("last").isNotNull(), F.col("l_tax") + 1).otherwise(F.col("l_tax"))
    target = lines.join(last, F.col("l_orderkey") == F.col("last"), "left").withColumn("l_tax", tax).drop("last")
    root = R.digest_tree(lines, ["l_orderkey"]).filter("level = 0").select(F.col("rows").alias("source_rows"))
    other = R.digest_tree(target, ["l_orderkey"]).filter("level = 0").select(F.col("rows").alias("target_rows"))
    found = R.unequal_ranges(lines, target, ["l_orderkey"]).agg(F.count("*").alias("unequal_ranges"), F.sum("source_rows").alias("moved"))
    one = [df.withColumn("_one", F.lit(1)) for df in (root, other, found)]
    return one[0].join(one[1], "_one").join(one[2], "_one").select("source_rows", "target_rows", "unequal_ranges", (F.col("moved") * 100 < F.col("source_rows")).alias("few_rows"))


@query("row_differences", """SELECT lang, source, n, count(*) FILTER (side = 1) AS source_copies, count(*) FILTER (side = 0) AS target_copies FROM
  (SELECT lang, source, n_chars % 50 AS n, 1 AS side FROM documents UNION ALL SELECT lang, source, CASE WHEN lang = 'fr' THEN n_chars % 49 ELSE n_chars % 50 END, 0 FROM documents)
  GROUP BY lang, source, n HAVING count(*) FILTER (side = 1) <> count(*) FILTER (side = 0)""")
def _row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    source = docs.selectExpr("lang", "source", "n_chars % 50 AS n")
    target = docs.selectExpr("lang", "source", "CASE WHEN lang = 'fr' THEN n_chars % 49 ELSE n_chars % 50 END AS n")
    return R.row_differences(source, target)


@query("deduplicated_reconciliation", """SELECT 'linhas' AS verificacao, CAST(count(*) AS VARCHAR) AS esperado, CAST(count(*) AS VARCHAR) AS obtido, 'OK' AS status FROM (SELECT DISTINCT lang, source FROM documents)
  UNION ALL SELECT 'tamanho_max(lang)', CAST(max(length(lang)) AS VARCHAR), CAST(max(length(lang)) AS VARCHAR), 'OK' FROM documents
  UNION ALL SELECT 'tamanho_max(origin)', CAST(max(length(source)) AS VARCHAR), CAST(max(length(source)) AS VARCHAR), 'OK' FROM documents""")
def _deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spread(table(spark, sf_dir, "documents").select("lang", "source"))
    counts = P.duplicate_rows({"documents": raw}).first()
    mapping = spark.createDataFrame([("documents", "lang", "lang", "string", False), ("documents", "source", "origin", "string", False)],
                                    "dataset string, source string, target string, type string, legacy boolean")
    plans = L.plan_columns(P.profile(raw, "documents"), mapping)
    path = fresh_path(spark, "documents-once")
    L.load_table(raw, plans, path, counts["rows"] - counts["duplicate_rows"], drop_duplicates=True)
    return R.reconcile(spark.read.parquet(path), plans, counts["rows"], counts["duplicate_rows"], True).drop("ordinal")
