"""Run histories, costs and portfolio views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import spending as S
from plumbline.functions import types as Y
from plumbline.operators import flags as G
from plumbline.operators import portfolio as Q
from plumbline.operators import runs as H
from plumbline.queries.profiles import ALL_COLUMNS_SQL, TEXT_TABLES, TOTALS_SQL, all_columns, all_totals, profile_sql, text_table, text_table_sql
from plumbline.queries.registry import query, spread, table
from plumbline.session import fresh_path

# ---- events as runs: a user is a run, an event type a step --------------------------------------------------------

STEPS = {"types": ["view", "click", "error"], "required": ["signup", "purchase"], "failures": ["error", "click"]}


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS run_id", "event_id AS seq", "event_type AS type", "event_id * 3 AS t_ms", "props AS payload")


def _last(kind: str) -> str:
    return f"arg_max(props, event_id) FILTER (event_type = '{kind}')"


FOLD_SQL = f"""SELECT user_id AS run_id, count(*) AS events, CAST(max(event_id) * 3 AS BIGINT) AS elapsed_ms, {', '.join(f'{_last(k)} AS last_{k}' for k in ('view', 'click', 'error', 'signup', 'purchase'))},
  CASE WHEN bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase') THEN 'completed' ELSE 'failed' END AS status, coalesce({_last('error')}, {_last('click')}) AS reason FROM events GROUP BY user_id"""


@query("run_folds", FOLD_SQL)
def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fold_events(run_events(spark, sf_dir), **STEPS)


#: Rows of a part file, where a part has more than one.
FILE_ROWS = 1_000_000


def parts_of(spark: SparkSession, parts: list[DataFrame], label: str) -> tuple[str, int]:
    """A folder of part files, written one after the other, so that a stream reads them in this order; and how many
    files each part has, so that a batch is a part. The last part may have fewer."""
    folder = fresh_path(spark, label)
    files = 1 + min(part.count() for part in parts[:-1]) // FILE_ROWS
    for part in parts:
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(folder)
    return folder, files


@query("run_folds_streamed", FOLD_SQL)
def _fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.streaming import run_events as R

    stream = R.stream_table(spark, f"{sf_dir}/events.parquet").selectExpr(
        "user_id AS run_id", "event_id AS seq", "event_type AS type", "event_id * 3 AS t_ms", "props AS payload")
    return R.folded_runs(spark, stream, **STEPS)


@query("daily_quota_windows", """SELECT user_id, strftime(date_trunc('hour', ts) - to_hours(CAST(h AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS runs FROM events, range(24) r(h) GROUP BY ALL""")
def _quota_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.streaming import run_events as R

    stream = R.stream_table(spark, f"{sf_dir}/events.parquet").select("user_id", "ts")
    windows, _ = R.window_quota(spark, stream, "user_id", "ts")
    return windows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("late_events_kept", """WITH ordered AS (SELECT user_id, ts, event_id % 3 AS batch FROM events),
  marks AS (SELECT b.batch, max(o.ts) - INTERVAL 240 HOUR AS mark FROM (SELECT DISTINCT batch FROM ordered) b LEFT JOIN ordered o ON o.batch < b.batch GROUP BY b.batch),
  told AS (SELECT o.*, coalesce(ts < mark, false) AS late FROM ordered o JOIN marks USING (batch))
  SELECT 'window' AS kind, user_id, strftime(date_trunc('hour', ts) - to_hours(CAST(h AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS at, count(*) AS n FROM told, range(24) r(h) WHERE NOT late GROUP BY ALL
  UNION ALL SELECT 'late', user_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), count(*) FROM told WHERE late GROUP BY ALL""")
def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in three batches that overlap in time: what lies ten days behind the batches before is late."""
    from plumbline.streaming import run_events as R

    events = table(spark, sf_dir, "events")
    folder, files = parts_of(spark, [events.filter(F.col("event_id") % 3 == i).select("user_id", "ts") for i in range(3)], "events-in-parts")
    windows, late = R.window_quota(spark, R.stream_table(spark, folder, files), "user_id", "ts", "240 hours")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("at")
    return windows.select(F.lit("window").alias("kind"), "user_id", shown("window_start"), F.col("runs").alias("n")).unionByName(
        late.groupBy("user_id", shown("ts")).agg(F.count("*").alias("n")).select(F.lit("late").alias("kind"), "user_id", "at", "n"))


@query("arriving_files_profile", profile_sql(text_table_sql("customer"), list(TEXT_TABLES["customer"]), "customer"))
def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in five batches, merged after every second one."""
    from plumbline.streaming.growing import arriving_profile
    from plumbline.streaming.run_events import stream_table

    rows = text_table(spark, sf_dir, "customer")
    part = F.pmod(F.xxhash64("c_custkey"), F.lit(5))
    folder, files = parts_of(spark, [rows.filter(part == i) for i in range(5)], "customers-in-parts")
    found = arriving_profile(spark, stream_table(spark, folder, files), "customer", merge_every=2)
    return found.profile().drop("out_of_range", "fingerprint")


# ---- customers as runs with every kind of event -------------------------------------------------------------------

# Per event: its place in the run, its type, when it occurs, and the fields of its payload.
RUN_STEPS = [
    (1, "payload.built", "true", {"prompt": "c_name"}),
    (2, "gate.scored", "true", {"tier": "c_mktsegment", "score": "c_nationkey", "input_cap": "CAST(32000 AS BIGINT)", "output_cap": "CAST(8000 AS BIGINT)", "price_in": "0.25", "price_out": "1.5", "estimated_cost_usd": "0.125"}),
    (3, "provider.response", "c_custkey % 7 <> 0", {"latency_ms": "c_custkey"}),
    (4, "provider.error", "c_custkey % 7 = 0", {"message": "concat('no answer for ', c_name)"}),
    (5, "result", "c_custkey % 7 <> 0", {"mappings": "named_struct('a', c_name)", "error": "CASE WHEN c_custkey % 5 = 0 THEN 'odd answer' END"}),
    (6, "checks", "c_custkey % 7 <> 0", {"checks": "array(named_struct('name', 'unique', 'n', c_nationkey))", "pass_rate": "0.5"}),
    (7, "rule.corrected", "c_custkey % 3 = 0 AND c_custkey % 7 <> 0", {"mappings": "named_struct('a', c_mktsegment)", "checks": "array(named_struct('name', 'fixed', 'n', c_nationkey))", "changes": "array(c_mktsegment)", "pass_rate": "1.0"}),
    (8, "policy", "true", {"action": "CASE WHEN c_custkey % 3 = 0 THEN 'accept' ELSE 'refine' END"}),
    (9, "summary", "true", {"input_tokens": "c_custkey * 3", "output_tokens": "c_custkey", "cost_usd": "0.5"}),
    (10, "done", "c_custkey % 11 <> 0", {"t": "1"}),
]


def governed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, seq, type, t_ms, payload, at)``: a run of each customer, a minute an event; some runs are not closed."""
    steps = ", ".join(
        f"CASE WHEN {when} THEN named_struct('seq', {seq}, 'type', '{kind}', 'payload', to_json(named_struct({', '.join(f'{n!r}, {v}' for n, v in said.items())}))) END"
        for seq, kind, when, said in RUN_STEPS)
    rows = spread(table(spark, sf_dir, "customer")).selectExpr("c_custkey AS run_id", f"explode(array_compact(array({steps}))) AS e")
    return rows.selectExpr("run_id", "e.seq AS seq", "e.type AS type", "run_id % 1000 + e.seq * 10 AS t_ms", "e.payload AS payload",
                           "timestampadd(MINUTE, e.seq, timestampadd(SECOND, CAST(run_id % 600 AS INT), TIMESTAMP '2024-01-01 00:00:00')) AS at")


RUN_ROWS_SQL = """SELECT c_custkey AS run_id, CAST(CASE WHEN bad THEN 5 WHEN ruled THEN 8 ELSE 7 END AS BIGINT) AS events, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, c_mktsegment AS tier, CAST(c_nationkey AS DOUBLE) AS score,
  CAST(c_custkey * 3 AS BIGINT) AS input_tokens, CAST(c_custkey AS BIGINT) AS output_tokens, 0.5::DOUBLE AS cost_usd, CASE WHEN NOT bad THEN CAST(c_custkey AS DOUBLE) END AS latency_ms, CAST(c_custkey % 1000 + 90 AS BIGINT) AS elapsed_ms,
  CASE WHEN bad THEN NULL WHEN ruled THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS pass_rate, CASE WHEN c_custkey % 3 = 0 THEN 'accept' ELSE 'refine' END AS policy_action,
  CASE WHEN NOT bad THEN '{"a":"' || CASE WHEN ruled THEN c_mktsegment ELSE c_name END || '"}' END AS mappings_json,
  CASE WHEN NOT bad THEN '[{"name":"' || CASE WHEN ruled THEN 'fixed' ELSE 'unique' END || '","n":' || c_nationkey || '}]' END AS checks_json, CAST(ruled AS INTEGER) AS edited,
  CASE WHEN ruled THEN '{"a":"' || c_name || '"}' END AS original_mappings_json, CASE WHEN ruled THEN '["' || c_mktsegment || '"]' END AS changes_json, c_name AS prompt,
  0.25::DOUBLE AS price_in, 1.5::DOUBLE AS price_out, 0.125::DOUBLE AS estimated_cost_usd, CAST(32000 AS BIGINT) AS input_cap, CAST(8000 AS BIGINT) AS output_cap,
  CASE WHEN bad THEN 'no answer for ' || c_name WHEN c_custkey % 5 = 0 THEN 'odd answer' END AS error
  FROM (SELECT *, c_custkey % 7 = 0 AS bad, c_custkey % 3 = 0 AND c_custkey % 7 <> 0 AS ruled FROM customer)"""


@query("run_rows", RUN_ROWS_SQL)
def _run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.streaming.run_events import PASSING

    return H.run_rows(H.fold_events(governed_events(spark, sf_dir).filter(~F.col("type").isin(*PASSING))))


@query("run_rows_streamed", RUN_ROWS_SQL)
def _run_rows_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches; a run in a later year moves the watermark past the runs that were never closed."""
    from plumbline.streaming import run_events as R

    # Written once by all tasks, so that cutting it into parts is copying.
    path = fresh_path(spark, "governed")
    governed_events(spark, sf_dir).write.parquet(path)
    events = spark.read.parquet(path)
    bounds = [(1, 3), (4, 6), (7, 10)]
    parts = [events.filter(F.col("seq").between(*b)) for b in bounds]
    later = table(spark, sf_dir, "customer").agg(F.max("c_custkey").cast("long").alias("run_id")).selectExpr(
        "-1 - run_id AS run_id", "1 AS seq", "'done' AS type", "CAST(0 AS BIGINT) AS t_ms", "'{}' AS payload", "TIMESTAMP '2025-01-01 00:00:00' AS at")
    columns = [F.col(f.name).cast(f.dataType) for f in events.schema]
    folder, files = parts_of(spark, [*parts, later.select(*columns)], "governed-events")
    rows, _ = R.closed_runs(spark, R.stream_table(spark, folder, files))
    return rows.filter("run_id >= 0")


@query("trailing_run_counts", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS recent FROM events")
def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return H.trailing_counts(events, "user_id", "ts").select("event_id", "user_id", "recent")


# One user with a third of all events, inside one hour.
HOT_SQL = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id,
  CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (event_id % 3600) SECOND ELSE ts END AS ts FROM events"""


@query("trailing_run_counts_hot_user", f"SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS recent FROM ({HOT_SQL})")
def _trailing_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = F.col("event_id") % 3 == 0
    within = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("event_id") % 3600)
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(hot, -1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(hot, within).otherwise(F.col("ts").cast("timestamp")).alias("ts"))
    return H.trailing_counts(events, "user_id", "ts").select("event_id", "user_id", "recent")


# ---- orders as runs: a customer is a dataset ----------------------------------------------------------------------

RUN_ROW = {
    "dataset_id": "o_custkey", "id": "o_orderkey",
    "status": "CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END",
    "decision": "CASE o_orderpriority WHEN '1-URGENT' THEN 'approved' WHEN '2-HIGH' THEN 'rejected' ELSE 'pending' END",
    "elapsed_ms": "CASE WHEN o_totalprice > 400000 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END",
    "cost_usd": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) / 1000000",
}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        *[f"{sql} AS {n}" for n, sql in RUN_ROW.items()], "date_format(o_orderdate, 'yyyy-MM-dd 08:00:00') AS created_at",
        "CASE WHEN o_orderstatus = 'F' THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd 09:30:15') END AS decided_at")


RUNS_SQL = "SELECT " + ", ".join(f"{sql} AS {n}" for n, sql in RUN_ROW.items()) + """, strftime(o_orderdate, '%Y-%m-%d 08:00:00') AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d 09:30:15') END AS decided_at FROM orders"""
BEST_SQL = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY decision = 'approved' DESC, id DESC) AS rn FROM ({RUNS_SQL}) WHERE status = 'completed') WHERE rn = 1"


@query("best_runs", f"SELECT dataset_id, id, decision FROM ({BEST_SQL})")
def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.best_runs(runs(spark, sf_dir)).select("dataset_id", "id", "decision")


@query("run_history", f"SELECT dataset_id, id, status, decision, created_at FROM ({RUNS_SQL})")
def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.run_history(runs(spark, sf_dir)).select("dataset_id", "id", "status", "decision", "created_at")


@query("dataset_listing", f"SELECT c_custkey AS dataset_id, c_name AS filename, b.decision AS mapping FROM customer LEFT JOIN ({BEST_SQL}) b ON b.dataset_id = c_custkey")
def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = table(spark, sf_dir, "customer").selectExpr("c_custkey AS dataset_id", "c_name AS filename")
    return H.dataset_listing(datasets, runs(spark, sf_dir))


@query("decision_states", f"SELECT coalesce(b.decision, 'none') AS state, count(*) AS datasets FROM customer LEFT JOIN ({BEST_SQL}) b ON b.dataset_id = c_custkey GROUP BY 1")
def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = table(spark, sf_dir, "customer").selectExpr("c_custkey AS dataset_id")
    return Q.decision_states(datasets, H.best_runs(runs(spark, sf_dir)))


MEDIANS_SQL = "SELECT o_custkey AS dataset_id, count(*) AS baselines, CAST(median(s) AS DOUBLE) AS manual_seconds FROM (SELECT o_custkey, CAST(floor(o_totalprice / 3) AS INTEGER) AS s FROM orders) WHERE s BETWEEN 30 AND 86400 GROUP BY o_custkey"


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS dataset_id", "CAST(floor(o_totalprice / 3) AS INT) AS seconds")


@query("baseline_medians", MEDIANS_SQL)
def _medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.baseline_medians(baselines(spark, sf_dir))


ECONOMY_SQL = f"""SELECT *, CASE WHEN review_seconds IS NOT NULL THEN manual_hours - (ai_seconds + review_seconds) / 3600 END AS saving_hours,
    CASE WHEN review_seconds IS NOT NULL THEN (manual_hours - (ai_seconds + review_seconds) / 3600) * 60 - cost_usd END AS saving_usd FROM
  (SELECT r.dataset_id, id, decision, elapsed_ms / 1000 AS ai_seconds, CAST(CASE WHEN decision <> 'pending' THEN epoch(try_strptime(decided_at, '%Y-%m-%d %H:%M:%S')) - epoch(strptime(created_at, '%Y-%m-%d %H:%M:%S')) END AS DOUBLE) AS review_seconds,
    coalesce(manual_seconds / 3600, 2.0::DOUBLE) AS manual_hours, manual_seconds IS NOT NULL AS manual_is_reported, coalesce(baselines, 0) AS baselines, cost_usd
    FROM ({RUNS_SQL}) r LEFT JOIN ({MEDIANS_SQL}) m ON m.dataset_id = r.dataset_id WHERE elapsed_ms IS NOT NULL)"""


def economies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.economy(runs(spark, sf_dir), H.baseline_medians(baselines(spark, sf_dir)))


@query("run_economy", f"SELECT * EXCLUDE (cost_usd) FROM ({ECONOMY_SQL})")
def _economy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economies(spark, sf_dir)


_EXACT = "coalesce(CAST(sum(CAST({0} AS DECIMAL(28,8))) AS DOUBLE), 0)"


@query("economy_totals", f"""SELECT count(saving_hours) AS decided, count(*) FILTER (saving_hours IS NOT NULL AND manual_is_reported) AS with_baseline,
  {_EXACT.format('saving_hours')} AS saving_hours, {_EXACT.format('CASE WHEN manual_is_reported THEN saving_hours END')} AS saving_hours_reported, {_EXACT.format('saving_usd')} AS saving_usd,
  {_EXACT.format('CASE WHEN saving_hours IS NOT NULL THEN review_seconds END')} / 60 AS review_minutes, {_EXACT.format('ai_seconds')} AS ai_seconds FROM ({ECONOMY_SQL})""")
def _economy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.economy_totals(economies(spark, sf_dir))


@query("elapsed_seconds", "SELECT id, CAST(epoch(try_strptime(decided_at, '%Y-%m-%d %H:%M:%S')) - epoch(strptime(created_at, '%Y-%m-%d %H:%M:%S')) AS DOUBLE) AS seconds FROM (" + RUNS_SQL + ")")
def _elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("id", H.elapsed_seconds(F.col("created_at"), F.col("decided_at")).alias("seconds"))


# ---- events as attempts: a user is an artifact --------------------------------------------------------------------

ATTEMPT_ROW = {
    "artifact_id": "user_id", "attempt_no": "event_id",
    "tier": "CASE event_type WHEN 'view' THEN 'daylight' WHEN 'click' THEN 'horizon' WHEN 'signup' THEN 'twilight' WHEN 'purchase' THEN 'starlight' ELSE 'aurora' END",
    "pass_rate": "CAST(CAST(value AS DECIMAL(18,2)) / 100 AS DECIMAL(18,4))",
    "cost_usd": "CAST(CAST(value AS DECIMAL(18,2)) - 5 AS DECIMAL(18,4))",
}
ATTEMPTS_SQL = "SELECT " + ", ".join(f"{sql} AS {n}" for n, sql in ATTEMPT_ROW.items()) + " FROM events"
VALID_SQL = f"SELECT * FROM ({ATTEMPTS_SQL}) WHERE pass_rate BETWEEN 0 AND 1 AND cost_usd >= 0"
HISTORY_SQL = f"""SELECT artifact_id, attempt_no, tier, pass_rate, cost_usd, sum(cost_usd) OVER w AS spent_usd, count(*) OVER w AS attempts, max(pass_rate) OVER w AS best_pass_rate,
  pass_rate - max(pass_rate) OVER (PARTITION BY artifact_id ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gain FROM ({VALID_SQL})
  WINDOW w AS (PARTITION BY artifact_id ORDER BY attempt_no ROWS UNBOUNDED PRECEDING)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{sql} AS {n}" for n, sql in ATTEMPT_ROW.items()])


def attempt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = H.valid_attempts(attempts(spark, sf_dir))
    return H.attempt_history(valid, F.floor(F.col("attempt_no") / 4096).cast("long"))


def _as_double(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")})


_HISTORY_DOUBLE = "SELECT artifact_id, attempt_no, tier, CAST(pass_rate AS DOUBLE) AS pass_rate, CAST(cost_usd AS DOUBLE) AS cost_usd, CAST(spent_usd AS DOUBLE) AS spent_usd, attempts, CAST(best_pass_rate AS DOUBLE) AS best_pass_rate, CAST(gain AS DOUBLE) AS gain"


@query("attempt_history", f"{_HISTORY_DOUBLE} FROM ({HISTORY_SQL})")
def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_double(attempt_history(spark, sf_dir))


@query("rejected_attempts", f"SELECT artifact_id, attempt_no FROM ({ATTEMPTS_SQL}) WHERE NOT (pass_rate BETWEEN 0 AND 1 AND cost_usd >= 0)")
def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.valid_attempts(attempts(spark, sf_dir))[1].select("artifact_id", "attempt_no")


POLICY = H.Policy(max_attempts=12, budget=400.0, target=0.99)
ESTIMATES = {"daylight": 1.0, "horizon": 3.0, "twilight": 8.0, "starlight": 20.0, "aurora": 40.0}


@query("refinement_decisions", f"""WITH h AS (SELECT *, 400 - spent_usd AS remaining, coalesce(gain < 0.02, false) AS stalled FROM ({HISTORY_SQL})),
  n AS (SELECT *, CASE WHEN NOT stalled THEN tier WHEN tier = 'daylight' THEN 'horizon' WHEN tier = 'horizon' THEN 'twilight' WHEN tier = 'twilight' THEN 'starlight' WHEN tier = 'starlight' THEN 'aurora' END AS t FROM h),
  e AS (SELECT *, CASE t WHEN 'daylight' THEN 1 WHEN 'horizon' THEN 3 WHEN 'twilight' THEN 8 WHEN 'starlight' THEN 20 WHEN 'aurora' THEN 40 END AS est FROM n),
  d AS (SELECT *, CASE WHEN best_pass_rate >= 0.99 THEN 'accept' WHEN attempts >= 12 THEN 'stop_exhausted' WHEN t IS NULL THEN 'stop_stalled' WHEN est > remaining THEN 'stop_budget'
    WHEN NOT stalled AND best_pass_rate < 0.5 AND est * 2 <= remaining THEN 'parallel' WHEN stalled THEN 'escalate' ELSE 'refine' END AS action FROM e)
  SELECT artifact_id, attempt_no, action, CASE WHEN action IN ('parallel', 'escalate', 'refine') THEN t END AS next_tier, CAST(CASE action WHEN 'parallel' THEN 2 WHEN 'escalate' THEN 1 WHEN 'refine' THEN 1 ELSE 0 END AS INTEGER) AS candidates FROM d""")
def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.decide(attempt_history(spark, sf_dir), ESTIMATES, POLICY).select("artifact_id", "attempt_no", "action", "next_tier", "candidates")


HINTED_SQL = "SELECT 1 FROM supplier WHERE s_nationkey % 2 = 0"

# ---- costs, budgets, tiers ----------------------------------------------------------------------------------------

USAGE_SQL = "SELECT conv_id, turn, role, length(text) * 20 AS tin, length(text) * 7 AS tout, round(length(text) * 20 / 1e6 * 400.0 + length(text) * 7 / 1e6 * 800.0, 8) AS cost FROM conversations"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.length("text") * 20).alias("tin"), (F.length("text") * 7).alias("tout"))
    return sized.withColumn("cost", S.call_cost(F.col("tin"), F.col("tout"), 400.0, 800.0))


@query("call_costs", f"SELECT conv_id, turn, round(cost, 6) AS cost FROM ({USAGE_SQL})")
def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).select("conv_id", "turn", F.round("cost", 6).alias("cost"))


@query("budget_violations", f"""SELECT conv_id, turn, concat_ws('; ', CASE WHEN tin > 32000 THEN 'input token budget exceeded' END, CASE WHEN tout > 8000 THEN 'output token budget exceeded' END, CASE WHEN cost > 1 THEN 'cost budget exceeded' END) AS violations
  FROM ({USAGE_SQL}) WHERE tin > 32000 OR tout > 8000 OR cost > 1""")
def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.budget_violations(F.col("tin"), F.col("tout"), F.col("cost"))
    return usage(spark, sf_dir).select("conv_id", "turn", found.alias("violations")).filter("violations is not null")


@query("telemetry_totals", f"SELECT role AS agent, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens, round(CAST(sum(CAST(cost AS DECIMAL(28,8))) AS DOUBLE), 4) AS cost_usd FROM ({USAGE_SQL}) WHERE turn > 0 GROUP BY role")
def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.col("turn") > 0
    events = usage(spark, sf_dir).select(
        F.col("role").alias("agent"), F.when(told, F.col("tin")).alias("input_tokens"), F.when(told, F.col("tout")).alias("output_tokens"),
        F.when(told, F.col("cost").cast("decimal(28,8)")).alias("cost_usd"))
    return H.totals_by_agent(events).withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 4))


@query("compression_gate", r"""SELECT doc_id, b AS before, ok AS applied, CASE WHEN ok THEN a ELSE b END AS tokens_after, greatest(0, b - CASE WHEN ok THEN a ELSE b END) AS tokens_saved,
  round(CASE WHEN b = 0 THEN 0.0 ELSE greatest(0, b - CASE WHEN ok THEN a ELSE b END) / b END, 6) AS savings_ratio FROM
  (SELECT doc_id, b, a, b > 0 AND a <= b AND (b - a) / b >= 0.1 AS ok FROM (SELECT doc_id, length(text) AS b, length(regexp_replace(text, '[aeiou ]+', ' ', 'g')) + doc_id % 7 * 40 AS a FROM documents))""")
def _compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").cast("long").alias("before"),
        (F.length(F.regexp_replace("text", "[aeiou ]+", " ")) + F.col("doc_id") % 7 * 40).alias("after"))
    return H.compression_gate(pairs).drop("after").withColumn("savings_ratio", F.round("savings_ratio", 6))


@query("complexity_tiers", """SELECT p_partkey, score, CASE WHEN score BETWEEN 0 AND 15 THEN 'solar' WHEN score BETWEEN 16 AND 30 THEN 'daylight' WHEN score BETWEEN 31 AND 45 THEN 'horizon' WHEN score BETWEEN 46 AND 60 THEN 'twilight'
    WHEN score BETWEEN 61 AND 80 THEN 'starlight' WHEN score BETWEEN 81 AND 100 THEN 'aurora' END AS tier,
  CAST(CASE WHEN score BETWEEN 0 AND 15 THEN 0 WHEN score BETWEEN 16 AND 30 THEN 1200 WHEN score BETWEEN 31 AND 45 THEN 2400 WHEN score BETWEEN 46 AND 60 THEN 4800 WHEN score BETWEEN 61 AND 80 THEN 8000 WHEN score BETWEEN 81 AND 100 THEN 12000 END AS INTEGER) AS output_cap
  FROM (SELECT p_partkey, CAST(least(100, 36 + 2 * p_size + 4 * (p_partkey % 5)) AS DOUBLE) - CASE WHEN p_size > 40 THEN 84.5 WHEN p_size > 30 THEN 10.5 ELSE 0 END AS score FROM part)""")
def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = S.complexity_score(F.col("p_size"), F.col("p_partkey") % 5)
    score = base - F.when(F.col("p_size") > 40, 84.5).when(F.col("p_size") > 30, 10.5).otherwise(0.0)
    scored = table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).withColumn("tier", S.tier_for_score(F.col("score")))
    return scored.withColumn("output_cap", S.tier_cap(F.col("tier")))


# ---- repeated measurements ----------------------------------------------------------------------------------------


@query("timing_stats", """SELECT event_type, count(*) AS n, median(value) AS median, list_sort(list(value))[CAST(least(count(*) - 1, round_even(0.95 * (count(*) - 1), 0)) AS BIGINT) + 1] AS p95,
  max(value) AS max, CAST(sum(CAST(value AS DECIMAL(28,8))) AS DOUBLE) / count(*) AS mean FROM events GROUP BY event_type""")
def _timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.timing_stats(table(spark, sf_dir, "events"), ["event_type"], "value")


# A NULL key, and one value that is a thousand million times the others.
_SKEWED = "SELECT nullif(event_type, 'error') AS event_type, CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN 1e15::DOUBLE ELSE value END AS value FROM events"


@query("timing_stats_outlier", f"""SELECT event_type, count(*) AS n, median(value) AS median, list_sort(list(value))[CAST(least(count(*) - 1, round_even(0.95 * (count(*) - 1), 0)) AS BIGINT) + 1] AS p95,
  max(value) AS max FROM ({_SKEWED}) GROUP BY event_type""")
def _timing_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = F.broadcast(events.agg(F.max("event_id").alias("last")))  # one row
    marked = events.join(last, F.col("event_id") == F.col("last"), "left")
    value = F.when(F.col("last").isNotNull(), F.lit(1e15)).otherwise(F.col("value"))
    return Q.timing_stats(marked.select(F.nullif("event_type", F.lit("error")).alias("event_type"), value.alias("value")), ["event_type"], "value").drop("mean")


KINDS = ["integer", "decimal", "boolean", "date", "text", "mixed", "empty"]
SUGGESTED = ["int", "double", "string", "date", "bigint", "boolean", "decimal", "timestamp"]
ANSWERS_SQL = f"""SELECT source AS dataset, n_chars % 3 AS rep, CASE WHEN n_chars % 4 = 0 THEN 'Col ' || lang ELSE lang END AS "column", ({KINDS!r})[n_chars % 7 + 1] AS type,
  CASE WHEN n_chars % 5 = 0 THEN 'Col ' || lang ELSE 'col_' || lang END AS target, ({SUGGESTED!r})[n_chars % 9 + 1] AS suggested FROM documents"""
FAMILY_SQL = "coalesce(CASE type " + " ".join(f"WHEN '{k}' THEN suggested IN ({', '.join(map(repr, v))})" for k, v in Y.FAMILIES.items()) + " END, false)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda pool, n: F.get(F.array(*[F.lit(x) for x in pool]), (F.col("n_chars") % n).cast("int"))
    odd = F.concat(F.lit("Col "), "lang")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset"), (F.col("n_chars") % 3).alias("rep"), F.when(F.col("n_chars") % 4 == 0, odd).otherwise(F.col("lang")).alias("column"),
        pick(KINDS, 7).alias("type"), F.when(F.col("n_chars") % 5 == 0, odd).otherwise(F.concat(F.lit("col_"), "lang")).alias("target"),
        pick(SUGGESTED, 9).alias("suggested"))


@query("type_agreement", f"""SELECT dataset, rep, count(*) AS columns, count(*) FILTER ({FAMILY_SQL}) AS agreeing, count(*) FILTER (NOT regexp_full_match("column", '[a-z_][a-z0-9_]*')) AS renames_needed,
  count(*) FILTER (NOT regexp_full_match("column", '[a-z_][a-z0-9_]*') AND target <> "column" AND regexp_full_match(target, '[a-z_][a-z0-9_]*')) AS renames_done, count(*) FILTER ({FAMILY_SQL}) / count(*) AS agreement FROM ({ANSWERS_SQL}) GROUP BY dataset, rep""")
def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.type_agreement(answers(spark, sf_dir))


@query("type_disagreements", f"SELECT dataset, \"column\", type || ' → ' || coalesce(suggested, 'None') AS change, count(*) AS times FROM ({ANSWERS_SQL}) WHERE NOT {FAMILY_SQL} GROUP BY ALL")
def _disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.type_disagreements(answers(spark, sf_dir))


@query("stable_columns", "SELECT dataset, count(*) AS columns, count(*) FILTER (a = 1) AS stable FROM (SELECT l_orderkey AS dataset, l_returnflag AS c, count(DISTINCT l_linestatus) AS a FROM lineitem GROUP BY ALL) GROUP BY dataset")
def _stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS dataset", "l_returnflag AS `column`", "l_linestatus AS target", "CAST(NULL AS STRING) AS suggested")
    return Q.stable_columns(rows)


CHECK_ROWS_SQL = """SELECT d.source AS dataset, d.doc_id AS seq, CASE WHEN quality = 1 THEN 'type_fits_data' ELSE 'valid_types' END AS name, CASE WHEN n_chars % 3 = 0 THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN n_chars % 5 = 0 THEN '' ELSE 'col_' || lang || ': int, valores até ' || (n_chars * 9000000) || ' não cabem em int (use bigint)' END AS offender FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""
FAILED_SQL = f"SELECT dataset, name AS \"check\", count(*) AS times, arg_min(offender, seq) AS example FROM ({CHECK_ROWS_SQL}) WHERE status = 'failed' GROUP BY ALL"


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("source").alias("dataset"), F.col("doc_id").alias("seq"), F.when(F.col("quality") == 1, "type_fits_data").otherwise("valid_types").alias("name"),
        F.when(F.col("n_chars") % 3 == 0, "passed").otherwise("failed").alias("status"),
        F.when(F.col("n_chars") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(
            F.concat(F.lit("col_"), "lang", F.lit(": int, valores até "), (F.col("n_chars") * 9000000).cast("string"), F.lit(" não cabem em int (use bigint)")))).alias("offenders"))
    return Q.failed_checks(rows)


@query("failed_checks", FAILED_SQL)
def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures(spark, sf_dir)


@query("overflow_findings", f"""SELECT dataset, regexp_extract(example, '^(\\w+): (\\w+), valores até ([0-9]+) não cabem', 1) AS "column", upper(regexp_extract(example, '^(\\w+): (\\w+), valores até ([0-9]+) não cabem', 2)) AS suggested,
  regexp_extract(example, 'valores até ([0-9]+)', 1) AS max, times FROM ({FAILED_SQL}) WHERE "check" = 'type_fits_data' AND example <> ''""")
def _overflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.overflow_findings(failures(spark, sf_dir))


@query("detection_score", """WITH e AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), f AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars < 600)
  SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM e SEMI JOIN f USING (doc_id)) AS detected, (SELECT count(*) FROM e ANTI JOIN f USING (doc_id)) AS missed, (SELECT count(*) FROM f ANTI JOIN e USING (doc_id)) AS unexpected""")
def _detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.detection_score(table(spark, sf_dir, "labels").filter("quality = 0"), table(spark, sf_dir, "documents").filter("n_chars < 600"), ["doc_id"])


@query("pass_rate_per_source", """SELECT s.source, count(l.doc_id) AS checks, count(*) FILTER (l.quality = 1) AS passed, CASE WHEN count(l.doc_id) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (l.quality = 1) / count(l.doc_id) END AS pass_rate
  FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT d.source, l.* FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.lang = 'fr') l ON l.source = s.source GROUP BY s.source""")
def _source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators.mapping import pass_rates

    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    checks = documents.filter("lang = 'fr'").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "source", F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("status"))
    return pass_rates(documents, checks, ["source"])


# ---- across datasets ----------------------------------------------------------------------------------------------


_NAMED_SQL = f"SELECT dataset, type, is_key_candidate, regexp_replace(lower(replace(replace(name, 'o_', ''), 'l_', '')), '[^a-z0-9]', '', 'g') AS name_key FROM ({ALL_COLUMNS_SQL})"


def named_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_columns(spark, sf_dir).withColumn("name", F.replace(F.replace("name", F.lit("o_"), F.lit("")), F.lit("l_"), F.lit("")))


@query("shared_columns", f"""SELECT * FROM (SELECT name_key, count(DISTINCT dataset) AS n_datasets, count(DISTINCT dataset) FILTER (is_key_candidate) AS n_keys, string_agg(DISTINCT type, ',' ORDER BY type) AS types,
    CASE WHEN count(DISTINCT type) > 1 THEN 'conflict' ELSE 'shared' END AS relation FROM ({_NAMED_SQL}) GROUP BY name_key) WHERE n_datasets >= 2""")
def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.shared_columns(named_columns(spark, sf_dir)).withColumn("types", F.concat_ws(",", "types"))


@query("shared_column_datasets", f"""WITH n AS ({_NAMED_SQL}) SELECT name_key, dataset, string_agg(DISTINCT type, ',' ORDER BY type) AS types, bool_or(is_key_candidate) AS is_key FROM n
  WHERE name_key IN (SELECT name_key FROM n GROUP BY name_key HAVING count(DISTINCT dataset) >= 2) GROUP BY name_key, dataset""")
def _shared_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.shared_column_datasets(named_columns(spark, sf_dir)).withColumn("types", F.concat_ws(",", "types"))


@query("portfolio_totals", f"""SELECT dataset, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(columns) AS BIGINT) AS columns, CAST(sum(total_cells) AS BIGINT) AS total_cells, CAST(sum(empty_cells) AS BIGINT) AS empty_cells,
  CAST(sum(duplicate_rows) AS BIGINT) AS duplicate_rows FROM ({TOTALS_SQL}) GROUP BY ROLLUP (dataset)""")
def _portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.portfolio_totals(all_totals(spark, sf_dir)[1])


@query("portfolio_figures", f"""SELECT (SELECT count(*) FROM customer) AS datasets, (SELECT CAST(sum(c_custkey % 100) AS BIGINT) FROM customer) AS rows, (SELECT CAST(sum(1 + c_nationkey % 5) AS BIGINT) FROM customer) AS columns,
  (SELECT CAST(sum(c_custkey * 1000) AS BIGINT) FROM customer) AS bytes, (SELECT count(*) FROM events WHERE event_type = 'error') AS alerts_total, (SELECT count(*) FROM ({HINTED_SQL})) AS hints_total,
  count(*) AS runs_total, CAST(sum(CAST(cost_usd AS DECIMAL(28,8))) AS DOUBLE) AS cost_total FROM ({RUNS_SQL})""")
def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = table(spark, sf_dir, "customer").selectExpr("c_custkey AS dataset", "c_custkey % 100 AS rows", "1 + c_nationkey % 5 AS columns", "c_custkey * 1000 AS bytes")
    alerts = table(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr("user_id AS dataset", "event_type AS kind")
    named = table(spark, sf_dir, "supplier").select(F.concat(F.when(F.col("s_nationkey") % 2 == 0, "telefone_").otherwise("codigo_"), F.col("s_suppkey").cast("string")).alias("name"))
    hints = named.filter(N.privacy_hint(F.col("name")).isNotNull())
    return Q.portfolio_figures(datasets, alerts, runs(spark, sf_dir), hints)


@query("worst_case_costs", """WITH c AS (SELECT conv_id, turn, length(text) * 40 AS tin, ['daylight', 'horizon', 'twilight', 'nebula'][turn % 4 + 1] AS tier, conv_id % 3 = 0 AS unpriced FROM conversations),
  w AS (SELECT *, CASE tier WHEN 'daylight' THEN 4000 WHEN 'horizon' THEN 8000 WHEN 'twilight' THEN 16000 END AS cap_in, CASE tier WHEN 'daylight' THEN 1200 WHEN 'horizon' THEN 2400 WHEN 'twilight' THEN 4800 END AS cap_out FROM c),
  x AS (SELECT *, CASE WHEN cap_out IS NULL THEN NULL WHEN unpriced THEN round(tin / 1e6, 8) ELSE round(tin / 1e6 * 2.0 + cap_out / 1e6 * 8.0, 8) END AS worst FROM w)
  SELECT conv_id, turn, round(worst, 6) AS worst_case, CASE WHEN cap_out IS NULL THEN 'unknown tier' WHEN tin > cap_in THEN 'input token cap exceeded' WHEN worst > 0.025 THEN 'worst case exceeds the budget' END AS refusal FROM x""")
def _worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.get(F.array(*[F.lit(t) for t in ("daylight", "horizon", "twilight", "nebula")]), (F.col("turn") % 4).cast("int"))
    price = lambda p: F.when(F.col("conv_id") % 3 != 0, F.lit(p))
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") * 40).alias("tin"), tier.alias("tier"))
    told = calls.withColumn("worst", S.worst_case_cost(F.col("tin"), F.col("tier"), price(2.0), price(8.0)))
    return told.select("conv_id", "turn", F.round("worst", 6).alias("worst_case"), S.refusal(F.col("tin"), F.col("tier"), F.col("worst"), F.lit(0.025)).alias("refusal"))


@query("flag_frequency", f"""WITH c AS ({ALL_COLUMNS_SQL}) SELECT * FROM (SELECT 'mixed_types' AS kind, count(DISTINCT dataset) AS datasets FROM c WHERE type = 'mixed' UNION ALL SELECT 'ambiguous_dates', count(DISTINCT dataset) FROM c WHERE date_ambiguous
  UNION ALL SELECT 'mostly_empty', count(DISTINCT dataset) FROM c WHERE null_ratio > 0.5 UNION ALL SELECT 'duplicate_rows', count(*) FROM ({TOTALS_SQL}) WHERE duplicate_rows > 0) WHERE datasets > 0""")
def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.flag_frequency(G.flags(*all_totals(spark, sf_dir)))
