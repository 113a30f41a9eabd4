"""Run histories: event folds, best runs, attempts, refinement decisions, quotas and what a run was worth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import median, median_ranks, order_statistics, running

# Event types of one run, and the order in which failures explain it.
EVENT_TYPES = ["run.start", "payload.built", "gate.scored", "gate.blocked", "provider.response", "provider.error",
               "result", "result.blocked", "checks", "rule.corrected", "policy", "summary", "error"]
FAILURES = ["error", "provider.error", "gate.blocked", "result.blocked"]
REQUIRED = ["result", "checks", "provider.response"]

# What is assumed where nothing was reported.
MANUAL_HOURS, RATE_USD = 2.0, 60.0
BASELINE_SECONDS = (30, 24 * 3600)


def fold_events(events: DataFrame, run: str = "run_id", types: list[str] | None = None,
                required: list[str] | None = None, failures: list[str] | None = None) -> DataFrame:
    """One row per run from its events ``(run_id, seq, type, t_ms, payload)``; the last event of a type counts.

    ``last_<type>`` is that event's payload. A run is completed when every required type occurred; otherwise the
    first failure type present explains it. Everything is a mergeable aggregate, so it also runs on a stream.
    """
    types, required, failures = types or EVENT_TYPES, required or REQUIRED, failures or FAILURES
    known = list(dict.fromkeys([*types, *required, *failures]))

    def last(kind: str) -> Column:
        return F.max_by(F.when(F.col("type") == kind, F.col("payload")), F.when(F.col("type") == kind, F.col("seq")))

    folded = events.groupBy(run).agg(
        F.count("*").alias("events"), F.coalesce(F.max("t_ms"), F.lit(0)).alias("elapsed_ms"),
        *[last(k).alias(f"last_{k.replace('.', '_')}") for k in known],
        *[(F.count_if(F.col("type") == k) > 0).alias(f"has_{k.replace('.', '_')}") for k in required])
    completed = F.lit(True)
    for kind in required:
        completed = completed & F.col(f"has_{kind.replace('.', '_')}")
    reason = F.coalesce(*[F.col(f"last_{k.replace('.', '_')}") for k in failures])
    return folded.withColumn("status", F.when(completed, "completed").otherwise("failed")).withColumn(
        "reason", reason).drop(*[f"has_{k.replace('.', '_')}" for k in required])


def run_rows(folded: DataFrame) -> DataFrame:
    """The stored row of each run from its fold: every ``last_<type>`` is the JSON payload of that type's last event.

    The corrected answer goes before the model's own: its mappings, checks and pass rate are the run's, and the
    model's mappings stay beside them. Works on batches and on streams.
    """
    def at(kind: str, *path: str) -> Column:
        return F.get_json_object(f"last_{kind}", "$." + ".".join(path))

    def there(kind: str) -> Column:
        return F.col(f"last_{kind}").isNotNull()

    def said(kind: str, name: str) -> Column:
        return F.nullif(at(kind, name), F.lit(""))

    ruled = there("rule_corrected")
    completed = there("result") & there("checks") & there("provider_response")
    failure = F.lit(None).cast("string")
    for kind in reversed(FAILURES):
        own = kind.replace(".", "_")
        failure = F.when(there(own), F.coalesce(said(own, "message"), said(own, "reason"))).otherwise(failure)
    return folded.select(
        "run_id", "events", F.when(completed, "completed").otherwise("failed").alias("status"),
        at("gate_scored", "tier").alias("tier"), at("gate_scored", "score").cast("double").alias("score"),
        *[at("summary", n).cast(t).alias(n) for n, t in (("input_tokens", "long"), ("output_tokens", "long"), ("cost_usd", "double"))],
        at("provider_response", "latency_ms").cast("double").alias("latency_ms"), "elapsed_ms",
        F.when(ruled, at("rule_corrected", "pass_rate")).otherwise(at("checks", "pass_rate")).cast("double").alias("pass_rate"),
        at("policy", "action").alias("policy_action"),
        F.when(there("result"), F.when(ruled, at("rule_corrected", "mappings")).otherwise(at("result", "mappings"))).alias("mappings_json"),
        F.when(there("checks"), F.when(ruled, at("rule_corrected", "checks")).otherwise(at("checks", "checks"))).alias("checks_json"),
        ruled.cast("int").alias("edited"),
        F.when(ruled & there("result"), at("result", "mappings")).alias("original_mappings_json"),
        F.when(ruled, at("rule_corrected", "changes")).alias("changes_json"),
        at("payload_built", "prompt").alias("prompt"),
        *[at("gate_scored", n).cast("double").alias(n) for n in ("price_in", "price_out", "estimated_cost_usd")],
        *[at("gate_scored", n).cast("long").alias(n) for n in ("input_cap", "output_cap")],
        F.coalesce(failure, said("result", "error")).alias("error"))


def best_runs(runs: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """Per dataset the approved run if there is one, otherwise the latest completed one.

    Spark keeps only the first row of each dataset per task before the shuffle, so a long history is not gathered.
    """
    newest = Window.partitionBy(dataset).orderBy(F.desc(F.coalesce(F.col("decision") == "approved", F.lit(False))), F.desc("id"))
    return runs.filter("status = 'completed'").withColumn("_turn", F.row_number().over(newest)).filter("_turn = 1").drop("_turn")


def run_history(runs: DataFrame) -> DataFrame:
    return runs.orderBy("dataset_id", F.desc("id"))


def dataset_listing(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Datasets, newest first, with the decision of their best run."""
    state = best_runs(runs).select("dataset_id", F.col("decision").alias("mapping"))
    return datasets.join(state, "dataset_id", "left").orderBy(F.desc("dataset_id"))


def valid_attempts(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts within range, and the rejected ones."""
    ok = F.col("pass_rate").between(0, 1) & (F.col("cost_usd") >= 0)
    return attempts.filter(F.coalesce(ok, F.lit(False))), attempts.filter(~F.coalesce(ok, F.lit(False)))


def attempt_history(attempts: DataFrame, block: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """Each attempt with the running spend, best rate and number of attempts of its artifact, and its gain over the
    best earlier attempt (NULL for the first). Without ``block`` long histories are cut by count."""
    told = running(attempts, ["artifact_id"], order or ["attempt_no"], block,
                   sums={"spent_usd": F.col("cost_usd"), "attempts": F.lit(1)}, maxes={"best_pass_rate": F.col("pass_rate")})
    return told.withColumn("gain", F.col("pass_rate") - F.col("best_pass_rate_before")).drop(
        "spent_usd_before", "attempts_before", "best_pass_rate_before")


@dataclass(frozen=True)
class Policy:
    """Limits of the refinement decision. The defaults."""

    tiers: tuple[str, ...] = ("daylight", "horizon", "twilight", "starlight", "aurora")
    target: float = 0.95
    budget: float = 50.0
    max_attempts: int = 4
    min_gain: float = 0.02
    parallel_width: int = 2
    parallel_below: float = 0.5


def decide(history: DataFrame, estimates: dict[str, float], policy: Policy | None = None) -> DataFrame:
    """Add ``action, next_tier, candidates`` to rows ``(tier, attempts, best_pass_rate, spent_usd, gain)``.

    A row says what to do after that attempt; a row with no attempts has ``attempts`` 0. The first rule that applies
    wins. A tier without an estimate gives ``error``.
    """
    p = policy or Policy()
    current = F.coalesce("tier", F.lit(p.tiers[0]))
    higher, estimate = F.lit(None).cast("string"), F.lit(None).cast("double")
    for low, high in zip(p.tiers, p.tiers[1:]):
        higher = F.when(current == low, high).otherwise(higher)
    some = F.col("attempts") > 0
    stalled = F.coalesce(F.col("gain") < p.min_gain, F.lit(False))
    rows = history.withColumn("_stalled", stalled).withColumn("_tier", F.when(stalled, higher).otherwise(current))
    for tier, cost in estimates.items():
        estimate = F.when(F.col("_tier") == tier, F.lit(float(cost))).otherwise(estimate)
    rows = rows.withColumn("_estimate", estimate).withColumn("_left", F.lit(p.budget) - F.col("spent_usd"))
    best = F.col("best_pass_rate")
    wide = (~F.col("_stalled") & some & (best < p.parallel_below) & F.lit(p.parallel_width > 1)
            & (F.col("_estimate") * p.parallel_width <= F.col("_left")))
    action = (
        F.when(some & (best >= p.target), "accept")
        .when(F.col("attempts") >= p.max_attempts, "stop_exhausted")
        .when(F.col("_tier").isNull(), "stop_stalled")
        .when(F.col("_estimate").isNull(), "error")
        .when(F.col("_estimate") > F.col("_left"), "stop_budget")
        .when(wide, "parallel")
        .when(F.col("_stalled"), "escalate")
        .otherwise("refine")
    )
    goes_on = F.col("action").isin("parallel", "escalate", "refine")
    return (
        rows.withColumn("action", action)
        .withColumn("next_tier", F.when(goes_on, F.col("_tier")))
        .withColumn("candidates", F.when(F.col("action") == "parallel", p.parallel_width).when(goes_on, 1).otherwise(0))
        .drop("_stalled", "_tier", "_estimate", "_left")
    )


def trailing_counts(runs: DataFrame, user: str, at: str, hours: int = 24) -> DataFrame:
    """Add ``recent``: runs of the same user in the trailing hours up to each run, itself and simultaneous ones included.

    Each run arrives once and expires once; the count is a running sum over both, in blocks of equal counts, so no
    user's history has to be in one place, not even that of a single hour.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    base = runs.withColumn("_at", micros)
    arrivals = base.withColumn("_step", F.lit(1)).withColumn("_when", F.col("_at") * 2)
    # A run still counts at the end of its hours and no longer just after: it expires between two microseconds.
    expiries = base.withColumn("_step", F.lit(-1)).withColumn("_when", (F.col("_at") + hours * 3_600_000_000) * 2 + 1)
    steps = arrivals.unionByName(expiries)
    counted = running(steps, [user], ["_when"], sums={"recent": F.col("_step")}, through_peers=True)
    return counted.filter("_step = 1").drop("_at", "_step", "_when", "recent_before").withColumn(
        "recent", F.col("recent").cast("long"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two texts ``yyyy-MM-dd HH:mm:ss``; NULL when either does not read."""
    pattern = F.lit("yyyy-MM-dd HH:mm:ss")
    return (F.unix_timestamp(F.try_to_timestamp(end, pattern)) - F.unix_timestamp(F.try_to_timestamp(start, pattern))).cast("double")


def baseline_medians(baselines: DataFrame) -> DataFrame:
    """``(dataset_id, baselines, manual_seconds)``: the exact median of the reported times within range."""
    low, high = BASELINE_SECONDS
    valid = baselines.filter(F.col("seconds").between(low, high))
    stats = order_statistics(valid, ["dataset_id"], "seconds", median_ranks())
    return stats.select("dataset_id", F.col("n").alias("baselines"), median().cast("double").alias("manual_seconds"))


def economy(runs: DataFrame, medians: DataFrame, manual_hours: float = MANUAL_HOURS, rate_usd: float = RATE_USD) -> DataFrame:
    """Time and money of each run against the manual work; savings only for decided runs."""
    review = F.when(F.col("decision") != "pending", elapsed_seconds(F.col("created_at"), F.col("decided_at")))
    joined = runs.filter("elapsed_ms is not null").join(medians, "dataset_id", "left")
    spent_hours = (F.col("ai_seconds") + F.coalesce("review_seconds", F.lit(0.0))) / 3600
    return (
        joined.withColumn("ai_seconds", F.col("elapsed_ms") / 1000)
        .withColumn("review_seconds", review)
        .withColumn("manual_hours", F.coalesce(F.col("manual_seconds") / 3600, F.lit(manual_hours)))
        .withColumn("manual_is_reported", F.col("manual_seconds").isNotNull())
        .withColumn("saving_hours", F.when(F.col("review_seconds").isNotNull(), F.col("manual_hours") - spent_hours))
        .withColumn("saving_usd", F.col("saving_hours") * rate_usd - F.coalesce("cost_usd", F.lit(0.0)))
        .select("dataset_id", "id", "decision", "ai_seconds", "review_seconds", "manual_hours", "manual_is_reported",
                F.coalesce("baselines", F.lit(0)).cast("long").alias("baselines"), "saving_hours", "saving_usd")
    )


def totals_by_agent(events: DataFrame) -> DataFrame:
    """Tokens and cost per agent; an agent with neither usage nor cost has no row."""
    used = events.filter(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull() | F.col("cost_usd").isNotNull())
    return used.groupBy("agent").agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("cost_usd"))


def compression_gate(pairs: DataFrame) -> DataFrame:
    """Add ``applied, tokens_after, tokens_saved, savings_ratio`` to ``(before, after)``; refused compressions
    leave the tokens as they were."""
    from plumbline.functions.spending import compression_pays

    applied = compression_pays(F.col("before"), F.col("after"))
    kept = F.when(F.col("applied"), F.col("after")).otherwise(F.col("before"))
    saved = F.greatest(F.lit(0), F.col("before") - F.col("tokens_after"))
    return (pairs.withColumn("applied", applied).withColumn("tokens_after", kept).withColumn("tokens_saved", saved)
            .withColumn("savings_ratio", F.when(F.col("before") != 0, F.col("tokens_saved") / F.col("before")).otherwise(F.lit(0.0))))
