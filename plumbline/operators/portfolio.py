"""Views across datasets and across repeated measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import types as Y
from plumbline.operators.cells import quoted
from plumbline.operators.ordered import median, median_ranks, nearest_rank, order_statistics, same_key


def _named_columns(columns: DataFrame) -> DataFrame:
    """One row per name and dataset, so a name that every dataset uses stays small before it is shuffled."""
    keyed = columns.withColumn("name_key", N.name_key(F.col("name")))
    return keyed.groupBy("name_key", "dataset").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.max("is_key_candidate").alias("is_key"))


def shared_columns(columns: DataFrame) -> DataFrame:
    """Column names that occur in two datasets or more: ``shared`` when all measured one type, else ``conflict``.

    ``(name_key, n_datasets, n_keys, types, relation)``; ``shared_column_datasets`` lists the datasets, one per row.
    """
    groups = _named_columns(columns).groupBy("name_key").agg(
        F.count("*").alias("n_datasets"), F.count_if("is_key").alias("n_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"))
    return groups.filter("n_datasets >= 2").withColumn(
        "relation", F.when(F.size("types") > 1, "conflict").otherwise("shared"))


def shared_column_datasets(columns: DataFrame) -> DataFrame:
    """``(name_key, dataset, types, is_key)`` for every dataset that shares a column name with another."""
    named = _named_columns(columns)
    shared = named.groupBy("name_key").agg(F.count("*").alias("n")).filter("n >= 2").select("name_key")
    return named.join(shared, "name_key", "left_semi")


def flag_frequency(flags: DataFrame) -> DataFrame:
    return flags.groupBy("kind").agg(F.count("*").alias("datasets")).orderBy(F.desc("datasets"), "kind")


def decision_states(datasets: DataFrame, best: DataFrame) -> DataFrame:
    """Datasets per state of their best run; ``none`` where no run completed."""
    states = datasets.select("dataset_id").join(best.select("dataset_id", "decision"), "dataset_id", "left")
    return states.groupBy(F.coalesce("decision", F.lit("none")).alias("state")).agg(F.count("*").alias("datasets"))


def portfolio_totals(totals: DataFrame) -> DataFrame:
    """Totals per dataset and, in the row without a dataset, over all of them."""
    return totals.rollup("dataset").agg(
        F.sum("rows").alias("rows"), F.sum("columns").alias("columns"), F.sum("total_cells").alias("total_cells"),
        F.sum("empty_cells").alias("empty_cells"), F.sum("duplicate_rows").alias("duplicate_rows"))


def portfolio_figures(datasets: DataFrame, flags: DataFrame, runs: DataFrame, hints: DataFrame) -> DataFrame:
    """One row over a portfolio: ``datasets, rows, columns, bytes, alerts_total, hints_total, runs_total, cost_total``.

    ``datasets`` holds ``(dataset, rows, columns, bytes)``, ``flags`` a row per alert, ``runs`` every run, best or not,
    with its ``cost_usd``, and ``hints`` a row per column whose name suggests personal data.
    """
    def of(df: DataFrame, **figures: Column) -> DataFrame:
        return df.agg(*[c.alias(n) for n, c in figures.items()]).withColumn("_one", F.lit(1))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("long")

    cost = F.coalesce(F.sum(F.coalesce("cost_usd", F.lit(0)).cast("decimal(28,8)")), F.lit(0)).cast("double")
    parts = [of(datasets, datasets=F.count("*"), rows=total("rows"), columns=total("columns"), bytes=total("bytes")),
             of(flags, alerts_total=F.count("*")), of(hints, hints_total=F.count("*")), of(runs, runs_total=F.count("*"), cost_total=cost)]
    # One row each.
    return reduce(lambda a, b: a.join(b, "_one"), parts).drop("_one")


def economy_totals(economies: DataFrame) -> DataFrame:
    """Savings over decided runs, and the part that rests on a reported baseline."""
    decided = F.col("saving_hours").isNotNull()
    reported = decided & F.col("manual_is_reported")

    def exact(value: Column) -> Column:
        return F.coalesce(F.sum(value.cast("decimal(28,8)")), F.lit(0)).cast("double")

    return economies.agg(
        F.count_if(decided).alias("decided"), F.count_if(reported).alias("with_baseline"),
        exact(F.when(decided, F.col("saving_hours"))).alias("saving_hours"),
        exact(F.when(reported, F.col("saving_hours"))).alias("saving_hours_reported"),
        exact(F.when(decided, F.col("saving_usd"))).alias("saving_usd"),
        (exact(F.when(decided, F.col("review_seconds"))) / 60).alias("review_minutes"),
        exact(F.col("ai_seconds")).alias("ai_seconds"))


def timing_stats(measurements: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(*keys, n, median, p95, max, mean)``: exact, the percentile by nearest rank."""
    stats = order_statistics(measurements, keys, value, {**median_ranks(), "p95": nearest_rank(0.95)})
    # Sums of decimals do not depend on the order in which tasks finish.
    means = measurements.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.sum(F.col(value).cast("decimal(28,8)")).alias("_sum"))
    return stats.alias("s").join(means.alias("m"), same_key(keys, "s", "m")).select(
        *[f"s.{quoted(k)}" for k in keys], "n", median().cast("double").alias("median"), F.col("p95").cast("double").alias("p95"),
        F.col("highest").cast("double").alias("max"), (F.col("_sum").cast("double") / F.col("n")).alias("mean"))


def _in_family(kind: Column, suggested: Column) -> Column:
    agrees = F.lit(False)
    for measured, targets in Y.FAMILIES.items():
        agrees = F.when(kind == measured, F.coalesce(suggested.isin(*targets), F.lit(False))).otherwise(agrees)
    return agrees


def type_agreement(answers: DataFrame) -> DataFrame:
    """Per run the share of columns whose suggested type is of the measured family, with the renames needed and done.

    ``answers`` holds ``(dataset, rep, column, type, target, suggested)``.
    """
    needed = ~F.col("column").rlike(N.TARGET_NAME)
    done = needed & (F.coalesce("target", F.lit("")) != F.col("column")) & F.coalesce(F.col("target").rlike(N.TARGET_NAME), F.lit(False))
    return answers.groupBy("dataset", "rep").agg(
        F.count("*").alias("columns"),
        F.count_if(_in_family(F.col("type"), F.col("suggested"))).alias("agreeing"),
        F.count_if(needed).alias("renames_needed"), F.count_if(done).alias("renames_done"),
    ).withColumn("agreement", F.col("agreeing") / F.col("columns"))


def type_disagreements(answers: DataFrame) -> DataFrame:
    change = F.concat("type", F.lit(" → "), F.coalesce("suggested", F.lit("None")))
    rows = answers.filter(~_in_family(F.col("type"), F.col("suggested")))
    return rows.groupBy("dataset", "column", change.alias("change")).agg(F.count("*").alias("times"))


def stable_columns(answers: DataFrame) -> DataFrame:
    """Per dataset the columns that got one and the same answer in every repetition."""
    per_column = answers.groupBy("dataset", "column").agg(
        F.countDistinct(F.struct("target", "suggested")).alias("answers"))
    return per_column.groupBy("dataset").agg(
        F.count("*").alias("columns"), F.count_if(F.col("answers") == 1).alias("stable"))


def failed_checks(checks: DataFrame) -> DataFrame:
    """How often each check failed per dataset and the first offender of the first failure.

    ``checks`` holds ``(dataset, seq, name, status, offenders)``.
    """
    failed = checks.filter("status = 'failed'")
    first = F.coalesce(F.try_element_at("offenders", F.lit(1)), F.lit(""))
    return failed.groupBy("dataset", F.col("name").alias("check")).agg(
        F.count("*").alias("times"), F.min_by(first, F.col("seq")).alias("example")
    ).orderBy(F.desc("times"), "dataset", "check")


def overflow_findings(failures: DataFrame) -> DataFrame:
    """Failures whose example reads as a value too large for its suggested type, most frequent first."""
    pattern = r"^(\w+): (\w+), valores até ([0-9]+) não cabem"
    found = failures.filter((F.col("check") == "type_fits_data") & F.col("example").rlike(pattern))
    return found.select(
        "dataset", F.regexp_extract("example", pattern, 1).alias("column"),
        F.upper(F.regexp_extract("example", pattern, 2)).alias("suggested"),
        F.regexp_extract("example", pattern, 3).try_cast("decimal(38,0)").cast("string").alias("max"), "times",
    ).orderBy(F.desc("times"), "dataset", "column")


def detection_score(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many expected ``keys`` were found, how many missed, and how many were not expected."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    f = found.select(*keys).distinct().withColumn("_f", F.lit(1))
    both = e.join(f, keys, "full_outer")
    return both.agg(
        F.count("_e").alias("expected"),
        F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull()).alias("detected"),
        F.count_if(F.col("_f").isNull()).alias("missed"),
        F.count_if(F.col("_e").isNull()).alias("unexpected"))
