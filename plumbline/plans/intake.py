"""From a file or table to its profile, flags and quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import flags as G
from plumbline.operators import profile as P
from plumbline.sources import delimited as D


@dataclass(frozen=True)
class Intake:
    """The rows as text under their own names, and everything measured about them."""

    rows: DataFrame
    columns: DataFrame
    totals: DataFrame
    flags: DataFrame
    quality: DataFrame
    layout: D.Layout | None = None


def profile_table(df: DataFrame, dataset: str, distinct_limit: int | None = None, discarded: int = 0,
                  malformed: DataFrame | None = None, encoding: str = "utf-8", names: list[str] | None = None) -> Intake:
    """Profile a table. ``names`` are the real column names when ``df`` carries positional ones."""
    named = df.toDF(*names) if names else df
    columns = P.profile(named, dataset, distinct_limit)
    duplicates = P.duplicate_rows({dataset: df})
    totals = P.dataset_totals(columns, duplicates, F.lit(discarded))
    identical = G.identical_columns(df, columns)
    encodings = df.sparkSession.createDataFrame([(dataset, encoding)], "dataset string, encoding string")
    raised = G.flags(columns, totals, identical, malformed, encodings)
    return Intake(named, columns, totals, raised, G.quality(columns, totals))


def profile_file(spark: SparkSession, path: str, dataset: str, distinct_limit: int | None = None) -> Intake:
    """Profile one delimited file. Malformed rows are set aside, counted and listed by line."""
    found = D.layout(spark, path)
    good, bad = D.split_malformed(D.read_delimited(spark, path, found), found)
    discarded = bad.count()
    lines = None
    if discarded:
        numbered = D.malformed_lines(spark, path, found)
        lines = numbered.select(F.lit(dataset).alias("dataset"), F.col("line").alias("p"),
                                F.concat(F.lit("linha "), F.col("line").cast("string")).alias("item"))
    intake = profile_table(good, dataset, distinct_limit, discarded, lines, found.encoding, list(found.header))
    return Intake(intake.rows, intake.columns, intake.totals, intake.flags, intake.quality, found)
