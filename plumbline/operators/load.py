"""The typed load: projection to approved types, the lost-value guard, the count gate and the guarded write."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import types as Y
from plumbline.functions import values as V
from plumbline.operators.cells import quoted
from plumbline.session import create_only, folders, remove_folder


@dataclass(frozen=True)
class ColumnPlan:
    """One column of a load: where it comes from, its target name and Spark type, and what was measured."""

    source: str
    target: str
    kind: str
    spark_type: str
    measured: dict[str, Any]


class LoadRefused(ValueError):
    """The load must not write: values would be lost, counts differ, or the target already holds data."""


def plan_columns(profile: DataFrame, mapping: DataFrame) -> list[ColumnPlan]:
    """The load plan of one dataset, in source order: one small row per column. Refuses anything unsafe."""
    wanted = mapping.select(F.col("source").alias("name"), "target", F.col("type").alias("kind"))
    typed = profile.join(F.broadcast(wanted), "name", "left").withColumn(
        "spark_type", Y.spark_type(F.col("kind"), F.col("max_int_digits"), F.col("max_scale")))
    plans, seen = [], {}
    for row in sorted(typed.collect(), key=lambda r: r["position"]):
        name, target, kind = row["name"], row["target"], row["kind"]
        if target is None or kind is None:
            raise ValueError(f"column {name!r} has no target and type in the approved mapping")
        if target != N.check_identifier(target, f"target of {name!r}").lower():
            raise ValueError(f"unsafe target name for {name!r}: {target!r}")
        if kind not in Y.TARGET_TYPES:
            raise ValueError(f"unsupported type for {name!r}: {kind!r}")
        if target in seen:
            raise ValueError(f"repeated target {target!r}: {seen[target]!r} and {name!r}")
        seen[target] = name
        plans.append(ColumnPlan(name, target, kind, row["spark_type"], row.asDict()))
    return plans


def source_formats(profile: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(dataset, formats)``: per dataset the measured source formats by column, for the load to read with."""
    j = profile.join(mapping.select("dataset", F.col("source").alias("name"), F.col("type").alias("kind")), ["dataset", "name"])
    date = F.when(F.col("kind").isin("date", "timestamp"), F.col("date_format"))
    brazilian = F.col("kind").isin(*Y.NUMERIC_TARGETS) & (F.col("number_style") == "br")
    fmt = F.coalesce(date, F.when(brazilian, "br"))
    return j.select("dataset", "name", fmt.alias("format")).filter(F.col("format").isNotNull()).groupBy("dataset").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "format")))).alias("formats"))


def converted(plan: ColumnPlan) -> Column:
    """The source cell in its approved type; NULL when it does not convert."""
    text = V.trimmed(F.col(quoted(plan.source)))
    pattern = plan.measured.get("date_format")
    if plan.measured.get("number_style") == "br" and plan.kind != "string":
        text = V.from_brazilian(text)
    if plan.kind == "date" and pattern:
        return F.try_to_date(text, pattern)
    if plan.kind == "timestamp" and pattern:
        return F.try_to_timestamp(text, F.lit(pattern))
    if plan.kind == "boolean":
        # A cast would also accept yes, no, 1 and 0, which were measured as text and numbers.
        return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")
    return text.try_cast(plan.spark_type)


def typed_projection(raw: DataFrame, plans: list[ColumnPlan]) -> DataFrame:
    return raw.select(*[converted(p).alias(p.target) for p in plans])


def _lost_and_rows(raw: DataFrame, plans: list[ColumnPlan]) -> DataFrame:
    """One row: the number of rows and, per column, of cells that hold something and convert to nothing."""
    return raw.agg(F.count("*").alias("rows"), *[
        F.count_if(V.trimmed(F.col(quoted(p.source))).isNotNull() & converted(p).isNull()).alias(f"c{i}")
        for i, p in enumerate(plans)])


def lost_values(raw: DataFrame, plans: list[ColumnPlan]) -> DataFrame:
    """``(target, lost)``: per column, cells that hold something and convert to nothing. One pass for all columns."""
    return _lost_and_rows(raw, plans).select(F.explode(F.array(*[
        F.struct(F.lit(p.target).alias("target"), F.col(f"c{i}").alias("lost")) for i, p in enumerate(plans)])).alias("r")
    ).select("r.*")


def rounded_values(raw: DataFrame, plans: list[ColumnPlan]) -> DataFrame:
    """``(target, rounded)``: values a decimal target keeps only rounded, which no NULL gives away."""
    decimals = [p for p in plans if p.kind == "decimal"]
    if not decimals:
        return raw.sparkSession.createDataFrame([], "target string, rounded long")
    checks = []
    for i, p in enumerate(decimals):
        text = V.trimmed(F.col(quoted(p.source)))
        text = V.from_brazilian(text) if p.measured.get("number_style") == "br" else text
        # The exponent is ignored, as in the measured scale.
        checks.append(F.count_if(V.fraction_digits(text) > int(p.measured.get("max_scale") or 10)).alias(f"c{i}"))
    return raw.agg(*checks).select(F.explode(F.array(*[
        F.struct(F.lit(p.target).alias("target"), F.col(f"c{i}").alias("rounded")) for i, p in enumerate(decimals)
    ])).alias("r")).select("r.*")


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a parquet table exists at ``path`` and holds a row."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def load_table(raw: DataFrame, plans: list[ColumnPlan], path: str, expected_rows: int, drop_duplicates: bool = False) -> None:
    """Write the typed rows as the parquet table at ``path``, or refuse and leave it as it was.

    The source is read once: rows and lost values are counted while the typed rows go to a folder beside the target,
    and only when everything agrees is that folder published. Of two loads that race for one target one is refused.
    """
    spark = raw.sparkSession
    N.check_path(path)
    if has_rows(spark, path):
        raise LoadRefused(f"{path} already holds data; nothing was written")
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    filled = [V.trimmed(F.col(quoted(p.source))).isNotNull() for p in plans]
    marked = raw.select(*[converted(p).alias(f"_v{i}") for i, p in enumerate(plans)], *[f.alias(f"_f{i}") for i, f in enumerate(filled)])
    seen = Observation()
    watched = marked.observe(seen, F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col(f"_f{i}") & F.col(f"_v{i}").isNull()).alias(f"c{i}") for i in range(len(plans))])
    out = watched.select(*[F.col(f"_v{i}").alias(p.target) for i, p in enumerate(plans)])
    try:
        (out.dropDuplicates() if drop_duplicates else out).write.parquet(staging)
        measured = seen.get
        lost = {p.target: measured[f"c{i}"] for i, p in enumerate(plans) if measured.get(f"c{i}")}
        if lost:
            raise LoadRefused(f"the conversion loses values (column: rows): {lost}")
        # From the footers of what was written.
        rows = spark.read.schema(out.schema).parquet(staging).count()
        if rows != expected_rows:
            raise LoadRefused(f"{rows} rows to load, {expected_rows} measured on the source")
        publish(spark, staging, path)
    finally:
        remove_folder(spark, staging)


def publish(spark: SparkSession, staging: str, path: str) -> None:
    """Make a finished folder the table at ``path``, unless another load holds the target or has filled it.

    A claim file, which only one load can create, guards the step; a load that died while publishing leaves it
    behind, and the message names it. A new table appears by one rename; into an empty table its files are moved.
    """
    files, place, claim = folders(spark, path, path.rstrip("/") + "__loading")
    if not create_only(files, claim):
        raise LoadRefused(f"another load is publishing {path} ({claim}); nothing was written")
    try:
        if has_rows(spark, path):
            raise LoadRefused(f"{path} already holds data; nothing was written")
        source = folders(spark, staging)[1]
        if not files.exists(place):
            moved = files.rename(source, place)
        else:
            parts = [f.getPath() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")]
            moved = all([files.rename(p, files.makeQualified(place).suffix("/" + p.getName())) for p in parts])
        if not moved:
            raise LoadRefused(f"{staging} could not be moved to {path}")
    finally:
        files.delete(claim, False)
