"""Catalogs against the files that were delivered for them: find, read, measure, compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.evidence import loaded_stats, runtime_checks
from plumbline.sources.catalogs import csv_presence
from plumbline.sources.delimited import layout, read_delimited, split_malformed

_NO_FILES = "database string, table_name string, rows_loaded long, digest string, null_cells long, nulls array<struct<column:string,n:bigint>>"


def check_delivered(source: DataFrame, target: DataFrame, root: str) -> DataFrame:
    """Each table of the source catalog as it was delivered under ``<root>/<database>/<table>.csv``, against the row
    counts of both catalogs. Tables without a file are skipped; malformed rows are not loaded.

    Only names and paths of tables reach the driver; every file is read once for its layout and once for its measures.
    """
    spark = source.sparkSession
    found = csv_presence(source, root).filter("found").orderBy("database", "table_name").collect()
    measured = []
    for r in found:
        own = layout(spark, r["path"])
        good, _ = split_malformed(read_delimited(spark, r["path"], own), own)
        # Cells were read under positional names.
        names = F.array(*[F.lit(name) for name in own.header])
        nulls = F.transform("nulls", lambda e, i: F.struct(F.get(names, i).alias("column"), e["n"].alias("n")))  # noqa: B023
        measured.append(loaded_stats(good, r["table_name"], r["database"]).withColumn("nulls", nulls))
    loaded = reduce(DataFrame.unionByName, measured) if measured else spark.createDataFrame([], _NO_FILES)
    return runtime_checks(source, target, loaded)
