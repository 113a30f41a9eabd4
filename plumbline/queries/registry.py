"""The registered queries: each runs an operator over whole tables, most beside an independent SQL formulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        QUERIES[name] = configured
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a table kept in fewer files than there are cores before work that is heavy per row, unless its files are
    read in parts that keep every core busy: rows that stand together then stay together, which counts of values gain by."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores or read_evenly(df, cores) else df.repartition(cores)


def read_evenly(df: DataFrame, cores: int) -> bool:
    """Whether no part of a table, as it is read, holds more than its share of the rows and a half. Rows are counted by
    the files' own figures; one row a part reaches the driver's aggregate."""
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    rows, largest = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return 2 * largest * cores <= 3 * rows
