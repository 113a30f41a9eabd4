"""Ordered results that stay spread out when one key holds much of the data.

A window partitioned by key alone puts a whole key into one task. Here each key is cut into blocks along its order,
blocks are summarised on the map side, and only block totals are carried forward.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.cells import quoted
from plumbline.session import fresh_path


def same_key(keys: list[str], left: str, right: str) -> Column:
    """Whether the keys of two aliased tables are equal, NULL being a key like any other."""
    return reduce(and_, [F.col(f"{left}.{quoted(k)}").eqNullSafe(F.col(f"{right}.{quoted(k)}")) for k in keys], F.lit(True))


def blocks_by_count(df: DataFrame, keys: list[str], order: list[str], name: str = "_block", blocks: int | None = None) -> DataFrame:
    """The table with a block number that never falls along the order of a key, in blocks of about equal numbers of rows.

    Splitters come from a sample of all rows, so a key that fills a third of the table is cut into a third of the
    blocks, however close together its rows lie. Rows equal in key and order share a block. Without ``blocks`` there
    are as many as shuffle partitions, small ones put together. Written once to the shared folder, so that every
    reader sees the same cuts.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "blocks")
    places = [F.col(quoted(c)) for c in (*keys, *order)]
    cut = df.repartitionByRange(*places) if blocks is None else df.repartitionByRange(blocks, *places)
    cut.withColumn(name, F.spark_partition_id().cast("long")).write.parquet(path)
    return spark.read.parquet(path)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | None = None,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    through_peers: bool = False,
) -> DataFrame:
    """Add running sums and maxima per key, up to and including each row, and ``<name>_before`` without the row.

    ``block`` must never decrease along ``order`` within a key, and rows equal in ``order`` must share a block; without
    it blocks are cut by count. With ``through_peers`` rows equal in ``order`` see each other. NULL is a key of its own.
    """
    sums, maxes = sums or {}, maxes or {}
    if block is None:
        columns = df.columns
        cut = blocks_by_count(df, keys, order, "_cut")
        return running(cut, keys, order, F.col("_cut"), sums, maxes, through_peers).select(
            *[quoted(c) for c in columns], *[f"{n}{end}" for n in (*sums, *maxes) for end in ("", "_before")])
    rows = df.select("*", block.alias("_block"), *[c.alias(f"_in_{n}") for n, c in {**sums, **maxes}.items()])
    totals = rows.groupBy(*keys, "_block").agg(
        *[F.sum(f"_in_{n}").alias(f"_total_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_total_{n}") for n in maxes],
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_block",
        *[F.sum(f"_total_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
        *[F.max(f"_total_{n}").over(earlier).alias(f"_carry_{n}") for n in maxes],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto = inside.rangeBetween(Window.unboundedPreceding, 0) if through_peers and len(order) == 1 else (
        inside.rowsBetween(Window.unboundedPreceding, 0))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.toDF(*[f"_of_{i}" for i in range(len(keys))], "_of_block", *carried.columns[len(keys) + 1:])
    same = F.col("_block").eqNullSafe(F.col("_of_block"))
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{i}"))
    joined = rows.join(carried, same)
    columns = []
    for name in sums:
        value, carry = F.col(f"_in_{name}"), F.coalesce(F.col(f"_carry_{name}"), F.lit(0))
        columns += [(F.coalesce(F.sum(value).over(upto), F.lit(0)) + carry).alias(name),
                    (F.coalesce(F.sum(value).over(before), F.lit(0)) + carry).alias(f"{name}_before")]
    for name in maxes:
        value, carry = F.col(f"_in_{name}"), F.col(f"_carry_{name}")
        columns += [F.greatest(F.max(value).over(upto), carry).alias(name),
                    F.greatest(F.max(value).over(before), carry).alias(f"{name}_before")]
    return joined.select(*df.columns, *columns)


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact values at 0-based ranks of each key's sorted values, without sorting any key as a whole.

    ``ranks`` gives each result a rank as an expression over ``n``, the number of values of the key. Values are
    counted on the map side and cut into blocks of equally many distinct values along key and value, so neither a hot
    key nor an outlier fills a task; only blocks that hold a rank are looked at again. NULL is a key of its own.
    Returns ``(*keys, n, lowest, highest, *ranks)``.
    """
    values = df.filter(F.col(quoted(value)).isNotNull()).select(*[quoted(k) for k in keys], F.col(quoted(value)).alias("_value"))
    cut = blocks_by_count(values.groupBy(*[quoted(k) for k in keys], "_value").agg(F.count("*").alias("_times")), keys, ["_value"])
    # One row for each key, and one more for each block that a key goes on in.
    blocks = cut.groupBy(*[quoted(k) for k in keys], "_block").agg(
        F.sum("_times").alias("_size"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    whole = Window.partitionBy(*[quoted(k) for k in keys])
    below = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    told = blocks.select("*", F.sum("_size").over(whole).alias("n"), F.min("_low").over(whole).alias("lowest"),
                         F.max("_high").over(whole).alias("highest"), F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_below"))
    names = list(ranks)
    inside = told.select("*", *[(ranks[n].cast("long") - F.col("_below")).alias(f"_rank_{i}") for i, n in enumerate(names)])
    held = [(F.col(f"_rank_{i}") >= 0) & (F.col(f"_rank_{i}") < F.col("_size")) for i in range(len(names))]
    wanted = inside.filter(reduce(or_, held)).select(
        *[quoted(k) for k in keys], "_block", "n", "lowest", "highest", *[f"_rank_{i}" for i in range(len(names))])
    rows = cut.alias("c").join(wanted.alias("w"), same_key([*keys, "_block"], "c", "w")).select("c.*", *[
        f"w.{c}" for c in ("n", "lowest", "highest", *[f"_rank_{i}" for i in range(len(names))])])
    within = Window.partitionBy(*[quoted(k) for k in keys], "_block").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_through", F.sum("_times").over(within))
    hit = [(F.col(f"_rank_{i}") >= F.col("_through") - F.col("_times")) & (F.col(f"_rank_{i}") < F.col("_through")) for i in range(len(names))]
    return ranked.groupBy(*[quoted(k) for k in keys]).agg(
        F.max("n").alias("n"), F.max("lowest").alias("lowest"), F.max("highest").alias("highest"),
        *[F.max(F.when(hit[i], F.col("_value"))).alias(n) for i, n in enumerate(names)])


def nearest_rank(share: float) -> Column:
    """The rank of a percentile: the nearest position, halves to the even one, never past the last."""
    return F.least(F.col("n") - 1, F.bround(F.lit(share) * (F.col("n") - 1), 0).cast("long"))


def median_ranks() -> dict[str, Column]:
    return {"lower": F.floor((F.col("n") - 1) / 2), "upper": F.ceil((F.col("n") - 1) / 2)}


def median() -> Column:
    return (F.col("lower") + F.col("upper")) / 2
