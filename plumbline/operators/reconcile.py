"""Reconciliation: what was measured on the source against what the target holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import types as Y
from plumbline.functions import values as V
from plumbline.operators.cells import cells, quoted, row_key, tagged_text
from plumbline.operators.load import ColumnPlan
from plumbline.operators.profile import LONG_TEXT

CHECK_SCHEMA = "ordinal int, verificacao string, esperado string, obtido string, status string"


def _as_text(column: Column, kind: str) -> Column:
    """Numbers without needless zeros, whatever their size; NaN and infinity as they are."""
    text = column.cast("string")
    if kind in Y.NUMERIC_TARGETS:
        return F.when(text.rlike(V.DECIMAL_US), V.number_text(V.ordered_number(text))).otherwise(text)
    return text


def expected_checks(plans: list[ColumnPlan], rows: int, duplicate_rows: int = 0, drop_duplicates: bool = False) -> list[tuple]:
    """``(ordinal, name, key, expected, compare)`` per check, in source order. ``key`` names the measured target value,
    ``compare`` how the two are held against each other: as exact numbers, as doubles or as text."""
    checks = [("linhas", "rows", str(rows - (duplicate_rows if drop_duplicates else 0)), "number")]
    for i, plan in enumerate(plans):
        m = plan.measured
        if not drop_duplicates:
            checks.append((f"nulos({plan.target})", f"nulls{i}", str(m["nulls"]), "number"))
            if m["distinct"] is not None:
                checks.append((f"distintos({plan.target})", f"distinct{i}", str(m["distinct"]), "number"))
        ranged = plan.kind in Y.NUMERIC_TARGETS or plan.kind == "date"
        if ranged and m["min"] is not None:
            compare = "text" if plan.kind == "date" else "double" if plan.kind == "double" else "number"
            checks.append((f"min({plan.target})", f"min{i}", m["min"], compare))
            checks.append((f"max({plan.target})", f"max{i}", m["max"], compare))
        elif plan.kind == "string" and m["max_len"]:
            checks.append((f"tamanho_max({plan.target})", f"length{i}", str(m["max_len"]), "number"))
    return [(n, *check) for n, check in enumerate(checks)]


def target_measures(target: DataFrame, plans: list[ColumnPlan], with_distinct: bool = True) -> DataFrame:
    """``(key, obtido)``: every measure of the loaded table, from one aggregate and one count of distinct cells."""
    columns = [F.col(quoted(p.target)) for p in plans]
    measures = [("rows", F.count("*").cast("string"))]
    for i, (plan, column) in enumerate(zip(plans, columns)):
        measures.append((f"nulls{i}", F.count_if(column.isNull()).cast("string")))
        if plan.kind in Y.NUMERIC_TARGETS or plan.kind == "date":
            measures.append((f"min{i}", _as_text(F.min(column), plan.kind)))
            measures.append((f"max{i}", _as_text(F.max(column), plan.kind)))
        elif plan.kind == "string":
            measures.append((f"length{i}", F.coalesce(F.max(F.length(column)), F.lit(0)).cast("string")))
    one = target.agg(*[m.alias(f"m{n}") for n, (_, m) in enumerate(measures)])
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(key).alias("key"), F.col(f"m{n}").alias("obtido")) for n, (key, _) in enumerate(measures)
    ])).alias("m")).select("m.*")
    if not with_distinct:
        return rows
    # Long cells travel as digests.
    cell = F.col("cell")
    short = F.when(F.octet_length(cell) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(cell, 256))).otherwise(cell)
    distinct = cells(target.select(*columns)).groupBy("position").agg(F.countDistinct(short).alias("n"))
    return rows.unionByName(distinct.select(F.concat(F.lit("distinct"), "position").alias("key"),
                                            F.col("n").cast("string").alias("obtido")))


def reconcile(target: DataFrame, plans: list[ColumnPlan], rows: int, duplicate_rows: int = 0,
              drop_duplicates: bool = False) -> DataFrame:
    """``(ordinal, verificacao, esperado, obtido, status)`` with status OK or DIVERGE, in source order.

    With ``drop_duplicates`` null and distinct counts are left out: the removed rows changed them.
    """
    expected = expected_checks(plans, rows, duplicate_rows, drop_duplicates)
    wanted = target.sparkSession.createDataFrame(
        expected, "ordinal int, verificacao string, key string, esperado string, compare string").coalesce(1)
    measured = target_measures(target, plans, with_distinct=not drop_duplicates)
    left, right = F.col("esperado"), F.coalesce("obtido", F.when(F.startswith("key", F.lit("distinct")), F.lit("0")))
    # A double holds the nearest number to the source's; every other number must be the same to its last digit.
    equal = F.when(F.col("compare") == "number", V.ordered_number(left) == V.ordered_number(right)).when(
        F.col("compare") == "double", left.try_cast("double") == right.try_cast("double")).otherwise(left == right)
    return measured.join(F.broadcast(wanted), "key", "right").select(
        "ordinal", "verificacao", "esperado", right.alias("obtido"),
        F.when(equal, "OK").otherwise("DIVERGE").alias("status"))


def row_digest(columns: list[Column]) -> Column:
    """60 bits of the MD5 of a row. Cells carry their length and NULL a mark of its own, so text can't move between cells."""
    return F.conv(F.substring(F.md5(tagged_text(columns)), 1, 15), 16, 10).cast("decimal(20,0)")


def content_digest(df: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """``(rows, digest)`` whatever the row order. Sums, not XOR, so a duplicated row does not cancel itself."""
    chosen = [F.col(quoted(c)) for c in df.columns] if columns is None else columns
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_digest(chosen)), F.lit(0)).cast("string").alias("digest"))


def compare_tables(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: rows and digests of both sides, and whether they match."""
    sides = content_digest(source).withColumn("side", F.lit("source")).unionByName(
        content_digest(target).withColumn("side", F.lit("target")))
    both = sides.agg(*[
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}") for side in ("source", "target") for c in ("rows", "digest")])
    same = (F.col("source_rows") == F.col("target_rows")) & (F.col("source_digest") == F.col("target_digest"))
    return both.withColumn("status", F.when(same, "passed").otherwise("failed"))


def keyed_differences(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, column, source, target)``: every cell behind a divergence.

    Keys and row digests of both sides meet in one exchange; whole rows are only fetched for keys that differ. NULL is
    a key like any other. A key that stands in several rows of a side is reported once, as ``(repeated key)`` with the
    numbers of rows, when the rows of the two sides differ.
    """
    others = [c for c in source.columns if c not in keys]

    def marked(df: DataFrame, side: int, value: Column) -> DataFrame:
        return df.select(*keys, value.alias("_value"), F.lit(side).alias("_side"))

    def both_sides(value: Column) -> DataFrame:
        return marked(source, 1, value).unionByName(marked(target, 0, value))

    def on(side: int, value: Column) -> Column:
        return F.when(F.col("_side") == side, value)

    digest = F.xxhash64("_value").cast("decimal(38,0)")
    counted = both_sides(row_key([F.col(quoted(c)) for c in others])).groupBy(*keys).agg(
        F.count(on(1, F.lit(1))).alias("_n1"), F.count(on(0, F.lit(1))).alias("_n0"),
        F.sum(on(1, digest)).alias("_d1"), F.sum(on(0, digest)).alias("_d0"))
    differing = counted.filter((F.col("_n1") != F.col("_n0")) | ~F.col("_d1").eqNullSafe(F.col("_d0")))
    repeated = (F.col("_n1") > 1) | (F.col("_n0") > 1)
    wanted = differing.filter(~repeated).select(*[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(quoted(k)).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    cells_of = F.struct(*[F.col(quoted(c)).cast("string").alias(c) for c in others], F.lit(0).alias("_there"))
    both = both_sides(cells_of).join(wanted, same, "left_semi").groupBy(*keys).agg(
        F.max(on(1, F.col("_value"))).alias("_s"), F.max(on(0, F.col("_value"))).alias("_t"))
    missing, extra = F.col("_t").isNull(), F.col("_s").isNull()
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"_s.{quoted(c)}").eqNullSafe(F.col(f"_t.{quoted(c)}")),
               F.struct(F.lit(c).alias("column"), F.col(f"_s.{quoted(c)}").alias("source"), F.col(f"_t.{quoted(c)}").alias("target")))
        for c in others]))
    whole = F.array(F.struct(F.lit("(row)").alias("column"), F.when(~extra, "present").alias("source"),
                             F.when(~missing, "present").alias("target")))
    cells_found = both.select(*keys, F.explode(F.when(missing | extra, whole).otherwise(changed)).alias("d")).select(*keys, "d.*")
    return cells_found.unionByName(differing.filter(repeated).select(
        *keys, F.lit("(repeated key)").alias("column"), F.col("_n1").cast("string").alias("source"), F.col("_n0").cast("string").alias("target")))


LEAVES, FAN = 4096, 16


def digest_tree(df: DataFrame, keys: list[str], leaves: int = LEAVES) -> DataFrame:
    """``(level, node, rows, digest)``: digests of ranges of hashed keys, summed upward to one root at level 0.

    A node's digest is the sum of its children's, and every level is made from the leaves alone, ``leaves`` rows of
    them whatever the size of the table.
    """
    told = df.select(_leaf(keys, leaves).alias("node"), row_digest([F.col(quoted(c)) for c in df.columns]).alias("d"))
    level, width = 0, leaves
    while width > 1:
        level, width = level + 1, -(-width // FAN)
    rows = told.groupBy("node").agg(F.count("*").alias("rows"), F.sum("d").alias("digest")).withColumn("level", F.lit(level))
    steps = F.explode(F.array(*[F.struct(F.lit(level - i).alias("level"), F.floor(F.col("node") / FAN**i).cast("long").alias("node")) for i in range(level + 1)]))
    return rows.select(steps.alias("at"), "rows", "digest").groupBy("at.level", "at.node").agg(
        F.sum("rows").alias("rows"), F.sum("digest").cast("decimal(38,0)").alias("digest"))


def _leaf(keys: list[str], leaves: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(quoted(k)) for k in keys]), F.lit(leaves)).cast("long")


def unequal_ranges(source: DataFrame, target: DataFrame, keys: list[str], leaves: int = LEAVES) -> DataFrame:
    """``(node, source_rows, target_rows)`` of the leaves in which the two sides differ."""
    sides = digest_tree(source, keys, leaves).withColumn("_s", F.lit(1)).unionByName(digest_tree(target, keys, leaves).withColumn("_s", F.lit(0)))
    of = lambda side, column: F.max(F.when(F.col("_s") == side, F.col(column)))
    both = sides.filter(F.col("level") == F.lit(_depth(leaves))).groupBy("node").agg(
        F.coalesce(of(1, "rows"), F.lit(0)).alias("source_rows"), F.coalesce(of(0, "rows"), F.lit(0)).alias("target_rows"),
        of(1, "digest").alias("_d1"), of(0, "digest").alias("_d0"))
    differ = (F.col("source_rows") != F.col("target_rows")) | ~F.col("_d1").eqNullSafe(F.col("_d0"))
    return both.filter(differ).select("node", "source_rows", "target_rows")


def _depth(leaves: int) -> int:
    depth = 0
    while leaves > 1:
        depth, leaves = depth + 1, -(-leaves // FAN)
    return depth


def tree_differences(source: DataFrame, target: DataFrame, keys: list[str], leaves: int = LEAVES) -> DataFrame:
    """``keyed_differences`` for sides that mostly agree: only rows of unequal ranges leave their tasks.

    Digests are compared first, a few thousand numbers for each side; then both sides are read again and rows outside
    the unequal ranges dropped where they are read.
    """
    nodes = F.broadcast(unequal_ranges(source, target, keys, leaves).select(F.col("node").alias("_node")))  # at most ``leaves`` rows

    def suspects(df: DataFrame) -> DataFrame:
        return df.withColumn("_leaf", _leaf(keys, leaves)).join(nodes, F.col("_leaf") == F.col("_node"), "left_semi").drop("_leaf")

    return keyed_differences(suspects(source), suspects(target), keys)


def row_differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, for tables without a key: ``(*columns, source_copies, target_copies)``.
    Copies are counted before the shuffle, so a row repeated many times travels once per task."""
    tagged = source.withColumn("_side", F.lit(1)).unionByName(target.withColumn("_side", F.lit(0)))
    counted = tagged.groupBy(*[quoted(c) for c in source.columns]).agg(
        F.sum("_side").alias("source_copies"), F.sum(1 - F.col("_side")).alias("target_copies"))
    return counted.filter("source_copies <> target_copies")


