"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are aggregated by the set of sources they belong to. Words flow from each set, at a cost that rises with
every repetition, to the sources of the set, and from there to the sources' quotas; the flow of least cost says how
many words each set gives. Inside a set, documents are taken in a seeded order until the words are reached: all of
them for whole repetitions, then the first ones once more, the last of those in part.

The flow has a node for each set of sources and each source, however many documents there are. Only these totals come
to the driver; more sets than ``MOST_SETS`` are refused, never cut.

Defined results: a null or empty text has size 0 and nothing is taken. A null source counts as a source of its own,
last in order. Rows with the same id and text share evenly what their place in the order is given. Sources without
words have target 0. An empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import n_words, pick, stored

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
MOST_SETS = 100_000
#: Parts of the seeded order that are summed before single documents are looked at: hex digits of the hash.
DIGITS = 3


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            repeats: float = REPEATS) -> dict[str | None, float]:
    """The words wanted from each source: a weighted share of all, at most ``repeats`` times its size.

    What a full source can't take is shared anew by weight among the others until none is above its bound.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, found = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] > repeats * sizes[s] * total]
        if not full:
            found |= {s: left * weight[s] / total for s in free}
            break
        found |= {s: float(repeats * sizes[s]) for s in full}
        left -= sum(found[s] for s in full)
        free = [s for s in free if s not in full]
    return found


def cheapest_flow(sizes: dict[tuple, int], quotas: dict, repeats: int) -> dict[tuple, int]:
    """Words each set gives: a flow to the quotas of least cost, the r-th repetition of a word costing r.

    Successive shortest paths with potentials. Sets are tuples of sources.
    """
    sets, sources = list(sizes), list(quotas)
    start, end = 0, 1
    of_set = {s: 2 + i for i, s in enumerate(sets)}
    of_source = {s: 2 + len(sets) + i for i, s in enumerate(sources)}
    out: list[list[int]] = [[] for _ in range(2 + len(sets) + len(sources))]
    edges: list[list] = []  # [to, capacity, cost]; the reverse edge is at index ^ 1

    def edge(a: int, b: int, capacity: int, cost: int) -> None:
        out[a].append(len(edges))
        edges.append([b, capacity, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])

    for s, size in sizes.items():
        for r in range(1, repeats + 1):
            edge(start, of_set[s], size, r)
        for source in s:
            edge(of_set[s], of_source[source], repeats * size, 0)
    for source, quota in quotas.items():
        edge(of_source[source], end, quota, 0)

    potential = [0] * len(out)
    while True:
        distance: list[float] = [float("inf")] * len(out)
        by = [-1] * len(out)
        distance[start], queue = 0, [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for k in out[a]:
                b, capacity, cost = edges[k]
                new = d + cost + potential[a] - potential[b]
                if capacity and new < distance[b]:
                    distance[b], by[b] = new, k
                    heapq.heappush(queue, (new, b))
        if by[end] < 0:
            break
        furthest = distance[end]
        potential = [p + min(d, furthest) for p, d in zip(potential, distance, strict=True)]
        path, a = [], end
        while a != start:
            path.append(by[a])
            a = edges[by[a] ^ 1][0]
        amount = min(edges[k][1] for k in path)
        for k in path:
            edges[k][1] -= amount
            edges[k ^ 1][1] += amount
    return {s: sum(edges[k ^ 1][1] for k in out[of_set[s]] if k % 2 == 0) for s in sets}


def _place(seed: str) -> Column:
    """The seeded order of documents: 32 hex digits."""
    return F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
         seed: str = "mix") -> DataFrame:
    """``(doc_id, sources, size, source_size, target, taken)`` of all documents.

    ``docs`` has ``(doc_id, text, sources array<string>)``, the array being the set of sources a document belongs to.
    ``source_size`` and ``target`` are those of the first of them, for documents of one source its own. Sizes are
    summed over single membership: a word of a document in two sources counts in both.
    """
    spark = docs.sparkSession
    sized = stored(
        pick(docs, "doc_id", "text", "sources").select(
            "doc_id", F.array_sort("sources").alias("sources"), n_words(F.col("text")).alias("size"),
            _place(seed).alias("place")), "sized")
    cells = stored(
        sized.groupBy("sources", F.left("place", F.lit(DIGITS)).alias("part")).agg(F.sum("size").alias("words")), "cells")
    sets = {tuple(r["sources"]): r["words"] for r in cells.groupBy("sources").agg(F.sum("words").alias("words")).take(MOST_SETS + 1)}
    if len(sets) > MOST_SETS:
        raise ValueError(f"documents belong to more than {MOST_SETS} different sets of sources")
    sizes: dict[str | None, int] = {}
    for s, words in sets.items():
        for source in s:
            sizes[source] = sizes.get(source, 0) + words
    wanted = targets(sizes, weights, share, repeats)
    flow = cheapest_flow(sets, {s: round(t) for s, t in wanted.items()}, repeats)

    rows = [(list(s), sizes[s[0]] if s else 0, wanted[s[0]] if s else 0.0,
             flow[s] // words if words else 0, flow[s] % words if words else 0) for s, words in sets.items()]
    # One row for each set of sources.
    shares = F.broadcast(spark.createDataFrame(
        rows, "sources array<string>, source_size long, target double, whole long, rest long"))
    # Only the part of the order in which the rest of a set ends is looked at document by document.
    upto = Window.partitionBy("sources").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        cells.join(shares.select("sources", "rest"), "sources")
        .withColumn("below", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .filter("below <= rest AND rest < below + words").select("sources", "part", F.col("rest") - F.col("below")))
    edge = edge.toDF("sources", "part", "left_over")
    inside = Window.partitionBy("sources").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        sized.withColumn("part", F.left("place", F.lit(DIGITS))).join(F.broadcast(edge), ["sources", "part"])
        .groupBy("sources", "left_over", "place").agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
        .withColumn("below", F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .filter("below <= left_over AND left_over < below + words")
        .select("sources", F.col("place").alias("cut"), F.floor((F.col("left_over") - F.col("below")) / F.col("copies")).alias("part_taken")))
    extra = (F.when(F.col("place") < F.col("cut"), F.col("size"))
             .when(F.col("place") == F.col("cut"), F.least("size", "part_taken")).otherwise(F.lit(0)))
    return (
        sized.join(shares.select("sources", "source_size", "target", "whole"), "sources")
        .join(F.broadcast(stored(cut, "cuts")), "sources", "left")
        .select("doc_id", "sources", "size", "source_size", "target",
                (F.col("whole") * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long").alias("taken")))
