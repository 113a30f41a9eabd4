"""Approximate nearest neighbours with a permutation index.

A vector is represented by its ``LISTED`` nearest pivots in order. It is posted in the inverted files of the first
``POSTED`` of them, and a query looks into the files of its own first ``POSTED``. In a file, candidates are ranked by
the footrule distance of the two orders (a missing pivot counts as the place behind the last), those within the radius
are reranked by cosine, and the best of all files are merged. A pair that meets in several files is looked at in the
first of the query's.

Pivots and radius are fitted to a bounded sample of vectors (``PIVOTS`` and ``PROBES``); the radius is the quantile of
the sample's footrule distances that holds ``REACH`` of all pairs, so the work is a fixed share of all pairs at every
size. Every vector is indexed. Files are cut into blocks of vectors and blocks of queries, so a pivot that is near to
a third of all rows is spread over many tasks. Queries that find fewer neighbours than asked for are searched against
all rows, in the same kind of blocks.

Defined results: vectors that are null, zero, hold a null or a component that is not finite, or have another length
than most of the sample take no part, as queries or as candidates. Equal scores go to the smaller id. Rows that share
an id: one query for each, each other row a candidate unless it has the query's id. Fewer candidates than asked for
give fewer rows. An empty table gives an empty result. Null ids take no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import pick, small_batches, stored, type_of

PIVOTS, LISTED, POSTED = 256, 64, 32
PROBES = 2000
REACH = 0.35
#: Vectors, and queries, that meet in a task.
ROWS, QUERIES = 4096, 1024


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector at length 1, in double precision, whatever its size."""
    vectors = np.asarray(vectors, dtype=np.float64)
    top = np.abs(vectors).max(axis=1, keepdims=True)
    extreme = (top < 1e-100) | (top > 1e100)
    vectors = np.where(extreme, vectors / top, vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, summed in one order, so that equal vectors score exactly alike."""
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    sizes = np.maximum(np.abs(a).max(axis=1), np.abs(b).max(axis=1)), np.minimum(np.abs(a).max(axis=1), np.abs(b).max(axis=1))
    if len(a) and (sizes[0].max() > 1e100 or sizes[1].min() < 1e-100):
        a, b = scaled(a), scaled(b)
    dot, aa, bb = ((x * y).sum(axis=1) for x, y in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def orders(vectors: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """The numbers of the nearest pivots, nearest first, ties to the smaller number."""
    return np.argsort(-(scaled(vectors) @ pivots.T), axis=1, kind="stable")[:, :listed]


def places(order: np.ndarray, pivots: int) -> np.ndarray:
    """The place of every pivot in each order; behind the last if it isn't listed."""
    out = np.full((len(order), pivots), order.shape[1], dtype=np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


def footrule(own: np.ndarray, order: np.ndarray, listed: int) -> np.ndarray:
    """The distance of one query's order from the places of many vectors."""
    at = own[:, order].astype(np.int32)
    gaps = np.abs(at - np.arange(len(order), dtype=np.int32)).sum(axis=1)
    # What the vector lists and the query doesn't: listed - place each, out of a constant total.
    return gaps + listed * (listed + 1) // 2 - (listed - at).sum(axis=1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest are, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Index:
    """Pivots, the length of vectors, and the radius, fitted to a bounded sample."""

    def __init__(self, vectors: list, reach: float = REACH) -> None:
        sizes = Counter(len(v) for v in vectors)
        self.length = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
        sample = np.array([v for v in vectors if len(v) == self.length], dtype=np.float64)
        if not len(sample):
            self.pivots, self.listed, self.radius = np.zeros((0, 0)), 0, 0
            return
        distinct = scaled(np.unique(sample, axis=0))
        rng = np.random.default_rng(7)
        self.pivots = distinct[np.sort(rng.permutation(len(distinct))[:PIVOTS])]
        self.listed = min(LISTED, len(self.pivots))
        order = orders(sample, self.pivots, self.listed)
        own = places(order, len(self.pivots))
        seen = np.concatenate([footrule(own, o, self.listed) for o in order[:200]])
        self.radius = int(np.quantile(seen, reach))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v array<double>)`` of the vectors that take part."""
    rows = pick(df, key, vector).toDF("id", "v").withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def fitted(rows: DataFrame, reach: float = REACH) -> Index:
    """An index fitted to the ``PROBES`` vectors that a hash of their ids puts first."""
    share = min(1.0, 2 * PROBES / max(1, rows.count()))
    place = F.pmod(F.xxhash64(F.lit("pivot"), F.col("id").cast("string")), F.lit(1 << 30))
    drawn = rows.filter(place < int(share * (1 << 30))).withColumn("place", place)
    return Index([r["v"] for r in drawn.orderBy("place", "id").limit(PROBES).select("v").collect()], reach)


def _block(name: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), "id"), n).cast("int")


def _search(cell: pd.DataFrame, k: int, index: Index, pivot: int | None) -> pd.DataFrame:
    """The k nearest that each query of a cell finds among its vectors."""
    rows, queries = cell[~cell["asks"]], cell[cell["asks"]]
    ids, out = rows["id"].to_numpy(), []
    if len(rows) and len(queries):
        raw, asked = np.stack(rows["v"].to_numpy()), np.stack(queries["v"].to_numpy())
        unit, unit_asked = scaled(raw), scaled(asked)
        if pivot is not None:
            own = places(orders(raw, index.pivots, index.listed), len(index.pivots))
            wants = orders(asked, index.pivots, index.listed)
        for i, query in enumerate(queries["id"].to_numpy()):
            can = ids != query
            if pivot is not None:
                first = int(np.flatnonzero(wants[i] == pivot)[0])
                can &= ~(own[:, wants[i][:first]] < POSTED).any(axis=1)
                at = np.flatnonzero(can)
                at = at[footrule(own[at], wants[i], index.listed) <= index.radius]
            else:
                at = np.flatnonzero(can)
            if not len(at):
                continue
            near = unit[at] @ unit_asked[i]
            if len(at) > k:
                at = at[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
            exact = cosines(raw[at], np.broadcast_to(asked[i], (len(at), raw.shape[1])))
            top = best(exact, ids[at], k)
            out.append(pd.DataFrame({"query_id": query, "number": queries["number"].iloc[i], "vec_id": ids[at][top], "score": exact[top]}))
    columns = {"query_id": np.zeros(0, ids.dtype), "number": np.zeros(0, np.int64), "vec_id": np.zeros(0, ids.dtype), "score": np.zeros(0)}
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns)


def _meet(rows: DataFrame, queries: DataFrame, key: str, k: int, index: Index) -> DataFrame:
    """Blocks of vectors against blocks of queries under each key: ``(query_id, number, vec_id, score)``."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks")).join(
        queries.groupBy(key).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("asked")), key)
    sizes = F.broadcast(stored(sizes, "block-counts"))  # a row for each pivot
    vectors = rows.join(sizes, key).select(
        key, _block("v", F.col("blocks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("j"),
        "id", "v", F.lit(-1).cast("long").alias("number"), F.lit(False).alias("asks"))
    asks = queries.join(sizes, key).select(
        key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), _block("q", F.col("asked")).alias("j"),
        "id", "v", "number", F.lit(True).alias("asks"))
    kind = type_of(rows, "id")

    def run(group: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        return _search(cell, k, index, None if group[0] < 0 else int(group[0]))

    return vectors.unionByName(asks).groupBy(key, "i", "j").applyInPandas(
        run, f"query_id {kind}, number long, vec_id {kind}, score double")


def posted(rows: DataFrame, index: Index) -> DataFrame:
    """``(pivot, place, ...)``: each row in the inverted files of its nearest pivots."""

    def nearest(vectors: pd.Series) -> pd.Series:
        order = orders(np.stack(vectors.to_numpy()), index.pivots, index.listed)[:, :POSTED]
        return pd.Series(list(order.astype(np.int32)))

    files = F.pandas_udf(nearest, "array<int>")
    return rows.select("*", F.posexplode(files("v")).alias("place", "pivot"))


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
            reach: float = REACH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for the rows that ``is_query`` picks by ``id``."""
    spark = df.sparkSession
    small_batches(spark, 4096)
    rows = stored(usable(df, key, vector), "vectors")
    kind = type_of(rows, "id")
    index = fitted(rows, reach)
    if not index.listed:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    rows = rows.filter(F.size("v") == index.length)
    queries = stored(rows.filter(is_query).withColumn("number", F.monotonically_increasing_id()), "queries")
    found = stored(_meet(posted(rows, index), posted(queries, index), "pivot", k, index), "found")
    enough = found.groupBy("number").count().filter(F.col("count") >= k).select("number")
    short = stored(queries.join(enough, "number", "left_anti").withColumn("all", F.lit(-1)), "short")
    if not short.isEmpty():
        rest = _meet(rows.withColumn("all", F.lit(-1)), short, "all", k, index)
        found = found.join(short.select("number"), "number", "left_anti").unionByName(rest.select(*found.columns))
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
