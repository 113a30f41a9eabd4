"""Near-duplicate groups by circulant MinHash, bands and exact Jaccard.

A document's set holds 64-bit hashes of its distinct word shingles. Two permutations make the whole signature: the
first places the shingles on a circle of 2^32, the second ranks places; coordinate k is the smallest rank after a turn
of the circle by k. ``BANDS`` bands of ``ROWS`` coordinates are grouped: at a likeness of 0.8 a pair shares none with a
chance of (1 - 0.8^4)^32, about 5e-8.

Exact copies meet first, by a digest of the whole set, and go on as one class. Inside a band's group every class is
compared with the group's first one, and those links are joined up; so a group of n copies costs n comparisons and not
n^2. Groups that still hold several components are searched again: pairs of different components whose signatures
agree in ``AGREE`` of the places are compared too, inside cells of a bounded number of members, until a cell's components
are joined up. At a likeness of 0.8 a pair agrees in fewer of 128 places with a chance of about 8e-8 (were the places
independent), so that it is missed there or by the bands with about 1.2e-7. Every link is confirmed on the full sets; there
is no cap on groups, partners or candidates.

Defined results: a document without words has an empty set, no links, and is its own component. With fewer words than
a shingle has, all of them are one shingle. Rows that share an id are compared by their own texts. A null id never names a
component unless all its rows have null ids; such rows are kept. Texts of any length count whole. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import partitions, pick, small_batches, stored, type_of

BANDS, ROWS = 32, 4
AGREE = 0.6
#: Classes of one side that a task compares at a time.
CELL = 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of the words met last; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 400_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles. Words end at ASCII white space; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    each = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ each[i : i + n]) * _BASE
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The smallest rank for each turn of the circle."""
    place = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    turns = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(place), 1024):
        x = place[None, start : start + 1024] + turns
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, digest, signature)``; digest and signature are null for empty sets."""
    small_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, size)
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "digest", "signature"])

    return docs.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, text_hash long, n_shingles long, digest binary, signature binary")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The keys of the bands of each signature."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(parts), 1))
    for i in range(ROWS):
        key = (key ^ parts[:, :, i]) * _BASE
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def band_keys(classes: DataFrame) -> DataFrame:
    """``(band, node, n)``: each class under the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = keys_of(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1)), *[pa.array(np.repeat(batch.column(i).to_numpy(), BANDS)) for i in (0, 1)]],
                ["band", "node", "n"])

    return classes.select("node", "n", "signature").mapInArrow(run, "band long, node long, n long")


def similar(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be alike."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * 80


def linked(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are alike: 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has a link, the root being the smallest node of its component.

    Large and small stars in turn, written to the shared folder each time, until the edges no longer change.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pulled = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(pulled.select("e.*").filter("u > v").distinct(), "edges")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(node, hashes binary)``: the full sets of the wanted classes, from the whole texts again."""
    docs = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    wanted = wanted.select("node", "digest", F.col("rep").alias("rep"), F.col("rep_hash").alias("rep_hash"))
    rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for text, node, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(text, size).tobytes()
                if hashlib.blake2b(own, digest_size=16).digest() == digest:
                    nodes.append(node)
                    found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "hashes"])

    return rows.select("text", "node", "digest").mapInArrow(run, "node long, hashes binary")


def _across(groups: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``(band, i, j, xs, ys, nodes)``: pairs of different components that share a band and whose signatures nearly
    agree, as two arrays for each cell, and the nodes in them.

    ``groups`` has ``(band, node)``. The members outside a group's largest component meet all its members, in cells of
    at most about ``CELL`` by ``CELL``; only groups with several components are looked at. A pair that shares several
    bands is taken in the first of them.
    """
    rooted = groups.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    held = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = held.groupBy("band").agg(
        F.count("*").alias("roots"), F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("largest")).filter("roots > 1")
    mixed = mixed.select("band", F.col("largest.root").alias("largest"),
                         F.ceil((F.col("members") - F.col("largest.n")) / CELL).cast("int").alias("rows"),
                         F.ceil(F.col("members") / CELL).cast("int").alias("columns"))
    open_ = rooted.join(mixed, "band").join(classes.select("node", "n", "signature"), "node")
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    odd = F.col("root") != F.col("largest")
    shared = ("band", "node", "root", "n", "signature")
    every = open_.select(F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), block(F.col("columns")).alias("j"), *shared,
                         odd.alias("odd"), F.lit(False).alias("row"))
    rows_ = open_.filter(odd).select(block(F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), *shared,
                                     F.lit(True).alias("odd"), F.lit(True).alias("row"))

    spark = groups.sparkSession
    cells = every.unionByName(rows_).repartition(partitions(spark), "band", "i", "j").sortWithinPartitions("band", "i", "j")
    small_batches(spark, CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Most cells hold a few rows: they are cut out of sorted batches, the last one of a batch waits for the next.
        held: list[np.ndarray] | None = None
        for batch in chain(batches, [None]):
            if batch is None:
                columns, ends = held, [] if held is None else [len(held[0])]
            else:
                columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in CELL_COLUMNS]
                columns.append(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, -1))
                if held is not None:
                    columns = [np.concatenate(part) for part in zip(held, columns, strict=True)]
                change = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
                ends = (np.flatnonzero(change) + 1).tolist()
            found, start = [], 0
            for end in ends:
                own = [c[start:end] for c in columns]
                x, y = _candidates(*own[:1], *own[3:])
                if len(x):
                    found.append((own[0][0], own[1][0], own[2][0], x, y, np.unique(np.concatenate([x, y]))))
                start = end
            held = None if columns is None else [c[start:] for c in columns]
            if found:
                kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)],
                                                 names=["band", "i", "j", "xs", "ys", "nodes"])

    return cells.select(*CELL_COLUMNS, "signature").mapInArrow(
        run, "band long, i int, j int, xs array<bigint>, ys array<bigint>, nodes array<bigint>")


CELL_COLUMNS = ("band", "i", "j", "node", "root", "n", "odd", "row")


def _candidates(band: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, odd: np.ndarray, row: np.ndarray,
                marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one cell that are worth a comparison of full sets."""
    rows, columns = np.flatnonzero(row), np.flatnonzero(~row)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 13) // max(1, len(columns)))
    for start in range(0, len(rows) if len(columns) else 0, step):
        at, to = rows[start : start + step, None], columns[None, :]
        # Two odd members meet twice; the smaller one asks.
        can = (root[to] != root[at]) & (~odd[to] | (node[to] > node[at])) & (100 * np.minimum(n[to], n[at]) >= 80 * np.maximum(n[to], n[at]))
        a, b = np.nonzero(can)
        a, b = at[a, 0], to[0, b]
        same = marks[a] == marks[b]
        near_ = same.mean(axis=1) >= AGREE
        a, b, same = a[near_], b[near_], same[near_]
        if len(a):
            first = same.reshape(len(a), BANDS, ROWS).all(axis=2).argmax(axis=1)
            here = keys_of(marks[a])[np.arange(len(a)), first] == band[0]
            xs.append(node[a[here]])
            ys.append(node[b[here]])
    return np.concatenate(xs), np.concatenate(ys)


def _linked_across(across: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` among the pairs of each cell, enough to join up what they join: pairs that are connected by
    then are not compared. The sets of a cell's nodes come to it; pairs never become rows."""
    needed = across.select(F.col("band").alias("of"), F.col("i").alias("r"), F.col("j").alias("c"), F.explode("nodes").alias("node"))
    needed = needed.join(sets, "node").select("of", "r", "c", "node", "hashes")

    def run(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        own = {node: np.frombuffer(h, np.uint64) for node, h in zip(members["node"], members["hashes"], strict=True)}
        parent = {node: node for node in own}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        found = []
        for x, y in zip(np.concatenate(pairs["xs"].to_list()).tolist(), np.concatenate(pairs["ys"].to_list()).tolist(), strict=True):
            a, b = root(x), root(y)
            if a != b:
                common = len(np.intersect1d(own[x], own[y], assume_unique=True))
                if 100 * common >= percent * (len(own[x]) + len(own[y]) - common):
                    parent[a] = b
                    found.append((x, y))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    cells = across.select("band", "i", "j", "xs", "ys").groupBy("band", "i", "j")
    return cells.cogroup(needed.groupBy("of", "r", "c")).applyInPandas(run, "a long, b long")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document; ``size`` is the words of a shingle.

    ``component_id`` is the smallest id reachable over links, and ``kept`` marks the document that has it. The bands
    are made for a likeness of 0.8 or more.
    """
    return _grouped(docs, size, percent).drop("text_hash", "root")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The same with ``text_hash`` and ``root``, which tell rows, and groups, of one id apart."""
    if percent < 80:
        raise ValueError("the bands find pairs from a likeness of 0.8 on")
    spark = docs.sparkSession
    kind = type_of(docs, "doc_id")
    small_batches(spark)
    marks = stored(sketches(docs, size), "sketches")
    rep = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    classes = stored(
        marks.filter("digest IS NOT NULL").groupBy("digest").agg(
            F.any_value("n_shingles").alias("n"), F.any_value("signature").alias("signature"), F.min(rep).alias("r"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "n", "signature",
                F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_hash")), "classes")

    bands = stored(band_keys(classes), "bands")
    firsts = bands.groupBy("band").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("size")).filter("size > 1")
    groups = stored(bands.join(firsts, "band").select("band", "node", "n", "first"), "groups")
    first = F.col("first.node")
    pairs = stored(
        groups.filter((F.col("node") > first) & similar(F.col("n"), F.col("first.n")))
        .select(first.alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    sets = stored(_sets(docs, classes.join(groups.select("node").distinct(), "node"), size), "sets")
    links = stored(linked(pairs, sets, percent), "links")
    roots = components(links)
    across = stored(_across(groups.select("band", "node"), classes, roots), "across")
    small_batches(spark)
    more = stored(_linked_across(across, sets, percent), "more-links")
    if not more.isEmpty():
        # Links between components are joined up over their roots.
        named = more.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").select(
            F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        above = components(named).toDF("root", "top")
        below = classes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        roots = below.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))

    named = classes.select("digest", "node", "rep").join(roots, "node", "left").select(
        "digest", "rep", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("smallest"))
    of_digest = named.join(smallest, "root").select("digest", "root", "smallest")
    out = marks.select("doc_id", "text_hash", "n_shingles", "digest").join(of_digest, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).cast(kind)
    return out.select("doc_id", "text_hash", "root", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns as they were, without all but one of each group.

    Of several rows with the kept id the one with the smallest hash of its text stays, of equal rows one.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    found = _grouped(docs, size, percent)
    # One text for each group, and all rows without words.
    stay = found.filter("kept AND n_shingles > 0").groupBy("root", "component_id").agg(F.min("text_hash").alias("one"))
    stay = stay.select(F.col("component_id").alias("id"), "one", F.lit(True).alias("single"))
    empty = found.filter("n_shingles = 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("one"), F.lit(False).alias("single"))
    left = plain.withColumn("_hash", F.xxhash64(text)).join(
        stay.unionByName(empty).distinct(), doc_id.eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("one")))
    turn = F.row_number().over(Window.partitionBy("id", "one").orderBy(text))
    return left.withColumn("_turn", turn).filter("NOT single OR _turn = 1").select(*plain.columns).toDF(*names)
