"""Winnowed document fingerprints, and how near a document is to an edited text and to its neighbour.

Grams of ``k`` code points are hashed with a rolling polynomial. Of every window of ``w`` grams the smallest hash is
chosen, the rightmost of equals, with its position: two texts that share ``w + k - 1`` code points in a row share a
chosen gram, and no match shorter than ``k`` is ever seen. Unless ``w`` is given, it is ``WINDOW`` for long texts and less for
short ones, so that a text of ``2 k - 1`` code points or more shares a gram with any text that starts with its first half:
a smallest of a wide window is also that of a narrower one in it, so short and long texts still meet.

Defined results: a null text counts as empty. An empty text has an empty fingerprint, a text shorter than ``k`` one
hash of the whole text. Texts of any length are hashed in blocks, so working memory doesn't grow with them. Equal
texts have equal fingerprints, so repeated rows get equal values. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import partitions, pick, small_batches

K, WINDOW = 20, 81
#: Windows hashed at a time.
BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread sums over all 64 bits, one to one, so that the smallest is a random one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` codes in a row, from hashes of half the length."""
    h, length = codes, 1
    for bit in bin(k)[3:]:
        shift = np.uint64(pow(BASE, length, 1 << 64))
        h, length = h[:-length] * shift + h[length:], 2 * length
        if bit == "1":
            h, length = h[:-1] * np.uint64(BASE) + codes[length:], length + 1
    return _mixed(h)


def chosen(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of each window of ``w``, each once, in order."""
    n = len(hashes)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.array([], dtype=np.int64)
    best, size = np.arange(n), 1
    while size < w:
        step = min(size, w - size)  # the two halves may overlap: a smallest of both is still the smallest
        left, right = best[:-step], best[step:]
        best, size = np.where(hashes[right] <= hashes[left], right, left), size + step
    return np.unique(best)


def window_of(length: int, k: int = K) -> int:
    """Grams a window for a text of so many code points: a quarter of them at most, and no more than its first half has."""
    return max(1, min(WINDOW, (length - k + 1) // 4, (length + 1) // 2 - k + 1))


def winnow(text: str, k: int = K, w: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, positions)`` of the fingerprint."""
    if not text:
        return np.array([], dtype=np.uint64), np.array([], dtype=np.int64)
    k = min(k, len(text))
    w = w or window_of(len(text), k)
    hashes, positions = [], []
    grams = len(text) - k + 1
    for start in range(0, max(1, grams - w + 1), BLOCK):
        stop = min(grams, start + BLOCK + w - 1)
        codes = np.frombuffer(text[start : stop + k - 1].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        h = gram_hashes(codes, k)
        at = chosen(h, w)
        hashes.append(h[at])
        positions.append(at + start)
    if len(hashes) == 1:
        return hashes[0], positions[0]
    at, first = np.unique(np.concatenate(positions), return_index=True)
    return np.concatenate(hashes)[first], at


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """``hash@position`` with hashes in 16 hex digits, joined by spaces."""
    digits = hashes.astype(">u8").tobytes().hex()
    return " ".join([f"{digits[16 * i:16 * i + 16]}@{p}" for i, p in enumerate(positions.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes of two fingerprints; two empty ones are equal."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, k: int = K, w: int | None = None) -> DataFrame:
    """``(doc_id, n_chars, hashes array<long>, positions array<long>)`` of every whole text."""
    small_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [winnow(t, k, w) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                 pa.array([p for _, p in found], pa.list_(pa.int64()))],
                ["doc_id", "n_chars", "hashes", "positions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_chars long, hashes array<bigint>, positions array<bigint>")


def _dealt(docs: DataFrame) -> DataFrame:
    """``(bucket, guest, doc_id, text)``: rows dealt into ranges of descending ``doc_id``, null last, each range with
    the first row of the next one as its guest; after the last range comes the first.

    Only ids are looked at to find the ranges, and one id for each range comes to the driver: a fixed multiple of the
    shuffle partitions, whatever the size of the table.
    """
    spark = docs.sparkSession
    ranges = 4 * partitions(spark)
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * ranges)).first()[0] or []
    bounds = np.array(sorted(set(found)), dtype=np.int64)

    def bucketed(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                at = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False))
                at = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), *batch.columns], ["bucket", *batch.schema.names])

        columns = ", ".join(f"{n} {t}" for n, t in df.dtypes)
        return df.mapInArrow(run, f"bucket int, {columns}")

    firsts = sorted((r[0], r[1]) for r in bucketed(docs.select("doc_id")).groupBy("bucket").agg(F.max("doc_id")).collect())
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    ids = [i for _, i in firsts if i is not None]
    wanted = F.col("doc_id").isin(ids)
    if len(ids) < len(firsts):
        wanted = F.coalesce(wanted, F.lit(True))
    own = bucketed(docs)
    guests = bucketed(docs.filter(wanted)).groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("row"))
    if before:
        guests = guests.withColumn("bucket", F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("bucket")))
    return own.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").unionByName(
        guests.select(F.col("bucket").cast("int").alias("bucket"), F.lit(True).alias("guest"), "row.doc_id", "row.text"))


def edited_and_next(docs: DataFrame, k: int = K, w: int | None = None) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The next document is the one with the next smaller ``doc_id`` (rows that share one follow by text, greatest first;
    null ids come last), after the last the first; a single document is its own next. The edited text is the text with
    its last half replaced by as many of the next text's first code points, or all it has. Texts are shuffled once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce("text", F.lit(""))})
    dealt = _dealt(docs).repartition(partitions(spark), "bucket").sortWithinPartitions(
        "bucket", "guest", F.desc("doc_id"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (bucket, doc_id, text, hashes, positions) of the row before
        for batch in batches:
            rows = []
            for bucket, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, positions = winnow(text, k, w)
                if held is not None and held[0] == bucket:
                    rows.append(compared(*held[1:], text, hashes))
                held = None if guest else (bucket, doc_id, text, hashes, positions)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    def compared(doc_id, text, hashes, positions, next_text, next_hashes) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + next_text[:half]
        edited_hashes, edited_positions = winnow(edited, k, w)
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(hashes, positions),
                written(edited_hashes, edited_positions), likeness(hashes, edited_hashes), likeness(hashes, next_hashes))

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
