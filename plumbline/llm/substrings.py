"""Substring dedup: units of text are hashed, grouped globally, and all but the earliest occurrence are removed.

A unit is a paragraph (text between blank lines) or a line; ``sentence`` takes both, lines cut at their sentence ends, and
pieces that end where the words say so, whatever sentences and lines they stand in: passages are found that start in the
middle of a line or of a sentence, or are made of short sentences. Units of one text may overlap. They are normalised (white space to one blank, lower case) and hashed to 128
bits. The earliest occurrence by document id, then by offset, stays; every other one comes back with its offsets in
the original text, in code points.

Pieces end between two words whose hash is the smallest among those of ``REACH`` pairs on either side, so the same words
give the same ends after ``REACH`` + 1 words, and a passage may lose the piece it begins or ends in. A piece below the
minimum goes on to the end of the next one, the last one back to the start of the one before.

Repeated units can be short, and documents share stock sentences: ``in_long_runs`` leaves only units in long repeated runs.

Defined results: a null or empty text has no units. Units of fewer than ``min_words`` words and fewer than ``MIN_CHARS``
characters are never removed. Null ids rank last; rows that share an id rank in the order they were read. Of repeated rows the first keeps its text. Units of
any length are hashed whole. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import partitions, pick, small_batches, stored, type_of

MIN_WORDS = 6
#: Of a normalised unit; enough whatever the number of its words.
MIN_CHARS = 30
#: Characters of text that repeated units must cover in one go to be removed from a document by the registered query,
#: and the characters between two units that don't part them.
MIN_RUN, GAP = 150, 8
#: Pairs of words on either side that the end of a piece is compared with.
REACH = 3
UNITS = {
    "paragraph": re.compile(r"(?:[^\n]+|\n(?![ \t]*\n))+"),
    "line": re.compile(r"[^\n]+"),
    "sentence": re.compile(r"(?:[^\n.!?]+|[.!?](?!\s|$))+[.!?]?"),
}
DIGEST = ["h1", "h2"]


def _cuts(words: list[str]) -> list[int]:
    """Where pieces start, and the number of words at the end; of equal hashes the last one counts."""
    import xxhash

    own = dict.fromkeys(words)
    for word in own:
        own[word] = xxhash.xxh3_64_intdigest(word)
    each = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
    pairs = (each[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ each[1:]
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    least = np.ones(len(pairs), bool)
    for step in range(1, REACH + 1):
        least[step:] &= pairs[step:] <= pairs[:-step]
        least[:-step] &= pairs[:-step] < pairs[step:]
    return [0, *(np.flatnonzero(least) + 1).tolist(), len(words)]


def units_of(text: str, unit: str, min_words: int) -> list[tuple[int, int, str]]:
    """``(start, end, normalised)`` of the units that may be removed, each span once, in order."""
    at = [m.span() for m in re.finditer(r"\S+", text)]
    if not at:
        return []
    words = text.lower().split()
    whole = " ".join(words)
    # Where each word starts in the normalised text; units start and end with words.
    place = [0, *accumulate(len(word) + 1 for word in words)]
    starts = [start for start, _ in at]

    def enough(first: int, last: int) -> bool:
        return last - first >= min_words or place[last] - place[first] - 1 >= MIN_CHARS

    found = set()
    for pattern in UNITS.values() if unit == "sentence" else [UNITS[unit]]:
        for m in pattern.finditer(text):
            first = bisect_left(starts, m.start())
            found.add((first, bisect_left(starts, m.end(), first)))
    if unit == "sentence":
        cuts = _cuts(words)
        for k, (first, last) in enumerate(pairwise(cuts)):
            after, before = k + 2, k - 1
            while after < len(cuts) and not enough(first, last):
                last, after = cuts[after], after + 1
            while before >= 0 and not enough(first, last):
                first, before = cuts[before], before - 1
            found.add((first, last))
    return [(starts[first], at[last - 1][1], whole[place[first] : place[last] - 1]) for first, last in sorted(found) if enough(first, last)]


def unit_digests(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, row, start, end, h1, h2)`` of every unit; ``row`` tells rows with the same id apart."""
    import xxhash

    small_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, ends, digests = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for start, end, words in units_of(text or "", unit, min_words):
                    at.append(i)
                    starts.append(start)
                    ends.append(end)
                    digests.append(xxhash.xxh3_128_digest(words))
            halves = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), 2 * len(at), [None, pa.py_buffer(b"".join(digests))])
            halves = halves.view(pa.int64()) if len(at) else pa.array([], pa.int64())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
                 halves.take(pa.array(range(0, 2 * len(at), 2), pa.int64())), halves.take(pa.array(range(1, 2 * len(at), 2), pa.int64()))],
                ["doc_id", "row", "start", "end", *DIGEST])

    return docs.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, row long, start int, end int, h1 long, h2 long")


def repeats(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, row, start, end, kept_doc_id, kept_start)``: the spans to remove, and where the text stays.

    Digests that make up a large share of a sample of the units meet in a minimum on the map side, so a unit that fills
    a third of the table is one row for each task; all others are shuffled once, by range. The sample only tells which way
    a digest goes.
    """
    units = stored(unit_digests(docs, unit, min_words), "units")
    n = partitions(docs.sparkSession)
    share = min(1.0, 200 * n / max(1, units.count()))
    # At most 4 n digests have so many of the about 200 n rows.
    heavy = F.broadcast(stored(units.sample(share, seed=1).groupBy(*DIGEST).count().filter("count >= 50").select(*DIGEST), "heavy-units"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start")

    heavy_units = units.join(heavy, DIGEST)
    firsts = F.broadcast(heavy_units.groupBy(*DIGEST).agg(F.min(rank).alias("first")))
    heavy_found = heavy_units.join(firsts, DIGEST).filter(rank != F.col("first"))

    # The range partitioning satisfies the window, so this is the only exchange of the other units.
    light = units.join(heavy, DIGEST, "left_anti").repartitionByRange(n, *DIGEST)
    ordered = Window.partitionBy(*DIGEST).orderBy(F.col("doc_id").asc_nulls_last(), "row", "start")
    light_found = light.withColumns({"first": F.first(rank).over(ordered), "turn": F.row_number().over(ordered)}).filter("turn > 1")
    return heavy_found.unionByName(light_found.drop("turn")).select(
        "doc_id", "row", "start", "end", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))


def in_long_runs(spans: DataFrame, least: int = MIN_RUN, gap: int = GAP) -> DataFrame:
    """The spans, in their own columns, that lie in a run of at least ``least`` characters: a stretch of one document that
    spans cover with no more than ``gap`` characters between them.

    A stock sentence that many documents share stays in all of them; a passage goes as a whole. The spans of one
    document are brought together, not its text.
    """
    along = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("opens", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    numbered = marked.withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("row", "run")
    long = numbered.withColumn("covered", F.max("end").over(whole) - F.min("start").over(whole)).filter(F.col("covered") >= least)
    return long.select(*spans.columns)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; offsets are those of the original."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])
