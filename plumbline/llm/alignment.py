"""Alignment of two tokenizers over the same bytes, scored by inverted pair bitmaps.

Tokenizer A, byte-level BPE, reads a blank and the text; tokenizer B, BPE pieces, reads the text and puts the blank in
itself. An A token and a B token are linked where their byte ranges overlap, so a link is a stretch between two
neighbouring ends of either; offsets where both end cut the tokens into groups. No token of either reaches over the
border between a non-blank character and a blank, so a text falls into stretches that are encoded, aligned and
remembered on their own, whatever its length.

Documents are numbered inside chunks. Each pair of ids has a compressed bitmap of a chunk's documents, the bytes that
aren't zero, in planes: plane k holds the documents that link the pair a number of times with bit k set. Pairs are
dealt into buckets. Bytes of the planes OR-merged and popcounted give a pair's documents, and popcounts weighted by
2 ** k its links; the totals go back to the chunks whose postings hold the pair, and along the bitmaps to the
documents, which gather their scores there. One chunk's totals and one bucket of its bitmaps are in memory at a time;
a pair that all documents hold is one bitmap a chunk.

Defined results: texts that are null, empty, or that a tokenizer doesn't give back byte by byte (U+2581 becomes a
blank) have no tokens: zeros, and no groups. Special tokens written out are plain text. Texts of any length are
encoded whole. Rows are documents, whatever their ids: null and repeated ids have a row each, and repeated texts count
each time. Ties for a B token's best pair all count. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import byte_characters
from plumbline.llm.tables import partitions, pick, stored, type_of

#: Documents of a chunk, and postings of a chunk from which on it is closed.
DOCS, POSTINGS = 1 << 16, 1 << 21
#: Characters of texts worked on together; stretches, and their characters, that each worker remembers.
TOGETHER, KNOWN, KNOWN_CHARS = 1 << 20, 300_000, 1 << 23
#: Pairs of a chunk are dealt into this many buckets, a row each.
BUCKETS = 64

#: Both tokenizers' tokens end here: Python's white space holds all that the pattern of A calls white space.
_CUT, _PLAIN = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Both tokenizers, and the stretches of text they have met last, in flat arrays."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(byte_of.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        self.texts = [str(i) for i in range(max(size, len(pieces)))]
        self.width = len(pieces)
        with open(a_path, encoding="utf-8") as file:
            pipeline = json.load(file)
        plain = pipeline["normalizer"] is None and pipeline["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.cuts = plain and not any(re.search("[^▁]▁", p) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        #: Of each stretch: numbers of A tokens, B tokens, groups and links, and whether its bytes agree.
        self.facts = np.zeros((0, 5), np.int64)
        self.groups: list[str] = []
        #: Of each stretch the place of its first link in ``links``.
        self.first, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def stretches(self, text: str) -> list[str]:
        """The text cut where neither tokenizer reaches over, each part without its leading blank."""
        if not self.cuts:
            return [text]
        if text[:1] != " " and not _PLAIN.search(text):
            return text.split(" ")
        return [s[1:] for s in _CUT.split(" " + text)]

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' stretches, one after the other, and where each text's begin."""
        if len(self.number) > KNOWN or self.chars > KNOWN_CHARS:
            self._forget()
        parts = [self.stretches(t) if t else [] for t in texts]
        flat = [p for ps in parts for p in ps]
        new = [p for p in dict.fromkeys(flat) if p not in self.number]
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        return numbers, np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])

    def _learn(self, new: list[str]) -> None:
        """Encode and align stretches, all in one line of bytes."""
        whole = [" " + p for p in new]
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        a = [e.ids for e in encode(whole, add_special_tokens=False)]
        b = [ids if p else [self.blank] for p, ids in zip(new, self.b.encode(new, num_threads=1), strict=True)]
        sizes = np.array([len(w.encode()) for w in whole], np.int64)
        agree = np.array([b"".join([self.a_bytes[i] for i in x]) == b"".join([self.b_bytes[i] for i in y]) == w.encode()
                          for x, y, w in zip(a, b, whole, strict=True)], bool)
        # Stretches whose bytes differ take no part: they have no tokens.
        a, b = ([ids if ok else [] for ids, ok in zip(side, agree, strict=True)] for side in (a, b))
        ends = np.cumsum(np.where(agree, sizes, 0))
        n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a, b))
        a_ids, b_ids = (np.array([i for ids in side for i in ids], np.int64) for side in (a, b))
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        cuts = np.union1d(a_ends, b_ends)
        links = a_ids[np.searchsorted(a_ends, cuts)] * self.width + b_ids[np.searchsorted(b_ends, cuts)] if len(cuts) else cuts
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        before = lambda of: np.diff(np.searchsorted(of, ends, side="right"), prepend=0)
        n_groups, n_links = before(common), before(cuts)

        # The groups in writing: A's ids, B's ids, group after group.
        side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        ids, group = np.concatenate([a_ids, b_ids]), np.concatenate([np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)])
        order = np.lexsort((side, group))
        side, group, ids = side[order], group[order], ids[order]
        last = np.append((side[1:] != side[:-1]) | (group[1:] != group[:-1]), True)
        texts = self.texts
        marks = np.array([",", "|", ";"])[np.where(last, 1 + side, 0)].tolist()
        written = [texts[i] + m for i, m in zip(ids.tolist(), marks, strict=True)]
        stops = np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(written[i:j])[:-1] for i, j in zip([0, *stops], stops, strict=False)]

        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.facts = np.vstack([self.facts, np.stack([n_a, n_b, n_groups, n_links, agree], axis=1)])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(n_links))
        self.links = np.append(self.links, links)

    def totals(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each text the numbers of A tokens, B tokens, groups and links; zeros if its bytes don't agree."""
        running = np.vstack([np.zeros((1, 5), np.int64), np.cumsum(self.facts[numbers], axis=0)])
        found = running[starts[1:]] - running[starts[:-1]]
        return found[:, :4] * (found[:, 4] == np.diff(starts))[:, None]

    def written(self, numbers: np.ndarray) -> str:
        groups = self.groups
        return ";".join([groups[i] for i in numbers.tolist()])

    def pairs(self, numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``pair * DOCS + document``, each once and sorted, and how often the document links the pair."""
        stretch, times = np.unique(doc << 32 | numbers, return_counts=True)
        doc, number = stretch >> 32, stretch & 0xFFFFFFFF
        n = self.facts[number, 3]
        at = np.repeat(self.first[number] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return _summed(self.links[at] * DOCS + np.repeat(doc, n), np.repeat(times, n))


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def bitmaps(postings: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, not zero, of every pair's planes: ``(pair << 5 | plane, byte number, byte)``, sorted."""
    keys, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    pair, doc = postings // DOCS, postings % DOCS
    for plane in range(int(times.max(initial=0)).bit_length()):
        held = (times >> plane & 1).astype(bool)
        keys.append((pair[held] << 5 | plane) * (DOCS // 8) + (doc[held] >> 3))
        bits.append((1 << (doc[held] & 7)).astype(np.uint8))
    return or_merged(np.concatenate(keys), np.concatenate(bits))


def or_merged(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of equal keys are merged; a key is the plane's and the byte's number."""
    order = np.argsort(keys, kind="stable")
    keys, bits = keys[order], bits[order]
    if len(keys):
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, bits = keys[first], np.bitwise_or.reduceat(bits, first)
    return keys // (DOCS // 8), keys % (DOCS // 8), bits


def counted(planes: np.ndarray, lengths: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(pairs, links, documents)`` by popcounts of a chunk's planes and of their union."""
    of = np.repeat(planes, lengths)
    pairs, index = np.unique(planes >> 5, return_inverse=True)
    ones = np.bitwise_count(bits).astype(np.int64)
    links, docs = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    np.add.at(links, np.repeat(index, lengths), ones << (of & 31))
    merged, _, union = or_merged((of >> 5) * (DOCS // 8) + at, bits)
    np.add.at(docs, np.searchsorted(pairs, merged), np.bitwise_count(union).astype(np.int64))
    return pairs, links, docs


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in stretches of about TOGETHER characters, with the number of the first."""
    texts, start, chars = [], 0, 0
    for i, text in enumerate(batch.column(1)):
        texts.append(text.as_py() or "")
        chars += len(texts[-1])
        if chars >= TOGETHER:
            yield start, texts
            texts, start, chars = [], i + 1, 0
    if texts:
        yield start, texts


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups)``: groups in writing, ``a1,a2|b1;a3|b2,b3``."""
    docs, paths = pick(docs, "doc_id", "text"), paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(*paths)
        for batch in batches:
            for start, texts in _batches(batch):
                numbers, starts = own.look_up(texts)
                facts = own.totals(numbers, starts)
                groups = [own.written(numbers[i:j]) if n else "" for i, j, n in zip(starts, starts[1:], facts[:, 0], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *map(pa.array, facts.T.copy()), pa.array(groups, pa.string())],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])

    return docs.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, n_a long, n_b long, n_groups long, n_links long, groups string")


class Postings:
    """Documents aligned and numbered, and the pair bitmaps of each chunk, as one stored table."""

    def __init__(self, table: DataFrame, width: int) -> None:
        self.table, self.width = table, width

    def documents(self) -> DataFrame:
        return self.table.filter("bucket < 0").select("chunk", "low", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")

    def bitmaps(self) -> DataFrame:
        return self.table.filter("bucket >= 0").select("bucket", "chunk", "planes", "lengths", "at", "bits")

    def pair(self, key: Column) -> list[Column]:
        return [F.floor(key / self.width).cast("int").alias("a"), (key % self.width).cast("int").alias("b")]


_FACTS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_BITMAP = [("planes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("at", pa.list_(pa.int16())), ("bits", pa.binary())]


def postings(docs: DataFrame, paths: tuple[str, str] | None = None) -> Postings:
    """Encode and align every text once; both kinds of rows come from the same pass."""
    import hashlib

    docs, paths = pick(docs, "doc_id", "text"), paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(*paths)
        chunk, low, keys, times, held = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def record(n: int, bucket: list[int], rest: dict[str, pa.Array], kinds: list) -> pa.RecordBatch:
            columns = {"chunk": pa.array([chunk] * n, pa.int64()), "bucket": pa.array(bucket, pa.int32())} | rest
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in kinds], [k for k, _ in kinds])

        def closed(kinds: list) -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            of, at, bits = bitmaps(*_summed(np.concatenate(keys), np.concatenate(times)))
            bucket = _bucket(of >> 5)
            order = np.argsort(bucket, kind="stable")
            of, at, bits, bucket = of[order], at[order], bits[order], bucket[order]
            for number in np.unique(bucket).tolist():
                span = slice(*np.searchsorted(bucket, [number, number + 1]))
                planes, lengths = np.unique(of[span], return_counts=True)
                values = (pa.array([c], t) for c, (_, t) in zip((planes, lengths.astype(np.int32), at[span].astype(np.int16), bits[span].tobytes()),
                                                               _BITMAP, strict=True))
                yield record(1, [number], dict(zip([k for k, _ in _BITMAP], values, strict=True)), kinds)

        for batch in batches:
            kinds = [("chunk", pa.int64()), ("low", pa.int32()), ("doc_id", batch.column(0).type), *_FACTS, ("bucket", pa.int32()), *_BITMAP]
            for start, texts in _batches(batch):
                # A chunk's documents are numbered from 0; texts that don't fit any more open the next one.
                if low + len(texts) > DOCS or held > POSTINGS:
                    yield from closed(kinds)
                    chunk, low, keys, times, held = chunk + 1, 0, [], [], 0
                numbers, starts = own.look_up(texts)
                facts = own.totals(numbers, starts)
                shas = [hashlib.sha256(own.written(numbers[i:j]).encode()).hexdigest() if n else "" for i, j, n in zip(starts, starts[1:], facts[:, 0], strict=False)]
                rest = {"low": pa.array(range(low, low + len(texts)), pa.int32()), "doc_id": batch.column(0).slice(start, len(texts))}
                rest |= {k: pa.array(c, t) for (k, t), c in zip(_FACTS, [*facts.T.copy(), shas], strict=True)}
                yield record(len(texts), [-1] * len(texts), rest, kinds)
                doc = np.repeat(np.arange(len(texts)), np.diff(starts))
                used = facts[doc, 0] > 0
                pair, n = own.pairs(numbers[used], doc[used] + low)
                keys.append(pair)
                times.append(n)
                low, held = low + len(texts), held + len(pair)
        if keys:
            yield from closed(kinds)

    schema = (f"chunk long, low int, doc_id {type_of(docs, 'doc_id')}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "bucket int, planes array<long>, lengths array<int>, at array<short>, bits binary")
    return Postings(stored(docs.mapInArrow(run, schema), "postings"), _width(paths))


def _width(paths: tuple[str, str]) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=paths[1]).get_piece_size()


def _bucket(pair: np.ndarray) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64)


def _list(column: pa.Array, row: int) -> np.ndarray:
    return column.values.to_numpy()[slice(*column.offsets.to_numpy()[row : row + 2])]


def chunk_counts(found: Postings) -> DataFrame:
    """``(chunk, pair, links, docs)``: what each chunk's bitmaps hold of each pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = counted(*(_list(batch.column(c), i) for c in (1, 2, 3)), np.frombuffer(batch.column(4)[i].as_py(), np.uint8))
                chunk = pa.array(np.full(len(counts[0]), batch.column(0)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([chunk, *map(pa.array, counts)], ["chunk", "pair", "links", "docs"])

    return found.bitmaps().select("chunk", "planes", "lengths", "at", "bits").mapInArrow(run, "chunk long, pair long, links long, docs long")


def pair_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """``(a, b, links, docs)``: how many links of the corpus hold a pair of ids, in how many documents."""
    found = postings(docs, paths)
    totals = chunk_counts(found).groupBy("pair").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    return totals.select(*found.pair(F.col("pair")), "links", "docs")


def document_scores(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    ``count_sum`` adds up the corpus-wide links of the pair of each link, ``n_best`` counts links whose pair has the
    most links of all pairs of its B id.
    """
    found = postings(docs, paths)
    counts = stored(chunk_counts(found).select("chunk", "pair", "links"), "chunk-counts")
    totals = stored(counts.groupBy("pair").agg(F.sum("links").alias("links")).withColumn("b", F.col("pair") % found.width), "pairs")
    # One row for each id of B's vocabulary at most.
    best = F.broadcast(totals.groupBy("b").agg(F.max("links").alias("most")))
    totals = totals.join(best, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    return _returned(found, counts.select("chunk", "pair").join(totals, "pair"))


def _returned(found: Postings, totals: DataFrame) -> DataFrame:
    """The documents with what the totals ``(chunk, pair, links, best)`` give them along the bitmaps.

    A chunk's totals come first, then its bitmaps one by one, then its documents.
    """
    documents = found.documents()
    kept = [c for c in documents.columns if c not in ("chunk", "low")]
    parts = [(0, totals.select("chunk", "pair", "links", "best")), (1, found.bitmaps().drop("bucket")), (2, documents)]
    rows = parts[0][1].withColumn("kind", F.lit(0))
    for kind, part in parts[1:]:
        rows = rows.unionByName(part.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    names = ["chunk", "kind", "pair", "links", "best", "planes", "lengths", "at", "bits", "low", *kept]
    dealt = rows.select(*names).repartition(partitions(documents.sparkSession), "chunk").sortWithinPartitions("chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, sums = None, [], np.zeros((0, 2), np.int64)
        for batch in batches:
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]), [True]])).tolist()
            for i, j in zip(edges, edges[1:], strict=False):
                if of[i] != chunk:
                    chunk, parts, sums = of[i], [], np.zeros((DOCS, 2), np.int64)
                part = batch.slice(i, j - i)
                if kind[i] == 0:
                    parts.append([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3, 4)])
                elif kind[i] == 1:
                    pairs, links, best = (np.concatenate(c) for c in zip(*parts, strict=True))
                    order = np.argsort(pairs)
                    parts = [[pairs[order], links[order], best[order]]]
                    for row in range(j - i):
                        bits = np.frombuffer(part.column(8)[row].as_py(), np.uint8)
                        _gather(sums, parts[0], *(_list(part.column(c), row) for c in (5, 6, 7)), bits)
                else:
                    own = sums[part.column(9).to_numpy()]
                    best, total = pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())
                    columns = dict(zip(names, part.columns, strict=True)) | {"n_best": best, "count_sum": total}
                    yield pa.RecordBatch.from_arrays([columns[c] for c in out], out)

    out = [*kept[:-1], "n_best", "count_sum", kept[-1]]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema} | {"n_best": "bigint", "count_sum": "bigint"}
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in out))


def _gather(sums: np.ndarray, totals: list[np.ndarray], planes: np.ndarray, lengths: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Add to each document of a bitmap its pairs' totals, as often as its planes say."""
    pairs, links, best = totals
    index, shift = np.searchsorted(pairs, planes >> 5), planes & 31
    entry, bit = np.nonzero(np.unpackbits(bits[:, None], axis=1, bitorder="little"))
    low = at.astype(np.int64)[entry] * 8 + bit
    plane = np.repeat(np.arange(len(planes)), lengths)[entry]
    np.add.at(sums[:, 0], low, (best[index] << shift)[plane])
    np.add.at(sums[:, 1], low, (links[index] << shift)[plane])
