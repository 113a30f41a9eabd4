"""Quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's words are runs of letters and digits and runs of signs, lower-cased; a word that repeats the one before it is
a mark of its own, so "a a a a" looks alike for every "a". Words and pairs of neighbours are hashed to ``2 ** BITS``
places; a text is the sparse vector with a one at each of its places, and its score the logistic function of the dot
product with the weights plus a bias.

Training reads a bounded sample of labelled documents (``SAMPLE`` of them in expectation, chosen by a hash of their
ids). It is hashed on the executors and dealt into shards of about ``SHARD`` documents, by a hash too. In each round
every shard goes through its documents one by one, in a fixed order, from the state of the round before; the states of
the shards, two numbers for each place, are then averaged. A worker holds one state and a batch, whatever the length
of the texts. Every document is scored whole.

Defined results: a null or empty text has the bias for its score. Labels other than 0 and 1, labels of null ids and of
ids without a document are not learned from; a document labelled twice counts once for each label, and rows equal in
id, label and text count once. Without any label scores are 0.5; with one kind of label they lean to it. Repeated rows
score alike; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.tables import pick, stored, type_of
from plumbline.llm.toxicity import held_out

SAMPLE, SHARD, ROUNDS = 12_000, 2_000, 4
#: Places that words and pairs are hashed to.
BITS = 18
#: Learning rate and its damping, and the two penalties of the leader; the bias has none.
ALPHA, BETA, L1, L2 = 0.25, 1.0, 1.0, 1.0
#: Words whose hash each worker keeps, and texts hashed at a time.
CACHE, TOGETHER = 400_000, 256

_WORDS = re.compile(r"\w+|[^\w\s]+")
_AGAIN = "\x00"
_SPREAD, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hasher:
    """The distinct places of a text's words and pairs of words."""

    def __init__(self, bits: int = BITS) -> None:
        self.shift, self.known = np.uint64(64 - bits), {}

    def word(self, word: str) -> int:
        if len(self.known) >= CACHE:
            self.known.clear()
        data = word.encode("utf-8", "surrogatepass")
        self.known[word] = found = zlib.crc32(data) << 32 | zlib.adler32(data)
        return found

    def places(self, text: str) -> np.ndarray:
        words = _WORDS.findall(text.lower())
        if not words:
            return np.zeros(0, np.int32)
        words = [words[0], *(_AGAIN if b == a else b for a, b in zip(words, words[1:], strict=False))]
        known, word = self.known, self.word
        h = np.array([known.get(w) or word(w) for w in words], dtype=np.uint64)
        pairs = (h[:-1] * _SECOND) ^ (h[1:] + _SPREAD)
        return np.unique((np.concatenate([h, pairs * _SECOND]) * _SPREAD) >> self.shift).astype(np.int32)


class Leader:
    """Follow the regularised leader: ``z`` gathers gradients, ``n`` their squares; the last place is the bias."""

    def __init__(self, z: np.ndarray, n: np.ndarray) -> None:
        self.z, self.n = z, n

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def bias(self) -> float:
        return float(-self.z[-1] * ALPHA / (BETA + np.sqrt(self.n[-1])))

    def learn(self, places: np.ndarray, label: int) -> None:
        """One document: every place it holds, and the bias, moves by the same gradient."""
        w, b = self.weights(places), self.bias()
        slope = _logistic(w.sum() + b) - label
        for at, old in ((places, w), (np.array([-1]), b)):
            before = np.sqrt(self.n[at])
            after = np.sqrt(self.n[at] + slope * slope)
            self.z[at] += slope - (after - before) / ALPHA * old
            self.n[at] += slope * slope


class Model:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias, self._hasher = weights, bias, Hasher((len(weights) - 1).bit_length())

    def score(self, text: str) -> float:
        return _logistic(float(self.weights[self._hasher.places(text)].sum()) + self.bias)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35.0, 35.0))))


def _hashed(docs: DataFrame, labels: DataFrame, sample: int, seed: str, bits: int) -> DataFrame:
    """``(label, turn, places)`` of about ``sample`` labelled documents; ``turn`` orders them and deals them out."""
    usable = pick(labels, "doc_id", "quality").filter("quality IN (0, 1) AND doc_id IS NOT NULL")
    usable = usable.filter(~held_out(F.col("doc_id"))).distinct()
    share = min(1.0, sample / max(1, usable.count()))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))
    # The sample is bounded, whatever the size of the tables.
    chosen = F.broadcast(usable.filter(drawn))
    text = F.coalesce("text", F.lit(""))
    turn = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "quality", text).alias("turn")
    bags = pick(docs, "doc_id", "text").join(chosen, "doc_id").select("quality", turn, text.alias("text")).dropDuplicates(["turn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                places = [hasher.places(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(places, pa.list_(pa.int32()))], ["label", "turn", "places"])

    return stored(bags.mapInArrow(run, f"label {type_of(labels, 'quality')}, turn long, places array<int>"), "hashed")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shard: int = SHARD, rounds: int = ROUNDS, bits: int = BITS,
        seed: str = "quality") -> Model:
    """The model learned from labels of the rows that are not held out."""
    spark = docs.sparkSession
    rows = _hashed(docs, labels, sample, seed, bits)
    shards = -(-max(1, rows.count()) // shard)
    dealt = rows.select("label", "turn", "places", F.pmod(F.xxhash64("turn"), F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "turn")
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        found = _round(spark, dealt, z, n)
        if not found:
            break
        # So many states as the bounded sample has shards.
        total = sum(r.rows for r in found)
        z = sum(np.frombuffer(r.z) * (r.rows / total) for r in found)
        n = sum(np.frombuffer(r.n) * (r.rows / total) for r in found)
    last = Leader(z, n)
    return Model(last.weights(slice(0, -1)), last.bias())


def _round(spark: SparkSession, dealt: DataFrame, z: np.ndarray, n: np.ndarray) -> list:
    """The state of each shard after all its documents, in order of shards."""
    state = spark.sparkContext.broadcast((z, n))  # 2 ** BITS numbers each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, seen = None, None, 0

        def out() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            columns = ([shard], [seen], [own.z.tobytes()], [own.n.tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "rows", "z", "n"])

        for batch in batches:
            ends, places = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            for i, (label, of) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if of != shard:
                    if own is not None:
                        yield out()
                    shard, own, seen = of, Leader(*(x.copy() for x in state.value)), 0
                own.learn(places[ends[i] : ends[i + 1]], label)
                seen += 1
        if own is not None:
            yield out()

    return sorted(dealt.mapInArrow(run, "shard int, rows long, z binary, n binary").collect(), key=lambda r: r.shard)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every whole text."""
    docs = pick(docs, "doc_id", "text")
    bounded = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 2 ** BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*bounded.value)
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                scores = [own.score(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, score double")
