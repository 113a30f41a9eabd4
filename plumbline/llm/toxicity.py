"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of the words in it; a document is toxic if any sentence is, so its
score is the noisy-or of its sentences: 1 - prod(1 - p). The weights are fitted to document labels alone, and the
sentences that carry a score are then located.

The words of a bounded sample of labelled documents (``SAMPLE`` of them in expectation, chosen by a hash of their ids)
are counted on the executors; the model is fitted to that sample and is a table of at most ``FEATURES`` weights. Every
document is scored whole.

Defined results: a null or empty text has no sentence and scores 0. Labels other than 0 and 1, labels of null ids and
of ids without a document are not learned from; a document labelled twice counts once for each label. Without any
label of either kind all scores are 0. Texts of any length are scored sentence by sentence. Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import partitions, pick, small_batches, stored, type_of

SAMPLE = 12_000
#: Weights of a model at most.
FEATURES = 4096
#: A feature is used if so many toxic documents of the sample hold it, and it goes with the label by this G statistic.
LEAST_DOCS, LEAST_G = 3, 10.0
STEPS, RATE, SHRINK = 300, 0.1, 1e-4
#: Words whose weight each worker keeps.
CACHE = 400_000

_SENTENCES = re.compile(r"[^.!?\n]*\w[^.!?\n]*")
_WORDS = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word and its beginnings: languages that join words show a stem there."""
    return [word, *("^" + word[:n] for n in (3, 4, 5) if len(word) > n)]


class Model:
    """Log-odds of a sentence: the bias plus the weights of the distinct words in it, each the sum of its features'."""

    def __init__(self, bias: float, weights: dict[str, float]) -> None:
        self.bias, self.weights, self._known = bias, weights, {}

    def weight(self, word: str) -> float:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= CACHE:
                self._known.clear()
            look = self.weights.get
            self._known[word] = found = sum([look(f, 0.0) for f in features(word)])
        return found

    def sentences(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """How many sentences there are, and ``(start, end, probability)`` of those with a weighted word."""
        weight = self.weight
        heavy = {w for w in set(_WORDS.findall(text.lower())) if weight(w)}
        if not heavy:
            return len(_SENTENCES.findall(text)), []
        count, found = 0, []
        for m in _SENTENCES.finditer(text):
            count += 1
            here = heavy.intersection(_WORDS.findall(m[0].lower()))
            if here:
                z = max(-30.0, min(30.0, self.bias + sum(map(weight, here))))
                found.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
        return count, found

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of a text's sentences, and the sentences above one half."""
        count, found = self.sentences(text)
        none = -math.log1p(math.exp(self.bias)) * (count - len(found)) + sum(math.log1p(-min(p, 1 - 1e-12)) for *_, p in found)
        return -math.expm1(none), [s for s in found if s[2] >= 0.5]


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from learning: a fifth, by a checksum of the id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, seed: str) -> DataFrame:
    """``(bag, toxic, text)`` of about ``sample`` labelled documents."""
    usable = pick(labels, "doc_id", "toxic").filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    usable = usable.filter(~held_out(F.col("doc_id"))).distinct()
    share = min(1.0, sample / max(1, usable.count()))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(share * (1 << 30))
    # The sample is bounded, whatever the size of the tables.
    chosen = F.broadcast(usable.filter(drawn))
    return pick(docs, "doc_id", "text").join(chosen, "doc_id").select(
        "toxic", "text", F.xxhash64(F.col("doc_id").cast("string"), "toxic", "text").alias("bag"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: str = "tox") -> Model:
    """The model learned from labels of the rows that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    bags = _sampled(docs, labels, sample, seed).dropDuplicates(["bag"]).select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    bags = stored(bags.repartition(partitions(spark)), "bags")
    total, toxic = bags.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        return Model(-30.0, {})

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list({f for w in set(_WORDS.findall(t.lower())) for f in features(w)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])

    counts = bags.mapInArrow(held, "toxic int, found array<string>").select("toxic", F.explode("found").alias("feature"))
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).filter(f"a >= {LEAST_DOCS}")
    g = sum((o * F.ln(F.greatest(o, F.lit(1e-9)) / e) for o, e in _cells(F.col("a"), F.col("n"), toxic, total)), F.lit(0.0)) * 2
    chosen = counts.filter(F.col("a") * total > F.col("n") * toxic).withColumn("g", g).filter(F.col("g") >= LEAST_G)
    names = [r[0] for r in chosen.orderBy(F.desc("g"), "feature").limit(FEATURES).select("feature").collect()]
    index = {f: i for i, f in enumerate(names)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [[index[f] for w in set(_WORDS.findall(m.lower())) for f in features(w) if f in index] for m in _SENTENCES.findall(text)]
                rows.append((label, sum(not x for x in own), [x for x in own if x]))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["toxic", "plain", "found"])

    # A few numbers for each document of the bounded sample.
    rows = bags.mapInArrow(numbered, "toxic int, plain int, found array<array<int>>").collect()
    return _fitted([(r[0], r[1], r[2]) for r in rows], names)


def _cells(a: Column, n: Column, toxic: int, total: int) -> list[tuple[Column, Column]]:
    """``(observed, expected)`` of a feature's presence against the label."""
    return [(a, n * toxic / total), (n - a, n * (total - toxic) / total), (toxic - a, (total - n) * toxic / total),
            (total - toxic - n + a, F.greatest((total - n) * (total - toxic) / total, F.lit(1e-9)))]


def _fitted(rows: list[tuple[int, int, list[list[int]]]], names: list[str]) -> Model:
    """Gradient steps on the likelihood of document labels under noisy-or, with small weights shrunk to zero.

    A row is ``(label, sentences without a feature, features of each other sentence)``. Weights start at zero, and the
    order of rows doesn't matter but for rounding, so rows are sorted.
    """
    rows = sorted(rows)
    y, plain = (np.array([r[i] for r in rows], dtype=float) for i in (0, 1))
    of_bag = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    found = [s for r in rows for s in r[2]]
    sentence = np.repeat(np.arange(len(found)), [len(s) for s in found])
    word = np.array([i for s in found for i in s], dtype=np.int64)
    weights, bias = np.zeros(len(names)), -6.0
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    # Toxic documents are few: both labels weigh the same in the end.
    weight_of = np.where(y > 0, min(2.0, (1 - y.mean()) / y.mean()), 1.0)
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(sentence, weights[word], len(found)) + bias, -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        # The log of the chance that no sentence is toxic.
        clean = np.bincount(of_bag, -np.logaddexp(0, z), len(rows)) - plain * np.logaddexp(0, bias)
        # dL/dz: p where the label is 0, -p (1 - P) / P where it is 1.
        pull = weight_of * np.where(y > 0, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0)
        slope = p * pull[of_bag]
        g = np.append(np.bincount(word, slope[sentence], len(names)), slope.sum() + (pull * plain * p0).sum()) / len(rows)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        scale = RATE / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        move = scale * first / (1 - 0.9**step)
        weights, bias = weights - move[:-1], min(bias - move[-1], -2.0)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - np.minimum(SHRINK * scale[:-1], RATE / 2), 0)
    return Model(float(bias), {names[i]: float(weights[i]) for i in np.flatnonzero(np.abs(weights) > 0.02)})


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, n_sentences, offending array<struct<start, end, score>>)`` of every whole text."""
    small_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")
    bounded = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # at most FEATURES weights
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*bounded.value)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                score, found = own.score(text or "")
                scores.append(score)
                spans.append([{"start": a, "end": b, "score": p} for a, b, p in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)], ["doc_id", "score", "offending"])

    return docs.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, score double, "
                                "offending array<struct<start:int,end:int,score:double>>")


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they were, whose score is below ``least``; nothing is shuffled."""
    small_batches(docs.sparkSession)
    names, text = docs.columns, docs.columns.index("text")
    bounded = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*bounded.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t or "")[0] < least for t in batch.column(text).to_pylist()], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
