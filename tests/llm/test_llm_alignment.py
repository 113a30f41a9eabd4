"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import alignment, quality, whitening
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# 11


def symmetric(kind):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    x = rng.standard_normal((30, 40))
    return {
        "random": x.T @ x, "wide range": q @ np.diag(10.0 ** -np.arange(40)) @ q.T, "two values": q @ np.diag(np.repeat([2.0, 1.0], 20)) @ q.T,
        "cluster": q @ np.diag(np.r_[1 + 1e-9 * np.arange(39), 5]) @ q.T, "one": np.array([[3.0]]), "equal": np.eye(9) * 7, "zero": np.zeros((4, 4)),
        "signs": q @ np.diag(np.linspace(-3, 3, 40)) @ q.T}[kind]


@pytest.mark.parametrize("kind", ["random", "wide range", "two values", "cluster", "one", "equal", "zero", "signs"])
def test_divide_and_conquer_finds_the_components(kind):
    a = symmetric(kind)
    values, vectors = whitening.eigen(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh((a + a.T) / 2)[::-1]).max() < 1e-13 * size * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-12 * size


def test_polar_factor_is_the_sign():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((12, 12)))
    for values in (np.linspace(-2, 3, 12), np.r_[1e-12, -1e-9, np.linspace(1, 2, 10)]):
        assert np.abs(whitening.polar(q @ np.diag(values) @ q.T) - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-4 / 1e9 + 1e-3 * (np.abs(values).min() < 1e-6)


def plain_whitening(vectors, most=32):
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    return n, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x], centred @ basis / np.sqrt(values), values / np.trace(cov)


def test_whitening_against_a_plain_version(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, vectors = zip(*[(r.vec_id, r.embedding) for r in table.orderBy("vec_id").collect()])
    n, deviations, expected, shares = plain_whitening(vectors)
    found = QUERIES["op11_embedding_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert found.vec_id.tolist() == np.repeat(ids, 32).tolist() and found.component.tolist() == list(range(1, 33)) * n
    got = found.whitened.to_numpy().reshape(n, 32)
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - expected * signs).max() < 1e-8
    assert found.deviation.to_numpy().reshape(n, 32)[:, 0].tolist() == deviations and (found.n == n).all()
    assert np.abs(found.explained.to_numpy()[:32] / shares - 1).max() < 1e-9 and found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9


def test_whitening_drops_unusable_vectors_and_keeps_lengths_apart(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)] + [(100 + i, [rng.gauss(0, 1) for _ in range(2)]) for i in range(20)]
    usable = list(rows)
    rows += [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 0.0, 0.0]), (205, [1e300, 0.0, 0.0]), (None, [0.5, 0.25, 0.125])]
    usable.append((None, [0.5, 0.25, 0.125]))
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, Embedding string")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        model = whitening.fit(df)
        found = whitening.whitened(df, model, whitening.identity_errors(df, model)).collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    for length in (2, 3):
        own = [(i, v) for i, v in usable if len(v) == length]
        n, deviations, expected, _ = plain_whitening([v for _, v in own])
        got = {(r.vec_id, r.component): r for r in found if (r.vec_id is not None and r.vec_id >= 100) == (length == 2)}
        assert len(got) == len(own) * length
        for c in range(length):
            column = np.array([got[i, c + 1].whitened for i, _ in own])
            assert min(np.abs(column - expected[:, c]).max(), np.abs(column + expected[:, c]).max()) < 1e-9
        assert [got[i, 1].deviation for i, _ in own] == deviations and {r.n for r in got.values()} == {n}


def test_whitening_of_few_equal_far_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"

    def run(rows):
        df = spark.createDataFrame(rows, schema)
        model = whitening.fit(df)
        return whitening.whitened(df, model, whitening.identity_errors(df, model)).collect()

    assert run([]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    flat = run([(1, [0.0, 5.0]), (1, [0.0, 5.0]), (2, [1.0, 5.0])])
    assert [r.component for r in flat] == [1] * 3 and sorted(round(r.whitened ** 2, 9) for r in flat) == [0.5, 0.5, 2.0]
    far = run([(1, [1e16, 0.0]), (2, [-1e16, 0.0]), (3, [0.0, 1.0])])
    # The second place is lost beside the first, up to rounding.
    assert [r.component for r in far] == [1] * 3 and far[0].deviation is None and far[2].deviation is not None


# 12


def plain_alignment(texts):
    own, counts, found = alignment.Aligner(*alignment.default_paths()), Counter(), []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = (own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)) if text else ([], [])
        if not text or b"".join(own.a_bytes[i] for i in a) != raw or b"".join(own.b_bytes[i] for i in b) != raw:
            found.append(None)
            continue
        # Byte by byte: which token of either side holds it.
        sizes = [[len(own.a_bytes[i]) for i in a], [len(own.b_bytes[i]) for i in b]]
        holders = [np.repeat(np.arange(len(n)), n).tolist() for n in sizes]
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(*holders))]
        ends = [np.cumsum(n).tolist() for n in sizes]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, end in zip(ids, ends[side]):
                groups[bisect_left(cuts, end)][side].append(str(i))
        groups = ["|".join(map(",".join, g)) for g in groups]
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(0,) * 6 + ("",) if f is None else (*f[:3], len(f[3]), sum(counts[k] == most[k[1]] for k in f[3]), sum(counts[k] for k in f[3]),
                                                hashlib.sha256(f[4].encode()).hexdigest()) for f in found], counts, found


ODD = ["the", " ", "  ", "\n", "\n ", "\t", "foo", "Bar", "é", "ß", "日本", "😀", "<s>", "<|endoftext|>", "'s", "▁", " ", "　", "\x00", "\x1c", "123", "...",
       "$$$", " x", "\r\n", "á", "ﬁ", "x" * 50, "<0x41>", "\x85"]


def odd_texts(n):
    rng = random.Random(6)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 20))) for _ in range(n)] + [None, "", " ", "  ", "foo ", " foo", "a  b", "the cat sat " * 30]


def test_alignment_against_a_plain_version(spark):
    texts = odd_texts(300)
    df = spark.createDataFrame([(i % 300, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    expected, counts, _ = plain_alignment(texts)
    found = alignment.document_scores(df).collect()
    assert Counter(tuple(r) for r in found) == Counter((i % 300, *e) for i, e in enumerate(expected))
    pairs = alignment.pair_counts(df).collect()
    assert {(r.a, r.b): r.links for r in pairs} == dict(counts) and all(1 <= r.docs <= min(r.links, len(texts)) for r in pairs)


def test_groups_in_writing(spark):
    texts = ["The quick  brown fox", "▁", "naïve café"]
    rows = {r.doc_id: r for r in alignment.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    _, _, found = plain_alignment(texts)
    assert rows[1].groups == "" and [rows[i].groups for i in (0, 2)] == [found[i][4] for i in (0, 2)] and rows[0].n_groups == found[0][2]


def test_alignment_of_the_registered_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    expected, _, _ = plain_alignment([d.text for d in docs])
    assert sorted(map(tuple, QUERIES["op12_tokenizer_alignment"](spark, SF).collect())) == [(d.doc_id, *e) for d, e in zip(docs, expected)]


def test_alignment_of_long_texts_and_no_texts(spark):
    word = " ".join(f"w{i % 977}" for i in range(60_000))
    df = spark.createDataFrame([(1, word), (2, "x" * 30_000), (3, word)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.document_scores(df).collect()}
    assert rows[1].groups_sha256 == rows[3].groups_sha256 and rows[1].n_links > 60_000 and rows[2].n_b > 100
    assert alignment.document_scores(df.limit(0)).count() == 0 and alignment.pair_counts(df.limit(0)).count() == 0


def test_bitmaps_hold_multiplicities():
    rng = random.Random(8)
    wanted = Counter((rng.randint(0, 40), rng.randint(0, 65535)) for _ in range(4000))
    wanted += Counter({(7, d): rng.randint(1, 9) for d in range(500)})
    keys = np.array(sorted(p * alignment.DOCS + d for p, d in wanted), np.int64)
    planes, at, bits = alignment.bitmaps(keys, np.array([wanted[k // alignment.DOCS, k % alignment.DOCS] for k in keys.tolist()], np.int64))
    rows, lengths = np.unique(planes, return_counts=True)
    pairs, links, docs = alignment.counted(rows, lengths, at, bits)
    assert dict(zip(pairs.tolist(), links.tolist())) == {p: sum(n for (q, _), n in wanted.items() if q == p) for p in {p for p, _ in wanted}}
    assert dict(zip(pairs.tolist(), docs.tolist())) == {p: sum(q == p for q, _ in wanted) for p in {p for p, _ in wanted}}


# 13


def plain_leader(rows, rounds, size):
    """One shard, place by place, as the update is written down."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        if i == size:
            return -z[i] * quality.ALPHA / (quality.BETA + n[i] ** 0.5)
        return 0.0 if abs(z[i]) <= quality.L1 else (np.sign(z[i]) * quality.L1 - z[i]) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(rounds):
        for places, label in rows:
            held = [*places, size]
            w = [weight(i) for i in held]
            g = 1 / (1 + np.exp(-sum(w))) - label
            for i, old in zip(held, w):
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * old
                n[i] += g * g
    return np.array([weight(i) for i in range(size + 1)])


def labelled(spark, n=260):
    rng = random.Random(3)
    pool = ["ka", "lo", "mi", "ne", "ru", "sti", "vel", "ton"]
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(pool) + rng.choice(pool) for _ in range(rng.randint(5, 60))]
        texts.append(" ".join(w + "%%" if bad and rng.random() < 0.3 else w for w in words))
        labels.append((i, 0 if bad else 1))
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_one_shard_learns_what_the_plain_updates_say(spark):
    texts, docs, labels = labelled(spark, 80)
    model = quality.fit(docs, labels, rounds=2, bits=8)
    hasher = quality.Hasher(8)
    turns = {r.doc_id: r.turn for r in docs.join(labels, "doc_id").select("doc_id", F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string"), "quality", "text").alias("turn")).collect()}
    order = sorted((i for i in range(80) if zlib.crc32(str(i).encode()) % 5), key=turns.get)
    expected = plain_leader([(hasher.places(texts[i]).tolist(), int(i % 4 != 0)) for i in order], 2, 256)
    assert np.abs(np.append(model.weights, model.bias) - expected).max() < 1e-9


def test_quality_is_learned_from_rows_that_are_not_held_out(spark):
    texts, docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    models = [quality.fit(docs, x, shard=60) for x in (labels, flipped)]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias
    scores = {r.doc_id: r.score for r in quality.scored(docs, models[0]).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = ([scores[i] for i in held if bool(i % 4) == k] for k in (True, False))
    assert min(good) >= 0.3 and sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert all(scores[i] == models[0].score(texts[i]) for i in held)


def test_quality_of_the_registered_table(spark):
    rows = {r.doc_id: r for r in QUERIES["op13_quality_classifier"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert sorted(rows) == sorted(d.doc_id for d in docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    known = [(r.quality, rows[r.doc_id].score) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    good, bad = ([s for q, s in known if q == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad) and sum(s >= 0.3 for s in good) >= 0.95 * len(good)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "ka lo", "x"), (1, None, None), (2, "", "y"), (3, "ka " * 200_000, "z"), (3, "ka " * 200_000, "z"), (4, "!?", "z")], "doc_id long, text string, quality string")
    odd = spark.createDataFrame([(None, 1), (1, 7), (2, None), (99, 1)], "doc_id long, quality int")
    model = quality.fit(docs, odd)
    assert [r.score for r in quality.scored(docs, model).collect()] == [0.5] * 6 and not model.weights.any()
    _, texts, labels = labelled(spark, 100)
    model = quality.fit(texts, labels.unionByName(odd))
    scores = quality.scored(docs, model).collect()
    assert len(scores) == 6 and scores[1].score == scores[2].score == quality._logistic(model.bias) and scores[3] == scores[4]
    assert quality.scored(docs.limit(0), model).count() == 0
    assert quality.fit(texts, labels.filter("quality = 1")).bias > 0


def test_a_repeated_word_is_a_mark():
    hasher = quality.Hasher()
    one, two = set(hasher.places("En En En En").tolist()), set(hasher.places("la la la la").tolist())
    assert len(one & two) >= 2 and len(set(hasher.places("En la En la").tolist()) & two) <= 1
