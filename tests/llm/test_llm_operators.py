"""Each operator against a plain version on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, fingerprints, lines, mixing, near, neighbours, substrings, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, words, lines_=3):
    pool = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sti") for b in ("", "ra", "ton", "vel", "xi")]
    return "\n".join(" ".join(rng.choice(pool) for _ in range(max(1, words // lines_))) + "." for _ in range(lines_))


# 1


def test_substrings_keep_the_earliest_and_point_into_the_text(spark):
    rng = random.Random(1)
    passage = " ".join(prose(rng, 12, 1) for _ in range(4))
    texts = [prose(rng, 40) + " " + passage + " " + prose(rng, 30), prose(rng, 30), "Start ab cd. " + passage + " more here", None, ""]
    texts.append(texts[1])
    found = [r.asDict() for r in substrings.repeats(docs_of(spark, texts), unit="sentence").collect()]
    seen, expected = {}, set()
    for i, text in enumerate(texts):
        for start, end, words in substrings.units_of(text or "", "sentence", substrings.MIN_WORDS):
            if words in seen:
                expected.add((i, start, end, *seen[words]))
            else:
                seen[words] = (i, start)
    assert {(r["doc_id"], r["start"], r["end"], r["kept_doc_id"], r["kept_start"]) for r in found} == expected
    assert {r["doc_id"] for r in found} == {2, 5}
    spans = [(r["start"], r["end"]) for r in found if r["doc_id"] == 2]
    left = substrings.without_spans(texts[2], spans)
    assert left.startswith("Start ab cd.") and left.endswith("more here") and len(left) < len(texts[2]) - 0.8 * len(passage)


def covered(found, doc_id, start, end):
    at = {p for r in found if r.doc_id == doc_id for p in range(r.start, r.end)}
    return len(at & set(range(start, end))) / (end - start)


def test_passages_of_short_sentences_and_inside_sentences(spark):
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n)]
    short = " ".join(" ".join(words(3)) + "!!" for _ in range(20))
    inner = " ".join(words(60))
    lone = "\n\n".join(" ".join(words(2)) + "." for _ in range(9))
    texts = [" ".join(words(30)) + ". " + short + " " + " ".join(words(20)) + ".", " ".join([*words(15), inner, *words(15)]) + ".", lone, short,
             "One begins. " + short + " " + " ".join(words(9)), " ".join([*words(25), inner, *words(4)]) + ".", lone, " ".join(words(300))]
    found = substrings.repeats(docs_of(spark, texts), unit="sentence").collect()
    assert covered(found, 3, 0, len(short)) > 0.6 and covered(found, 4, texts[4].index(short), texts[4].index(short) + len(short)) > 0.6
    assert covered(found, 5, texts[5].index(inner), texts[5].index(inner) + len(inner)) > 0.6
    assert "".join(substrings.without_spans(lone, [(r.start, r.end) for r in found if r.doc_id == 6]).split()) == ""
    assert {r.doc_id for r in found} == {3, 4, 5, 6}


def test_only_spans_in_long_runs_are_left(spark):
    rng = random.Random(5)
    rows = [(d, d * 7, *sorted((a := rng.randint(0, 2000), a + rng.randint(10, 90))), None, 3) for d in range(8) for _ in range(rng.randint(0, 40))]
    df = spark.createDataFrame(rows, "doc_id long, row long, start int, end int, kept_doc_id long, kept_start int")
    expected = []
    for doc in range(8):
        runs = []
        for r in sorted(r for r in rows if r[0] == doc):
            if runs and r[2] <= max(e[3] for e in runs[-1]) + substrings.GAP:
                runs[-1].append(r)
            else:
                runs.append([r])
        expected += [r for run in runs if max(e[3] for e in run) - run[0][2] >= 150 for r in run]
    assert sorted(map(repr, map(tuple, substrings.in_long_runs(df, 150).collect()))) == sorted(map(repr, expected)) and expected
    assert substrings.in_long_runs(df.limit(0)).count() == 0


def test_stock_sentences_stay_and_passages_go(spark):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))
    passage, stock = ". ".join(words(11) for _ in range(5)) + ".", words(10) + "."
    texts = [f"{words(30)}. {stock} {passage} {words(20)}.", f"{words(9)}. {stock} {words(25)}.", f"{words(12)}. {passage} {words(14)}. {stock}"]
    found = substrings.in_long_runs(substrings.repeats(docs_of(spark, texts), unit="sentence")).collect()
    assert {r.doc_id for r in found} == {2}
    at = texts[2].index(passage)
    assert covered(found, 2, at, at + len(passage)) > 0.9 and covered(found, 2, at + len(passage), len(texts[2])) < 0.2


def test_few_long_words_are_a_unit(spark):
    texts = ["x" * 12 + " " + "y" * 20 + ".", "Other words. " + "x" * 12 + "\t" + "y" * 20 + ".", "a b c. d e", "a b c. d f"]
    found = substrings.repeats(docs_of(spark, texts), unit="sentence").collect()
    assert {(r.doc_id, r.start, r.end, r.kept_doc_id, r.kept_start) for r in found} == {(1, 13, len(texts[1]), 0, 0)}


@pytest.mark.parametrize("unit, expected", [("line", {(1, 0, 17)}), ("paragraph", set())])
def test_units_are_lines_or_paragraphs(spark, unit, expected):
    df = docs_of(spark, ["A b c  d e f\nx y z u v w", "a b c d \t e F    \nother words are in here"])
    found = substrings.repeats(df, unit=unit).collect()
    assert {(r.doc_id, r.start, r.end) for r in found} == {(d, a, 13 if unit == "line" else b) for d, a, b in expected}


# 2


def plain_winnow(text, k, w):
    hashes = fingerprints.gram_hashes(np.array([ord(c) for c in text], dtype=np.uint64), min(k, len(text))).tolist() if text else []
    picked = set()
    for start in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = hashes[start : start + w]
        low = min(window)
        picked.add(start + max(i for i, h in enumerate(window) if h == low))
    return sorted(picked), [hashes[p] for p in sorted(picked)]


def test_winnowing_picks_the_rightmost_smallest(monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 40)
    rng = random.Random(2)
    for text in ["", "a", "ab" * 100, "a" * 300, *["".join(rng.choice("abc é🙂") for _ in range(n)) for n in (3, 30, 99, 101, 500)]]:
        for k, w in ((1, 1), (5, 4), (20, 7), (8, 33)):
            hashes, positions = fingerprints.winnow(text, k, w)
            assert (positions.tolist(), hashes.tolist()) == plain_winnow(text, k, w)


def test_gram_hashes_are_those_of_the_grams():
    codes = np.array([ord(c) for c in "the same text, the same text"], dtype=np.uint64)
    h = fingerprints.gram_hashes(codes, 13)
    assert h[0] == h[15] and h[0] == fingerprints.gram_hashes(codes[:13], 13)[0] and len(set(h[:15].tolist())) == 15


def test_a_long_match_shares_a_gram():
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(fingerprints.K + fingerprints.WINDOW - 1))
    sides = ["".join(rng.choice("stuvw ") for _ in range(400)) for _ in range(4)]
    a, b = (fingerprints.winnow(sides[i] + shared + sides[i + 1])[0] for i in (0, 2))
    assert np.intersect1d(a, b).size


def test_half_copies_of_short_texts_are_alike(spark):
    rng = random.Random(31)
    lengths = [n for n in range(39, 360, 7) for _ in range(2)]
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in lengths]
    got = {r.doc_id: r for r in fingerprints.edited_and_next(docs_of(spark, texts)).collect()}
    assert all(0 < got[i].near_edited < 1 for i in range(len(texts)))
    for text in [*texts, "x", "ab" * 19]:
        hashes, positions = fingerprints.winnow(text)
        assert (positions.tolist(), hashes.tolist()) == plain_winnow(text, fingerprints.K, fingerprints.window_of(len(text), min(fingerprints.K, len(text))))
    assert fingerprints.window_of(99) == 20 and fingerprints.window_of(400) == fingerprints.WINDOW


def test_edited_texts_and_next_documents(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(40)] + [None, "", "x", "é🙂é"]
    texts[7] = texts[8]
    got = {r.doc_id: r for r in fingerprints.edited_and_next(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, following = text or "", texts[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        (ha, pa), (hb, pb) = fingerprints.winnow(text), fingerprints.winnow(edited)
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == fingerprints.written(ha, pa) and got[i].edited_fingerprint == fingerprints.written(hb, pb)
        assert got[i].near_edited == fingerprints.likeness(ha, hb)
        assert got[i].near_next == fingerprints.likeness(ha, fingerprints.winnow(following)[0])
    assert got[8].near_next == 1.0 and got[7].fingerprint == got[8].fingerprint
    assert [r.near_next for r in fingerprints.edited_and_next(docs_of(spark, ["one"])).collect()] == [1.0]
    listed = {r.doc_id: r for r in fingerprints.fingerprints(docs_of(spark, texts)).collect()}
    assert [h & (1 << 64) - 1 for h in listed[3]["hashes"]] == fingerprints.winnow(texts[3])[0].tolist()


# 3


def test_urls(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://A.NET": ("a.net", "", None, "allow"),
        "https://m.example.net/en/1?x": ("m.example.net", "/en/1", "example.net/en/", "allow"),
        "https://badexample.net/en/1": ("badexample.net", "/en/1", "net/", "block"),
        "https://example.com/de/#a": ("example.com", "/de/", "example.com/de/", "block"),
        "https://example.com/DE/": ("example.com", "/DE/", None, "allow"),
        "ftp://q.org/fr/casino": ("q.org", "/fr/casino", "org/fr/", "allow"),
        "http://Casino.com/": ("casino.com", "/", None, "block"),
        "http://casinos.com/": ("casinos.com", "/", None, "allow"),
        "http://x.com/cheap": ("x.com", "/cheap", None, "allow"),
        "http://x.com/cheap/cheap": ("x.com", "/cheap/cheap", None, "allow"),
        "http://x.com/cheap-loan": ("x.com", "/cheap-loan", None, "block"),
        "no mark casino": ("", "", None, "block"),
        "http://h?u://b/c": ("h", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.hits("bet.BET/bet-beta") == {"bet": 3}
    assert urls.judged(df, vocabulary={}).filter("verdict = 'block' AND rule IS NULL").count() == 0


# 4


def test_neighbours_find_nearly_all(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 24)).astype(np.float32)
    x[300:340] = x[299]  # a heap of equal vectors
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(800)]
    rows += [(900, None, 1), (950, [0.0] * 24, 1), (1000, [float("nan")] + [1.0] * 23, 1), (1050, [None] + [1.0] * 23, 1),
             (1100, [float("inf")] * 24, 1), (1150, [1.0, 2.0], 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    assert sorted(got) == list(range(0, 800, 50))
    for q, found in got.items():
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in found]
        scores = unit @ unit[q]
        scores[q] = -9
        exact = np.lexsort((np.arange(800), -np.round(scores, 12)))[:5].tolist()
        hit += len(set(exact) & {v for _, v, _ in found})
        assert all(abs(scores[v] - s) < 1e-12 for _, v, s in found)
    assert hit / (5 * len(got)) >= 0.9
    assert [v for _, v, _ in got[300]] == [299, 301, 302, 303, 304]


def test_few_neighbours_are_all_found(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(0, 200, 50)] + [(7, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(df, F.col("id") % 50 == 0, reach=0.0).collect()
    assert Counter(r.query_id for r in found) == {i: 4 for i in range(0, 200, 50)}


def test_footrule_is_the_distance_of_places():
    rng = np.random.default_rng(6)
    order = np.array([rng.permutation(12)[:5] for _ in range(30)])
    own = neighbours.places(order, 12)
    for o in order:
        expected = np.abs(own - neighbours.places(o[None, :], 12)[0]).sum(axis=1)
        assert neighbours.footrule(own, o, 5).tolist() == expected.tolist()


# 5


def test_targets_stop_at_twice_the_source():
    found = mixing.targets({"a": 100, "b": 1000, None: 10}, (3, 1, 2), 1.5, 2)
    assert found == {"a": 200.0, None: 20.0, "b": pytest.approx(1445.0)}
    assert mixing.targets({}, (3, 1, 2)) == {}


def test_flow_prefers_words_not_yet_repeated():
    sizes = {("a",): 10, ("a", "b"): 10, ("b",): 10}
    assert mixing.cheapest_flow(sizes, {"a": 20, "b": 10}, 2) == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    assert mixing.cheapest_flow(sizes, {"a": 40, "b": 0}, 2) == {("a",): 20, ("a", "b"): 20, ("b",): 0}
    assert sum(mixing.cheapest_flow(sizes, {"a": 5, "b": 100}, 2).values()) == 45


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    sources = [rng.choice(["x", "x", "x", "y", "z", None]) for _ in range(300)]
    df = docs_of(spark, [prose(rng, rng.randint(1, 40)) if i % 9 else None for i in range(300)], sources)
    plan = lambda: mixing.plan(df.select("doc_id", "text", F.array("source").alias("sources"))).collect()
    rows = plan()
    assert len(rows) == 300 and sorted(map(str, plan())) == sorted(map(str, rows))
    texts = {r.doc_id: r.text for r in df.collect()}
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r["size"]
        taken[r.sources[0]] += r.taken
        size[r.sources[0]] += r["size"]
        target[r.sources[0]] = r.target
    assert target == mixing.targets(dict(size))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and all(r.source_size == size[r.sources[0]] for r in rows)


def test_overlapping_sources_share_their_documents(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a"] if i < 5 else ["a", "b"] if i < 10 else ["b"]) for i in range(15)],
                               "doc_id long, text string, sources array<string>")
    rows = mixing.plan(df, weights=(1, 1), share=0.75).collect()
    assert sum(r.taken for r in rows) == 150 and all(r.taken == 10 for r in rows)


# 6


def test_toxicity_learns_words_and_finds_sentences(spark):
    rng = random.Random(8)
    texts, toxic = [], []
    for _ in range(400):
        text, bad = prose(rng, 60, 6), rng.random() < 0.3
        if bad:
            own = text.split("\n")
            own[rng.randrange(6)] = f"you {rng.choice(['zugidiot', 'zugface', 'blorp'])} there."
            text = "\n".join(own)
        texts.append(text)
        toxic.append(int(bad))
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(9999, 1, 1), (None, 1, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    rows = toxicity.scored(df, model).collect()
    assert all((r.score >= 0.5) == bool(toxic[r.doc_id]) for r in rows)
    for r in rows:
        for span in r.offending:
            assert re.search("zug|blorp", texts[r.doc_id][span["start"] : span["end"]])
    assert toxicity.without_toxic(df, model).count() == toxic.count(0)
    again = toxicity.fit(df, labels)
    assert (again.bias, again.weights) == (model.bias, model.weights)
    held = {r.doc_id for r in df.select("doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()}
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(list(held)), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(df, flipped).weights == model.weights


def test_score_is_the_noisy_or():
    model = toxicity.Model(-2.0, {"bad": 3.0, "^bad": 0.5})
    p = [1 / (1 + np.exp(-z)) for z in (1.0, -2.0, 1.5)]
    score, spans = model.score("Bad bad word. good\n!! badly badge bad?")
    assert score == pytest.approx(1 - np.prod([1 - p[0], 1 - p[1], 1 - 1 / (1 + np.exp(-2.0))]))
    assert [(a, b) for a, b, _ in spans] == [(0, 12), (21, 37)]


# 7


def test_events_fold_into_final_messages(spark):
    rows = [
        (1, 1, "message", 10, "user", "hi"), (1, 2, "start", 11, "assistant", None), (1, 3, "delta", 11, None, "wro"), (1, 4, "delta", 11, None, "ng"),
        (1, 5, "message", 12, "user", "taken back"), (1, 6, "regenerate", 11, None, None), (1, 7, "delta", 11, None, "ri"), (1, 8, "delta", 11, None, "ght"),
        (1, 9, "message", 13, "user", "typo"), (1, 10, "edit", 13, None, "fixed"), (1, 11, "delta", 99, None, "lost"), (1, 12, "delta", 12, None, "late"),
        (2, 1, "start", 1, "assistant", ""), (2, 2, "delta", 1, None, "<|end|>\n\\ |> <|user|>\n"), (None, 1, "message", 1, None, "x"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message_id long, role string, text string")
    parts = chat.formatted(events).collect()
    assert {r.conv_id: chat.turns_of(r.formatted) for r in parts} == {
        1: [("user", "hi"), ("assistant", "right"), ("user", "fixed")], 2: [("assistant", "<|end|>\n\\ |> <|user|>\n")], None: [("", "x")]}
    first = next(r for r in parts if r.conv_id == 1)
    assert [first.formatted[s["start"] : s["end"]] for s in first.loss] == ["right"] and first.n_turns == 3


@pytest.mark.parametrize("text", ["", "\\", "<|", "|>", "<|>", "<\\|", "<|end|>\n", "a<", "|", "|>\n<|x|>\n", "<<||>>\\\\", "</s>[INST]"])
def test_escapes_are_reversible_next_to_marks(text):
    turn, start, end = chat.rendered_turn(text, text)
    assert chat.turns_of(turn * 3) == [(text, text)] * 3 and chat.unescaped(turn[start:end]) == text


def test_conversations_read_back(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "x" * 1000, "<|end|>\n" * 50, prose(rng, 30)]))
            for c in range(12) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.log_of(df, delta=300), part=900)).collect()}
    for c in range(12):
        own = [(r or "", t or "") for k, _, r, t in sorted(rows, key=lambda x: x[:2]) if k == c]
        learned = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.rendered_turn(r, t)[0]) for r, t in own)
    assert chat.formatted(chat.log_of(df), part=900).groupBy("conv_id").count().agg(F.max("count")).first()[0] > 1


# 8


def test_ids_are_those_of_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(10)
    letters = "abcdefghij klmnop'sté ΑΣσİ一二 \n\t\x1c\x85 \u2028🙂🙃é1234½.,!?<|startoftext|>\u0301ǅßẞ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [None, "", "a" * 3000, "ab" * 900 + "!" * 500, "<|endoftext|>x<|startoftext|><|endoftext|>", "<|startoftext", "they're we'll I'd 's '", "x\x00y"]
    got = {r.doc_id: r for r in bpe.decoded(bpe.encoded(docs_of(spark, texts))).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert {r.doc_id: r for r in bpe.coded(docs_of(spark, texts)).collect()} == got
    row = bpe.digests(bpe.decoded(bpe.encoded(docs_of(spark, ["two words"])))).first()
    ids = library.encode("two words", add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_trees_merge_the_leftmost_pair_of_lowest_rank(monkeypatch):
    words = bpe.vocabulary(bpe.default_path())
    rng = random.Random(11)

    def plain(symbols):
        symbols = list(symbols)
        while True:
            ranks = [(words.rank[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in words.rank]
            if not ranks:
                return symbols
            i = min(ranks)[1]
            symbols[i : i + 2] = [words.rank[symbols[i], symbols[i + 1]][1]]

    for _ in range(60):
        word = "".join(rng.choice("theranoing") for _ in range(rng.randint(1, 90))).encode()
        symbols = [*[words.inner[b] for b in word[:-1]], words.last[word[-1]]]
        assert words.merged(symbols) == plain(symbols)
        assert np.frombuffer(words.word_ids([word.decode()])[0], np.int32).tolist() == plain(symbols)


def test_texts_in_stretches_are_whole(monkeypatch):
    words = bpe.Vocabulary(bpe.default_path())
    texts = ["", "a b c d e f g", None, "it's <|endoftext|> one more", "", "x" * 300]
    whole = [(i.tolist(), words.decode(i)) for i in words.encode(texts)]
    monkeypatch.setattr(bpe, "STRETCH", 2)
    monkeypatch.setattr(bpe, "TOGETHER", 3)
    assert [(i.tolist(), words.decode(i)) for i in words.encode(texts)] == whole


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    words = bpe.Vocabulary(bpe.default_path())
    texts = ["the one and only the", "other words than those before", "the one"]
    assert [i.tolist() for i in words.encode(texts)] == [words.encode([t])[0].tolist() for t in texts]


# 9


def plain_lines(texts, min_docs, keep_first):
    where, out = defaultdict(list), {}
    for i, text in enumerate(texts):
        for p, line in enumerate((text or "").split("\n")):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
            if key:
                where[key].append((i, p))
    gone = {at for own in where.values() if len({i for i, _ in own}) >= min_docs for at in (sorted(own)[1:] if keep_first else own)}
    for i, text in enumerate(texts):
        own = (text or "").split("\n")
        kept = [x for p, x in enumerate(own) if (i, p) not in gone]
        out[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("min_docs, keep_first", [(2, True), (3, False), (1, True)])
def test_lines_against_a_plain_version(spark, min_docs, keep_first):
    rng = random.Random(12)
    pool = [" Hot line\t", "hot LINE", "é É", "  ", "", "a\rb", "Ünder", "\x0bx\x0c", *[f"line {i}" for i in range(40)]]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    texts += [None, "", "\n", "\n".join(f"line {i % 45}" for i in range(700)), "hot line\n" * 1500]
    df = docs_of(spark, texts)
    marked = lines.with_kept_text(df, lines.line_dedup(df, min_docs, keep_first)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in marked} == plain_lines(texts, min_docs, keep_first)


def test_line_dedup_is_native(spark):
    df = docs_of(spark, ["a\nb", "a\nc"])
    plan = lines.with_kept_text(df, lines.line_dedup(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10


def test_pairs_across_components_may_agree_in_three_fifths():
    marks = np.arange(256, dtype=np.uint32).reshape(2, 128)
    for agreeing, expected in ((76, []), (77, [2]), (83, [2])):
        marks[1, :agreeing], marks[1, agreeing:] = marks[0, :agreeing], np.arange(1000, 1128 - agreeing)
        band = np.repeat(near.keys_of(marks)[0, 0], 2)
        two = lambda a, b, kind=np.int64: np.array([a, b], kind)
        x, y = near._candidates(band, two(1, 2), two(1, 2), two(50, 50), two(False, True, bool), two(False, True, bool), marks)
        assert x.tolist() == expected and y.tolist() == [1] * len(expected)


def plain_groups(texts, size):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("cell", [2048, 7])
def test_near_groups_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(near, "CELL", cell)
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(20, 60)) for _ in range(20)]
    for base in range(6):
        for _ in range(14):  # chains and clusters around the limit
            words = texts[rng.choice([base, len(texts) - 1])].split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "zz" + str(rng.randrange(99))
            texts.append(" ".join(words))
    texts += [None, "", " \n", "one", "ONE", "two words", "two  words", texts[0].upper()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(docs_of(spark, texts), size=4).collect()}
    assert got == plain_groups(texts, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in near.near_groups(docs_of(spark, texts[:9]), size=5).collect())


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(14)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = (near.signature(np.unique(np.concatenate([common, z]))) for z in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.13


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + 2 * i, 100) for i in range(1, 30)] + [(7, 7)]
    random.Random(15).shuffle(edges)
    found = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + 2 * i: 100 for i in range(1, 30)}}
