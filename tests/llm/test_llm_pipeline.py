"""The five stages over a whole small table, each against a plain version on what the stage before kept."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from test_llm_operators import plain_groups, plain_lines

from plumbline.llm import bpe, mixing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """The documents, and what each stage made of them, in order of ids."""
    folder = tmp_path_factory.mktemp("stages")
    tables, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    tables.append(docs.orderBy("doc_id").collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        tables.append(docs.orderBy("doc_id").collect())
    return tables


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]


def test_toxic_documents_go(spark, outputs):
    docs, kept, *_ = outputs
    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    model = toxicity.fit(table("documents"), table("labels"))
    assert kept == [d for d in docs if model.score(d.text)[0] < 0.5]


def test_repeated_lines_go(outputs):
    _, docs, kept, *_ = outputs
    expected = plain_lines([d.text for d in docs], 10, True)
    rows = [(d.doc_id, text, d.lang, d.source, len(text)) for i, d in enumerate(docs)
            for n, dropped, text in [expected[i]] if not dropped or text.strip(" \t\n\x0b\x0c\r")]
    assert [tuple(r) for r in kept] == rows


def copied_documents(spark):
    """12 copies of a clean text, 12 near copies of another, 12 texts of their own over a stock line."""
    clean = "\n".join(f"line {i} of a clean text that was copied as a whole" for i in range(8))
    body = "\n".join(f"sentence {i} of the text with a last line of its own" for i in range(30))
    texts = ["\n\n".join([clean, "its end"])] * 12 + [f"{body}\nlast words {i} here" for i in range(12)]
    texts += ["\n".join([f"{w} {i} stands in document {i} alone" for w in ("first", "second", "third")] + ["all rights reserved"]) for i in range(12)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_one_of_many_copies_survives_three_stages(spark):
    texts, docs = copied_documents(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    clean = corpus_pipeline.toxicity.without_toxic(docs, corpus_pipeline.toxicity.fit(docs, labels))
    assert clean.count() == len(texts)
    kept = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_repeated_lines(spark, clean, SF), SF).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in kept if r.doc_id < 12] == [(0, texts[0], len(texts[0]))]


def test_the_first_of_every_repeated_line_stays(spark):
    texts, docs = copied_documents(spark)
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert kept[12] == texts[12] and [kept[i] for i in range(13, 24)] == [f"last words {i - 12} here" for i in range(13, 24)]
    assert sorted(kept) == [0, *range(12, 36)] and kept[24] == texts[24]
    assert all(kept[i] == texts[i].rpartition("\n")[0] for i in range(25, 36))


@pytest.mark.parametrize("share", [10, 45, 55, 90])
def test_one_copy_of_a_shared_passage_survives_whatever_its_share(spark, share):
    passage = [f"line {i} of the passage that twelve documents have in common" for i in range(9)]
    own = round(len("\n".join(passage)) * (100 - share) / share)
    texts = []
    for i in range(12):
        words = " ".join(f"w{i}x{k}" for k in range(own))[:own]
        texts.append("\n".join([words[: own // 2], *passage, words[own // 2 :]]))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert sorted(kept) == list(range(12)) and kept[0].text == texts[0]
    for i in range(1, 12):
        assert kept[i].text.split("\n") == [x for x in texts[i].split("\n") if x not in passage] and kept[i].n_chars == len(kept[i].text)


def test_stages_take_nulls_repeats_empty_tables_and_other_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, Text string"
    rows = [(1, None, None, None, None, "x"), (None, "some words are here", "en", "a", 19, None), (2, "", "en", "b", 0, "y"),
            (3, "equal rows of text", "en", "a", 18, "z"), (3, "equal rows of text", "en", "a", 18, "z")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.createDataFrame(rows, schema)
        assert corpus_pipeline.toxicity.without_toxic(docs, corpus_pipeline.toxicity.fit(docs, labels)).count() == 5
        lined = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
        assert lined.columns == docs.columns and sorted(map(repr, lined.collect())) == sorted(map(repr, docs.collect()))
        near = corpus_pipeline.drop_near_copies(spark, docs, SF)
        assert near.columns == docs.columns and sorted(map(repr, near.collect())) == sorted(map(repr, docs.dropDuplicates().collect()))
        assert corpus_pipeline.mix_sources(spark, docs, SF).columns == docs.columns
        ids = corpus_pipeline.encode(spark, docs, SF).collect()
        assert len(ids) == 5 and all(r.n_tokens == len(r.ids) for r in ids)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs.limit(0), SF).count() == 0, name
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_one_of_each_group_stays(outputs):
    _, _, docs, kept, *_ = outputs
    groups = plain_groups([d.text for d in docs], 5)
    assert kept == [d for i, d in enumerate(docs) if groups[i][1] == i]


def test_sources_are_mixed(outputs):
    *_, docs, mixed, _ = outputs
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) for d in docs}
    totals = Counter()
    for d in docs:
        totals[d.source] += size[d.doc_id]
    expected = Counter()
    for source, target in mixing.targets(dict(totals)).items():
        whole, rest = divmod(round(target), totals[source])
        own = sorted((d for d in docs if d.source == source), key=lambda d: hashlib.md5(f"mix\x1f{d.doc_id}".encode()).hexdigest())
        for d in own:
            taken = whole * size[d.doc_id] + min(size[d.doc_id], max(rest, 0))
            rest -= size[d.doc_id]
            expected[d] = -(-taken // size[d.doc_id]) if size[d.doc_id] else 0
    assert Counter(mixed) == +expected


def test_texts_are_encoded(outputs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    *_, docs, ids = outputs
    assert sorted((d.doc_id, library.encode(d.text, add_special_tokens=False).ids) for d in docs) == sorted((r.doc_id, r.ids) for r in ids)
    assert all(r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(
        library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest() for r in ids)
