"""Odd tables for every operator and stage: nulls anywhere, empty tables, clashing columns, repeated rows, long texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, chat, fingerprints, lines, mixing, near, neighbours, substrings, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "x" * 20_000
ROWS = [
    (1, "some words stand here and more\nsecond line", "en", "a", 40), (1, "some words stand here and more\nsecond line", "en", "a", 40),
    (1, "the same id with another text", "en", "a", 29), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id for this row at all", "en", "b", 25),
    (None, None, None, None, None), (4, LONG, "en", "a", len(LONG)), (5, " \t\n\n ", "en", "b", 5),
]
CLASH = ["score", "keep", "size", "h1", "pos", "node", "Text", "DOC_ID", "rank", "c0", "row", "place", "bucket"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1), (3, 0, None), (4, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")


def mixed(docs):
    at = docs.columns.index("source")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return mixing.plan(plain.select(F.col("c0").alias("doc_id"), F.col("c1").alias("text"), F.array(f"c{at}").alias("sources")))


PER_ROW = {
    "fingerprints": fingerprints.fingerprints,
    "edited": fingerprints.edited_and_next,
    "mix": mixed,
    "bpe": lambda d: bpe.digests(bpe.decoded(bpe.encoded(d))),
    "bpe in one": lambda d: bpe.digests(bpe.coded(d)),
    "lines": lambda d: lines.with_kept_text(d, lines.line_dedup(d)),
    "near": near.near_groups,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_has_a_result(odd, name):
    assert len(PER_ROW[name](odd).collect()) == len(ROWS)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables_give_empty_results(odd, name):
    assert PER_ROW[name](odd.limit(0)).collect() == []


def test_substrings_of_odd_rows(odd):
    assert {r.doc_id for r in substrings.repeats(odd).collect()} == {1}
    assert substrings.repeats(odd.limit(0)).collect() == []


def test_toxicity_of_odd_rows(odd, labels):
    model = toxicity.fit(odd, labels)
    assert len(toxicity.scored(odd, model).collect()) == len(ROWS)
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.scored(odd.limit(0), toxicity.fit(odd.limit(0), labels.limit(0))).collect() == []


def test_lines_of_odd_rows(odd):
    rows = lines.with_kept_text(odd, lines.line_dedup(odd, min_docs=1, keep_first=False)).collect()
    assert all(r["kept_text"].strip() == "" for r in rows)
    again = lines.with_kept_text(odd, lines.line_dedup(odd)).collect()
    assert all(r["n_dropped"] == 0 for r in again)


def test_near_groups_of_odd_rows(odd):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_groups(odd).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [
        (1, 4, 1, True), (1, 4, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 3, None, True), (None, 0, None, True),
        (4, 2, 4, True), (5, 0, 5, True)]))
    assert near.one_of_each(odd).count() == len(ROWS) - 1


def test_urls_of_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, verdict int"
    rows = [(1, None, None, "x", 1), (None, "http://a.net/" + "b" * 100_000, None, None, None), (1, "", "", "", 2), (1, "", "", "", 2)]
    df = spark.createDataFrame(rows, schema)
    assert [r.verdict for r in urls.judged(df).orderBy("verdict").collect()] == ["allow", "allow", "allow", "block"]
    assert urls.judged(df.limit(0)).collect() == []


def test_vectors_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, score double, id int, pivot int"
    rows = [(0, [1.0, 0.0], 1.0, 1, 1), (0, [1.0, 0.0], 1.0, 1, 1), (50, [1.0, 1.0], None, 2, 2), (7, [1.0, 0.0], 1.0, 3, 3), (8, [], 1.0, 1, 1)]
    df = spark.createDataFrame(rows, schema)
    found = neighbours.nearest(df, F.col("id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [
        (0, 1, 7), (0, 1, 7), (0, 2, 50), (0, 2, 50), (50, 1, 0), (50, 2, 0), (50, 3, 7)]
    assert neighbours.nearest(df.limit(0), F.col("id") % 50 == 0).collect() == []
    tied = spark.createDataFrame([(i, [1e200, 1e200 * (i % 2)]) for i in range(8)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.nearest(tied, F.col("id") == 0, 3).orderBy("rank").collect()] == [2, 4, 6]


def test_conversations_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, message_id int, seq string, part int"
    rows = [(1, None, "user", "first", 1, "", 0), (1, 2, None, None, 1, "", 0), (1, 2, None, None, 1, "", 0), (None, 1, "assistant", "x" * 200_000, 1, "", 0)]
    df = spark.createDataFrame(rows, schema)
    found = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.formatted(chat.log_of(df))).collect()}
    assert found == {1: (3, 0), None: (1, 200_000)}
    assert chat.read_back(chat.formatted(chat.log_of(df.limit(0)))).collect() == []


def test_stages_take_odd_documents(spark, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ROWS, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
        out = stage(spark, docs, str(tmp_path))
        assert out.count() > 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert out.filter("doc_id = 4").count() >= 1
