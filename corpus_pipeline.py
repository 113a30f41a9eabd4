"""From raw documents to token ids: five stages, each on all that the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; it is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents.

Defined results: a null text is an empty one, which no stage drops but the mix, if its turn doesn't come. Null ids are
ids like any other. Rows equal in id and text lose the same lines; near-dedup keeps one row of each group, and ties are
settled by the smallest id. Empty tables go through all stages. Other columns of the documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, lines, mixing, near, toxicity
from plumbline.llm.tables import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model rejects go; it learns from the labels that are not held out."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more stay where they come first, by id and place, and go elsewhere.

    Whatever share of a text they make up, one copy of each line is left. A document that loses lines and has no words
    left goes. ``n_chars`` is that of the text that stays.
    """
    return lines.without_repeated(docs, min_docs=10)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, a likeness of 0.8 or more."""
    return near.one_of_each(docs, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice. A document taken in part comes whole once more."""
    plan = mixing.plan(docs.select("doc_id", "text", F.array("source").alias("sources")))
    times = plan.filter("taken > 0").groupBy("doc_id").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    times = times.withColumnRenamed("doc_id", "planned")
    rows = docs.join(times, docs["doc_id"].eqNullSafe(times["planned"]))
    return rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[docs[c] for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to."""
    found = bpe.coded(docs)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The first stage is a fitted model, which SQL can't express; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
