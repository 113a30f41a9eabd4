"""Line dedup with column functions alone: keep bitmaps for each document instead of text.

A text is split at ``\\n``. A line's key is the line stripped of white space and with A-Z lower-cased; keys travel as
two 64-bit hashes. Keys that make up a large share of all lines are counted apart, on the map side; the rest is
partitioned by range of the hash and sorted by document and position inside, where a window streams over the
occurrences of each key. What comes back is one sparse bitmap for each document.

Defined results: a null or empty text is one empty line. Lines whose key is shorter than ``min_chars`` always stay. A
document is its id and text: rows equal in both count once and get equal bitmaps; rows that share only the id are two
documents. A null id is a value like any other, and ranks first. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import SPACES, ascii_lower, partitions, pick, stored

KEY, DOC = ["h1", "h2"], ["doc_id", "text_hash"]


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``(doc_id, text_hash, pos, h1, h2)`` of every line that may repeat."""
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    return (lines.withColumn("key", key).filter(F.char_length("key") >= min_chars)
            .select(*DOC, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")))


def dropped_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """``(doc_id, text_hash, pos)`` of lines whose key stands in ``min_docs`` documents or more.

    With ``keep_first`` the first occurrence, by document and position, stays; without it all go.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    lines = stored(line_keys(docs, min_chars), "line-keys")
    share = max(1000, lines.count() // (2 * n))
    # At most 2 n keys hold more than that share of the lines.
    heavy = lines.groupBy(*KEY).count().filter(F.col("count") > share).select(*KEY)
    heavy = F.broadcast(stored(heavy, "heavy-keys"))
    place = F.struct(*DOC, "pos")

    heavy_lines = lines.join(heavy, KEY)
    totals = heavy_lines.groupBy(*KEY, *DOC).agg(F.min("pos").alias("pos")).groupBy(*KEY).agg(
        F.count("*").alias("n_docs"), F.min(place).alias("first"))
    # One row for each heavy key.
    heavy_out = heavy_lines.join(F.broadcast(totals), KEY).select(*DOC, "pos", "n_docs", (place == F.col("first")).alias("is_first"))

    # The range partitioning satisfies the windows, so this is the only exchange of the light lines.
    light = lines.join(heavy, KEY, "left_anti").repartitionByRange(n, *KEY)
    ordered = Window.partitionBy(*KEY).orderBy(*DOC, "pos")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    light_out = (
        light.withColumns({"turn": F.rank().over(ordered), "before": F.lag(F.struct(*DOC)).over(ordered)})
        .withColumn("new_doc", F.when(F.col("before").eqNullSafe(F.struct(*DOC)), 0).otherwise(1))
        .withColumn("n_docs", F.sum("new_doc").over(whole))
        .select(*DOC, "pos", "n_docs", (F.col("turn") == 1).alias("is_first")))

    found = heavy_out.unionByName(light_out).filter(F.col("n_docs") >= min_docs)
    return (found.filter(~F.col("is_first")) if keep_first else found).select(*DOC, "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, keep map<int,bigint>)``: bit p % 64 of word p / 64 says that line p stays.

    Words that keep all their lines are left out, and so are documents that keep all.
    """
    words = dropped.groupBy(*DOC, F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy(*DOC).agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"))


def _kept(text: Column, keep: Column) -> Column:
    def stays(_: Column, pos: Column) -> Column:
        bits = F.try_element_at(keep, F.floor(pos / 64).cast("int"))
        return bits.isNull() | (F.getbit(bits, pos % 64) == 1)

    return F.when(keep.isNull(), _split(text)).otherwise(F.filter(_split(text), stays))


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents, all their columns as they were, plus ``(n_lines, n_dropped, kept_text)`` at the end."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = f"c{names.index('doc_id')}", F.coalesce(F.col(f"c{names.index('text')}"), F.lit(""))
    marks = bitmaps.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "keep")
    joined = plain.join(marks, F.col(doc_id).eqNullSafe(F.col("m_id")) & (F.xxhash64(text) == F.col("m_hash")), "left")
    lines = joined.withColumn("stay", _kept(text, F.col("keep")))
    n_lines = F.size(_split(text))
    return lines.select(
        *plain.columns, n_lines.cast("long").alias("n_lines"), (n_lines - F.size("stay")).cast("long").alias("n_dropped"),
        F.array_join("stay", "\n").alias("kept_text")).toDF(*names, "n_lines", "n_dropped", "kept_text")


def line_dedup(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: ``(doc_id, text_hash, keep)``."""
    return keep_bitmaps(dropped_lines(docs, min_docs, keep_first, min_chars))


def without_repeated(docs: DataFrame, min_docs: int = 2) -> DataFrame:
    """The documents, in their own columns, with repeated lines left where they come first only.

    Documents that lose lines and have no words left go; the text of the others, and ``n_chars``, if there is such a
    column, are those of the lines that stay. Documents that lose nothing are as they were.
    """
    names = docs.columns
    marked = with_kept_text(docs, line_dedup(docs, min_docs))
    plain = marked.toDF(*[f"c{i}" for i in range(len(marked.columns))])
    changed, kept = F.col(f"c{len(names) + 1}") > 0, F.col(f"c{len(names) + 2}")
    left = plain.filter(~changed | (F.btrim(kept, F.lit(SPACES)) != ""))
    new = {"text": kept, "n_chars": F.char_length(kept)}

    def column(i: int, name: str) -> Column:
        old = F.col(f"c{i}")
        return F.when(changed, new[name].cast(docs.schema[i].dataType)).otherwise(old) if name in new else old

    return left.select(*[column(i, name).alias(name) for i, name in enumerate(names)])
