"""Column profiles of any table read as text.

The table is reduced to its dictionary first: one row per column and distinct value, counted on the map side, so a
value that fills half a column travels once per task. Numbers that differ in their digits only are then put together,
of which the smallest and the largest are classified, and all other values once each. Every reading of
an ambiguous value is measured, and the column's type is decided from the totals, as data. What reaches the driver is
one measured row per column.

Equal numbers can be spelled in several ways (7, 007). Only columns that show such spellings need a second count, by
numeric key, and only those columns are read for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import values as V
from plumbline.operators.cells import cells, quoted, row_key

COLUMN_PROFILE = [
    "dataset", "position", "name", "type", "rows", "nulls", "null_ratio", "distinct", "distinct_capped",
    "is_key_candidate", "min", "max", "max_len", "max_scale", "max_int_digits", "date_format", "date_ambiguous",
    "has_time", "number_style", "out_of_range", "fingerprint",
]

DIGEST_BITS = 22  # three slices of a 64-bit hash: a bigint sum of one slice holds 2^41 rows
LONG_TEXT = 64
COUNTS = ["n", "spellings", "slice_0", "slice_1", "slice_2"]


def dictionary(cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, value, long_length, n)``: each distinct trimmed value with how often it occurs.

    A text longer than ``LONG_TEXT`` bytes that cannot be a number is replaced by its digest and its length, so
    documents are counted without being shuffled.
    """
    value = F.col("value")
    number_like = F.ascii(value).between(ord("+"), ord("9")) & value.rlike("^[0-9.,eE+-]+$")
    is_long = (F.octet_length(value) > LONG_TEXT) & ~number_like
    return (
        cell_rows.withColumn("value", V.trimmed(F.col("cell")))
        .select(*keys, F.when(is_long, F.sha2(value, 256)).otherwise(value).alias("value"),
                F.when(is_long, F.length(value)).alias("long_length"))
        .groupBy(*keys, "value", "long_length")
        .agg(F.count("*").alias("n"))
    )


def counted(values: DataFrame) -> DataFrame:
    """Values, ``n`` occurrences each, with what a fold adds up: how many there are, and three slices of their hashes."""
    hashed, mask = F.xxhash64("value"), (1 << DIGEST_BITS) - 1
    return values.withColumns({"spellings": F.when(F.col("value").isNotNull(), 1).otherwise(0)} | {
        f"slice_{i}": F.when(F.col("value").isNotNull(), F.shiftrightunsigned(hashed, i * DIGEST_BITS).bitwiseAND(mask) * F.col("n"))
        for i in range(3)})


def folded(values: DataFrame, keys: list[str]) -> DataFrame:
    """Counted values of a dictionary, with numbers of one form (see ``values.form``) put together per ``keys``: the
    smallest and the largest stay, and the first of them carries the counts of all. Other values stay as they are."""
    form = V.form(F.col("value"))
    formed = [name for name in form if name != "digits"]
    other = F.when(F.col("size").isNull(), F.col("value")).alias("value")
    groups = counted(values).withColumns(form).groupBy(*keys, other, "long_length", *formed).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.min("digits").alias("low"), F.max("digits").alias("high"))

    def end(digits: str, carries: bool) -> Column:
        text = V.of_form(F.col(digits), *[F.col(name) for name in formed if name != "zero_end"])
        return F.struct(text.alias("value"), *[(F.col(c) if carries else F.lit(0).cast("long")).alias(c) for c in COUNTS])

    alone = F.struct("value", *COUNTS)
    ends = F.when(F.col("size").isNull(), F.array(alone)).when(
        F.col("low") == F.col("high"), F.array(end("low", True))).otherwise(F.array(end("low", True), end("high", False)))
    return groups.select(*keys, "long_length", F.explode(ends).alias("end")).select(*keys, "long_length", "end.*")


def classified(values: DataFrame) -> DataFrame:
    """Values with their kind and every reading. ``long_length`` marks the digest of a long text."""
    kind = F.when(F.col("long_length").isNotNull(), "text").otherwise(V.kind(F.col("value"), F.col("date")))
    kinds = V.with_date(values).withColumn("kind", kind)
    texts = kinds.withColumn("us_text", V.us_text(F.col("value"), F.col("kind"))).withColumn(
        "br_text", V.br_text(F.col("value"), F.col("kind"))
    )

    def shaped(reading: str) -> dict[str, Column]:
        text = F.col(f"{reading}_text")
        return {reading: V.number(text), f"{reading}_digits": V.integer_digits(text),
                f"{reading}_scale": V.fraction_digits(text), f"{reading}_plain": V.plain_spelling(text)}

    def beyond(reading: str) -> dict[str, Column]:
        """A sortable key of numbers that the decimal can't hold exactly, whose decimal is left out."""
        text = F.col(f"{reading}_text")
        fits = V.fits_number(text, F.col(f"{reading}_digits"), F.col(f"{reading}_scale"))
        return {reading: F.when(fits, F.col(reading)), f"{reading}_key": F.when(~fits, V.ordered_number(text))}

    # An integer reads the same both ways: it is shaped once.
    integer = F.col("kind") == "integer"

    def once(columns: dict[str, Column]) -> dict[str, Column]:
        return {name: F.when(integer, F.col(name.replace("br", "us"))).otherwise(c) for name, c in columns.items()}

    return texts.withColumns(shaped("us")).withColumns(beyond("us")).withColumns(once(shaped("br"))).withColumns(once(beyond("br")))


def _kind_bits(kinds: Column) -> Column:
    return reduce(Column.__add__, [F.when(F.array_contains(kinds, name), bit).otherwise(0) for name, bit in V.KIND_BITS.items()])


def column_measures(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregate classified values, counted or folded, per ``keys``: the kinds seen, ranges and shapes under
    both readings, date evidence, and whether distinct spellings may be one number.

    Kinds are collected as a set: beside a collected value Spark keeps the largest texts in a hash table as well, where
    it would else sort all distinct values by column.
    """
    if "spellings" not in readings.columns:
        readings = counted(readings)
    n = F.col("n")
    numeric = F.col("us_text").isNotNull() | F.col("br_text").isNotNull()
    lost = numeric & F.coalesce(F.col("us").cast("string"), F.col("br").cast("string"), "us_key", "br_key").isNull()
    grouped = F.when(F.col("kind").isin("decimal_br", "int_thousands"), F.when(F.contains("value", F.lit(".")), 1)
                     .when(F.col("br_digits") > 3, 2)).when(
        (F.col("kind") == "integer") & (F.octet_length("value") > 3), 2)

    def spellings(reading: str) -> list[Column]:
        """What tells whether one number may be spelled in two ways under a reading."""
        text, scale = F.col(f"{reading}_text"), F.col(f"{reading}_scale")
        trailing_zero = F.endswith(text, F.lit("0")) & (scale > 0)
        return [
            F.max(f"{reading}_digits").alias(f"{reading}_digits"),
            F.min(scale).alias(f"{reading}_scale_low"), F.max(scale).alias(f"{reading}_scale"),
            F.count_if(~F.col(f"{reading}_plain")).alias(f"{reading}_odd"),
            F.max(F.when(trailing_zero, scale).otherwise(0)).alias(f"{reading}_zero_scale"),
        ]

    date = F.col("date")
    true_bit = F.when(F.col("kind") == "boolean", F.when(F.lower("value") == "true", 1).otherwise(2)).otherwise(0)
    return readings.groupBy(*keys).agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(F.col("value").isNull(), n).otherwise(0)).alias("nulls"),
        F.sum("spellings").alias("raw_distinct"),
        F.coalesce(F.max(F.coalesce("long_length", F.length("value"))), F.lit(0)).alias("max_len"),
        F.collect_set("kind").alias("kinds"),
        F.bit_or(true_bit).alias("truths"),
        F.count_if(F.col("kind") == "boolean").alias("boolean_spellings"),
        *[f(name).alias(f"{name}_{end}") for name in ("us", "br", "us_key", "br_key") for f, end in ((F.min, "low"), (F.max, "high"))],
        *spellings("us"), *spellings("br"), F.coalesce(F.bit_or(grouped), F.lit(0)).alias("grouping"),
        F.sum(F.when(lost, n).otherwise(0)).alias("out_of_range"),
        F.min(date["code"]).alias("code_low"), F.max(date["code"]).alias("code_high"),
        F.coalesce(F.bit_or(date["flags"]), F.lit(0)).alias("date_flags"),
        F.min(date["day_first"]).alias("day_first_low"), F.max(date["day_first"]).alias("day_first_high"),
        F.min(date["month_first"]).alias("month_first_low"), F.max(date["month_first"]).alias("month_first_high"),
        *[F.sum(f"slice_{i}").alias(f"digest_{i}") for i in range(3)],
    ).withColumn("kinds", _kind_bits(F.col("kinds")))


def resolved(measures: DataFrame) -> DataFrame:
    """Decide each column's type and formats from everything that was seen in it."""
    kinds = F.col("kinds")

    def seen(name: str) -> Column:
        return kinds.bitwiseAND(V.KIND_BITS[name]) > 0

    def flag(bit: int) -> Column:
        return F.col("date_flags").bitwiseAND(bit) > 0

    numeric_only = (kinds > 0) & (kinds.bitwiseAND(127 - V.NUMERIC_BITS) == 0)
    one_pattern = F.col("code_low") == F.col("code_high")
    no_order = flag(V.NOT_DAY_FIRST) & flag(V.NOT_MONTH_FIRST)
    by_kind = (
        F.when(kinds == 0, "empty")
        .when(numeric_only & seen("decimal_br") & seen("decimal"), "mixed")
        .when(kinds == V.KIND_BITS["integer"], "integer")
        .when(numeric_only, "decimal")
        .when((kinds == V.KIND_BITS["date"]) & one_pattern & ~no_order, "date")
        .when(kinds == V.KIND_BITS["boolean"], "boolean")
        .when(kinds == V.KIND_BITS["text"], "text")
        .otherwise("mixed")
    )
    typed = measures.withColumn("type", by_kind).withColumn("reads_br", seen("decimal_br"))

    kind, br = F.col("type"), F.col("reads_br")
    is_number, is_date = kind.isin("integer", "decimal"), kind == "date"
    month_first = flag(V.NOT_DAY_FIRST)
    spelled_two_ways = (flag(V.PADDED) & flag(V.UNPADDED)) | (flag(V.HOUR_PADDED) & flag(V.HOUR_UNPADDED))

    def reading(part: str) -> Column:
        return F.when(br, F.col(f"br_{part}")).otherwise(F.col(f"us_{part}"))

    def bound(part: str) -> Column:
        day = F.when(month_first, F.col(f"month_first_{part}")).otherwise(F.col(f"day_first_{part}"))
        held = reading(part).cast("string")
        further = F.when(br, F.col(f"br_key_{part}")).otherwise(F.col(f"us_key_{part}"))
        first = (F.least if part == "low" else F.greatest)(V.ordered_number(held), further)
        return F.when(is_number, V.number_text(first)).when(is_date, day.cast("string"))

    # Spellings are one per number when all have the same scale, or none ends in a zero it could do without; in
    # the Brazilian reading thousands must also be grouped always or never.
    low, high, zeros = reading("scale_low"), reading("scale"), reading("zero_scale")
    one_spelling = (reading("odd") == 0) & (~br | (F.col("grouping") != 3)) & (
        (low == high) | (zeros == 0) | ((zeros == 1) & (low >= 1)))
    truths = F.bit_count("truths").cast("long")
    return typed.select(
        "*",
        F.when(is_number & ~one_spelling, None).otherwise(
            F.col("raw_distinct") - F.col("boolean_spellings") + truths).alias("spelled_distinct"),
        bound("low").alias("min"),
        bound("high").alias("max"),
        F.when(is_number, reading("scale")).alias("max_scale"),
        F.when(is_number, reading("digits")).alias("max_int_digits"),
        F.when(is_date, V.date_format(F.col("code_low"), month_first, F.col("date_flags"))).alias("date_format"),
        (is_date & (F.col("code_low") >= V.ISO_CODE + V.FAMILY_STEP) & ~flag(V.NOT_DAY_FIRST)
         & ~flag(V.NOT_MONTH_FIRST)).alias("date_ambiguous"),
        (is_date & V.has_clock(F.col("code_low"))).alias("has_time"),
        F.when(kind == "decimal", F.when(br, "br").otherwise("us")).alias("number_style"),
        (is_date & spelled_two_ways).alias("spelled_two_ways"),
        F.concat_ws("-", *[F.lpad(F.hex(F.coalesce(F.col(f"digest_{i}"), F.lit(0))), 16, "0") for i in range(3)])
        .alias("fingerprint"),
    )


_MEASURED = (
    "dataset string, position int, name string, type string, rows long, nulls long, spelled_distinct long, min string, "
    "max string, max_len int, max_scale int, max_int_digits int, date_format string, date_ambiguous boolean, "
    "has_time boolean, number_style string, spelled_two_ways boolean, out_of_range long, fingerprint string, "
    "beyond_limit boolean"
)
_EMPTY = {"type": "empty", "rows": 0, "nulls": 0, "spelled_distinct": 0, "max_len": 0, "date_ambiguous": False,
          "has_time": False, "spelled_two_ways": False, "out_of_range": 0, "fingerprint": ""}
KEYS = ["dataset", "position"]


def _all_cells(tables: dict[str, DataFrame], chosen: list[tuple[str, int]]) -> DataFrame | None:
    """``(position, cell)``: the chosen columns of every table as one DataFrame, positions counted over all tables, so
    that a short key tells the columns apart."""
    parts, start = [], 0
    for name, df in tables.items():
        if positions := [i for dataset, i in chosen if dataset == name]:
            parts.append(cells(df, positions, start))
        start += len(df.columns)
    return reduce(DataFrame.union, parts) if parts else None


def measure(cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per column: everything a profile says, with the distinct count where spellings settle it."""
    return resolved(column_measures(classified(folded(dictionary(cell_rows, keys), keys)), keys))


def measure_unshuffled(cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same row for columns whose distinct count is not wanted: no value leaves its task."""
    values = cell_rows.select(
        *keys, V.trimmed(F.col("cell")).alias("value"), F.lit(None).cast("int").alias("long_length"), F.lit(1).alias("n"))
    return resolved(column_measures(classified(values), keys))


def columns_beyond(cell_rows: DataFrame, limit: int) -> set[int]:
    """Positions certain to hold more distinct values than ``limit``: a sketch with 1% error says so by ten errors."""
    sketch = cell_rows.groupBy("position").agg(F.approx_count_distinct(F.xxhash64(V.trimmed(F.col("cell"))), 0.01).alias("n"))
    return {int(r["position"]) for r in sketch.filter(F.col("n") > limit * 1.1).collect()}


def _measured_rows(tables: dict[str, DataFrame], distinct_limit: int | None) -> list[dict]:
    every = [(name, i) for name, df in tables.items() for i in range(len(df.columns))]
    large = set() if distinct_limit is None else columns_beyond(_all_cells(tables, every), distinct_limit)
    beyond = {every[i] for i in large}
    counted_cells = _all_cells(tables, [c for c in every if c not in beyond])
    uncounted = _all_cells(tables, [c for c in every if c in beyond])
    rows = [] if counted_cells is None else measure(counted_cells, ["position"]).collect()
    rows += [] if uncounted is None else measure_unshuffled(uncounted, ["position"]).collect()
    found = {every[int(r["position"])]: r.asDict() for r in rows}
    fields = T._parse_datatype_string(_MEASURED).names
    measured = []
    for dataset, df in tables.items():
        for position, name in enumerate(df.columns):
            row = {**_EMPTY, **found.get((dataset, position), {})}
            row.update(dataset=dataset, position=position, name=name, beyond_limit=(dataset, position) in beyond)
            measured.append({f: row.get(f) for f in fields})
    return measured


def number_key_counts(tables: dict[str, DataFrame], columns: list[dict]) -> DataFrame:
    """``(dataset, position, keys)``: how many numbers each column holds, whatever their spelling. Spellings are made
    unique first, so that a key is worked out once a spelling and not once a row."""
    parts = []
    for dataset, df in tables.items():
        chosen = [c for c in columns if c["dataset"] == dataset]
        if not chosen:
            continue
        spelled = []
        for c in chosen:
            value = V.trimmed(F.col(quoted(c["name"])))
            text = V.from_brazilian(value) if c["number_style"] == "br" else value
            spelled.append(text.alias(str(c["position"])))
        rows = df.select(*spelled).unpivot([], [quoted(str(c["position"])) for c in chosen], "position", "text")
        parts.append(rows.select(F.lit(dataset).alias("dataset"), "position", "text"))
    # The filter on the count keeps Spark from taking this step for a needless one, as distinct keys follow.
    spellings = reduce(DataFrame.union, parts).groupBy("dataset", "position", "text").agg(F.count("*").alias("n")).filter("n > 0")
    rows = spellings.withColumn("key", V.number_key(F.col("text")))
    return rows.groupBy("dataset", F.col("position").cast("int").alias("position")).agg(F.countDistinct("key").alias("keys"))


def profile_many(tables: dict[str, DataFrame], distinct_limit: int | None = None) -> DataFrame:
    """The column profiles of several tables, one row per column in ``COLUMN_PROFILE`` order, from the same jobs.

    Distinct counts are exact and say what a typed load would tell apart. With ``distinct_limit`` a column holding
    more values reports NULL and ``distinct_capped``; columns far beyond it are recognised by a sketch, and their
    values are never shuffled.
    """
    # Columns are renamed so that names differing only in case can be told apart.
    named = {dataset: df.toDF(*[f"c{i}" for i in range(len(df.columns))]) for dataset, df in tables.items()}
    measured = _measured_rows(named, distinct_limit)
    respelled = [c for c in measured if c["spelled_distinct"] is None and not c["beyond_limit"]]
    values = [tuple({**c, "name": tables[c["dataset"]].columns[c["position"]]}.values()) for c in measured]
    spark = next(iter(tables.values())).sparkSession
    by_column = spark.createDataFrame(values, _MEASURED).coalesce(1)
    if respelled:
        joined = number_key_counts(named, respelled).join(F.broadcast(by_column), KEYS, "right")
    else:
        joined = by_column.withColumn("keys", F.lit(None).cast("long"))
    return _finished(joined, distinct_limit)


def _finished(joined: DataFrame, distinct_limit: int | None) -> DataFrame:
    """Measured columns with their distinct counts settled, in ``COLUMN_PROFILE`` order."""
    exact = F.when(~F.col("spelled_two_ways") & ~F.col("beyond_limit"), F.coalesce("spelled_distinct", "keys"))
    over = F.lit(False) if distinct_limit is None else F.coalesce(exact > distinct_limit, F.lit(False))
    capped = F.col("beyond_limit") | over
    filled = F.col("rows") - F.col("nulls")
    counted = joined.withColumns({"distinct_capped": capped, "distinct": F.when(~capped, exact)})
    return counted.withColumns({
        "null_ratio": F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(F.lit(0.0)),
        "is_key_candidate": F.coalesce((F.col("distinct") == filled) & (filled > 0), F.lit(False)),
    }).select(*COLUMN_PROFILE)


def profile_of_values(values: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """The column profiles that a dictionary ``(dataset, position, value, long_length, n)`` tells, without the tables
    it was counted from. Columns without a row are empty."""
    spark = values.sparkSession
    readings = classified(values)
    measured = resolved(column_measures(classified(folded(values, KEYS)), KEYS)).withColumn("position", F.col("position").cast("int"))
    # Both readings' keys in one pass; the column decides which one counts.
    keyed = readings.groupBy(*KEYS).agg(
        F.countDistinct(V.number_key(F.col("us_text"))).alias("us_keys"), F.countDistinct(V.number_key(F.col("br_text"))).alias("br_keys"))
    keyed = keyed.withColumn("position", F.col("position").cast("int"))
    named = spark.createDataFrame([(d, i, n) for d, names in columns.items() for i, n in enumerate(names)], "dataset string, position int, name string")
    fields = [f for f in T._parse_datatype_string(_MEASURED).names if f not in (*KEYS, "name", "beyond_limit")]
    rows = F.broadcast(named).join(measured, KEYS, "left").join(keyed, KEYS, "left").select(
        *KEYS, "name", *[F.when(F.col("type").isNull(), F.lit(_EMPTY.get(f))).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(F.col("number_style") == "br", F.col("br_keys")).otherwise(F.col("us_keys")).alias("keys"))
    return _finished(rows.withColumn("beyond_limit", F.lit(False)), None)


def profile(df: DataFrame, dataset: str, distinct_limit: int | None = None) -> DataFrame:
    """The column profile of one table; see ``profile_many``."""
    return profile_many({dataset: df}, distinct_limit)


#: Size of a distinct sketch, 2 ** 14 registers, and the relative standard error of its estimate.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, sketch)``: a mergeable sketch of the distinct trimmed values; no value leaves its task."""
    return cell_rows.groupBy(*keys).agg(F.hll_sketch_agg(V.trimmed(F.col("cell")), SKETCH_BITS).alias("sketch"))


def distinct_estimates(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, distinct_estimate)`` from sketches of any parts of the data, batches or tables; the standard error is
    ``SKETCH_ERROR`` of the estimate."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))


def duplicate_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """``(dataset, rows, duplicate_rows)``: rows equal to an earlier one, compared cell by cell as they are."""
    keys = []
    for dataset, df in tables.items():
        positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        keys.append(positional.select(
            F.lit(dataset).alias("dataset"), row_key([F.col(c) for c in positional.columns]).alias("key")))
    return reduce(DataFrame.union, keys).groupBy("dataset").agg(
        F.count("*").alias("rows"), (F.count("*") - F.countDistinct("key")).alias("duplicate_rows"))


def dataset_totals(columns: DataFrame, duplicates: DataFrame, discarded: Column | None = None) -> DataFrame:
    """One row per dataset from its column profile and its duplicate count."""
    totals = columns.groupBy("dataset").agg(
        F.max("rows").alias("rows"), F.count("*").alias("columns"), F.sum("rows").alias("total_cells"),
        F.sum("nulls").alias("empty_cells"))
    copies = duplicates.select("dataset", F.col("duplicate_rows").alias("copies"))
    joined = totals.join(F.broadcast(copies), "dataset", "left").withColumn(
        "duplicate_rows", F.coalesce("copies", F.lit(0)).cast("long")).drop("copies")
    return joined.withColumn("filled_cells", F.col("total_cells") - F.col("empty_cells")).withColumn(
        "rows_discarded", (F.lit(0) if discarded is None else discarded).cast("long"))
