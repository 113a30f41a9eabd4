import pytest
from pyspark.sql import functions as F

from plumbline.operators import flags as G
from plumbline.operators import profile as P
from plumbline.operators.profile import profile
from plumbline.plans.intake import profile_file, profile_table
from plumbline.queries.registry import read_evenly, spread
from plumbline.sources import delimited as D


def intake(spark, tmp_path, content, encoding="utf-8"):
    path = tmp_path / "data.csv"
    path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
    return profile_file(spark, str(path), "data")


def columns_of(result):
    return {r["name"]: r for r in result.columns.collect()}


def column_profiles(spark, columns):
    """Profiles of several value lists, as the columns of one table."""
    height = max(len(values) for values in columns)
    rows = [tuple(values[i] if i < len(values) else None for values in columns) for i in range(height)]
    df = spark.createDataFrame(rows, ", ".join(f"v{i} string" for i in range(len(columns))))
    return sorted(profile(df, "d").collect(), key=lambda r: r["position"])


def one_column(spark, values):
    return column_profiles(spark, [values])[0]


def test_brazilian_export(spark, tmp_path):
    text = "nota|emissao|frete|bairro\n901|28/11/2024|7.050,25|Açaí\n902|09/07/2024|12,5|Ipê\n903|30/06/2023|840,00|Cajá\n"
    found = intake(spark, tmp_path, text)
    c = columns_of(found)
    assert found.layout.delimiter == "|" and found.flags.count() == 0
    assert (c["emissao"]["type"], c["emissao"]["date_format"], c["emissao"]["min"], c["emissao"]["max"]) == (
        "date", "dd/MM/yyyy", "2023-06-30", "2024-11-28")
    f = c["frete"]
    assert (f["type"], f["number_style"], f["min"], f["max"], f["max_scale"], f["max_int_digits"]) == (
        "decimal", "br", "12.5", "7050.25", 2, 4)


@pytest.mark.parametrize("raw, encoding", [
    ("rua;bairro\nPraça XV;Água Rasa\n".encode("cp1252"), "windows-1252"),
    (b"k;w\nq;\x8d\x90\n", "latin-1"),
])
def test_encodings_are_found_and_flagged(spark, tmp_path, raw, encoding):
    found = intake(spark, tmp_path, raw)
    assert found.layout.encoding == encoding
    assert [r["kind"] for r in found.flags.collect()] == ["encoding"]
    if encoding == "windows-1252":
        assert columns_of(found)["bairro"]["max_len"] == len("Água Rasa")


@pytest.mark.parametrize("raw", [b"", b"\t\n\n   ", "x;y\n".encode("utf-16"), b"k,w\nq,\x00r\n", b";;;\n7;8;9;0\n"])
def test_unreadable_files_are_refused(spark, tmp_path, raw):
    with pytest.raises(D.UnreadableFile):
        intake(spark, tmp_path, raw)


def test_flags_of_a_broken_file(spark, tmp_path):
    found = intake(spark, tmp_path, "sku,net weight,SKU,memo\nA7,31,k,\nA7,31,k,\nB9,heavy,m,\nC2,40,k,,9\n")
    flags = {r["kind"]: r["items"] for r in found.flags.collect()}
    assert flags["column_names"] == ["'net weight'"]
    assert flags["duplicate_columns"] == ["sku, SKU"]
    assert flags["malformed_rows"] == ["linha 5"]
    assert flags["mixed_types"] == ["net weight"]
    assert flags["mostly_empty"] == ["memo (100% vazia)"]
    assert flags["duplicate_rows"] == ["1 linhas idênticas a uma anterior"]
    totals = found.totals.first()
    assert (totals["rows"], totals["rows_discarded"], totals["duplicate_rows"]) == (3, 1, 1)
    order = [r["kind"] for r in found.flags.orderBy("ordinal").collect()]
    assert order == ["column_names", "duplicate_columns", "malformed_rows", "mixed_types", "mostly_empty", "duplicate_rows"]


def test_ranges_keys_and_shapes(spark, tmp_path):
    found = intake(spark, tmp_path, "trip,driver,km,left_on,remark\n40,Uli,9.0625,2019-08-30,late\n41,Ida,20480.5,2019-02-11,\n42,Uli,77.25,2019-12-01,ok\n")
    c = columns_of(found)
    assert c["trip"]["is_key_candidate"] and (c["trip"]["min"], c["trip"]["max"]) == ("40", "42")
    assert c["driver"]["distinct"] == 2 and not c["driver"]["is_key_candidate"]
    assert (c["km"]["max_scale"], c["km"]["max_int_digits"], c["km"]["max"]) == (4, 5, "20480.5")
    assert (c["left_on"]["min"], c["left_on"]["max"], c["remark"]["max_len"]) == ("2019-02-11", "2019-12-01", 4)


def test_identical_columns_beside_a_permuted_one(spark):
    rows = [("x", "y", "y", "x"), ("y", "x", "x", "y"), ("z", "z", "z", "q")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    found = G.identical_columns(df, P.profile(df, "d")).collect()
    assert [r["item"] for r in found] == ["b = c"]


def test_identical_columns(spark, tmp_path):
    found = intake(spark, tmp_path, "u,v,w,n1,n2\n8,t,8,,\n6,t,6,,\n8,r,8,,\n")
    flags = {r["kind"]: r["items"] for r in found.flags.collect()}
    assert flags["identical_columns"] == ["u = w"]


DATE_CASES = [
    (["09/10/2021", "11/12/2020", "07/08/2019"], ("date", "dd/MM/yyyy", True)),
    (["27/09/2021", "04/11/2021"], ("date", "dd/MM/yyyy", False)),
    (["09/27/2021", "04/11/2021"], ("date", "MM/dd/yyyy", False)),
    (["27/09/2021", "09/28/2021"], ("mixed", None, False)),
    (["04/11/2021", "31/04/2021"], ("mixed", None, False)),
    (["2021-04-11", "04/11/2021"], ("mixed", None, False)),
    (["2021-00-10"], ("text", None, False)),
    (["2021-04-11 23:59:58", "2020-02-29 00:00:00"], ("date", "yyyy-MM-dd HH:mm:ss", False)),
    (["2020-02-29T07:15"], ("date", "yyyy-MM-dd'T'HH:mm", False)),
    (["4/9/2021", "27/9/2021"], ("date", "d/M/yyyy", False)),
    (["28.09.2021 7:45"], ("date", "dd.MM.yyyy H:mm", False)),
]


def test_date_columns(spark):
    found = column_profiles(spark, [values for values, _ in DATE_CASES])
    for c, (values, expected) in zip(found, DATE_CASES):
        assert (c["type"], c["date_format"], c["date_ambiguous"]) == expected, values


def test_mixed_padding_hides_the_distinct_count(spark):
    assert one_column(spark, ["4/9/2021", "04/09/2021"])["distinct"] is None


NUMBER_CASES = [
    (["8.410,75", "61.5"], ("mixed", None, None, None, 2)),
    (["2.718", "9.5"], ("decimal", "us", "2.718", "9.5", 2)),
    (["2.718", "40,5"], ("decimal", "br", "40.5", "2718", 2)),
    (["-6.020,5", "8,75"], ("decimal", "br", "-6020.5", "8.75", 2)),
    (["3,1", "3,10", "4,6"], ("decimal", "br", "3.1", "4.6", 2)),
    (["19", "0019"], ("integer", None, "19", "19", 1)),
    (["5.0", "5.00", "6"], ("decimal", "us", "5", "6", 2)),
    (["3e2", "300", "300.0"], ("decimal", "us", "300", "300", 1)),
    (["false", "False", "TRUE"], ("boolean", None, None, None, 2)),
    (["false", "False", "maybe"], ("mixed", None, None, None, 2)),
    (["", "   ", None], ("empty", None, None, None, 0)),
]


def test_number_columns(spark):
    found = column_profiles(spark, [values for values, _ in NUMBER_CASES])
    for c, (values, expected) in zip(found, NUMBER_CASES):
        assert (c["type"], c["number_style"], c["min"], c["max"], c["distinct"]) == expected, values


def test_distinct_limit_is_exact_below_and_null_above(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 90).cast("string").alias("b"),
                                  (F.col("id") % 101).cast("string").alias("c"))
    rows = {r["name"]: r for r in profile(df, "d", distinct_limit=100).collect()}
    assert (rows["a"]["distinct"], rows["a"]["distinct_capped"], rows["a"]["min"], rows["a"]["max"]) == (None, True, "0", "4999")
    assert (rows["b"]["distinct"], rows["b"]["distinct_capped"]) == (90, False)
    assert (rows["c"]["distinct"], rows["c"]["distinct_capped"]) == (None, True)


def test_empty_table_and_long_texts(spark):
    empty = profile(spark.createDataFrame([], "a string, b string"), "d").collect()
    assert [(r["type"], r["rows"], r["distinct"], r["null_ratio"]) for r in empty] == [("empty", 0, 0, 0.0)] * 2
    long = "é" * 100
    c = one_column(spark, [long, " " + long, long + "x"])
    assert (c["type"], c["max_len"], c["distinct"]) == ("text", 101, 2)


def test_corrupted_seed_shows_every_injected_defect(spark, tmp_path):
    lines = ["date_rep,day,month,year,cases,deaths,geo id,Cases,notes"]
    for i in range(1, 60):
        deaths = "n/a" if i == 2 else str(i % 7)
        lines.append(f"0{1 + i % 2}/01/2022,0{1 + i % 2},01,2022,{i * 3},{deaths},C{i},{i * 3},")
    lines += [lines[1], "02/01/2022,02"]
    found = intake(spark, tmp_path, "\n".join(lines) + "\n")
    kinds = {r["kind"] for r in found.flags.collect()}
    assert kinds == {"column_names", "duplicate_columns", "mixed_types", "mostly_empty", "duplicate_rows",
                     "malformed_rows", "ambiguous_dates", "identical_columns"}


def test_quality_ratios(spark):
    df = spark.createDataFrame([("1", None), ("1", None), ("x", "b")], "a string, `b c` string")
    q = profile_table(df, "d").quality.first()
    assert (q["completeness"], q["row_uniqueness"], q["type_consistency"], q["name_compatibility"], q["rows_kept"]) == (
        4 / 6, 2 / 3, 0.5, 0.5, 1.0)


def spelled(rng, style):
    """One random number in one of several spellings; few distinct values, so that spellings meet."""
    whole, cents = rng.choice([0, 1, 7, 12, 999, 1000, 1234, 20000]), rng.choice([0, 5, 50, 25, 10])
    sign = rng.choice(["", "", "", "-"]) if whole or cents else ""
    if style == "integer":
        return sign + str(whole)
    if style == "padded":
        return sign + rng.choice(["", "0", "00"]) + str(whole)
    if style == "fixed":
        return f"{sign}{whole}.{cents:02d}"
    if style == "shortest":
        return sign + (f"{whole}.{cents:02d}".rstrip("0").rstrip(".") or "0")
    if style == "double":
        return sign + str(float(f"{whole}.{cents:02d}"))
    if style == "loose":
        return rng.choice([f"{whole}.{cents:02d}", f"{whole}.{cents:02d}0", f"+{whole}", f"{whole}.", f".{cents:02d}", f"{whole}e0"])
    grouped = f"{whole:,}".replace(",", ".")
    if style == "brazilian":
        return f"{sign}{grouped},{cents:02d}"
    if style == "ungrouped":
        return f"{sign}{whole},{cents:02d}"
    if style == "either":
        return sign + rng.choice([f"{grouped},{cents:02d}", f"{whole},{cents:02d}"])
    return sign + rng.choice([grouped, f"{grouped},5", str(whole)])


def test_distinct_counts_see_numbers_not_spellings(spark):
    import random
    from decimal import Decimal

    styles = ["integer", "padded", "fixed", "shortest", "double", "loose", "brazilian", "ungrouped", "either", "thousands"]
    rng = random.Random(11)
    columns = [[spelled(rng, style) for _ in range(rng.randint(1, 60))] for style in styles for _ in range(3)]
    for c, values in zip(column_profiles(spark, columns), columns):
        if c["type"] == "mixed":
            continue
        texts = [v.replace(".", "").replace(",", ".") if c["number_style"] == "br" else v for v in values]
        numbers = {Decimal(t) + 0 for t in texts}
        assert (c["distinct"], Decimal(c["min"]), Decimal(c["max"])) == (len(numbers), min(numbers), max(numbers)), sorted(set(values))


def test_a_value_filling_a_third_of_a_column_changes_nothing(spark):
    values = ["x"] * 400 + [str(i) for i in range(800)]
    c = one_column(spark, values)
    assert (c["type"], c["rows"], c["distinct"], c["is_key_candidate"]) == ("mixed", 1200, 801, False)


def test_many_malformed_lines_are_counted_and_the_first_listed(spark, tmp_path):
    found = intake(spark, tmp_path, "a,b\n" + "".join(f"{i},x{',y' if i % 2 else ''}\n" for i in range(60)))
    flag = found.flags.filter("kind = 'malformed_rows'").first()
    assert flag["n_items"] == 30 and flag["items"] == [f"linha {n}" for n in range(3, 19, 2)] + ["… e mais 22"]


def test_measures_of_values_need_no_sort(spark):
    """Largest and smallest keys are texts; all distinct values would be sorted by column if only plain aggregates held them."""
    rows = spark.createDataFrame([("a", 0, v) for v in ("1", "true", "2024-01-05", None, "1.234", "1,5", "2.5", "x")], "dataset string, position int, cell string")
    values = P.dictionary(rows, P.KEYS)
    found = P.column_measures(P.classified(values), P.KEYS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    assert found.first()["kinds"] == 127
    empty = P.column_measures(P.classified(P.dictionary(rows.filter("cell IS NULL"), P.KEYS)), P.KEYS).first()
    assert (empty["kinds"], empty["nulls"]) == (0, 1)


def test_tables_read_in_even_parts_are_left_together(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    even, one = str(tmp_path / "even"), str(tmp_path / "one")
    spark.range(0, 8000, 1, cores).write.parquet(even)
    spark.range(0, 8000, 1, 1).write.parquet(one)
    assert read_evenly(spark.read.parquet(even), cores) and not read_evenly(spark.read.parquet(one), cores)
    assert spread(spark.read.parquet(one)).rdd.getNumPartitions() == cores
    assert sorted(r.id for r in spread(spark.read.parquet(one)).collect()) == list(range(8000))
    assert read_evenly(spark.read.parquet(one).filter("id < 0"), cores)  # nothing to spread


def test_numbers_of_one_form_are_measured_by_their_extremes(spark):
    """F6 to F9, F14: what is classified does not grow with the numbers of a column, and says the same of them."""
    import random

    pick = random.Random(7)

    def number():
        whole = "".join(pick.choice("0012345") for _ in range(pick.randint(1, 7)))
        grouped = f"{pick.randint(0, 999)}" + "".join(f".{pick.randint(0, 999):03d}" for _ in range(pick.randint(1, 4)))
        tail = pick.choice(["", ".", ",", ".0", ".50", ",0", ",125", ".12345678901", "e3", ",1" * 2])
        return pick.choice(["", "", "-", "+"]) + pick.choice([whole, grouped, "0", "00", ".5", "12-11-2024", "1.2.2024", "9" * 19]) + tail

    columns = [[number() for _ in range(200)] for _ in range(10)] + [[pick.choice(shapes) for _ in range(12)] for shapes in (
        ["0.123", "5.123", "-0.5", "-0.0"], ["007", "7", "-07", "+7"], ["1.234,50", "-9.999,00", "12,5", "0,5"], ["1.234.567", "-1.234", "999"],
        ["9" * 18, "-" + "9" * 17, "1" * 18], ["0", "-0", "+0"], [None, "", "x", "true", "2024-01-31", "31.12.2024"])]
    rows = spark.createDataFrame([("d", str(i), c) for i, column in enumerate(columns) for c in column], "dataset string, position string, cell string")
    values = P.dictionary(rows, P.KEYS).cache()
    assert P.folded(values, P.KEYS).filter("n > 0").agg({"n": "sum"}).first()[0] == rows.count()
    whole = P.resolved(P.column_measures(P.classified(values), P.KEYS)).drop("us_odd", "br_odd")
    by_form = P.resolved(P.column_measures(P.classified(P.folded(values, P.KEYS)), P.KEYS)).select(whole.columns)
    assert {(r.dataset, r.position): r for r in by_form.collect()} == {(r.dataset, r.position): r for r in whole.collect()}

    many = spark.range(5_000).selectExpr("'d' AS dataset", "explode(array('0', '1')) AS position", "id").selectExpr(
        "dataset", "position", "CASE position WHEN '0' THEN CAST(id AS STRING) ELSE concat(id, ',', lpad(id % 100, 2, '0')) END AS cell")
    assert P.folded(P.dictionary(many, P.KEYS), P.KEYS).count() <= 40


def test_a_cell_is_trimmed_of_all_whitespace(spark, rows_of):
    from plumbline.functions import values as V

    cells = {"a": "a", " a": "a", "a ": "a", "\u3000a\u00a0": "a", "é": "é", "é ": "é", " é!": "é!", "aé": "aé", "é\u2003": "é", "!\u00e9\u2003": "!é", "\t": None, "": None, None: None}
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    assert {r["cell"]: r["v"] for r in rows_of(df.select("cell", V.trimmed(df.cell).alias("v")))} == cells
