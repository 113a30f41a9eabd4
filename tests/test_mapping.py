import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import spending as S
from plumbline.functions import types as Y
from plumbline.operators import load as L
from plumbline.operators import mapping as M

PROFILE = "dataset string, position int, name string, type string, min string, max string, has_time boolean"
MAPPING = "dataset string, source string, target string, type string, legacy boolean"


def profile_of(spark, *columns):
    return spark.createDataFrame([("d", i, *c) for i, c in enumerate(columns)], PROFILE)


def mapping_of(spark, *rows):
    return spark.createDataFrame([("d", *r, False) for r in rows], MAPPING)


def test_names(spark):
    names = {"Valor Total (R$)": "valor_total_r", "São Paulo": "sao_paulo", "2024 vendas": "c_2024_vendas", "***": "coluna",
             "ção-É": "cao_e", "x" * 200: "x" * 128, "Preço™": "precotm", "ofﬁce": "office", "№ pedido": "no_pedido", "½ dia": "c_12_dia"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", N.snake_case(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == names


def test_privacy_hints_and_safe_cells(spark):
    df = spark.createDataFrame([(n,) for n in ("cpf_cliente", "valor", "E-mail", "Telefone Celular", "quantidade")], "n string")
    assert [r["n"] for r in df.filter(N.privacy_hint(F.col("n")).isNotNull()).collect()] == ["cpf_cliente", "E-mail", "Telefone Celular"]
    cells = spark.createDataFrame([("=1+1",), ("ok",), (None,), ("-3",)], "c string").select(N.csv_safe(F.col("c")).alias("s"))
    assert [r["s"] for r in cells.collect()] == ["'=1+1", "ok", "", "'-3"]


@pytest.mark.parametrize("bad", ["", "1a", "a b", "a;drop", "a`b"])
def test_unsafe_identifiers_are_refused(bad):
    with pytest.raises(ValueError):
        N.check_identifier(bad, "table")


def test_wide_integers_do_not_fit_int(spark, rows_of):
    profile = profile_of(spark, ("id", "integer", "1", "9", False), ("population", "integer", "0", "7761620146", False), ("label", "text", None, None, False))
    mapping = mapping_of(spark, ("id", "id", "int"), ("population", "population", "int"), ("label", "label", "string"))
    checks = {r["name"]: r for r in rows_of(M.check_mapping(profile, mapping))}
    assert checks["type_fits_data"]["offenders"] == ["population: int, valores até 7761620146 não cabem em int (use bigint)"]
    assert [n for n, r in checks.items() if r["status"] == "failed"] == ["type_fits_data"]
    corrected, changes = M.correct_mapping(profile, mapping)
    assert {r["source"]: r["type"] for r in corrected.collect()} == {"id": "int", "population": "bigint", "label": "string"}
    assert [(r["from"], r["to"]) for r in changes.collect()] == [("int", "bigint")]


def test_corrections_are_complete_and_settle(spark):
    profile = profile_of(spark, ("Valor Total (R$)", "decimal", "1", "9", False), ("TOTAL_BRL", "integer", "1", "9", False), ("extra", "date", None, None, True))
    mapping = mapping_of(spark, ("Valor Total (R$)", "Valor Total", "decimal"), ("TOTAL_BRL", "valor_total", "money"), ("fantasma", "x", "int"))
    corrected, changes = M.correct_mapping(profile, mapping)
    assert [(r["target"], r["type"]) for r in corrected.orderBy("position").collect()] == [
        ("valor_total", "decimal"), ("valor_total_2", "int"), ("extra", "timestamp")]
    reasons = {(r["column"], r["reason"]) for r in changes.collect()}
    assert ("fantasma", "A coluna não existe no arquivo.") in reasons and ("TOTAL_BRL", "Destino repetido.") in reasons
    again, more = M.correct_mapping(profile, corrected)
    assert more.count() == 0
    assert all(r["status"] == "passed" for r in M.check_mapping(profile, again).collect())


# Columns in order, and the names they end up with.
SETTLED = [
    ("a a a", "a a_2 a_3"),
    ("a a_2 a", "a a_2 a_3"),
    ("a a a_2", "a a_2 a_2_2"),
    ("a_2 a a", "a_2 a a_3"),
    ("a a a_2 a_2 a_3 a", "a a_2 a_2_2 a_2_3 a_3 a_4"),
    ("a_2_2 a_2 a_2 a a", "a_2_2 a_2 a_2_3 a a_3"),
    ("a_02 a a a_02", "a_02 a a_2 a_02_2"),
    ("b c b_2 c b b", "b c b_2 c_2 b_3 b_4"),
    ("a_3 a_2 a a a", "a_3 a_2 a a_4 a_5"),
]


def test_unique_names(spark):
    rows = [(f"d{i}", position, base) for i, (bases, _) in enumerate(SETTLED) for position, base in enumerate(bases.split())]
    expected = {(f"d{i}", position): name for i, (_, names) in enumerate(SETTLED) for position, name in enumerate(names.split())}
    found = M.unique_names(spark.createDataFrame(rows, "dataset string, position int, base string")).collect()
    assert {(r["dataset"], r["position"]): r["unique"] for r in found} == expected


def test_many_repeats_stay_distinct_and_keep_first_names(spark):
    rng = random.Random(7)
    pool = ["a", "a_2", "a_3", "a_2_2", "b", "b_10", "c", "a_02"]
    bases = [rng.choice(pool) for _ in range(200)]
    rows = [("d", i, b) for i, b in enumerate(bases)]
    names = [r["unique"] for r in M.unique_names(spark.createDataFrame(rows, "dataset string, position int, base string")).orderBy("position").collect()]
    assert len(set(names)) == 200
    # Every earlier spelling of a column's name, from its own on, went to a column before it.
    before = set()
    for base, name in zip(bases, names):
        number = 1 if name == base else int(name.rsplit("_", 1)[1])
        assert name == base or name == f"{base}_{number}"
        assert {base if n == 1 else f"{base}_{n}" for n in range(1, number)} <= before and name not in before
        before.add(name)


def test_answers_are_parsed_or_refused(spark):
    texts = ['```json\n{"a": {"target": "x", "type": "int"}, "b": "y"}\n```', 'so: {"a": "z"} ok', "no mapping here", "{broken", '} {',
             '{"a":"x"} and {"b":"y"}', "{'a':'x'}", '{"a":"x"},{"b":"y"}', '{"a":"x","a":"y"}',
             '{"a": 5, "b": ["q"], "c": {"target": 5, "type": 7}, "d": null, "e": {}, "f": {"target": "t", "type": null}}', "{}", None]
    parsed = M.parsed_answers(spark.createDataFrame(list(enumerate(texts)), "id int, content string"))
    assert [r["id"] for r in parsed.filter("error is not null").orderBy("id").collect()] == [2, 3, 4, 5, 6, 7, 11]
    rows = {(r["id"], r["source"]): (r["target"], r["type"], r["legacy"]) for r in M.mapping_rows(parsed, ["id"]).collect()}
    none = (None, None, False)
    assert rows == {(0, "a"): ("x", "int", False), (0, "b"): ("y", None, True), (1, "a"): ("z", None, True), (8, "a"): ("y", None, True),
                    **{(9, c): none for c in "abcde"}, (9, "f"): ("t", None, False)}


def test_no_checks_is_no_evidence(spark):
    items = spark.createDataFrame([("a",), ("b",)], "k string")
    checks = spark.createDataFrame([("a", s) for s in ("passed", "failed", "passed", "passed")], "k string, status string")
    assert {r["k"]: r["pass_rate"] for r in M.pass_rates(items, checks, ["k"]).collect()} == {"a": 0.75, "b": 0.0}


def test_unsafe_plans_are_refused(spark):
    columns = PROFILE + ", max_int_digits int, max_scale int"
    profile = spark.createDataFrame([("d", 0, "a", "integer", "1", "2", False, 1, 0), ("d", 1, "b", "integer", "1", "2", False, 1, 0)], columns)
    for rows in ([("a", "x", "int")], [("a", "X", "int"), ("b", "y", "int")], [("a", "x", "int"), ("b", "x", "int")], [("a", "x", "money"), ("b", "y", "int")]):
        with pytest.raises(ValueError):
            L.plan_columns(profile, mapping_of(spark, *rows))


def test_type_names(spark):
    row = spark.range(1).select(
        Y.decimal_type(F.lit(4), F.lit(2)).alias("a"), Y.decimal_type(F.lit(40), F.lit(2)).alias("b"), Y.decimal_type(F.lit(None), F.lit(2)).alias("c"),
        Y.varchar_type(F.lit(9)).alias("d"), Y.varchar_type(F.lit(9000)).alias("e"), Y.tsql_type(F.lit("timestamp"), F.lit(1), F.lit(1), F.lit(1)).alias("f"),
        Y.hive_to_tsql(F.lit("DECIMAL(10,2)")).alias("g"), Y.warehouse_warning(F.lit("GEO")).alias("h")).first()
    assert tuple(row) == ("DECIMAL(10,2)", "DECIMAL(38,2)", "DECIMAL(38,10)", "VARCHAR(32)", "VARCHAR(8000)", "DATETIME2(6)", "decimal", "Tipo desconhecido: GEO")


def test_integers_of_any_length_are_told_from_int(spark, rows_of):
    profile = profile_of(spark, ("wide", "integer", "1", "9" * 60, False), ("edge", "integer", "-2147483648", "1", False), ("fits", "integer", "0", "2147483647", False))
    mapping = mapping_of(spark, ("wide", "wide", "int"), ("edge", "edge", "int"), ("fits", "fits", "int"))
    checks = {r["name"]: r for r in rows_of(M.check_mapping(profile, mapping))}
    assert [o.split(":")[0] for o in checks["type_fits_data"]["offenders"]] == ["wide", "edge"]


def test_own_checks_stand_beside_the_six(spark, rows_of):
    own = M.OwnChecks()

    @own.register("no_price", "no column is a price", "some column is a price")
    def no_price(rows):
        return rows.filter("name LIKE '%price%'").selectExpr("dataset", "position", "name AS offender")

    own.register("nothing")(lambda rows: rows.filter("false").selectExpr("dataset", "position", "name AS offender"))
    with pytest.raises(ValueError, match="already"):
        own.register("no_price")
    with pytest.raises(ValueError, match="already"):
        own.register("valid_types")
    profile = profile_of(spark, ("price", "decimal", "1", "9", False), ("id", "integer", "1", "9", False))
    mapping = mapping_of(spark, ("price", "price", "decimal"), ("id", "id", "int"))
    checks = rows_of(M.check_mapping(profile, mapping, own=own), "ordinal")
    assert [(r["name"], r["status"], r["offenders"], r["details"]) for r in checks[6:]] == [
        ("no_price", "failed", ["price"], "some column is a price"), ("nothing", "passed", [], "nothing: ok")]
    assert M.pass_rates(profile, M.check_mapping(profile, mapping, own=own), ["dataset"]).first()["passed"] == 7
    own.register("broken")(lambda rows: rows.select("dataset"))
    with pytest.raises(ValueError, match="offender"):
        M.check_mapping(profile, mapping, own=own)


def test_letters_beyond_the_basic_plane(spark):
    import unicodedata

    names = ["\U0001d400\U0001d401 \U0001d7d8", "\U0001f110x", "café \U0001f600", "ﬁn™", "\U0002f800", "a\U0001d552b"]
    expected = [unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in names]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(N.without_accents(F.col("n"))).collect()] == expected
    assert [r[0] for r in df.select(N.snake_case(F.col("n"))).collect()][0] == "ab_0"


def test_calls_are_refused_before_they_are_made(spark):
    rows = [(1000, "daylight", 1.0, 2.0, 1.0), (1000, "daylight", None, None, 1.0), (9000, "daylight", 1.0, 2.0, 1.0), (10, "nebula", 1.0, 2.0, 1.0),
            (1000, "daylight", 1.0, 2.0, 0.0033), (1000, "daylight", 1.0, None, 1.0), (1000, "daylight", 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "t long, tier string, pin double, pout double, left double").withColumn(
        "worst", S.worst_case_cost(F.col("t"), F.col("tier"), F.col("pin"), F.col("pout")))
    found = [(r.worst, r.no) for r in df.select("worst", S.refusal(F.col("t"), F.col("tier"), F.col("worst"), F.col("left")).alias("no")).collect()]
    assert found == [(0.0034, None), (0.001, None), (0.0114, "input token cap exceeded"), (None, "unknown tier"), (0.0034, "worst case exceeds the budget"),
                     (None, "unknown cost"), (0.0034, "worst case exceeds the budget")]


@pytest.mark.parametrize("name, ok", [("t_1", True), ("t_1\n", False), ("1t", False), ("", False), ("a" * 128, True), ("a" * 129, False), ("a;b", False)])
def test_identifiers_pass_or_are_refused_alike(spark, name, ok):
    assert spark.createDataFrame([(name,)], "n string").select(N.is_identifier(F.col("n"))).first()[0] is ok
    if ok:
        assert N.check_identifier(name, "table") == name
    else:
        with pytest.raises(ValueError, match="table"):
            N.check_identifier(name, "table")


def test_names_of_long_texts_cost_no_look_through_all_signs_for_each_character(spark, capsys):
    import re
    import unicodedata

    def expected(name):
        plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
        spelled = re.sub("[^0-9a-zA-Z]+", "_", plain).strip("_").lower()
        return (f"c_{spelled}" if spelled[:1].isdigit() else spelled)[:128]

    names = ["é" * 50 + "a" * n + after for n in (127, 128, 129) for after in ("™b", " é", "_", "!!x", "")] + ["字" * 3000 + "½ﬁé", "ж™" * 2000, " x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", N.snake_case(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == [expected(n) for n in names]
    df.explain("extended")
    assert "element_at" not in capsys.readouterr().out


def test_tasks_take_parts_of_a_bounded_size(spark):
    """Sorts of a join and of windows hold their rows many times over, so small shuffle parts are not made into large ones."""
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
    rows = spark.range(0, 600_000, 1, 8).selectExpr("id AS dataset", "sha2(CAST(id AS STRING), 256) AS base")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        # More than 16 MB of digests, which would be one part of the 64 MB that Spark asks for by itself.
        parts = rows.repartition("dataset").groupBy(F.spark_partition_id().alias("part")).agg(F.max("base").alias("last"))
        assert len(parts.collect()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
