from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from plumbline.operators import evidence
from plumbline.operators import load as L
from plumbline.operators import reconcile as R
from plumbline.plans.handover import approved_plan, load_and_reconcile
from plumbline.plans.intake import profile_file

TEXT = "pedido;data;valor;cliente;ativo\n" + "".join(
    f"{i:03d};{1 + i % 28:02d}/{1 + i % 12:02d}/2026;{i}.{100 + i},5{i % 10};José {i % 7};{'TRUE' if i % 2 else 'false'}\n" for i in range(1, 40))
ROWS = [("pedido", "id", "int"), ("data", "dia", "date"), ("valor", "valor", "decimal"), ("cliente", "cliente", "string"), ("ativo", "ativo", "boolean")]


@pytest.fixture(scope="module")
def intake(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "pedidos.csv"
    path.write_text(TEXT + TEXT.splitlines()[1] + "\n", encoding="utf-8")
    return profile_file(spark, str(path), "d")


def mapping(spark, rows=ROWS):
    return spark.createDataFrame([("d", *r, False) for r in rows], "dataset string, source string, target string, type string, legacy boolean")


def test_load_reconciles_and_refuses_to_run_twice(spark, intake, tmp_path):
    path = str(tmp_path / "out")
    checks = load_and_reconcile(intake, mapping(spark), path).orderBy("ordinal").collect()
    assert {r["status"] for r in checks} == {"OK"}
    names = [r["verificacao"] for r in checks]
    assert names[:5] == ["linhas", "nulos(id)", "distintos(id)", "min(id)", "max(id)"]
    assert {"min(dia)", "max(dia)", "min(valor)", "max(valor)", "distintos(valor)", "tamanho_max(cliente)"} <= set(names)
    assert not any("(ativo)" in n and n.startswith(("min", "max", "tam")) for n in names)
    with pytest.raises(L.LoadRefused):
        load_and_reconcile(intake, mapping(spark), path)


def test_one_changed_cell_diverges(spark, intake):
    plans = approved_plan(intake, mapping(spark))
    loaded = L.typed_projection(intake.rows, plans)
    damaged = loaded.withColumn("valor", F.when(F.col("id") == 5, F.lit(999999).cast("decimal(10,2)")).otherwise(F.col("valor")))
    status = {r["verificacao"]: r["status"] for r in R.reconcile(damaged, plans, 40).collect()}
    assert status["max(valor)"] == "DIVERGE" and status["linhas"] == "OK" and status["min(id)"] == "OK"
    assert R.compare_tables(loaded, damaged).first()["status"] == "failed"
    assert R.compare_tables(loaded, loaded.orderBy(F.desc("id"))).first()["status"] == "passed"


def test_lost_values_and_wrong_counts_stop_the_load(spark, intake, tmp_path):
    plans = approved_plan(intake, mapping(spark))
    broken = intake.rows.withColumn("valor", F.when(F.col("pedido") == "003", F.lit("abc")).otherwise(F.col("valor")))
    with pytest.raises(L.LoadRefused, match="valor"):
        L.load_table(broken, plans, str(tmp_path / "a"), 40)
    with pytest.raises(L.LoadRefused, match="measured"):
        L.load_table(intake.rows.filter("pedido <> '039'"), plans, str(tmp_path / "b"), 40)
    assert not (tmp_path / "a").exists() and not (tmp_path / "b").exists()


def test_duplicates_can_be_dropped(spark, intake, tmp_path):
    checks = load_and_reconcile(intake, mapping(spark), str(tmp_path / "once"), drop_duplicates=True).collect()
    assert {r["status"] for r in checks} == {"OK"}
    assert {r["verificacao"]: r["obtido"] for r in checks}["linhas"] == "39"
    assert not any(r["verificacao"].startswith(("nulos", "distintos")) for r in checks)


def test_failed_checks_block_the_plan(spark, intake):
    with pytest.raises(L.LoadRefused, match="type_fits_data"):
        approved_plan(intake, mapping(spark, [*ROWS[:3], ("cliente", "cliente", "int"), ROWS[4]]))


def test_row_differences_count_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    assert {(r["k"], r["source_copies"], r["target_copies"]) for r in R.row_differences(a, b).collect()} == {(1, 2, 1), (3, 0, 1)}


def test_digests_tell_moved_text_and_null_apart(spark):
    schema = "x string, y string"
    a = spark.createDataFrame([("a|b", "c"), (None, "k")], schema)
    b = spark.createDataFrame([("a", "b|c"), ("", "k")], schema)
    assert R.compare_tables(a, b).first()["status"] == "failed"
    assert R.compare_tables(a.limit(1), spark.createDataFrame([("a", "b|c")], schema)).first()["status"] == "failed"
    assert R.compare_tables(a.filter("x IS NULL"), b.filter("x = ''")).first()["status"] == "failed"


def test_keyed_differences_see_null_and_repeated_keys(spark):
    schema = "k int, j string, v string"
    a = spark.createDataFrame([(None, "p", "1"), (1, None, "2"), (2, "q", None), (3, "r", "x"), (4, "s", "a"), (4, "s", "b"), (5, "t", "a"), (5, "t", "b")], schema)
    b = spark.createDataFrame([(1, None, "9"), (2, "q", None), (3, "r", None), (4, "s", "b"), (4, "s", "a"), (5, "t", "a"), (6, None, None)], schema)
    found = {tuple(r) for r in R.keyed_differences(a, b, ["k", "j"]).collect()}
    assert found == {(None, "p", "(row)", "present", None), (1, None, "v", "2", "9"), (3, "r", "v", "x", None),
                     (5, "t", "(repeated key)", "2", "1"), (6, None, "(row)", None, "present")}


def test_numbers_too_large_diverge_without_ending_the_job(spark, intake):
    plans = approved_plan(intake, mapping(spark))
    loaded = L.typed_projection(intake.rows, plans).withColumn("valor", F.lit(1e30))
    status = {r["verificacao"]: r["status"] for r in R.reconcile(loaded, plans, 40).collect()}
    assert status["max(valor)"] == "DIVERGE" and status["min(id)"] == "OK"


def test_runtime_checks_tell_databases_apart_and_refuse_to_guess(spark):
    keyed = "database string, table_name string, row_count long"
    source = spark.createDataFrame([("d1", "t", 2), ("d2", "t", 3), ("d3", "u", 1), ("d3", "u", 1), (None, "t", 5)], keyed)
    target = spark.createDataFrame([("d1", "t", 2), ("d2", "t", 4)], keyed)
    rows = {"d1": spark.createDataFrame([("a", None), ("b", "")], "x string, y string"), "d2": spark.createDataFrame([("c", "1")] * 3, "x string, y string")}
    loaded = evidence.loaded_stats(rows["d1"], "t", "d1").unionByName(evidence.loaded_stats(rows["d2"], "t", "d2"))
    found = {(r.database, r.table_name): r for r in evidence.runtime_checks(source, target, loaded).collect()}
    assert {k: (r.status, r.row_count_status, r.checksum_status) for k, r in found.items()} == {
        ("d1", "t"): ("checked", "passed", "passed"), ("d2", "t"): ("checked", "passed", "failed"), ("d3", "u"): ("ambiguous", None, None),
        (None, "t"): ("skipped", None, None)}
    assert [tuple(n) for n in found["d1", "t"].nulls] == [("x", 0), ("y", 2)] and found["d1", "t"].null_cells == 2
    by_name = evidence.runtime_checks(source, target, loaded.drop("database")).collect()
    assert {r.status for r in by_name} == {"ambiguous"}


def test_a_load_publishes_once_and_leaves_nothing_beside_it(spark, intake, tmp_path):
    plans = approved_plan(intake, mapping(spark))
    path = str(tmp_path / "t")

    def load(_):
        try:
            L.load_table(intake.rows, plans, path, 40)
        except L.LoadRefused as refused:
            return str(refused)
        return "loaded"

    with ThreadPoolExecutor(2) as pool:
        said = sorted(pool.map(load, range(2)), key=lambda s: s == "loaded")
    assert said[1] == "loaded" and said[0] != "loaded" and spark.read.parquet(path).count() == 40
    with pytest.raises(L.LoadRefused, match="already holds data"):
        L.load_table(intake.rows, plans, path, 40)
    with pytest.raises(L.LoadRefused, match="measured"):
        L.load_table(intake.rows, plans, str(tmp_path / "u"), 41)
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_load_fills_an_empty_table_and_respects_a_claim(spark, intake, tmp_path):
    plans = approved_plan(intake, mapping(spark))
    path = str(tmp_path / "t")
    L.typed_projection(intake.rows, plans).limit(0).write.parquet(path)
    (tmp_path / "t__loading").touch()
    with pytest.raises(L.LoadRefused, match="another load"):
        L.load_table(intake.rows, plans, path, 40)
    (tmp_path / "t__loading").unlink()
    L.load_table(intake.rows, plans, path, 40)
    assert spark.read.parquet(path).count() == 40
    L.load_table(intake.rows, plans, str(tmp_path / "once"), 39, drop_duplicates=True)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 39
