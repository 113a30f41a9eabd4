import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import evidence as E
from plumbline.operators import portfolio as Q
from plumbline.operators import runs as H
from plumbline.operators.ordered import blocks_by_count, median, median_ranks, nearest_rank, order_statistics, running
from plumbline.functions import spending as S

COSTS = {"daylight": 1.0, "horizon": 3.0, "twilight": 8.0, "starlight": 20.0, "aurora": 40.0}


def decision(spark, tiers_rates_costs, budget=50.0):
    rows = [("a", i, t, float(r), float(c)) for i, (t, r, c) in enumerate(tiers_rates_costs, 1)]
    attempts = spark.createDataFrame(rows, "artifact_id string, attempt_no int, tier string, pass_rate double, cost_usd double")
    history = H.attempt_history(attempts, F.floor(F.col("attempt_no") / 2))
    last = H.decide(history, COSTS, H.Policy(budget=budget)).orderBy(F.desc("attempt_no")).first()
    return last["action"], last["next_tier"], last["candidates"]


@pytest.mark.parametrize("attempts, budget, expected", [
    ([("daylight", 0.6, 1), ("daylight", 0.8, 1)], 50, ("refine", "daylight", 1)),
    ([("daylight", 0.7, 1), ("daylight", 0.71, 1)], 50, ("escalate", "horizon", 1)),
    ([("daylight", 0.7, 1), ("daylight", 0.6, 1)], 50, ("escalate", "horizon", 1)),
    ([("aurora", 0.7, 1), ("aurora", 0.7, 1)], 50, ("stop_stalled", None, 0)),
    ([("horizon", 0.6, 4), ("horizon", 0.8, 4)], 10, ("stop_budget", None, 0)),
    ([("daylight", 0.2, 1)], 50, ("parallel", "daylight", 2)),
    ([("daylight", 0.2, 1)], 2.5, ("refine", "daylight", 1)),
    ([("daylight", 0.96, 1)], 50, ("accept", None, 0)),
    ([("daylight", 0.5, 1)] * 4, 50, ("stop_exhausted", None, 0)),
    ([("unknown", 0.6, 1)], 50, ("error", None, 0)),
])
def test_refinement_rules(spark, attempts, budget, expected):
    assert decision(spark, attempts, budget) == expected


def test_running_totals_match_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 20)}", i, rng.randint(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    found = running(df, ["k"], ["i"], F.floor(F.col("i") / 100), {"total": F.col("v")}, {"best": F.col("v")}).collect()
    totals, best, expected = {}, {}, {}
    for k, i, v in rows:
        before = (totals.get(k, 0), best.get(k))
        totals[k], best[k] = totals.get(k, 0) + v, max(best.get(k, v), v)
        expected[i] = (totals[k], before[0], best[k], before[1])
    assert {r["i"]: (r["total"], r["total_before"], r["best"], r["best_before"]) for r in found} == expected


def test_blocks_hold_equal_counts_even_of_one_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i % 1000) for i in range(20_000)]
    cut = blocks_by_count(spark.createDataFrame(rows, "k string, i int"), ["k"], ["i"], blocks=8).collect()
    sizes = Counter(r["_block"] for r in cut)
    assert max(sizes.values()) < 2 * len(rows) / len(sizes) and len({r["_block"] for r in cut if r["k"] == "hot"}) > 1
    ordered = sorted((r["k"], r["i"], r["_block"]) for r in cut)
    assert all(a[2] <= b[2] for a, b in zip(ordered, ordered[1:]) if a[0] == b[0])
    assert len({(r["k"], r["i"], r["_block"]) for r in cut}) == len({(r["k"], r["i"]) for r in cut})


def test_running_totals_cut_by_count(spark):
    rows = [(None if i % 3 == 0 else i % 5, i, i % 7) for i in range(4000)]
    found = running(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], ["i"], sums={"total": F.col("v")}, maxes={"best": F.col("v")})
    totals, best, expected = {}, {}, {}
    for k, i, v in rows:
        totals[k], best[k] = totals.get(k, 0) + v, max(best.get(k, v), v)
        expected[i] = (k, totals[k], best[k])
    assert {r["i"]: (r["k"], r["total"], r["best"]) for r in found.collect()} == expected and found.columns[:3] == ["k", "i", "v"]


def test_timing_stats_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), ("b", None)], "g string, v double")
    assert {r["g"]: (r["n"], r["median"], r["mean"]) for r in Q.timing_stats(df, ["g"], "v").collect()} == {None: (2, 2.0, 2.0), "a": (1, 2.0, 2.0)}


def test_trailing_counts_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.4 else f"u{rng.randint(0, 9)}", rng.randint(0, 400_000) // 7 * 7) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, u string, s long").withColumn("at", F.timestamp_seconds("s"))
    found = {r["id"]: r["recent"] for r in H.trailing_counts(df, "u", "at").select("id", "recent").collect()}
    assert found == {i: sum(1 for _, v, t in rows if v == u and s - 86400 <= t <= s) for i, u, s in rows}


def test_null_users_are_counted_too(spark):
    rows = [(1, None, 0), (2, None, 3600), (3, "u", 3600), (4, None, 200_000)]
    df = spark.createDataFrame(rows, "id int, u string, s long").withColumn("at", F.timestamp_seconds("s"))
    assert {r["id"]: r["recent"] for r in H.trailing_counts(df, "u", "at").collect()} == {1: 1, 2: 2, 3: 1, 4: 1}


def test_order_statistics_match_sorting(spark):
    rng = random.Random(9)
    groups = {"ties": [rng.choice([1.5, 1.5, 1.5, 9.0]) for _ in range(400)], "one": [3.25], "same": [2.0] * 31,
              "wide": [rng.lognormvariate(0, 4) for _ in range(777)], None: [rng.random() for _ in range(50)],
              "far": [*[float(i % 97) for i in range(500)], 1e15]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    found = order_statistics(df, ["g"], "v", {**median_ranks(), "p95": nearest_rank(0.95)}).withColumn("median", median()).collect()
    assert {r["g"] for r in found} == set(groups)
    for r in found:
        ordered = sorted(groups[r["g"]])
        assert (r["lowest"], r["highest"]) == (ordered[0], ordered[-1])
        assert r["median"] == statistics.median(ordered) and r["n"] == len(ordered)
        assert r["p95"] == ordered[min(len(ordered) - 1, round(0.95 * (len(ordered) - 1)))]


def test_event_fold(spark):
    rows = [("r1", 1, "result", 5, "m1"), ("r1", 2, "checks", 9, "c"), ("r1", 3, "provider.response", 7, "p"), ("r1", 4, "result", 11, "m2"),
            ("r2", 1, "gate.blocked", 2, "cap"), ("r2", 2, "error", 4, "boom")]
    folded = {r["run_id"]: r for r in H.fold_events(spark.createDataFrame(rows, "run_id string, seq int, type string, t_ms long, payload string")).collect()}
    assert (folded["r1"]["status"], folded["r1"]["last_result"], folded["r1"]["elapsed_ms"]) == ("completed", "m2", 11)
    assert (folded["r2"]["status"], folded["r2"]["reason"]) == ("failed", "boom")


def test_best_run_prefers_the_approved_one(spark):
    rows = [(1, 1, "completed", "approved"), (1, 2, "completed", "pending"), (2, 3, "completed", None), (2, 4, "completed", "rejected"), (3, 5, "failed", None)]
    best = H.best_runs(spark.createDataFrame(rows, "dataset_id int, id int, status string, decision string")).collect()
    assert {r["dataset_id"]: r["id"] for r in best} == {1: 1, 2: 4}


def test_budgets_tiers_and_compression(spark):
    row = spark.range(1).select(
        S.budget_violations(F.lit(40000), F.lit(9000), F.lit(0.5)).alias("a"), S.budget_violations(F.lit(1), F.lit(1), F.lit(1.0)).alias("b"),
        S.tier_for_score(F.lit(15.5)).alias("c"), S.tier_for_score(F.lit(38.0)).alias("d"), S.compression_pays(F.lit(100), F.lit(90)).alias("e"),
        S.compression_pays(F.lit(0), F.lit(0)).alias("f"), S.complexity_score(F.lit(40), F.lit(2)).alias("g"), S.tier_cap(F.lit("nope")).alias("h"),
        S.call_cost(F.lit(100), F.lit(20), 100.0, 1000.0).alias("i")).first()
    assert tuple(row) == ("input token budget exceeded; output token budget exceeded", None, None, "horizon", True, False, 100.0, None, 0.03)


def test_economy_uses_reported_baselines(spark):
    runs = spark.createDataFrame([(1, 1, "approved", 3600000, 1.0, "2026-01-01 08:00:00", "2026-01-01 09:00:00"), (2, 2, "pending", 1000, 0.0, "x", None)],
                                 "dataset_id int, id int, decision string, elapsed_ms long, cost_usd double, created_at string, decided_at string")
    reported = spark.createDataFrame([(1, 20), (1, 14400), (1, 18000)], "dataset_id int, seconds int")
    rows = {r["id"]: r for r in H.economy(runs, H.baseline_medians(reported)).collect()}
    assert (rows[1]["manual_hours"], rows[1]["saving_hours"], rows[1]["saving_usd"], rows[1]["baselines"]) == (4.5, 2.5, 149.0, 2)
    assert (rows[2]["manual_hours"], rows[2]["saving_hours"], rows[2]["manual_is_reported"]) == (2.0, None, False)


def test_catalogs_without_evidence_are_skipped(spark):
    tables = spark.createDataFrame([], "table_name string, row_count long")
    assert E.row_count_check(tables, tables).first()["status"] == "skipped"


def test_overflow_finding(spark):
    rows = [("d", 2, "type_fits_data", "failed", ["population: int, valores até 7761620146 não cabem em int (use bigint)"]),
            ("d", 3, "type_fits_data", "failed", ["later"]), ("d", 1, "valid_types", "failed", []), ("d", 4, "valid_types", "passed", [])]
    failed = Q.failed_checks(spark.createDataFrame(rows, "dataset string, seq int, name string, status string, offenders array<string>"))
    assert [(r["check"], r["times"], r["example"][:10]) for r in failed.collect()] == [("type_fits_data", 2, "population"), ("valid_types", 1, "")]
    finding = Q.overflow_findings(failed).first()
    assert (finding["column"], finding["suggested"], finding["max"], finding["times"]) == ("population", "INT", "7761620146", 2)


def test_one_file_of_customers_becomes_events_in_many_tasks(spark):
    from plumbline.queries import histories

    assert histories.governed_events(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
