"""Numbers of any precision: their order, their spelling, and what a profile and a reconciliation say of them."""

import random
from decimal import Decimal, getcontext

from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.operators import load, profile, reconcile

CASES = ["0", "-0", "0.0", "00", "+7", "007", "7.0", "70e-1", "1e30", "-1e30", "1E+30", ".5", "5.", "-.5", "0.12345678912", "0.123456789123",
         "1e-20", "-1e-20", "123456789" * 6, "-" + "123456789" * 6, "1e400", "1e1500", "0e99", "-0.10", "1" + "0" * 40, "12e-3", "1" + "0" * 1500]


def numbers(n):
    rng, found = random.Random(1), list(CASES)
    for _ in range(n):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(1, rng.choice([3, 12, 60]))))
        at = rng.randint(0, len(digits))
        plain = digits[:at] + "." + digits[at:] if rng.random() < 0.6 else digits
        power = f"e{rng.choice(['', '+', '-'])}{rng.randint(0, 50)}" if rng.random() < 0.3 else ""
        found.append(rng.choice(["", "-", "+"]) + plain + power)
    return found


def test_keys_sort_as_numbers_and_give_them_back(spark):
    getcontext().prec = 2000
    df = spark.createDataFrame([(v,) for v in numbers(600)], "v string")
    key = V.ordered_number(F.col("v"))
    rows = sorted(((Decimal(r.v), r.k, r.t, r.n) for r in df.select("v", key.alias("k"), V.number_text(key).alias("t"), V.number_key(F.col("v")).alias("n")).collect()),
                  key=lambda r: r[0])
    for a, b in zip(rows, rows[1:]):
        assert a[1] <= b[1] and (a[0] == b[0]) == (a[1] == b[1]) == (a[3] == b[3])
    assert all(Decimal(t) == d and ("E" in t or t == (format(d.normalize(), "f") if d else "0")) for d, _, t, _ in rows)


def test_a_power_of_ten_beyond_reach_has_no_key(spark):
    df = spark.createDataFrame([("1e999999999999999999",), ("0e999999999999999999",), (None,)], "v string")
    assert [r.k for r in df.select(V.ordered_number(F.col("v")).alias("k")).collect()][2] is None
    found = profile.profile(df, "t").first()
    assert found.out_of_range == 1 and found["distinct"] == 2


def test_bounds_keep_every_digit(spark):
    low, high = "-0." + "0" * 40 + "1", "0.12345678912345678901"
    wide = ["9" * 60, "1" + "0" * 60, "-" + "9" * 59]
    df = spark.createDataFrame(list(zip([low, high, "0"], wide, ["1e30", "2e29", "1,5e3"])), "a string, b string, c string")
    a, b, c = profile.profile(df, "t").orderBy("position").collect()
    assert (a.min, a.max, a.out_of_range) == (low, high, 0) and (b.min, b.max, b.type) == (wide[2], wide[1], "integer")
    assert c.type == "mixed" and c.min is None


def test_brazilian_bounds_keep_every_digit(spark):
    df = spark.createDataFrame([("1.234,000000000001",), ("1.234,0000000000011",), ("-7,5",)], "a string")
    a = profile.profile(df, "t").first()
    assert (a.number_style, a.min, a.max) == ("br", "-7.5", "1234.0000000000011")


def test_a_change_in_the_last_digit_diverges(spark):
    raw = spark.createDataFrame([("1.000000000000000000001", "0.1"), ("2.5", "1e300")], "a string, b string")
    mapping = spark.createDataFrame([("t", "a", "a", "decimal"), ("t", "b", "b", "double")], "dataset string, source string, target string, type string")
    plans = load.plan_columns(profile.profile(raw, "t"), mapping)
    loaded = load.typed_projection(raw, plans)
    assert {r.status for r in reconcile.reconcile(loaded, plans, 2).collect()} == {"OK"}
    moved = loaded.withColumn("a", (F.col("a") + F.lit("0.000000000000000000001").cast("decimal(22,21)")).cast(loaded.schema["a"].dataType))
    assert {r.verificacao for r in reconcile.reconcile(moved, plans, 2).filter("status = 'DIVERGE'").collect()} == {"min(a)", "max(a)"}
    nudged = loaded.withColumn("b", F.col("b") * 1.0000000000000002)
    assert "min(b)" in {r.verificacao for r in reconcile.reconcile(nudged, plans, 2).filter("status = 'DIVERGE'").collect()}


def test_sketches_merge_to_the_estimate_of_all(spark):
    rows = spark.range(30_000).selectExpr("CAST(id % 3 AS STRING) AS part", "'a' AS position", "CAST(id % 20000 AS STRING) AS cell")
    parts = profile.distinct_sketches(rows, ["part", "position"])
    whole = profile.distinct_estimates(profile.distinct_sketches(rows, ["position"]), ["position"]).first()["distinct_estimate"]
    merged = profile.distinct_estimates(parts, ["position"]).first()["distinct_estimate"]
    assert abs(merged - 20_000) <= 4 * profile.SKETCH_ERROR * 20_000 and abs(merged - whole) <= profile.SKETCH_ERROR * 20_000
    blank = spark.createDataFrame([("a", " "), ("a", None)], "position string, cell string")
    assert profile.distinct_estimates(profile.distinct_sketches(blank, ["position"]), ["position"]).first()["distinct_estimate"] == 0


def test_a_digest_tree_sums_up_and_finds_the_range(spark):
    source = spark.range(5000).selectExpr("id AS k", "CAST(id * 7 AS STRING) AS v")
    target = source.withColumn("v", F.when(F.col("k") == 77, "x").otherwise(F.col("v"))).filter("k <> 4000")
    tree = {(r.level, r.node): (r.rows, r.digest) for r in reconcile.digest_tree(source, ["k"], 256).collect()}
    assert tree[0, 0][0] == 5000 and {level for level, _ in tree} == {0, 1, 2}
    for (level, node), (rows, digest) in tree.items():
        children = [v for (m, n), v in tree.items() if m == level + 1 and n // 16 == node]
        assert level == 2 or (sum(c[0] for c in children), sum(c[1] for c in children)) == (rows, digest)
    assert reconcile.unequal_ranges(source, target, ["k"], 256).count() == 2
    found = sorted(map(tuple, reconcile.tree_differences(source, target, ["k"], 256).collect()))
    assert found == sorted(map(tuple, reconcile.keyed_differences(source, target, ["k"]).collect())) == [(77, "v", "539", "x"), (4000, "(row)", "present", None)]
    assert reconcile.tree_differences(source, source, ["k"]).count() == 0


def test_keys_are_worked_out_once_a_spelling(spark):
    rows = spark.createDataFrame([(v,) for v in ("1e3", "1000", "1e3", None, " 1e3", "007", "7")], "v string")
    column = {"dataset": "t", "position": 0, "name": "v", "number_style": "us"}
    found = profile.number_key_counts({"t": rows}, [column])
    assert [tuple(r) for r in found.collect()] == [("t", 0, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Lines go from the result to the input: the key is worked out above an aggregate by spelling.
    assert plan.index("regexp_replace") < plan.rindex("Aggregate")
