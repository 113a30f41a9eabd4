"""Streams over files and folders, against what the batch operators say of the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile as P
from plumbline.operators import runs as H
from plumbline.streaming import growing, run_events as R

EVENTS = "run_id string, seq long, type string, t_ms long, payload string, at timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def parts(spark, tmp_path, schema, *batches):
    folder = str(tmp_path / "parts")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_a_table_is_one_file_or_a_folder(spark, tmp_path):
    folder = parts(spark, tmp_path, "u string, at timestamp", [("a", at(0))], [("a", at(1)), (None, at(2))])
    one = next((tmp_path / "parts").glob("*.parquet"))
    for path, n in ((folder, 3), (folder + "/", 3), (str(one), spark.read.parquet(str(one)).count())):
        windows, late = R.window_quota(spark, R.stream_table(spark, path), "u", "at")
        assert windows.agg(F.sum("runs")).first()[0] == 24 * n and late.count() == 0


@pytest.mark.parametrize("closing", ["done", None])
def test_runs_close_and_leave_no_state(spark, tmp_path, closing):
    first = [("a", 1, "gate.scored", 1, '{"tier":"horizon","score":40}', at(0)), ("a", 2, "provider.response", 5, '{"latency_ms":4}', at(1)),
             ("b", 1, "error", 2, '{"message":"boom"}', at(1)), ("a", 3, "result", 6, '{"mappings":{"x":"y"}}', at(2))]
    second = [("a", 4, "provider.delta", 99, "{}", at(3)), ("a", 5, "result", 7, '{"mappings":{"x":"z"},"error":""}', at(4)), ("a", 6, "checks", 8, '{"checks":[1],"pass_rate":1.0}', at(5))]
    if closing:
        second += [("a", 7, "done", 9, None, at(6)), ("b", 2, "done", 3, "{}", at(6))]
    far = [("z", 1, "done", 0, "{}", at(10_000))]
    rows, open_runs = R.closed_runs(spark, R.stream_table(spark, parts(spark, tmp_path, EVENTS, first, second, far), 1))
    batch = H.run_rows(H.fold_events(spark.createDataFrame([r for r in first + second if r[2] not in R.PASSING], EVENTS)))
    found = {r.run_id: r for r in rows.collect()}
    assert open_runs == 0 and {k: v for k, v in found.items() if k != "z"} == {r.run_id: r for r in batch.collect()}
    a, b = found["a"], found["b"]
    assert (a.status, a.mappings_json, a.elapsed_ms, a.tier, a.score, a.error, a.events) == ("completed", '{"x":"z"}', 8, "horizon", 40.0, None, 5)
    assert (b.status, b.error, b.mappings_json, b.edited) == ("failed", "boom", None, 0)


def test_open_runs_stay_open(spark, tmp_path):
    folder = parts(spark, tmp_path, EVENTS, [("a", 1, "result", 1, "{}", at(0)), ("b", 1, "done", 1, "{}", at(1))])
    rows, open_runs = R.closed_runs(spark, R.stream_table(spark, folder))
    assert [r.run_id for r in rows.collect()] == ["b"] and open_runs == 1


def test_late_events_are_kept_beside_the_windows(spark, tmp_path):
    folder = parts(spark, tmp_path, "u string, at timestamp", [("a", at(600)), ("b", at(0))], [("a", at(539)), ("a", at(540)), ("c", None)], [("a", at(601))])
    windows, late = R.window_quota(spark, R.stream_table(spark, folder, 1), "u", "at", "1 hour")
    assert [(r.u, r["at"]) for r in late.collect()] == [("a", at(539))]
    assert {r.u: r.n for r in windows.groupBy("u").agg(F.sum("runs").alias("n")).collect()} == {"a": 3 * 24, "b": 24}


COLUMNS = "a string, b string, c string, d string"
ROWS = [[("007", "1,50", "01/02/2024", None), ("7", "1.234,5", "13/02/2024", "")], [("7.0", "1,5", "1/3/2024", " "), ("8", None, "02/02/2024", None)],
        [("1e1", "x" * 90, "03/02/2024", None)], [("10", "1,5", "04/02/2024", None)]]


def test_a_profile_that_grew_equals_the_profile_of_all(spark, tmp_path):
    whole = spark.createDataFrame([r for b in ROWS for r in b], COLUMNS)
    grown = growing.arriving_profile(spark, R.stream_table(spark, parts(spark, tmp_path, COLUMNS, *ROWS), 1), "t", merge_every=2)
    expected = P.profile(whole, "t").orderBy("position").collect()
    assert grown.profile().orderBy("position").collect() == expected and grown.upto() == 3


def test_repeated_batches_change_nothing(spark, tmp_path):
    batches = [spark.createDataFrame(rows, COLUMNS) for rows in ROWS]
    grown = growing.GrowingProfile(spark, "t", batches[0].columns, str(tmp_path / "grown"), merge_every=3)
    assert [r.type for r in grown.profile().collect()] == ["empty"] * 4
    for i in (0, 0, 1, 1, 2, 2, 3, 2, 3):
        grown.add(batches[i], i)
    whole = P.profile(spark.createDataFrame([r for b in ROWS for r in b], COLUMNS), "t").orderBy("position").collect()
    assert grown.profile().orderBy("position").collect() == whole and grown.upto() == 2


def test_runs_that_share_a_state_end_each_at_their_time(spark, tmp_path):
    def said(run, seq, kind, minute):
        return (run, seq, kind, seq, '{"message":"m%d"}' % seq, at(minute))

    first = [said(f"r{i}", 1, "error", i) for i in range(40)] + [said(None, 1, "error", 1)]
    second = [said("r0", 2, "error", 85), *[said(f"r{i}", 2, "done", 80) for i in range(20, 40)], said("far", 1, "error", 95)]
    folder = parts(spark, tmp_path, EVENTS, first, second)
    rows, open_runs = R.closed_runs(spark, R.stream_table(spark, folder, 1), states=3)
    # The watermark ends at minute 85: runs last heard of before minute 25 are over, but for the one that went on.
    assert {r.run_id: (r.events, r.error) for r in rows.collect()} == {**{f"r{i}": (1, "m1") for i in range(1, 40)}, None: (1, "m1")} and open_runs == 2


def test_hours_become_windows_in_tasks_of_a_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "HOURS_OF_A_TASK", 2)
    rows = [("a", at(m)) for m in (0, 1, 59, 60, 1440)] + [("b", at(30))]
    windows, late = R.window_quota(spark, R.stream_table(spark, parts(spark, tmp_path, "u string, at timestamp", rows[:3], rows[3:]), 1), "u", "at", "100 hours")
    found = {(r.u, r.window_start): r.runs for r in windows.collect()}
    starts = {(u, at(60 * h)) for u, t in rows for h in range(-23, 25) if at(60 * h) <= t < at(60 * (h + 24))}
    assert found == {(u, s): sum(v == u and s <= t < s + dt.timedelta(hours=24) for v, t in rows) for u, s in starts} and late.count() == 0
    assert windows.rdd.getNumPartitions() == 3


def test_a_part_of_several_files_is_one_batch(spark, monkeypatch):
    from plumbline.queries import histories

    monkeypatch.setattr(histories, "FILE_ROWS", 10)
    rows = [spark.createDataFrame([("u", at(k * 1000 + i)) for i in range(n)], "u string, at timestamp") for k, n in ((3, 40), (2, 25), (1, 2))]
    folder, files = histories.parts_of(spark, rows, "several")
    windows, late = R.window_quota(spark, R.stream_table(spark, folder, files), "u", "at", "1 hour")
    assert files == 3 and late.count() == 27 and windows.agg(F.sum("runs")).first()[0] == 24 * 40
