"""Run events as they arrive: folds per run, rows of closed runs, and quotas over sliding windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.runs import EVENT_TYPES, fold_events, run_rows
from plumbline.session import fresh_path

#: The event that closes a run, and events that say nothing about it.
CLOSING, PASSING = "done", ["done", "saved", "provider.delta"]


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder of part files, as a stream with the schema it has now."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A stream takes a plain path for a folder; a pattern may also be a single file.
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def _run_to_end(stream: DataFrame, out: str, mode: str) -> dict:
    """Process everything there is and stop. Each batch goes to its own folder, so a repeated batch replaces itself.
    Returns the last progress of the query."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return query.lastProgress


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What batches have written under a path; an empty table before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _schema_of(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def folded_runs(spark: SparkSession, events: DataFrame, **fold: object) -> DataFrame:
    """The event fold of every run, kept up to date batch by batch; the latest state of each run is returned."""
    out = fresh_path(spark, "run-folds")
    folded = fold_events(events, **fold)
    _run_to_end(folded, out, "update")
    latest = Window.partitionBy("run_id").orderBy(F.desc("batch"))
    rows = written(spark, f"{out}/data/*", _schema_of(folded, "batch int"))
    return rows.withColumn("_turn", F.row_number().over(latest)).filter("_turn = 1").drop("_turn", "batch")


#: Runs share this many states, so that a batch calls Python once a state and not once a run.
STATES = 1024


def closed_runs(spark: SparkSession, events: DataFrame, at: str = "at", idle: str = "1 hour", late: str = "10 minutes",
                states: int = STATES) -> tuple[DataFrame, int]:
    """The row of every run that has ended, and how many runs are still open.

    A run ends with its closing event, or when nothing was heard of it for ``idle`` beyond the watermark; what is kept
    of it, one payload for each event type, is dropped then. ``events`` is ``(run_id, seq, type, t_ms, payload, <at>)``,
    in order for each run; events after the closing one start a run anew. Runs are dealt into ``states`` by their hash;
    a state holds its open runs, each with a time of its own at which it ends.
    """
    out = fresh_path(spark, "closed-runs")
    run_type = events.schema["run_id"].dataType
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    fields = [f"last_{t.replace('.', '_')}" for t in EVENT_TYPES]
    folded = "run_id string, events long, elapsed_ms long, " + ", ".join(f"{f} string" for f in fields)
    columns = ["run_id", "events", "elapsed_ms", *fields, "opened"]

    def whole(number: float | None) -> int:
        return 0 if number is None or number != number else int(number)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = dict(json.loads(state.get[0])) if state.exists else {}
        before, heard_now = len(runs), set()
        if not state.hasTimedOut:
            for batch in batches:
                rows = batch.sort_values("seq", kind="stable")
                for run_id, seq, kind, t_ms, payload, at_ms in zip(*(rows[c].tolist() for c in ("run_id", "seq", "type", "t_ms", "payload", "at_ms"))):
                    heard_now.add(run_id)
                    heard = runs.setdefault(run_id, {"events": 0, "elapsed": 0, "last": {}, "at": 0, "closed": False})
                    heard["closed"] |= kind == CLOSING
                    heard["at"] = max(heard["at"], whole(at_ms))
                    if kind in PASSING:
                        continue
                    heard["events"] += 1
                    heard["elapsed"] = max(heard["elapsed"], whole(t_ms))
                    if heard["last"].get(kind, [-1])[0] <= seq:
                        heard["last"][kind] = [int(seq), payload]
        mark = state.getCurrentWatermarkMs()
        for run_id in heard_now:
            runs[run_id]["ends"] = max(runs[run_id]["at"], mark) + idle_ms
        ended = [r for r, heard in runs.items() if heard["closed"] or (r not in heard_now and heard["ends"] < mark)]
        rows = []
        for run_id in ended:
            heard = runs.pop(run_id)
            rows.append([run_id, heard["events"], heard["elapsed"], *[heard["last"].get(t, [0, None])[1] for t in EVENT_TYPES], None])
        if runs:
            state.update((json.dumps(list(runs.items())),))
            state.setTimeoutTimestamp(max(mark, min(heard["ends"] for heard in runs.values())))
        elif state.exists:
            state.remove()
        # Besides the ended runs, by how many the open ones have become more.
        rows.append([*[None] * (len(columns) - 1), len(runs) - before])
        yield pd.DataFrame(rows, columns=columns).astype({"events": "Int64", "elapsed_ms": "Int64", "opened": "Int64"})

    # Runs go through as text, whatever their type, so that no missing one makes numbers inexact.
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).select(
        F.col("run_id").cast("string").alias("run_id"), "seq", "type", "t_ms", "payload", F.unix_millis(at).alias("at_ms"), at,
        F.pmod(F.xxhash64("run_id"), F.lit(states)).alias("state"))
    kept = timed.groupBy("state").applyInPandasWithState(step, f"{folded}, opened long", "heard string", "append", GroupStateTimeout.EventTimeTimeout)
    _run_to_end(kept, out, "append")
    found = written(spark, f"{out}/data/*", _schema_of(kept, "batch int"))
    open_runs = found.agg(F.sum("opened")).first()[0] or 0
    return run_rows(found.filter("opened IS NULL").withColumn("run_id", F.col("run_id").cast(run_type))), open_runs


#: Hourly counts that one task turns into windows, 24 rows each.
HOURS_OF_A_TASK = 50_000


def window_quota(spark: SparkSession, events: DataFrame, user: str, at: str, late: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """``(user, window_start, runs)``: runs per user over 24 hours, a window starting every hour; and the late events.

    An event is late when it lies more than ``late`` behind the newest event of the batches before its own. Late
    events are in no window but kept, so windows and late events add up to all events. Each batch writes its counts
    by hour, its late events and its newest time to folders of its own: a repeated batch replaces itself. Hours become
    windows at the end, in tasks of a bounded number of rows.
    """
    out = fresh_path(spark, "quota")
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    counted = f"`{user}` {timed.schema[user].dataType.simpleString()}, hour timestamp, runs long"

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        before = written(own, f"{out}/newest/*", "batch int, newest timestamp").filter(F.col("batch") < batch_id)
        mark = before.agg(F.max("newest") - F.expr(f"INTERVAL {late}")).first()[0]
        marked = batch.withColumn("_late", F.coalesce(F.col(at) < F.lit(mark).cast("timestamp"), F.lit(False)))
        hours = marked.filter("NOT _late").groupBy(F.window(at, "1 hour").alias("w"), user).agg(F.count("*").alias("runs"))
        for name, rows in (("hours", hours.select(user, F.col("w.start").alias("hour"), "runs")),
                           ("late", marked.filter("_late").select(*batch.columns)),
                           ("newest", batch.agg(F.lit(batch_id).alias("batch"), F.max(at).alias("newest")))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")

    query = (timed.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    hours = written(spark, f"{out}/hours/*", counted)
    tasks = 1 + hours.count() // HOURS_OF_A_TASK
    # A user's hours are few once counted; windows start every hour, so an hour lies in the same windows as its events.
    by_user = hours.groupBy(user, "hour").agg(F.sum("runs").alias("runs")).repartition(tasks, user)
    each = by_user.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(23))))
    windows = each.groupBy(user, F.expr("hour - make_dt_interval(0, back)").alias("window_start")).agg(F.sum("runs").alias("runs"))
    return windows, written(spark, f"{out}/late/*", _schema_of(timed))
