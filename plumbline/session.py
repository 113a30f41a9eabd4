"""Session settings the jobs rely on, and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Parts of a size whose distinct values fit the memory of a task, and enough of them that no core waits for the last.
    "spark.sql.files.maxPartitionBytes": "8m",
    # Compressed: rows that a join and windows sort take many times that in a task's memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # HotSpot compiles no method beyond this size; such stages run faster as separate steps that it does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A pruned CSV read lets malformed rows through, because the dropped fields are never counted.
    "spark.sql.csv.parser.columnPruning.enabled": "false",
    # The CSV reader only accepts windows-1252 with the wider charset list.
    "spark.sql.legacy.javaCharsets": "true",
    # Of a name given twice in a JSON object the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "plumbline", cores: int | str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        # Recording the call site of every expression costs seconds on plans of this size.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster that folder would exist on one
    machine and be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="plumbline-")


def folders(spark: SparkSession, *paths: str) -> tuple:
    """The file system of the first path, and all of them as its paths."""
    jvm = spark.sparkContext._jvm
    places = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return (places[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *places)


def create_only(files: JavaObject, place: JavaObject) -> bool:
    """Create an empty file; ``False`` if there is one already."""
    try:
        files.create(place, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName() or "already exists" in str(error.java_exception):
            return False
        raise
    return True


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = folders(spark, path)
    files.delete(place, True)


_handed_out: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has written to yet. It is removed when the driver ends."""
    if not _handed_out:
        atexit.register(remove_handed_out)
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _handed_out.append((spark, path))
    return path


def kept_in_order(df: DataFrame) -> DataFrame:
    """The rows, partition after partition in the order they have, kept in the shared folder; reading them sorts nothing.
    They are removed when the driver ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    if not _handed_out:
        atexit.register(remove_handed_out)
    if (spark, context.getCheckpointDir()) not in _handed_out:
        _handed_out.append((spark, context.getCheckpointDir()))
    return df.checkpoint()


def remove_handed_out() -> None:
    """Remove the intermediate tables of this driver, as far as its session still answers."""
    while _handed_out:
        spark, path = _handed_out.pop()
        try:
            remove_folder(spark, path)
        except Exception:  # the session has ended before the driver
            _handed_out.clear()
