"""A column profile that grows by batches and equals the profile of everything at once.

What is kept is mergeable: how often each distinct value stands in each column. A batch writes its own counts; from
time to time the counts of all batches so far are merged into a new version. A version says up to which batch it
goes, so a batch that is repeated after a failure either replaces its own counts or is in the version already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.cells import cells
from plumbline.operators.profile import KEYS, dictionary, profile_of_values
from plumbline.session import fresh_path
from plumbline.streaming.run_events import written

_VALUES = "dataset string, position string, value string, long_length int, n long"


class GrowingProfile:
    """The counts of one dataset's columns under a folder."""

    def __init__(self, spark: SparkSession, dataset: str, columns: list[str], folder: str, merge_every: int = 8) -> None:
        self.spark, self.dataset, self.columns, self.folder, self.merge_every = spark, dataset, columns, folder, merge_every

    def _versions(self) -> DataFrame:
        return written(self.spark, f"{self.folder}/versions/*", "upto long")

    def upto(self) -> int:
        """The last batch that a version holds, -1 before the first version."""
        return self._versions().agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Add one batch. Batches come in rising order; the last ones may come again."""
        if batch_id <= self.upto():
            return
        plain = batch.toDF(*[f"c{i}" for i in range(len(batch.columns))])
        counted = dictionary(cells(plain).select(F.lit(self.dataset).alias("dataset"), "position", "cell"), KEYS)
        counted.write.mode("overwrite").parquet(f"{self.folder}/batches/batch_id={batch_id}")
        if (batch_id + 1) % self.merge_every == 0:
            self._merge(batch_id)

    def _merge(self, batch_id: int) -> None:
        """A new version; it counts from the moment its mark is there, which is written last."""
        self.values().write.mode("overwrite").parquet(f"{self.folder}/merged/upto={batch_id}")
        mark = self.spark.range(1).select(F.lit(batch_id).cast("long").alias("upto"))
        mark.write.mode("overwrite").parquet(f"{self.folder}/versions/upto={batch_id}")

    def values(self) -> DataFrame:
        """``(dataset, position, value, long_length, n)`` over all batches."""
        upto = self.upto()
        parts = written(self.spark, f"{self.folder}/batches", f"{_VALUES}, batch_id long").filter(F.col("batch_id") > upto).drop("batch_id")
        if upto >= 0:
            parts = parts.unionByName(self.spark.read.schema(_VALUES).parquet(f"{self.folder}/merged/upto={upto}"))
        return parts.groupBy(*KEYS, "value", "long_length").agg(F.sum("n").alias("n"))

    def profile(self) -> DataFrame:
        """The column profile of all rows so far."""
        return profile_of_values(self.values(), {self.dataset: self.columns})


def arriving_profile(spark: SparkSession, files: DataFrame, dataset: str, merge_every: int = 8) -> GrowingProfile:
    """Take in everything a stream of files holds now, batch by batch."""
    folder = fresh_path(spark, "growing")
    growing = GrowingProfile(spark, dataset, files.columns, folder, merge_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        growing.add(batch, batch_id)

    query = files.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return growing
