"""Keyed state of a stream as a table in the shared folder: one row per key, written batch by batch.

A stateful step runs as a batch job per micro-batch (``foreachBatch``): the keys of the batch meet their last state, the
same SQL as the batch twin folds their rows, and the changed keys' new states are written under the batch's number. So
a key's state is one row whatever the number of keys, parallelism is that of the batch plan and not of a number
fixed in a checkpoint, and a busy key is split as the batch twin splits it.

Folders: ``delta=<n>`` holds the states that batch n changed, ``base=<n>`` all states before batch n; a base is made
every ``every`` batches, so a batch reads one base and at most ``every`` deltas. A repeated batch overwrites its own
folders and reads only earlier ones: the result is the same, and with it the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StateTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, every: int = 8):
        self.spark, self.path, self.schema, self.key, self.every = spark, path.rstrip("/"), schema, key, every

    def _read(self, *names: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(*[f"{self.path}/{n}" for n in names])

    def _latest(self, start: int, end: int) -> DataFrame:
        """The last state of every key from base ``start`` and the deltas up to ``end`` (exclusive)."""
        names = ([f"base={start}"] if start else []) + [f"delta={n}" for n in range(start, end)]
        if not names:
            return self.spark.createDataFrame([], f"{self.schema}, batch long")
        rows = self._read(*names)
        others = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*others), "batch").alias("_s")).select(self.key, "_s.*")

    def before(self, batch: int) -> DataFrame:
        """State of every key before a batch; makes the base that is due first."""
        start = batch // self.every * self.every
        if start and start == batch:
            self._latest(start - self.every, start).write.mode("overwrite").parquet(f"{self.path}/base={start}")
        return self._latest(start, batch).drop("batch")

    def write(self, changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/delta={batch}")
