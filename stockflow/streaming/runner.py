"""Run a streaming query to completion (``availableNow``) into a file sink and read the result back.

Registered streaming jobs use this so that the driver contract (a plain
DataFrame per query) holds: the stream drains every file present at start,
writes exactly-once through its checkpoint, and stops.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.functions.scalars import ntz_micros
from stockflow.sources.sinks import fresh_dir


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None):
    """Stateful operators fix their state-partition count from ``spark.sql.shuffle.partitions`` when a
    new checkpoint starts. Start new streams with the cluster's parallelism (not a fixed default such
    as 200 tiny state stores); the session value is restored afterwards."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    if n is None:
        try:
            n = max(spark.sparkContext.defaultParallelism, 1)
        except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect): keep the session value
            n = int(old)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _finish(q, timeout_s: int | None) -> None:
    """Wait for an ``availableNow`` stream; never return partial output."""
    done = q.awaitTermination(timeout_s) if timeout_s else (q.awaitTermination() or True)
    if not done:
        q.stop()
        raise TimeoutError(f"stream {q.name or q.id} did not drain within {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def drain_to_parquet(spark: SparkSession, stream: DataFrame, name: str, output_mode: str = "append",
                     timeout_s: int | None = None) -> DataFrame:
    out, ckpt = fresh_dir(spark, f"{name}-out"), fresh_dir(spark, f"{name}-ckpt")
    with state_partitions(spark):
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
                   .outputMode(output_mode).trigger(availableNow=True).start())
        _finish(q, timeout_s)
    return spark.read.schema(stream.schema).parquet(out)


def drain_slices(spark: SparkSession, df: DataFrame, ts_col: str, name: str, build: Callable[[DataFrame], DataFrame] | None = None,
                 handler: Callable[[DataFrame, int], None] | None = None, slices: int = 4, deliveries: int = 1,
                 timeout_s: int | None = None, staged: bool = False) -> DataFrame | None:
    """Deliver ``df`` in ``slices`` consecutive time ranges of equal width and drain the stream after each.

    Every delivery restarts the stream from its checkpoint, so state carries over as it does in a long-running
    job, and a slice is one micro-batch whatever its number of files. ``build`` turns the source stream into the
    result stream (returned from its file sink); ``handler`` is a foreachBatch function instead. With
    ``deliveries`` > 1 each slice arrives again. The input is computed once and staged; ``staged``: it is a
    plain read of stored files already.
    """
    path = fresh_dir(spark, name)
    out, ckpt = fresh_dir(spark, f"{name}-out"), fresh_dir(spark, f"{name}-ckpt")
    rows = df
    if not staged:
        stage = fresh_dir(spark, f"{name}-stage")
        df.write.parquet(stage)
        rows = spark.read.schema(df.schema).parquet(stage)
    at = ntz_micros(ts_col)
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    edges = [] if lo is None else [lo + (hi - lo) * i // slices for i in range(1, slices)]
    result = None
    with state_partitions(spark):
        for k in range(len(edges) + 1):
            some = rows
            if k:
                some = some.where(at >= F.lit(edges[k - 1]))
            if k < len(edges):
                some = some.where((at < F.lit(edges[k])) | at.isNull() if k == 0 else at < F.lit(edges[k]))
            for _ in range(deliveries):
                some.write.mode("append").parquet(path)
                source = spark.readStream.schema(df.schema).parquet(path)
                result = build(source) if build else source
                w = result.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
                w = w.foreachBatch(handler) if handler else w.format("parquet").option("path", out).outputMode("append")
                _finish(w.start(), timeout_s)
    return None if handler else spark.read.schema(result.schema).parquet(out)


def drain_foreach_batch(spark: SparkSession, stream: DataFrame, name: str,
                        handler: Callable[[DataFrame, int], None], timeout_s: int | None = None) -> None:
    ckpt = fresh_dir(spark, f"{name}-ckpt")
    with state_partitions(spark):
        q = (stream.writeStream.foreachBatch(handler).option("checkpointLocation", ckpt)
                   .trigger(availableNow=True).start())
        _finish(q, timeout_s)
