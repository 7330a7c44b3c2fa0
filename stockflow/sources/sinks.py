"""Sinks (S3 ledger append, S7 notification log append) and the stored event-stream source.

Paths are folders on shared storage. Jobs write whole results or nothing:
Spark's file committer only publishes task output of committed jobs, so a
lost executor means a retried task, not a half-written table. Scratch
folders for the registered jobs live under the session's
``spark.checkpoint.dir`` (never a machine-local temp folder on a cluster).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.session import scratch_dir


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint dir."""
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def append_ledger(tx: DataFrame, path: str) -> None:
    """S3: append ledger rows laid out by month and type (the columns the ledger is queried by).

    Rows are rebalanced by the partition columns first: small folders share a
    task, a folder with many rows is split over several (AQE splits what is
    above the advisory size), so no month waits for one task.
    """
    laid = tx.withColumn("transaction_month", F.date_format("transaction_date", "yyyy-MM"))
    (laid.hint("rebalance", "transaction_month", "transaction_type")
         .write.mode("append").partitionBy("transaction_month", "transaction_type").parquet(path))


NOTIFICATION_LOG_SCHEMA = T.StructType([
    T.StructField("notification_id", T.StringType()),
    T.StructField("work_order_id", T.LongType()),
    T.StructField("notification_type", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("recipient_customer_id", T.LongType()),
    T.StructField("subject", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("sent_at", T.TimestampNTZType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
])


def notification_rows(recipients: DataFrame, notification_type: str = "StatusChanged") -> DataFrame:
    """Recipient rows (J16) as notification-log rows; delivery is external, so attempts are logged
    as successful with no error unless the row carries its own outcome."""
    cols = recipients.columns
    return recipients.select(
        F.concat_ws("/", F.col("event_id").cast("string"), F.col("channel")).alias("notification_id"),
        F.col("work_order_id").cast("bigint"),
        F.lit(notification_type).alias("notification_type"),
        "channel",
        F.col("customer_id").cast("bigint").alias("recipient_customer_id"),
        "subject", "message",
        F.col("ts").alias("sent_at"),
        (F.col("success") if "success" in cols else F.lit(True)).alias("success"),
        (F.col("error_message") if "error_message" in cols else F.lit(None).cast("string")).alias("error_message"))


def append_notifications(rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append notification attempts (outcome and error included).

    With ``batch_id`` (streams) the rows replace that batch's folder, so a retried batch adds nothing.
    """
    out = rows.select(*[f.name for f in NOTIFICATION_LOG_SCHEMA.fields])
    if batch_id is None:
        out.write.mode("append").parquet(path)
    else:
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    """The notification log of a folder, without its batch folders' column."""
    return spark.read.schema(NOTIFICATION_LOG_SCHEMA).parquet(path).select(*NOTIFICATION_LOG_SCHEMA.fieldNames())


def read_events(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None,
                max_bytes: int = 1 << 30) -> DataFrame:
    """The stored events of a folder as a stream (fixed schema, bounded bytes or files per micro-batch)."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)
