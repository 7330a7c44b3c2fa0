"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from stockflow.session import ensure_checkpoint_dir, ship_package


BATCH_BYTES = "1m"
#: intermediate files are written in small row groups, as a writer holds a whole group in memory
GROUP_BYTES = str(16 << 20)
#: bits of one row of Spark's bitmap aggregate
BUCKET = 1 << 15


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a worker holds one batch of texts and its results at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: keys of 16 bytes and an id: 200,000 are a few MB; larger sides are joined by shuffle
BROADCAST_ROWS = 200_000


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of docs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def by_key(docs: DataFrame, keys: DataFrame, how: str, doc: str = "doc_id") -> DataFrame:
    """left_semi or left_anti join of documents with (doc_id, tkey) keys, null ids included.

    tkey is the 64-bit key xxhash64(text). The keys are broadcast only when a count has shown them to be few.
    """
    d, t = fresh(docs, "key_d", "key_t")
    side = keys.select(F.col(doc).alias(d), F.col("tkey").alias(t))
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return docs.join(side, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(t)), how)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, waves: int = 4, **options: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: later jobs don't recompute it.

    At most ``waves`` files per core of the cluster are written, so intermediate steps don't leave
    thousands of tiny files; frames of links and keys take one wave.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.coalesce(waves * max(spark.sparkContext.defaultParallelism, 1)).write.options(**{"parquet.block.size": GROUP_BYTES} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(keys: DataFrame, column: str, slots: int) -> np.ndarray:
    """Bits of the slots of 64-bit keys, built by Spark's bitmap aggregate: slots / 8 bytes whatever the number of keys."""
    slot = F.col(column).bitwiseAND(slots - 1) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(slots // 8, dtype=np.uint8)
    for r in rows.collect():
        part = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        at = (r.b - 1) * (BUCKET // 8)
        out[at: at + len(part)] = part[: len(out) - at]
    return out


def _stars(e: DataFrame) -> bool:
    """Whether distinct links (u, v), v < u, are stars: no u has another link."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    return not ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 and n > 1").count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links by alternating large-star and small-star steps.

    Returns (node, root) for every node that has a link; root is the least node of its component.
    Each step is two shuffles on the links; hubs are pre-aggregated with min() and joined back, so a
    hub's links are never held together. Every step is written to the shared folder, which cuts lineage.
    Links end as stars around the roots, which one count over the nodes tells: links that come as stars take no step.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), waves=1)
    while not _stars(e):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = stored(small, waves=1)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
