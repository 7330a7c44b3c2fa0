"""Sharding by jump consistent hashing: no ring table, and one more shard takes rows only into itself.

``shard_documents`` answers one row per input row. The shard depends on the row's key and the shard
count alone. Slots number the rows of a shard from 0 without gaps; they are not taken from one window
over a shard (a shard may hold a large part of all rows) but from ranks inside small (shard, block)
groups plus the counts of the earlier blocks, a table of shards x blocks rows.

Defined cases: a null text has no bytes (size is the overhead alone) and the CRC of the empty text;
a null key is placed by a fixed substitute key, so it also moves only into new shards; repeated rows
get the same shard and different slots. An empty table gives an empty result. Only the two named
columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

NULL_KEY = -1
#: fixed values of the published jump hash
MULTIPLIER, SHIFT, SCALE = 2862933555777941757, 33, float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys jump together until the last has landed."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    b = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    j = np.zeros(len(key), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            b[live] = j[live]
            key[live] = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            j[live] = ((b[live] + 1) * (SCALE / ((key[live] >> np.uint64(SHIFT)) + np.uint64(1)))).astype(np.int64)
            live = live[j[live] < shards]
    return b


def _jump_column(shards: int):
    @F.pandas_udf("int")
    def jump(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in parts:
            yield pd.Series(jump_hash(keys.to_numpy(), shards))
    return jump


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, rows_per_block: int = 100_000,
                    key_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (with one more shard) of every row.

    Slots follow (block, key, CRC, size) inside a shard, so they don't depend on how the input is split.
    """
    n = docs.count()
    blocks = max(1, -(-n // (shards * rows_per_block)))
    key = F.coalesce(F.col(key_column).cast("long"), F.lit(NULL_KEY))
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(F.col(key_column).alias("doc_id"), key.alias("k"),
                       (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = base.select("doc_id", "k", "size", "text_crc32", _jump_column(shards)("k").alias("shard"),
                         _jump_column(shards + 1)("k").alias("grown_shard"),
                         F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block"))
                                               - F.col("n")).alias("first_slot"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("k", "text_crc32", "size")) - 1
    return (placed.withColumn("rank", rank).join(before, ["shard", "block"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("first_slot") + F.col("rank")).cast("long").alias("slot"), "grown_shard"))
