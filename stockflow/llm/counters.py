"""Sums of fixed-size counter tables over all tasks of a job.

A task counts into one array, hands it on in segments, and segments are summed in parallel by
shuffle; the driver gets the summed table, whose size is a parameter and not the data's. Tables that are
turned into smaller numbers stay a frame of segments (``added``) until that is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT = 1 << 12
SPEC = "segment int, counts binary"


def emit(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The used segments of a task's counters (32 bits each where they fit)."""
    parts = counts.reshape(-1, SEGMENT)
    used = np.flatnonzero(parts.any(axis=1))
    for a in range(0, len(used), 32):
        ids = used[a: a + 32]
        blobs = [(parts[i].astype("<u4") if parts[i].max() < 1 << 32 else parts[i]).tobytes() for i in ids]
        yield pa.RecordBatch.from_pydict({"segment": pa.array(ids, pa.int32()), "counts": pa.array(blobs, pa.binary())})


def numbers(blob: bytes) -> np.ndarray:
    """The counters of a segment."""
    return np.frombuffer(blob, dtype="<u4" if len(blob) == 4 * SEGMENT else "<i8").astype(np.int64)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1)):
            c = numbers(c.as_py())
            total[s] = total[s] + c if s in total else c
    for s, c in total.items():
        blob = (c.astype("<u4") if c.max() < 1 << 32 else c).tobytes()
        yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "counts": pa.array([blob], pa.binary())})


def added(per_task: DataFrame) -> DataFrame:
    """The sum of all tasks' counters, a row per used segment."""
    return per_task.repartition("segment").mapInArrow(_add, SPEC)


def summed(per_task: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' counters: ``size`` numbers of 8 bytes (sent in 4 where they fit)."""
    out = np.zeros(size, dtype=np.int64)
    for row in added(per_task).collect():
        out[row.segment * SEGMENT: (row.segment + 1) * SEGMENT] = numbers(bytes(row.counts))
    return out
