"""One reusable ordered fold: apply guarded commands per key in a stated order.

Order-dependent guards (a rejection changes every later outcome of that key)
cannot be expressed with prefix sums alone, and collecting a key's history
into one array would hold a hot key entirely in memory. So the fold is a
streaming scan:

    repartition(key) -> sortWithinPartitions(key, order) -> mapInPandas(kernel)

Spark hash-partitions and sorts (spilling as needed); each task then walks
its sorted rows in Arrow batches, carrying only the current key's state
across batch boundaries. Memory is O(batch), whatever the size of a key.

A *kernel* is ``kernel(pdf, carry) -> out_pdf`` where ``carry`` is a dict the
kernel may read and update (it survives from one batch to the next within a
task). Kernels are small per-row helpers over numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stockflow.session import ship_package

Kernel = Callable[[pd.DataFrame, dict], pd.DataFrame]


def sorted_fold(df: DataFrame, key: list[str], order: list[str], kernel: Kernel,
                schema: T.StructType | str, num_partitions: int | None = None) -> DataFrame:
    """Run ``kernel`` over each task's rows sorted by (key, order)."""
    parts = df.repartition(num_partitions, *key) if num_partitions else df.repartition(*key)
    ordered = parts.sortWithinPartitions(*key, *order)
    ship_package(df.sparkSession)

    def run(batches):
        carry: dict = {}
        for pdf in batches:
            if len(pdf):
                yield kernel(pdf, carry)

    return ordered.mapInPandas(run, schema)
