"""Change sets applied to snapshots (S4 upsert, S5 audit stamps, S6 bulk update).

Plain Parquet has no MERGE, so an upsert is: the last change per key
(``max_by`` over the change sequence, a partial aggregate), an anti join that
removes every changed key from the base, and a union of the surviving
added / updated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADD, UPDATE, REMOVE = "add", "update", "remove"


def latest_changes(changes: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The last change of each key (ties in ``seq`` must not occur; the caller's order is total)."""
    cols = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*seq)).alias("_c"))
    return last.select(*key, "_c.*")


def upsert(base: DataFrame, changes: DataFrame, key: list[str], seq: list[str], op: str = "op") -> DataFrame:
    """Apply add / update / remove changes; the last change per key wins.

    ``changes`` carries every column of ``base`` plus ``op`` and the ``seq``
    columns. Removes drop the key; adds and updates replace the row.
    """
    last = latest_changes(changes, key, seq)
    keep = base.join(last.select(*key), key, "left_anti")
    new = last.where(F.col(op) != REMOVE).select(*base.columns)
    return keep.unionByName(new)


def stamp(changes: DataFrame, as_of: str, op: str = "op") -> DataFrame:
    """``created_at`` on adds, ``updated_at`` on updates (removes get neither)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return changes.withColumns({
        "created_at": F.when(F.col(op) == ADD, now),
        "updated_at": F.when(F.col(op) == UPDATE, now),
    })


def bulk_update(df: DataFrame, predicate: Column, sets: dict[str, Column]) -> DataFrame:
    """Set columns on every row matching ``predicate``; other rows unchanged.

    Adds ``changed`` so callers can count or write only the touched rows.
    """
    # evaluate the predicate once, on the old values, before any column is overwritten
    marked = df.withColumn("changed", F.coalesce(predicate, F.lit(False)))
    hit = F.col("changed")
    return marked.withColumns({c: F.when(hit, v).otherwise(F.col(c) if c in df.columns else F.lit(None))
                               for c, v in sets.items()})
