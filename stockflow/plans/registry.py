"""Query registry: name -> (Spark job, DuckDB oracle text).

Each registered job takes ``(spark, sf_dir)`` and returns a lazy DataFrame.
Oracle texts are written as the tail after the shared fixture ``WITH`` list;
``oracle_sql()`` glues the prefix on (with ``RECURSIVE`` where needed).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stockflow.plans.fixture_sql import FIXTURE_WITH

Job = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    job: Job
    oracle_tail: str | None
    recursive: bool = False


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None = None, recursive: bool = False):
    def deco(fn: Job) -> Job:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, oracle, recursive)
        return fn
    return deco


def full_oracle(tail: str, recursive: bool = False) -> str:
    head = FIXTURE_WITH.strip()
    if recursive:
        head = "WITH RECURSIVE" + head[len("WITH"):]
    tail = tail.strip()
    return f"{head}\n{tail}"


def _load_all() -> None:
    # importing the plan modules registers their queries
    from stockflow.plans import (  # noqa: F401
        q_catalog, q_inventory, q_workorders, q_people, q_quality, q_ledger, q_commands,
        q_intervals, q_changes, q_scalars, q_streaming,
    )


def queries() -> dict[str, Job]:
    _load_all()
    return {n: e.job for n, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {n: full_oracle(e.oracle_tail, e.recursive) for n, e in REGISTRY.items() if e.oracle_tail}
