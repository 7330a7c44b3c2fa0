"""Plan regression tests: properties that must hold for the plans to scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from stockflow.plans import registry

from .conftest import SF001

# jobs that write files or run streams while they are built
SIDE_EFFECTS = {"ledger_stream", "status_stream", "event_dispatch", "event_dedupe", "low_stock_alert_stream",
                "notification_stream", "price_event_stream", "event_stream_source", "ledger_append",
                "notification_log_append"}
# the library's own queries; the optional training-data operators have their tests in tests/llm
PLAN_QUERIES = sorted(n for n in registry.queries() if n not in SIDE_EFFECTS)


def physical(spark, name: str) -> str:
    return E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_each_fold_runs_once_and_no_cartesian(spark, name):
    plan = physical(spark, name)
    assert plan.count("MapInPandas") <= 1, "a fold kernel is computed more than once"
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stock_summary_prunes_lineitem_columns(spark):
    plan = physical(spark, "warehouse_summaries")
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem", plan)
    assert scans and all(len(s.split(",")) <= 4 for s in scans)


def test_filters_reach_the_scan(spark):
    plan = physical(spark, "parts_by_category")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(p_type,PROMO\)", plan)


def test_only_fixed_dimensions_carry_broadcast_hints(spark):
    for name in PLAN_QUERIES:
        df = E.queries()[name](spark, SF001)
        hinted = df._jdf.queryExecution().analyzed().toString()
        for m in re.finditer(r"ResolvedHint \(strategy=broadcast\)", hinted):
            # the first relation under the hint is the hinted one: it must be nation (n_*) or region (r_*)
            rel = re.search(r"Relation \[(\w+)#", hinted[m.end():])
            assert rel and rel.group(1).startswith(("n_", "r_")), (name, rel.group(1) if rel else None)
