"""Streaming behaviour: dispatch isolation of failing handlers, dedupe, stream equals batch."""

from __future__ import annotations

import datetime as dt


from stockflow.operators import ledger as L
from stockflow.sources import sinks
from stockflow.streaming import jobs as T
from stockflow.streaming.runner import drain_foreach_batch, drain_to_parquet

SCHEMA = "event_id string, event_type string, occurred_on timestamp_ntz, part_id long"


def _events(spark, rows):
    path = sinks.fresh_dir(spark, "test-events")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return path


def test_failing_handler_does_not_stop_others(spark):
    t = dt.datetime(2024, 1, 1)
    path = _events(spark, [("1", "A", t, 1), ("2", "A", t, 2), ("3", "B", t, 3)])
    log, seen = sinks.fresh_dir(spark, "log"), sinks.fresh_dir(spark, "seen")

    def boom(df, bid):
        raise RuntimeError("handler down")

    def keep(df, bid):
        df.write.mode("append").parquet(seen)

    handlers = {"A": [("boom", boom), ("keep", keep)]}
    stream = sinks.read_events(spark, path, spark.read.parquet(path).schema)
    drain_foreach_batch(spark, stream, "dispatch-test", lambda df, bid: T.dispatch_batch(df, bid, handlers, log))
    summary = {(r.event_type, r.handler): (r.events, r.failed_batches)
               for r in T.dispatch_summary(spark.read.parquet(log)).collect()}
    assert summary == {("A", "boom"): (2, 1), ("A", "keep"): (2, 0), ("B", None): (1, 0)}
    assert spark.read.parquet(seen).count() == 2


def test_dedupe_within_delay(spark):
    t = dt.datetime(2024, 1, 1)
    path = _events(spark, [("1", "A", t, 1), ("2", "A", t, 2)])
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(path)  # redelivery
    stream = sinks.read_events(spark, path, spark.read.parquet(path).schema)
    out = drain_to_parquet(spark, T.dedupe(stream, "1 day"), "dedupe-test")
    assert sorted(r.event_id for r in out.collect()) == ["1", "2"]


def test_ledger_stream_equals_batch(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", t, "receive", 10, None), (1, "b", t + dt.timedelta(1), "reserve", 8, None),
            (2, "c", t, "reserve", 1, None), (1, "d", t + dt.timedelta(2), "issue", 9, None),
            (1, "e", t + dt.timedelta(3), "release", 8, None)]
    schema = "inventory_id long, command_id string, ts timestamp_ntz, command string, quantity int, work_order_id long"
    path = sinks.fresh_dir(spark, "cmds")
    for r in rows[:3], rows[3:]:  # two arrivals, in time order
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(path)
    stream = sinks.read_events(spark, path, spark.read.parquet(path).schema)
    got = drain_to_parquet(spark, T.ledger_stream(stream), "ledger-test")
    want = L.replay(spark.createDataFrame(rows, schema))
    key = ["inventory_id", "command_id"]
    assert got.orderBy(key).collect() == want.orderBy(key).collect()
