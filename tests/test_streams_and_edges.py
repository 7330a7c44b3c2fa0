"""Restarts, repeated batches, open-ended periods and NULL commands."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys
from decimal import Decimal

import pytest

from stockflow.operators import commands as C, intervals, ledger as L
from stockflow.sources import sinks
from stockflow.streaming import jobs as T
from stockflow.streaming.runner import _finish

T0 = dt.datetime(2024, 1, 1)
CMD = "inventory_id long, command_id string, ts timestamp_ntz, command string, quantity int, work_order_id long"


def test_ledger_stream_survives_a_restart_with_other_shuffle_partitions(spark):
    rows = [(i, f"r{i}", T0, "receive", 10, None) for i in range(8)]
    more = [(i, f"s{i}", T0 + dt.timedelta(1), "reserve", 5, None) for i in range(8)]
    path, out, ckpt = (sinks.fresh_dir(spark, n) for n in ("restart", "restart-out", "restart-ckpt"))
    old = spark.conf.get("spark.sql.shuffle.partitions")

    def drain(buckets):
        stream = spark.readStream.schema(CMD).parquet(path)
        q = (T.ledger_stream(stream, buckets=buckets).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        _finish(q, None)

    try:
        for part, n in ((rows, "2"), (more, "3")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.createDataFrame(part, CMD).write.mode("append").parquet(path)
            drain(16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    key = ["inventory_id", "command_id"]
    got = spark.read.schema(L.REPLAY_SCHEMA).parquet(out)
    assert got.orderBy(key).collect() == L.replay(spark.createDataFrame(rows + more, CMD)).orderBy(key).collect()
    assert got.where("not accepted").count() == 0
    spark.createDataFrame([(i, f"t{i}", T0 + dt.timedelta(2), "reserve", 1, None) for i in range(8)], CMD).write.mode("append").parquet(path)
    with pytest.raises(Exception, match="state buckets"):
        drain(8)


def test_a_repeated_batch_is_logged_once_and_failures_keep_their_events(spark):
    log, dead = sinks.fresh_dir(spark, "log"), sinks.fresh_dir(spark, "dead")
    batch = spark.createDataFrame([("1", "A"), ("2", "A")], "event_id string, event_type string")

    def boom(df, bid):
        raise RuntimeError("x" * 500)

    for _ in range(2):
        T.dispatch_batch(batch, 7, {"A": [("boom", boom)]}, log, dead)
    rows = spark.read.parquet(log).collect()
    assert len(rows) == 1 and rows[0].error.endswith("x" * 500)
    assert spark.read.parquet(dead).count() == 2


def _orders(spark, rows):
    return spark.createDataFrame(rows, "work_order_id long, technician_id long, status int, scheduled_start timestamp_ntz, scheduled_end timestamp_ntz")


def test_open_ended_periods(spark):
    day = lambda y, m=1, d=1: dt.datetime(y, m, d)
    o = _orders(spark, [(1, 1, 0, day(2024), None), (2, 1, 0, day(2031), day(2031, 1, 3)), (3, 1, 0, day(2020), day(2020, 1, 5)),
                        (4, 1, 0, day(2025), day(9999, 12, 31)), (5, 2, 0, day(2024), None), (6, 1, 4, day(2031), None)])
    got = {(r.work_order_id_a, r.work_order_id_b, r.overlap_start, r.overlap_end) for r in intervals.schedule_conflicts(o).collect()}
    assert got == {(1, 2, day(2031), day(2031, 1, 3)), (1, 4, day(2025), None), (2, 4, day(2031), day(2031, 1, 3))}
    probes = spark.createDataFrame([("p", day(2030))], "probe_id string, probe_ts timestamp_ntz")
    assert {r.work_order_id for r in intervals.periods_containing(o, probes).collect()} == {1, 4, 5}
    windows = spark.createDataFrame([("w", day(2019), day(2025, 6))], "window_id string, window_start timestamp_ntz, window_end timestamp_ntz")
    assert {r.work_order_id for r in intervals.periods_within(o, windows).collect()} == {3}


def test_exactly_ten_percent_is_no_alert(spark):
    d = Decimal
    ch = spark.createDataFrame([(1, d("0.70"), d("0.77")), (2, d("0.70"), d("0.78")), (3, d("0"), d("1")), (4, d("100"), d("89.99"))],
                               "part_id long, old_cost decimal(18,2), new_cost decimal(18,2)")
    assert {r.part_id for r in C.price_alerts(ch).collect()} == {2, 3, 4}


def test_null_commands_are_rejected(spark):
    parts = spark.createDataFrame([(1,)], "part_id long")
    cmds = spark.createDataFrame([(1, 1, None, None, None), (1, 2, "defaults", None, 5), (1, 3, "defaults", 1, 5)],
                                 "part_id long, seq long, command string, new_min int, new_max int").selectExpr(
        "*", "cast(null as decimal(18,2)) new_cost", "cast(null as decimal(18,2)) new_price", "cast(null as int) new_lead_time")
    assert {r.seq: r.reason for r in C.part_command_reasons(cmds, parts).collect()} == {1: "unknown_command", 2: "levels_required", 3: None}


def test_closed_orders_take_no_slot(spark):
    wo = spark.createDataFrame([(1, 1, 4), (2, None, 0), (3, None, 0), (4, None, 0)], "work_order_id long, technician_id long, status int")
    tech = spark.createDataFrame([(1, True, 0, 2)], "technician_id long, is_active boolean, status int, max_concurrent_jobs int")
    req = spark.createDataFrame([(i, 1, T0 + dt.timedelta(minutes=i)) for i in (1, 2, 3, 4)],
                                "work_order_id long, technician_id long, requested_at timestamp_ntz")
    got = {r.work_order_id: r.reason for r in C.apply_assignments(req, wo, tech).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "technician_at_capacity"}


def test_jobs_run_from_another_directory(tmp_path):
    code = ("import sys; sys.path.insert(0, %r)\n"
            "import __spark_entry__ as E\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "E.entry(s).count()\n"
            "print('rows', E.queries()['reservation_queue'](s, '/root/testdata/sf0.001').count())" % os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_no_local_checkpoint_folder_on_a_cluster():
    from stockflow.session import ensure_checkpoint_dir

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
