"""What must not grow faster than the input: sides sent through the driver, repeated folds, state and rounds."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stockflow.operators import intervals
from stockflow.operators import ledger as L

DAY0 = dt.datetime(2024, 1, 1)


def _orders(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = DAY0 + dt.timedelta(hours=rng.randrange(24 * 40))
        end = None if i % 9 == 0 else start + dt.timedelta(hours=rng.randrange(-2, 200))
        rows.append((i, i % 3, 0, None if i % 17 == 0 else start, end))
    return rows, spark.createDataFrame(
        rows, "work_order_id long, technician_id long, status int, scheduled_start timestamp_ntz, scheduled_end timestamp_ntz")


def test_interval_joins_broadcast_no_exploded_side(spark):
    rows, orders = _orders(spark)
    windows = [(f"w{i % 5}", DAY0 + dt.timedelta(days=3 * i, hours=i), DAY0 + dt.timedelta(days=3 * i + 9)) for i in range(10)] * 2
    w = spark.createDataFrame(windows, "window_id string, window_start timestamp_ntz, window_end timestamp_ntz")
    probes = w.select(F.col("window_id").alias("probe_id"), F.col("window_start").alias("probe_ts"))
    within = intervals.periods_within(orders, w)
    for df in (within, intervals.periods_containing(orders, probes), intervals.schedule_conflicts(orders)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    want = sorted((x, r[0]) for x, lo, hi in windows for r in rows if r[3] and r[4] and lo <= r[3] and r[4] <= hi)
    assert want and sorted((r.window_id, r.work_order_id) for r in within.collect()) == want


def _counted(df):
    """The same rows, and how many of them were made in all."""
    acc = df.sparkSession.sparkContext.accumulator(0)

    def run(frames):
        for pdf in frames:
            acc.add(len(pdf))
            yield pdf
    return df.mapInPandas(run, df.schema), acc


def _commands(spark, n=400, seed=5):
    rng = random.Random(seed)
    kinds = ["receive", "receive", "reserve", "release", "issue", "adjust", "adjust_by"]
    rows = [(rng.randrange(12), f"c{i:05d}", DAY0 + dt.timedelta(hours=rng.randrange(500)), rng.choice(kinds), rng.randrange(-3, 30), i % 7) for i in range(n)]
    inv = [(i, i // 2, f"W{i % 2}", None if i == 3 else i, 50) for i in range(10)]
    return (spark.createDataFrame(rows, "inventory_id long, command_id string, ts timestamp_ntz, command string, quantity int, work_order_id long"),
            spark.createDataFrame(inv, "inventory_id long, part_id long, warehouse string, minimum_stock_level int, reorder_quantity int"))


def test_reorder_suggestions_make_their_events_once(spark):
    cmds, inv = _commands(spark)
    low = L.low_stock_events(L.replay(cmds), inv).localCheckpoint()
    counted, acc = _counted(low)
    out = L.reorder_suggestions(counted).collect()
    assert out and acc.value == len(out) == low.count()
    got = sorted((r.warehouse, r.urgency_rank) for r in out)
    assert got == sorted((w, k + 1) for w in ("W0", "W1") for k in range(sum(r.warehouse == w for r in out)))


def test_all_events_are_both_kinds_in_one_pass(spark):
    cmds, inv = _commands(spark)
    rep = L.replay(cmds).localCheckpoint()
    counted, acc = _counted(rep)
    got = L.all_events(counted, inv)
    want = L.inventory_events(rep, inv).unionByName(L.low_stock_events(rep, inv))
    assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    rows = sorted(map(str, got.collect()))
    assert acc.value == rep.count()
    assert rows == sorted(map(str, want.collect()))


def test_replay_reads_the_opening_states_once(spark):
    cmds, inv = _commands(spark)
    opening, acc = _counted(inv.selectExpr("inventory_id", "40L AS on_hand", "5L AS reserved"))
    L.replay(cmds, opening).collect()
    assert acc.value == inv.count()


def _queue(spark, n=300, seed=11):
    rng = random.Random(seed)
    req = [(o, line, rng.randrange(8), rng.randrange(0 if o % 50 == 0 else 1, 9), DAY0 + dt.timedelta(hours=o // 3))
           for o in range(n) for line in range(rng.randrange(1, 4))]
    inv = [(i, i % 7, f"W{i // 7}", 100 + 10 * i, i, True) for i in range(21)]
    return (spark.createDataFrame(req, "work_order_id long, line_no int, part_id long, quantity int, created_at timestamp_ntz"),
            spark.createDataFrame(inv, "inventory_id long, part_id long, warehouse string, quantity_on_hand int, quantity_reserved int, is_active boolean"),
            spark.range(8).withColumnRenamed("id", "part_id"))


def test_queue_rounds_keep_open_orders_only_and_agree_with_the_walk(spark):
    req, inv, parts = _queue(spark)
    walked = sorted(map(str, L.allocate_queue(req, inv, parts).collect()))
    counted, acc = _counted(req)
    rounds = L.allocate_queue(counted, inv, parts, chunk_rows=20, finish_rows=10)
    assert sorted(map(str, rounds.collect())) == walked
    assert acc.value == req.count()
