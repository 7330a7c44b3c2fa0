"""Composed state maps, walked arrays and clean prefixes against plain walks, with busy keys split."""

from __future__ import annotations

import datetime as dt
import random

from stockflow.operators import commands as C, ledger as L

T0 = dt.datetime(2024, 1, 1)
CMD = "inventory_id long, command_id string, ts timestamp_ntz, command string, quantity int, work_order_id long"


def ledger_rows(seed: int, clean: bool = False):
    """One location holds half of the rows; ``clean`` commands never fail a guard."""
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        loc = 1 if i % 2 else rng.randint(2, 9)
        if clean:
            c, q = rng.choice([("receive", 50), ("reserve", 1), ("adjust_by", 3)])
        else:
            c = rng.choice(["receive", "receive", "reserve", "release", "issue", "adjust", "adjust_by", "nonsense", None])
            q = rng.choice([None, -3, 0, 1, 2, 5, 9])
        rows.append((loc, f"c{i % 350:03d}", T0 + dt.timedelta(minutes=i // 3), c, q, None))
    return rows


def test_replay_with_busy_locations_equals_the_plain_walk(spark):
    opening = spark.createDataFrame([(i, 5 * i, i) for i in range(1, 7)], "inventory_id long, on_hand long, reserved long")
    for seed, clean in ((1, False), (2, False), (3, True)):
        # ids repeat within a location at different times only
        cmds = spark.createDataFrame(ledger_rows(seed, clean), CMD).dropDuplicates(["inventory_id", "ts", "command_id"])
        want = sorted(map(str, L.replay(cmds, opening, fast_path=False).collect()))
        assert sorted(map(str, L.replay(cmds, opening).collect())) == want
        assert sorted(map(str, L.replay(cmds, opening, busy_rows=20).collect())) == want
        closed = sorted(map(str, L.closing(L.replay(cmds, opening, fast_path=False)).collect()))
        assert sorted(map(str, L.replay_closing(cmds, opening).collect())) == closed
        assert sorted(map(str, L.replay_closing(cmds, opening, busy_rows=20).collect())) == closed
    split = L.clean_prefix(L._with_opening(spark.createDataFrame(ledger_rows(3, True), CMD), opening), 20)
    assert split.where("dirty").count() == 0


def walk(requests, status):
    out = {}
    for order in {r[1] for r in requests}:
        st = status.get(order)
        for e, _, ts, to in sorted((r for r in requests if r[1] == order), key=lambda r: (r[2], r[0])):
            before = st
            if st is None:
                why = "work_order_not_found"
            elif to is None or not 0 <= to <= 5:
                why = "invalid_status"
            elif to != 5 and (st, to) not in C.ALLOWED:
                why = "invalid_transition"
            else:
                why, st = None, to
            out[e] = (why, before, st)
    return out


def test_transitions_with_busy_orders_equal_the_plain_walk(spark):
    rng = random.Random(5)
    requests = [(i, 1 if i % 2 else rng.randint(2, 9), T0 + dt.timedelta(minutes=i // 4), rng.choice([0, 1, 1, 2, 2, 3, 3, 2, 3, 4, None, 7] + [5] * (i > 500)))
                for i in range(700)]
    status = {1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 4, 7: 5, 8: 0}
    req = spark.createDataFrame(requests, "event_id long, work_order_id long, ts timestamp_ntz, new_status int")
    wo = spark.createDataFrame(list(status.items()), "work_order_id long, status int")
    want = walk(requests, status)
    for rows in (50_000, 40, 7):
        got = {r.event_id: (r.reason, r.status_before, r.status_after) for r in C.apply_transitions(req, wo, chunk_rows=rows).collect()}
        assert got == want


def test_transitions_run_without_python(spark):
    req = spark.createDataFrame([(1, 1, T0, 1)], "event_id long, work_order_id long, ts timestamp_ntz, new_status int")
    wo = spark.createDataFrame([(1, 0)], "work_order_id long, status int")
    plan = C.apply_transitions(req, wo)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan


def test_queue_gives_units_of_failed_orders_to_later_ones(spark):
    rng = random.Random(8)
    parts = spark.createDataFrame([(i,) for i in range(6)], "part_id long")
    stocks = [(i * 10 + w, i, f"W{w}", rng.randint(0, 30), 0, True) for i in range(6) for w in range(3)]
    inv = spark.createDataFrame(stocks, "inventory_id long, part_id long, warehouse string, quantity_on_hand int, quantity_reserved int, is_active boolean")
    lines = [(o, n, rng.choice([0, 0, 0, 1, 2, 3, 4, 5] + [9] * (o % 13 == 0)), rng.choice([1, 2, 5, 9] + [None] * (o % 11 == 0)), T0 + dt.timedelta(minutes=o // 2))
             for o in range(60) for n in range(rng.randint(1, 4))]
    req = spark.createDataFrame(lines, "work_order_id long, line_no int, part_id long, quantity int, created_at timestamp_ntz")
    total, used, want = {p: sum(s[3] for s in stocks if s[1] == p) for p in range(6)}, {}, {}
    for o in range(60):
        mine, ok = {}, True
        for _, _, p, q, _ in [x for x in lines if x[0] == o]:
            ok &= p in total and q is not None and q >= 1
            if ok:
                mine[p] = mine.get(p, 0) + q
        want[o] = ok and all(used.get(p, 0) + q <= total[p] for p, q in mine.items())
        if want[o]:
            for p, q in mine.items():
                used[p] = used.get(p, 0) + q
    assert len({o for o, ok in want.items() if ok}) > 5 and not all(want.values())
    for chunk, finish in ((50_000, 200_000), (20, 0)):
        rows = L.allocate_queue(req, inv, parts, chunk, finish).collect()
        assert {r.work_order_id: r.order_committed for r in rows} == want
        taken = {}
        for r in rows:
            taken[r.part_id] = taken.get(r.part_id, 0) + r.taken
            assert r.order_committed or (r.taken == 0 and r.inventory_id is None)
        assert {p: n for p, n in taken.items() if n} == used
        assert max(sum(r.taken for r in rows if r.inventory_id == s[0]) - s[3] for s in stocks) <= 0


def test_numbers_are_dense_in_time_order(spark):
    from stockflow.operators import workorders
    rng = random.Random(2)
    rows = [(i, dt.datetime(2023 + (i % 3 == 0), rng.randint(1, 12), rng.randint(1, 28))) for i in range(300)]
    wo = spark.createDataFrame(rows, "work_order_id long, created_at timestamp_ntz")
    for chunk in (50_000, 15):
        got = {r.work_order_id: r.assigned_number for r in workorders.assign_numbers(wo, chunk).collect()}
        for year in (2023, 2024):
            mine = sorted((r for r in rows if r[1].year == year), key=lambda r: (r[1], r[0]))
            assert [got[i] for i, _ in mine] == [f"WO-{year}-{10000 + n}" for n in range(len(mine))]


def test_assignment_queue_counts_freed_slots_and_retries(spark):
    rng = random.Random(4)
    techs = [(i, i != 4, 3 if i == 5 else i % 2, 5 + i % 3) for i in range(6)]
    orders = [(o, rng.choice([None, 0, 1, 2, 9]) if o % 3 == 1 else None, rng.choice([0, 0, 1, 2, 4])) for o in range(40)]
    reqs = [(rng.randint(0, 42), rng.randint(0, 6), T0 + dt.timedelta(minutes=rng.randint(0, 60))) for _ in range(90)]
    shut = [(o, T0 + dt.timedelta(minutes=rng.randint(0, 60))) for o in range(0, 40, 3)]
    tech = {t[0]: t for t in techs}
    holder, status = {o[0]: o[1] for o in orders}, {o[0]: o[2] for o in orders}
    jobs = {t: sum(h == t and status[o] not in (4, 5) for o, h in holder.items()) for t in range(10)}
    st, closed, want = {t[0]: t[2] for t in techs}, {o for o in status if status[o] in (4, 5)}, []
    events = sorted([(at, 1, o, t) for o, t, at in reqs] + [(at, 0, o, -1) for o, at in shut])
    for at, kind, o, t in events:
        h = holder.get(o)
        if kind == 0:
            if o not in closed and h is not None:
                jobs[h] -= 1
            closed.add(o)
            continue
        before = jobs.get(t, 0)
        why = ("work_order_not_found" if o not in status else "technician_not_found" if t not in tech else "technician_inactive" if not tech[t][1]
               else "technician_at_capacity" if st[t] == 3 or before >= tech[t][3] else None)
        if why is None:
            if st[t] == 0 and before + 1 >= tech[t][3]:
                st[t] = 1
            if o not in closed and h != t:
                jobs[t] += 1
                if h is not None:
                    jobs[h] -= 1
            holder[o] = t
        want.append((o, t, at, why, h))
    got = C.assign_queue(spark.createDataFrame(reqs, "work_order_id long, technician_id long, requested_at timestamp_ntz"),
                         spark.createDataFrame(orders, "work_order_id long, technician_id long, status int"),
                         spark.createDataFrame(techs, "technician_id long, is_active boolean, status int, max_concurrent_jobs int"),
                         spark.createDataFrame(shut, "work_order_id long, closed_at timestamp_ntz")).collect()
    assert sorted(map(str, ((r.work_order_id, r.technician_id, r.requested_at, r.reason, r.previous_technician_id) for r in got))) == sorted(map(str, want))
    assert sum(w[3] is None for w in want) > 10


def test_state_tables_over_restarts_repeats_and_bases(spark):
    """Many small batches with a base every third one, every batch delivered twice, under changing settings."""
    from stockflow.sources import sinks
    from stockflow.streaming import jobs as T
    from stockflow.streaming.state_table import StateTable

    cmds = spark.createDataFrame(ledger_rows(6), CMD).dropDuplicates(["inventory_id", "ts", "command_id"]).where("ts is not null")
    opening = spark.createDataFrame([(i, 5 * i, i) for i in range(1, 7)], "inventory_id long, on_hand long, reserved long")
    out, folder = sinks.fresh_dir(spark, "st-out"), sinks.fresh_dir(spark, "st")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in range(5):
            spark.conf.set("spark.sql.shuffle.partitions", str(2 + n % 3))
            part = cmds.where(f"ts >= timestamp_ntz'2024-01-01 00:00:00' + interval {n * 30} minutes and ts < timestamp_ntz'2024-01-01 00:00:00' + interval {n * 30 + 30} minutes")
            for _ in range(2):
                state = StateTable(spark, folder, "inventory_id long, on_hand long, reserved long", "inventory_id", every=3)
                T.ledger_batch(part, n, state, out, opening)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = spark.read.schema(L.REPLAY_SCHEMA).parquet(out).select(*L.REPLAY_SCHEMA.names)
    assert sorted(map(str, got.collect())) == sorted(map(str, L.replay(cmds, opening).collect()))
    assert state.before(5).count() == cmds.select("inventory_id").distinct().count()


def test_dyadic_covers_and_a_busy_technician(spark):
    from pyspark.sql import functions as F
    from stockflow.operators import intervals
    rng = random.Random(3)
    spans = [(a := rng.randint(0, 4000), a + rng.choice([0, 1, 2, 7, 300, 9000, 3_000_000])) for _ in range(200)]
    rows = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", intervals._cover(F.col("lo"), F.col("hi")).alias("c")).collect()
    for r in rows:
        days = sorted(((n & 0xFFFFFFFF) << (n >> 32), ((n & 0xFFFFFFFF) + 1 << (n >> 32)) - 1) for n in r.c)
        assert len(days) <= 60 and days[0][0] == r.lo and days[-1][1] == r.hi
        assert all(a[1] + 1 == b[0] for a, b in zip(days, days[1:]))
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n, hours=rng.randint(0, 20))
    wo = []
    for i in range(250):
        a = rng.randint(0, 5000)
        end = rng.choice([a, a + 1, a + 3, a + 700, None])
        s, e = day(a), None if end is None else day(end)
        wo.append((i, 1 if i % 2 else rng.randint(2, 5), rng.choice([0, 1, 4]), s, e if e is None or e >= s else s))
    orders = spark.createDataFrame(wo, "work_order_id long, technician_id long, status int, scheduled_start timestamp_ntz, scheduled_end timestamp_ntz")
    never = dt.datetime(9999, 12, 31)
    want = {(a[0], b[0]) for a in wo for b in wo if a[0] < b[0] and a[1] == b[1] and a[2] < 4 and b[2] < 4
            and a[3] <= (b[4] or never) and b[3] <= (a[4] or never)}
    got = [(r.work_order_id_a, r.work_order_id_b) for r in intervals.schedule_conflicts(orders).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
