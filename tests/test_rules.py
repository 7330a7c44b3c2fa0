"""Rule tests on tiny frames: the source application's own test cases and the
semantics list (SURVEY §1.5)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stockflow.functions import scalars as X
from stockflow.operators import catalog, commands as C, intervals, inventory as I, ledger as L, quality as Q, workorders as W

T0 = dt.datetime(2024, 1, 1)

INV_SCHEMA = ("inventory_id long, part_id long, warehouse string, bin_location string, quantity_on_hand int, "
              "quantity_reserved int, minimum_stock_level int, maximum_stock_level int, reorder_quantity int, "
              "is_active boolean")
PART_SCHEMA = ("part_id long, part_number string, part_name string, description string, category string, "
               "unit_cost decimal(18,2), unit_cost_currency string, unit_price decimal(18,2), "
               "unit_price_currency string, supplier_id long, lead_time_days int, default_minimum_stock_level int, "
               "default_maximum_stock_level int, is_discontinued boolean, is_active boolean")
CMD_SCHEMA = "inventory_id long, command_id string, ts timestamp_ntz, command string, quantity int, work_order_id long"


def inv_rows(spark, rows):
    return spark.createDataFrame(rows, INV_SCHEMA)


def parts(spark):
    from decimal import Decimal as D
    return spark.createDataFrame([
        (1, "HYD-001", "Hydraulic Pump", None, "Hydraulics", D("1200"), "USD", D("1800"), "USD", None, 5, 0, 0, False, True),
        (2, "HYD-002", "Hydraulic Cylinder", None, "Hydraulics", D("800"), "USD", D("1200"), "USD", None, 5, 0, 0, False, True),
        (3, "ENG-001", "Engine Oil", None, "Engine", D("50"), "USD", D("75"), "USD", None, 5, 0, 0, False, True),
    ], PART_SCHEMA)


def cmds(spark, rows):
    return spark.createDataFrame(
        [(r[0], str(i), T0 + dt.timedelta(minutes=i), r[1], r[2], None) for i, r in enumerate(rows)], CMD_SCHEMA)


def replay_rows(spark, rows, opening=None, fast=True):
    return [r.asDict() for r in L.replay(cmds(spark, rows), opening, fast_path=fast).orderBy("ts").collect()]


# -- stock (§5) -----------------------------------------------------------------------------------

def test_low_stock_is_inclusive(spark):
    inv = inv_rows(spark, [(1, 1, "Main", "A", 3, 0, 10, 50, 40, True), (2, 2, "Main", "B", 30, 0, 10, 50, 40, True),
                           (3, 3, "Main", "C", 0, 0, 0, 50, 50, True)])
    low = {r.inventory_id for r in I.low_stock(inv).collect()}
    assert low == {1, 3}  # min 0 and available 0 is low


def test_nothing_received_is_out_of_stock(spark):
    inv = inv_rows(spark, [(1, 1, "Main", "A", 0, 0, 10, 50, 40, True)])
    assert I.out_of_stock(inv).count() == 1


def test_totals_over_three_warehouses(spark):
    inv = inv_rows(spark, [(1, 1, "Main", "A-12-3", 30, 10, 10, 50, 40, True),
                           (2, 1, "East", "B-05-1", 20, 0, 5, 30, 25, True),
                           (3, 1, "West", "C-08-2", 15, 0, 8, 40, 32, True)])
    t = I.part_totals(parts(spark), inv).where("part_id = 1").first()
    assert t.total_on_hand == 65 and t.total_available == 55


def test_available_after_reservation(spark):
    inv = inv_rows(spark, [(1, 1, "Main", "A", 30, 10, 10, 50, 40, True), (2, 1, "East", "B", 15, 0, 5, 30, 25, True)])
    assert I.part_totals(parts(spark), inv).where("part_id = 1").first().total_available == 35


def test_receive_reserve_issue(spark):
    out = replay_rows(spark, [(1, "receive", 30), (1, "reserve", 10), (1, "issue", 10)])
    assert all(r["accepted"] for r in out)
    assert (out[-1]["on_hand_after"], out[-1]["reserved_after"]) == (20, 0)
    ev = L.inventory_events(L.replay(cmds(spark, [(1, "receive", 30), (1, "reserve", 10), (1, "issue", 10)])),
                            inv_rows(spark, [(1, 1, "Main", "A", 0, 0, 10, 50, 40, True)]))
    assert sorted(r.event_type for r in ev.collect()) == ["InventoryIssued", "InventoryReceived", "InventoryReserved"]


def test_reserve_more_than_available_is_rejected(spark):
    out = replay_rows(spark, [(1, "receive", 5), (1, "reserve", 6)])
    assert out[1]["accepted"] is False and out[1]["reason"] == "insufficient_available"
    assert out[1]["reserved_after"] == 0


def test_adjust_to_target(spark):
    out = replay_rows(spark, [(1, "receive", 30), (1, "adjust", 28)])
    assert out[-1]["on_hand_after"] == 28
    ev = L.inventory_events(L.replay(cmds(spark, [(1, "receive", 30), (1, "adjust", 28)])),
                            inv_rows(spark, [(1, 1, "Main", "A", 0, 0, 10, 50, 40, True)]))
    adj = ev.where("event_type = 'InventoryAdjusted'").first()
    assert (adj.old_qty, adj.new_qty, adj.difference) == (30, 28, -2)


def test_guards(spark):
    out = replay_rows(spark, [(1, "receive", 0), (1, "receive", 10), (1, "reserve", 8), (1, "release", 9),
                              (1, "issue", 9), (1, "adjust", 7), (1, "adjust", -1), (1, "adjust_by", -3)])
    assert [r["reason"] for r in out] == ["invalid_quantity", None, None, "insufficient_reserved",
                                          "insufficient_reserved", "target_below_reserved", "negative_target",
                                          "target_below_reserved"]


def test_fast_path_equals_walk(spark):
    rows = [(k, c, q) for k in range(1, 6) for c, q in
            [("receive", 10 * k), ("reserve", 7), ("issue", 3), ("release", 9), ("adjust_by", -2), ("reserve", 40),
             ("issue", 4), ("adjust", 12)]]
    key = ["inventory_id", "command_id"]
    a = L.replay(cmds(spark, rows), fast_path=True).orderBy(key).collect()
    b = L.replay(cmds(spark, rows), fast_path=False).orderBy(key).collect()
    assert a == b


def test_low_stock_events_fire_on_issue_and_adjust_only(spark):
    inv = inv_rows(spark, [(1, 1, "Main", "A", 0, 0, 10, 50, 40, True)])
    rep = L.replay(cmds(spark, [(1, "receive", 12), (1, "reserve", 5), (1, "issue", 1), (1, "adjust_by", 0)]))
    ev = L.low_stock_events(rep, inv).collect()
    assert len(ev) == 2 and all(e.available <= e.min_level and e.reorder_qty == 40 for e in ev)


def test_bin_move_and_deactivate(spark):
    inv = inv_rows(spark, [(1, 1, "Main", "A-1", 5, 0, 1, 10, 9, True)])
    c = spark.createDataFrame(
        [(1, "1", T0, "move_bin", None, "B-2"), (1, "2", T0 + dt.timedelta(1), "deactivate", None, None),
         (1, "3", T0 + dt.timedelta(2), "adjust", 0, None), (1, "4", T0 + dt.timedelta(3), "deactivate", None, None),
         (9, "5", T0, "receive", 1, None)],
        "inventory_id long, command_id string, ts timestamp_ntz, command string, quantity int, new_bin string")
    out = L.apply_location_commands(inv, c).orderBy("inventory_id", "ts").collect()
    assert out[0].ledger_note == "Moved from A-1 to B-2" and out[0].bin_location == "B-2"
    assert out[1].reason == "stock_on_hand" and out[3].accepted and out[3].is_active is False
    assert out[4].reason == "location_not_found"


def test_alerts_and_reorder(spark):
    inv = inv_rows(spark, [(1, 1, "Main", "A", 3, 0, 10, 50, 40, True), (2, 2, "East", "B", 4, 1, 5, 30, 25, True),
                           (3, 3, "West", "C", 30, 0, 8, 40, 32, True), (4, 99, "West", "D", 0, 0, 8, 40, 32, True)])
    alerts = I.low_stock_alerts(inv, parts(spark)).collect()
    assert len(alerts) == 2  # the location of an unknown part is dropped (inner join)
    assert all(a.current_quantity <= a.minimum_stock_level for a in alerts)
    assert {a.reorder_quantity for a in alerts} == {47, 27}


def test_warehouse_summary_entry_points(spark):
    inv = inv_rows(spark, [(1, 1, "Main", "A", 3, 0, 10, 50, 40, True), (2, 2, "Main", "B", 4, 0, 5, 30, 25, False),
                           (3, 99, "Main", "C", 10, 0, 1, 30, 25, True)])
    all_rows = I.warehouse_summary(inv, parts(spark)).first()
    active = I.warehouse_summary(inv, parts(spark), active_only=True).first()
    assert all_rows.total_parts == 3 and active.total_parts == 2
    assert float(all_rows.total_inventory_value) == 3 * 1200 + 4 * 800  # missing part adds 0


def test_part_with_inventory(spark):
    inv = inv_rows(spark, [(1, 1, "Main", "A", 30, 0, 10, 50, 40, True), (2, 1, "East", "B", 15, 0, 5, 30, 25, True)])
    r = I.part_with_inventory(parts(spark), inv).where("part_id = 1").first()
    assert (r.total_on_hand, r.total_available, r.location_count) == (45, 45, 2)
    assert [l.warehouse for l in r.locations] == ["East", "Main"]


# -- parts ----------------------------------------------------------------------------------------

def test_discontinue_and_margin(spark):
    c = spark.createDataFrame([(1, 1, T0, "discontinue", None, None, None, None, None)],
                              "part_id long, seq long, ts timestamp_ntz, command string, new_cost decimal(18,2), "
                              "new_price decimal(18,2), new_min int, new_max int, new_lead_time int")
    p = C.apply_part_commands(parts(spark), c).where("part_id = 1").first()
    assert p.is_discontinued and not p.is_active
    v = {r.part_number: r for r in catalog.parts_view(parts(spark)).collect()}
    assert round(v["HYD-001"].profit_margin, 6) == round((1800 - 1200) / 1800 * 100, 6)


def test_margin_rules(spark):
    df = spark.createDataFrame([(0.0, 5.0, "USD", "USD"), (10.0, 12.0, "USD", "USD"), (10.0, 5.0, "usd", "EUR")],
                               "price double, cost double, pc string, cc string")
    r = df.select(X.profit_margin("price", "cost", "pc", "cc").alias("m"),
                  X.margin_error("price", "cost", "pc", "cc").alias("e")).collect()
    assert r[0].m == 0.0 and r[1].m is None and r[1].e == "negative amount" and r[2].e == "currency mismatch"


def test_search_and_blank_filters(spark):
    p = parts(spark)
    assert catalog.parts_search(p, "HYDRAULIC").count() == 2
    assert catalog.parts_search(p, "  ").count() == 3
    assert catalog.parts_by_category(p, "").count() == 3
    req = spark.createDataFrame([("HYD-001",), (" ",)], "requested_number string")
    got = {r.requested_number: r.found for r in catalog.parts_by_number(p, req).collect()}
    assert got == {"HYD-001": True, " ": False}


# -- work orders and technicians -----------------------------------------------------------------

WO_SCHEMA = ("work_order_id long, work_order_number string, customer_id long, vin string, equipment_type string, "
             "priority int, status int, technician_id long, created_at timestamp_ntz, scheduled_start timestamp_ntz, "
             "scheduled_end timestamp_ntz, estimated_labor_hours decimal(8,2), estimated_cost decimal(18,2), "
             "actual_cost decimal(18,2)")
TECH_SCHEMA = ("technician_id long, first_name string, last_name string, skill_level int, status int, "
               "max_concurrent_jobs int, is_active boolean")


def wo(spark, rows):
    base = ("WO-2024-10000", 1, "1HGBH41JXMN109186", "Excavator", 3)
    full = []
    for (wid, status, tech, start, end) in rows:
        full.append((wid, base[0], base[1], base[2], base[3], base[4], status, tech, T0, start, end, None, None, None))
    return spark.createDataFrame(full, WO_SCHEMA)


def test_capacity_and_assignment(spark):
    tech = spark.createDataFrame([(1, "J", "Unior", 1, 0, 2, True), (2, "S", "Enior", 3, 0, 4, True)], TECH_SCHEMA)
    orders = wo(spark, [(10, 1, 1, None, None), (11, 0, 1, None, None), (12, 0, None, None, None)])
    load = {r.technician_id: r for r in W.tech_workload(tech, orders).collect()}
    assert load[1].active_job_count == 2 and load[1].can_accept_new_job is False  # a Pending order counts
    req = spark.createDataFrame([(12, 1, T0), (12, 2, T0 + dt.timedelta(1))],
                                "work_order_id long, technician_id long, requested_at timestamp_ntz")
    res = {(r.work_order_id, r.technician_id): r for r in C.apply_assignments(req, orders, tech).collect()}
    assert res[(12, 1)].reason == "technician_at_capacity"  # the first request; junior already has 2
    assert res[(12, 2)].reason == "duplicate_request"
    req2 = spark.createDataFrame([(12, 2, T0)], "work_order_id long, technician_id long, requested_at timestamp_ntz")
    r = C.apply_assignments(req2, orders, tech).first()
    assert r.accepted and r.status_after == 1 and r.jobs_after == 1


def test_transitions(spark):
    orders = wo(spark, [(1, 0, None, None, None), (2, 4, None, None, None)])
    req = spark.createDataFrame(
        [(1, 1, T0, 2), (2, 1, T0 + dt.timedelta(1), 1), (3, 1, T0 + dt.timedelta(2), 2), (4, 1, T0 + dt.timedelta(3), 2),
         (5, 1, T0 + dt.timedelta(4), 4), (6, 2, T0, 5), (7, 2, T0 + dt.timedelta(1), 5), (8, 3, T0, 1)],
        "event_id long, work_order_id long, ts timestamp_ntz, new_status int")
    out = {r.event_id: r for r in C.apply_transitions(req, orders).collect()}
    assert [out[i].accepted for i in range(1, 9)] == [False, True, True, False, True, True, True, False]
    assert out[8].reason == "work_order_not_found"  # unknown order
    per = C.actual_periods(C.apply_transitions(req, orders)).first()
    assert per.actual_start == T0 + dt.timedelta(2) and per.actual_end == T0 + dt.timedelta(4)


def test_pending_only_and_delays(spark):
    past, later = dt.datetime(1998, 1, 1), dt.datetime(1998, 1, 2)
    orders = wo(spark, [(1, 0, None, past, later), (2, 1, 1, past, later), (3, 4, 1, past, later),
                        (4, 5, 1, past, later)])
    assert [r.work_order_id for r in W.wo_pending(orders).collect()] == [1]
    flagged = {r.work_order_id: r.is_delayed for r in W.with_is_delayed(orders, "1999-01-01 00:00:00").collect()}
    listed = {r.work_order_id for r in W.wo_delayed(orders, "1999-01-01 00:00:00").collect()}
    assert flagged == {1: True, 2: True, 3: False, 4: True} and listed == {1, 2}


def test_all_parts_available_true_without_lines(spark):
    orders = wo(spark, [(1, 0, None, None, None), (2, 0, None, None, None)])
    lines = spark.createDataFrame([(2, 5, 1, 3, False)],
                                  "work_order_id long, part_id long, line_no int, quantity_required int, is_available boolean")
    got = {r.work_order_id: r.all_parts_available for r in W.all_parts_available(orders, lines).collect()}
    assert got == {1: True, 2: False}


# -- scalars -------------------------------------------------------------------------------------------

def test_address_parse(spark):
    df = spark.createDataFrame([("123 St",), (" ",), ("1 Main, Dallas, tx, 75001",), ("1 Main, Dallas, tx, 7500",)],
                               "a string")
    r = df.select(X.parse_address("a").alias("p")).collect()
    assert (r[0].p.street, r[0].p.city, r[0].p.state, r[0].p.zip_code) == ("123 St", "Unknown", "TX", "00000")
    assert r[1].p.street == "Unknown" and r[2].p.state == "TX" and r[2].p.zip_code == "75001"
    assert r[3].p.error is not None and r[3].p.street is None


def test_vin_rules(spark):
    df = spark.createDataFrame([(" 1hgbh41jxmn109186 ",), ("SHORT",), ("1HGBH41JXMN10918!",)], "v string")
    r = df.select(X.vin_valid("v").alias("ok"), X.vin_short("v").alias("s")).collect()
    assert [x.ok for x in r] == [True, False, False] and r[0].s == "MN109186"


def test_interval_buckets_match_brute_force(spark):
    rows = []
    for i in range(40):
        s = dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i)
        rows.append((i, 1 + i % 2, 0, s, s + dt.timedelta(hours=3 + (i * 13) % 60)))
    full = [(wid, "n", 1, "v", "t", 1, st, tech, T0, s, e, None, None, None) for wid, tech, st, s, e in rows]
    orders = spark.createDataFrame(full, WO_SCHEMA)
    got = {(r.work_order_id_a, r.work_order_id_b)
           for r in intervals.schedule_conflicts(orders).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows
            if a[0] < b[0] and a[1] == b[1] and a[3] <= b[4] and a[4] >= b[3]}
    assert got == want


def test_validations_flag_bad_rows(spark):
    inv = inv_rows(spark, [(1, 1, "", "A", 5, 6, -1, 10, 0, True)])
    r = Q.validate_inventory(inv).first()
    assert not r.valid and "Warehouse is required" in r.reasons and "Reserved quantity exceeds quantity on hand" in r.reasons


def test_fused_closing_equals_closing_of_replay(spark):
    rows = [(k, c, q) for k in range(1, 5) for c, q in
            [("receive", 10 * k), ("reserve", 7), ("issue", 30), ("release", 2), ("adjust_by", -2), ("adjust", 3)]]
    a = L.replay_closing(cmds(spark, rows)).orderBy("inventory_id").collect()
    b = L.closing(L.replay(cmds(spark, rows))).orderBy("inventory_id").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]


# -- change sets -----------------------------------------------------------------------------------

def test_upsert_last_change_wins_and_removes(spark):
    from stockflow.operators import changes as CH
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    ch = spark.createDataFrame([(1, "x", 1, "update"), (1, "y", 2, "update"), (2, None, 1, "remove"),
                                (4, "d", 1, "add"), (3, None, 5, "update")], "k long, v string, seq int, op string")
    got = {r.k: r.v for r in CH.upsert(base, ch, ["k"], ["seq"]).collect()}
    assert got == {1: "y", 3: None, 4: "d"}  # an explicit NULL update is kept
    st = {r.k: (r.created_at is not None, r.updated_at is not None)
          for r in CH.stamp(ch, "2024-01-01 00:00:00").collect() if r.seq == 1}
    assert st == {1: (False, True), 2: (False, False), 4: (True, False)}


def test_admit_new_only(spark):
    base = spark.createDataFrame([(1, "Main")], "part_id long, warehouse string")
    cand = spark.createDataFrame([(1, "Main", 1), (1, "East", 3), (1, "East", 2), (2, "Main", 9)],
                                 "part_id long, warehouse string, seq int")
    got = {(r.part_id, r.warehouse): r.seq for r in Q.admit_new(cand, base, ["part_id", "warehouse"], ["seq"]).collect()}
    assert got == {(1, "East"): 2, (2, "Main"): 9}


def test_duplicate_keys_report(spark):
    df = spark.createDataFrame([("WO-1",), ("WO-1",), ("WO-2",)], "n string")
    r = Q.duplicate_keys(df, ["n"], "orders.number").collect()
    assert [(x.key_value, x.row_count) for x in r] == [("WO-1", 2)]


def test_price_changes_across_chunks(spark):
    c = spark.createDataFrame(
        [(1, s, T0 + dt.timedelta(minutes=s), "price", float(10 + s), float(20 + s), None, None, None)
         for s in range(1, 12)] + [(2, 5, T0, "price", 7.0, 9.0, None, None, None)],
        "part_id long, seq long, ts timestamp_ntz, command string, new_cost double, new_price double, "
        "new_min int, new_max int, new_lead_time int")
    c = c.withColumn("new_cost", F.col("new_cost").cast("decimal(18,2)")).withColumn(
        "new_price", F.col("new_price").cast("decimal(18,2)"))
    whole = {r.seq: r for r in C.price_changes(c, parts(spark)).where("part_id = 1").collect()}
    split = {r.seq: r for r in C.price_changes(c, parts(spark), seq_chunk=3).where("part_id = 1").collect()}
    assert whole == split
    assert float(whole[1].old_cost) == 1200 and float(whole[5].old_cost) == 14


def test_status_as_of_chunks_agree(spark):
    from stockflow.sources.domain import domain
    d = domain(spark, "/root/testdata/sf0.001")
    tr = C.apply_transitions(d.status_requests, d.work_orders)
    cm = d.raw("events").select(F.col("user_id").alias("work_order_id"), F.col("event_id").alias("seq"), "ts")
    key = ["work_order_id", "seq"]
    a = C.status_as_of(cm, tr, d.work_orders, chunk="day").select(*key, "status_at").orderBy(key).collect()
    b = C.status_as_of(cm, tr, d.work_orders, chunk="year").select(*key, "status_at").orderBy(key).collect()
    assert a == b and len(a) > 0


def test_create_locations_reorder_is_max_minus_min(spark):
    inv = inv_rows(spark, [(10, 1, "Main", "A", 5, 0, 1, 10, 9, True)])
    req = spark.createDataFrame(
        [(10, 1, "Main", "X", 2, 20, 1, 1), (21, 2, "East", "B-1", 3, 30, 2, 1), (21, 2, "East", "B-9", 5, 50, 1, 1)],
        "inventory_id long, part_id long, warehouse string, bin_location string, minimum_stock_level int, "
        "maximum_stock_level int, work_order_id long, line_no int")
    new = L.create_locations(req, inv).collect()
    assert len(new) == 1  # (1, Main) exists; (2, East) is requested twice, the first request wins
    r = new[0]
    assert (r.bin_location, r.reorder_quantity, r.quantity_on_hand, r.is_active) == ("B-9", 45, 0, True)


def test_reorder_suggestions_top_k_per_warehouse(spark):
    ev = spark.createDataFrame(
        [(f"e{i}", T0 + dt.timedelta(hours=i), i, i, "Main" if i % 2 else "East", 0 if i in (5, 6) else 2, 40)
         for i in range(1, 9)],
        "event_id string, occurred_on timestamp_ntz, inventory_id long, part_id long, warehouse string, "
        "available int, reorder_qty int")
    top = L.reorder_suggestions(ev, top_k=2).collect()
    got = sorted((r.warehouse, r.urgency_rank, r.source_event_id) for r in top)
    assert got == [("East", 1, "e6"), ("East", 2, "e2"), ("Main", 1, "e5"), ("Main", 2, "e1")]
    assert L.reorder_suggestions(ev).count() == 8


def test_unknown_location_is_unavailable_and_empty_totals_are_zero(spark):
    inv = inv_rows(spark, [(1, 1, "Main", "A", 30, 10, 10, 50, 40, True)])
    req = spark.createDataFrame([(1, "Main", 5), (1, "East", 1), (1, " ", 1), (2, "Main", 1)],
                                "part_id long, warehouse string, quantity int")
    got = {(r.part_id, r.warehouse): r.is_available for r in I.check_availability(req, inv).collect()}
    assert got == {(1, "Main"): True, (1, "East"): False, (1, " "): False, (2, "Main"): False}
    t = {r.part_id: r for r in I.part_totals(parts(spark), inv).collect()}
    assert (t[3].total_on_hand, t[3].total_available, t[3].location_count) == (0, 0, 0)
