"""Registered stock-location queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.operators import inventory as inv_ops
from stockflow.plans.registry import register
from stockflow.sources.domain import Domain, domain

# Shared oracle fragments ------------------------------------------------------

AVAIL = "(quantity_on_hand - quantity_reserved)"

LOCATION_REQUESTS_SQL = """
, location_requests AS (
  SELECT r.work_order_id, r.line_no, r.part_id,
         CASE WHEN r.line_no = 7 THEN '' ELSE g.r_name END AS warehouse, r.quantity
  FROM reservation_requests r JOIN region g ON g.r_regionkey = r.work_order_id % 5)
"""


def location_requests(d: Domain) -> DataFrame:
    """(part, warehouse, quantity) requests derived from the open order lines.

    Each line asks at the warehouse of region ``work_order_id % 5``; line 7
    asks with a blank warehouse (which by rule finds nothing).
    """
    region = F.broadcast(d.raw("region"))
    r = d.reservation_requests
    return (r.join(region, region.r_regionkey == r.work_order_id % 5)
             .select("work_order_id", "line_no", "part_id",
                     F.when(F.col("line_no") == 7, F.lit("")).otherwise(F.col("r_name")).alias("warehouse"),
                     "quantity"))


# A2 / A3 -------------------------------------------------------------------------

_SUMMARY_SQL = f"""
SELECT warehouse,
       count(*) AS total_parts,
       cast(sum(quantity_on_hand) AS bigint) AS total_quantity_on_hand,
       cast(sum(quantity_reserved) AS bigint) AS total_quantity_reserved,
       cast(sum({AVAIL}) AS bigint) AS total_available,
       count(*) FILTER (WHERE {AVAIL} <= minimum_stock_level) AS low_stock_count,
       count(*) FILTER (WHERE {AVAIL} <= 0) AS out_of_stock_count,
       cast(sum(coalesce(quantity_on_hand * p.unit_cost, 0)) AS decimal(28,2)) AS total_inventory_value
FROM inventory i LEFT JOIN parts p ON p.part_id = i.part_id
{{where}}
GROUP BY warehouse
"""


@register("warehouse_summaries", _SUMMARY_SQL.format(where=""))
def q_warehouse_summaries(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.warehouse_summary(d.inventory, d.parts, active_only=False)


@register("warehouse_summary_active", _SUMMARY_SQL.format(where="WHERE i.is_active"))
def q_warehouse_summary_active(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.warehouse_summary(d.inventory, d.parts, active_only=True)


# F13-F18 --------------------------------------------------------------------------

@register("inventory_by_part", """
SELECT * FROM inventory i
WHERE i.is_active AND i.part_id IN (
  SELECT p.part_id FROM work_order_parts p JOIN work_orders w ON w.work_order_id = p.work_order_id
  WHERE w.status NOT IN (4, 5))
""")
def q_inventory_by_part(spark, sf_dir):
    d = domain(spark, sf_dir)
    open_wo = d.work_orders.where(~F.col("status").isin(4, 5)).select("work_order_id")
    wanted = d.work_order_parts.join(open_wo, "work_order_id", "left_semi").select("part_id")
    return inv_ops.inventory_by_part(d.inventory, wanted)


@register("inventory_at_location", LOCATION_REQUESTS_SQL + """
SELECT q.work_order_id, q.line_no, q.part_id, q.warehouse, q.quantity,
       i.inventory_id, i.bin_location, i.quantity_on_hand, i.quantity_reserved, i.minimum_stock_level,
       (i.inventory_id IS NOT NULL) AS found
FROM location_requests q
LEFT JOIN inventory i ON i.is_active AND i.part_id = q.part_id AND i.warehouse = q.warehouse
                      AND trim(q.warehouse) <> ''
""")
def q_inventory_at_location(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.inventory_at(d.inventory, location_requests(d))


@register("inventory_by_warehouse", "SELECT * FROM inventory WHERE warehouse = 'EUROPE' AND is_active")
def q_inventory_by_warehouse(spark, sf_dir):
    return inv_ops.inventory_by_warehouse(domain(spark, sf_dir).inventory, "EUROPE")


@register("inventory_low_stock", f"SELECT * FROM inventory WHERE is_active AND {AVAIL} <= minimum_stock_level")
def q_inventory_low_stock(spark, sf_dir):
    return inv_ops.low_stock(domain(spark, sf_dir).inventory)


@register("inventory_out_of_stock", f"SELECT * FROM inventory WHERE is_active AND {AVAIL} <= 0")
def q_inventory_out_of_stock(spark, sf_dir):
    return inv_ops.out_of_stock(domain(spark, sf_dir).inventory)


@register("inventory_view", f"""
SELECT *, {AVAIL} AS available_quantity,
       {AVAIL} <= minimum_stock_level AS is_low_stock,
       {AVAIL} <= 0 AS is_out_of_stock,
       CASE WHEN {AVAIL} <= minimum_stock_level THEN maximum_stock_level - {AVAIL} ELSE 0 END AS reorder_suggestion
FROM inventory
""")
def q_inventory_view(spark, sf_dir):
    return inv_ops.inventory_view(domain(spark, sf_dir).inventory)


# Joins -------------------------------------------------------------------------------

ALERTS_SQL = f"""
SELECT i.inventory_id, i.part_id, p.part_number, p.part_name, i.warehouse,
       {AVAIL} AS current_quantity, i.minimum_stock_level,
       CASE WHEN {AVAIL} <= minimum_stock_level THEN maximum_stock_level - {AVAIL} ELSE 0 END AS reorder_quantity,
       p.unit_cost, p.lead_time_days
FROM inventory i JOIN parts p ON p.part_id = i.part_id
WHERE i.is_active AND {AVAIL} <= i.minimum_stock_level
"""


@register("low_stock_alerts", ALERTS_SQL)
def q_low_stock_alerts(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.low_stock_alerts(d.inventory, d.parts)


@register("availability_check", LOCATION_REQUESTS_SQL + """
SELECT q.work_order_id, q.line_no, q.part_id, q.warehouse, q.quantity,
       i.inventory_id, i.bin_location, i.quantity_on_hand, i.quantity_reserved, i.minimum_stock_level,
       (i.inventory_id IS NOT NULL) AS found,
       coalesce(i.quantity_on_hand - i.quantity_reserved >= q.quantity, false) AS is_available
FROM location_requests q
LEFT JOIN inventory i ON i.is_active AND i.part_id = q.part_id AND i.warehouse = q.warehouse
                      AND trim(q.warehouse) <> ''
""")
def q_availability_check(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.check_availability(location_requests(d), d.inventory)


@register("discontinued_stock", f"""
SELECT i.inventory_id, i.part_id, p.part_number, p.part_name, i.warehouse,
       i.quantity_on_hand, i.quantity_reserved, {AVAIL} AS available_quantity
FROM inventory i JOIN parts p ON p.part_id = i.part_id
WHERE p.is_discontinued AND i.quantity_on_hand > 0
""")
def q_discontinued_stock(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.discontinued_stock(d.parts, d.inventory)


@register("part_stock_totals", f"""
SELECT p.part_id, p.part_number, p.part_name,
       cast(coalesce(sum(i.quantity_on_hand), 0) AS bigint) AS total_on_hand,
       cast(coalesce(sum(i.quantity_reserved), 0) AS bigint) AS total_reserved,
       cast(coalesce(sum(i.quantity_on_hand - i.quantity_reserved), 0) AS bigint) AS total_available,
       count(i.inventory_id) AS location_count
FROM parts p LEFT JOIN inventory i ON i.part_id = p.part_id AND i.is_active
GROUP BY p.part_id, p.part_number, p.part_name
""")
def q_part_stock_totals(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.part_totals(d.parts, d.inventory)


@register("part_with_inventory", """
, loc AS (
  SELECT part_id, warehouse, bin_location, quantity_on_hand, quantity_reserved, quantity_on_hand - quantity_reserved AS available_quantity,
         quantity_on_hand - quantity_reserved <= minimum_stock_level AS is_low_stock
  FROM inventory WHERE is_active),
agg AS (
  SELECT part_id,
         cast(sum(quantity_on_hand) AS bigint) AS total_on_hand,
         cast(sum(quantity_reserved) AS bigint) AS total_reserved,
         cast(sum(quantity_on_hand - quantity_reserved) AS bigint) AS total_available,
         count(*) AS location_count,
         string_agg(concat_ws(':', warehouse, bin_location, cast(quantity_on_hand AS varchar),
                              cast(quantity_reserved AS varchar)), '|'
                    ORDER BY warehouse, bin_location, quantity_on_hand, quantity_reserved) AS locations_text,
         to_json(list({'warehouse': warehouse, 'bin_location': bin_location, 'quantity_on_hand': quantity_on_hand, 'quantity_reserved': quantity_reserved,
                       'available_quantity': available_quantity, 'is_low_stock': is_low_stock}
                      ORDER BY warehouse, bin_location, quantity_on_hand, quantity_reserved)) AS locations
  FROM loc GROUP BY part_id)
SELECT p.part_id, p.part_number, p.part_name, p.unit_cost, p.unit_price,
       coalesce(a.total_on_hand, 0) AS total_on_hand, coalesce(a.total_reserved, 0) AS total_reserved,
       coalesce(a.total_available, 0) AS total_available, cast(coalesce(a.location_count, 0) AS int) AS location_count,
       coalesce(a.locations_text, '') AS locations_text, CAST(coalesce(a.locations, '[]') AS VARCHAR) AS locations
FROM parts p LEFT JOIN agg a ON a.part_id = p.part_id
""")
def q_part_with_inventory(spark, sf_dir):
    d = domain(spark, sf_dir)
    # the nested list is compared as JSON text; the operator keeps an array of structs
    return inv_ops.part_with_inventory(d.parts, d.inventory).withColumn("locations", F.coalesce(F.to_json("locations"), F.lit("[]")))


@register("inventory_with_transactions", """
, cnt AS (SELECT inventory_id, count(*) AS transaction_count FROM inventory_transactions GROUP BY inventory_id)
SELECT i.*, coalesce(c.transaction_count, 0) AS transaction_count,
       t.transaction_id, t.transaction_type, t.quantity AS transaction_quantity, t.transaction_date
FROM inventory i LEFT JOIN cnt c ON c.inventory_id = i.inventory_id
LEFT JOIN inventory_transactions t ON t.inventory_id = i.inventory_id
""")
def q_inventory_with_transactions(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.inventory_with_tx(d.inventory, d.inventory_transactions)


# Ledger aggregates -------------------------------------------------------------------

@register("stock_reconciliation", """
, led AS (
  SELECT inventory_id,
         sum(CASE WHEN transaction_type IN ('Receipt', 'Issue', 'Adjustment') THEN quantity ELSE 0 END) AS ledger_on_hand,
         sum(CASE WHEN transaction_type IN ('Reservation', 'Release', 'Issue') THEN quantity ELSE 0 END) AS ledger_reserved,
         count(*) AS ledger_rows
  FROM inventory_transactions GROUP BY inventory_id)
SELECT coalesce(i.inventory_id, l.inventory_id) AS inventory_id,
       coalesce(i.quantity_on_hand, 0) AS snapshot_on_hand,
       coalesce(i.quantity_reserved, 0) AS snapshot_reserved,
       cast(coalesce(l.ledger_on_hand, 0) AS bigint) AS ledger_on_hand,
       cast(coalesce(l.ledger_reserved, 0) AS bigint) AS ledger_reserved,
       cast(coalesce(i.quantity_on_hand, 0) - coalesce(l.ledger_on_hand, 0) AS bigint) AS on_hand_difference,
       cast(coalesce(i.quantity_reserved, 0) - coalesce(l.ledger_reserved, 0) AS bigint) AS reserved_difference,
       i.inventory_id IS NULL AS missing_snapshot,
       l.ledger_rows IS NULL AS missing_ledger
FROM inventory i FULL OUTER JOIN led l ON l.inventory_id = i.inventory_id
""")
def q_stock_reconciliation(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.reconcile(d.inventory, d.inventory_transactions)


USAGE_SQL = """
, usage AS (
  SELECT t.work_order_id, i.part_id,
         cast(sum(CASE WHEN t.transaction_type = 'Reservation' THEN t.quantity ELSE 0 END) AS bigint) AS reserved_units,
         cast(sum(CASE WHEN t.transaction_type = 'Issue' THEN -t.quantity ELSE 0 END) AS bigint) AS issued_units,
         cast(sum(CASE WHEN t.transaction_type = 'Release' THEN -t.quantity ELSE 0 END) AS bigint) AS released_units
  FROM inventory_transactions t JOIN inventory i ON i.inventory_id = t.inventory_id
  WHERE t.work_order_id IS NOT NULL
  GROUP BY t.work_order_id, i.part_id)
"""


@register("work_order_part_usage", USAGE_SQL + "SELECT * FROM usage")
def q_work_order_part_usage(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.wo_usage(d.inventory_transactions, d.inventory)


@register("work_order_parts_cost", USAGE_SQL + """
SELECT u.work_order_id, cast(sum(u.issued_units) AS bigint) AS issued_units,
       cast(sum(u.issued_units * p.unit_cost) AS decimal(28,2)) AS parts_cost
FROM usage u JOIN parts p ON p.part_id = u.part_id
WHERE u.issued_units <> 0
GROUP BY u.work_order_id
""")
def q_work_order_parts_cost(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.wo_parts_cost(d.inventory_transactions, d.inventory, d.parts)


@register("reorder_spend", f"""
, alerts AS ({ALERTS_SQL})
SELECT warehouse, count(*) AS alert_count, cast(sum(reorder_quantity) AS bigint) AS total_reorder_quantity,
       cast(sum(reorder_quantity * unit_cost) AS decimal(28,2)) AS reorder_cost
FROM alerts GROUP BY warehouse
""")
def q_reorder_spend(spark, sf_dir):
    d = domain(spark, sf_dir)
    return inv_ops.reorder_spend(inv_ops.low_stock_alerts(d.inventory, d.parts))
