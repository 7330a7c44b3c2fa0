"""Registered scans, sinks and change-set jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.functions.enums import enum_case_sql
from stockflow.operators import changes as CH
from stockflow.operators import commands as C
from stockflow.operators import ledger as L
from stockflow.plans.fixture_sql import AS_OF
from stockflow.plans.q_commands import TRANSITIONS_SQL
from stockflow.plans.q_ledger import ACC_CTE, ACC_SELECT, LOW_CTE, LOW_STOCK_EVENTS_SELECT, REPLAY_SQL, _replayed
from stockflow.plans.registry import register
from stockflow.sources import sinks
from stockflow.sources.domain import domain
from stockflow.sources.tables import scan
from stockflow.streaming.runner import drain_to_parquet


@register("scan_table", "SELECT * FROM orders")
def q_scan_table(spark, sf_dir):
    return scan(spark, sf_dir, "orders")


@register("ledger_append", """
SELECT *, strftime(transaction_date, '%Y-%m') AS transaction_month FROM inventory_transactions
""")
def q_ledger_append(spark, sf_dir):
    tx = domain(spark, sf_dir).inventory_transactions
    path = sinks.fresh_dir(spark, "ledger")
    sinks.append_ledger(tx, path)
    return (spark.read.option("basePath", path).parquet(path)
                 .withColumn("transaction_month", F.col("transaction_month").cast("string")))


PART_COLS = ["part_id", "part_number", "part_name", "description", "category", "unit_cost", "unit_cost_currency",
             "unit_price", "unit_price_currency", "supplier_id", "lead_time_days", "default_minimum_stock_level",
             "default_maximum_stock_level", "is_discontinued", "is_active"]

CHANGES_SQL = """
, ch AS (
  SELECT CASE WHEN c.command = 'reactivate' THEN p.part_id + 1000000 ELSE p.part_id END AS part_id,
         CASE WHEN c.command = 'reactivate' THEN concat('P-', lpad(cast(p.part_id + 1000000 AS varchar), 8, '0'))
              ELSE p.part_number END AS part_number,
         p.part_name, p.description, p.category,
         CASE WHEN c.command = 'price' THEN c.new_cost ELSE p.unit_cost END AS unit_cost, p.unit_cost_currency,
         CASE WHEN c.command = 'price' THEN c.new_price ELSE p.unit_price END AS unit_price, p.unit_price_currency,
         p.supplier_id, p.lead_time_days, p.default_minimum_stock_level, p.default_maximum_stock_level,
         p.is_discontinued, p.is_active, c.seq,
         CASE c.command WHEN 'price' THEN 'update' WHEN 'discontinue' THEN 'remove' ELSE 'add' END AS op
  FROM part_commands c JOIN parts p ON p.part_id = c.part_id
  WHERE c.command IN ('price', 'discontinue', 'reactivate'))
"""


def part_changes(d):
    """A change set from the part commands: price -> update, discontinue -> remove,
    reactivate -> add of a copy under a new key (id + 1,000,000)."""
    c = d.part_commands.where(F.col("command").isin("price", "discontinue", "reactivate"))
    p = d.parts
    j = c.select("part_id", "seq", "command", "new_cost", "new_price").join(p, "part_id")
    add = F.col("command") == "reactivate"
    new_id = F.col("part_id") + 1000000
    return j.select(
        F.when(add, new_id).otherwise(F.col("part_id")).alias("part_id"),
        F.when(add, F.concat(F.lit("P-"), F.lpad(new_id.cast("string"), 8, "0"))).otherwise(F.col("part_number"))
         .alias("part_number"),
        "part_name", "description", "category",
        F.when(F.col("command") == "price", F.col("new_cost")).otherwise(F.col("unit_cost")).alias("unit_cost"),
        "unit_cost_currency",
        F.when(F.col("command") == "price", F.col("new_price")).otherwise(F.col("unit_price")).alias("unit_price"),
        "unit_price_currency", "supplier_id", "lead_time_days", "default_minimum_stock_level",
        "default_maximum_stock_level", "is_discontinued", "is_active", "seq",
        F.when(F.col("command") == "price", F.lit(CH.UPDATE)).when(F.col("command") == "discontinue", F.lit(CH.REMOVE))
         .otherwise(F.lit(CH.ADD)).alias("op"))


@register("snapshot_upsert", CHANGES_SQL + f"""
, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY seq DESC) AS rn FROM ch) x
           WHERE rn = 1)
SELECT {', '.join(PART_COLS)} FROM parts WHERE part_id NOT IN (SELECT part_id FROM last)
UNION ALL
SELECT {', '.join(PART_COLS)} FROM last WHERE op <> 'remove'
""")
def q_snapshot_upsert(spark, sf_dir):
    d = domain(spark, sf_dir)
    return CH.upsert(d.parts, part_changes(d), ["part_id"], ["seq"])


@register("audit_stamp", CHANGES_SQL + f"""
SELECT *, CASE WHEN op = 'add' THEN TIMESTAMP '{AS_OF}' END AS created_at,
          CASE WHEN op = 'update' THEN TIMESTAMP '{AS_OF}' END AS updated_at
FROM ch
""")
def q_audit_stamp(spark, sf_dir):
    return CH.stamp(part_changes(domain(spark, sf_dir)), AS_OF)


@register("bulk_status_update", f"""
SELECT work_order_id, work_order_number, customer_id, vin, equipment_type, priority,
       CASE WHEN hit THEN 5 ELSE status END AS status, technician_id, created_at, scheduled_start, scheduled_end,
       estimated_labor_hours, estimated_cost, actual_cost,
       CASE WHEN hit THEN TIMESTAMP '{AS_OF}' END AS updated_at, hit AS changed
FROM (SELECT *, coalesce(status = 0 AND scheduled_end < TIMESTAMP '{AS_OF}', false) AS hit FROM work_orders) w
""")
def q_bulk_status_update(spark, sf_dir):
    w = domain(spark, sf_dir).work_orders
    pred = (F.col("status") == 0) & (F.col("scheduled_end") < F.lit(AS_OF).cast("timestamp_ntz"))
    return CH.bulk_update(w, pred, {"status": F.lit(5), "updated_at": F.lit(AS_OF).cast("timestamp_ntz")})


@register("notification_log_append", TRANSITIONS_SQL + f"""
, j AS (SELECT t.event_id, t.work_order_id, w.customer_id, t.ts, t.new_status, c.prefer_email, c.prefer_sms
        FROM transitions t JOIN work_orders w ON w.work_order_id = t.work_order_id
        JOIN customers c ON c.customer_id = w.customer_id WHERE t.accepted),
r AS (SELECT event_id, work_order_id, customer_id, ts, 'email' AS channel,
             concat('Work Order ', cast(work_order_id AS varchar), ' Status Update') AS subject,
             concat('Your work order status changed to ', {enum_case_sql('new_status', 'status')}) AS message
      FROM j WHERE prefer_email
      UNION ALL
      SELECT event_id, work_order_id, customer_id, ts, 'sms', CAST(NULL AS varchar),
             concat('Your equipment is ready! Work order #', cast(work_order_id AS varchar), ' completed.') FROM j
      WHERE prefer_sms AND new_status = 4)
SELECT concat_ws('/', cast(event_id AS varchar), channel) AS notification_id, work_order_id,
       'StatusChanged' AS notification_type, channel, customer_id AS recipient_customer_id, subject, message,
       ts AS sent_at, true AS success, CAST(NULL AS varchar) AS error_message
FROM r
""", recursive=True)
def q_notification_log_append(spark, sf_dir):
    d = domain(spark, sf_dir)
    rec = C.recipients(C.apply_transitions(d.status_requests, d.work_orders), d.work_orders, d.customers)
    path = sinks.fresh_dir(spark, "notifications")
    sinks.append_notifications(sinks.notification_rows(rec), path)
    return sinks.read_notifications(spark, path)


def _event_files(spark, sf_dir) -> str:
    """W4 + W5 events written as Parquet files for the stream jobs to read."""
    d = domain(spark, sf_dir)
    ev = L.all_events(_replayed(spark, sf_dir), d.inventory)
    path = sinks.fresh_dir(spark, "events")
    ev.write.parquet(path)
    return path


ALL_EVENTS_SQL = REPLAY_SQL + ACC_CTE + LOW_CTE + ACC_SELECT + " UNION ALL " + LOW_STOCK_EVENTS_SELECT


@register("event_stream_source", ALL_EVENTS_SQL, recursive=True)
def q_event_stream_source(spark, sf_dir):
    path = _event_files(spark, sf_dir)
    schema = spark.read.parquet(path).schema
    stream = sinks.read_events(spark, path, schema)
    return drain_to_parquet(spark, stream, "event-source")
