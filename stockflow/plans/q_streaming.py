"""Registered streaming jobs.

Each job stores its input as Parquet files in a fresh folder under the
shared checkpoint dir, reads them as a stream, drains it with ``availableNow``
and returns what the sink holds. Inputs that must arrive in time order are
delivered as consecutive time slices; the stream restarts from its checkpoint
after each, so state really carries across batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions.enums import enum_case_sql
from stockflow.operators import commands as C
from stockflow.operators import ledger as L
from stockflow.plans.q_changes import _event_files
from stockflow.plans.q_commands import PRICE_CHANGES_SQL, TRANSITIONS_SQL
from stockflow.plans.q_ledger import ACC_CTE, ACC_SELECT, LOW_CTE, LOW_STOCK_EVENTS_SELECT, REPLAY_SQL
from stockflow.plans.registry import register
from stockflow.sources import sinks
from stockflow.sources.domain import domain
from stockflow.streaming import jobs as T
from stockflow.streaming.runner import drain_foreach_batch, drain_slices, drain_to_parquet

EVENTS_CTE = (REPLAY_SQL + ACC_CTE + LOW_CTE + ", ev AS (" + ACC_SELECT + " UNION ALL "
              + LOW_STOCK_EVENTS_SELECT + ")\n")


def _stream_of(spark, path):
    return sinks.read_events(spark, path, spark.read.parquet(path).schema)


# -- T1 --------------------------------------------------------------------------------------

@register("event_dispatch", EVENTS_CTE + """
, h AS (SELECT * FROM (VALUES ('InventoryLowStockDetected', 'reorder_suggestion'),
                              ('InventoryLowStockDetected', 'purchasing_alert')) v(t, handler))
SELECT ev.event_type, h.handler, count(*) AS events, CAST(0 AS BIGINT) AS failed_batches
FROM ev LEFT JOIN h ON h.t = ev.event_type
GROUP BY ev.event_type, h.handler
""", recursive=True)
def q_event_dispatch(spark, sf_dir):
    d = domain(spark, sf_dir)
    events = _stream_of(spark, _event_files(spark, sf_dir))
    reorder_path, alert_path = sinks.fresh_dir(spark, "reorders"), sinks.fresh_dir(spark, "alerts")
    log_path = sinks.fresh_dir(spark, "dispatch-log")

    # handlers replace their batch's folder: a retried batch writes once
    def reorder(batch, bid):
        L.reorder_suggestions(batch).write.mode("overwrite").parquet(f"{reorder_path}/batch_id={bid}")

    def purchasing_alert(batch, bid):
        T.low_stock_alert_stream(batch, d.parts).write.mode("overwrite").parquet(f"{alert_path}/batch_id={bid}")

    handlers = {"InventoryLowStockDetected": [("reorder_suggestion", reorder), ("purchasing_alert", purchasing_alert)]}
    drain_foreach_batch(spark, events, "dispatch",
                        lambda df, bid: T.dispatch_batch(df, bid, handlers, log_path, f"{log_path}-dead"))
    return T.dispatch_summary(spark.read.parquet(log_path))


# -- T2 / T3 -----------------------------------------------------------------------------------

@register("event_dedupe", EVENTS_CTE + "SELECT * FROM ev", recursive=True)
def q_event_dedupe(spark, sf_dir):
    events = spark.read.parquet(_event_files(spark, sf_dir))
    # every time slice is delivered twice; ids are remembered for a week of event time
    return drain_slices(spark, events, "occurred_on", "dedupe", lambda s: T.dedupe(s, "7 days"), deliveries=2, staged=True)


@register("low_stock_alert_stream", EVENTS_CTE + """
SELECT ev.event_id, ev.occurred_on, ev.inventory_id, ev.part_id, p.part_number, p.part_name, ev.warehouse,
       ev.available AS current_quantity, ev.min_level AS minimum_stock_level, ev.reorder_qty AS reorder_quantity,
       p.unit_cost, p.lead_time_days
FROM ev LEFT JOIN parts p ON p.part_id = ev.part_id
WHERE ev.event_type = 'InventoryLowStockDetected'
""", recursive=True)
def q_low_stock_alert_stream(spark, sf_dir):
    d = domain(spark, sf_dir)
    stream = _stream_of(spark, _event_files(spark, sf_dir))
    return drain_to_parquet(spark, T.low_stock_alert_stream(stream, d.parts), "low-stock-alerts")


# -- T4 / T5 (batch twins: W2 / W12) ---------------------------------------------------------------

@register("ledger_stream", REPLAY_SQL + "SELECT * FROM replayed", recursive=True)
def q_ledger_stream(spark, sf_dir):
    d = domain(spark, sf_dir)
    out, state = sinks.fresh_dir(spark, "ledger-results"), T.ledger_state(spark, sinks.fresh_dir(spark, "ledger-state"))
    drain_slices(spark, L.ledger_commands(d.inventory_transactions), "ts", "ledger-stream",
                 handler=lambda df, bid: T.ledger_batch(df, bid, state, out))
    return spark.read.schema(L.REPLAY_SCHEMA).parquet(out).select(*L.REPLAY_SCHEMA.names)


@register("status_stream", TRANSITIONS_SQL + "SELECT * FROM transitions", recursive=True)
def q_status_stream(spark, sf_dir):
    d = domain(spark, sf_dir)
    out, state = sinks.fresh_dir(spark, "status-results"), T.status_state(spark, sinks.fresh_dir(spark, "status-state"))
    drain_slices(spark, d.status_requests, "ts", "status-stream", handler=lambda df, bid: T.status_batch(df, bid, state, out, d.work_orders))
    return spark.read.parquet(out).drop("batch_id")


# -- T6 ------------------------------------------------------------------------------------------

@register("notification_stream", TRANSITIONS_SQL + f"""
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
def q_notification_stream(spark, sf_dir):
    d = domain(spark, sf_dir)
    changes = C.apply_transitions(d.status_requests, d.work_orders).where("accepted")
    log_path = sinks.fresh_dir(spark, "notification-log")

    def handle(batch, bid):
        # dimensions are re-read for every micro-batch
        fresh = domain(spark, sf_dir)
        T.notification_batch(batch, lambda: fresh.work_orders, lambda: fresh.customers, log_path, bid)

    drain_slices(spark, changes, "ts", "status-changes", handler=handle)
    return sinks.read_notifications(spark, log_path)


# -- T7 ------------------------------------------------------------------------------------------

PART_EVENTS_SQL = PRICE_CHANGES_SQL + """
, pev AS (
  SELECT concat('price/', cast(seq AS varchar)) AS event_id, 'PartPriceUpdated' AS event_type, part_id,
         old_cost, new_cost FROM changes
  UNION ALL
  SELECT concat('discontinued/', cast(seq AS varchar)), 'PartDiscontinued', part_id, NULL, NULL
  FROM judged WHERE reason IS NULL AND command = 'discontinue')
"""


def part_events(d) -> DataFrame:
    ch = C.price_changes(d.part_commands, d.parts)
    price = ch.select(F.concat(F.lit("price/"), F.col("seq").cast("string")).alias("event_id"),
                      F.lit("PartPriceUpdated").alias("event_type"), "part_id", "old_cost", "new_cost")
    disc = (C.part_command_reasons(d.part_commands, d.parts)
            .where(F.col("accepted") & (F.col("command") == "discontinue"))
            .select(F.concat(F.lit("discontinued/"), F.col("seq").cast("string")).alias("event_id"),
                    F.lit("PartDiscontinued").alias("event_type"), "part_id",
                    F.lit(None).cast("decimal(18,2)").alias("old_cost"),
                    F.lit(None).cast("decimal(18,2)").alias("new_cost")))
    return price.unionByName(disc)


@register("price_event_stream", PART_EVENTS_SQL + """
SELECT event_id, 'price_change' AS alert_type, part_id, old_cost, new_cost,
       CASE WHEN old_cost <> 0 THEN cast(abs(new_cost - old_cost) AS double) / cast(old_cost AS double) END
         AS cost_change_ratio,
       CAST(NULL AS BIGINT) AS inventory_id, CAST(NULL AS VARCHAR) AS warehouse, CAST(NULL AS INT) AS quantity_on_hand
FROM pev WHERE event_type = 'PartPriceUpdated'
  AND CASE WHEN old_cost = 0 THEN new_cost <> 0
           ELSE abs(new_cost - old_cost) > abs(old_cost) * CAST(0.10 AS DECIMAL(9,6)) END
UNION ALL
SELECT e.event_id, 'discontinued_stock', e.part_id, NULL, NULL, NULL, i.inventory_id, i.warehouse, i.quantity_on_hand
FROM pev e JOIN inventory i ON i.part_id = e.part_id
WHERE e.event_type = 'PartDiscontinued' AND i.quantity_on_hand > 0
""")
def q_price_event_stream(spark, sf_dir):
    d = domain(spark, sf_dir)
    path = sinks.fresh_dir(spark, "part-events")
    part_events(d).write.parquet(path)
    return drain_to_parquet(spark, T.price_event_stream(_stream_of(spark, path), d.inventory), "price-events")
