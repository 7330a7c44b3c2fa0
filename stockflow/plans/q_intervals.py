"""Registered interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.operators import intervals as I
from stockflow.plans.registry import register
from stockflow.sources.domain import domain


# one order in 40 never ends (NULL), one in 40 carries the sentinel, one in 40 runs for two years
ORDERS_CTE = """
, orders_x AS (
  SELECT work_order_id, technician_id, status, scheduled_start,
         CASE work_order_id % 40 WHEN 7 THEN NULL WHEN 11 THEN TIMESTAMP '9999-12-31'
              WHEN 13 THEN scheduled_start + INTERVAL 730 DAY ELSE scheduled_end END AS scheduled_end
  FROM work_orders WHERE scheduled_start IS NOT NULL),
sched AS (SELECT work_order_id, technician_id, status, scheduled_start,
                 CASE WHEN scheduled_end < TIMESTAMP '9999-12-31' THEN scheduled_end END AS scheduled_end FROM orders_x)
"""


def _orders(d):
    k = F.col("work_order_id") % 40
    end = (F.when(k == 7, F.lit(None).cast("timestamp_ntz")).when(k == 11, F.lit("9999-12-31").cast("timestamp_ntz"))
           .when(k == 13, F.col("scheduled_start") + F.expr("INTERVAL 730 DAYS")).otherwise(F.col("scheduled_end")))
    return d.work_orders.withColumn("scheduled_end", end)


@register("schedule_conflicts", ORDERS_CTE + """
SELECT a.technician_id, a.work_order_id AS work_order_id_a, b.work_order_id AS work_order_id_b,
       greatest(a.scheduled_start, b.scheduled_start) AS overlap_start,
       least(a.scheduled_end, b.scheduled_end) AS overlap_end
FROM sched a JOIN sched b
  ON a.technician_id = b.technician_id AND a.work_order_id < b.work_order_id
 AND (b.scheduled_end IS NULL OR a.scheduled_start <= b.scheduled_end)
 AND (a.scheduled_end IS NULL OR a.scheduled_end >= b.scheduled_start)
WHERE a.status NOT IN (4, 5) AND b.status NOT IN (4, 5)
""")
def q_schedule_conflicts(spark, sf_dir):
    return I.schedule_conflicts(_orders(domain(spark, sf_dir)))


def _probes(d):
    """One probe per distinct ship day (midnight) of the order lines."""
    return (d.raw("lineitem").select(F.col("l_shipdate").alias("probe_ts")).distinct()
             .select(F.date_format("probe_ts", "yyyy-MM-dd HH:mm:ss").alias("probe_id"), "probe_ts"))


@register("periods_containing", ORDERS_CTE + """
, probes AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS probe_id, l_shipdate AS probe_ts FROM lineitem)
SELECT p.probe_id, p.probe_ts, w.work_order_id
FROM probes p JOIN sched w ON w.scheduled_start <= p.probe_ts AND (w.scheduled_end IS NULL OR p.probe_ts <= w.scheduled_end)
""")
def q_periods_containing(spark, sf_dir):
    d = domain(spark, sf_dir)
    return I.periods_containing(_orders(d), _probes(d))


def _windows(d):
    """A maintenance window per month of order creation: days 3 to 12 of the month."""
    m = d.work_orders.select(F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("m")).distinct()
    return m.select(F.date_format("m", "yyyy-MM").alias("window_id"),
                    (F.col("m") + F.expr("INTERVAL 2 DAYS")).alias("window_start"),
                    (F.col("m") + F.expr("INTERVAL 12 DAYS")).alias("window_end"))


@register("periods_within", ORDERS_CTE + """
, months AS (SELECT DISTINCT date_trunc('month', created_at) AS m FROM work_orders),
windows AS (SELECT strftime(m, '%Y-%m') AS window_id, m + INTERVAL 2 DAY AS window_start,
                   m + INTERVAL 12 DAY AS window_end FROM months)
SELECT x.window_id, x.window_start, x.window_end, w.work_order_id
FROM windows x JOIN sched w ON w.scheduled_start >= x.window_start AND w.scheduled_end <= x.window_end
""")
def q_periods_within(spark, sf_dir):
    d = domain(spark, sf_dir)
    return I.periods_within(_orders(d), _windows(d))
