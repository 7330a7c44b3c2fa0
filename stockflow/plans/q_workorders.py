"""Registered work-order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.operators import workorders as wo_ops
from stockflow.plans.fixture_sql import AS_OF, NOTIFICATIONS_SQL
from stockflow.plans.registry import register
from stockflow.sources.domain import domain

OPEN = "status NOT IN (4, 5)"
DELAYED = f"(scheduled_end IS NOT NULL AND TIMESTAMP '{AS_OF}' > scheduled_end AND status <> 4)"


@register("work_orders_by_technician", f"""
SELECT w.*, p.line_no, p.part_id, p.quantity_required, p.is_available
FROM work_orders w LEFT JOIN work_order_parts p ON p.work_order_id = w.work_order_id
WHERE w.{OPEN} AND w.technician_id IN (SELECT technician_id FROM technicians WHERE skill_level = 4)
""")
def q_work_orders_by_technician(spark, sf_dir):
    d = domain(spark, sf_dir)
    experts = d.technicians.where(F.col("skill_level") == 4).select("technician_id")
    return wo_ops.wo_by_technician(d.work_orders, d.work_order_parts, experts)


@register("work_orders_delayed", f"""
SELECT * FROM work_orders
WHERE scheduled_end IS NOT NULL AND scheduled_end < TIMESTAMP '{AS_OF}' AND {OPEN}
""")
def q_work_orders_delayed(spark, sf_dir):
    return wo_ops.wo_delayed(domain(spark, sf_dir).work_orders, AS_OF)


@register("work_orders_delay_flag", f"SELECT *, coalesce({DELAYED}, false) AS is_delayed FROM work_orders")
def q_work_orders_delay_flag(spark, sf_dir):
    return wo_ops.with_is_delayed(domain(spark, sf_dir).work_orders, AS_OF)


@register("work_orders_search", """
SELECT * FROM work_orders
WHERE coalesce(contains(work_order_number, '1999'), false) OR coalesce(contains(vin, '1999'), false)
""")
def q_work_orders_search(spark, sf_dir):
    return wo_ops.wo_search(domain(spark, sf_dir).work_orders, "1999")


@register("equipment_of_type", "SELECT * FROM work_orders WHERE lower(equipment_type) = 'crane'")
def q_equipment_of_type(spark, sf_dir):
    return wo_ops.of_type(domain(spark, sf_dir).work_orders, "CRANE")


@register("work_order_details", NOTIFICATIONS_SQL + """
, ls AS (SELECT work_order_id, count(*) AS line_count, cast(sum(quantity_required) AS bigint) AS total_quantity_required,
                count(*) FILTER (WHERE NOT is_available) AS unavailable_lines,
                to_json(list({'line_no': line_no, 'part_id': part_id, 'quantity_required': quantity_required, 'is_available': is_available}
                             ORDER BY line_no, part_id, quantity_required, is_available)) AS parts
         FROM work_order_parts GROUP BY work_order_id),
ns AS (SELECT work_order_id, count(*) AS notification_count,
              to_json(list({'notification_id': notification_id, 'notification_type': notification_type, 'subject': subject, 'success': success,
                            'error_message': coalesce(error_message, '')} ORDER BY sent_at, notification_id)) AS notifications,
              count(*) FILTER (WHERE NOT success) AS failed_notifications, max(sent_at) AS last_notification_at
       FROM work_order_notifications GROUP BY work_order_id)
SELECT w.*, coalesce(ls.line_count, 0) AS line_count,
       coalesce(ls.total_quantity_required, 0) AS total_quantity_required,
       coalesce(ls.unavailable_lines, 0) AS unavailable_lines,
       coalesce(ns.notification_count, 0) AS notification_count,
       coalesce(ns.failed_notifications, 0) AS failed_notifications, ns.last_notification_at,
       CAST(coalesce(ls.parts, '[]') AS VARCHAR) AS parts, CAST(coalesce(ns.notifications, '[]') AS VARCHAR) AS notifications
FROM work_orders w LEFT JOIN ls ON ls.work_order_id = w.work_order_id
LEFT JOIN ns ON ns.work_order_id = w.work_order_id
""")
def q_work_order_details(spark, sf_dir):
    d = domain(spark, sf_dir)
    # lists are compared as JSON text; the operator keeps arrays of structs
    notes = F.transform("notifications", lambda n: F.struct(n.notification_id, n.notification_type, n.subject, n.success,
                                                            F.coalesce(n.error_message, F.lit("")).alias("error_message")))
    return (wo_ops.wo_details(d.work_orders, d.work_order_parts, d.work_order_notifications)
            .withColumns({"parts": F.to_json("parts"), "notifications": F.to_json(notes)}))


@register("work_order_view", f"""
SELECT w.work_order_id, w.work_order_number, w.vin, w.equipment_type, w.priority, w.status,
       w.estimated_labor_hours, w.estimated_cost, w.technician_id,
       CASE WHEN t.technician_id IS NOT NULL
            THEN concat(coalesce(t.first_name, ''), ' ', coalesce(t.last_name, '')) END AS assigned_technician_name,
       c.company_name AS customer_name, w.created_at, w.scheduled_start AS scheduled_start_date,
       coalesce({DELAYED.replace('scheduled_end', 'w.scheduled_end').replace('status', 'w.status')}, false) AS is_delayed
FROM work_orders w LEFT JOIN customers c ON c.customer_id = w.customer_id
LEFT JOIN technicians t ON t.technician_id = w.technician_id
""")
def q_work_order_view(spark, sf_dir):
    d = domain(spark, sf_dir)
    return wo_ops.wo_view(d.work_orders, d.customers, d.technicians, AS_OF)


@register("work_orders_waiting_for_parts", """
SELECT * FROM work_orders w WHERE w.status = 3
  AND EXISTS (SELECT 1 FROM work_order_parts p WHERE p.work_order_id = w.work_order_id AND NOT p.is_available)
""")
def q_work_orders_waiting_for_parts(spark, sf_dir):
    d = domain(spark, sf_dir)
    return wo_ops.wo_waiting(d.work_orders, d.work_order_parts)


@register("parts_needed", """
SELECT l.work_order_id, l.line_no, l.part_id, p.part_number, p.part_name, l.quantity_required AS quantity
FROM work_order_parts l JOIN parts p ON p.part_id = l.part_id
""")
def q_parts_needed(spark, sf_dir):
    d = domain(spark, sf_dir)
    return wo_ops.parts_needed(d.work_order_parts, d.parts)


@register("work_orders_by_customer_name", """
SELECT * FROM work_orders
WHERE customer_id IN (SELECT customer_id FROM customers WHERE coalesce(contains(company_name, '#00000001'), false))
""")
def q_work_orders_by_customer_name(spark, sf_dir):
    d = domain(spark, sf_dir)
    return wo_ops.wo_by_customer_name(d.work_orders, d.customers, "#00000001")


@register("discontinued_required", f"""
SELECT l.work_order_id, w.work_order_number, w.status, w.priority, l.line_no, l.part_id,
       p.part_number, p.part_name, l.quantity_required
FROM work_order_parts l JOIN parts p ON p.part_id = l.part_id
JOIN work_orders w ON w.work_order_id = l.work_order_id
WHERE p.is_discontinued AND w.{OPEN}
""")
def q_discontinued_required(spark, sf_dir):
    d = domain(spark, sf_dir)
    return wo_ops.discontinued_required(d.work_orders, d.work_order_parts, d.parts)


@register("required_part_shortages", f"""
, av AS (SELECT part_id, sum(quantity_on_hand - quantity_reserved) AS total_available
         FROM inventory WHERE is_active GROUP BY part_id)
SELECT l.work_order_id, l.line_no, l.part_id, l.quantity_required,
       cast(coalesce(av.total_available, 0) AS bigint) AS total_available,
       coalesce(av.total_available, 0) >= l.quantity_required AS sufficient,
       cast(greatest(l.quantity_required - coalesce(av.total_available, 0), 0) AS bigint) AS shortage
FROM work_order_parts l LEFT JOIN av ON av.part_id = l.part_id
WHERE l.work_order_id IN (SELECT work_order_id FROM work_orders WHERE {OPEN})
""")
def q_required_part_shortages(spark, sf_dir):
    d = domain(spark, sf_dir)
    return wo_ops.part_shortages(d.work_orders, d.work_order_parts, d.inventory)


ACTIVE_JOBS_SQL = f"""
, jobs AS (SELECT t.technician_id, count(w.work_order_id) AS active_job_count
           FROM technicians t LEFT JOIN work_orders w ON w.technician_id = t.technician_id AND w.{OPEN}
           GROUP BY t.technician_id)
"""


@register("active_jobs_by_technician", ACTIVE_JOBS_SQL + "SELECT * FROM jobs")
def q_active_jobs_by_technician(spark, sf_dir):
    d = domain(spark, sf_dir)
    return wo_ops.active_jobs(d.work_orders, d.technicians)


CAN_ACCEPT = "(CASE WHEN NOT t.is_active OR t.status = 3 THEN false ELSE {n} < t.max_concurrent_jobs END)"


@register("technician_workload", ACTIVE_JOBS_SQL + f"""
SELECT t.technician_id, concat(coalesce(t.first_name, ''), ' ', coalesce(t.last_name, '')) AS full_name,
       t.status, t.is_active, t.max_concurrent_jobs, j.active_job_count,
       CASE WHEN NOT t.is_active THEN 0.0
            ELSE cast(j.active_job_count AS double) / cast(t.max_concurrent_jobs AS double) * 100.0 END
         AS workload_percentage,
       {CAN_ACCEPT.format(n='j.active_job_count')} AS can_accept_new_job,
       {CAN_ACCEPT.format(n='j.active_job_count')} AND t.status = 0
         AND NOT {CAN_ACCEPT.format(n='(j.active_job_count + 1)')} AS would_become_busy
FROM technicians t JOIN jobs j ON j.technician_id = t.technician_id
""")
def q_technician_workload(spark, sf_dir):
    d = domain(spark, sf_dir)
    return wo_ops.tech_workload(d.technicians, d.work_orders)


@register("status_counts", "SELECT status, count(*) AS order_count FROM work_orders GROUP BY status")
def q_status_counts(spark, sf_dir):
    return wo_ops.status_counts(domain(spark, sf_dir).work_orders)


@register("technician_in_progress_hours", """
SELECT technician_id,
       cast(sum(CASE WHEN status = 2 THEN estimated_labor_hours ELSE 0 END) AS decimal(18,2)) AS in_progress_hours
FROM work_orders WHERE technician_id IS NOT NULL GROUP BY technician_id
""")
def q_technician_in_progress_hours(spark, sf_dir):
    return wo_ops.tech_hours(domain(spark, sf_dir).work_orders)


@register("technician_has_critical", """
SELECT technician_id, bool_or(priority = 4 AND status <> 4) AS has_critical
FROM work_orders WHERE technician_id IS NOT NULL GROUP BY technician_id
""")
def q_technician_has_critical(spark, sf_dir):
    return wo_ops.tech_has_critical(domain(spark, sf_dir).work_orders)


@register("all_parts_available", """
SELECT w.work_order_id, coalesce(a.all_ok, true) AS all_parts_available
FROM work_orders w LEFT JOIN (SELECT work_order_id, bool_and(is_available) AS all_ok
                              FROM work_order_parts GROUP BY work_order_id) a
  ON a.work_order_id = w.work_order_id
""")
def q_all_parts_available(spark, sf_dir):
    d = domain(spark, sf_dir)
    return wo_ops.all_parts_available(d.work_orders, d.work_order_parts)


@register("estimate_accuracy", """
, done AS (SELECT *, CASE WHEN estimated_cost > 0
                          THEN cast(actual_cost - estimated_cost AS double) / cast(estimated_cost AS double) * 100.0
                     END AS pct,
                     cast(work_order_id % 45 AS decimal(8,2)) AS actual_labor_hours, scheduled_end AS completed_at
           FROM work_orders WHERE status = 4)
SELECT equipment_type, count(*) AS completed_orders,
       count(*) FILTER (WHERE actual_cost > estimated_cost) AS over_budget_orders,
       cast(sum(estimated_cost) AS decimal(28,2)) AS total_estimated_cost,
       cast(sum(actual_cost) AS decimal(28,2)) AS revenue,
       cast(sum(actual_cost - estimated_cost) AS decimal(28,2)) AS total_cost_variance,
       avg(pct) AS avg_cost_variance_pct,
       avg(CASE WHEN actual_cost > estimated_cost THEN pct END) AS avg_over_budget_pct,
       avg(cast(estimated_labor_hours AS double)) AS avg_estimated_hours,
       cast(sum(actual_labor_hours - estimated_labor_hours) AS decimal(20,2)) AS total_hours_variance,
       avg(CASE WHEN estimated_labor_hours > 0
                THEN cast(actual_labor_hours - estimated_labor_hours AS double) / cast(estimated_labor_hours AS double) * 100.0 END) AS avg_hours_variance_pct,
       avg((epoch_us(completed_at) - epoch_us(created_at)) / 3600000000.0) AS avg_completion_hours
FROM done GROUP BY equipment_type
""")
def q_estimate_accuracy(spark, sf_dir):
    wo = domain(spark, sf_dir).work_orders
    return wo_ops.estimate_accuracy(wo.withColumns({
        "actual_labor_hours": (F.col("work_order_id") % 45).cast("decimal(8,2)"), "completed_at": F.col("scheduled_end")}))


@register("work_orders_pending", "SELECT * FROM work_orders WHERE status = 0")
def q_work_orders_pending(spark, sf_dir):
    return wo_ops.wo_pending(domain(spark, sf_dir).work_orders)


@register("work_orders_top", """
SELECT * FROM work_orders WHERE status = 2 AND priority = 3 AND estimated_cost > 1000
ORDER BY priority DESC, scheduled_start ASC NULLS FIRST, work_order_id LIMIT 10
""")
def q_work_orders_top(spark, sf_dir):
    return wo_ops.wo_top(domain(spark, sf_dir).work_orders, 10)


@register("work_orders_page", """
SELECT * FROM work_orders ORDER BY created_at, work_order_id LIMIT 20 OFFSET 40
""")
def q_work_orders_page(spark, sf_dir):
    return wo_ops.page(domain(spark, sf_dir).work_orders, [F.col("created_at"), F.col("work_order_id")], 3, 20)


@register("equipment_master", """
SELECT upper(trim(vin)) AS vin,
       arg_max(equipment_type, (created_at, work_order_id)) AS equipment_type,
       count(*) AS order_count, count(DISTINCT equipment_type) AS type_count,
       min(created_at) AS first_seen, max(created_at) AS last_seen,
       count(DISTINCT equipment_type) > 1 AS has_conflict
FROM work_orders GROUP BY upper(trim(vin))
""")
def q_equipment_master(spark, sf_dir):
    return wo_ops.equipment_master(domain(spark, sf_dir).work_orders)
