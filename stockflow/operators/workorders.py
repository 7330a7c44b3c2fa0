"""Work-order jobs: filters (F23-F27), joins (J4-J8, J15, J17), aggregates (A4-A10),
sorted lists (L1-L3), equipment master (K3) and number assignment (X13).

Children (lines, notifications) are aggregated per order *before* joining to
the order, so two child collections never multiply rows, and no per-order
list is collected (an order with a huge number of lines stays flat).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions import scalars as X
from stockflow.functions.enums import AVAILABLE, CANCELLED, COMPLETED, CRITICAL, HIGH, IN_PROGRESS, ON_HOLD, \
    ON_LEAVE, PENDING
from stockflow.operators.automaton import CHUNK_ROWS, numbered


def is_open() -> Column:
    """Active job = not Completed and not Cancelled (a Pending order with a technician counts)."""
    return ~F.col("status").isin(COMPLETED, CANCELLED)


# -- F23-F27 ------------------------------------------------------------------------

def wo_by_technician(wo: DataFrame, wop: DataFrame, tech_ids: DataFrame) -> DataFrame:
    """open orders of the given technicians with their part lines (flat; an order without lines once)."""
    orders = wo.where(is_open()).join(tech_ids.select("technician_id").distinct(), "technician_id", "left_semi")
    lines = wop.select("work_order_id", "line_no", "part_id", "quantity_required", "is_available")
    return orders.join(lines, "work_order_id", "left")


def wo_delayed(wo: DataFrame, as_of: str) -> DataFrame:
    """scheduled end before ``as_of``; not Completed and not Cancelled."""
    return wo.where(F.col("scheduled_end").isNotNull()
                    & (F.col("scheduled_end") < F.lit(as_of).cast("timestamp_ntz")) & is_open())


def with_is_delayed(wo: DataFrame, as_of: str) -> DataFrame:
    """the row flag (excludes only Completed, so a cancelled overdue order is flagged)."""
    return wo.withColumn("is_delayed", X.is_delayed("status", "scheduled_end", as_of))


def wo_search(wo: DataFrame, term: str) -> DataFrame:
    """number or VIN contains the term (case-sensitive literal substring)."""
    t = F.lit(term)
    return wo.where(F.coalesce(F.col("work_order_number").contains(t), F.lit(False))
                    | F.coalesce(F.col("vin").contains(t), F.lit(False)))


def of_type(wo: DataFrame, equipment_type: str) -> DataFrame:
    """equipment type equal ignoring case."""
    return wo.where(F.lower("equipment_type") == F.lit(equipment_type.lower()))


# -- joins ----------------------------------------------------------------------------

def line_stats(wop: DataFrame) -> DataFrame:
    """Per-order line aggregates (partial + final hash aggregate; skew-safe)."""
    return (wop.groupBy("work_order_id")
               .agg(F.count(F.lit(1)).alias("line_count"),
                    F.sum("quantity_required").alias("total_quantity_required"),
                    F.count_if(~F.col("is_available")).alias("unavailable_lines")))


def wo_details(wo: DataFrame, wop: DataFrame, notif: DataFrame) -> DataFrame:
    """Order with its parts list, its notification list and their aggregates (each child collection is gathered
    per order first, so the two never multiply). Lists are sorted; an order without children has empty lists."""
    parts = wop.groupBy("work_order_id").agg(F.array_sort(F.collect_list(F.struct(
        "line_no", "part_id", "quantity_required", "is_available"))).alias("parts"))
    n = (notif.groupBy("work_order_id")
              .agg(F.array_sort(F.collect_list(F.struct("sent_at", "notification_id", "notification_type", "subject", "success", "error_message")))
                   .alias("notifications"), F.count(F.lit(1)).alias("notification_count"),
                   F.count_if(~F.col("success")).alias("failed_notifications"),
                   F.max("sent_at").alias("last_notification_at")))
    out = wo.join(line_stats(wop), "work_order_id", "left").join(parts, "work_order_id", "left").join(n, "work_order_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("parts", "notifications")})
    zero = F.lit(0).cast("bigint")
    return out.withColumns({
        "line_count": F.coalesce("line_count", zero),
        "total_quantity_required": F.coalesce("total_quantity_required", zero),
        "unavailable_lines": F.coalesce("unavailable_lines", zero),
        "notification_count": F.coalesce("notification_count", zero),
        "failed_notifications": F.coalesce("failed_notifications", zero),
    })


def wo_view(wo: DataFrame, cust: DataFrame, tech: DataFrame, as_of: str) -> DataFrame:
    """Order + customer name + technician full name + delay flag (two left joins)."""
    c = cust.select("customer_id", F.col("company_name").alias("customer_name"))
    # a missing technician gives NULL, not a blank name
    t = tech.select("technician_id", X.full_name("first_name", "last_name").alias("assigned_technician_name"))
    return (wo.join(c, "customer_id", "left").join(t, "technician_id", "left")
              .select("work_order_id", "work_order_number", "vin", "equipment_type", "priority", "status",
                      "estimated_labor_hours", "estimated_cost", "technician_id", "assigned_technician_name",
                      "customer_name", "created_at", F.col("scheduled_start").alias("scheduled_start_date"),
                      X.is_delayed("status", "scheduled_end", as_of).alias("is_delayed")))


def wo_waiting(wo: DataFrame, wop: DataFrame) -> DataFrame:
    """OnHold orders with at least one unavailable line (semi join)."""
    missing = wop.where(~F.col("is_available")).select("work_order_id")
    return wo.where(F.col("status") == ON_HOLD).join(missing, "work_order_id", "left_semi")


def parts_needed(wop: DataFrame, parts: DataFrame, wo_ids: DataFrame | None = None) -> DataFrame:
    """Order lines with part number and name (optionally for a set of orders)."""
    lines = wop if wo_ids is None else wop.join(wo_ids.select("work_order_id").distinct(), "work_order_id",
                                                "left_semi")
    p = parts.select("part_id", "part_number", "part_name")
    return (lines.join(p, "part_id")
                 .select("work_order_id", "line_no", "part_id", "part_number", "part_name",
                         F.col("quantity_required").alias("quantity")))


def wo_by_customer_name(wo: DataFrame, cust: DataFrame, term: str) -> DataFrame:
    """Customers whose company name contains the term, then their orders (semi join)."""
    hit = cust.where(F.coalesce(F.col("company_name").contains(F.lit(term)), F.lit(False))).select("customer_id")
    return wo.join(hit, "customer_id", "left_semi")


def discontinued_required(wo: DataFrame, wop: DataFrame, parts: DataFrame) -> DataFrame:
    """Lines of open orders that need a discontinued part."""
    disc = parts.where(F.col("is_discontinued")).select("part_id", "part_number", "part_name")
    open_wo = wo.where(is_open()).select("work_order_id", "work_order_number", "status", "priority")
    return (wop.join(disc, "part_id").join(open_wo, "work_order_id")
               .select("work_order_id", "work_order_number", "status", "priority", "line_no", "part_id",
                       "part_number", "part_name", "quantity_required"))


def part_shortages(wo: DataFrame, wop: DataFrame, inv: DataFrame) -> DataFrame:
    """Per open-order line, the required quantity against the part's total available (active rows)."""
    avail = (inv.where(F.col("is_active")).groupBy("part_id")
                .agg(F.sum(F.col("quantity_on_hand") - F.col("quantity_reserved")).alias("total_available")))
    lines = wop.join(wo.where(is_open()).select("work_order_id"), "work_order_id", "left_semi")
    out = lines.join(avail, "part_id", "left")
    ta = F.coalesce("total_available", F.lit(0).cast("bigint"))
    return out.select("work_order_id", "line_no", "part_id", "quantity_required",
                      ta.alias("total_available"),
                      (ta >= F.col("quantity_required")).alias("sufficient"),
                      F.greatest(F.col("quantity_required") - ta, F.lit(0).cast("bigint")).alias("shortage"))


# -- aggregates -------------------------------------------------------------------------

def active_jobs(wo: DataFrame, tech: DataFrame) -> DataFrame:
    """A4: open orders per technician, technicians without any included with 0."""
    cnt = (wo.where(is_open() & F.col("technician_id").isNotNull())
             .groupBy("technician_id").agg(F.count(F.lit(1)).alias("active_job_count")))
    return (tech.select("technician_id").join(cnt, "technician_id", "left")
                .withColumn("active_job_count", F.coalesce("active_job_count", F.lit(0).cast("bigint"))))


def can_accept(count: Column) -> Column:
    """Capacity rule: inactive or OnLeave -> no; else count < max."""
    return F.when(~F.col("is_active") | (F.col("status") == ON_LEAVE), F.lit(False)) \
            .otherwise(count < F.col("max_concurrent_jobs"))


def tech_workload(tech: DataFrame, wo: DataFrame) -> DataFrame:
    """A5: count, max, load %, can accept, would become Busy after one more job."""
    jobs = active_jobs(wo, tech)
    n = F.col("active_job_count")
    return (tech.join(jobs, "technician_id")
                .select("technician_id", X.full_name("first_name", "last_name").alias("full_name"), "status",
                        "is_active", "max_concurrent_jobs", n,
                        F.when(~F.col("is_active"), F.lit(0.0))
                         .otherwise(n.cast("double") / F.col("max_concurrent_jobs").cast("double") * 100.0)
                         .alias("workload_percentage"),
                        can_accept(n).alias("can_accept_new_job"),
                        (can_accept(n) & (F.col("status") == AVAILABLE) & ~can_accept(n + 1))
                        .alias("would_become_busy")))


def status_counts(wo: DataFrame, by_tech: bool = False) -> DataFrame:
    """Orders per status (optionally per technician)."""
    keys = ["technician_id", "status"] if by_tech else ["status"]
    return wo.groupBy(*keys).agg(F.count(F.lit(1)).alias("order_count"))


def tech_hours(wo: DataFrame) -> DataFrame:
    """Sum of estimated hours of InProgress orders per technician."""
    return (wo.where(F.col("technician_id").isNotNull()).groupBy("technician_id")
              .agg(F.sum(F.when(F.col("status") == IN_PROGRESS, F.col("estimated_labor_hours"))
                          .otherwise(F.lit(0).cast("decimal(8,2)"))).cast("decimal(18,2)")
                   .alias("in_progress_hours")))


def tech_has_critical(wo: DataFrame) -> DataFrame:
    """Any Critical order that is not Completed, per technician."""
    return (wo.where(F.col("technician_id").isNotNull()).groupBy("technician_id")
              .agg(F.bool_or((F.col("priority") == CRITICAL) & (F.col("status") != COMPLETED))
                   .alias("has_critical")))


def all_parts_available(wo: DataFrame, wop: DataFrame) -> DataFrame:
    """Per order, every line available; true for an order without lines."""
    agg = wop.groupBy("work_order_id").agg(F.bool_and("is_available").alias("_all"))
    return (wo.select("work_order_id").join(agg, "work_order_id", "left")
              .select("work_order_id", F.coalesce("_all", F.lit(True)).alias("all_parts_available")))


def estimate_accuracy(wo: DataFrame) -> DataFrame:
    """A10: completed orders per equipment type: cost and hours variance, over-budget count and %, revenue, and the
    average hours from creation to completion (``actual_labor_hours`` and ``completed_at`` may be absent: then NULL)."""
    done = wo.where(F.col("status") == COMPLETED)
    for name, kind in (("actual_labor_hours", "decimal(8,2)"), ("completed_at", "timestamp_ntz")):
        if name not in done.columns:
            done = done.withColumn(name, F.lit(None).cast(kind))
    hours, planned = F.col("actual_labor_hours"), F.col("estimated_labor_hours")
    taken = (X.ntz_micros("completed_at") - X.ntz_micros("created_at")) / F.lit(3600000000.0)
    est, act = F.col("estimated_cost"), F.col("actual_cost")
    pct = F.when(est > 0, (act - est).cast("double") / est.cast("double") * 100.0)
    return (done.groupBy("equipment_type")
                .agg(F.count(F.lit(1)).alias("completed_orders"),
                     F.count_if(act > est).alias("over_budget_orders"),
                     F.sum(est).cast("decimal(28,2)").alias("total_estimated_cost"),
                     F.sum(act).cast("decimal(28,2)").alias("revenue"),
                     F.sum(act - est).cast("decimal(28,2)").alias("total_cost_variance"),
                     F.avg(pct).alias("avg_cost_variance_pct"),
                     F.avg(F.when(act > est, pct)).alias("avg_over_budget_pct"),
                     F.avg(F.col("estimated_labor_hours").cast("double")).alias("avg_estimated_hours"),
                     F.sum(hours - planned).cast("decimal(20,2)").alias("total_hours_variance"),
                     F.avg(F.when(planned > 0, (hours - planned).cast("double") / planned.cast("double") * 100.0)).alias("avg_hours_variance_pct"),
                     F.avg(taken).alias("avg_completion_hours")))


# -- L1-L3 --------------------------------------------------------------------------------

def wo_pending(wo: DataFrame) -> DataFrame:
    """L1: Pending orders, priority descending then created (id breaks ties)."""
    return (wo.where(F.col("status") == PENDING)
              .orderBy(F.col("priority").desc(), F.col("created_at").asc(), F.col("work_order_id").asc()))


def wo_top(wo: DataFrame, k: int = 10) -> DataFrame:
    """L2: InProgress, High, cost > 1000; top k by priority desc, start asc (NULLs first), id."""
    return (wo.where((F.col("status") == IN_PROGRESS) & (F.col("priority") == HIGH)
                     & (F.col("estimated_cost") > 1000))
              .orderBy(F.col("priority").desc(), F.col("scheduled_start").asc_nulls_first(),
                       F.col("work_order_id").asc())
              .limit(k))


def page(df: DataFrame, order: list[Column], n: int, k: int) -> DataFrame:
    """L3: page ``n`` (1-based) of size ``k`` under a stated total order."""
    return df.orderBy(*order).offset((n - 1) * k).limit(k)


# -- K3 / X13 --------------------------------------------------------------------------------

def equipment_master(wo: DataFrame) -> DataFrame:
    """K3: one row per VIN (equality is by cleaned VIN): latest type, order count, conflicting types."""
    v = wo.withColumn("_vin", X.vin_clean("vin"))
    return (v.groupBy(F.col("_vin").alias("vin"))
              .agg(F.max_by("equipment_type", F.struct("created_at", "work_order_id")).alias("equipment_type"),
                   F.count(F.lit(1)).alias("order_count"),
                   F.count_distinct("equipment_type").alias("type_count"),
                   F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
              .withColumn("has_conflict", F.col("type_count") > 1))


def assign_numbers(wo: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Deterministic 'WO-<year>-<n>' numbers, dense per year in (created, id) order.

    A single window over a whole year would put that year in one task; ``numbered`` cuts a year by time, as
    finely as its number of orders asks for, and shifts the parts by the counts before them.
    """
    out = numbered(wo.withColumns({"_year": F.year("created_at"), "_all": F.lit(0)}), ["_year"], "_all", "created_at",
                   ["created_at", "work_order_id"], "_rn", chunk_rows)
    idx = F.col("_rn") - 1
    return (out.withColumns({
        "assigned_number": F.concat(F.lit("WO-"), F.col("_year").cast("string"), F.lit("-"),
                                    (F.lit(X.WO_NUMBER_LOW) + idx).cast("string")),
        "assigned_in_range": idx <= (X.WO_NUMBER_HIGH - X.WO_NUMBER_LOW),
    }).drop("_year", "_all", "_rn"))
