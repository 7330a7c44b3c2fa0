"""Registered scalar-rule projections (X1-X14), one query per rule over a domain table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.functions import scalars as X
from stockflow.functions.enums import decode_enum, enum_case_sql
from stockflow.operators import workorders as wo_ops
from stockflow.plans.fixture_sql import AS_OF
from stockflow.plans.registry import register
from stockflow.sources.domain import domain

SAME_CUR = "upper(unit_cost_currency) = upper(unit_price_currency)"


@register("money_ops", f"""
SELECT part_id,
       CASE WHEN {SAME_CUR} THEN unit_cost + unit_price END AS cost_plus_price,
       CASE WHEN {SAME_CUR} AND unit_price - unit_cost >= 0 THEN unit_price - unit_cost END AS price_minus_cost,
       CASE WHEN NOT {SAME_CUR} THEN 'currency mismatch'
            WHEN unit_price - unit_cost < 0 THEN 'negative amount' END AS subtract_error,
       cast(CASE WHEN lead_time_days >= 0 THEN unit_cost * lead_time_days END AS decimal(28,2)) AS cost_times_lead,
       CASE WHEN {SAME_CUR} THEN unit_price > unit_cost END AS price_gt_cost,
       CASE WHEN {SAME_CUR} THEN unit_price < unit_cost END AS price_lt_cost
FROM parts
""")
def q_money_ops(spark, sf_dir):
    p = domain(spark, sf_dir).parts
    a = ("unit_cost", "unit_cost_currency")
    b = ("unit_price", "unit_price_currency")
    return p.select(
        "part_id",
        X.money_add(*a, *b).alias("cost_plus_price"),
        X.money_sub(*b, *a).alias("price_minus_cost"),
        X.money_sub_error(*b, *a).alias("subtract_error"),
        X.money_mul("unit_cost", "lead_time_days").cast("decimal(28,2)").alias("cost_times_lead"),
        X.money_gt(*b, *a).alias("price_gt_cost"),
        X.money_lt(*b, *a).alias("price_lt_cost"))


@register("profit_margin", f"""
SELECT part_id,
       CASE WHEN unit_price = 0 THEN 0.0
            WHEN {SAME_CUR} AND unit_price - unit_cost >= 0
            THEN cast(unit_price - unit_cost AS double) / cast(unit_price AS double) * 100.0 END AS profit_margin
FROM parts
""")
def q_profit_margin(spark, sf_dir):
    p = domain(spark, sf_dir).parts
    return p.select("part_id", X.profit_margin("unit_price", "unit_cost", "unit_price_currency",
                                               "unit_cost_currency").alias("profit_margin"))


@register("money_format", """
SELECT part_id,
       concat(format('{:,.2f}', cast(unit_cost AS double)), ' ', upper(unit_cost_currency)) AS cost_text,
       concat(format('{:,.2f}', cast(unit_price AS double)), ' ', upper(unit_price_currency)) AS price_text
FROM parts
""")
def q_money_format(spark, sf_dir):
    p = domain(spark, sf_dir).parts
    return p.select("part_id", X.money_format("unit_cost", "unit_cost_currency").alias("cost_text"),
                    X.money_format("unit_price", "unit_price_currency").alias("price_text"))


ADDRESS_SQL = r"""
, pieces AS (
  SELECT customer_id, address,
         list_transform(string_split(address, ','), lambda x: trim(x)) AS pc,
         (address IS NULL OR trim(address) = '') AS blank
  FROM customers),
raw AS (
  SELECT customer_id, address,
         CASE WHEN blank THEN 'Unknown' WHEN len(pc) >= 4 THEN pc[1] ELSE trim(address) END AS street,
         CASE WHEN blank OR len(pc) < 4 THEN 'Unknown' ELSE pc[2] END AS city,
         CASE WHEN blank OR len(pc) < 4 THEN 'TX' ELSE upper(pc[3]) END AS state,
         CASE WHEN blank OR len(pc) < 4 THEN '00000' ELSE pc[4] END AS zip_code
  FROM pieces),
chk AS (
  SELECT *, CASE WHEN street IS NULL OR trim(street) = '' THEN 'Street address is required'
                 WHEN city IS NULL OR trim(city) = '' THEN 'City is required'
                 WHEN state IS NULL OR trim(state) = '' THEN 'State is required'
                 WHEN zip_code IS NULL OR trim(zip_code) = '' THEN 'ZIP code is required'
                 WHEN NOT regexp_matches(zip_code, '^[0-9]{5}(-[0-9]{4})?$') THEN 'Invalid US ZIP code format'
            END AS address_error
  FROM raw),
parsed AS (
  SELECT customer_id, address,
         CASE WHEN address_error IS NULL THEN street END AS street,
         CAST(NULL AS varchar) AS street2,
         CASE WHEN address_error IS NULL THEN city END AS city,
         CASE WHEN address_error IS NULL THEN state END AS state,
         CASE WHEN address_error IS NULL THEN zip_code END AS zip_code,
         CASE WHEN address_error IS NULL THEN 'USA' END AS country,
         address_error
  FROM chk)
"""


def _parsed(spark, sf_dir):
    c = domain(spark, sf_dir).customers
    return c.select("customer_id", "address", X.parse_address("address").alias("a"))


@register("address_parse", ADDRESS_SQL + "SELECT * FROM parsed")
def q_address_parse(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "customer_id", "address", "a.street", "a.street2", "a.city", "a.state", "a.zip_code", "a.country",
        F.col("a.error").alias("address_error"))


@register("address_format", ADDRESS_SQL + r"""
SELECT customer_id,
       CASE WHEN address_error IS NULL THEN concat_ws(', ', street, concat(city, ', ', state, ' ', zip_code)) END
         AS full_address,
       CASE WHEN address_error IS NULL THEN concat_ws(chr(10), street, concat(city, ', ', state, ' ', zip_code)) END
         AS multi_line_address
FROM parsed
""")
def q_address_format(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    ok = F.col("a.error").isNull()
    return p.select("customer_id",
                    F.when(ok, X.format_address("a", ", ")).alias("full_address"),
                    F.when(ok, X.format_address("a", "\n")).alias("multi_line_address"))


@register("vin_clean", r"""
SELECT work_order_id, upper(trim(vin)) AS vin_clean,
       coalesce(regexp_full_match(upper(trim(vin)), '[\pL\p{Nd}]{17}'), false) AS vin_valid,
       CASE WHEN length(upper(trim(vin))) >= 8 THEN right(upper(trim(vin)), 8) ELSE upper(trim(vin)) END AS short_vin,
       concat('Unknown ', trim(equipment_type), ' (', upper(trim(vin)), ')') AS display_name
FROM work_orders
""")
def q_vin_clean(spark, sf_dir):
    w = domain(spark, sf_dir).work_orders
    return w.select("work_order_id", X.vin_clean("vin").alias("vin_clean"), X.vin_valid("vin").alias("vin_valid"),
                    X.vin_short("vin").alias("short_vin"),
                    X.equipment_display_name("vin", "equipment_type", F.lit(None).cast("string")).alias("display_name"))


@register("period_metrics", f"""
, p AS (SELECT work_order_id, scheduled_start AS s, scheduled_end AS e,
               TIMESTAMP '{AS_OF}' AS now,
               epoch_us(scheduled_end) - epoch_us(scheduled_start) AS us
        FROM work_orders WHERE scheduled_start IS NOT NULL)
SELECT work_order_id,
       us / 3600000000.0 AS duration_hours,
       cast(CASE WHEN us / 86400000000.0 >= 0 THEN floor(us / 86400000000.0) ELSE ceil(us / 86400000000.0) END AS int)
         AS duration_days,
       e IS NULL AS is_open_ended,
       e < now AS is_past, s > now AS is_future, s <= now AND e >= now AS is_current
FROM p
""")
def q_period_metrics(spark, sf_dir):
    w = domain(spark, sf_dir).work_orders.where(F.col("scheduled_start").isNotNull())
    m = X.period_metrics("scheduled_start", "scheduled_end", AS_OF)
    return w.select("work_order_id", m.alias("m")).select("work_order_id", "m.*")


@register("period_format", """
SELECT work_order_id,
       CASE WHEN scheduled_end IS NULL THEN concat(strftime(scheduled_start, '%Y-%m-%d %H:%M'), ' - (ongoing)')
            ELSE concat(strftime(scheduled_start, '%Y-%m-%d %H:%M'), ' - ', strftime(scheduled_end, '%Y-%m-%d %H:%M'),
                        ' (', printf('%.1f', (epoch_us(scheduled_end) - epoch_us(scheduled_start)) / 3600000000.0),
                        ' hours)') END AS period_text
FROM work_orders WHERE scheduled_start IS NOT NULL
""")
def q_period_format(spark, sf_dir):
    w = domain(spark, sf_dir).work_orders.where(F.col("scheduled_start").isNotNull())
    return w.select("work_order_id", X.period_format("scheduled_start", "scheduled_end").alias("period_text"))


@register("enum_decode", f"""
SELECT w.work_order_id, {enum_case_sql('w.status', 'status')} AS status_name,
       {enum_case_sql('w.priority', 'priority')} AS priority_name,
       {enum_case_sql('t.skill_level', 'skill')} AS technician_skill_name,
       {enum_case_sql('t.status', 'technician_status')} AS technician_status_name
FROM work_orders w LEFT JOIN technicians t ON t.technician_id = w.technician_id
""")
def q_enum_decode(spark, sf_dir):
    d = domain(spark, sf_dir)
    t = d.technicians.select("technician_id", F.col("skill_level").alias("_skill"), F.col("status").alias("_tst"))
    return (d.work_orders.join(t, "technician_id", "left")
            .select("work_order_id", decode_enum("status", "status").alias("status_name"),
                    decode_enum("priority", "priority").alias("priority_name"),
                    decode_enum("_skill", "skill").alias("technician_skill_name"),
                    decode_enum("_tst", "technician_status").alias("technician_status_name")))


@register("status_description", f"""
SELECT work_order_id,
       CASE WHEN status = 0 THEN 'Waiting for assignment'
            WHEN status = 1 AND scheduled_start IS NOT NULL THEN concat('Scheduled for ', strftime(scheduled_start, '%m/%d/%Y'))
            WHEN status = 2 AND scheduled_end IS NOT NULL AND TIMESTAMP '{AS_OF}' > scheduled_end
              THEN '⚠️ DELAYED - In Progress'
            WHEN status = 2 THEN 'Currently being worked on'
            WHEN status = 4 THEN '✅ Completed'
            ELSE 'Unknown status' END AS status_description
FROM work_orders
""")
def q_status_description(spark, sf_dir):
    w = domain(spark, sf_dir).work_orders
    return w.select("work_order_id", X.status_description("status", "scheduled_start", "scheduled_end", AS_OF)
                    .alias("status_description"))


@register("technician_full_name", """
SELECT technician_id, concat(coalesce(first_name, ''), ' ', coalesce(last_name, '')) AS full_name FROM technicians
""")
def q_technician_full_name(spark, sf_dir):
    t = domain(spark, sf_dir).technicians
    return t.select("technician_id", X.full_name("first_name", "last_name").alias("full_name"))


@register("max_jobs_for_skill", """
SELECT technician_id, skill_level,
       CASE skill_level WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 2 END AS max_jobs
FROM technicians
""")
def q_max_jobs_for_skill(spark, sf_dir):
    t = domain(spark, sf_dir).technicians
    return t.select("technician_id", "skill_level", X.max_jobs_for_skill("skill_level").alias("max_jobs"))


@register("work_order_number", """
, numbered AS (
  SELECT work_order_id, work_order_number, created_at,
         row_number() OVER (PARTITION BY year(created_at) ORDER BY created_at, work_order_id) - 1
           AS idx
  FROM work_orders)
SELECT work_order_id, work_order_number,
       coalesce(regexp_full_match(work_order_number, 'WO-[0-9]{4}-[0-9]{5}'), false) AS number_valid,
       concat('WO-', cast(year(created_at) AS varchar), '-', cast(10000 + idx AS varchar)) AS assigned_number,
       idx <= 89998 AS assigned_in_range
FROM numbered
""")
def q_work_order_number(spark, sf_dir):
    w = domain(spark, sf_dir).work_orders
    return wo_ops.assign_numbers(w).select(
        "work_order_id", "work_order_number", X.wo_number_valid("work_order_number").alias("number_valid"),
        "assigned_number", "assigned_in_range")


@register("ledger_notes", """
SELECT transaction_id, transaction_type, quantity,
       CASE transaction_type
         WHEN 'Reservation' THEN concat('Reserved ', cast(abs(quantity) AS varchar), ' parts for work order')
         WHEN 'Release' THEN concat('Released ', cast(abs(quantity) AS varchar), ' parts reservation')
         WHEN 'Issue' THEN concat('Issued ', cast(abs(quantity) AS varchar), ' parts to work order')
         WHEN 'Receipt' THEN concat('Received ', cast(abs(quantity) AS varchar), ' parts')
       END AS notes
FROM inventory_transactions
""")
def q_ledger_notes(spark, sf_dir):
    t = domain(spark, sf_dir).inventory_transactions
    return t.select("transaction_id", "transaction_type", "quantity",
                    X.ledger_note("transaction_type", "quantity").alias("notes"))
