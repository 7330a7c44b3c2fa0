"""Registered key and data-quality jobs (K1-K4, Q1-Q7).

The registered forms render ``reasons`` as text (``reasons_text``, '; '-joined)
so both engines compare plain strings; the operators keep the array.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.operators import quality as Q
from stockflow.plans.q_inventory import LOCATION_REQUESTS_SQL, location_requests
from stockflow.plans.registry import register
from stockflow.sources.domain import domain


def _text(df):
    return df.withColumn("reasons_text", F.array_join("reasons", "; ")).drop("reasons")


def _sql_reasons(rules: list[tuple[str, str]]) -> str:
    arr = ", ".join(f"CASE WHEN {cond} THEN '{text}' END" for text, cond in rules)
    lst = f"list_filter([{arr}], lambda x: x IS NOT NULL)"
    return f"array_to_string({lst}, '; ') AS reasons_text, len({lst}) = 0 AS valid"


def _blank(c):
    return f"({c} IS NULL OR trim({c}) = '')"


def _long(c, n):
    return f"coalesce(length({c}) > {n}, false)"


def _lt(c, v):
    return f"coalesce({c} < {v}, false)"


PART_RULES = [
    ("Part number is required", _blank("part_number")),
    ("Part number longer than 50", _long("part_number", 50)),
    ("Part name is required", _blank("part_name")),
    ("Part name longer than 200", _long("part_name", 200)),
    ("Description longer than 1000", _long("description", 1000)),
    ("Category longer than 100", _long("category", 100)),
    ("Unit cost cannot be negative", _lt("unit_cost", 0)),
    ("Unit price cannot be negative", _lt("unit_price", 0)),
    ("Lead time cannot be negative", _lt("lead_time_days", 0)),
    ("Minimum stock level cannot be negative", _lt("default_minimum_stock_level", 0)),
    ("Maximum must be >= minimum", "coalesce(default_maximum_stock_level < default_minimum_stock_level, false)"),
]


@register("validate_parts", f"SELECT *, {_sql_reasons(PART_RULES)} FROM parts")
def q_validate_parts(spark, sf_dir):
    return _text(Q.validate_parts(domain(spark, sf_dir).parts))


INV_RULES = [
    ("PartId is required", "part_id IS NULL"),
    ("Warehouse is required", _blank("warehouse")),
    ("Minimum stock level cannot be negative", _lt("minimum_stock_level", 0)),
    ("Maximum stock level must be >= minimum", "coalesce(maximum_stock_level < minimum_stock_level, false)"),
    ("Quantity on hand cannot be negative", _lt("quantity_on_hand", 0)),
    ("Reserved quantity cannot be negative", _lt("quantity_reserved", 0)),
    ("Reserved quantity exceeds quantity on hand", "coalesce(quantity_reserved > quantity_on_hand, false)"),
]


@register("validate_inventory", f"SELECT *, {_sql_reasons(INV_RULES)} FROM inventory")
def q_validate_inventory(spark, sf_dir):
    return _text(Q.validate_inventory(domain(spark, sf_dir).inventory))


_VIN = "upper(trim(vin))"
WO_RULES = [
    ("Equipment VIN is required", _blank("vin")),
    ("VIN must be 17 characters", f"NOT {_blank('vin')} AND length({_VIN}) <> 17"),
    ("VIN must contain only letters and numbers",
     f"NOT {_blank('vin')} AND length({_VIN}) = 17 AND NOT coalesce(regexp_full_match({_VIN}, '[\\pL\\p{{Nd}}]{{17}}'), false)"),
    ("Equipment type is required", _blank("equipment_type")),
    ("Equipment type longer than 100", _long("equipment_type", 100)),
    ("Customer ID is required", "customer_id IS NULL"),
    ("Priority must be between 1 (Low) and 4 (Critical)", "coalesce(NOT (priority BETWEEN 1 AND 4), true)"),
    ("Estimated labor hours must be between 0 and 999",
     "coalesce(NOT (estimated_labor_hours BETWEEN 0 AND 999), false)"),
    ("Estimated cost cannot be negative", _lt("estimated_cost", 0)),
]


@register("validate_work_orders", f"SELECT *, {_sql_reasons(WO_RULES)} FROM work_orders")
def q_validate_work_orders(spark, sf_dir):
    return _text(Q.validate_work_orders(domain(spark, sf_dir).work_orders))


@register("validate_technicians", f"""
SELECT *, {_sql_reasons([("First name is required", _blank("first_name")),
                         ("Last name is required", _blank("last_name"))])} FROM technicians
""")
def q_validate_technicians(spark, sf_dir):
    return _text(Q.validate_technicians(domain(spark, sf_dir).technicians))


@register("validate_customers", r"""
, pc AS (SELECT *, list_transform(string_split(address, ','), lambda x: trim(x)) AS pcs,
                (address IS NULL OR trim(address) = '') AS blank FROM customers),
pz AS (SELECT *, CASE WHEN blank THEN 'Unknown' WHEN len(pcs) >= 4 THEN pcs[1] ELSE trim(address) END AS a_street,
              CASE WHEN blank OR len(pcs) < 4 THEN 'Unknown' ELSE pcs[2] END AS a_city,
              CASE WHEN blank OR len(pcs) < 4 THEN 'TX' ELSE upper(pcs[3]) END AS a_state,
              CASE WHEN blank OR len(pcs) < 4 THEN '00000' ELSE pcs[4] END AS a_zip FROM pc),
pe AS (SELECT customer_id, company_name, segment, prefer_email, prefer_sms, address,
              (a_street IS NULL OR trim(a_street) = '') OR (a_city IS NULL OR trim(a_city) = '')
              OR (a_state IS NULL OR trim(a_state) = '') OR (a_zip IS NULL OR trim(a_zip) = '')
              OR NOT regexp_matches(a_zip, '^[0-9]{5}(-[0-9]{4})?$') AS bad_address FROM pz)
SELECT customer_id, company_name, segment, prefer_email, prefer_sms, address,
""" + _sql_reasons([("Company name is required", _blank("company_name")),
                    ("Address: invalid", "bad_address")]) + " FROM pe")
def q_validate_customers(spark, sf_dir):
    return _text(Q.validate_customers(domain(spark, sf_dir).customers))


@register("validate_requests", f"""
, asked AS (SELECT work_order_id, CASE WHEN work_order_id % 17 = 0 THEN NULL ELSE technician_id END AS technician_id,
                   CASE WHEN work_order_id % 13 = 0 THEN ' ' ELSE 'dispatch' END AS assigned_by FROM assignment_requests),
st AS (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 9 WHEN event_id % 23 = 0 THEN NULL ELSE new_status END AS new_status FROM status_requests)
SELECT 'reservation' AS kind, concat_ws('/', work_order_id, line_no, part_id) AS request_key,
       {_sql_reasons([("Part ID is required", "part_id IS NULL"), ("Quantity must be at least 1", "coalesce(quantity < 1, true)")])}
FROM reservation_requests
UNION ALL
SELECT 'assign', cast(work_order_id AS varchar),
       {_sql_reasons([("Technician ID is required", "technician_id IS NULL"), ("Assigned by is required", _blank("assigned_by"))])}
FROM asked
UNION ALL
SELECT 'status', cast(event_id AS varchar),
       {_sql_reasons([("Status must be between 0 and 5", "coalesce(NOT (new_status BETWEEN 0 AND 5), true)")])}
FROM st
""")
def q_validate_requests(spark, sf_dir):
    d = domain(spark, sf_dir)
    w, e = F.col("work_order_id"), F.col("event_id")
    asked = d.assignment_requests.select("work_order_id", F.when(w % 17 != 0, F.col("technician_id")).alias("technician_id"),
                                         F.when(w % 13 == 0, " ").otherwise("dispatch").alias("assigned_by"))
    status = d.status_requests.select("event_id", F.when(e % 19 == 0, 9).when(e % 23 != 0, F.col("new_status")).alias("new_status"))

    def checked(df, kind, key):
        return _text(Q.validate_requests(df, kind)).select(F.lit(kind).alias("kind"), key.alias("request_key"), "reasons_text", "valid")
    return (checked(d.reservation_requests, "reservation", F.concat_ws("/", "work_order_id", "line_no", "part_id"))
            .unionByName(checked(asked, "assign", w.cast("string"))).unionByName(checked(status, "status", e.cast("string"))))


@register("validate_periods", f"""
SELECT work_order_id, scheduled_start, scheduled_end, scheduled_end + INTERVAL 1 DAY * (work_order_id % 3 - 1) AS new_end,
       {_sql_reasons([("Start date must be before or equal to end date",
                       "coalesce(scheduled_start > scheduled_end, false)"),
                      ("New end date must be after current end date",
                       "coalesce(scheduled_end + INTERVAL 1 DAY * (work_order_id % 3 - 1) < scheduled_end, false)")])}
FROM work_orders
""")
def q_validate_periods(spark, sf_dir):
    w = domain(spark, sf_dir).work_orders
    w = w.select("work_order_id", "scheduled_start", "scheduled_end",
                 (F.col("scheduled_end") + F.make_dt_interval(days=(F.col("work_order_id") % 3 - 1).cast("int")))
                 .alias("new_end"))
    return _text(Q.validate_periods(w, "scheduled_start", "scheduled_end", "new_end"))


# every 50th part, location and order is inserted a second time, so that the report has rows
@register("duplicate_keys", """
, p2 AS (SELECT part_id, part_number FROM parts UNION ALL SELECT part_id, part_number FROM parts WHERE part_id % 50 = 7),
i2 AS (SELECT part_id, warehouse FROM inventory UNION ALL SELECT part_id, warehouse FROM inventory WHERE inventory_id % 50 = 7),
w2 AS (SELECT work_order_number FROM work_orders UNION ALL SELECT work_order_number FROM work_orders WHERE work_order_id % 50 = 7)
SELECT 'parts.part_number' AS index_name, part_number AS key_value, count(*) AS row_count
FROM p2 GROUP BY part_number HAVING count(*) > 1
UNION ALL
SELECT 'inventory.part_warehouse', concat(cast(part_id AS varchar), '|', warehouse), count(*)
FROM i2 GROUP BY part_id, warehouse HAVING count(*) > 1
UNION ALL
SELECT 'work_orders.work_order_number', work_order_number, count(*)
FROM w2 GROUP BY work_order_number HAVING count(*) > 1
UNION ALL
SELECT 'customers.email', concat('c', cast(customer_id % 140 AS varchar), '@example.com'), count(*)
FROM customers GROUP BY customer_id % 140 HAVING count(*) > 1
UNION ALL
SELECT 'technicians.email', concat('t', cast(technician_id % 9 AS varchar), '@example.com'), count(*)
FROM technicians GROUP BY technician_id % 9 HAVING count(*) > 1
""")
def q_duplicate_keys(spark, sf_dir):
    d = domain(spark, sf_dir)

    def mailed(df, key, letter, n):
        return df.withColumn("email", F.concat(F.lit(letter), (F.col(key) % n).cast("string"), F.lit("@example.com")))

    def twice(df, key):
        return df.unionByName(df.where(F.col(key) % 50 == 7))
    return (Q.duplicate_keys(twice(d.parts, "part_id"), ["part_number"], "parts.part_number")
            .unionByName(Q.duplicate_keys(twice(d.inventory, "inventory_id"), ["part_id", "warehouse"], "inventory.part_warehouse"))
            .unionByName(Q.duplicate_keys(twice(d.work_orders, "work_order_id"), ["work_order_number"],
                                          "work_orders.work_order_number"))
            .unionByName(Q.duplicate_keys(mailed(d.customers, "customer_id", "c", 140), ["email"], "customers.email"))
            .unionByName(Q.duplicate_keys(mailed(d.technicians, "technician_id", "t", 9), ["email"], "technicians.email")))


@register("insert_new_only", LOCATION_REQUESTS_SQL + """
, fresh AS (
  SELECT q.* FROM location_requests q
  WHERE trim(q.warehouse) <> ''
    AND NOT EXISTS (SELECT 1 FROM inventory i WHERE i.part_id = q.part_id AND i.warehouse = q.warehouse)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY part_id, warehouse ORDER BY work_order_id, line_no, quantity) AS rn
  FROM fresh)
SELECT part_id, warehouse, work_order_id, line_no, quantity FROM ranked WHERE rn = 1
""")
def q_insert_new_only(spark, sf_dir):
    d = domain(spark, sf_dir)
    cand = location_requests(d).where(F.trim("warehouse") != "")
    return Q.admit_new(cand, d.inventory, ["part_id", "warehouse"], ["work_order_id", "line_no", "quantity"])


@register("customer_address_dedupe", r"""
, pc AS (SELECT *, list_transform(string_split(address, ','), lambda x: trim(x)) AS pcs,
                (address IS NULL OR trim(address) = '') AS blank FROM customers),
pz AS (SELECT customer_id, company_name,
              CASE WHEN blank THEN 'Unknown' WHEN len(pcs) >= 4 THEN pcs[1] ELSE trim(address) END AS a_street,
              CASE WHEN blank OR len(pcs) < 4 THEN 'Unknown' ELSE pcs[2] END AS a_city,
              CASE WHEN blank OR len(pcs) < 4 THEN 'TX' ELSE upper(pcs[3]) END AS a_state,
              CASE WHEN blank OR len(pcs) < 4 THEN '00000' ELSE pcs[4] END AS a_zip FROM pc),
ok AS (SELECT customer_id, company_name,
              concat_ws('|', upper(a_street), '', upper(a_city), upper(a_state), upper(a_zip), 'USA') AS address_key
       FROM pz
       WHERE NOT ((a_street IS NULL OR trim(a_street) = '') OR (a_city IS NULL OR trim(a_city) = '')
              OR (a_state IS NULL OR trim(a_state) = '') OR (a_zip IS NULL OR trim(a_zip) = '')
              OR NOT regexp_matches(a_zip, '^[0-9]{5}(-[0-9]{4})?$'))),
sz AS (SELECT address_key, count(*) AS group_size FROM ok GROUP BY address_key HAVING count(*) > 1)
SELECT ok.address_key, ok.customer_id, ok.company_name, sz.group_size FROM ok JOIN sz ON sz.address_key = ok.address_key
""")
def q_customer_address_dedupe(spark, sf_dir):
    return Q.address_dedupe(domain(spark, sf_dir).customers)


# some parents are taken out, so that the report has rows
@register("reference_violations", """
SELECT 'work_order.customer' AS rule, cast(w.work_order_id AS varchar) AS child_id, cast(w.customer_id AS varchar) AS missing_key
FROM work_orders w WHERE w.customer_id IS NOT NULL AND w.customer_id NOT IN (SELECT customer_id FROM customers WHERE customer_id % 100 <> 3)
UNION ALL
SELECT 'work_order.technician', cast(w.work_order_id AS varchar), cast(w.technician_id AS varchar)
FROM work_orders w WHERE w.technician_id IS NOT NULL AND w.technician_id NOT IN (SELECT technician_id FROM technicians WHERE technician_id % 50 <> 3)
UNION ALL
SELECT 'ledger.location', t.transaction_id, cast(t.inventory_id AS varchar)
FROM inventory_transactions t WHERE t.inventory_id IS NOT NULL AND t.inventory_id NOT IN (SELECT inventory_id FROM inventory WHERE inventory_id % 500 <> 3)
UNION ALL
SELECT 'line.work_order', cast(l.work_order_id AS varchar), cast(l.work_order_id AS varchar)
FROM work_order_parts l WHERE l.work_order_id IS NOT NULL AND l.work_order_id NOT IN (SELECT work_order_id FROM work_orders)
UNION ALL
SELECT 'inventory.part', cast(i.inventory_id AS varchar), cast(i.part_id AS varchar)
FROM inventory i WHERE i.inventory_id % 500 <> 3 AND i.part_id IS NOT NULL AND i.part_id NOT IN (SELECT part_id FROM parts WHERE part_id % 200 <> 3)
UNION ALL
SELECT 'line.part', cast(l.work_order_id AS varchar), cast(l.part_id AS varchar)
FROM work_order_parts l WHERE l.part_id IS NOT NULL AND l.part_id NOT IN (SELECT part_id FROM parts WHERE part_id % 200 <> 3)
""")
def q_reference_violations(spark, sf_dir):
    d = domain(spark, sf_dir)
    cust, tech = d.customers.where("customer_id % 100 <> 3"), d.technicians.where("technician_id % 50 <> 3")
    locations, parts = d.inventory.where("inventory_id % 500 <> 3"), d.parts.where("part_id % 200 <> 3")
    report = Q.reference_violations(d.work_orders, tech, cust, locations, d.inventory_transactions, d.work_order_parts, parts)
    return report
