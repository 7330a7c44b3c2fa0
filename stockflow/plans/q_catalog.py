"""Registered generic-predicate and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.operators import catalog as cat
from stockflow.plans.registry import register
from stockflow.sources.domain import domain

PART_COLS = ("part_id, part_number, part_name, description, category, unit_cost, unit_cost_currency, unit_price, "
             "unit_price_currency, supplier_id, lead_time_days, default_minimum_stock_level, "
             "default_maximum_stock_level, is_discontinued, is_active")


@register("find_where", "SELECT * FROM parts WHERE unit_cost > unit_price")
def q_find_where(spark, sf_dir):
    return cat.find(domain(spark, sf_dir).parts, F.col("unit_cost") > F.col("unit_price"))


@register("first_where", "SELECT * FROM parts WHERE unit_cost > unit_price ORDER BY part_number LIMIT 1")
def q_first_where(spark, sf_dir):
    return cat.first_where(domain(spark, sf_dir).parts, F.col("unit_cost") > F.col("unit_price"),
                           [F.col("part_number")])


@register("count_where", """
SELECT count(*) FILTER (WHERE status IN (0, 1)) AS matching, count(*) AS total FROM work_orders
""")
def q_count_where(spark, sf_dir):
    return cat.count_where(domain(spark, sf_dir).work_orders, F.col("status").isin(0, 1))


@register("exists_where", "SELECT EXISTS (SELECT 1 FROM parts WHERE unit_price = 0) AS \"exists\"")
def q_exists_where(spark, sf_dir):
    return cat.exists_where(spark, domain(spark, sf_dir).parts, F.col("unit_price") == 0)


@register("lookup_by_key", f"""
, req AS (SELECT DISTINCT part_id FROM part_commands)
SELECT r.part_id, {', '.join('p.' + c.strip() for c in PART_COLS.split(',')[1:])},
       p.part_id IS NOT NULL AS found
FROM req r LEFT JOIN parts p ON p.part_id = r.part_id
""")
def q_lookup_by_key(spark, sf_dir):
    d = domain(spark, sf_dir)
    return cat.lookup(d.part_commands.select("part_id").distinct(), d.parts, "part_id")


@register("parts_active", "SELECT * FROM parts WHERE is_active AND NOT is_discontinued")
def q_parts_active(spark, sf_dir):
    return cat.parts_active(domain(spark, sf_dir).parts)


@register("parts_discontinued", "SELECT * FROM parts WHERE is_discontinued")
def q_parts_discontinued(spark, sf_dir):
    return cat.parts_discontinued(domain(spark, sf_dir).parts)


@register("parts_by_category", "SELECT * FROM parts WHERE category = 'PROMO'")
def q_parts_by_category(spark, sf_dir):
    return cat.parts_by_category(domain(spark, sf_dir).parts, "PROMO")


@register("parts_by_supplier", "SELECT * FROM parts WHERE supplier_id = 7")
def q_parts_by_supplier(spark, sf_dir):
    return cat.parts_by_supplier(domain(spark, sf_dir).parts, 7)


@register("parts_by_number", f"""
, req AS (
  SELECT seq, CASE WHEN seq % 7 = 0 THEN ' ' ELSE concat('P-', lpad(cast(part_id AS varchar), 8, '0')) END
         AS requested_number
  FROM part_commands)
SELECT r.seq, r.requested_number, {', '.join('p.' + c.strip() for c in PART_COLS.split(','))},
       p.part_id IS NOT NULL AS found
FROM req r LEFT JOIN parts p ON p.part_number = r.requested_number AND trim(r.requested_number) <> ''
""")
def q_parts_by_number(spark, sf_dir):
    d = domain(spark, sf_dir)
    req = d.part_commands.select(
        "seq", F.when(F.col("seq") % 7 == 0, F.lit(" "))
                .otherwise(F.concat(F.lit("P-"), F.lpad(F.col("part_id").cast("string"), 8, "0")))
                .alias("requested_number"))
    return cat.parts_by_number(d.parts, req)


SEARCH_SQL = """
SELECT * FROM parts
WHERE coalesce(contains(lower(part_number), '{t}'), false)
   OR coalesce(contains(lower(part_name), '{t}'), false)
   OR coalesce(contains(lower(description), '{t}'), false)
"""


@register("parts_search", SEARCH_SQL.format(t="gear"))
def q_parts_search(spark, sf_dir):
    return cat.parts_search(domain(spark, sf_dir).parts, "GEAR")


@register("parts_list", SEARCH_SQL.format(t="brand#1"))
def q_parts_list(spark, sf_dir):
    return cat.parts_list(domain(spark, sf_dir).parts, search="Brand#1", category="PROMO", active_only=True)


@register("parts_view", """
SELECT part_id, part_number, part_name, description, category, unit_cost, unit_price,
       CASE WHEN unit_price = 0 THEN 0.0
            WHEN upper(unit_price_currency) = upper(unit_cost_currency) AND unit_price - unit_cost >= 0
            THEN cast(unit_price - unit_cost AS double) / cast(unit_price AS double) * 100.0 END AS profit_margin,
       CASE WHEN unit_price = 0 THEN NULL
            WHEN upper(unit_price_currency) <> upper(unit_cost_currency) THEN 'currency mismatch'
            WHEN unit_price - unit_cost < 0 THEN 'negative amount' END AS margin_error,
       supplier_id, lead_time_days, default_minimum_stock_level, default_maximum_stock_level,
       default_maximum_stock_level - default_minimum_stock_level AS default_reorder_quantity,
       is_active, is_discontinued
FROM parts
""")
def q_parts_view(spark, sf_dir):
    return cat.parts_view(domain(spark, sf_dir).parts)


@register("currency_mismatch", "SELECT * FROM parts WHERE upper(unit_cost_currency) <> upper(unit_price_currency)")
def q_currency_mismatch(spark, sf_dir):
    return cat.currency_mismatch(domain(spark, sf_dir).parts)
