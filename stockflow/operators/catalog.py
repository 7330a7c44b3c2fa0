"""Generic repository predicates (F1-F5) and parts-catalog queries.

Predicates are ``Column`` arguments, so they stay inside Catalyst and reach
the Parquet scan as pushed filters where possible. Presentation orders are
applied only where the operator is defined by them (F2 first-by-order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.functions import scalars as X


def _blank(s: str | None) -> bool:
    return s is None or s.strip() == ""


# -- F1-F5 generic ----------------------------------------------------------------

def find(df: DataFrame, predicate: Column) -> DataFrame:
    """every row matching the predicate."""
    return df.where(predicate)


def first_where(df: DataFrame, predicate: Column, order: list[Column]) -> DataFrame:
    """first match under a stated order (TakeOrdered: a per-partition top-1, then one merge)."""
    return df.where(predicate).orderBy(*order).limit(1)


def count_where(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """one row with the number of matching rows and the total."""
    pred = predicate if predicate is not None else F.lit(True)
    return df.agg(F.count_if(pred).alias("matching"), F.count(F.lit(1)).alias("total"))


def exists_where(spark: SparkSession, df: DataFrame, predicate: Column) -> DataFrame:
    """one row, ``exists`` = any row matches (an EXISTS subquery; stops at the first hit)."""
    return spark.range(1).select(df.where(predicate).exists().alias("exists"))


def lookup(requests: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """a batch of keys -> rows, with ``found`` (replaces one-by-one get-by-id / 404)."""
    right = df.withColumn("_hit", F.lit(True))
    return (requests.join(right, key, "left")
                    .withColumn("found", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))


# -- F6-F12 parts ---------------------------------------------------------------------

def parts_active(parts: DataFrame) -> DataFrame:
    """active and not discontinued."""
    return parts.where(F.col("is_active") & ~F.col("is_discontinued"))


def parts_discontinued(parts: DataFrame) -> DataFrame:
    """F7."""
    return parts.where(F.col("is_discontinued"))


def parts_by_category(parts: DataFrame, category: str | None) -> DataFrame:
    """F8: category equals; a blank category returns every part."""
    return parts if _blank(category) else parts.where(F.col("category") == category)


def parts_by_supplier(parts: DataFrame, supplier_id) -> DataFrame:
    """F9."""
    return parts.where(F.col("supplier_id") == F.lit(supplier_id))


def parts_by_number(parts: DataFrame, requests: DataFrame, col: str = "requested_number") -> DataFrame:
    """exact part-number lookup per request; a blank number finds nothing."""
    p = parts.withColumnRenamed("part_number", "_pn")
    blank = F.trim(F.coalesce(F.col(col), F.lit(""))) == ""
    r = requests.withColumn("_blank", blank)
    out = r.join(p, (r[col] == p["_pn"]) & ~r["_blank"], "left")
    return (out.withColumn("found", F.col("part_id").isNotNull())
               .withColumnRenamed("_pn", "part_number").drop("_blank"))


def search_predicate(term: str) -> Column:
    """Case-folded literal substring over number, name and description (NULL description never matches)."""
    t = F.lit(term.lower())
    return (F.coalesce(F.lower("part_number").contains(t), F.lit(False))
            | F.coalesce(F.lower("part_name").contains(t), F.lit(False))
            | F.coalesce(F.lower("description").contains(t), F.lit(False)))


def parts_search(parts: DataFrame, term: str | None) -> DataFrame:
    """blank term returns every part."""
    return parts if _blank(term) else parts.where(search_predicate(term))


def parts_list(parts: DataFrame, search: str | None = None, category: str | None = None,
               active_only: bool = False) -> DataFrame:
    """one filter with precedence search > category > active only > all (chosen on the driver)."""
    if not _blank(search):
        return parts_search(parts, search)
    if not _blank(category):
        return parts_by_category(parts, category)
    if active_only:
        return parts_active(parts)
    return parts


def parts_view(parts: DataFrame) -> DataFrame:
    """catalog projection with profit margin (NULL + error when the margin is refused)."""
    return parts.select(
        "part_id", "part_number", "part_name", "description", "category", "unit_cost", "unit_price",
        X.profit_margin("unit_price", "unit_cost", "unit_price_currency", "unit_cost_currency").alias("profit_margin"),
        X.margin_error("unit_price", "unit_cost", "unit_price_currency", "unit_cost_currency").alias("margin_error"),
        "supplier_id", "lead_time_days", "default_minimum_stock_level", "default_maximum_stock_level",
        (F.col("default_maximum_stock_level") - F.col("default_minimum_stock_level")).alias("default_reorder_quantity"),
        "is_active", "is_discontinued")


def currency_mismatch(parts: DataFrame) -> DataFrame:
    """Q8: rows whose cost and price currencies differ (case ignored)."""
    return parts.where(F.upper("unit_cost_currency") != F.upper("unit_price_currency"))
