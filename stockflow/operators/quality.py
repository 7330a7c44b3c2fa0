"""Keys, constraints and data-quality checks (K1-K4, Q1-Q7) as batch jobs.

Every Q job adds ``reasons`` (array of rule texts, empty when clean) and
``valid``; rules are Column expressions collected with ``filter(array(..))``.
Rules on columns a frame does not carry are skipped (the plan is chosen from
the schema on the driver; no data is looked at).

Fixed values (rule texts and limits of the source application):
  part number required, at most 50 chars; part name required, at most 200; description at most 1000;
  category at most 100; money amounts not negative; lead time not negative; default min not negative,
  max >= min, reorder not negative; inventory part and warehouse required, min not negative, max >= min;
  VIN 17 letters or digits; equipment type required, at most 100; customer required; description 10..2000;
  priority 1..4; labor hours 0..999; cost not negative; creator required; names required; email contains '@';
  company name required; status 0..5; reservation quantity at least 1; period start <= end;
  an extension may not end before the current end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions import scalars as X


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def _too_long(c: str, n: int) -> Column:
    return F.coalesce(F.length(c) > n, F.lit(False))


def _lt(c: str, v) -> Column:
    return F.coalesce(F.col(c) < v, F.lit(False))


def with_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Attach ``reasons`` / ``valid`` from (text, failing-condition) pairs over present columns."""
    arr = F.array(*[F.when(cond, F.lit(text)) for text, cond in rules]) if rules else F.array().cast("array<string>")
    reasons = F.filter(arr, lambda x: x.isNotNull())
    return df.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


# -- Q1-Q7 ------------------------------------------------------------------------------

def validate_parts(df: DataFrame) -> DataFrame:
    r: list[tuple[str, Column]] = []
    if _has(df, "part_number"):
        r += [("Part number is required", _blank("part_number")),
              ("Part number longer than 50", _too_long("part_number", 50))]
    if _has(df, "part_name"):
        r += [("Part name is required", _blank("part_name")),
              ("Part name longer than 200", _too_long("part_name", 200))]
    if _has(df, "description"):
        r.append(("Description longer than 1000", _too_long("description", 1000)))
    if _has(df, "category"):
        r.append(("Category longer than 100", _too_long("category", 100)))
    if _has(df, "unit_cost"):
        r.append(("Unit cost cannot be negative", _lt("unit_cost", 0)))
    if _has(df, "unit_price"):
        r.append(("Unit price cannot be negative", _lt("unit_price", 0)))
    if _has(df, "lead_time_days"):
        r.append(("Lead time cannot be negative", _lt("lead_time_days", 0)))
    if _has(df, "default_minimum_stock_level"):
        r.append(("Minimum stock level cannot be negative", _lt("default_minimum_stock_level", 0)))
    if _has(df, "default_minimum_stock_level", "default_maximum_stock_level"):
        r.append(("Maximum must be >= minimum",
                  F.coalesce(F.col("default_maximum_stock_level") < F.col("default_minimum_stock_level"),
                             F.lit(False))))
    if _has(df, "default_reorder_quantity"):
        r.append(("Reorder quantity cannot be negative", _lt("default_reorder_quantity", 0)))
    return with_reasons(df, r)


def validate_inventory(df: DataFrame) -> DataFrame:
    r = [("PartId is required", F.col("part_id").isNull()),
         ("Warehouse is required", _blank("warehouse")),
         ("Minimum stock level cannot be negative", _lt("minimum_stock_level", 0)),
         ("Maximum stock level must be >= minimum",
          F.coalesce(F.col("maximum_stock_level") < F.col("minimum_stock_level"), F.lit(False))),
         ("Quantity on hand cannot be negative", _lt("quantity_on_hand", 0)),
         ("Reserved quantity cannot be negative", _lt("quantity_reserved", 0)),
         ("Reserved quantity exceeds quantity on hand",
          F.coalesce(F.col("quantity_reserved") > F.col("quantity_on_hand"), F.lit(False)))]
    return with_reasons(df, r)


def validate_work_orders(df: DataFrame) -> DataFrame:
    r: list[tuple[str, Column]] = []
    if _has(df, "vin"):
        clean = X.vin_clean("vin")
        r += [("Equipment VIN is required", _blank("vin")),
              ("VIN must be 17 characters", ~_blank("vin") & (F.length(clean) != 17)),
              ("VIN must contain only letters and numbers",
               ~_blank("vin") & (F.length(clean) == 17) & ~X.vin_valid("vin"))]
    if _has(df, "equipment_type"):
        r += [("Equipment type is required", _blank("equipment_type")),
              ("Equipment type longer than 100", _too_long("equipment_type", 100))]
    if _has(df, "equipment_model"):
        r.append(("Equipment model longer than 100", _too_long("equipment_model", 100)))
    if _has(df, "customer_id"):
        r.append(("Customer ID is required", F.col("customer_id").isNull()))
    if _has(df, "description"):
        r.append(("Description must be 10 to 2000 characters",
                  _blank("description") | (F.length("description") < 10) | (F.length("description") > 2000)))
    if _has(df, "priority"):
        r.append(("Priority must be between 1 (Low) and 4 (Critical)",
                  F.coalesce(~F.col("priority").between(1, 4), F.lit(True))))
    if _has(df, "estimated_labor_hours"):
        r.append(("Estimated labor hours must be between 0 and 999",
                  F.coalesce(~F.col("estimated_labor_hours").between(0, 999), F.lit(False))))
    if _has(df, "estimated_cost"):
        r.append(("Estimated cost cannot be negative", _lt("estimated_cost", 0)))
    if _has(df, "created_by"):
        r.append(("Created by is required", _blank("created_by")))
    return with_reasons(df, r)


def validate_technicians(df: DataFrame) -> DataFrame:
    r = [("First name is required", _blank("first_name")), ("Last name is required", _blank("last_name"))]
    if _has(df, "email"):
        r.append(("Valid email is required", _blank("email") | ~F.coalesce(F.col("email").contains("@"), F.lit(False))))
    return with_reasons(df, r)


def validate_customers(df: DataFrame, on_update: bool = False) -> DataFrame:
    r = [("Company name is required", _blank("company_name"))]
    if on_update and _has(df, "email"):
        r.append(("Email is required", _blank("email")))
    if _has(df, "address"):
        r.append(("Address: invalid", X.parse_address("address").error.isNotNull()))
    return with_reasons(df, r)


def validate_requests(df: DataFrame, kind: str) -> DataFrame:
    """Q6: request checks by kind: 'assign', 'status' or 'reservation'."""
    r: list[tuple[str, Column]] = []
    if kind == "assign":
        r.append(("Technician ID is required", F.col("technician_id").isNull()))
        if _has(df, "assigned_by"):
            r.append(("Assigned by is required", _blank("assigned_by")))
        if _has(df, "scheduled_start", "scheduled_end"):
            r.append(("Start must be before or equal to end",
                      F.coalesce(F.col("scheduled_start") > F.col("scheduled_end"), F.lit(False))))
    elif kind == "status":
        r.append(("Status must be between 0 and 5", F.coalesce(~F.col("new_status").between(0, 5), F.lit(True))))
    elif kind == "reservation":
        r += [("Part ID is required", F.col("part_id").isNull()),
              ("Quantity must be at least 1", F.coalesce(F.col("quantity") < 1, F.lit(True)))]
        if _has(df, "reserved_by"):
            r.append(("Reserved by is required", _blank("reserved_by")))
    else:
        raise ValueError(f"unknown request kind {kind}")
    return with_reasons(df, r)


def validate_periods(df: DataFrame, start: str, end: str, new_end: str | None = None) -> DataFrame:
    """Q7: start <= end; an extension (``new_end``) may not end before the current end."""
    r = [("Start date must be before or equal to end date",
          F.coalesce(F.col(start) > F.col(end), F.lit(False)))]
    if new_end is not None:
        r.append(("New end date must be after current end date",
                  F.coalesce(F.col(new_end) < F.col(end), F.lit(False))))
    return with_reasons(df, r)


# -- K1-K4 -----------------------------------------------------------------------------------

def duplicate_keys(df: DataFrame, cols: list[str], index_name: str) -> DataFrame:
    """K1: keys of a unique index that occur more than once (partial + final aggregate)."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return (df.groupBy(key.alias("key_value")).agg(F.count(F.lit(1)).alias("row_count"))
              .where(F.col("row_count") > 1)
              .select(F.lit(index_name).alias("index_name"), "key_value", "row_count"))


def admit_new(candidates: DataFrame, base: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """K2: candidates whose key is new in the table and first (by ``seq``) within the batch.

    The within-batch winner is a ``min_by`` aggregate (map-side partial
    aggregation), not a window, so a key repeated many times does not pile
    up in one task.
    """
    fresh = candidates.join(base.select(*key).distinct(), key, "left_anti")
    others = [c for c in candidates.columns if c not in key]
    firsts = (fresh.groupBy(*key)
                   .agg(F.min_by(F.struct(*others), F.struct(*seq)).alias("_first")))
    return firsts.select(*key, "_first.*")


def address_dedupe(cust: DataFrame) -> DataFrame:
    """K4: customers sharing an address (six fields, case ignored, NULL street2 = '').

    Flat output (one row per customer of a shared address) with the group size;
    the group key is the upper-cased joined address.
    """
    a = X.parse_address("address")
    key = F.concat_ws("|", *[F.upper(F.coalesce(a[f], F.lit(""))) for f in
                             ("street", "street2", "city", "state", "zip_code", "country")])
    keyed = cust.where(a.error.isNull()).select("customer_id", "company_name", key.alias("address_key"))
    sizes = keyed.groupBy("address_key").agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > 1)
    return keyed.join(sizes, "address_key")


def reference_violations(wo: DataFrame, tech: DataFrame, cust: DataFrame, inv: DataFrame, tx: DataFrame,
                         wop: DataFrame, parts: DataFrame) -> DataFrame:
    """Child rows whose parent key is missing (the foreign keys of the source schema), as one report.

    Each rule is a left anti join; NULL child keys are not violations
    (optional references such as an unassigned technician).
    """
    def rule(name: str, child: DataFrame, child_key: str, child_id: str, parent: DataFrame, parent_key: str):
        c = child.where(F.col(child_key).isNotNull()).select(
            F.col(child_id).cast("string").alias("child_id"), F.col(child_key).alias("_k"))
        p = parent.select(F.col(parent_key).alias("_k")).distinct()
        return (c.join(p, "_k", "left_anti")
                 .select(F.lit(name).alias("rule"), "child_id", F.col("_k").cast("string").alias("missing_key")))

    return (rule("work_order.customer", wo, "customer_id", "work_order_id", cust, "customer_id")
            .unionByName(rule("work_order.technician", wo, "technician_id", "work_order_id", tech, "technician_id"))
            .unionByName(rule("ledger.location", tx, "inventory_id", "transaction_id", inv, "inventory_id"))
            .unionByName(rule("line.work_order", wop, "work_order_id", "work_order_id", wo, "work_order_id"))
            .unionByName(rule("inventory.part", inv, "part_id", "inventory_id", parts, "part_id"))
            .unionByName(rule("line.part", wop, "part_id", "work_order_id", parts, "part_id")))
