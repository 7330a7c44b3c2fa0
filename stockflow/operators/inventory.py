"""Stock-location jobs: filters (F13-F18), joins (J1-J3, J13, J14) and aggregates.

All jobs are whole-table DataFrame plans. Joins to the parts catalog are plain
equi-joins: the catalog grows with the data, so AQE decides at runtime whether
to broadcast it (it is never forced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEC28 = "decimal(28,2)"


def available() -> Column:
    return F.col("quantity_on_hand") - F.col("quantity_reserved")


def is_low() -> Column:
    """Low stock is inclusive: available <= minimum (min 0 and available 0 is low)."""
    return available() <= F.col("minimum_stock_level")


def is_out() -> Column:
    return available() <= 0


def reorder_suggestion() -> Column:
    """Quantity that brings a low location back to its maximum; 0 when not low."""
    return F.when(is_low(), F.col("maximum_stock_level") - available()).otherwise(F.lit(0))


# -- F13-F18 ---------------------------------------------------------------

def inventory_view(inv: DataFrame) -> DataFrame:
    """snapshot plus available, low / out flags and reorder suggestion."""
    return inv.withColumns({
        "available_quantity": available(),
        "is_low_stock": is_low(),
        "is_out_of_stock": is_out(),
        "reorder_suggestion": reorder_suggestion(),
    })


def inventory_by_part(inv: DataFrame, part_ids: DataFrame) -> DataFrame:
    """active locations of the requested parts (semi join), presentation sort by warehouse."""
    return (inv.where(F.col("is_active"))
               .join(part_ids.select("part_id").distinct(), "part_id", "left_semi"))


def inventory_at(inv: DataFrame, requests: DataFrame) -> DataFrame:
    """active row for each (part, warehouse) request; blank warehouse finds nothing.

    Requests keep their own columns; ``found`` tells whether a location matched.
    """
    loc = inv.where(F.col("is_active")).select(
        F.col("part_id").alias("_pid"), F.col("warehouse").alias("_wh"),
        "inventory_id", "bin_location", "quantity_on_hand", "quantity_reserved", "minimum_stock_level")
    req = requests.withColumn("_blank", F.trim(F.coalesce(F.col("warehouse"), F.lit(""))) == "")
    cond = (req.part_id == loc._pid) & (req.warehouse == loc._wh) & ~req._blank
    return (req.join(loc, cond, "left")
               .withColumn("found", F.col("inventory_id").isNotNull())
               .drop("_pid", "_wh", "_blank"))


def inventory_by_warehouse(inv: DataFrame, warehouse: str | None) -> DataFrame:
    """active rows of one warehouse; a blank name returns every row, inactive too."""
    if warehouse is None or warehouse.strip() == "":
        return inv
    return inv.where((F.col("warehouse") == warehouse) & F.col("is_active"))


def low_stock(inv: DataFrame) -> DataFrame:
    """F16: active rows with available <= minimum."""
    return inv.where(F.col("is_active") & is_low())


def out_of_stock(inv: DataFrame) -> DataFrame:
    """active rows with nothing available."""
    return inv.where(F.col("is_active") & is_out())


# -- joins -----------------------------------------------------------------

def low_stock_alerts(inv: DataFrame, parts: DataFrame) -> DataFrame:
    """Low-stock rows with catalog data; rows whose part is missing are dropped (inner join)."""
    cat = parts.select("part_id", "part_number", "part_name", "unit_cost", "lead_time_days")
    return (low_stock(inv).join(cat, "part_id")
            .select("inventory_id", "part_id", "part_number", "part_name", "warehouse",
                    available().alias("current_quantity"), "minimum_stock_level",
                    reorder_suggestion().alias("reorder_quantity"), "unit_cost", "lead_time_days"))


def check_availability(requests: DataFrame, inv: DataFrame) -> DataFrame:
    """Is the requested quantity available at that location? Unknown location -> false."""
    hit = inventory_at(inv, requests)
    return hit.withColumn("is_available",
                          F.coalesce((F.col("quantity_on_hand") - F.col("quantity_reserved")) >= F.col("quantity"),
                                     F.lit(False)))


def discontinued_stock(parts: DataFrame, inv: DataFrame) -> DataFrame:
    """Discontinued parts that still have stock on hand, per location."""
    disc = parts.where(F.col("is_discontinued")).select("part_id", "part_number", "part_name")
    return (inv.where(F.col("quantity_on_hand") > 0).join(disc, "part_id")
               .select("inventory_id", "part_id", "part_number", "part_name", "warehouse",
                       "quantity_on_hand", "quantity_reserved", available().alias("available_quantity")))


def part_totals(parts: DataFrame, inv: DataFrame) -> DataFrame:
    """A1: on hand / reserved / available per part over active rows; 0 for parts without any.

    Aggregate first (partial + final hash aggregate), then a left join on the
    part key, so the join sees one row per part.
    """
    tot = (inv.where(F.col("is_active")).groupBy("part_id")
              .agg(F.sum("quantity_on_hand").alias("total_on_hand"),
                   F.sum("quantity_reserved").alias("total_reserved"),
                   F.sum(available()).alias("total_available"),
                   F.count(F.lit(1)).alias("location_count")))
    out = parts.select("part_id", "part_number", "part_name").join(tot, "part_id", "left")
    return out.fillna(0, subset=["total_on_hand", "total_reserved", "total_available", "location_count"])


def part_with_inventory(parts: DataFrame, inv: DataFrame) -> DataFrame:
    """Each part with totals over its active locations and the nested location list.

    The list is sorted by warehouse; ``locations_text`` is a flat rendering of
    it for order-insensitive comparison.
    """
    loc = (inv.where(F.col("is_active"))
              .select("part_id", F.struct("warehouse", "bin_location", "quantity_on_hand", "quantity_reserved",
                                          available().alias("available_quantity"),
                                          is_low().alias("is_low_stock")).alias("loc")))
    agg = (loc.groupBy("part_id")
              .agg(F.sum("loc.quantity_on_hand").alias("total_on_hand"),
                   F.sum("loc.quantity_reserved").alias("total_reserved"),
                   F.sum("loc.available_quantity").alias("total_available"),
                   F.array_sort(F.collect_list("loc")).alias("locations")))
    out = parts.select("part_id", "part_number", "part_name", "unit_cost", "unit_price").join(agg, "part_id", "left")
    text = F.array_join(F.transform("locations", lambda l: F.concat_ws(
        ":", l.warehouse, l.bin_location, l.quantity_on_hand.cast("string"),
        l.quantity_reserved.cast("string"))), "|")
    return (out.withColumns({
        "total_on_hand": F.coalesce("total_on_hand", F.lit(0).cast("bigint")),
        "total_reserved": F.coalesce("total_reserved", F.lit(0).cast("bigint")),
        "total_available": F.coalesce("total_available", F.lit(0).cast("bigint")),
        "location_count": F.when(F.col("locations").isNull(), F.lit(0)).otherwise(F.size("locations")),
        "locations_text": F.coalesce(text, F.lit("")),
    }))


def inventory_with_tx(inv: DataFrame, tx: DataFrame) -> DataFrame:
    """Each location with its ledger rows, as flat rows (a location without rows appears once).

    The ledger is not collected into a per-location list: one location may
    hold a large share of all ledger rows, so rows stay flat and the per-location
    count comes from a partial/final aggregate joined back on the key.
    """
    counts = tx.groupBy("inventory_id").agg(F.count(F.lit(1)).alias("transaction_count"))
    rows = tx.select("inventory_id", "transaction_id", "transaction_type",
                     F.col("quantity").alias("transaction_quantity"), "transaction_date")
    out = inv.join(counts, "inventory_id", "left").join(rows, "inventory_id", "left")
    return out.withColumn("transaction_count", F.coalesce("transaction_count", F.lit(0).cast("bigint")))


# -- aggregates --------------------------------------------------------------

def warehouse_summary(inv: DataFrame, parts: DataFrame, active_only: bool = False) -> DataFrame:
    """A2 / A3: per warehouse counts, sums, low / out counts and stock value.

    The all-warehouse report groups every row, inactive included; the
    one-warehouse entry point only sees active rows (``active_only=True``).
    Value = sum(on hand x unit cost) with a left join: a missing part adds 0.
    The catalog side is projected to (part_id, unit_cost) before the join.
    """
    rows = inv.where(F.col("is_active")) if active_only else inv
    cost = parts.select("part_id", "unit_cost")
    j = rows.join(cost, "part_id", "left")
    value = F.coalesce(F.col("quantity_on_hand") * F.col("unit_cost"), F.lit(0))
    return (j.groupBy("warehouse")
             .agg(F.count(F.lit(1)).alias("total_parts"),
                  F.sum("quantity_on_hand").alias("total_quantity_on_hand"),
                  F.sum("quantity_reserved").alias("total_quantity_reserved"),
                  F.sum(available()).alias("total_available"),
                  F.count_if(is_low()).alias("low_stock_count"),
                  F.count_if(is_out()).alias("out_of_stock_count"),
                  F.sum(value).cast(DEC28).alias("total_inventory_value")))


def reorder_spend(alerts: DataFrame) -> DataFrame:
    """Sum of reorder quantity x unit cost per warehouse, from the alert rows."""
    return (alerts.groupBy("warehouse")
                  .agg(F.count(F.lit(1)).alias("alert_count"),
                       F.sum("reorder_quantity").alias("total_reorder_quantity"),
                       F.sum(F.col("reorder_quantity") * F.col("unit_cost")).cast(DEC28).alias("reorder_cost")))


# -- ledger-based aggregates ---------------------------------------------------

def ledger_position(tx: DataFrame) -> DataFrame:
    """On hand and reserved implied by the ledger signs, per location.

    on_hand = Receipt + Issue + Adjustment; reserved = Reservation + Release + Issue.
    """
    t, q = F.col("transaction_type"), F.col("quantity")
    return (tx.groupBy("inventory_id")
              .agg(F.sum(F.when(t.isin("Receipt", "Issue", "Adjustment"), q).otherwise(0)).alias("ledger_on_hand"),
                   F.sum(F.when(t.isin("Reservation", "Release", "Issue"), q).otherwise(0)).alias("ledger_reserved"),
                   F.count(F.lit(1)).alias("ledger_rows")))


def reconcile(inv: DataFrame, tx: DataFrame) -> DataFrame:
    """Ledger-derived position against the snapshot (full outer join), with differences."""
    led = ledger_position(tx)
    snap = inv.select("inventory_id", "quantity_on_hand", "quantity_reserved")
    j = snap.join(led, "inventory_id", "full")
    return j.select(
        "inventory_id",
        F.coalesce("quantity_on_hand", F.lit(0)).alias("snapshot_on_hand"),
        F.coalesce("quantity_reserved", F.lit(0)).alias("snapshot_reserved"),
        F.coalesce("ledger_on_hand", F.lit(0).cast("bigint")).alias("ledger_on_hand"),
        F.coalesce("ledger_reserved", F.lit(0).cast("bigint")).alias("ledger_reserved"),
        (F.coalesce("quantity_on_hand", F.lit(0)) - F.coalesce("ledger_on_hand", F.lit(0))).alias("on_hand_difference"),
        (F.coalesce("quantity_reserved", F.lit(0)) - F.coalesce("ledger_reserved", F.lit(0))).alias("reserved_difference"),
        F.col("quantity_on_hand").isNull().alias("missing_snapshot"),
        F.col("ledger_rows").isNull().alias("missing_ledger"),
    )


def wo_usage(tx: DataFrame, inv: DataFrame) -> DataFrame:
    """Reserved / issued / released units per (work order, part) from the ledger.

    Ledger signs are undone so each figure is a positive unit count.
    """
    loc = inv.select("inventory_id", "part_id")
    t, q = F.col("transaction_type"), F.col("quantity")
    return (tx.where(F.col("work_order_id").isNotNull())
              .join(loc, "inventory_id")
              .groupBy("work_order_id", "part_id")
              .agg(F.sum(F.when(t == "Reservation", q).otherwise(0)).alias("reserved_units"),
                   F.sum(F.when(t == "Issue", -q).otherwise(0)).alias("issued_units"),
                   F.sum(F.when(t == "Release", -q).otherwise(0)).alias("released_units")))


def wo_parts_cost(tx: DataFrame, inv: DataFrame, parts: DataFrame) -> DataFrame:
    """Issued units x unit cost per work order (decimal arithmetic, currency ignored)."""
    usage = wo_usage(tx, inv).where(F.col("issued_units") != 0)
    cost = parts.select("part_id", "unit_cost")
    return (usage.join(cost, "part_id")
                 .groupBy("work_order_id")
                 .agg(F.sum("issued_units").alias("issued_units"),
                      F.sum(F.col("issued_units") * F.col("unit_cost")).cast(DEC28).alias("parts_cost")))
