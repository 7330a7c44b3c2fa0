"""The domain tables (parts, inventory, ledger, work orders, ...) derived from the raw tables.

Each table is a lazy DataFrame built with the DataFrame API; the derivation
rules are those of FIXTURES.md (the oracle runs the same rules as one SQL
``WITH`` list, see ``stockflow.plans.fixture_sql``).

Scale notes: lineitem-sized tables (stock_moves, inventory_transactions,
work_order_parts) are never broadcast. Nation / region are fixed-size
dimensions (25 / 5 rows) and are broadcast. Supplier grows with the data, so
its join is left to AQE, which broadcasts it only when runtime stats say it is
small. The supplier count used by two id rules is a scalar subquery.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.sources.tables import scan

DEC18 = "decimal(18,2)"


def _lpad_num(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


class Domain:
    """Domain tables of one data directory. Every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return scan(self.spark, self.sf_dir, name)

    # -- helpers -------------------------------------------------------------
    @cached_property
    def _supplier_count_col(self) -> Column:
        # one subquery expression shared by every rule that needs it (so Spark can reuse its result)
        return self.raw("supplier").select(F.count(F.lit(1))).scalar()

    def _supplier_count(self) -> Column:
        return self._supplier_count_col

    # -- catalog -------------------------------------------------------------
    @cached_property
    def parts(self) -> DataFrame:
        p = self.raw("part")
        size, key = F.col("p_size"), F.col("p_partkey")
        return p.select(
            key.alias("part_id"),
            F.concat(F.lit("P-"), _lpad_num(key, 8)).alias("part_number"),
            F.col("p_name").alias("part_name"),
            F.when(size % 13 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat("p_brand", F.lit(" "), "p_type", F.lit(" "), "p_name")).alias("description"),
            F.col("p_type").alias("category"),
            (F.col("p_retailprice").cast(DEC18) * (60 + size % 60).cast("decimal(9,0)")
             * F.lit(0.01).cast("decimal(3,2)")).cast(DEC18).alias("unit_cost"),
            F.lit("USD").alias("unit_cost_currency"),
            F.when(key % 101 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")).cast(DEC18).alias("unit_price"),
            F.when(key % 97 == 1, F.lit("EUR")).otherwise(F.lit("USD")).alias("unit_price_currency"),
            F.when(size % 11 == 0, F.lit(None).cast("bigint"))
             .otherwise(key % self._supplier_count()).alias("supplier_id"),
            size.alias("lead_time_days"),
            (size % 20).cast("int").alias("default_minimum_stock_level"),
            (size % 20 + 50).cast("int").alias("default_maximum_stock_level"),
            (size % 10 == 0).alias("is_discontinued"),
            ((size % 10 != 0) & (size % 7 != 0)).alias("is_active"),
        )

    # -- stock ---------------------------------------------------------------
    @cached_property
    def stock_moves(self) -> DataFrame:
        li = self.raw("lineitem")
        sup = self.raw("supplier").select("s_suppkey", "s_nationkey")
        nat = F.broadcast(self.raw("nation").select("n_nationkey", "n_regionkey"))
        return (li.join(sup, li.l_suppkey == sup.s_suppkey)
                  .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
                  .select(F.col("l_partkey").alias("part_id"), F.col("n_regionkey").alias("region_id"),
                          "l_orderkey", "l_linenumber", "l_suppkey",
                          F.col("l_quantity").cast("int").alias("q"),
                          F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
                          "l_shipdate"))

    @cached_property
    def inventory(self) -> DataFrame:
        m = self.stock_moves
        region = F.broadcast(self.raw("region"))
        received = F.sum(F.when(F.col("rf") == "N", F.col("q") * 3).otherwise(0))
        allocated = F.sum(F.when(F.col("rf") == "A", F.col("q")).otherwise(0))
        pid = F.col("part_id")
        agg = (m.groupBy("part_id", "region_id")
                .agg(received.cast("int").alias("quantity_on_hand"),
                     F.least(received, allocated).cast("int").alias("quantity_reserved"),
                     F.min(pid % 20).cast("int").alias("minimum_stock_level")))
        return (agg.join(region, agg.region_id == region.r_regionkey)
                   .select((pid * 10 + F.col("region_id")).alias("inventory_id"),
                           pid,
                           F.col("r_name").alias("warehouse"),
                           F.concat(F.lit("B-"), _lpad_num(pid % 40, 2), F.lit("-"),
                                    (pid % 7).cast("string")).alias("bin_location"),
                           "quantity_on_hand", "quantity_reserved", "minimum_stock_level",
                           (F.col("minimum_stock_level") + 50).cast("int").alias("maximum_stock_level"),
                           F.lit(50).alias("reorder_quantity"),
                           ((pid + F.col("region_id")) % 17 != 0).alias("is_active")))

    @cached_property
    def inventory_transactions(self) -> DataFrame:
        m = self.stock_moves
        rf, ls, q = F.col("rf"), F.col("ls"), F.col("q")
        ttype = (F.when(rf == "N", "Receipt").when((rf == "A") & (ls == "F"), "Reservation")
                  .when(rf == "A", "Issue").when(ls == "F", "Release").otherwise("Adjustment"))
        qty = (F.when(rf == "N", q * 2).when((rf == "A") & (ls == "F"), q).when(rf == "A", -q)
                .when(ls == "F", -q)
                .otherwise(F.when(F.col("l_linenumber") % 2 == 0, q).otherwise(-q)))
        return m.select(
            F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
                     F.lit("-"), F.col("part_id").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"),
                     F.lit("-"), F.col("l_shipdate").cast("date").cast("string")).alias("transaction_id"),
            (F.col("part_id") * 10 + F.col("region_id")).alias("inventory_id"),
            ttype.alias("transaction_type"),
            qty.alias("quantity"),
            F.when(rf == "N", F.lit(None).cast("bigint")).otherwise(F.col("l_orderkey")).alias("work_order_id"),
            F.col("l_shipdate").alias("transaction_date"),
        )

    # -- people --------------------------------------------------------------
    @cached_property
    def technicians(self) -> DataFrame:
        s = self.raw("supplier")
        k, n = F.col("s_suppkey"), F.col("s_nationkey")
        return s.select(
            k.alias("technician_id"),
            F.concat(F.lit("Tech"), k.cast("string")).alias("first_name"),
            F.concat(F.lit("L"), n.cast("string")).alias("last_name"),
            (1 + n % 4).cast("int").alias("skill_level"),
            (k % 5).cast("int").alias("status"),
            (2 + n % 4).cast("int").alias("max_concurrent_jobs"),
            ((F.col("s_acctbal") > 0) & (k % 5 != 4)).alias("is_active"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        c = self.raw("customer")
        nat = F.broadcast(self.raw("nation").select("n_nationkey", "n_name"))
        k = F.col("c_custkey")
        ks = k.cast("string")
        addr = (F.when(k % 9 == 0, F.lit(" "))
                 .when(k % 9 == 1, F.concat(ks, F.lit(" Main St")))
                 .when(k % 9 == 2, F.concat(ks, F.lit(" Main St, "), F.col("n_name"), F.lit(", tx, 7500")))
                 .otherwise(F.concat(ks, F.lit(" Main St , "), F.col("n_name"), F.lit(", tx, "),
                                     _lpad_num(10000 + k, 5))))
        return (c.join(nat, c.c_nationkey == nat.n_nationkey)
                 .select(k.alias("customer_id"), F.col("c_name").alias("company_name"),
                         F.col("c_mktsegment").alias("segment"),
                         (k % 3 != 0).alias("prefer_email"), (k % 4 != 0).alias("prefer_sms"),
                         addr.alias("address")))

    # -- work orders ---------------------------------------------------------
    @cached_property
    def work_orders(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        prio = F.substring("o_orderpriority", 1, 1)
        start = F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")
        return o.select(
            k.alias("work_order_id"),
            F.concat(F.lit("WO-"), F.year("o_orderdate").cast("string"), F.lit("-"),
                     _lpad_num(10000 + k % 89999, 5)).alias("work_order_number"),
            F.col("o_custkey").alias("customer_id"),
            F.concat(F.lit("VIN"), _lpad_num(F.col("o_custkey"), 8), _lpad_num(k % 50, 6)).alias("vin"),
            F.when(k % 3 == 0, "Excavator").when(k % 3 == 1, "Bulldozer").otherwise("Crane").alias("equipment_type"),
            F.when(prio == "1", 4).when(prio == "2", 3).when(prio == "3", 2).otherwise(1).cast("int").alias("priority"),
            F.when(k % 11 == 0, F.lit(5)).when(F.col("o_orderstatus") == "F", F.lit(4))
             .when(F.col("o_orderstatus") == "P", 2 + k % 2).otherwise(k % 2).cast("int").alias("status"),
            F.when((F.col("o_orderstatus") == "O") & (k % 2 == 0), F.lit(None).cast("bigint"))
             .otherwise(k % self._supplier_count()).alias("technician_id"),
            F.col("o_orderdate").alias("created_at"),
            F.when(k % 5 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(start).alias("scheduled_start"),
            F.when(k % 5 == 0, F.lit(None).cast("timestamp_ntz"))
             .otherwise(start + F.make_dt_interval(hours=(8 + k % 90).cast("int"))).alias("scheduled_end"),
            (k % 40).cast("decimal(8,2)").alias("estimated_labor_hours"),
            F.col("o_totalprice").cast(DEC18).alias("estimated_cost"),
            (F.col("o_totalprice").cast(DEC18) * (80 + k % 50).cast("decimal(9,0)")
             * F.lit(0.01).cast("decimal(3,2)")).cast(DEC18).alias("actual_cost"),
        )

    @cached_property
    def dispatch_orders(self) -> DataFrame:
        """Orders as a dispatcher finds them: a few in a hundred are held by technicians, so technicians have room."""
        held = F.when((F.col("status") < 4) & (F.col("work_order_id") % 100 < 4), F.col("technician_id"))
        return self.work_orders.withColumn("technician_id", held)

    @cached_property
    def work_order_parts(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(F.col("l_orderkey").alias("work_order_id"), F.col("l_partkey").alias("part_id"),
                         F.col("l_linenumber").alias("line_no"),
                         F.col("l_quantity").cast("int").alias("quantity_required"),
                         (F.col("l_linestatus") == "F").alias("is_available"))

    # -- command tables ------------------------------------------------------
    @cached_property
    def status_requests(self) -> DataFrame:
        e = self.raw("events")
        et = F.col("event_type")
        new = (F.when(et == "signup", 1).when(et == "view", 2).when(et == "error", 3).when(et == "purchase", 4)
                .otherwise(F.when(F.col("event_id") % 10 == 0, 5).otherwise(2)))
        return e.select("event_id", F.col("user_id").alias("work_order_id"), "ts",
                        new.cast("int").alias("new_status"))

    @cached_property
    def part_commands(self) -> DataFrame:
        e = self.raw("events")
        et, eid = F.col("event_type"), F.col("event_id")
        cost = F.col("value").cast(DEC18)
        return e.select(
            eid.alias("seq"), "ts", F.col("user_id").alias("part_id"),
            F.when(et == "purchase", "price").when(et == "error", "discontinue").when(et == "signup", "reactivate")
             .when(et == "view", "defaults").otherwise("supplier").alias("command"),
            F.when(et == "purchase", cost).alias("new_cost"),
            F.when(et == "purchase", (cost * F.lit(1.25).cast("decimal(3,2)")).cast(DEC18)).alias("new_price"),
            F.when(et == "view", (eid % 30).cast("int")).alias("new_min"),
            F.when(et == "view", (eid % 60).cast("int")).alias("new_max"),
            F.when(et == "click", (eid % 25).cast("int") - 2).alias("new_lead_time"),
        )

    @cached_property
    def reservation_requests(self) -> DataFrame:
        w = self.work_orders.where(F.col("status").isin(0, 1, 2)).select("work_order_id", "created_at")
        p = self.work_order_parts
        return (p.join(w, "work_order_id")
                 .select("work_order_id", "line_no", "part_id",
                         F.col("quantity_required").alias("quantity"), "created_at"))

    @cached_property
    def assignment_requests(self) -> DataFrame:
        w = self.work_orders.where(F.col("status") == 0)
        return w.select("work_order_id",
                        ((F.col("work_order_id") * 7) % self._supplier_count()).alias("technician_id"),
                        F.col("created_at").alias("requested_at"))

    @cached_property
    def work_order_notifications(self) -> DataFrame:
        """One synthesised notification attempt per order, typed by its status (fixture gap, FIXTURES.md)."""
        w = self.work_orders
        k, st = F.col("work_order_id"), F.col("status")
        return w.select(
            k.alias("notification_id"), k.alias("work_order_id"),
            F.when(st == 0, "Created").when(st == 1, "Assigned").otherwise("StatusChanged").alias("notification_type"),
            F.concat(F.lit("Work order "), F.col("work_order_number"), F.lit(" status "), st.cast("string"))
             .alias("subject"),
            F.col("created_at").alias("sent_at"),
            (k % 10 != 0).alias("success"),
            F.when(k % 10 == 0, F.lit("delivery failed")).alias("error_message"))

    TABLES = ("parts", "inventory", "inventory_transactions", "technicians", "work_orders",
              "dispatch_orders", "work_order_parts", "customers", "status_requests", "part_commands",
              "reservation_requests", "assignment_requests", "work_order_notifications")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


_CACHE: dict[tuple[int, str], Domain] = {}


def domain(spark: SparkSession, sf_dir: str) -> Domain:
    """One Domain per (session, dir); DataFrames are lazy so sharing is cheap."""
    key = (id(spark), sf_dir)
    d = _CACHE.get(key)
    # an id can be reused by a new session after the old one is gone: check identity
    if d is None or d.spark is not spark:
        d = _CACHE[key] = Domain(spark, sf_dir)
    return d
