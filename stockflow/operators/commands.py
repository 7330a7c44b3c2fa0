"""Command tables applied to snapshots: parts (W7-W9), work-order status (W12, W13),
assignments (W14, W15), people (W16), work-order changes (W17), completion (W18)
and the notification recipients of status changes (J16).

Where a command's guard depends only on its own values (part commands), the
new snapshot is "last accepted write per column wins": a ``max_by`` partial
aggregate per key. Where the guard depends on state (status transitions,
technician capacity) the sorted streaming fold of ``fold.py`` is used.

Fixed values of the source application:
  allowed status moves: Pending->Assigned, Assigned->InProgress, InProgress->OnHold,
  InProgress->Completed, OnHold->InProgress, any->Cancelled (all other moves and self-moves rejected)
  status e-mail: subject "Work Order {id} Status Update", body "Your work order status changed to {status}"
  completion SMS: "Your equipment is ready! Work order #{id} completed."
  reassignment note: "[yyyy-MM-dd HH:mm] Reassigned from technician {old} to {new}. Reason: {reason}"
  price alert threshold: cost moved by more than 10 %
  invoice due: 30 days after completion
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.functions.enums import ASSIGNED, AVAILABLE, BUSY, CANCELLED, COMPLETED, INACTIVE, IN_PROGRESS, \
    ON_HOLD, ON_LEAVE, PENDING, decode_enum
from stockflow.functions.scalars import ntz_micros
from stockflow.operators.automaton import CHUNK_ROWS, time_chunks, walk
from stockflow.operators.fold import sorted_fold
from stockflow.session import ensure_checkpoint_dir

DEC18 = "decimal(18,2)"


# -- W7 part commands -------------------------------------------------------------------

PART_COLUMNS = (("new_number", "string"), ("new_name", "string"), ("new_description", "string"), ("new_category", "string"),
                ("new_supplier_id", "bigint"), ("new_supplier_number", "string"), ("new_reorder", "int"))


def part_command_reasons(cmds: DataFrame, parts: DataFrame) -> DataFrame:
    """Each part command with its rejection reason (NULL when accepted).

    Guards need no state but one: a part outside the snapshot lives from its first valid ``create`` on (an as-of
    guard against the least sequence number of those, one partial aggregate), so a command before it finds no part and
    a later create finds one. Commands without the columns of ``create``, ``info`` and the supplier number may leave
    them out; a ``defaults`` command is only asked for a reorder quantity where the table has the column.
    """
    c, seq = F.col("command"), F.col("seq")
    full = "new_name" in cmds.columns
    for name, kind in PART_COLUMNS:
        if name not in cmds.columns:
            cmds = cmds.withColumn(name, F.lit(None).cast(kind))
    known = parts.select("part_id", F.lit(True).alias("_known"))
    j = cmds.join(known, "part_id", "left")

    def blank(name: str) -> Column:
        return F.coalesce(F.trim(name) == "", F.lit(True))
    money = (F.when(F.col("new_cost").isNull() | F.col("new_price").isNull(), F.lit("price_required"))
              .when((F.col("new_cost") < 0) | (F.col("new_price") < 0), F.lit("negative_amount")))
    valid = F.when(blank("new_number"), F.lit("part_number_required")).when(blank("new_name"), F.lit("part_name_required")).otherwise(money)
    alive = F.col("_known").isNotNull()
    if full:
        j = j.withColumn("_valid", F.when(c == "create", valid))
        births = (j.where((c == "create") & F.col("_known").isNull() & F.col("_valid").isNull()).groupBy("part_id")
                  .agg(F.min("seq").alias("_born")))
        j = j.join(births, "part_id", "left")
        alive = alive | F.coalesce(seq > F.col("_born"), F.lit(False))
        made = F.when(alive, F.lit("part_exists")).otherwise(F.col("_valid"))
    reorder = F.col("new_reorder")
    reason = F.when(~alive & ~F.coalesce(c == "create", F.lit(False)) if full else ~alive, F.lit("part_not_found"))
    if full:
        reason = reason.when(c == "create", made).when((c == "info") & blank("new_name"), F.lit("part_name_required"))
    reason = (reason
               .when((c == "price") & money.isNotNull(), money)
               .when((c == "defaults") & (F.col("new_min").isNull() | F.col("new_max").isNull() | (reorder.isNull() if full else F.lit(False))),
                     F.lit("levels_required"))
               .when((c == "defaults") & (F.col("new_min") < 0), F.lit("negative_minimum"))
               .when((c == "defaults") & (F.col("new_max") < F.col("new_min")), F.lit("maximum_below_minimum"))
               .when((c == "defaults") & (reorder < 0), F.lit("negative_reorder"))
               .when((c == "supplier") & (F.col("new_lead_time") < 0), F.lit("negative_lead_time"))
               .when(~F.coalesce(c.isin("price", "defaults", "supplier", "discontinue", "reactivate", *(["create", "info"] if full else [])), F.lit(False)),
                     F.lit("unknown_command")))
    return (j.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
             .drop("_known", "_valid", "_born"))


def apply_part_commands(parts: DataFrame, cmds: DataFrame) -> DataFrame:
    """New parts snapshot after the accepted commands (last accepted write per column wins).

    create -> a new part (number, name, description, category, cost, price; no supplier, levels 0, active); info -> name,
    description, category; price -> cost and price; defaults -> min, max and reorder quantity; supplier -> supplier id,
    supplier's number and lead time; discontinue -> discontinued and inactive; reactivate -> active, not discontinued.
    Snapshots without a supplier's number or a reorder quantity start with none and 0, as new parts do.
    """
    judged = part_command_reasons(cmds, parts)
    ok = F.col("accepted")
    c = F.col("command")
    seq = F.struct("seq")

    def last(cond: Column, value: Column) -> Column:
        # NULL when no accepted command touched the column (struct keeps an explicit NULL value)
        return F.max_by(F.when(ok & cond, F.struct(value.alias("v"))), F.when(ok & cond, seq))

    # one aggregate per part for the new values and the counts (commands are read once)
    info, priced = c.isin("create", "info"), c.isin("create", "price")
    supplier = "new_supplier_id" in cmds.columns
    upd = (judged.groupBy("part_id")
                 .agg(last(c == "create", F.col("new_number")).alias("_number"),
                      last(info, F.col("new_name")).alias("_name"), last(info, F.col("new_description")).alias("_desc"),
                      last(info, F.col("new_category")).alias("_cat"),
                      last(priced, F.col("new_cost")).alias("_cost"),
                      last(priced, F.col("new_price")).alias("_price"),
                      last(c == "defaults", F.col("new_min")).alias("_min"),
                      last(c == "defaults", F.col("new_max")).alias("_max"),
                      last(c == "defaults", F.col("new_reorder")).alias("_reorder"),
                      last(c == "supplier", F.col("new_supplier_id")).alias("_sid"),
                      last(c == "supplier", F.col("new_supplier_number")).alias("_snum"),
                      last(c == "supplier", F.col("new_lead_time")).alias("_lead"),
                      last(c.isin("discontinue", "reactivate"), c == "discontinue").alias("_disc"),
                      F.count_if(ok).alias("commands_applied"), F.count_if(~ok).alias("commands_rejected")))
    base = parts
    for name, value in (("supplier_part_number", F.lit("")), ("default_reorder_quantity", F.lit(0))):
        if name not in base.columns:
            base = base.withColumn(name, value)
    j = base.withColumn("_old", F.lit(True)).join(upd, "part_id", "full").where(F.col("_old") | F.col("_number").isNotNull())
    old = F.col("_old").isNotNull()

    def pick(new: str, name: str, start: Column | None = None) -> Column:
        value = F.col(name) if start is None else F.when(old, F.col(name)).otherwise(start)
        return F.when(F.col(new).isNotNull(), F.col(f"{new}.v")).otherwise(value)

    zero = F.lit(0)
    disc = F.col("_disc.v")
    return j.select(
        "part_id", pick("_number", "part_number").alias("part_number"), pick("_name", "part_name").alias("part_name"),
        pick("_desc", "description").alias("description"), pick("_cat", "category").alias("category"),
        pick("_cost", "unit_cost").cast(DEC18).alias("unit_cost"), F.coalesce("unit_cost_currency", F.lit("USD")).alias("unit_cost_currency"),
        pick("_price", "unit_price").cast(DEC18).alias("unit_price"), F.coalesce("unit_price_currency", F.lit("USD")).alias("unit_price_currency"),
        (pick("_sid", "supplier_id") if supplier else F.col("supplier_id")).cast("bigint").alias("supplier_id"),
        (pick("_snum", "supplier_part_number", F.lit("")) if supplier else F.col("supplier_part_number")).alias("supplier_part_number"),
        pick("_lead", "lead_time_days", zero).cast("int").alias("lead_time_days"),
        pick("_min", "default_minimum_stock_level", zero).cast("int").alias("default_minimum_stock_level"),
        pick("_max", "default_maximum_stock_level", zero).cast("int").alias("default_maximum_stock_level"),
        F.coalesce(pick("_reorder", "default_reorder_quantity", zero), F.lit(0)).cast("int").alias("default_reorder_quantity"),
        F.when(F.col("_disc").isNotNull(), disc).when(old, F.col("is_discontinued")).otherwise(F.lit(False)).alias("is_discontinued"),
        F.when(F.col("_disc").isNotNull(), ~disc).when(old, F.col("is_active")).otherwise(F.lit(True)).alias("is_active"),
        F.coalesce("commands_applied", F.lit(0).cast("bigint")).alias("commands_applied"),
        F.coalesce("commands_rejected", F.lit(0).cast("bigint")).alias("commands_rejected"))


def price_changes(cmds: DataFrame, parts: DataFrame, seq_chunk: int = 1_000_000) -> DataFrame:
    """Each accepted price command with old / new cost and price.

    Old values come from the previous accepted price command of the part, or
    from the snapshot for the first one. A part's price history is split into
    chunks of ``seq_chunk`` consecutive sequence numbers: ``lag`` runs inside
    (part, chunk), and a chunk's first command takes the last values of the
    part's earlier chunks from a small parts x chunks table, so a very active
    part is not one window partition (exact: chunks follow the seq order).
    """
    acc = (part_command_reasons(cmds, parts).where(F.col("accepted") & (F.col("command") == "price"))
           .withColumn("_chunk", F.floor(F.col("seq") / F.lit(seq_chunk))))
    w = Window.partitionBy("part_id", "_chunk").orderBy("seq")
    inner = acc.withColumns({"_pc": F.lag("new_cost").over(w), "_pp": F.lag("new_price").over(w)})
    last = (acc.groupBy("part_id", "_chunk")
               .agg(F.max_by(F.struct("new_cost", "new_price"), "seq").alias("_last")))
    prev = Window.partitionBy("part_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("part_id", "_chunk", F.last("_last", ignorenulls=True).over(prev).alias("_prev"))
    snap = parts.select("part_id", F.col("unit_cost").alias("_c0"), F.col("unit_price").alias("_p0"))
    return (inner.join(carry, ["part_id", "_chunk"]).join(snap, "part_id")
                 .select("part_id", "seq", "ts",
                         F.coalesce("_pc", F.col("_prev.new_cost"), "_c0").alias("old_cost"), "new_cost",
                         F.coalesce("_pp", F.col("_prev.new_price"), "_p0").alias("old_price"), "new_price"))


def price_moved(pct: str = "0.10") -> Column:
    """Cost moved by more than ``pct`` of the old cost, compared in decimals (an exact 10 % move is no alert)."""
    old, new = F.col("old_cost"), F.col("new_cost")
    return F.when(old == 0, new != 0).otherwise(F.abs(new - old) > F.abs(old) * F.lit(pct).cast("decimal(9,6)"))


def price_alerts(changes: DataFrame, pct: str = "0.10") -> DataFrame:
    """Cost moved by more than ``pct``. An old cost of 0 gives no ratio; any new non-zero cost alerts."""
    old, new = F.col("old_cost"), F.col("new_cost")
    ratio = F.when(old != 0, F.abs(new - old).cast("double") / old.cast("double"))
    return changes.withColumn("cost_change_ratio", ratio).where(price_moved(pct))


# -- W12 / W13 status transitions ------------------------------------------------------------

ALLOWED = ((PENDING, ASSIGNED), (ASSIGNED, IN_PROGRESS), (IN_PROGRESS, ON_HOLD), (IN_PROGRESS, COMPLETED),
           (ON_HOLD, IN_PROGRESS))


def valid_move(frm: Column, to: Column) -> Column:
    """Column form of the transition table (for joins / checks outside the fold)."""
    cond = to == CANCELLED
    for a, b in ALLOWED:
        cond = cond | ((frm == a) & (to == b))
    return cond


def apply_transitions(requests: DataFrame, wo: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Requested status changes per order in (ts, event_id) order -> accepted / rejected.

    Requests: ``event_id, work_order_id, ts, new_status``. The opening status is the order's current status; an
    unknown order rejects every request. A request is a map of the six states, so the walk composes maps
    (``automaton.walk``): SQL only, and an order with more than ``chunk_rows`` requests is split by time.
    """
    opening = wo.select("work_order_id", F.col("status").alias("_opening"))
    to = F.col("new_status")
    rows = requests.select("event_id", "work_order_id", "ts", "new_status")

    def step(state: Column, new: Column) -> Column:
        return F.when(valid_move(state, new), new).otherwise(state)
    chunk = time_chunks(rows, "work_order_id", "ts", chunk_rows)
    walked = walk(rows.join(opening, "work_order_id", "left"), "work_order_id", ["ts", "event_id"], "new_status", F.col("_opening"),
                  6, step, chunk)
    before = F.col("state_before")
    reason = (F.when(before.isNull(), F.lit("work_order_not_found"))
               .when(to.isNull() | ~to.between(0, 5), F.lit("invalid_status"))
               .when(~valid_move(before, to), F.lit("invalid_transition")))
    return walked.select("event_id", "work_order_id", "ts", "new_status", reason.isNull().alias("accepted"), reason.alias("reason"),
                         before.cast("int").alias("status_before"), F.col("state_after").cast("int").alias("status_after"))


def final_status(transitions: DataFrame, wo: DataFrame) -> DataFrame:
    """Status of every order after the batch (unchanged when no request was accepted)."""
    last = (transitions.where("accepted").groupBy("work_order_id")
                       .agg(F.max_by("status_after", F.struct("ts", "event_id")).alias("_new")))
    return (wo.join(last, "work_order_id", "left")
              .withColumn("status", F.coalesce("_new", "status")).drop("_new"))


def actual_periods(transitions: DataFrame) -> DataFrame:
    """Actual start = last accepted entry to InProgress; end = accepted Completed time, else open.

    Completed is only reachable from InProgress, so a completion always
    follows the last start. Orders never started in the batch get no period.
    """
    acc = transitions.where("accepted")
    return (acc.groupBy("work_order_id")
               .agg(F.max(F.when(F.col("new_status") == IN_PROGRESS, F.col("ts"))).alias("actual_start"),
                    F.max(F.when(F.col("new_status") == COMPLETED, F.col("ts"))).alias("_done"))
               .where(F.col("actual_start").isNotNull())
               .select("work_order_id", "actual_start",
                       F.when(F.col("_done") >= F.col("actual_start"), F.col("_done")).alias("actual_end"),
                       (F.col("_done").isNull() | (F.col("_done") < F.col("actual_start"))).alias("is_open_ended")))


# -- J16 recipients ----------------------------------------------------------------------------

def recipients(changes: DataFrame, wo: DataFrame, cust: DataFrame) -> DataFrame:
    """Accepted status changes -> e-mail row (customer prefers e-mail) and SMS row
    (customer prefers SMS *and* the new status is Completed)."""
    acc = changes.where("accepted").select("event_id", "work_order_id", "ts", "new_status")
    w = wo.select("work_order_id", "customer_id")
    c = cust.select("customer_id", "prefer_email", "prefer_sms")
    j = acc.join(w, "work_order_id").join(c, "customer_id")
    wid = F.col("work_order_id").cast("string")
    email = F.struct(F.lit("email").alias("channel"),
                     F.concat(F.lit("Work Order "), wid, F.lit(" Status Update")).alias("subject"),
                     F.concat(F.lit("Your work order status changed to "),
                              decode_enum("new_status", "status")).alias("message"))
    sms = F.struct(F.lit("sms").alias("channel"), F.lit(None).cast("string").alias("subject"),
                   F.concat(F.lit("Your equipment is ready! Work order #"), wid, F.lit(" completed.")).alias("message"))
    opts = F.array(F.when(F.col("prefer_email"), email),
                   F.when(F.col("prefer_sms") & (F.col("new_status") == COMPLETED), sms))
    return (j.select("event_id", "work_order_id", "customer_id", "ts", "new_status",
                     F.explode(F.filter(opts, lambda x: x.isNotNull())).alias("r"))
             .select("event_id", "work_order_id", "customer_id", "ts", "new_status", "r.*"))


# -- W14 / W15 assignments --------------------------------------------------------------------------

ASSIGN_SCHEMA = T.StructType([
    T.StructField("work_order_id", T.LongType()),
    T.StructField("technician_id", T.LongType()),
    T.StructField("requested_at", T.TimestampNTZType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("jobs_before", T.LongType()),
    T.StructField("jobs_after", T.LongType()),
    T.StructField("technician_status_after", T.IntegerType()),
])


def _assign_kernel(pdf: pd.DataFrame, carry: dict) -> pd.DataFrame:
    keys = pdf["technician_id"].to_numpy()
    known = pdf["_tech_known"].to_numpy(dtype="float64", na_value=0.0)
    active = pdf["_tech_active"].to_numpy(dtype="float64", na_value=0.0)
    status0 = pdf["_tech_status"].to_numpy(dtype="float64", na_value=np.nan)
    maxj = pdf["_tech_max"].to_numpy(dtype="float64", na_value=0.0)
    jobs0 = pdf["_jobs"].to_numpy(dtype="float64", na_value=0.0)
    wo_ok = pdf["_wo_known"].to_numpy(dtype="float64", na_value=0.0)
    dup = pdf["_duplicate"].to_numpy(dtype="float64", na_value=0.0)
    same = pdf["_already_here"].to_numpy(dtype="float64", na_value=0.0)
    n = len(pdf)
    reason = np.empty(n, dtype=object)
    jb, ja = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    sa = np.full(n, np.nan)
    cur, jobs, st = carry.get("key"), carry.get("jobs", 0), carry.get("st")
    for i in range(n):
        if keys[i] != cur:
            cur, jobs = keys[i], int(jobs0[i])
            st = None if np.isnan(status0[i]) else int(status0[i])
        jb[i] = jobs
        if dup[i]:
            reason[i] = "duplicate_request"
        elif not wo_ok[i]:
            reason[i] = "work_order_not_found"
        elif not known[i]:
            reason[i] = "technician_not_found"
        elif not active[i]:
            reason[i] = "technician_inactive"
        elif st == ON_LEAVE or jobs >= maxj[i]:
            reason[i] = "technician_at_capacity"
        else:
            # the capacity mark counts the accepted order on top, whether or not it takes a new slot
            if st == AVAILABLE and jobs + 1 >= maxj[i]:
                st = BUSY
            if not same[i]:
                jobs += 1
        ja[i] = jobs
        sa[i] = np.nan if st is None else st
    carry.update(key=cur, jobs=jobs, st=st)
    out = pdf[["work_order_id", "technician_id", "requested_at"]].copy()
    out["accepted"] = pd.isna(reason)
    out["reason"] = reason
    out["jobs_before"], out["jobs_after"] = jb, ja
    out["technician_status_after"] = pd.Series(sa).astype("Int32").values
    return out


def apply_assignments(requests: DataFrame, wo: DataFrame, tech: DataFrame) -> DataFrame:
    """Assignment requests per technician in (requested_at, order) order.

    Capacity at batch start is the technician's open-order count (A4); an order
    that is closed, or already with the technician, takes no new slot; slots
    freed inside the batch count from the next batch. An order requested
    more than once keeps its first request (the rest are rejected). Accepting
    marks the technician Busy when it was Available and one more job would
    not fit. Output adds the order's status after (Pending -> Assigned).
    """
    from stockflow.operators.workorders import active_jobs
    firsts = (requests.groupBy("work_order_id")
                      .agg(F.min_by(F.struct("technician_id", "requested_at"),
                                    F.struct("requested_at", "technician_id")).alias("_f")))
    r = (requests.join(firsts, "work_order_id", "left")
                 .withColumn("_duplicate", ~((F.col("_f.technician_id") == F.col("technician_id"))
                                             & (F.col("_f.requested_at") == F.col("requested_at"))))
                 .drop("_f"))
    # exact duplicate rows: only one of them may pass
    dup_rank = F.row_number().over(
        Window.partitionBy("work_order_id", "technician_id", "requested_at").orderBy("requested_at"))
    r = r.withColumn("_duplicate", F.col("_duplicate") | (dup_rank > 1))
    t = tech.select("technician_id", F.lit(True).alias("_tech_known"), F.col("is_active").alias("_tech_active"),
                    F.col("status").alias("_tech_status"), F.col("max_concurrent_jobs").alias("_tech_max"))
    jobs = active_jobs(wo, tech).withColumnRenamed("active_job_count", "_jobs")
    w = wo.select("work_order_id", F.lit(True).alias("_wo_known"), F.col("technician_id").alias("_cur_tech"),
                  F.col("status").alias("_wo_status"))
    j = (r.join(t, "technician_id", "left").join(jobs, "technician_id", "left").join(w, "work_order_id", "left")
          .withColumn("_already_here", F.coalesce((F.col("_cur_tech") == F.col("technician_id"))
                                                  | F.col("_wo_status").isin(COMPLETED, CANCELLED), F.lit(False))))
    folded = sorted_fold(j, ["technician_id"], ["requested_at", "work_order_id"], _assign_kernel, ASSIGN_SCHEMA)
    back = wo.select("work_order_id", F.col("status").alias("_s0"), F.col("technician_id").alias("previous_technician_id"))
    return (folded.join(back, "work_order_id", "left")
                  .withColumn("status_after", F.when(F.col("accepted") & (F.col("_s0") == PENDING), F.lit(ASSIGNED))
                              .otherwise(F.col("_s0")))
                  .drop("_s0"))


QUEUE_SCHEMA = T.StructType([
    T.StructField("_rid", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("jobs_before", T.LongType()),
    T.StructField("jobs_after", T.LongType()),
    T.StructField("technician_status_after", T.IntegerType()),
])


def _queue_kernel(pdf: pd.DataFrame, carry: dict) -> pd.DataFrame:
    """One technician's stream in time order: requests (with a row id) and departures, which free a slot."""
    keys = pdf["technician_id"].to_numpy()
    flag = {c: pdf[c].eq(True).to_numpy(dtype=bool) for c in ("_known", "_active", "_wo_known", "_takes", "_request")}
    status0 = pdf["_status"].to_numpy(dtype="float64", na_value=np.nan)
    most, jobs0 = (pdf[c].to_numpy(dtype="float64", na_value=0.0) for c in ("_max", "_jobs"))
    rids = pdf["_rid"].to_numpy()
    cur, jobs, st = carry.get("key"), carry.get("jobs", 0), carry.get("st")
    rows = []
    for i in range(len(pdf)):
        if keys[i] != cur:
            cur, jobs = keys[i], int(jobs0[i])
            st = None if np.isnan(status0[i]) else int(status0[i])
        if not flag["_request"][i]:
            jobs -= 1
            continue
        before, why = jobs, None
        if not flag["_wo_known"][i]:
            why = "work_order_not_found"
        elif not flag["_known"][i]:
            why = "technician_not_found"
        elif not flag["_active"][i]:
            why = "technician_inactive"
        elif st == ON_LEAVE or jobs >= most[i]:
            why = "technician_at_capacity"
        else:
            # the capacity mark counts the accepted order on top, whether or not it takes a new slot
            if st == AVAILABLE and jobs + 1 >= most[i]:
                st = BUSY
            jobs += bool(flag["_takes"][i])
        rows.append((rids[i], why, before, jobs, st))
    carry.update(key=cur, jobs=jobs, st=st)
    out = pd.DataFrame(rows, columns=[f.name for f in QUEUE_SCHEMA])
    return out.astype({"_rid": "int64", "jobs_before": "int64", "jobs_after": "int64", "technician_status_after": "Int32"})


def assign_queue(requests: DataFrame, wo: DataFrame, tech: DataFrame, closures: DataFrame | None = None) -> DataFrame:
    """Assignment requests in (requested_at, order, technician) order, as the service takes them one by one.

    A technician's open orders change inside the batch: an accepted request adds a slot to the technician (unless the
    order is closed or already there) and frees one of the technician who held the order; a closure
    (``closures``: work_order_id, closed_at) frees one of its holder. A request that was rejected leaves no
    trace, so a later request for the same order is judged on its own.

    Requests and the slots that are freed meet in one stream per technician and one fold. Who holds an order depends
    on which requests were accepted, so the folds are repeated with the last round's answers until no answer
    changes. Every answer depends on earlier ones only, so this ends, and after one round where no order
    moves. Each round is written to the checkpoint folder.
    """
    from stockflow.operators.workorders import active_jobs
    ensure_checkpoint_dir(requests.sparkSession)
    t = tech.select("technician_id", F.lit(True).alias("_known"), F.col("is_active").alias("_active"), F.col("status").alias("_status"),
                    F.col("max_concurrent_jobs").alias("_max"))
    t = t.join(active_jobs(wo, tech).withColumnRenamed("active_job_count", "_jobs"), "technician_id", "left")
    orders = wo.select("work_order_id", F.lit(True).alias("_wo_known"), F.col("technician_id").alias("_t0"), F.col("status").alias("_s0"))
    asked = requests.select("work_order_id", F.col("technician_id").alias("_to"), F.col("requested_at").alias("_at"), F.lit(1).alias("_kind"),
                            F.monotonically_increasing_id().alias("_rid"))
    if closures is not None:
        asked = asked.unionByName(closures.select("work_order_id", F.lit(None).cast("bigint").alias("_to"), F.col("closed_at").alias("_at"),
                                                  F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_rid")))
    asked = asked.join(orders, "work_order_id", "left").checkpoint()
    before = Window.partitionBy("work_order_id").orderBy("_at", "_kind", "_to", "_rid").rowsBetween(Window.unboundedPreceding, -1)
    known = tech.where("is_active").select(F.col("technician_id").alias("_to"), F.lit(True).alias("_first"))
    guess = asked.join(known, "_to", "left").select("_rid", F.coalesce(F.col("_first") & F.col("_wo_known"), F.lit(False)).alias("_ok")).where("_rid is not null")
    while True:
        told = (asked.join(guess, "_rid", "left")
                .withColumn("_holder", F.coalesce(F.last(F.when(F.col("_ok"), F.col("_to")), ignorenulls=True).over(before), "_t0"))
                .withColumn("_shut", F.coalesce(F.max(F.col("_kind") == 0).over(before), F.lit(False)))
                .withColumn("_closed", F.col("_shut") | F.coalesce(F.col("_s0").isin(COMPLETED, CANCELLED), F.lit(False)))
                .withColumn("_moves", ~F.col("_closed") & F.col("_holder").isNotNull() & ~F.col("_holder").eqNullSafe(F.col("_to"))
                            & ((F.col("_kind") == 0) | F.coalesce(F.col("_ok"), F.lit(False)))))
        stream = told.where("_kind = 1").select(
            F.col("_to").alias("technician_id"), "_at", "_kind", "work_order_id", "_rid", "_wo_known", F.lit(True).alias("_request"),
            (~F.col("_closed") & ~F.col("_holder").eqNullSafe(F.col("_to"))).alias("_takes"))
        freed = told.where("_moves").select(
            F.col("_holder").alias("technician_id"), "_at", "_kind", "work_order_id", "_rid", F.lit(True).alias("_wo_known"),
            F.lit(False).alias("_request"), F.lit(False).alias("_takes"))
        folded = sorted_fold(stream.unionByName(freed).join(t, "technician_id", "left"), ["technician_id"],
                             ["_at", "_kind", "work_order_id", "_rid"], _queue_kernel, QUEUE_SCHEMA).checkpoint()
        now = folded.select("_rid", F.col("reason").isNull().alias("_ok"))
        if not now.exceptAll(guess).limit(1).count():
            break
        guess = now
    s = F.when(F.col("_shut"), F.lit(COMPLETED)).otherwise(F.col("_s0"))
    first = F.coalesce(F.max(F.coalesce(F.col("_ok"), F.lit(False))).over(before), F.lit(False))
    status = F.when(~F.col("_shut") & (F.col("_s0") == PENDING) & (F.col("_ok") | F.col("_seen")), F.lit(ASSIGNED)).otherwise(s)
    return (told.withColumn("_seen", first).where("_kind = 1").join(folded, "_rid")
            .select("work_order_id", F.col("_to").alias("technician_id"), F.col("_at").alias("requested_at"), F.col("reason").isNull().alias("accepted"),
                    "reason", "jobs_before", "jobs_after", "technician_status_after", F.col("_holder").alias("previous_technician_id"),
                    status.cast("int").alias("status_after")))


def reassignments(assignments: DataFrame, reason: str = "Reassignment request") -> DataFrame:
    """Accepted assignments that move an order from one technician to another, with the note line."""
    acc = assignments.where(F.col("accepted") & F.col("previous_technician_id").isNotNull()
                            & (F.col("previous_technician_id") != F.col("technician_id")))
    note = F.concat(F.lit("["), F.date_format("requested_at", "yyyy-MM-dd HH:mm"), F.lit("] Reassigned from technician "),
                    F.col("previous_technician_id").cast("string"), F.lit(" to "),
                    F.col("technician_id").cast("string"), F.lit(". Reason: "), F.lit(reason))
    return acc.select("work_order_id", "previous_technician_id", F.col("technician_id").alias("new_technician_id"),
                      "requested_at", note.alias("note"))


# -- W16 people commands -------------------------------------------------------------------------

def _last(cond: Column, value: Column, seq: Column) -> Column:
    """Last accepted value of a column among the commands that touch it (NULL struct when none)."""
    return F.max_by(F.when(cond, F.struct(value.alias("v"))), F.when(cond, seq))


def apply_technician_commands(tech: DataFrame, cmds: DataFrame) -> DataFrame:
    """Technician commands (``technician_id, seq, command, new_status``): ``status`` sets any status
    0-4 (no other guard); ``deactivate`` sets inactive and status Inactive. Last write per column wins."""
    known = tech.select("technician_id", F.lit(True).alias("_k"))
    c = F.col("command")
    j = cmds.join(known, "technician_id", "left")
    reason = (F.when(F.col("_k").isNull(), F.lit("technician_not_found"))
               .when((c == "status") & F.coalesce(~F.col("new_status").between(0, 4), F.lit(True)),
                     F.lit("invalid_status"))
               .when(~F.coalesce(c.isin("status", "deactivate"), F.lit(False)), F.lit("unknown_command")))
    judged = j.withColumn("reason", reason).drop("_k")
    acc = judged.where(F.col("reason").isNull())
    seq = F.struct("seq")
    upd = acc.groupBy("technician_id").agg(
        _last(c.isin("status", "deactivate"), F.when(c == "deactivate", F.lit(INACTIVE)).otherwise(F.col("new_status")),
              seq).alias("_st"),
        _last(c == "deactivate", F.lit(False), seq).alias("_act"))
    cnt = judged.groupBy("technician_id").agg(F.count_if(F.col("reason").isNull()).alias("commands_applied"),
                                              F.count_if(F.col("reason").isNotNull()).alias("commands_rejected"))
    out = tech.join(upd, "technician_id", "left").join(cnt, "technician_id", "left")
    return out.select(
        "technician_id", "first_name", "last_name", "skill_level", "max_concurrent_jobs",
        F.coalesce(F.col("_st.v"), F.col("status")).cast("int").alias("status"),
        F.coalesce(F.col("_act.v"), F.col("is_active")).alias("is_active"),
        F.coalesce("commands_applied", F.lit(0).cast("bigint")).alias("commands_applied"),
        F.coalesce("commands_rejected", F.lit(0).cast("bigint")).alias("commands_rejected"))


def apply_customer_commands(cust: DataFrame, cmds: DataFrame) -> DataFrame:
    """Customer commands (``customer_id, seq, command, ...``): ``contact`` (contact name, e-mail and phone; e-mail required),
    ``address`` (new_address must parse), ``preferences`` (new_prefer_email, new_prefer_sms),
    ``deactivate`` / ``reactivate``. Last accepted write per column wins."""
    from stockflow.functions.scalars import parse_address
    known = cust.select("customer_id", F.lit(True).alias("_k"))
    c = F.col("command")
    for name in ("new_contact_name", "new_phone"):
        if name not in cmds.columns:
            cmds = cmds.withColumn(name, F.lit(None).cast("string"))
    j = cmds.join(known, "customer_id", "left")
    reason = (F.when(F.col("_k").isNull(), F.lit("customer_not_found"))
               .when((c == "contact") & (F.col("new_email").isNull() | (F.trim("new_email") == "")),
                     F.lit("email_required"))
               .when((c == "address") & parse_address("new_address").error.isNotNull(), F.lit("invalid_address"))
               .when(~F.coalesce(c.isin("contact", "address", "preferences", "deactivate", "reactivate"), F.lit(False)),
                     F.lit("unknown_command")))
    judged = j.withColumn("reason", reason).drop("_k")
    acc = judged.where(F.col("reason").isNull())
    seq = F.struct("seq")
    upd = acc.groupBy("customer_id").agg(
        _last(c == "contact", F.col("new_email"), seq).alias("_email"),
        _last(c == "contact", F.col("new_contact_name"), seq).alias("_contact"),
        _last(c == "contact", F.col("new_phone"), seq).alias("_phone"),
        _last(c == "address", F.col("new_address"), seq).alias("_addr"),
        _last(c == "preferences", F.col("new_prefer_email"), seq).alias("_pe"),
        _last(c == "preferences", F.col("new_prefer_sms"), seq).alias("_ps"),
        _last(c.isin("deactivate", "reactivate"), c == "reactivate", seq).alias("_act"))
    cnt = judged.groupBy("customer_id").agg(F.count_if(F.col("reason").isNull()).alias("commands_applied"),
                                            F.count_if(F.col("reason").isNotNull()).alias("commands_rejected"))
    out = cust.join(upd, "customer_id", "left").join(cnt, "customer_id", "left")
    base_active = F.col("is_active") if "is_active" in cust.columns else F.lit(True)
    base_email, base_contact, base_phone = (F.col(n) if n in cust.columns else F.lit(None).cast("string") for n in ("email", "contact_name", "phone"))
    return out.select(
        "customer_id", "company_name",
        F.when(F.col("_contact").isNotNull(), F.col("_contact.v")).otherwise(base_contact).alias("contact_name"),
        F.when(F.col("_phone").isNotNull(), F.col("_phone.v")).otherwise(base_phone).alias("phone"),
        F.coalesce(F.col("_email.v"), base_email).alias("email"),
        F.when(F.col("_addr").isNotNull(), F.col("_addr.v")).otherwise(F.col("address")).alias("address"),
        F.when(F.col("_pe").isNotNull(), F.col("_pe.v")).otherwise(F.col("prefer_email")).alias("prefer_email"),
        F.when(F.col("_ps").isNotNull(), F.col("_ps.v")).otherwise(F.col("prefer_sms")).alias("prefer_sms"),
        F.when(F.col("_act").isNotNull(), F.col("_act.v")).otherwise(base_active).alias("is_active"),
        F.coalesce("commands_applied", F.lit(0).cast("bigint")).alias("commands_applied"),
        F.coalesce("commands_rejected", F.lit(0).cast("bigint")).alias("commands_rejected"))


# -- W17 work-order commands -----------------------------------------------------------------------

def create_rule(wo: DataFrame) -> DataFrame:
    """Order creation keeps the estimate only when hours > 0 (the cost is dropped with it)."""
    keep = F.col("estimated_labor_hours") > 0
    return wo.withColumns({
        "estimated_labor_hours": F.when(keep, F.col("estimated_labor_hours")).otherwise(F.lit(0).cast("decimal(8,2)")),
        "estimated_cost": F.when(keep, F.col("estimated_cost")),
    })


def status_as_of(cmds: DataFrame, transitions: DataFrame, wo: DataFrame, chunk: str = "month") -> DataFrame:
    """Each command with the order's status at its (ts, seq): the last accepted transition at or
    before it, else the opening status.

    An as-of join written as a union + ``last(ignorenulls)`` window. The window
    runs per (order, ``chunk`` of time); the status reached by the end of each
    earlier chunk comes from a small orders x chunks table, so a very busy order
    is not one window partition. Exact, because chunks follow ``ts``, the
    leading sort key.
    """
    # the accepted transitions feed two branches (the in-chunk window and the per-chunk ends); a
    # reliable checkpoint in the shared checkpoint dir runs the transition fold once
    ensure_checkpoint_dir(transitions.sparkSession)
    t = (transitions.where("accepted")
                    .select("work_order_id", "ts", F.col("event_id").alias("seq"), F.lit(0).alias("_kind"),
                            F.col("status_after").alias("_st"))
                    .checkpoint())
    c = cmds.withColumns({"_kind": F.lit(1), "_st": F.lit(None).cast("int")})
    timeline = c.unionByName(t, allowMissingColumns=True).withColumn("_chunk", F.date_trunc(chunk, "ts"))
    inside = (Window.partitionBy("work_order_id", "_chunk").orderBy("ts", "seq", "_kind")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chunks = (timeline.groupBy("work_order_id", "_chunk")
                      .agg(F.max_by(F.when(F.col("_kind") == 0, F.col("_st")),
                                    F.when(F.col("_kind") == 0, F.struct("ts", "seq"))).alias("_end")))
    before = Window.partitionBy("work_order_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select("work_order_id", "_chunk", F.last("_end", ignorenulls=True).over(before).alias("_prev"))
    opening = wo.select("work_order_id", F.col("status").alias("_open"))
    return (timeline.withColumn("_now", F.last("_st", ignorenulls=True).over(inside))
                    .where(F.col("_kind") == 1)
                    .join(carry, ["work_order_id", "_chunk"])
                    .join(opening, "work_order_id", "left")
                    .withColumn("status_at", F.coalesce("_now", "_prev", "_open"))
                    .drop("_kind", "_st", "_now", "_prev", "_open", "_chunk"))


def apply_wo_commands(wo: DataFrame, cmds: DataFrame, transitions: DataFrame) -> DataFrame:
    """Schedule (start <= end), estimate (hours >= 0, cost >= 0), actuals (hours, cost >= 0;
    only while the order is Completed), add_part (no quantity guard) applied to the created orders.

    Commands: ``work_order_id, seq, ts, command, new_start, new_end, hours, cost, part_id, quantity``.
    Guards depend on the status timeline (W12), not on earlier commands, so the snapshot is again
    "last accepted write per column".
    """
    judged = status_as_of(cmds, transitions, wo)
    c = F.col("command")
    reason = (F.when(F.col("status_at").isNull(), F.lit("work_order_not_found"))
               .when((c == "schedule") & (F.col("new_start") > F.col("new_end")), F.lit("start_after_end"))
               .when((c == "estimate") & (F.col("hours") < 0), F.lit("negative_hours"))
               .when(c.isin("estimate", "actuals") & (F.col("cost") < 0), F.lit("negative_amount"))
               .when((c == "actuals") & (F.col("status_at") != COMPLETED), F.lit("not_completed"))
               .when(~F.coalesce(c.isin("schedule", "estimate", "actuals", "add_part"), F.lit(False)),
                     F.lit("unknown_command")))
    judged = judged.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    seq = F.struct("ts", "seq")
    # one aggregate for the new values and the counts (the judged commands are read once)
    upd = judged.groupBy("work_order_id").agg(
        _last(ok & (c == "schedule"), F.col("new_start"), seq).alias("_s"),
        _last(ok & (c == "schedule"), F.col("new_end"), seq).alias("_e"),
        _last(ok & (c == "estimate"), F.col("hours"), seq).alias("_eh"),
        _last(ok & (c == "estimate"), F.col("cost"), seq).alias("_ec"),
        _last(ok & (c == "actuals"), F.col("hours"), seq).alias("_ah"),
        _last(ok & (c == "actuals"), F.col("cost"), seq).alias("_ac"),
        F.count_if(ok & (c == "add_part")).alias("_lines"),
        F.count_if(ok).alias("commands_applied"), F.count_if(~ok).alias("commands_rejected"))
    base = create_rule(wo)
    out = base.join(upd, "work_order_id", "left")

    def pick(new, old):
        return F.when(F.col(new).isNotNull(), F.col(f"{new}.v")).otherwise(old)

    return out.select(
        "work_order_id", "status",
        pick("_s", F.col("scheduled_start")).alias("scheduled_start"),
        pick("_e", F.col("scheduled_end")).alias("scheduled_end"),
        pick("_eh", F.col("estimated_labor_hours")).cast("decimal(8,2)").alias("estimated_labor_hours"),
        pick("_ec", F.col("estimated_cost")).cast(DEC18).alias("estimated_cost"),
        pick("_ah", F.lit(None).cast("decimal(8,2)")).cast("decimal(8,2)").alias("actual_labor_hours"),
        pick("_ac", F.col("actual_cost")).cast(DEC18).alias("actual_cost"),
        F.coalesce("_lines", F.lit(0).cast("bigint")).alias("added_lines"),
        F.coalesce("commands_applied", F.lit(0).cast("bigint")).alias("commands_applied"),
        F.coalesce("commands_rejected", F.lit(0).cast("bigint")).alias("commands_rejected"))


# -- W18 completion ------------------------------------------------------------------------------------

def unused_reservations(tx: DataFrame) -> DataFrame:
    """Units still reserved for an order at each location: reserved - issued - released (ledger signs)."""
    t, q = F.col("transaction_type"), F.col("quantity")
    return (tx.where(F.col("work_order_id").isNotNull()).groupBy("work_order_id", "inventory_id")
              .agg((F.sum(F.when(t == "Reservation", q).otherwise(0))
                    + F.sum(F.when(t.isin("Issue", "Release"), q).otherwise(0))).alias("unused")))


def complete(transitions: DataFrame, wo: DataFrame, tx: DataFrame):
    """Every accepted move to Completed -> invoice row (actual cost, due 30 days later), the
    actuals check (hours > 0 and cost > 0) and release commands for units still reserved.

    An order reaches Completed at most once (it can only leave it for Cancelled), so one aggregate
    per order over the transitions gives both the completion and the last start (W13), and the
    transitions are read once. Actual hours are the start-to-completion time, else the estimate.

    Returns ``(invoices, release_commands)``; the release commands use the W2 command layout and
    can be appended to the next ledger replay.
    """
    acc = F.col("accepted")
    per = (transitions.groupBy("work_order_id")
                      .agg(F.max(F.when(acc & (F.col("new_status") == COMPLETED), F.col("ts"))).alias("completed_at"),
                           F.max_by(F.when(acc & (F.col("new_status") == COMPLETED), F.col("event_id")),
                                    F.when(acc & (F.col("new_status") == COMPLETED), F.col("ts"))).alias("event_id"),
                           F.max(F.when(acc & (F.col("new_status") == IN_PROGRESS), F.col("ts"))).alias("actual_start"))
                      .where(F.col("completed_at").isNotNull()))
    w = wo.select("work_order_id", "customer_id", "actual_cost", "estimated_labor_hours")
    unused = unused_reservations(tx).where(F.col("unused") > 0)
    j = per.join(w, "work_order_id", "left").join(unused, "work_order_id", "left")
    hours = F.coalesce(
        F.when(F.col("actual_start").isNotNull(),
               (ntz_micros("completed_at") - ntz_micros("actual_start")) / 3600000000.0),
        F.col("estimated_labor_hours").cast("double"))
    rel = (j.where(F.col("unused").isNotNull())
            .select("inventory_id",
                    F.concat(F.lit("complete-"), F.col("work_order_id").cast("string"), F.lit("-"),
                             F.col("inventory_id").cast("string")).alias("command_id"),
                    F.col("completed_at").alias("ts"), F.lit("release").alias("command"),
                    F.col("unused").cast("int").alias("quantity"), "work_order_id"))
    inv = (j.groupBy("work_order_id", "event_id", "customer_id", "completed_at", "actual_cost", "actual_start",
                     "estimated_labor_hours")
            .agg(F.count("inventory_id").alias("release_lines"),
                 F.coalesce(F.sum("unused"), F.lit(0)).cast("bigint").alias("release_units"))
            .withColumn("actual_labor_hours", hours)
            .select("work_order_id", "event_id", "customer_id", "completed_at",
                    F.col("actual_cost").alias("invoice_amount"),
                    (F.col("completed_at") + F.expr("INTERVAL 30 DAYS")).alias("due_date"),
                    "actual_labor_hours",
                    ((F.col("actual_labor_hours") > 0) & (F.col("actual_cost") > 0)).alias("actuals_valid"),
                    "release_lines", "release_units"))
    return inv, rel
