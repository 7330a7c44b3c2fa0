"""Stock ledger jobs: running balance (W1), guarded replay (W2) and what follows from it
(W3 closing, W4 events, W5 low-stock events), location commands (W6) and reservation
allocation (W10, W11).

Command table (one row per command)::

    inventory_id bigint, command_id string, ts timestamp_ntz, command string,
    quantity int, work_order_id bigint (optional)

``command`` is one of receive / reserve / release / issue / adjust (absolute
target) / adjust_by (signed difference). Commands of one location apply in
(ts, command_id) order; ties in time are broken by the id.

Guards (a rejected command leaves the state unchanged), fixed values of the
source application: quantity must be positive; reserve <= available; release
<= reserved; issue <= reserved and <= on hand; an adjust target must be >= 0
and >= reserved; a location may be deactivated only at 0 on hand / 0 reserved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.operators.automaton import CHUNK_ROWS, fold_rows, numbered, split_busy, sums_before, time_chunks
from stockflow.operators.fold import sorted_fold
from stockflow.operators.ledger_rules import on_hand_after, reason, reserved_after, step as _step
from stockflow.session import ensure_checkpoint_dir

ORDER = ["ts", "command_id"]

REPLAY_SCHEMA = T.StructType([
    T.StructField("inventory_id", T.LongType()),
    T.StructField("command_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("command", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("work_order_id", T.LongType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("on_hand_before", T.LongType()),
    T.StructField("reserved_before", T.LongType()),
    T.StructField("on_hand_after", T.LongType()),
    T.StructField("reserved_after", T.LongType()),
])


# -- W1 ------------------------------------------------------------------------------

def running_balance(tx: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """On hand / reserved / available after each ledger row (ledger signs, no guards).

    on_hand = Receipt + Issue + Adjustment; reserved = Reservation + Release + Issue.

    A running sum is a prefix sum, so a location with a very long history is
    split exactly: the window runs per (location, time chunk; see ``time_chunks``), and each
    chunk is shifted by the totals of the location's earlier chunks (a small
    locations x chunks table with its own window). No task ever holds a whole
    location's history.
    """
    t, q = F.col("transaction_type"), F.col("quantity")
    d_oh = F.when(t.isin("Receipt", "Issue", "Adjustment"), q).otherwise(0).cast("bigint")
    d_rs = F.when(t.isin("Reservation", "Release", "Issue"), q).otherwise(0).cast("bigint")
    chunk = time_chunks(tx, "inventory_id", "transaction_date", chunk_rows)
    rows = tx.withColumns({"_chunk": F.lit(0).cast("bigint") if chunk is None else chunk, "_doh": d_oh, "_drs": d_rs})
    spec = Window.partitionBy("inventory_id", "_chunk").orderBy("transaction_date", "transaction_id")
    run = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # running and whole-chunk sums share one window operator (same partitioning and order);
    # the chunk totals are then aggregated without another shuffle of the ledger rows
    inner = rows.withColumns({"_roh": F.sum("_doh").over(run), "_rrs": F.sum("_drs").over(run),
                              "_toh": F.sum("_doh").over(whole), "_trs": F.sum("_drs").over(whole)})
    totals = inner.groupBy("inventory_id", "_chunk").agg(F.max("_toh").alias("_toh"), F.max("_trs").alias("_trs"))
    before = Window.partitionBy("inventory_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("inventory_id", "_chunk",
                            F.coalesce(F.sum("_toh").over(before), F.lit(0)).alias("_ooh"),
                            F.coalesce(F.sum("_trs").over(before), F.lit(0)).alias("_ors"))
    out = inner.join(offsets, ["inventory_id", "_chunk"])
    return (out.withColumns({"running_on_hand": F.col("_ooh") + F.col("_roh"),
                             "running_reserved": F.col("_ors") + F.col("_rrs")})
               .withColumn("running_available", F.col("running_on_hand") - F.col("running_reserved"))
               .drop("_chunk", "_doh", "_drs", "_roh", "_rrs", "_toh", "_trs", "_ooh", "_ors"))


# -- commands --------------------------------------------------------------------------

def ledger_commands(tx: DataFrame) -> DataFrame:
    """Read ledger rows back as commands (signed ledger quantities -> positive command quantities)."""
    t, q = F.col("transaction_type"), F.col("quantity")
    cmd = (F.when(t == "Receipt", "receive").when(t == "Reservation", "reserve").when(t == "Issue", "issue")
            .when(t == "Release", "release").when(t == "Adjustment", "adjust_by").otherwise("unknown"))
    qty = F.when(t.isin("Issue", "Release"), -q).otherwise(q)
    return tx.select("inventory_id", F.col("transaction_id").alias("command_id"),
                     F.col("transaction_date").alias("ts"), cmd.alias("command"),
                     qty.cast("int").alias("quantity"), F.col("work_order_id").cast("bigint"))


# -- W2 kernel (per-row helper over one sorted batch) -------------------------------------

_CODES = {"receive": 0, "reserve": 1, "release": 2, "issue": 3, "adjust": 4, "adjust_by": 5}


def _ledger_kernel(pdf: pd.DataFrame, carry: dict, vectorized: bool = True) -> pd.DataFrame:
    """Guarded replay of one sorted batch (rows grouped by location, in (ts, id) order).

    Vectorised prefix sums give every location's state assuming all commands
    are accepted; up to a location's first guard violation those states are
    exact. Only the rows from that first violation on are walked one by one
    with ``_step``. ``carry`` holds the state of the last location of the
    previous batch (a location may span batches).
    """
    n = len(pdf)
    keys = pdf["inventory_id"].to_numpy()
    code = pdf["command"].map(_CODES).to_numpy(dtype="float64", na_value=-1.0)
    qf = pdf["quantity"].to_numpy(dtype="float64", na_value=np.nan)
    qnan = np.isnan(qf)
    q = np.where(qnan, 0, qf).astype(np.int64)
    new_seg = np.ones(n, dtype=bool)
    new_seg[1:] = keys[1:] != keys[:-1]
    seg = np.cumsum(new_seg) - 1
    starts = np.flatnonzero(new_seg)
    oh0 = pdf["opening_on_hand"].to_numpy(dtype="float64", na_value=0.0)[starts].astype(np.int64)
    rs0 = pdf["opening_reserved"].to_numpy(dtype="float64", na_value=0.0)[starts].astype(np.int64)
    if carry.get("key") is not None and keys[0] == carry["key"]:
        oh0[0], rs0[0] = carry["oh"], carry["rs"]
    d_oh = np.where(code == 0, q, np.where(code == 3, -q, np.where(code == 5, q, 0)))
    d_rs = np.where(code == 1, q, np.where((code == 2) | (code == 3), -q, 0))
    c_oh, c_rs = np.cumsum(d_oh), np.cumsum(d_rs)
    oha = c_oh - (c_oh - d_oh)[starts][seg] + oh0[seg]
    rsa = c_rs - (c_rs - d_rs)[starts][seg] + rs0[seg]
    ohb, rsb = oha - d_oh, rsa - d_rs
    if vectorized:
        bad = (qnan | (code < 0) | (code == 4) | ((code != 5) & (q <= 0))
               | ((code == 1) & (q > ohb - rsb)) | (((code == 2) | (code == 3)) & (q > rsb))
               | ((code == 3) & (q > ohb)) | ((code == 5) & ((ohb + q < 0) | (ohb + q < rsb))))
        idx = np.arange(n)
        first_bad = np.minimum.reduceat(np.where(bad, idx, n), starts)
        walk = np.flatnonzero(idx >= first_bad[seg])
    else:
        walk = np.arange(n)
    reason = np.full(n, None, dtype=object)
    if walk.size:
        cmds = pdf["command"].to_numpy(dtype=object)
        cur = -1
        oh = rs = 0
        for i in walk.tolist():
            if seg[i] != cur:
                cur = seg[i]
                # state before the first walked row: exact from the prefix sums (all earlier rows accepted)
                oh, rs = int(ohb[i]), int(rsb[i])
            ohb[i], rsb[i] = oh, rs
            reason[i], oh, rs = _step(cmds[i], None if qnan[i] else int(q[i]), oh, rs)
            oha[i], rsa[i] = oh, rs
    carry.update(key=keys[-1], oh=int(oha[-1]), rs=int(rsa[-1]))
    out = pdf[["inventory_id", "command_id", "ts", "command", "quantity", "work_order_id"]].copy()
    out["accepted"] = np.equal(reason, None)
    out["reason"] = reason
    out["on_hand_before"], out["reserved_before"] = ohb, rsb
    out["on_hand_after"], out["reserved_after"] = oha, rsa
    return out


# -- W2 ----------------------------------------------------------------------------------

def _with_opening(commands: DataFrame, opening: DataFrame | None) -> DataFrame:
    if "work_order_id" not in commands.columns:
        commands = commands.withColumn("work_order_id", F.lit(None).cast("bigint"))
    if opening is None:
        return commands.withColumns({"opening_on_hand": F.lit(0).cast("bigint"),
                                     "opening_reserved": F.lit(0).cast("bigint")})
    o = opening.select("inventory_id", F.col("on_hand").cast("bigint").alias("opening_on_hand"),
                       F.col("reserved").cast("bigint").alias("opening_reserved"))
    return (commands.join(o, "inventory_id", "left")
                    .fillna(0, subset=["opening_on_hand", "opening_reserved"]))


_STATE = "struct<reason:string,oh:bigint,rs:bigint>"


def _sql_step(state, x):
    c, q, oh, rs = x["command"], x["quantity"], state["oh"], state["rs"]
    # bound by a lambda: the guards are evaluated once for a row, not again for every field
    return F.get(F.transform(F.array(reason(c, q, oh, rs)), lambda why: F.struct(
        why.alias("reason"), F.when(why.isNull(), on_hand_after(c, q, oh)).otherwise(oh).alias("oh"),
        F.when(why.isNull(), reserved_after(c, q, rs)).otherwise(rs).alias("rs")).cast(_STATE)), F.lit(0))


def _walked(cmds: DataFrame) -> DataFrame:
    """inventory_id, items, results of every location (see ``fold_rows``): SQL only, for locations of bounded size."""
    opening = F.struct(F.lit(None).cast("string").alias("reason"), F.col("opening_on_hand").alias("oh"), F.col("opening_reserved").alias("rs")).cast(_STATE)
    rows = cmds.select("inventory_id", *ORDER, "command", "quantity", "work_order_id", "opening_on_hand", "opening_reserved")
    return fold_rows(rows, "inventory_id", ORDER, opening, _sql_step)


def clean_prefix(cmds: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of busy locations with the state before them if every command were accepted, and ``dirty``: whether a
    guard has failed at this row or before it.

    Sums run per (location, time chunk); earlier chunks come in through a small locations x chunks table, so one
    location with half of all rows is many windows. Up to a location's first violation these states are exact;
    an absolute adjustment needs the state itself and counts as one.
    """
    chunk = time_chunks(cmds, "inventory_id", "ts", chunk_rows)
    c, q = F.col("command"), F.coalesce(F.col("quantity"), F.lit(0)).cast("bigint")
    rows = cmds.withColumns({
        "_chunk": F.lit(0).cast("long") if chunk is None else chunk,
        "_doh": F.when(c.isin("receive", "adjust_by"), q).when(c == "issue", -q).otherwise(F.lit(0).cast("bigint")),
        "_drs": F.when(c == "reserve", q).when(c.isin("release", "issue"), -q).otherwise(F.lit(0).cast("bigint"))})
    inside = Window.partitionBy("inventory_id", "_chunk").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("inventory_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    carry = rows.groupBy("inventory_id", "_chunk").agg(F.sum("_doh").alias("a"), F.sum("_drs").alias("b")).select(
        "inventory_id", "_chunk", F.coalesce(F.sum("a").over(earlier), zero).alias("_coh"), F.coalesce(F.sum("b").over(earlier), zero).alias("_crs"))
    rows = rows.withColumns({"_roh": F.sum("_doh").over(inside), "_rrs": F.sum("_drs").over(inside)}).join(carry, ["inventory_id", "_chunk"])
    rows = rows.withColumns({"_oh": F.col("opening_on_hand") + F.col("_coh") + F.col("_roh") - F.col("_doh"),
                             "_rs": F.col("opening_reserved") + F.col("_crs") + F.col("_rrs") - F.col("_drs")})
    bad = reason(c, F.col("quantity"), F.col("_oh"), F.col("_rs")).isNotNull() | F.coalesce(c == "adjust", F.lit(False))
    first = rows.withColumn("_bad", bad).where("_bad").groupBy("inventory_id").agg(F.min(F.struct(*ORDER)).alias("_first"))
    return (rows.join(first, "inventory_id", "left").withColumn("dirty", F.col("_first").isNotNull() & (F.struct(*ORDER) >= F.col("_first")))
                .drop("_chunk", "_doh", "_drs", "_coh", "_crs", "_roh", "_rrs", "_first"))


def _busy_replay(cmds: DataFrame, chunk_rows: int) -> DataFrame:
    """Replay of busy locations: their clean prefixes in chunks, the rest in one streaming fold from the state before it."""
    split = clean_prefix(cmds, chunk_rows)
    c, q, oh, rs = F.col("command"), F.col("quantity"), F.col("_oh"), F.col("_rs")
    clean = split.where(~F.col("dirty")).select(
        "inventory_id", *ORDER, "command", "quantity", "work_order_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"),
        oh.alias("on_hand_before"), rs.alias("reserved_before"), on_hand_after(c, q, oh).alias("on_hand_after"), reserved_after(c, q, rs).alias("reserved_after"))
    dirty = (split.where("dirty").withColumns({"opening_on_hand": oh, "opening_reserved": rs}).drop("_oh", "_rs", "dirty"))
    folded = sorted_fold(dirty, ["inventory_id"], ORDER, _ledger_kernel, REPLAY_SCHEMA)
    names = [f.name for f in REPLAY_SCHEMA]
    return clean.select(*names).unionByName(folded)


def replay(commands: DataFrame, opening: DataFrame | None = None, fast_path: bool = True, busy_rows: int = CHUNK_ROWS) -> DataFrame:
    """Apply commands per location in order with guards; one result row per command.

    Locations of at most ``busy_rows`` commands are walked in SQL, one array per location. Busier ones (one aggregate
    finds them) are split by their first guard violation: what lies before it needs only prefix sums per time
    chunk, what follows runs through the streaming fold kernel. ``fast_path=False`` walks every row in the kernel
    (kept as a cross-check).
    """
    if not fast_path:
        return sorted_fold(_with_opening(commands, opening), ["inventory_id"], ORDER,
                           lambda pdf, carry: _ledger_kernel(pdf, carry, vectorized=False), REPLAY_SCHEMA)
    # split before the opening states are joined: counting needs the commands' keys only
    small, busy = split_busy(commands, "inventory_id", busy_rows)
    w = _walked(_with_opening(small, opening))
    one = w.select("inventory_id", F.posexplode("items").alias("_i", "_x"), "results").withColumns(
        {"_b": F.get("results", F.col("_i")), "_a": F.get("results", F.col("_i") + 1)})
    out = one.select("inventory_id", "_x.command_id", "_x.ts", "_x.command", "_x.quantity", "_x.work_order_id",
                     F.col("_a.reason").isNull().alias("accepted"), "_a.reason", F.col("_b.oh").alias("on_hand_before"), F.col("_b.rs").alias("reserved_before"),
                     F.col("_a.oh").alias("on_hand_after"), F.col("_a.rs").alias("reserved_after"))
    return out if busy is None else out.unionByName(_busy_replay(_with_opening(busy, opening), busy_rows))


# -- W3-W5 ---------------------------------------------------------------------------------

def closing(replayed: DataFrame) -> DataFrame:
    """Closing on hand / reserved and accept / reject counts per location.

    ``max_by`` over (ts, id) is a partial aggregate: a hot location never
    has to be gathered in one place.
    """
    last = F.max_by(F.struct("on_hand_after", "reserved_after"), F.struct(*ORDER))
    return (replayed.groupBy("inventory_id")
                    .agg(last.alias("_last"), F.count(F.lit(1)).alias("command_count"),
                         F.count_if("accepted").alias("accepted_count"),
                         F.count_if(~F.col("accepted")).alias("rejected_count"))
                    .select("inventory_id", F.col("_last.on_hand_after").alias("closing_on_hand"),
                            F.col("_last.reserved_after").alias("closing_reserved"),
                            "command_count", "accepted_count", "rejected_count"))


def replay_closing(commands: DataFrame, opening: DataFrame | None = None, busy_rows: int = CHUNK_ROWS) -> DataFrame:
    """W3 fused with W2: the closing state and counts come straight from each location's walked array; only busy
    locations go through the rows of ``replay``. Same result as ``closing(replay(...))``."""
    small, busy = split_busy(commands, "inventory_id", busy_rows)
    n = F.size("items").cast("long")
    end = F.element_at("results", -1)
    rejected = F.size(F.filter("results", lambda r: r["reason"].isNotNull())).cast("long")
    out = _walked(_with_opening(small, opening)).select("inventory_id", end["oh"].alias("closing_on_hand"), end["rs"].alias("closing_reserved"),
                                n.alias("command_count"), (n - rejected).alias("accepted_count"), rejected.alias("rejected_count"))
    return out if busy is None else out.unionByName(closing(_busy_replay(_with_opening(busy, opening), busy_rows)))


EVENT_COLUMNS = ["event_id", "event_type", "occurred_on", "inventory_id", "part_id", "work_order_id", "warehouse",
                 "quantity", "available", "on_hand", "min_level", "reorder_qty", "old_qty", "new_qty", "difference",
                 "reason", "reference", "old_cost", "new_cost", "old_price", "new_price", "part_number"]

_EVENT_TYPES = {"int": ("quantity", "available", "min_level", "reorder_qty"),
                "bigint": ("inventory_id", "part_id", "work_order_id", "on_hand", "old_qty", "new_qty", "difference"),
                "decimal(18,2)": ("old_cost", "new_cost", "old_price", "new_price"),
                "string": ("event_id", "event_type", "warehouse", "reason", "reference", "part_number"),
                "timestamp_ntz": ("occurred_on",)}


def envelope(df: DataFrame) -> DataFrame:
    """Project to the one flat event envelope; missing fields are typed NULLs."""
    types = {c: t for t, cols in _EVENT_TYPES.items() for c in cols}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
                       for c in EVENT_COLUMNS])


def _loc(inv: DataFrame) -> DataFrame:
    return inv.select("inventory_id", "part_id", "warehouse", "minimum_stock_level", "reorder_quantity")


def _stock_event() -> tuple[Column, dict[str, Column]]:
    """The condition on a replayed row with its location, and the event's fields."""
    c = F.col("command")
    etype = (F.when(c == "reserve", "InventoryReserved").when(c == "issue", "InventoryIssued")
              .when(c == "receive", "InventoryReceived").otherwise("InventoryAdjusted"))
    adj = c.isin("adjust", "adjust_by")
    return F.col("accepted") & (c != "release"), {
        "event_id": F.concat(F.col("command_id"), F.lit("/"), etype), "event_type": etype,
        "occurred_on": F.col("ts"), "inventory_id": F.col("inventory_id"), "part_id": F.col("part_id"),
        "work_order_id": F.when(c.isin("reserve", "issue"), F.col("work_order_id")), "warehouse": F.col("warehouse"),
        "quantity": F.when(~adj, F.col("quantity")),
        "available": F.when(c == "reserve", F.col("on_hand_after") - F.col("reserved_after")),
        "on_hand": F.when(c.isin("issue", "receive"), F.col("on_hand_after")),
        "old_qty": F.when(adj, F.col("on_hand_before")),
        "new_qty": F.when(adj, F.col("on_hand_after")),
        "difference": F.when(adj, F.col("on_hand_after") - F.col("on_hand_before")),
        "reference": F.when(c == "receive", F.lit(""))}


def _low_event() -> tuple[Column, dict[str, Column]]:
    """The condition on a replayed row with its location, and the event's fields."""
    avail = F.col("on_hand_after") - F.col("reserved_after")
    return F.col("accepted") & F.col("command").isin("issue", "adjust", "adjust_by") & (avail <= F.col("minimum_stock_level")), {
        "event_id": F.concat(F.col("command_id"), F.lit("/InventoryLowStockDetected")),
        "event_type": F.lit("InventoryLowStockDetected"), "occurred_on": F.col("ts"),
        "inventory_id": F.col("inventory_id"), "part_id": F.col("part_id"), "warehouse": F.col("warehouse"), "available": avail,
        "min_level": F.col("minimum_stock_level"), "reorder_qty": F.col("reorder_quantity")}


def _events(rows: DataFrame, event: tuple[Column, dict[str, Column]]) -> DataFrame:
    cond, fields = event
    return envelope(rows.where(cond).select(*[v.alias(c) for c, v in fields.items()]))


def inventory_events(replayed: DataFrame, inv: DataFrame) -> DataFrame:
    """Reserved / Issued / Received / Adjusted events of accepted commands (Release raises none)."""
    acc = replayed.where(F.col("accepted") & (F.col("command") != "release"))
    return _events(acc.join(_loc(inv), "inventory_id", "left"), _stock_event())


def low_stock_events(replayed: DataFrame, inv: DataFrame) -> DataFrame:
    """Each accepted Issue / Adjust that leaves available <= minimum (no crossing test).

    The event carries the *stored* reorder quantity of the location.
    """
    acc = replayed.where(F.col("accepted") & F.col("command").isin("issue", "adjust", "adjust_by"))
    return _events(acc.join(_loc(inv), "inventory_id"), _low_event())


def all_events(replayed: DataFrame, inv: DataFrame) -> DataFrame:
    """W4 and W5 together in one pass over the replayed rows: a union of both would run the replay twice."""
    types = {c: t for t, cols in _EVENT_TYPES.items() for c in cols}

    def one(event: tuple[Column, dict[str, Column]]) -> Column:
        cond, fields = event
        return F.when(cond, F.struct(*[fields.get(c, F.lit(None)).cast(types[c]).alias(c) for c in EVENT_COLUMNS]))
    acc = replayed.where(F.col("accepted") & (F.col("command") != "release")).join(_loc(inv), "inventory_id", "left")
    return (acc.select(F.explode(F.array(one(_stock_event()), one(_low_event()))).alias("_e"))
               .where(F.col("_e").isNotNull()).select("_e.*"))


# -- W10 / W11 ----------------------------------------------------------------------------------

def allocate(requests: DataFrame, inv: DataFrame) -> DataFrame:
    """Spread each request (one quantity per part) over active locations in warehouse-name order.

    Greedy: a location gives min(remaining, available); locations with nothing
    available are skipped. The request succeeds only if the part's total
    available (all active rows) covers it; otherwise nothing is taken.
    ``taken = greatest(0, least(avail, need - sum(avail) of earlier locations))``.
    The running sum depends only on the part, so it is computed once on the
    location side (a window per part, bounded by the number of warehouses) and
    every request joins to it: no per-request window or id is needed, and
    repeated requests stay separate rows. Requests: ``request_id, part_id, quantity``.
    """
    raw = F.col("quantity_on_hand") - F.col("quantity_reserved")
    w_prev = (Window.partitionBy("part_id").orderBy("warehouse", "inventory_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    loc = (inv.where(F.col("is_active"))
              .select("part_id", "inventory_id", "warehouse", raw.alias("_raw"),
                      F.greatest(raw, F.lit(0)).alias("available"))
              .withColumns({"_before": F.coalesce(F.sum("available").over(w_prev), F.lit(0)),
                            "total_available": F.sum("_raw").over(Window.partitionBy("part_id"))}))
    take = F.greatest(F.lit(0), F.least(F.col("available"), F.col("quantity") - F.col("_before")))
    return (requests.join(loc, "part_id")
                    .withColumn("fulfilled", F.col("total_available") >= F.col("quantity"))
                    .select("request_id", "part_id", "quantity", "inventory_id", "warehouse", "available",
                            "total_available", "fulfilled",
                            F.when(F.col("fulfilled"), take).otherwise(F.lit(0)).cast("bigint").alias("taken")))


QUEUE_ORDER = ["created_at", "work_order_id", "line_no", "quantity"]


FINISH_ROWS = 200_000


def committed_orders(lines: DataFrame, chunk_rows: int = CHUNK_ROWS, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """work_order_id, order_committed: which orders get all their lines when orders are served one after another.

    An order is a transaction: it takes all its units or, if one line doesn't fit what the earlier committed
    orders have left, none. Whether it commits depends on earlier orders through every part it needs, so it is decided
    from two sides until nothing is open: an order that fits even if all earlier open orders commit, commits;
    one that doesn't fit even if none of them does, fails. The first open order always decides and decisions never
    change. A row keeps what the orders committed before it take of its part (``least``), so decided orders leave the
    rows after one more sum and a round costs what is open. Each round is written to the checkpoint folder. The
    last ``FINISH_ROWS`` open rows are walked in order by one task, whose memory that number bounds.

    lines: work_order_id, created_at, part_id, quantity, total_available (null: unknown part).
    """
    ensure_checkpoint_dir(lines.sparkSession)
    valid = F.coalesce(F.col("total_available").isNotNull() & (F.col("quantity") >= 1), F.lit(False))
    needs = (lines.groupBy("work_order_id", "part_id")
             .agg(F.min("created_at").alias("created_at"), F.sum(F.col("quantity").cast("bigint")).alias("need"),
                  F.max("total_available").alias("total"), F.bool_and(valid).alias("valid")).checkpoint())
    invalid = needs.where("not valid").select(F.col("work_order_id").alias("_w")).distinct()
    decided = invalid.select(F.col("_w").alias("work_order_id"), F.lit(False).alias("order_committed"))
    zero = F.lit(0).cast("bigint")
    # state: 0 open, 1 committed in the last round
    rows = (needs.join(invalid, F.col("work_order_id") == F.col("_w"), "left_anti")
            .select("work_order_id", "part_id", "created_at", "need", "total", zero.alias("least"), F.lit(0).alias("state")))
    chunk = time_chunks(rows, "part_id", "created_at", chunk_rows)
    whole = Window.partitionBy("work_order_id")
    while True:
        sums = sums_before(rows, "part_id", ["created_at", "work_order_id"],
                           {"_ahead": F.when(F.col("state") == 0, F.col("need")).otherwise(zero),
                            "_new": F.when(F.col("state") == 1, F.col("need")).otherwise(zero)}, chunk)
        open_rows = sums.where("state = 0").withColumn("least", F.col("least") + F.col("_new")).drop("_new")
        if rows.where("state = 0").limit(finish_rows + 1).count() <= finish_rows:
            break
        low = F.col("least") + F.col("need")
        judged = open_rows.withColumn("state", F.when(F.bool_and(low + F.col("_ahead") <= F.col("total")).over(whole), F.lit(1))
                                      .when(F.bool_or(low > F.col("total")).over(whole), F.lit(-1)).otherwise(F.lit(0))).drop("_ahead").checkpoint()
        decided = decided.unionByName(judged.where("state <> 0").select("work_order_id", (F.col("state") == 1).alias("order_committed")).distinct())
        rows = judged.where("state >= 0")
    orders = open_rows.groupBy("work_order_id").agg(F.min("created_at").alias("created_at"), *[F.collect_list(c).alias(c) for c in (
        "part_id", "need", "total", "least")]).withColumn("_one", F.lit(0))
    last = sorted_fold(orders, ["_one"], ["created_at", "work_order_id"], _commit_kernel, "work_order_id long, order_committed boolean")
    return decided.unionByName(last.checkpoint())


def _commit_kernel(pdf: pd.DataFrame, carry: dict) -> pd.DataFrame:
    """Open orders in their order, with what each part has promised to them so far."""
    used = carry.setdefault("used", {})
    ok = []
    for parts, needs, totals, leasts in zip(pdf["part_id"], pdf["need"], pdf["total"], pdf["least"]):
        fits = all(used.get(p, 0) + low + n <= t for p, n, t, low in zip(parts, needs, totals, leasts))
        if fits:
            for p, n in zip(parts, needs):
                used[p] = used.get(p, 0) + n
        ok.append(fits)
    return pd.DataFrame({"work_order_id": pdf["work_order_id"], "order_committed": ok})


def allocate_queue(requests: DataFrame, inv: DataFrame, parts: DataFrame, chunk_rows: int = CHUNK_ROWS,
                   finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Many requests per part, served in (created, order, line) order against one snapshot.

    1. ``committed_orders`` decides which orders get all their lines. The units of a failed order stay free for the
       orders after it, as a rolled-back transaction leaves them.
    2. A line is accepted when the units of the committed orders before it, those of its own order's earlier lines
       and its own fit the part's total available (active locations).
    3. Lines of committed orders are split over locations by overlapping the cumulative demand interval
       [before, after) with each location's cumulative supply interval (active locations with stock, in
       warehouse-name order). Each line meets at most one location per warehouse, so the range join is bounded.

    Output: one row per (line, location) take; a line that takes nothing appears once with a NULL location.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    # stock and lines are read by several of the steps below: each is made once
    raw = F.col("_raw")
    active = inv.where(F.col("is_active")).select(
        "part_id", "inventory_id", "warehouse", (F.col("quantity_on_hand") - F.col("quantity_reserved")).alias("_raw")).checkpoint()
    totals = active.groupBy("part_id").agg(F.sum(raw).alias("total_available"))
    known = parts.select("part_id").join(totals, "part_id", "left").fillna(0, subset=["total_available"])
    lines = requests.select("work_order_id", "line_no", "part_id", "quantity", "created_at").join(known, "part_id", "left").checkpoint()
    chunk = time_chunks(lines, "part_id", "created_at", chunk_rows)
    lines = lines.join(committed_orders(lines, chunk_rows, finish_rows), "work_order_id")
    units = F.when(F.coalesce((F.col("quantity") >= 1) & F.col("total_available").isNotNull(), F.lit(False)), F.col("quantity").cast("bigint")).otherwise(
        F.lit(0).cast("bigint"))
    yes = F.col("order_committed")
    own = Window.partitionBy("work_order_id", "part_id").orderBy(*QUEUE_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    lines = sums_before(lines, "part_id", QUEUE_ORDER, {"_taken": F.when(yes, units).otherwise(F.lit(0).cast("bigint"))}, chunk)
    before = F.col("_taken") + F.when(yes, F.lit(0).cast("bigint")).otherwise(F.coalesce(F.sum(units).over(own), F.lit(0).cast("bigint")))
    lines = lines.withColumn("demand_before", before)
    why = (F.when(F.col("total_available").isNull(), F.lit("part_not_found"))
            .when(F.coalesce(F.col("quantity") < 1, F.lit(True)), F.lit("invalid_quantity"))
            .when(F.col("demand_before") + F.col("quantity") > F.col("total_available"), F.lit("insufficient_inventory")))
    folded = lines.select("work_order_id", "line_no", "part_id", "quantity", "created_at", why.isNull().alias("line_accepted"), why.alias("reason"),
                          "demand_before", (F.col("demand_before") + F.when(yes, units).otherwise(F.lit(0).cast("bigint"))).alias("demand_after"),
                          "order_committed")
    av = F.greatest(raw, F.lit(0))
    supply = (active.where(raw > 0)
                    .select(F.col("part_id").alias("_pid"), "inventory_id", "warehouse", av.alias("_av"))
                    .withColumn("_shi", F.sum("_av").over(Window.partitionBy("_pid").orderBy("warehouse", "inventory_id")
                                                          .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                    .withColumn("_slo", F.col("_shi") - F.col("_av")))
    lo, hi = F.col("demand_before"), F.col("demand_after")
    # one left range join serves both kinds of line: a line that takes nothing has an empty demand
    # interval (before == after), which the lo < hi test keeps from meeting any location
    cond = (F.col("part_id") == F.col("_pid")) & (lo < hi) & (lo < F.col("_shi")) & (F.col("_slo") < hi)
    taken = F.when(F.col("_pid").isNotNull(), F.least(hi, F.col("_shi")) - F.greatest(lo, F.col("_slo"))) \
             .otherwise(F.lit(0).cast("bigint"))
    return folded.join(supply, cond, "left").withColumn("taken", taken).drop("_pid", "_av", "_shi", "_slo")


def reorder_suggestions(low_events: DataFrame, top_k: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """L4: one suggestion per low-stock event: order the stored reorder quantity; Critical when
    nothing is available, else Normal; ``urgency_rank`` per warehouse (Critical first, then oldest, then event id).

    With ``top_k`` only the k most urgent suggestions per warehouse are kept: ``row_number() <= k`` lets Spark limit
    each partition before the shuffle. Without it the rank is counted per (warehouse, priority, time chunk) and
    shifted by the counts before, so no warehouse is ranked as a whole; the suggestions are read three times for
    that, so they are written to the checkpoint folder first and what makes the events runs once.
    """
    out = low_events.select(
        "part_id", "warehouse", "inventory_id", F.col("reorder_qty").alias("quantity_to_order"),
        F.when(F.col("available") == 0, F.lit("Critical")).otherwise(F.lit("Normal")).alias("priority"),
        F.col("occurred_on").alias("created_at"), F.col("event_id").alias("source_event_id"))
    if top_k is None:
        ensure_checkpoint_dir(out.sparkSession)
        out = out.checkpoint()
        return numbered(out, ["warehouse"], "priority", "created_at", ["created_at", "source_event_id"], "urgency_rank", chunk_rows)
    w = Window.partitionBy("warehouse").orderBy((F.col("priority") == "Critical").desc(), "created_at",
                                                "source_event_id")
    return out.withColumn("urgency_rank", F.row_number().over(w).cast("bigint")).where(F.col("urgency_rank") <= top_k)


def tx_view(tx: DataFrame) -> DataFrame:
    """ledger projection with the type text and the note of each row."""
    from stockflow.functions.scalars import ledger_note
    return tx.select("transaction_id", "inventory_id", "transaction_type", "quantity", "work_order_id",
                     ledger_note("transaction_type", "quantity").alias("notes"), "transaction_date")


# -- W6 location commands ------------------------------------------------------------------------

LOCATION_SCHEMA = T.StructType([
    T.StructField("inventory_id", T.LongType()),
    T.StructField("command_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("command", T.StringType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("on_hand", T.LongType()),
    T.StructField("reserved", T.LongType()),
    T.StructField("minimum_stock_level", T.IntegerType()),
    T.StructField("maximum_stock_level", T.IntegerType()),
    T.StructField("reorder_quantity", T.IntegerType()),
    T.StructField("bin_location", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("ledger_note", T.StringType()),
])

_LOC_FIELDS = ("oh", "rs", "mn", "mx", "ro", "bin", "act")


def _location_kernel(pdf: pd.DataFrame, carry: dict) -> pd.DataFrame:
    keys = pdf["inventory_id"].to_numpy()
    cmds = pdf["command"].to_numpy()
    cols = {c: pdf[c].to_numpy(dtype=object) for c in
            ("quantity", "new_min", "new_max", "new_reorder", "new_bin", "o_on_hand", "o_reserved", "o_min", "o_max",
             "o_reorder", "o_bin", "o_active", "o_exists")}
    n = len(pdf)
    rows = []
    cur = carry.get("key")
    s = carry.get("s")

    def num(v):
        return None if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NA else int(v)

    for i in range(n):
        if keys[i] != cur:
            cur = keys[i]
            if cols["o_exists"][i] is True or cols["o_exists"][i] == 1:
                s = dict(oh=num(cols["o_on_hand"][i]) or 0, rs=num(cols["o_reserved"][i]) or 0,
                         mn=num(cols["o_min"][i]), mx=num(cols["o_max"][i]), ro=num(cols["o_reorder"][i]),
                         bin=cols["o_bin"][i], act=bool(cols["o_active"][i]))
            else:
                s = None
        c, why, note = cmds[i], None, None
        if s is None:
            why = "location_not_found"
        elif c in ("receive", "reserve", "release", "issue", "adjust", "adjust_by"):
            why, s["oh"], s["rs"] = _step(c, num(cols["quantity"][i]), s["oh"], s["rs"])
        elif c == "set_levels":
            mn, mx, ro = num(cols["new_min"][i]), num(cols["new_max"][i]), num(cols["new_reorder"][i])
            if mn is None or mx is None or ro is None:
                why = "levels_required"
            elif mn < 0:
                why = "negative_minimum"
            elif mx < mn:
                why = "maximum_below_minimum"
            elif ro < 0:
                why = "negative_reorder"
            else:
                s["mn"], s["mx"], s["ro"] = mn, mx, ro
        elif c == "move_bin":
            nb = cols["new_bin"][i]
            if nb is None or (isinstance(nb, float) and np.isnan(nb)) or str(nb).strip() == "":
                why = "bin_required"
            else:
                note = f"Moved from {s['bin']} to {nb}"
                s["bin"] = nb
        elif c == "deactivate":
            if s["oh"] > 0:
                why = "stock_on_hand"
            elif s["rs"] > 0:
                why = "stock_reserved"
            else:
                s["act"] = False
        else:
            why = "unknown_command"
        st = s or {}
        rows.append((why, st.get("oh"), st.get("rs"), st.get("mn"), st.get("mx"), st.get("ro"), st.get("bin"),
                     st.get("act"), note))
    carry.update(key=cur, s=s)
    out = pdf[["inventory_id", "command_id", "ts", "command"]].copy()
    res = pd.DataFrame(rows, columns=["reason", "on_hand", "reserved", "minimum_stock_level", "maximum_stock_level",
                                      "reorder_quantity", "bin_location", "is_active", "ledger_note"])
    out["accepted"] = res["reason"].isna().to_numpy()
    for col in res.columns:
        out[col] = res[col].to_numpy()
    for col in ("on_hand", "reserved"):
        out[col] = pd.array(out[col], dtype="Int64")
    for col in ("minimum_stock_level", "maximum_stock_level", "reorder_quantity"):
        out[col] = pd.array(out[col], dtype="Int32")
    out["is_active"] = pd.array(out["is_active"], dtype="boolean")
    return out


def create_locations(requests: DataFrame, inv: DataFrame, key: tuple[str, str] = ("part_id", "warehouse"),
                     seq: tuple[str, ...] = ("work_order_id", "line_no")) -> DataFrame:
    """New locations for requested (part, warehouse) pairs not stocked yet (K2 admit-new rule).

    Requests carry ``inventory_id, part_id, warehouse, bin_location, minimum_stock_level,
    maximum_stock_level``; the stored reorder quantity starts as max - min; stock starts at 0.
    """
    from stockflow.operators.quality import admit_new
    fresh = admit_new(requests, inv, list(key), list(seq))
    return fresh.select("inventory_id", "part_id", "warehouse", "bin_location",
                        F.lit(0).alias("quantity_on_hand"), F.lit(0).alias("quantity_reserved"),
                        "minimum_stock_level", "maximum_stock_level",
                        (F.col("maximum_stock_level") - F.col("minimum_stock_level")).alias("reorder_quantity"),
                        F.lit(True).alias("is_active"))


def apply_location_commands(inv: DataFrame, cmds: DataFrame) -> DataFrame:
    """Stock and location commands per location in order, one result row per command.

    Besides the stock commands of W2: ``set_levels`` (new_min, new_max, new_reorder;
    min >= 0, max >= min, reorder >= 0), ``move_bin`` (new_bin; recorded as an
    Adjustment of 0 with a "Moved from .. to .." note) and ``deactivate`` (only at
    0 on hand and 0 reserved). Commands for an unknown location are rejected.
    """
    for c, t in (("quantity", "int"), ("new_min", "int"), ("new_max", "int"), ("new_reorder", "int"),
                 ("new_bin", "string")):
        if c not in cmds.columns:
            cmds = cmds.withColumn(c, F.lit(None).cast(t))
    snap = inv.select("inventory_id", F.col("quantity_on_hand").cast("bigint").alias("o_on_hand"),
                      F.col("quantity_reserved").cast("bigint").alias("o_reserved"),
                      F.col("minimum_stock_level").alias("o_min"), F.col("maximum_stock_level").alias("o_max"),
                      F.col("reorder_quantity").alias("o_reorder"), F.col("bin_location").alias("o_bin"),
                      F.col("is_active").alias("o_active"), F.lit(True).alias("o_exists"))
    j = cmds.join(snap, "inventory_id", "left").withColumn("o_exists", F.coalesce("o_exists", F.lit(False)))
    return sorted_fold(j, ["inventory_id"], ORDER, _location_kernel, LOCATION_SCHEMA)
