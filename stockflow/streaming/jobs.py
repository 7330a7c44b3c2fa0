"""Structured Streaming jobs.

The source application dispatches events synchronously after a database
save; here the same rules run on event / command streams:

* T1 dispatch: ``foreachBatch`` routes each micro-batch to the handlers
  registered for its event types; a failing handler is logged and does not
  stop the others; types without a handler are counted.
* T2 dedupe: ``withWatermark`` + ``dropDuplicatesWithinWatermark`` on the event id.
* T3 / T7: stream-static joins (the static side is a plain DataFrame read;
  Spark re-plans it every micro-batch, so a changing dimension is picked up).
* T4 / T5: the guarded ledger and status folds per micro-batch over a state table
  (``state_table``), with the batch jobs' own SQL; inside a micro-batch each key's rows
  are applied in (time, id) order, so the stream equals the batch fold when commands
  arrive in time order. ``ledger_stream`` is T4 as one stateful operator with its state
  in buckets, for pipelines that need a streaming DataFrame.
* T6: accepted status changes -> recipients (J16) -> notification log (S7)
  through ``foreachBatch``, re-reading orders and customers per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stockflow.operators import commands as C
from stockflow.operators import ledger as L
from stockflow.sources import sinks
from stockflow.streaming.state_table import StateTable

Handler = Callable[[DataFrame, int], None]


# -- T1 ----------------------------------------------------------------------------------

def dispatch_batch(batch: DataFrame, batch_id: int, handlers: dict[str, list[tuple[str, Handler]]],
                   log_path: str, dead_letters: str | None = None) -> None:
    """Route one micro-batch: every handler of every event type present, each in its own try.

    The log of a batch replaces that batch's folder, so a retried batch is logged once. With
    ``dead_letters`` the events a handler failed on are kept there, by batch and handler.
    """
    batch = batch.persist()
    try:
        _dispatch(batch, batch_id, handlers, log_path, dead_letters)
    finally:
        batch.unpersist()


def _dispatch(batch: DataFrame, batch_id: int, handlers: dict[str, list[tuple[str, Handler]]], log_path: str, dead_letters: str | None) -> None:
    spark = batch.sparkSession
    # one small aggregate: the number of event types is bounded by the envelope's type list
    counts = {r["event_type"]: r["n"] for r in batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for etype, n in counts.items():
        hs = handlers.get(etype, [])
        if not hs:
            rows.append((batch_id, etype, None, n, "no_handler", None))
            continue
        part = batch.where(F.col("event_type") == etype)
        for name, fn in hs:
            try:
                fn(part, batch_id)
                rows.append((batch_id, etype, name, n, "ok", None))
            except Exception as e:  # noqa: BLE001 - a failing handler must not stop the others
                rows.append((batch_id, etype, name, n, "failed", f"{type(e).__name__}: {e}"))
                if dead_letters:
                    part.write.mode("overwrite").parquet(f"{dead_letters}/batch_id={batch_id}/handler={name}/type={etype}")
    if rows:
        (spark.createDataFrame([r[1:] for r in rows], "event_type string, handler string, events long, status string, error string")
              .coalesce(1).write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}"))


def start_dispatch(stream: DataFrame, handlers: dict[str, list[tuple[str, Handler]]], log_path: str,
                   checkpoint: str, available_now: bool = True, dead_letters: str | None = None):
    """Start the dispatcher; returns the StreamingQuery. ``dead_letters`` is where events of failed handlers are kept
    (beside the log unless it is named)."""
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
               .foreachBatch(lambda df, bid: dispatch_batch(df, bid, handlers, log_path, dead_letters or f"{log_path.rstrip('/')}-dead")))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def dispatch_summary(log: DataFrame) -> DataFrame:
    """Events and failures per (type, handler) over all batches of a dispatch log."""
    return (log.groupBy("event_type", "handler")
               .agg(F.sum("events").alias("events"),
                    F.count_if(F.col("status") == "failed").alias("failed_batches")))


# -- T2 ----------------------------------------------------------------------------------

def dedupe(stream: DataFrame, delay: str, id_col: str = "event_id", time_col: str = "occurred_on") -> DataFrame:
    """Each event id once while duplicates arrive within ``delay`` of the stream's event time."""
    t = stream.withColumn("_et", F.col(time_col).cast("timestamp"))
    return t.withWatermark("_et", delay).dropDuplicatesWithinWatermark([id_col]).drop("_et")


# -- T3 ----------------------------------------------------------------------------------

def low_stock_alert_stream(stream: DataFrame, parts: DataFrame) -> DataFrame:
    """Low-stock events joined to the catalog (stream-static left join) -> alert rows."""
    cat = parts.select("part_id", "part_number", "part_name", "unit_cost", "lead_time_days")
    # the envelope's own (empty) part_number gives way to the catalog's
    ev = stream.where(F.col("event_type") == "InventoryLowStockDetected").drop("part_number")
    return ev.join(cat, "part_id", "left").select(
        "event_id", "occurred_on", "inventory_id", "part_id", "part_number", "part_name", "warehouse",
        F.col("available").alias("current_quantity"), F.col("min_level").alias("minimum_stock_level"),
        F.col("reorder_qty").alias("reorder_quantity"), "unit_cost", "lead_time_days")


# -- T4 / T5 -------------------------------------------------------------------------------

LEDGER_STATE = "on_hand long, reserved long"


_OUT_COLS = ["inventory_id", "command_id", "ts", "command", "quantity", "work_order_id"]


def _ledger_state_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One location's commands of one micro-batch, applied in (ts, id) order from the stored state.

    Groups are small (one location's share of a micro-batch) and this runs once
    per group, so it works on plain lists: per-group pandas operations would
    dominate the cost.
    """
    cols = {c: [] for c in [*_OUT_COLS, "opening_on_hand", "opening_reserved"]}
    for pdf in pdfs:
        for c in cols:
            cols[c].extend(pdf[c].tolist())
    order = sorted(range(len(cols["ts"])), key=lambda i: (cols["ts"][i], cols["command_id"][i]))
    if state.exists:
        oh, rs = state.get
    else:
        oh = int(cols["opening_on_hand"][0] or 0)
        rs = int(cols["opening_reserved"][0] or 0)
    out = {c: [cols[c][i] for i in order] for c in _OUT_COLS}
    reason, ohb, rsb, oha, rsa = [], [], [], [], []
    for c, x in zip(out["command"], out["quantity"]):
        ohb.append(oh)
        rsb.append(rs)
        why, oh, rs = L._step(c, None if pd.isna(x) else int(x), oh, rs)
        reason.append(why)
        oha.append(oh)
        rsa.append(rs)
    state.update((oh, rs))
    out.update(accepted=[r is None for r in reason], reason=reason, on_hand_before=ohb, reserved_before=rsb,
               on_hand_after=oha, reserved_after=rsa)
    yield pd.DataFrame(out)


#: State keys of T4 / T5. A checkpoint belongs to one number of buckets: it is part of every key, so it is
#: a constant (or an explicit argument), never a session setting, and it is stored and checked.
STATE_BUCKETS = 256
LEDGER_BUCKET_STATE = "buckets int, ids array<bigint>, on_hand array<bigint>, reserved array<bigint>"


def _same_buckets(stored: int, now: int) -> None:
    if stored != now:
        raise ValueError(f"this checkpoint was made with {stored} state buckets, the stream now uses {now}")


def _with_buckets(fn, buckets: int):
    def run(key, pdfs, state):
        return fn(buckets, pdfs, state)
    return run


def _ledger_bucket_fn(buckets: int, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All commands of one location bucket in a micro-batch, replayed with the batch kernel.

    State holds (on hand, reserved) for every location of the bucket seen so far;
    a location's stored state replaces its opening values.
    """
    frames = list(pdfs)
    pdf = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    pdf = pdf.sort_values(["inventory_id", *L.ORDER], kind="stable").reset_index(drop=True)
    if state.exists:
        stored, ids, ohs, rss = state.get
        _same_buckets(stored, buckets)
        known_oh = pd.Series(list(ohs), index=list(ids), dtype="int64")
        known_rs = pd.Series(list(rss), index=list(ids), dtype="int64")
        seen = pdf["inventory_id"].isin(known_oh.index)
        pdf.loc[seen, "opening_on_hand"] = pdf.loc[seen, "inventory_id"].map(known_oh)
        pdf.loc[seen, "opening_reserved"] = pdf.loc[seen, "inventory_id"].map(known_rs)
    else:
        known_oh = pd.Series(dtype="int64")
        known_rs = pd.Series(dtype="int64")
    out = L._ledger_kernel(pdf, {})
    last = out.groupby("inventory_id", sort=False).tail(1).set_index("inventory_id")
    known_oh = last["on_hand_after"].astype("int64").combine_first(known_oh)
    known_rs = last["reserved_after"].astype("int64").combine_first(known_rs)
    state.update((buckets, known_oh.index.tolist(), known_oh.tolist(), known_rs.reindex(known_oh.index).tolist()))
    yield out


def ledger_stream(commands: DataFrame, opening: DataFrame | None = None, buckets: int | None = STATE_BUCKETS) -> DataFrame:
    """T4: W2 guards over a command stream; state = (on hand, reserved) per location.

    ``opening`` (``inventory_id, on_hand, reserved``) seeds a location the
    first time it is seen (stream-static left join).

    With ``buckets`` the keyed state is grouped by ``pmod(xxhash64(location), buckets)``:
    the state function runs once per bucket and micro-batch (not once per
    location), and replays the bucket's rows with the vectorised batch kernel.
    Each bucket's state holds its locations' (on hand, reserved), so its size is
    locations / buckets: choose ``buckets`` for the number of locations when a
    checkpoint is first made. A restart with another number raises; session
    settings don't matter. ``buckets=None`` keeps one state group per location.
    """
    cmds = L._with_opening(commands, opening)
    if not buckets:
        return cmds.groupBy("inventory_id").applyInPandasWithState(
            _ledger_state_fn, L.REPLAY_SCHEMA, LEDGER_STATE, "append", GroupStateTimeout.NoTimeout)
    b = cmds.withColumn("_bucket", F.pmod(F.xxhash64("inventory_id"), F.lit(buckets)))
    return b.groupBy("_bucket").applyInPandasWithState(
        _with_buckets(_ledger_bucket_fn, buckets), L.REPLAY_SCHEMA, LEDGER_BUCKET_STATE, "append", GroupStateTimeout.NoTimeout)


def ledger_batch(batch: DataFrame, batch_id: int, state: StateTable, out: str, opening: DataFrame | None = None) -> None:
    """T4 per micro-batch: W2 from each location's last state (its opening the first time it is seen).

    The batch's results replace ``out/batch_id=<n>``; the new states are read back from them, so the replay runs once.
    """
    spark = batch.sparkSession
    last = state.before(batch_id)
    if opening is not None:
        last = last.unionByName(opening.select("inventory_id", F.col("on_hand").cast("bigint").alias("on_hand"),
                                               F.col("reserved").cast("bigint").alias("reserved")).join(last, "inventory_id", "left_anti"))
    path = f"{out}/batch_id={batch_id}"
    L.replay(batch, last).write.mode("overwrite").parquet(path)
    done = L.closing(spark.read.schema(L.REPLAY_SCHEMA).parquet(path))
    state.write(done.select("inventory_id", F.col("closing_on_hand").alias("on_hand"), F.col("closing_reserved").alias("reserved")), batch_id)


def ledger_state(spark: SparkSession, path: str) -> StateTable:
    return StateTable(spark, path, "inventory_id long, on_hand long, reserved long", "inventory_id")


def status_batch(batch: DataFrame, batch_id: int, state: StateTable, out: str, wo: DataFrame) -> None:
    """T5 per micro-batch: W12 from each order's last status (the snapshot's the first time it is seen)."""
    spark = batch.sparkSession
    last = state.before(batch_id).select("work_order_id", F.col("status").alias("_now"))
    asked = batch.select("work_order_id").distinct()
    orders = wo.select("work_order_id", "status").join(asked, "work_order_id", "left_semi").join(last, "work_order_id", "left").select(
        "work_order_id", F.coalesce("_now", "status").alias("status"))
    path = f"{out}/batch_id={batch_id}"
    moved = C.apply_transitions(batch, orders)
    moved.write.mode("overwrite").parquet(path)
    done = spark.read.schema(moved.schema).parquet(path).where("accepted").groupBy("work_order_id").agg(
        F.max_by("status_after", F.struct("ts", "event_id")).alias("status"))
    state.write(done, batch_id)


def status_state(spark: SparkSession, path: str) -> StateTable:
    return StateTable(spark, path, "work_order_id long, status int", "work_order_id")


# -- T6 ----------------------------------------------------------------------------------------

def notification_batch(changes: DataFrame, load_wo: Callable[[], DataFrame], load_cust: Callable[[], DataFrame],
                       log_path: str, batch_id: int) -> None:
    """T6 per micro-batch: re-read the dimensions, build recipients (J16), write the batch's log folder."""
    rec = C.recipients(changes, load_wo(), load_cust())
    sinks.append_notifications(sinks.notification_rows(rec), log_path, batch_id)


# -- T7 ----------------------------------------------------------------------------------------

def price_event_stream(stream: DataFrame, inv: DataFrame, pct: str = "0.10") -> DataFrame:
    """Price events moving cost by more than ``pct`` -> alert rows; discontinued events ->
    one row per location still holding stock (stream-static join)."""
    old, new = F.col("old_cost"), F.col("new_cost")
    ratio = F.when(old != 0, F.abs(new - old).cast("double") / old.cast("double"))
    price = (stream.where(F.col("event_type") == "PartPriceUpdated")
                   .withColumn("cost_change_ratio", ratio)
                   .where(C.price_moved(pct))
                   .select("event_id", F.lit("price_change").alias("alert_type"), "part_id", "old_cost", "new_cost",
                           "cost_change_ratio", F.lit(None).cast("bigint").alias("inventory_id"),
                           F.lit(None).cast("string").alias("warehouse"),
                           F.lit(None).cast("int").alias("quantity_on_hand")))
    stock = inv.where(F.col("quantity_on_hand") > 0).select("part_id", "inventory_id", "warehouse",
                                                            "quantity_on_hand")
    disc = (stream.where(F.col("event_type") == "PartDiscontinued").join(stock, "part_id")
                  .select("event_id", F.lit("discontinued_stock").alias("alert_type"), "part_id",
                          F.lit(None).cast("decimal(18,2)").alias("old_cost"),
                          F.lit(None).cast("decimal(18,2)").alias("new_cost"),
                          F.lit(None).cast("double").alias("cost_change_ratio"),
                          "inventory_id", "warehouse", "quantity_on_hand"))
    return price.unionByName(disc)


def run_stream(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    from stockflow.streaming.runner import drain_to_parquet
    return drain_to_parquet(spark, stream, name)
