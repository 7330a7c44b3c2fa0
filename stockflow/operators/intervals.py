"""Interval joins on closed periods (J10-J12) over a dyadic index, without nested loops.

Time is counted in days and cut into dyadic nodes: level k has nodes of 2**k days. A period is covered by at most two
nodes per level, so no period, however long, makes more than about 2 * ``LEVELS`` rows; an open one is
covered up to the last day of the index. A day lies in one node per level, its path.

* J11: a probe meets the periods whose cover holds a node of its path: an equi-join on (level, node), tested exactly.
  A node of a cover lies on the path at most once, so every hit comes once.
* J10: of two overlapping periods, one starts inside the other. The start of every period is a probe of the
  technician's other periods: an equi-join on (technician, level, node). A pair that starts on one day is
  taken from one side only.
* J12: a contained period starts inside its window, so the windows are covered and the distinct days on which periods
  start are probes; every period then meets the windows of its day.

Pairs of periods that don't overlap never meet beyond a day's precision, also for a technician with long or open
periods, so a busy technician costs what the result holds. Periods without an end (NULL, or the sentinel
9999-12-31) never end. The join keys are (technician, level, node): AQE splits what is still skewed.

The planner takes an exploded side to be as small as its file and would broadcast it, up to 46 rows for each one it
counted, through the driver; the index joins are therefore sort-merge joins (``_meet``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.operators.workorders import is_open

OPEN_END = "9999-12-31"
LEVELS = 23                       # days from 0001-01-01 on (3.7 million up to 9999-12-31) fit in 2**22


def _day(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("0001-01-01").cast("date")).cast("bigint")


def _path(day: Column) -> Column:
    """The nodes that hold a day, one per level, as level * 2**32 + node."""
    return F.array(*[F.lit(k << 32).cast("bigint") + F.shiftright(day, k) for k in range(LEVELS)])


def _cover(lo: Column, hi: Column) -> Column:
    """The fewest nodes that cover the days lo to hi: at each level the left end if it is odd, the right end if it is even."""
    out = []
    b = hi + 1
    for k in range(LEVELS):
        # at level k the range [a, b) shrinks to whole nodes of the next level
        left, right = F.shiftright(lo + ((1 << k) - 1), k), F.shiftright(b, k)
        base = F.lit(k << 32).cast("bigint")
        out.append(F.when((left < right) & (left % 2 == 1), base + left))
        out.append(F.when((left < right) & (right % 2 == 1), base + right - 1))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def scheduled(wo: DataFrame) -> DataFrame:
    """Orders with a scheduled period; ``p_end`` is NULL for a period that never ends."""
    end = F.when(F.col("scheduled_end") < F.lit(OPEN_END).cast("timestamp_ntz"), F.col("scheduled_end"))
    return (wo.where(F.col("scheduled_start").isNotNull())
              .select("work_order_id", "technician_id", "status", F.col("scheduled_start").alias("p_start"),
                      end.alias("p_end")))


def _covered(periods: DataFrame, start: str, end: str) -> DataFrame:
    """Periods with one row per node of their cover; periods that end before they start have none."""
    far = F.lit(OPEN_END).cast("timestamp_ntz")
    lo, hi = _day(F.col(start)), _day(F.coalesce(end, far))
    return periods.where(lo <= hi).select("*", F.explode(_cover(lo, hi)).alias("node"))


def _meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join that never sends a side through the driver."""
    return a.hint("merge").join(b.hint("merge"), keys)


def schedule_conflicts(wo: DataFrame) -> DataFrame:
    """Pairs of open orders of one technician whose scheduled periods overlap (closed ends).

    ``overlap_end`` is NULL when neither period ends.
    """
    every = scheduled(wo).where(is_open() & F.col("technician_id").isNotNull())
    x = _covered(every, "p_start", "p_end").select("technician_id", "node", F.col("work_order_id").alias("x_id"),
                                                   F.col("p_start").alias("x_start"), F.col("p_end").alias("x_end"))
    y = every.select("technician_id", F.explode(_path(_day(F.col("p_start")))).alias("node"), F.col("work_order_id").alias("y_id"),
                     F.col("p_start").alias("y_start"), F.col("p_end").alias("y_end"))
    far = F.lit(OPEN_END).cast("timestamp_ntz")
    # y starts on a day of x; where x starts on that day, too, both find each other and the smaller id keeps the pair
    same_day = F.to_date("x_start") == F.to_date("y_start")
    met = _meet(x, y, ["technician_id", "node"]).where(
        (F.col("x_id") != F.col("y_id")) & (~same_day | (F.col("x_id") < F.col("y_id")))
        & (F.col("x_start") <= F.coalesce("y_end", far)) & (F.col("y_start") <= F.coalesce("x_end", far)))
    return met.select("technician_id", F.least("x_id", "y_id").alias("work_order_id_a"), F.greatest("x_id", "y_id").alias("work_order_id_b"),
                      F.greatest("x_start", "y_start").alias("overlap_start"), F.least("x_end", "y_end").alias("overlap_end"))


def periods_containing(wo: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe time (``probe_id, probe_ts``), the orders whose period contains it."""
    p = _covered(scheduled(wo), "p_start", "p_end").select("node", "work_order_id", "p_start", "p_end")
    q = probes.select("probe_id", "probe_ts", F.explode(_path(_day(F.col("probe_ts")))).alias("node"))
    return (_meet(q, p, ["node"])
             .where((F.col("p_start") <= F.col("probe_ts")) & (F.col("p_end").isNull() | (F.col("probe_ts") <= F.col("p_end"))))
             .select("probe_id", "probe_ts", "work_order_id"))


def periods_within(wo: DataFrame, windows: DataFrame) -> DataFrame:
    """Orders whose period lies inside a window (``window_id, window_start, window_end``); a period without an end lies in none."""
    p = scheduled(wo).where(F.col("p_end").isNotNull()).select("work_order_id", "p_start", "p_end", _day(F.col("p_start")).alias("day"))
    days = p.select("day").distinct().select("day", F.explode(_path(F.col("day"))).alias("node"))
    w = _covered(windows.select("window_id", "window_start", "window_end"), "window_start", "window_end")
    return (_meet(p, _meet(days, w, ["node"]).drop("node"), ["day"])
             .where((F.col("p_start") >= F.col("window_start")) & (F.col("p_end") <= F.col("window_end")))
             .select("window_id", "window_start", "window_end", "work_order_id"))
