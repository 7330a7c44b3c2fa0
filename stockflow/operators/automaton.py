"""Ordered state machines as composed state maps, without Python and without one task per key.

A request moves a key from one of a few states to another, or is rejected and leaves it there. What a run
of requests does is therefore a map with one entry per state, and maps compose. The rows of a key are
cut into blocks of at most ``BLOCK`` rows in their order:

1. a block's map is its rows applied to every state (SQL ``aggregate`` over a short array);
2. the maps of the blocks before a block, applied to the key's opening state, give the state it starts in;
3. every block then walks its own rows from that state.

A busy key is cut by time first (``time_chunks``): its blocks are numbered and composed inside a chunk, and the
chunks' maps over a small keys x chunks table, so that no window or task holds the key's whole history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 128
CHUNK_ROWS = 50_000


def time_chunks(rows: DataFrame, key: str, ts: str, chunk_rows: int = CHUNK_ROWS) -> Column | None:
    """Number of the time chunk of a row; chunks are as narrow as the busiest key needs. None where no key holds
    more than ``chunk_rows`` rows. One aggregate job finds the width."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(micros).alias("lo"), F.max(micros).alias("hi"))
    r = per.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if r.n is None or r.n <= chunk_rows or r.hi == r.lo:
        return None
    width = max(1, (r.hi - r.lo) * chunk_rows // (2 * r.n))      # half as wide as even spacing needs
    return F.floor((micros - F.lit(r.lo)) / F.lit(width)).cast("long")


def walk(rows: DataFrame, key: str, order: list[str], symbol: str, opening: Column, states: int,
         step: Callable[[Column, Column], Column], chunk: Column | None = None, block: int = BLOCK) -> DataFrame:
    """The rows with state_before and state_after.

    ``opening`` is the key's state before its first row, the same on all rows of a key (null: the key has no state, and
    none of its rows has). ``step(state, symbol)`` is the state after one row; states are 0 to states - 1.
    ``chunk`` must grow with the order (see ``time_chunks``); without one, a key is one chunk. Null keys are one key."""
    names = rows.columns

    def moved(state: Column, x: Column) -> Column:
        return F.when(state.isNotNull(), step(state, x[symbol]))
    every = F.array(*[F.lit(s) for s in range(states)])

    def run(state: Column, items: Column) -> Column:
        return F.aggregate(items, state, moved)

    def through(maps: Column, state: Column) -> Column:
        return F.aggregate(maps, state, lambda s, m: F.get(m, s))
    group = [key] if chunk is None else [key, "_chunk"]
    inside = Window.partitionBy(*group).orderBy(*order)
    numbered = rows.withColumn("_open", opening)
    if chunk is not None:
        numbered = numbered.withColumn("_chunk", chunk)
    numbered = numbered.withColumn("_block", F.floor((F.row_number().over(inside) - 1) / block))
    item = F.struct(*order, *[c for c in names if c not in order and c != key])
    blocks = numbered.groupBy(*group, "_block").agg(F.array_sort(F.collect_list(item)).alias("_rows"), F.max("_open").alias("_open"))
    # a block's map is needed only where blocks follow
    along = Window.partitionBy(*group).orderBy("_block")
    blocks = blocks.withColumn("_last", F.lead("_block").over(along).isNull())
    blocks = blocks.withColumn("_map", F.when(~F.col("_last"), F.transform(every, lambda s: run(s, F.col("_rows")))))
    blocks = blocks.withColumn("_done", F.collect_list("_map").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.col("_open")
    if chunk is not None:
        whole = F.transform(every, lambda s: run(through(F.col("_done"), s), F.col("_rows")))
        earlier = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        starts = (blocks.where("_last").select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), F.col("_open").alias("_o"), whole.alias("_whole"))
                  .select("_k", "_c", through(F.collect_list("_whole").over(earlier), F.col("_o")).alias("_start")))
        blocks = blocks.join(starts, blocks[key].eqNullSafe(starts["_k"]) & (blocks["_chunk"] == starts["_c"]))
        start = F.col("_start")
    # a walk that appends each row's state; blocks are short
    states_of = F.aggregate(F.col("_rows"), F.array(through(F.col("_done"), start)),
                            lambda seen, x: F.concat(seen, F.array(moved(F.element_at(seen, -1), x))))
    out = (blocks.select(key, "_rows", states_of.alias("_states"))
           .select(key, F.posexplode("_rows").alias("_i", "_r"), "_states"))
    return out.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in names],
                      F.get("_states", F.col("_i")).alias("state_before"), F.get("_states", F.col("_i") + 1).alias("state_after"))


def split_busy(rows: DataFrame, key: str, most: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most ``most`` rows, rows of busier keys or None where there are none).

    The busy keys are found by a partial aggregate and told apart by joins, so they may be many."""
    busy = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_busy")).count().where(F.col("count") > most).select("_busy")
    if not busy.limit(1).count():
        return rows, None
    same = F.col(key) == F.col("_busy")
    return rows.join(busy, same, "left_anti"), rows.join(busy, same, "left_semi")


def fold_rows(rows: DataFrame, key: str, order: list[str], opening: Column, step: Callable[[Column, Column], Column],
              block: int = BLOCK) -> DataFrame:
    """One row per key: its rows in order (``items``) and what ``step`` made of each (``results``, one more: the opening).

    For states that are no small set (stock levels), where maps don't compose: ``step(result, row)`` gives the result
    of one row, a struct that holds the state after it. A key's rows are one array, walked in blocks so that
    appending stays cheap; keys of unbounded size must be kept out (``split_busy``)."""
    names = [c for c in rows.columns if c not in order and c != key]
    kept = rows.withColumn("_open", opening).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*order, *names))).alias("items"), F.first("_open").alias("_open"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / block)),
                         lambda i: F.slice(F.col("items"), (i * block + 1).cast("int"), block))

    def last(seen: Column) -> Column:
        return F.element_at(seen, -1)

    def walked(start: Column, items: Column) -> Column:
        return F.aggregate(items, F.array(start), lambda seen, x: F.concat(seen, F.array(step(last(seen), x))))
    runs = F.aggregate(blocks, F.array(F.array(F.col("_open"))), lambda done, items: F.concat(done, F.array(walked(last(last(done)), items))))
    # each run begins with the last result of the one before
    results = F.flatten(F.transform(F.col("_runs"), lambda run, i: F.when(i == 0, run).otherwise(F.slice(run, 2, F.size(run)))))
    return kept.withColumn("_runs", runs).select(key, "items", results.alias("results"))


def sums_before(rows: DataFrame, key: str, order: list[str], values: dict[str, Column], chunk: Column | None = None) -> DataFrame:
    """rows with a column per value: its sum over the key's earlier rows. With a ``chunk`` (see ``time_chunks``) the sums
    run inside (key, chunk) and take the earlier chunks' totals from a small keys x chunks table."""
    zero = F.lit(0).cast("bigint")

    def over(window, c):
        return F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), zero)
    if chunk is None:
        return rows.withColumns({n: over(Window.partitionBy(key).orderBy(*order), v) for n, v in values.items()})
    rows = rows.withColumns({"_chunk": chunk, **{f"_v_{n}": v for n, v in values.items()}})
    along = Window.partitionBy("_k").orderBy("_c")
    carry = rows.groupBy(F.col(key).alias("_k"), F.col("_chunk").alias("_c")).agg(*[F.sum(f"_v_{n}").alias(n) for n in values]).select(
        "_k", "_c", *[over(along, F.col(n)).alias(f"_t_{n}") for n in values])
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    out = rows.withColumns({n: over(inside, F.col(f"_v_{n}")) for n in values})
    out = out.join(carry, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c")))
    return out.withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in values}).drop(
        "_chunk", "_k", "_c", *[f"_v_{n}" for n in values], *[f"_t_{n}" for n in values])


def numbered(rows: DataFrame, group: list[str], first: str, ts: str, order: list[str], name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """rows with a dense number (from 1) per group, in the order of ``first`` (few values), time and ``order``.

    Rows are numbered inside (group, first, time chunk) and shifted by the counts of the parts before, a small table;
    the chunks' width comes from the largest group, so no task numbers a whole group."""
    key = F.struct(*group)
    chunk = time_chunks(rows.withColumn("_g", key), "_g", ts, chunk_rows)
    rows = rows.withColumn("_chunk", F.lit(0).cast("bigint") if chunk is None else F.coalesce(chunk, F.lit(-1).cast("bigint")))
    part = [*group, first, "_chunk"]
    sizes = rows.groupBy(*part).agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*group).orderBy(first, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)], F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_shift"))
    same = F.lit(True)
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    inside = rows.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    return inside.join(shift, same).withColumn(name, (F.col(name) + F.col("_shift")).cast("bigint")).drop("_chunk", "_shift", *[f"_p{i}" for i in range(len(part))])
