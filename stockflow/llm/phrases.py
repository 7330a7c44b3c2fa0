"""Phrase collocation mining: multikey three-way quicksort of suffix pointers, routed by leading words.

A text is lower-cased (A-Z only), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``. Every word opens a suffix of at most ``longest`` words inside its piece.

1. *Leading words.* One pass counts words and word pairs by 64-bit hash, further ones the runs of three and more words
   whose parts are frequent; those seen ``least`` times or more mark bitmaps of fixed size (a false mark costs
   work, never a result). A phrase can only be frequent if all its parts are, so a suffix pointer ends where the
   marks end.
2. *Routing.* Pointers go, added up in their task with their weights (a few tasks per core read the texts, so that equal
   pointers meet early, and heavy ones are held longest), to the task of their two leading words. Pairs seen ``HOT_PAIR`` times or more are routed by three words, so that a hot pair is
   spread; their two-word counts are summed from the parts.
3. *Sorting.* Each task sorts the pointers of whole routes by multikey three-way quicksort on (language, word 1,
   word 2, ...): a partition is split into less, equal and greater at one word position, and only the
   equal part goes on to the next position. The weight of an equal part is the count of the phrase it
   spells; parts below ``least`` are abandoned at once.
4. *Scores.* A candidate (2 to ``longest`` words) is cut after each word, the cuts' parts are looked up among the
   counts (parts of a frequent phrase are frequent), and the lowest score counts. Candidates that lie
   inside a longer one with nearly the same count go. The first ``top`` of each language are returned.

Defined cases: null and empty texts have no words; a null language counts as ``und`` (with texts that say
``und``); repeated rows count as often as they stand; ties in score and count are ranked by the phrase's
UTF-8 bytes; empty tables give an empty result. Only text and lang are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from stockflow.llm import textkit as tk
from stockflow.llm.frames import bitmap, stored
from stockflow.session import ship_package

LEAST, LONGEST, TOP = 30, 4, 2000
SLOTS = 1 << 25                      # bits of the bitmap of frequent words and pairs
HOT_SLOTS = 1 << 20                  # bits of the bitmap of hot pairs
HOT_PAIR = 1 << 17                   # a pair seen as often is routed by three words
HELD_ROWS = 1 << 20                  # pointers that a task holds to add them up
CHUNK_ROWS = 1 << 17                 # pointers that are sorted together (whole routes)
POINTER_WAVES = 2                    # tasks per core that make pointers: the more texts one reads, the more equal ones it adds up
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Slice:
    """Words of one slice of texts: hashes that carry the language, and how many words may follow in the piece."""

    def __init__(self, langs: list[str], data: np.ndarray, off: np.ndarray):
        self.data = data
        self.start, self.end, self.row = tk.words(data, off, _WORD)
        self.names = sorted(set(langs))
        code = {x: i for i, x in enumerate(self.names)}
        self.lang = np.array([code[x] for x in langs], dtype=np.int64)[self.row]
        raw = [x.encode() for x in self.names]
        at = tk.run_offsets([len(x) for x in raw])
        seeds = tk.word_hashes(np.frombuffer(b"".join(raw) or b" ", dtype=np.uint8), at[:-1], at[1:])
        with np.errstate(over="ignore"):
            self.hash = tk.mix(tk.word_hashes(data, self.start, self.end, lower=True) + tk.mix(seeds + tk.U64(1))[self.lang])
        breaks = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_BREAK[data], out=breaks[1:])
        piece = breaks[self.start]
        self.joined = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])     # word i and i + 1 share a piece

    def runs(self, m: int) -> np.ndarray:
        """Hash of the m words from each word on (0 where there are fewer)."""
        out = np.zeros(len(self.hash), dtype=tk.U64)
        h = tk.shingle_hashes(self.hash, m)
        out[: len(h)] = h
        return out

    def strings(self, at: np.ndarray, m: np.ndarray) -> pa.Array:
        """The m[j] words from word at[j] on, lower-cased and joined by one space."""
        size = self.end - self.start + 1
        off = tk.run_offsets(size)
        text = np.append(_LOWER[self.data], np.uint8(32))[_spread(self.start, size)]
        text[off[1:] - 1] = 32
        first, length = off[at], off[at + m] - off[at] - 1
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(tk.run_offsets(length).tobytes()),
                                                                  pa.py_buffer(text[_spread(first, length)].tobytes())])


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all spans one after another."""
    off = tk.run_offsets(size)
    return np.repeat(start - off[:-1], size) + np.arange(off[-1])


def _slices(batch: pa.RecordBatch) -> Iterator[Slice]:
    for rows, data, off in tk.batch_slices(batch, "text"):
        yield Slice(rows.column(rows.schema.get_field_index("lang")).to_pylist(), data, off)


def _counted(keys: np.ndarray, pair: bool) -> Iterator[pa.RecordBatch]:
    key, count = np.unique(keys, return_counts=True)
    if len(key):
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64)),
                                          pa.array(np.full(len(key), pair))], names=["key", "c", "pair"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count, is pair) of the words and pairs of each slice."""
    for batch in batches:
        for s in _slices(batch):
            yield from _counted(tk.mix(s.hash), False)
            yield from _counted(s.runs(2)[:-1][s.joined] if len(s.hash) else s.hash, True)


def _reach(s: Slice, marks: list[np.ndarray], longest: int) -> np.ndarray:
    """How many words from each word on may be a frequent phrase; marks[m - 2] holds the runs of m words (and words)."""
    n = len(s.hash)
    reach = np.ones(n, dtype=np.int64)
    for m in range(2, min(longest, len(marks) + 1) + 1):
        further = np.zeros(n, dtype=bool)
        further[: n - 1] = s.joined & (reach[:-1] >= m - 1) & (reach[1:] >= m - 1)
        reach[further & tk.marked(marks[m - 2], s.runs(m))] = m
    return reach


def _count_runs(marks, m: int):
    """(hash, count, false) of the runs of m words whose parts are marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _slices(batch):
                if len(s.hash) >= m:
                    reach = _reach(s, marks.value, m - 1)
                    at = np.flatnonzero(s.joined & (reach[:-1] == m - 1) & (reach[1:] == m - 1))
                    yield from _counted(s.runs(m)[at], False)
    return run


POINTER = "lang string, route long, deep boolean, words int, phrase string, c long"


class Held:
    """Pointers of one task, added up before they are handed on; at most about ``most`` are held.

    Where too many differ, the light ones go: the heavy ones stay, as they will be met again."""

    def __init__(self, most: int):
        self.tables: list[pa.Table] = []
        self.rows, self.most = 0, most

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.tables.append(pa.Table.from_batches([batch]))
        self.rows += len(batch)
        if self.rows > self.most:
            one = merged(pa.concat_tables(self.tables))
            if len(one) >= self.most * 3 // 4:
                c = one["c"].to_numpy()
                stay = c > np.partition(c, len(c) // 2)[len(c) // 2]
                yield from one.filter(pa.array(~stay)).combine_chunks().to_batches(max_chunksize=1 << 16)
                one = one.filter(pa.array(stay)).combine_chunks()
            self.tables, self.rows = [one], len(one)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.tables:
            yield from merged(pa.concat_tables(self.tables)).to_batches(max_chunksize=1 << 16)


FIELDS = ["lang", "route", "deep", "words", "phrase", "c"]


def merged(table: pa.Table) -> pa.Table:
    """Equal pointers added up."""
    out = table.group_by(FIELDS[:-1], use_threads=False).aggregate([("c", "sum")])
    return out.select([*FIELDS[:-1], "c_sum"]).rename_columns(FIELDS).combine_chunks()


def _pointers(bits, longest: int, held_rows: int):
    """Distinct suffix pointers of each task with weights; words: 0 all words of a language, 1 a single word."""
    def found(s: Slice, marks: list[np.ndarray], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        pair, reach = s.runs(2), _reach(s, marks, longest)
        spread = tk.marked(hot, pair)
        at, m, weight, route, far = [], [], [], [], []
        for k in range(1, longest + 1):
            own = s.runs(k) if k > 1 else tk.mix(s.hash)
            i = np.flatnonzero(reach == k) if k > 1 else np.flatnonzero(tk.marked(marks[0], own))
            _, first, count = np.unique(own[i], return_index=True, return_counts=True)
            i = i[first]
            at.append(i), m.append(np.full(len(i), k)), weight.append(count)
            lead = own if k == 1 else np.where(spread, s.runs(min(k, 3)), pair)
            route.append(lead[i]), far.append(spread[i] & (k > 1))
        at, m = np.concatenate(at), np.concatenate(m)
        names, n = pa.array(s.names, pa.string()), len(s.names)
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(np.arange(n)), pa.array([False] * n), pa.array([0] * n, pa.int32()),
             pa.array([""] * n), pa.array(np.bincount(s.lang, minlength=n).astype(np.int64))], names=FIELDS)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(s.lang[at])), pa.array(np.concatenate(route).view(np.int64)), pa.array(np.concatenate(far)),
             pa.array(m.astype(np.int32)), s.strings(at, m).cast(pa.string()), pa.array(np.concatenate(weight).astype(np.int64))], names=FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(held_rows)
        for batch in batches:
            for s in _slices(batch):
                if len(s.hash):
                    for out in found(s, *bits.value):
                        yield from held.add(out)
        yield from held.rest()
    return run


def quicksort(symbols: np.ndarray, weight: np.ndarray, free: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers (rows of symbols; -1 ends a row): (a pointer, depth, weight) of each
    prefix of ``least`` weight or more. Where ``free`` is set, prefixes up to depth 3 are parts of a whole
    that other tasks hold, too: they are never abandoned."""
    depth_most = symbols.shape[1]
    todo = [(np.arange(len(weight)), 0)]
    while todo:
        at, d = todo.pop()
        column = symbols[at, d]
        n = len(column)
        a, b, c = column[0], column[n // 2], column[n - 1]
        pivot = max(min(a, b), min(max(a, b), c))
        low, high = column < pivot, column > pivot
        for part in (low, high):
            if part.any():
                rest = at[part]
                if weight[rest].sum() >= least or (d <= 2 and free[rest].any()):
                    todo.append((rest, d))
        same = at[~(low | high)]
        if pivot < 0 or not len(same):
            continue
        total = int(weight[same].sum())
        part = d <= 2 and bool(free[same].any())
        if total < least and not part:
            continue
        if d:
            yield int(same[0]), d, total
        if d + 1 < depth_most:
            todo.append((same, d + 1))


def _mine(least: int, longest: int, chunk_rows: int):
    """Counts of phrases from pointers sorted by route; chunks hold whole routes."""
    names = ["lang", "words", "phrase", "c"]

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        single = pc.less_equal(table["words"], 1)
        plain = table.filter(single)
        if len(plain):
            sums = plain.group_by(["lang", "words", "phrase"]).aggregate([("c", "sum")]).select(["lang", "words", "phrase", "c_sum"])
            yield from sums.rename_columns(names).to_batches()
        rows = table.filter(pc.invert(single))
        if not len(rows):
            return
        parts = pc.split_pattern(rows["phrase"].combine_chunks(), " ")
        parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
        off = parts.offsets.to_numpy().astype(np.int64)
        words = pc.dictionary_encode(parts.values.slice(off[0], off[-1] - off[0]))
        code, off = words.indices.to_numpy(zero_copy_only=False).astype(np.int32), off - off[0]
        n, size = len(rows), np.diff(off)
        symbols = np.full((n, longest + 1), -1, dtype=np.int32)
        symbols[:, 0] = rows["lang"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        symbols[np.repeat(np.arange(n), size), 1 + np.arange(off[-1]) - np.repeat(off[:-1], size)] = code
        weight = rows["c"].to_numpy()
        free = rows["deep"].combine_chunks().to_numpy(zero_copy_only=False)
        found = [x for x in quicksort(symbols, weight, free, least) if x[1] > 1]
        if found:
            at, depth, total = (np.array(x) for x in zip(*found))
            first = off[at]
            take = words.dictionary.take(pa.array(code[_spread(first, depth)]))
            lists = pa.ListArray.from_arrays(pa.array(tk.run_offsets(depth).astype(np.int32)), take)
            yield pa.RecordBatch.from_arrays([rows["lang"].combine_chunks().take(pa.array(at)), pa.array(depth.astype(np.int32)),
                                              pc.binary_join(lists, " "), pa.array(total.astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, most = 0, 4 * chunk_rows
        for batch in batches:
            while batch is not None and len(batch):
                rest = None
                route = batch.column(1).to_numpy()
                if count + len(batch) >= chunk_rows:
                    turn = np.flatnonzero(route[1:] != route[:-1]) + 1
                    if held and held[-1].column(1)[-1].as_py() != route[0]:
                        turn = np.append(0, turn)
                    turn = turn[turn + count >= chunk_rows]
                    if len(turn):
                        cut = int(turn[0])
                        batch, rest = batch.slice(0, cut), batch.slice(cut)
                        held.append(batch)
                        yield from counted(pa.Table.from_batches(held))
                        held, count, most, batch = [], 0, 4 * chunk_rows, rest
                        continue
                held.append(batch)
                count += len(batch)
                batch = None
            if count > most:                     # one route larger than a chunk
                one = merged(pa.Table.from_batches(held))
                held, count, most = one.to_batches(), len(one), max(4 * chunk_rows, 2 * len(one))
        yield from counted(pa.Table.from_batches(held)) if held else ()
    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, words, phrase, f of every phrase of 1 to longest words with f >= least, and of all words of a
    language (words 0, empty phrase)."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).where("text is not null")
    seen = (texts.mapInArrow(_count, "key long, c long, pair boolean").groupBy("key", "pair").agg(F.sum("c").alias("c"))
            .where(F.col("c") >= least))
    seen = stored(seen)
    frequent, hot = bitmap(seen, "key", SLOTS), bitmap(seen.where(F.col("pair") & (F.col("c") >= HOT_PAIR)), "key", HOT_SLOTS)
    marks = [frequent]
    for m in range(3, longest + 1):
        runs = (texts.mapInArrow(_count_runs(spark.sparkContext.broadcast(marks), m), "key long, c long, pair boolean")
                .groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least))
        marks = [*marks, bitmap(runs, "key", SLOTS)]
    bits = spark.sparkContext.broadcast((marks, hot))
    read = texts.coalesce(POINTER_WAVES * max(spark.sparkContext.defaultParallelism, 1))
    pointers = read.mapInArrow(_pointers(bits, longest, HELD_ROWS), POINTER).repartition("route").sortWithinPartitions("route")
    counts = (pointers.mapInArrow(_mine(least, longest, CHUNK_ROWS), "lang string, words int, phrase string, c long")
              .groupBy("lang", "words", "phrase").agg(F.sum("c").alias("f")))
    return counts.where((F.col("words") == 0) | (F.col("f") >= least))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 scale: int = 2_000_000, inside: int = 80) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = stored(phrase_counts(docs, least, longest))
    single = counts.where("words > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ", -1)

    def part(start, size) -> F.Column:
        return F.array_join(F.slice(F.col("w"), start, size), " ")
    cand = counts.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", words.alias("w"))
    cuts = cand.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = (cuts.join(single.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(single.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    # decimals of 38 digits: the product may pass 64 bits, and the quotient is rounded down exactly
    score = F.expr(f"(cast(a as decimal(24,0)) * cast({scale} as decimal(14,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = [(i, m) for m in range(2, longest) for i in range(1, longest - m + 2)]
    longer = cand.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.filter(F.array(*[
        F.when((F.col("words") > m) & (F.col("words") >= i + m - 1), part(F.lit(i), F.lit(m))) for i, m in spans]),
        lambda x: x.isNotNull())).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(24,0)") * 100 < F.col("a").cast("decimal(24,0)") * inside))
    rank = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                                             "n", F.col("cut.score").cast("long").alias("score"))
