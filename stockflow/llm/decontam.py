"""Benchmark decontamination by a prefix-filtered set join with exact containment.

Benchmark items are cut into windows of ``window`` consecutive words (an item of fewer words is one
window). A window occurs in a document when its words stand there in a row, so containment is 1 and
the necessary prefix of a window is a single shingle: its rarest one. Rarity comes from counters over all
documents' shingles (a fixed table; ties go to the hash, then the position).

1. One pass over the documents counts their shingles.
2. Every window names its prefix shingle and the shingle's position in it.
3. A second pass looks every document shingle up in a bitmap of the prefix shingles (fixed size: it
   only thins out, the join decides) and hands on the hits with the words around them.
4. Hits and windows meet in an equi-join on the shingle. Positional and length bounds: the window has
   to start at or after the document's first word and end at or before its last. The words of
   the item-sized window are then compared exactly, as strings.
5. Hit words are the union of all occurrences per document, items are those with an occurring window.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined cases: null texts have no words, and such items no window; a null item_id counts no item, yet
its words are hit; repeated documents (equal id and text) give equal rows, rows with equal ids and other
texts are kept apart; repeated items count once per item_id. No benchmark, no documents: nothing is hit,
or no row. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stockflow.llm import counters, textkit as tk
from stockflow.llm.frames import by_key, stored
from stockflow.session import ship_package

SHINGLE = 3
SKETCH = 1 << 20
SLOTS = 1 << 24
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32


def _word_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    raw = _LOW[data[int(start[0]): int(end[-1])]].tobytes()
    base = int(start[0])
    return [raw[a - base: b - base].decode() for a, b in zip(start.tolist(), end.tolist())]


def _shingles(data: np.ndarray, off: np.ndarray, k: int):
    """(hash, word number) of each k-word shingle inside one row, and the words."""
    start, end, row = tk.words(data, off, tk.ALNUM)
    wh = tk.word_hashes(data, start, end, lower=True)
    h = tk.shingle_hashes(wh, k)
    at = np.flatnonzero(row[k - 1:] == row[: len(h)]) if len(h) else np.zeros(0, np.int64)
    return h[at], at, start, end, row


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, dtype=np.uint32)
    for batch in batches:
        for _, data, off in tk.batch_slices(batch, "text"):
            h, *_ = _shingles(data, off, SHINGLE)
            np.add.at(counts, (h & tk.U64(SKETCH - 1)).astype(np.int64), np.uint32(1))
    yield from counters.emit(counts)


def _windows(rarity, window: int):
    """Windows of the items with their prefix shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = rarity.value
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("item_id", "k", "gram", "at", "words")}
            for rows, data, off in tk.batch_slices(batch, "text"):
                start, end, row = tk.words(data, off, tk.ALNUM)
                if not len(start):
                    continue
                wh = tk.word_hashes(data, start, end, lower=True)
                text = _word_strings(data, start, end)
                first = tk.run_offsets(tk.row_counts(row, len(off) - 1)).tolist()
                items = rows.column(0).to_pylist()
                for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    k = min(SHINGLE, b - a)
                    h = tk.shingle_hashes(wh[a:b], k) if k else wh[:0]
                    rank = freq[(h & tk.U64(SKETCH - 1)).astype(np.int64)] if k == SHINGLE else np.zeros(len(h), np.int64)
                    size = min(window, b - a)
                    for w in range(a, b - size + 1) if size else ():
                        inner = slice(w - a, w - a + size - k + 1)
                        at = int(np.lexsort((h[inner], rank[inner]))[0])
                        out["item_id"].append(items[i])
                        out["k"].append(k)
                        out["gram"].append(int(h[inner][at].view(np.int64)))
                        out["at"].append(at)
                        out["words"].append(text[w: w + size])
            yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], batch.schema.field(0).type), pa.array(out["k"], pa.int32()),
                                              pa.array(out["gram"], pa.int64()), pa.array(out["at"], pa.int32()),
                                              pa.array(out["words"], pa.list_(pa.string()))], names=list(out))
    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    used = np.zeros(SLOTS, dtype=np.uint8)
    for batch in batches:
        used[batch.column(0).to_numpy() & (SLOTS - 1)] = 1
    yield from counters.emit(used)


def _probe(slots, sizes: list[int], window: int):
    """Per document: number of words and the shingles that may be a prefix, with the words around them."""
    context = pa.struct([("k", pa.int32()), ("gram", pa.int64()), ("pos", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.unpackbits(slots.value).astype(bool)
        for batch in batches:
            for rows, data, off in tk.batch_slices(batch, "text"):
                n = len(off) - 1
                hits: list[list] = [[] for _ in range(n)]
                for k in sizes:
                    h, at, start, end, row = _shingles(data, off, k)
                    hit = used[(h & tk.U64(SLOTS - 1)).astype(np.int64)]
                    base = tk.run_offsets(tk.row_counts(row, n)).tolist()
                    for g, p in zip(h[hit].view(np.int64).tolist(), at[hit].tolist()):
                        r = int(row[p])
                        a, b = max(base[r], p - window + 1), min(base[r + 1], p + window)
                        hits[r].append((k, g, p - base[r], a - base[r], _word_strings(data, start[a:b], end[a:b])))
                start, _, row = tk.words(data, off, tk.ALNUM)
                flat = [x for one in hits for x in one]
                values = pa.StructArray.from_arrays(
                    [pa.array([x[i] for x in flat], context.field(i).type) for i in range(5)], fields=list(context))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(tk.row_counts(row, n)),
                     pa.ListArray.from_arrays(pa.array(tk.run_offsets(np.array([len(x) for x in hits])).astype(np.int32)), values)],
                    names=["doc_id", "tkey", "n_words", "hits"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, tkey (64-bit key of the text), n_words, n_hit, n_items, items_sha256, contaminated per row of docs."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    rarity = spark.sparkContext.broadcast(counters.summed(texts.select("text").mapInArrow(_count, counters.SPEC), SKETCH))
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    windows = stored(benchmark.select("item_id", "text").distinct().mapInArrow(
        _windows(rarity, window), f"item_id {item_type}, k int, gram long, at int, words array<string>"))
    sizes = sorted(r.k for r in windows.select("k").distinct().collect())       # at most SHINGLE numbers
    slots = spark.sparkContext.broadcast(np.packbits(
        counters.summed(windows.select("gram").distinct().mapInArrow(_mark, counters.SPEC), SLOTS) > 0))
    probed = stored(texts.mapInArrow(
        _probe(slots, sizes, window),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tkey long, n_words long, "
        "hits array<struct<k:int,gram:long,pos:long,first:long,words:array<string>>>"))
    hits = (probed.where(F.size("hits") > 0).distinct().select("doc_id", "tkey", "n_words", F.explode("hits").alias("h"))
            .select("doc_id", "tkey", "n_words", "h.*").withColumnRenamed("words", "near"))
    w = windows.select("item_id", "k", "gram", "at", "words")
    start, size = F.col("pos") - F.col("at"), F.size("words")
    found = stored(
        hits.join(w, ["k", "gram"])
        .where((start >= 0) & (start + size <= F.col("n_words")))
        .where(F.expr("slice(near, int(pos - at - first) + 1, size(words)) = words"))
        .select("doc_id", "tkey", start.alias("s"), (start + size).alias("e"), F.col("item_id").cast("string").alias("item")).distinct())
    before = Window.partitionBy("doc_id", "tkey").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("doc_id", "tkey", "s").agg(F.max("e").alias("e"))
    spans = (spans.withColumn("done", F.coalesce(F.max("e").over(before), F.lit(0)))
             .groupBy("doc_id", "tkey").agg(F.sum(F.greatest(F.col("e") - F.greatest("s", "done"), F.lit(0))).alias("n_hit")))
    items = found.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_doc = (spans.join(items.withColumnsRenamed({"doc_id": "d", "tkey": "t"}),
                          spans["doc_id"].eqNullSafe(F.col("d")) & (spans["tkey"] == F.col("t")))
               .select(spans["doc_id"].alias("d"), F.col("t"), "n_hit", "items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return (probed.select("doc_id", "tkey", "n_words")
            .join(per_doc, probed["doc_id"].eqNullSafe(per_doc["d"]) & (probed["tkey"] == per_doc["t"]), "left")
            .select("doc_id", "tkey", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                    F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Rows of docs without any benchmark window, with all their columns."""
    bad = stored(contamination(docs, benchmark, window).where("contaminated").select("doc_id", "tkey").distinct())
    return by_key(docs, bad, "left_anti")
