"""Line dedup by hashes of shortest runs of lines.

A line is a stretch up to a line feed or up to the space after a sentence end, trimmed; its hash covers the
trimmed bytes. A run of lines of at least ``min_words`` words that stands earlier (smaller doc_id, then text
key, or the same document and an earlier line) is deleted, judged on the input. A line is only deleted when an
equal line stands earlier, so the first copy of everything stays.

From every line the shortest run of at least ``min_words`` words that starts there is taken, and the shortest
that ends there: about two hashes a line. Each line of a longer repeated run lies in one of these that is a
part of the run, so what they cover is exactly what repeats, whatever stands around it. (Selecting only
window minima with one source each loses runs whose minimum is a common line.) Every run hash has its own
first document: a document loses the runs that an earlier one has, and its own repeats but the first. There
are no pairs among the copies of a group.

Run hashes are counted before documents meet, and only hashes of several documents go on. First documents are found
with partial aggregates, and the joins are on stored sides, so that a common run can be split over tasks.
Only documents that repeat something are joined with their text.

Defined cases: null and empty texts have no line and stay as they are; null doc_ids come last in the
order; repeated rows (equal id and text) count as one document and are treated alike; lines without
words equal each other and go with the run they stand in. Empty tables give an empty
result. Only doc_id and text are read; other columns are handed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from stockflow.llm import textkit as tk
from stockflow.llm.frames import by_key, fresh, stored
from stockflow.session import ship_package

MIN_WORDS = 20
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True


def split_lines(data: np.ndarray, off: np.ndarray):
    """Lines of all rows: (start, end, row, hash, words); spans cover every byte, hashes only trimmed lines."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    if n:
        cut[1:] |= data == 10
        cut[2:n + 1] |= (data[1:] == 32) & _END[data[:-1]]
    at = np.flatnonzero(cut)
    at = at if len(at) and at[-1] == n else np.append(at, n)
    start, end = at[:-1], at[1:]
    row = np.searchsorted(off, start, side="right") - 1
    ws, we, _ = tk.words(data, off, tk.SPACE_SEPARATED)
    first = np.searchsorted(ws, start)
    last = np.searchsorted(ws, end)
    count = last - first
    h = np.zeros(len(start), dtype=tk.U64)
    full = count > 0
    if full.any():
        h[full] = tk.word_hashes(data, ws[first[full]], we[last[full] - 1])
    return start, end, row, h, count


def runs(h: np.ndarray, count: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest runs of min_words words from each line on and up to each line: (start, end, hash), by start and end.

    at: offsets of the texts' lines; runs never cross texts."""
    n = len(h)
    words, i = tk.run_offsets(count), np.arange(n)
    text = np.searchsorted(at, i, side="right") - 1
    end = np.searchsorted(words, words[:-1] + min_words)
    start = np.searchsorted(words, words[1:] - min_words, side="right") - 1
    on, back = end <= at[text + 1], start >= at[text]
    both = np.unique(np.concatenate([i[on] * (n + 1) + end[on], start[back] * (n + 1) + i[back] + 1]))
    start, end = both // (n + 1), both % (n + 1)
    up, _ = tk.powers(n + 1)
    s = np.zeros(n + 1, dtype=tk.U64)
    with np.errstate(over="ignore"):
        np.cumsum(h * up[:n], out=s[1:])
    return start, end, tk.span_hash(s, start, end)


def _runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in tk.batch_slices(batch, "text"):
                _, _, row, h, count = split_lines(data, off)
                n = len(off) - 1
                at = tk.run_offsets(tk.row_counts(row, n))
                start, _, key = runs(h, count, at, min_words)
                text = row[start]
                order = np.lexsort((key, text))
                text, key = text[order], key[order]
                first = np.ones(len(key), dtype=bool)
                first[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
                again = np.zeros(n, dtype=bool)
                again[text[~first]] = True
                ends = tk.run_offsets(tk.row_counts(text[first], n))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), tk.list_array(key[first].view(np.int64), ends, pa.int64()), pa.array(again)],
                    names=["doc_id", "tkey", "keys", "again"])
    return run


def repeated_lines(h: np.ndarray, count: np.ndarray, later: np.ndarray, min_words: int) -> np.ndarray:
    """Which lines of a text to delete. later: hashes of runs that an earlier document has."""
    start, end, key = runs(h, count, np.array([0, len(h)]), min_words)
    go = np.ones(len(key), dtype=bool)
    go[np.unique(key, return_index=True)[1]] = False
    go |= np.isin(key, later)
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, start[go], 1)
    np.add.at(cover, end[go], -1)
    return np.cumsum(cover)[:-1] > 0


def _rewrite(columns: list[str], runs_column: str, removed: str, min_words: int):
    """Rows with the hashes of their later runs to rows with their new text and the number of deleted lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in tk.batch_slices(batch, "text"):
                found = rows.column(rows.schema.get_field_index(runs_column))
                texts, counts = rows.column(rows.schema.get_field_index("text")).to_pylist(), []
                for i in range(len(rows)):
                    own = data[off[i]: off[i + 1]]
                    start, end, _, h, count = split_lines(own, np.array([0, len(own)]))
                    later = np.asarray(found[i].as_py() or [], dtype=np.int64).view(tk.U64)
                    gone = repeated_lines(h, count, later, min_words)
                    if gone.any():
                        raw = own.tobytes()
                        texts[i] = b"".join(raw[x:y] for x, y, g in zip(start.tolist(), end.tolist(), gone) if not g).decode()
                    counts.append(int((gone & (count > 0)).sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()) if c == "text" else rows.column(rows.schema.get_field_index(c)) for c in columns] + [pa.array(counts, pa.int64())],
                    names=[*columns, removed])
    return run


def dedupe_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "_n_removed") -> DataFrame:
    """All rows of docs with their columns, text without later repeated runs, and the number of deleted lines
    (a column named by ``removed``; one of that name in docs is replaced). Documents that repeat nothing are
    handed through."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = stored(docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(
        _runs(min_words), f"doc_id {kind}, tkey long, keys array<long>, again boolean"))
    mark = lines.select(F.explode("keys").alias("h"), "doc_id", "tkey")
    many = stored(mark.groupBy("h").count().where("count > 1").select("h"))
    shared = stored(mark.join(many, "h").select("h", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey").alias("p")))
    source = stored(shared.groupBy("h").agg(F.min("p").alias("s"), F.max("p").alias("e")).where("s <> e").select("h", "s"))
    later = shared.join(source, "h").where("p > s").select("p.doc_id", "p.tkey", "h")
    own = lines.where("again").select("doc_id", "tkey", F.lit(None).cast("long").alias("h"))
    d, t, runs_ = fresh(docs, "d", "t", "later")
    found = stored(later.unionByName(own).groupBy(F.col("doc_id").alias(d), F.col("tkey").alias(t)).agg(F.collect_set("h").alias(runs_)))
    keys = found.select(F.col(d).alias("doc_id"), F.col(t).alias("tkey"))
    some, rest = by_key(docs, keys, "left_semi"), by_key(docs, keys, "left_anti")
    joined = some.join(found, some["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(some["text"]) == F.col(t)))
    kept = [c for c in docs.columns if c.lower() != removed.lower()]
    spec = StructType([f for f in docs.schema.fields if f.name in kept]).add(removed, "long")
    out = joined.select(*[some[c] for c in kept], runs_).mapInArrow(_rewrite(kept, runs_, removed, min_words), spec)
    return out.unionByName(rest.select(*kept, F.lit(0).cast("long").alias(removed)))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with deduplicated texts; a document that consisted of repeated runs alone goes."""
    removed, = fresh(docs, "n_removed")
    out = dedupe_lines(docs, min_words, removed)
    left = F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))) > 0
    return out.where((F.col(removed) == 0) | left).select(*docs.columns)


def line_digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_removed (lines), n_chars_left and the SHA-256 of what is left, per row."""
    text = F.coalesce("text", F.lit(""))
    return dedupe_lines(docs, min_words).select(
        "doc_id", F.col("_n_removed").alias("n_removed"),
        F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("left_sha256"))
