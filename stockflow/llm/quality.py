"""Quality rules: exact base rules, then the hashed n-gram log-likelihood ratio of each document.

Two multinomials over ``BUCKETS`` hashed byte n-grams are counted: the trusted target (all documents that
the labels call good) and the raw corpus (all documents); neither is sampled. A document's score is the mean over its n-grams of
log p_target - log p_raw. The ratios are rounded to 1/65536 and summed as integers, so a score doesn't
depend on how the input is split, and every document is kept or dropped by the same threshold.

Base rules count words ``[^\\x20\\x09-\\x0D]+``, code points in words, signs, repeated lines and words in
8-word windows that occur more than once in the text, all on whole texts.

Defined cases: a null text has no words (every count 0, base_failed); a text shorter than an n-gram
has score 0; without any trusted document all ratios are 0 and the base rules alone decide; rows are
answered one by one, so repeated rows and ids repeat; labels with null or repeated ids count once.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockflow.llm import counters, textkit as tk
from stockflow.llm.frames import BROADCAST_ROWS

BUCKETS = 1 << 16
ORDER = 4
WINDOW = 8
THRESHOLD = -0.1
SCALE = 65536

_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b"#*$%&|<>")] = True
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def buckets(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (the last order - 1 bytes start none)."""
    n = max(len(data) - order + 1, 0)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=tk.U64)
        for i in range(order):
            h = h * tk.U64(0xD6E8FEB86659FD93) + tk._EXACT[data[i: i + n]]
    return (tk.mix(h) >> tk.U64(48)).astype(np.int64)


def inside(off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Which n-gram starts of the joined texts stay inside their own text."""
    ok = np.ones(max(int(off[-1]) - order + 1, 0), dtype=bool)
    for i in range(1, order):
        at = off[1:-1] - i
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    off = np.minimum(off, len(values))
    return total[off[1:]] - total[off[:-1]]


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entries have an equal one, which have an equal one before them)."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    any_, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    any_[order[1:]] = same
    later[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    start, end, row = tk.words(data, off, tk.SPACE_SEPARATED)
    n_words = tk.row_counts(row, n)
    in_word = tk.SPACE_SEPARATED[data]
    salt = tk.splitmix(max(n, 1), 7)
    # repeated lines: equal whole lines of one text that have a word
    ls, le, lrow = tk.words(data, off, _LINE)
    words_before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(in_word, out=words_before[1:])
    real = words_before[le] > words_before[ls]
    ls, le, lrow = ls[real], le[real], lrow[real]
    _, later = _repeats(tk.mix(tk.word_hashes(data, ls, le) ^ salt[lrow]))
    # words in windows that occur more than once in the text
    wh = tk.word_hashes(data, start, end)
    at = np.flatnonzero(row[WINDOW - 1:] == row[: len(row) - WINDOW + 1]) if len(row) >= WINDOW else np.zeros(0, np.int64)
    again, _ = _repeats(tk.mix(tk.shingle_hashes(wh, WINDOW)[at] ^ salt[row[at]]))
    cover = np.zeros(len(row) + 1, dtype=np.int64)
    hit = at[again]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": n_words,
        "word_chars": _sums(in_word & ((data & 0xC0) != 0x80), off),
        "n_symbols": _sums(_SIGN[data], off),
        "n_dup_lines": tk.row_counts(lrow[later], n),
        "n_repeat_words": tk.row_counts(row[covered], n),
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(2 * BUCKETS, dtype=np.int64)
    for batch in batches:
        for rows, data, off in tk.batch_slices(batch, "text"):
            ok = inside(off)
            b = buckets(data)
            counts[:BUCKETS] += np.bincount(b[ok], minlength=BUCKETS)
            target = np.repeat(rows.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(off))[: len(b)]
            counts[BUCKETS:] += np.bincount(b[ok & target], minlength=BUCKETS)
    yield from counters.emit(counts)


def likelihood_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Rounded log ratios of the buckets; counts cover all documents and all trusted ones. The trusted ids are
    broadcast only when a count has shown them to be few."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("t")).distinct()
    if trusted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        trusted = F.broadcast(trusted)
    flagged = (docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("t"), "left")
               .select("text", F.col("t").isNotNull().alias("target")))
    counts = counters.summed(flagged.mapInArrow(_count, counters.SPEC), 2 * BUCKETS)
    raw, target = counts[:BUCKETS].astype(np.float64), counts[BUCKETS:].astype(np.float64)
    if not target.sum():
        return np.zeros(BUCKETS, dtype=np.int64)
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    return np.round(ratio * SCALE).astype(np.int64)


def _rate(ratios, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = ratios.value
        for batch in batches:
            for rows, data, off in tk.batch_slices(batch, "text"):
                c = base_counts(data, off)
                ok = inside(off)
                total = _sums(np.where(ok, weight[buckets(data)], 0), off)
                grams = _sums(ok, off)
                failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
                kept = ~failed & (total >= int(round(threshold * SCALE)) * grams)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *(pa.array(c[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                     pa.array(failed), pa.array(kept), pa.array(total / SCALE / np.maximum(grams, 1), pa.float64())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])
    return run


def rate_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base_failed, kept and the length-normalised score of every row of docs."""
    ratios = docs.sparkSession.sparkContext.broadcast(likelihood_ratios(docs, labels))
    spec = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, base_failed boolean, kept boolean, score double")
    return docs.select("doc_id", "text").mapInArrow(_rate(ratios, threshold), spec)
