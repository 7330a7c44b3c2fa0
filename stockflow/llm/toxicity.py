"""Toxicity by compression distance: one zstandard dictionary of toxic and one of ordinary text.

Fit (on a bounded sample of labelled rows, ``max_toxic`` and ``max_ordinary`` rows with the least hash of
their id, never from the held-out fold):

* Labels mark documents, not passages. The toxic sample text is therefore cut to the words that
  hold a letter n-gram found far more often in toxic than in ordinary documents (a two-proportion
  z-test on document counts); the ordinary sample text is the rest. One dictionary is trained on each.
* A second part of the sample calibrates: logistic regression on the window statistics below, moved so that
  the threshold 0.5 misses at most ``MISSED`` of its toxic texts if that flags at most ``FLAGGED`` of its
  ordinary ones.

Score (every whole text): windows are words of at most ``WINDOW`` letters. Each distinct window is
compressed once with either dictionary, behind a carrier that its dictionary holds in full (a window
alone is too short for the compressor to bother), giving lengths ``o`` and ``t`` without the carrier. A
window's gain is o - 2 t and its saving o - t. The document's statistics are its two highest
gains and savings over distinct windows and the logarithm of their number; the calibrated logistic
function maps them to a score from 0 to 1, the threshold is 0.5.

Nothing but the text enters a score. Defined cases: null and empty texts have no window and get the
score of a text whose windows all cost most (low, not undefined); labels that are null are skipped, a doc_id
with several labels counts once, toxic if any says so; without labelled rows of both kinds every score is the
share of toxic rows seen (0 if none); repeated rows are scored alike; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockflow.session import ship_package

MAX_TOXIC, MAX_ORDINARY = 2_000, 4_000
WINDOW = 24
GRAM = 5
CARRIER = 40
CACHE = 300_000
FLOOR = -12
MISSED, FLAGGED = 0.06, 0.025        # shares of the calibration texts that the threshold allows
TOXIC_BYTES, ORDINARY_BYTES = 4096, 32768
_WORD = re.compile(r"[^\W\d_]{1,%d}" % WINDOW)


def windows(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _grams(words: set[str]) -> set[str]:
    out = set()
    for w in words:
        w = f" {w} "
        out.update(w[i: i + GRAM] for i in range(len(w) - GRAM + 1))
    return out


def marked_grams(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Letter n-grams that far more toxic than ordinary documents hold; equal texts count once."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    a, b = Counter(), Counter()
    for t in toxic:
        a.update(_grams(windows(t)))
    for t in ordinary:
        b.update(_grams(windows(t)))
    na, nb = max(len(toxic), 1), max(len(ordinary), 1)
    least = max(3, math.ceil(0.004 * na))
    out = set()
    for g, x in a.items():
        y = b[g]
        p = (x + y) / (na + nb)
        z = (x / na - y / nb) / math.sqrt(p * (1 - p) * (1 / na + 1 / nb) + 1e-12)
        if x >= least and x / na > 8 * (y + 0.5) / nb and z > min(8.0, math.sqrt(na) / 2 + 2):
            out.add(g)
    return out


def _dictionary(samples: list[bytes], size: int):
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:          # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-size:].rjust(64, b" ")


class Measure(dict):
    """window -> (gain, saving), each window compressed once while it is cached."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._coder(toxic, 13), self._coder(ordinary, 15)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}      # equal results share one object

    @staticmethod
    def _coder(content: bytes, log: int):
        import zstandard as z

        params = z.ZstdCompressionParameters(
            format=z.FORMAT_ZSTD1_MAGICLESS, window_log=log + 1, chain_log=log, hash_log=log, search_log=8, min_match=3,
            target_length=256, strategy=z.STRATEGY_BTULTRA2, write_content_size=False, write_checksum=False, write_dict_id=False)
        coder = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content), compression_params=params)
        carrier = content[-CARRIER:]
        base = len(coder.compress(carrier))
        return lambda window: len(coder.compress(carrier + window)) - base

    def __missing__(self, word: str) -> tuple[int, int]:
        raw = f" {word} ".encode()
        o, t = self.ordinary(raw), self.toxic(raw)
        if len(self) >= CACHE:
            self.clear()
        out = (o - 2 * t, o - t)
        self[word] = out = self.pairs.setdefault(out, out)
        return out

    def statistics(self, text: str | None) -> tuple[float, ...]:
        words = windows(text)
        gains = [FLOOR, FLOOR]
        savings = [FLOOR, FLOOR]
        for gain, saving in map(self.__getitem__, words):
            if gain > gains[1]:
                gains = [gain, gains[0]] if gain > gains[0] else [gains[0], gain]
            if saving > savings[1]:
                savings = [saving, savings[0]] if saving > savings[0] else [savings[0], saving]
        return (*gains, *savings, math.log1p(len(words)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: (mean, scale, weights with the constant last)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.5] * (len(w) - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(rows: list[tuple[str, int, bool]]) -> dict:
    """rows: (text, label, is calibration row). The model is two dictionaries and the logistic function."""
    rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    toxic = [r[0] for r in rows if r[1] == 1 and not r[2]]
    ordinary = [r[0] for r in rows if r[1] == 0 and not r[2]]
    if not toxic or not ordinary:
        return {"share": sum(r[1] for r in rows) / len(rows) if rows else 0.0}
    marked = marked_grams(toxic, ordinary)

    def samples(texts: list[str], want: bool) -> list[bytes]:
        out = []
        for t in texts:
            words = [w for w in _WORD.findall(t.lower()) if any(f" {w} "[i: i + GRAM] in marked for i in range(len(w) + 3 - GRAM)) == want]
            out += [s for i in range(0, len(words), 8) if len(s := f" {' '.join(words[i: i + 8])} ".encode()) >= 24]
        return out

    model = {"toxic": _dictionary(samples(toxic, True) or [b" "], TOXIC_BYTES),
             "ordinary": _dictionary(samples(ordinary, False) or [b" "], ORDINARY_BYTES)}
    measure = Measure(model["toxic"], model["ordinary"])
    held = [r for r in rows if r[2]]
    if len({r[1] for r in held}) < 2:
        held = rows
    x = np.array([measure.statistics(r[0]) for r in held], dtype=np.float64)
    label = np.array([r[1] for r in held], dtype=np.float64)
    mean, scale, w = _logistic(x, label)
    w[-1] -= cut(((x - mean) / scale) @ w[:-1] + w[-1], label)
    model["logistic"] = (mean, scale, w)
    return model


def cut(z: np.ndarray, label: np.ndarray, missed: float = MISSED, flagged: float = FLAGGED) -> float:
    """The logit that becomes 0 (score 0.5): as low as leaves ``missed`` of the toxic calibration texts below it, but not
    so low that more than ``flagged`` of the ordinary ones reach it; never above 0."""
    toxic, ordinary = np.sort(z[label == 1]), np.sort(z[label == 0])
    if not len(toxic) or not len(ordinary):
        return 0.0
    low = toxic[int(missed * len(toxic))] - 1e-9
    floor = ordinary[min(len(ordinary) - 1, int(np.ceil((1 - flagged) * len(ordinary))))] + 1e-9
    return float(min(0.0, max(low, floor)))


class Scorer:
    """Scores texts with a fitted model; one per task."""

    def __init__(self, model: dict):
        self.model = model
        self.measure = Measure(model["toxic"], model["ordinary"]) if "logistic" in model else None

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.measure is None or not texts:
            return np.full(len(texts), self.model.get("share", 0.0))
        mean, scale, w = self.model["logistic"]
        x = np.array([self.measure.statistics(t) for t in texts], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            score = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), batch.column(2)],
                                             names=["doc_id", "score", "predicted", "tkey"])
    return run


def fold(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def toxicity_model(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> dict:
    """Fit on at most max_toxic + max_ordinary labelled rows outside the held-out fold."""
    known = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(fold() != 0))
    def some(label: int, most: int) -> DataFrame:
        return known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = some(1, max_toxic).unionByName(some(0, max_ordinary)).select(F.col("doc_id").alias("_id"), "toxic")
    rows = (docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
            .select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"),
                    (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5) % 4 == 0).alias("held")))
    return fit([(r.text, r.toxic, r.held) for r in rows.collect()])


def score_documents(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """doc_id, held_out, score, predicted and tkey (64-bit key of the text) of every row."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, **limits))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
            .mapInArrow(_score(model), f"doc_id {kind}, score double, predicted int, tkey long")
            .select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted", "tkey"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """Rows of docs that the classifier doesn't call toxic, with all their columns and in one pass."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, **limits))

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(scorer(texts) < 0.5, pa.bool_()))
    return docs.mapInArrow(ordinary, docs.schema)
