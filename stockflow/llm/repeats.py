"""Suffix-array dedup: exact removal of repeated 100-byte strings.

Every byte that a ``LENGTH``-byte string covers which also starts earlier (smaller doc_id, or the same document
and an earlier start) is removed; strings are judged on the input and never cross documents.

1. *Pieces.* Every window of LENGTH bytes has an anchor: the least-hashed GRAM-byte string inside it. Its
   bytes alone decide it, so equal windows have equal anchors at equal offsets. Neighbouring windows with one
   anchor form a piece: about one row per 26 bytes instead of one per byte.
2. *Equal pieces.* Rows are shuffled and sorted by (anchor, document, place). A streaming kernel marks
   pieces that stood before under the same anchor (all their bytes go; of a piece that one text repeats
   only the first two are sent, the rest follows) and, where an anchor has different
   pieces, the first of each: only these can hold a partial repeat.
3. *Blocks.* Such pieces are cut into blocks of up to ``BLOCK`` windows, aligned to the anchor. All windows
   of a block share a core of LENGTH - BLOCK + 1 bytes, so a block is a short string: the bytes left
   of the core, one symbol for the core, the bytes right of it.
4. *Suffix groups.* Blocks with one core are joined into one string, whose suffix array is built by the
   linear grouping construction (``suffix_array``): suffixes are grouped by Lyndon prefix in descending
   order with previous-smaller pointers, then each group's order is emitted; nothing is renamed
   recursively. Neighbours that share BLOCK symbols are equal windows; all but the first go.

A byte-level suffix array of the whole corpus would cost pure Python several microseconds a byte; steps
1 to 3 leave to it only the strings that equality of whole pieces doesn't decide (see README).

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; null doc_ids come last, ordered
by text key; rows with equal id and text are one document and get equal rows; rows with one id and different
texts are ordered by text key. Empty tables give an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stockflow.llm import textkit as tk
from stockflow.llm.frames import stored

LENGTH = 100
GRAM = 48
BLOCK = 8
CHUNK = 1 << 18
BROADCAST_ROWS = 200_000     # document keys of 16 bytes: 3 MB; more are joined by shuffle


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, span = v, 1
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(out) - (w - span)], out[w - span:])
    return out


def pieces(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with a common anchor: first window, number of windows, anchor place, anchor hash, piece hash.

    Long texts are taken in overlapping chunks; a piece that a chunk cuts is just shorter.
    """
    n = max(len(data) - length + 1, 0)
    parts = [_pieces(data[a: min(a + CHUNK, n) + length - 1], a, length, gram) for a in range(0, max(n, 1), CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def _pieces(data: np.ndarray, base: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(data) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(tk.U64), z.astype(tk.U64)
    s = tk.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    g = tk.span_hash(s, at, at + gram)
    # least high bits first, then the rightmost place
    packed = (g & tk.U64(0xFFFFFFFF00000000)) | tk.U64(0xFFFFFFFF) - at.astype(tk.U64)
    anchor = (tk.U64(0xFFFFFFFF) - (_window_min(packed, length - gram + 1) & tk.U64(0xFFFFFFFF))).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    count = np.diff(first, append=n)
    own = tk.span_hash(s, first, first + count + length - 1) ^ tk.mix((anchor[first] - first).astype(tk.U64))
    return first + base, count, anchor[first] + base, g[anchor[first]], own


def blocks(data: np.ndarray, first: int, count: int, anchor: int, gram: int) -> list[tuple[int, int, int, int, bytes, bytes]]:
    """Blocks of one piece: (core key, union key, first window, windows, left bytes, right bytes)."""
    out = []
    most = anchor - first                               # bytes before the anchor in the first window
    least = most - count + 1
    for j in range(least // BLOCK, most // BLOCK + 1):
        hi, lo = min(most, BLOCK * j + BLOCK - 1), max(least, BLOCK * j)
        a, b = anchor - BLOCK * j, anchor - BLOCK * j - BLOCK + 1 + LENGTH
        left, core, right = data[anchor - hi: a].tobytes(), data[a:b].tobytes(), data[b: anchor - lo + LENGTH].tobytes()
        key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=j.to_bytes(8, "little"), key=gram.to_bytes(8, "little")).digest(), "little", signed=True)
        out.append((key, anchor - hi, hi - lo + 1, left, right))
    return out


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of s by grouping (linear in len(s) but for sorting each group's members).

    The last symbol must be smaller than every other and occur once. Phase 1 takes the groups of suffixes in
    descending order; prev[i] is the nearest suffix before i in a lower group, and suffixes that a group's
    members point to move up, more pointers higher. What remains groups suffixes by Lyndon prefix.
    Phase 2 walks the growing array and emits each group's members in final order along prev.
    """
    n = len(s)
    order = sorted(set(s))
    members: dict[int, list[int]] = {g: [] for g in range(len(order))}
    rank = {c: g for g, c in enumerate(order)}
    group = [rank[c] for c in s]
    for i, g in enumerate(group):
        members[g].append(i)
    above = {g: g + 1 for g in members}                 # next higher group, as a linked list
    below = {g: g - 1 for g in members}
    fresh = len(order)
    top = fresh - 1
    done = [False] * n                                  # in the current group or a higher one
    prev = [-1] * n
    final = []
    g = top
    while g >= 0:
        own = members[g]
        own.sort()
        for i in own:
            done[i] = True
        points: Counter[int] = Counter()
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                points[j] += 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in points.items():
            moved.setdefault((times, group[j]), []).append(j)
        for times, h in sorted(moved, reverse=True):
            new = moved[times, h]
            up = above[h]
            above[h], below[fresh], above[fresh], below[up] = fresh, h, up, fresh
            members[fresh] = new
            for j in new:
                group[j] = fresh
            fresh += 1
        for h in {h for _, h in moved}:
            members[h] = [j for j in members[h] if group[j] == h]
        final.append(g)
        g = below[g]
        while g >= 0 and not members[g]:
            g = below[g]
    final.reverse()
    start, at = {}, 0
    for g in final:
        start[g] = at
        at += len(members[g])
    sa = [-1] * n
    placed = [False] * n
    sa[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = sa[i] - 1
        while j >= 0 and not placed[j]:
            sa[start[group[j]]] = j
            start[group[j]] += 1
            placed[j] = True
            j = prev[j]
    return sa


def repeated_windows(strings: list[tuple[int, bytes, bytes]]) -> list[list[int]]:
    """strings: (windows, left, right) of blocks with one core, in order of first start. Window numbers to remove."""
    s: list[int] = []
    owner: dict[int, tuple[int, int]] = {}
    for k, (windows, left, right) in enumerate(strings):
        for w in range(windows):
            owner[len(s) + w] = (k, w)
        s.extend(x + 3 for x in left)
        s.append(2)
        s.extend(x + 3 for x in right)
        s.append(1)
    s.append(0)
    out: list[list[int]] = [[] for _ in strings]
    last, equal = None, []

    def close() -> None:
        for k, w in sorted(equal)[1:]:
            out[k].append(w)

    for i in suffix_array(s):
        if i in owner:
            window = s[i: i + BLOCK]
            if window != last:
                close()
                last, equal = window, []
            equal.append(owner[i])
    close()
    return out


def _documents(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield data[a:b]


def _key(gram: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return tk.mix(gram) ^ piece


def _first_two(key: np.ndarray) -> np.ndarray:
    """Places of the first two entries of every key: what a text repeats further follows from them."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    keep = np.ones(len(key), dtype=bool)
    keep[order[2:][k[2:] == k[:-2]]] = False
    return np.flatnonzero(keep)


def _all_later(key: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Places of all entries that equal a listed one before them or are listed."""
    u, which = np.unique(key[whole], return_inverse=True)
    least = np.full(len(u), len(key))
    np.minimum.at(least, which, whole)
    at = np.flatnonzero(np.isin(key, u))
    return at[at >= least[np.searchsorted(u, key[at])]]


def _emit_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in tk.batch_slices(batch, "text"):
            found, places = [], []
            for d in _documents(rows, data, off):
                *_, gram, own = pieces(d)
                places.append(_first_two(_key(gram, own)))
                found.append((gram[places[-1]], own[places[-1]]))
            n = np.array([len(p) for p in places])
            take = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(np.concatenate([f[1] for f in found]).view(np.int64)),
                 rows.column(0).take(take), rows.column(1).take(take), pa.array(np.concatenate(places).astype(np.int32))],
                names=["gram", "piece", "doc", "tkey", "p"])


def _once(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without those whose key columns equal the row before: repeated rows are one document."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        same = np.ones(n - 1, dtype=bool)
        for k in keys:
            c = batch.column(k)
            a, b = c.slice(0, n - 1), c.slice(1)
            both = pc.and_(pc.is_null(a), pc.is_null(b))
            same &= pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        keep = np.concatenate([[first != last], ~same])
        last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
        yield batch if keep.all() else batch.filter(pa.array(keep))


def _mark_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, doc, tkey, p) to (doc, tkey, p, whole): whole pieces seen before, and firsts of
    anchors with several pieces. Only the current anchor's distinct pieces are held."""
    gram, seen, waiting = None, set(), None
    for batch in _once(batches, (0, 2, 3, 4)):
        g, piece = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(g):
            continue
        edge = np.flatnonzero(np.diff(g)) + 1
        at = np.concatenate([[0], edge, [len(g)]])
        take: list[int] = []
        whole: list[bool] = []
        early: list[tuple] = []
        big = np.flatnonzero((np.diff(at) > 1) | (at[:-1] == 0) | (at[1:] == len(g)))
        for r in big.tolist():
            a, b = int(at[r]), int(at[r + 1])
            if gram is None or g[a] != gram:
                gram, seen, waiting = g[a], set(), None
            for i in range(a, b):
                x = int(piece[i])
                if x in seen:
                    take.append(i)
                    whole.append(True)
                    continue
                seen.add(x)
                if len(seen) == 1:
                    waiting = (batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()) if b == len(g) else i
                    continue
                if waiting is not None:
                    if isinstance(waiting, tuple):
                        early.append(waiting)
                    else:
                        take.append(waiting)
                        whole.append(False)
                    waiting = None
                take.append(i)
                whole.append(False)
        if take:
            rows = pa.array(take)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(rows), batch.column(3).take(rows), batch.column(4).take(rows), pa.array(whole)],
                                             names=["doc", "tkey", "p", "whole"])
        if early:
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in early], batch.column(2).type), pa.array([e[1] for e in early], pa.int64()),
                                              pa.array([e[2] for e in early], pa.int32()), pa.array([False] * len(early))], names=["doc", "tkey", "p", "whole"])


def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in tk.batch_slices(batch, "text"):
            out: list[tuple] = []
            for d, doc, tkey, hard in zip(_documents(rows, data, off), rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                first, count, anchor, gram, _ = pieces(d)
                for p in hard:
                    out += [(core, doc, tkey, at, n, left, right)
                            for core, at, n, left, right in blocks(d, int(first[p]), int(count[p]), int(anchor[p]), int(gram[p]))]
            if out:
                kinds = [pa.int64(), rows.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(7)],
                                                 names=["core", "doc", "tkey", "at", "n", "left", "right"])


def _group_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (core, doc, tkey, at) to removed stretches (doc, tkey, start, end)."""
    core, firsts, distinct = None, {}, []
    out: list[tuple] = []

    def close() -> None:
        if len(distinct) > 1:
            for (doc, tkey, at, *_), gone in zip(distinct, repeated_windows([d[3:] for d in distinct])):
                out.extend((doc, tkey, at + w, at + w + LENGTH) for w in gone)

    kind = None
    for batch in _once(batches, (0, 1, 2, 3)):
        kind = batch.schema.field(1).type
        for c, *row in zip(*(x.to_pylist() for x in batch.columns)):
            if c != core:
                close()
                core, firsts, distinct = c, {}, []
            doc, tkey, at, n, left, right = row
            if (n, left, right) in firsts:
                out.append((doc, tkey, at, at + n - 1 + LENGTH))
            else:
                firsts[n, left, right] = True
                distinct.append((doc, tkey, at, n, left, right))
        if len(out) > 50_000:
            yield _stretches(out, kind)
            out = []
    close()
    if out:
        yield _stretches(out, kind)


def _stretches(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(4)], names=["doc", "tkey", "s", "e"])


def _cut_column():
    @F.pandas_udf("struct<n_removed:long,n_spans:long,kept:binary>")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        """What is left of a text without its whole pieces and removed stretches."""
        for texts, wholes, stretches in parts:
            rows = []
            for text, whole, some in zip(texts, wholes, stretches):
                raw = (text or "").encode()
                data = np.frombuffer(raw, dtype=np.uint8)
                start, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                if whole is not None and len(whole):
                    first, count, _, gram, own = pieces(data)
                    whole = _all_later(_key(gram, own), np.asarray(whole))
                    start.append(first[whole])
                    end.append(first[whole] + count[whole] + LENGTH - 1)
                if some is not None and len(some):
                    start.append(np.array([x["s"] for x in some]))
                    end.append(np.array([x["e"] for x in some]))
                s, e = tk.merge(np.concatenate(start), np.concatenate(end))
                at = np.concatenate([[0], np.column_stack([s, e]).ravel(), [len(raw)]]).tolist()
                rows.append((int((e - s).sum()), len(s), b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2]))))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])
    return cut


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("tkey"), "text")
    order = [F.col("doc").asc_nulls_last(), F.col("tkey")]
    rows = texts.mapInArrow(_emit_pieces, f"gram long, piece long, doc {kind}, tkey long, p int")
    marked = rows.repartition("gram").sortWithinPartitions("gram", *order, "p").mapInArrow(
        _mark_equal, f"doc {kind}, tkey long, p int, whole boolean")
    found = stored(marked.groupBy("doc", "tkey").agg(
        F.collect_set(F.when(F.col("whole"), F.col("p"))).alias("whole"), F.collect_set(F.when(~F.col("whole"), F.col("p"))).alias("hard")))
    hard = found.where(F.size("hard") > 0)
    spans = stored(_with(texts, hard).select("doc", "tkey", "hard", "text").mapInArrow(
        _emit_blocks, f"core long, doc {kind}, tkey long, at long, n int, left binary, right binary")
        .repartition("core").sortWithinPartitions("core", *order, "at")
        .mapInArrow(_group_blocks, f"doc {kind}, tkey long, s long, e long")
        .groupBy("doc", "tkey").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    whole = found.where(F.size("whole") > 0).select("doc", "tkey", "whole")
    both = whole.join(spans.withColumnsRenamed({"doc": "d", "tkey": "t"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "full")
    cut = stored(both.select(F.coalesce("doc", "d").alias("doc"), F.coalesce("tkey", "t").alias("tkey"), "whole", "spans"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    touched = _with(texts, cut).select("doc", size.alias("n_bytes"), _cut_column()("text", "whole", "spans").alias("c"))
    rest = _without(texts, cut)
    return (touched.select(F.col("doc").alias("doc_id"), "n_bytes", "c.n_removed", "c.n_spans", "c.kept")
            .unionByName(rest.select(F.col("doc").alias("doc_id"), size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                     F.lit(0).cast("long").alias("n_spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))))


def _keys(found: DataFrame) -> DataFrame:
    keys = found.select(F.col("doc").alias("d"), F.col("tkey").alias("t"))
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def _same(texts: DataFrame):
    return texts["doc"].eqNullSafe(F.col("d")) & (texts["tkey"] == F.col("t"))


def _with(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Texts of the documents in found with its columns; only these are shuffled while the keys are few."""
    some = texts.join(_keys(found), _same(texts), "left_semi")
    side = found.withColumnsRenamed({"doc": "d", "tkey": "t"})
    return some.join(side, some["doc"].eqNullSafe(side["d"]) & (some["tkey"] == side["t"]))


def _without(texts: DataFrame, found: DataFrame) -> DataFrame:
    return texts.join(_keys(found), _same(texts), "left_anti")


def repeat_digest(docs: DataFrame) -> DataFrame:
    """remove_repeats with the SHA-256 of the kept bytes in their place."""
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
