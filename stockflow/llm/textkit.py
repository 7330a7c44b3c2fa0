"""Vectorised byte, word and hash kernels over Arrow text columns.

All kernels run inside Spark tasks on one slice of an Arrow batch. A slice holds whole rows
and about ``SLICE_BYTES`` of text (one longer text is a slice of its own), so the temporary
arrays stay a fixed multiple of the slice, whatever the batch holds. Null texts read as empty.

Word hashes are polynomial hashes modulo 2**64 over a random 64-bit value per byte, taken from
one prefix sum per chunk, then mixed; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
CHUNK = 1 << 18
U64 = np.uint64
_MASK = (1 << 64) - 1

#: byte classes of the two word rules
SPACE_SEPARATED = np.ones(256, dtype=bool)          # [^\x20\x09-\x0D]+
SPACE_SEPARATED[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)                   # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x41:0x5B] = True                             # A-Z count as a-z
ALNUM[0x80:] = True


def splitmix(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit values from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that every bit of a hash depends on all input bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


_EXACT = splitmix(256, 11)
_LOWER = _EXACT.copy()
_LOWER[0x41:0x5B] = _LOWER[0x61:0x7B]
_P = 0x9E6C63D0876A9A35 | 1
_PINV = pow(_P, -1, 1 << 64)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n (n is at most one chunk and a bit)."""
    have = _POW.get(0)
    if have is None or len(have[0]) < n:
        def table(base: int) -> np.ndarray:
            out = np.ones(n, dtype=U64)
            out[1:] = U64(base)
            return np.multiply.accumulate(out)
        with np.errstate(over="ignore"):
            _POW[0] = have = (table(_P), table(_PINV))
    return have


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """S with S[e] - S[s] = the polynomial of bytes s..e-1 (see ``span_hash``). data: one chunk."""
    up, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((_LOWER if lower else _EXACT)[data] * up[: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hash of each byte span [start, end) of the chunk behind S."""
    _, down = powers(len(s))
    with np.errstate(over="ignore"):
        return mix((s[end] - s[start]) * down[start] + (end - start).astype(U64))


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset: col.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off
    return np.frombuffer(data, dtype=np.uint8)[off[0]: off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def batch_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """(rows of the slice, its bytes, its offsets) of each slice of a batch."""
    i = batch.schema.get_field_index(column)
    data, off = text_buffers(batch.column(i))
    for a, b in slices(off, most):
        yield batch.slice(a, b - a), data[off[a]: off[b]], off[a: b + 1] - off[a]


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, side="right") - 1
    return start, end, row


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word, chunk by chunk."""
    out = np.empty(len(start), dtype=U64)
    i, n = 0, len(start)
    while i < n:
        base = int(start[i])
        j = int(np.searchsorted(end, base + CHUNK, side="right"))
        if j == i:                                   # one word longer than a chunk
            h = 0
            for p in range(base, int(end[i]), CHUNK):
                q = min(p + CHUNK, int(end[i]))
                s = prefix_hash(data[p:q], lower)
                h = (h * 0x100000001B3 + int(s[-1]) + (q - p)) & _MASK
            out[i] = mix(np.array([h], dtype=U64))[0]
            i += 1
            continue
        s = prefix_hash(data[base: int(end[j - 1])], lower)
        out[i:j] = span_hash(s, start[i:j] - base, end[i:j] - base)
        i = j
    return out


def shingle_hashes(wh: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(wh) - k + 1 of them), order-sensitive."""
    n = len(wh) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=U64)
        for i in range(k):
            h = h * U64(0xD6E8FEB86659FD93) + wh[i: i + n]
        return mix(h + U64(k))


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in a bitmap (see ``frames.bitmap``)."""
    slot = h & h.dtype.type(len(bits) * 8 - 1)
    return (bits[(slot >> h.dtype.type(3)).astype(np.int64)] >> (slot & h.dtype.type(7)).astype(np.uint8)) & 1 == 1


def row_counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def run_offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def list_array(flat: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat, type=kind))


def union_length(start: np.ndarray, end: np.ndarray) -> int:
    """Positions covered by half-open intervals."""
    if len(start) == 0:
        return 0
    s, e = merge(start, end)
    return int((e - s).sum())


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open intervals; touching intervals join."""
    if len(start) == 0:
        return start, end
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate(end[o])
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], np.append(e[at[1:] - 1], e[-1])
