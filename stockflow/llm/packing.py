"""Hierarchical multi-length packing of tokenised documents.

Every document (its ids and an end id) gives whole windows of the longest tier from its start; the
rest is routed to the shortest tier that holds it. Sequences of the longest tier start with a rest of
that tier, gaps are filled from the shorter tiers (whole rests first, then one cut to size), then the
shorter tiers are packed the same way. So every sequence is exactly as long as its tier, until the
input of the task ends: what is then left (less than one longest window and a few open gaps) becomes
sequences whose lengths are powers of two, so nothing needs padding.

Packing is local to a partition: it needs no shuffle, memory is bounded by ``FLUSH`` waiting tokens, and
a lost task is packed again alike. sequence_id holds the partition and a running number. Step groups are
balanced: a group takes sequences of one tier until it holds ``step_tokens`` tokens, so each step costs
the same whatever its tier.

Defined cases: null and empty texts are a single end id; repeated rows are packed as often as they
occur; a null doc_id stays null; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stockflow.llm import textkit as tk
from stockflow.llm.tokens import encoder, tokenizer_path

TIERS = (2048, 1024, 512, 256)
FLUSH = 1 << 20
SLICE = 1 << 22       # bytes of text tokenised together


class Packer:
    """Packs rests of documents into full sequences; ``out`` gets (doc, start, ids, seq, offset, tier, group)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_sequence: int):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.waiting = {t: deque() for t in self.tiers}
        self.tokens = 0
        self.next = first_sequence
        self.step_tokens = step_tokens
        self.groups: dict[int, list[int]] = {}
        self.out: list[tuple] = []

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        top = self.tiers[0]
        whole = len(ids) // top * top
        for a in range(0, whole, top):
            self._emit([(doc, a, ids[a: a + top])], top)
        if whole < len(ids):
            self._wait((doc, whole, ids[whole:]))
            if self.tokens >= FLUSH:
                self.flush(2 * top)

    def _wait(self, piece: tuple) -> None:
        tier = min(t for t in self.tiers if t >= len(piece[2]))
        self.waiting[tier].append(piece)
        self.tokens += len(piece[2])

    def _take(self, gap: int) -> tuple:
        """A waiting piece for the gap: the longest tier whose next piece fits, else one cut to size."""
        for t in self.tiers:
            q = self.waiting[t]
            if q and len(q[0][2]) <= gap:
                self.tokens -= len(q[0][2])
                return q.popleft()
        for t in reversed(self.tiers):
            if self.waiting[t]:
                doc, start, ids = self.waiting[t].popleft()
                self.tokens -= len(ids)
                self._wait((doc, start + gap, ids[gap:]))
                return doc, start, ids[:gap]
        raise ValueError("nothing is waiting")

    def flush(self, leave: int) -> None:
        """Full sequences of each tier, longest first, while more than ``leave`` tokens wait."""
        for tier in self.tiers:
            while self.waiting[tier] and self.tokens >= max(leave, tier):
                first = self.waiting[tier].popleft()
                self.tokens -= len(first[2])
                self._fill(first, tier)

    def _fill(self, first: tuple, tier: int) -> None:
        pieces, gap = [first], tier - len(first[2])
        while gap:
            pieces.append(self._take(gap))
            gap -= len(pieces[-1][2])
        self._emit(pieces, tier)

    def finish(self) -> None:
        self.flush(0)
        while self.tokens:
            size = min(1 << (self.tokens.bit_length() - 1), self.tiers[0])
            pieces, gap = [], size
            while gap:
                pieces.append(self._take(gap))
                gap -= len(pieces[-1][2])
            self._emit(pieces, size)

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        group = self.groups.get(tier)
        if group is None or group[1] + tier > self.step_tokens:
            group = self.groups[tier] = [self.next, 0]
        group[1] += tier
        at = 0
        for doc, start, ids in pieces:
            self.out.append((doc, start, ids, self.next, at, tier, group[0]))
            at += len(ids)
        self.next += 1


def _pack(path: str, keep_space: bool, end_id: int, tiers: tuple[int, ...], step_tokens: int, with_ids: bool, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keep_space)
        end = np.array([end_id], dtype="<u4")
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for some, data, off in tk.batch_slices(batch, "text", SLICE):
                flat, at = enc.batch(data, off)
                for doc, a, b in zip(some.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    ids = np.concatenate([flat[a:b], end])
                    packer.add((doc, len(ids)), ids)
                if len(packer.out) >= 20_000:
                    yield rows(packer)
        packer.finish()
        if packer.out:
            yield rows(packer)

    def rows(p: Packer) -> pa.RecordBatch:
        out, p.out = p.out, []
        cols = {
            "doc_id": pa.array([r[0][0] for r in out], id_type), "start": pa.array([r[1] for r in out], pa.int64()),
            "length": pa.array([len(r[2]) for r in out], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(r[2].tobytes()) for r in out], pa.int64()),
            "doc_tokens": pa.array([r[0][1] for r in out], pa.int64()), "sequence_id": pa.array([r[3] for r in out], pa.int64()),
            "offset": pa.array([r[4] for r in out], pa.int64()), "tier": pa.array([r[5] for r in out], pa.int32()),
            "step_group": pa.array([r[6] for r in out], pa.int64()),
        }
        if with_ids:
            cols["ids"] = pa.array([r[2].tobytes() for r in out], pa.binary())
        return pa.RecordBatch.from_pydict(cols)
    return run


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", keep_space: bool = True, end_id: int = 1,
                   tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16, with_ids: bool = False,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group
    and, with_ids, the piece's ids (little-endian unsigned 32-bit)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_column].dataType
    spec = (f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
            "offset long, tier int, step_group long") + (", ids binary" if with_ids else "")
    run = _pack(tokenizer_path(tokenizer), keep_space, end_id, tiers, step_tokens, with_ids, to_arrow_type(kind))
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, spec)
