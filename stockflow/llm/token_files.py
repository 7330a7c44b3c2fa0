"""Token-id files: canonical length-limited Huffman codes, decoded in independent blocks.

``write_token_files`` tokenises whole texts once, counts all ids, builds one code for the corpus and
writes segments in ascending doc_id order; ``read_token_files`` gives every document back from them.

A segment is a binary value in the table ``segments`` (Spark's committer writes it, so a lost task leaves
nothing half done): magic, counts, the documents' ids and lengths, the bit offset of every block of
``BLOCK`` ids, and the bit stream. A one-row table ``code`` has the code length of every id, all a
canonical code needs. Blocks start at their checkpoint, so a reader decodes all blocks of a segment side
by side: step i looks up id i of every block in one table of 2**limit entries.

Defined cases: a null or empty text is its end id alone; null doc_ids come first; repeated rows are
written as often as they occur; an empty table writes no segment and reads back as no row. Only the two
named columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from stockflow.llm import textkit as tk
from stockflow.llm.frames import shared_dir
from stockflow.llm.tokens import encoder, tokenizer_path
from stockflow.session import ship_package

MAGIC = b"CHT1"
BLOCK = 512
SEGMENT_IDS = 1 << 19
STRETCH = 1 << 19     # ids encoded or decoded at once: a multiple of BLOCK
SEGMENT_COLUMNS = "part int, segment int, before long, n_ids long, payload binary"
SLICE = 1 << 22       # bytes of text tokenised together
LIMIT = 18            # bits of the longest code; 24 is the most that the readers' 32-bit window allows


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where an id never occurs."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    is_leaf = np.ones(n, dtype=bool)
    for _ in range(limit):
        levels.append(is_leaf)
        pairs = len(row) // 2
        packages = row[: 2 * pairs: 2] + row[1: 2 * pairs: 2]
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        row, is_leaf = merged[at], at < n
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaf = int(is_leaf[:take].sum())
        lengths[order[:leaf]] += 1
        take = 2 * (take - leaf)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i] = code
            code += 1
            last = n
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(id << 8 | length) for every window of the longest code's bits."""
    width = int(lengths.max(initial=1))
    table = np.zeros(1 << width, dtype=np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    span = np.uint64(1) << (np.uint64(width) - lengths[used].astype(np.uint64))
    entries = np.repeat((used << 8 | lengths[used]).astype(np.uint32), span.astype(np.int64))
    table[: len(entries)] = entries
    return table, width


def encode_stream(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream (big-endian bits) and the bit offset of every block, a stretch of whole blocks at a time."""
    parts, marks, base = [], [np.zeros(0, np.uint64)], 0
    for a in range(0, len(ids), STRETCH // 8):
        part, mark = _encode_stretch(ids[a: a + STRETCH // 8], codes, lengths)
        marks.append(mark + np.uint64(8 * base))
        parts.append(part)
        base += len(part)
    return b"".join(parts), np.concatenate(marks)


def _encode_stretch(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    n = lengths[ids].astype(np.uint64)
    at = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(n, out=at[1:])
    start = at[:-1]
    word = (start >> np.uint64(5)).astype(np.int64)
    put = codes[ids] << (np.uint64(64) - (start & np.uint64(31)) - n)
    run = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(at[-1] >> np.uint64(5)) + 3, dtype=np.uint64)
    out[word[run]] += np.add.reduceat(put >> np.uint64(32), run)
    out[word[run] + 1] += np.add.reduceat(put & np.uint64(0xFFFFFFFF), run)
    return out.astype(">u4").tobytes(), start[::BLOCK].copy()


def decode_stream(stream: bytes, marks: np.ndarray, n: int, table: np.ndarray, width: int) -> np.ndarray:
    """All n ids, a stretch of blocks at a time."""
    out, per = [np.zeros(0, dtype="<u4")], STRETCH // BLOCK
    for a in range(0, len(marks), per):
        some = marks[a: a + per].astype(np.int64)
        lo = int(some[0]) >> 3
        hi = (int(marks[a + per]) >> 3) + 8 if a + per < len(marks) else len(stream)
        out.append(_decode_stretch(stream[lo:hi], some - 8 * lo, min(n - a * BLOCK, STRETCH), table, width))
    return np.concatenate(out)


def _decode_stretch(stream: bytes, marks: np.ndarray, n: int, table: np.ndarray, width: int) -> np.ndarray:
    """The blocks step forward together from their checkpoints."""
    b = np.frombuffer(stream, dtype=np.uint8).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    out = np.zeros((BLOCK, len(marks)), dtype="<u4")
    at = marks.copy()
    last = n - (len(marks) - 1) * BLOCK
    mask = (1 << width) - 1
    for i in range(BLOCK):
        if i == last:
            at = at[:-1]
        if not len(at):
            break
        e = table[(window[at >> 3] >> (32 - width - (at & 7))) & mask]
        out[i, : len(at)] = e >> 8
        at += e & 255
    return out.T.reshape(-1)[:n]


def pack_segment(docs: np.ndarray, has_id: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    stream, marks = encode_stream(ids, codes, lengths)
    head = MAGIC + struct.pack("<qqqq", len(docs), len(ids), len(marks), len(stream))
    return b"".join([head, docs.astype("<i8").tobytes(), has_id.astype("u1").tobytes(), sizes.astype("<i8").tobytes(),
                     marks.astype("<u8").tobytes(), stream])


def unpack_segment(blob: bytes, table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, has-id flags, sizes and all ids of a segment."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids, n_marks, n_stream = struct.unpack_from("<qqqq", blob, 4)
    at = 36
    def part(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(blob, dtype=kind, count=n, offset=at)
        at += x.nbytes
        return x
    docs, has, sizes, marks = part("<i8", n_docs), part("u1", n_docs), part("<i8", n_docs), part("<u8", n_marks)
    return docs, has.astype(bool), sizes, decode_stream(blob[at: at + n_stream], marks, n_ids, table, width)


def _tokenise(path: str, keep_space: bool, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keep_space)
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            for some, data, off in tk.batch_slices(batch, "text", SLICE):
                flat, at = enc.batch(data, off)
                flat = flat.astype(kind)
                ids = [flat[a:b].tobytes() + end for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
    return run


def _count(size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            data, _ = tk.text_buffers(batch.column(0))
            ids = data.view(kind)
            for a in range(0, len(ids), STRETCH):
                counts += np.bincount(ids[a: a + STRETCH], minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64())})
    return run


def _segments(lengths: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, seg = canonical_codes(lengths), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[bytes] = []
        total = before = 0
        item = np.dtype(kind).itemsize

        def segment() -> pa.RecordBatch:
            nonlocal docs, held, total, before, seg
            sizes = np.array([len(x) // item for x in held], dtype=np.int64)
            ids = np.frombuffer(b"".join(held), dtype=kind)
            blob = pack_segment(np.array([d or 0 for d in docs], dtype=np.int64), np.array([d is not None for d in docs]), sizes, ids, codes, lengths)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([seg], pa.int32()),
                                              "before": pa.array([before], pa.int64()), "n_ids": pa.array([total], pa.int64()),
                                              "payload": pa.array([blob], pa.binary())})
            docs, held, total, before, seg = [], [], 0, before + total, seg + 1
            return out

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.as_py()
                if held and total + len(x) // item > SEGMENT_IDS:
                    yield segment()
                docs.append(d)
                held.append(x)
                total += len(x) // item
        if held:
            yield segment()
    return run


def _read(lengths: np.ndarray, base: dict[int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = decode_table(lengths)
        for batch in batches:
            for part, before, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs, has, sizes, ids = unpack_segment(blob.as_py(), table, width)
                at = np.zeros(len(sizes) + 1, dtype=np.int64)
                np.cumsum(sizes, out=at[1:])
                raw = [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                cols = {"doc_id": pa.array(docs, pa.int64(), mask=~has), "start": pa.array(at[:-1] + base[part] + before, pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", keep_space: bool = False, end_id: int = 1,
                      limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Tokenise, count, and write ``path/segments`` and ``path/code``."""
    spark = docs.sparkSession
    ship_package(spark)
    file = tokenizer_path(tokenizer)
    size = max(encoder(file, keep_space).vocab, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        _tokenise(file, keep_space, end_id, kind), "doc_id long, ids binary")
    ids.write.option("compression", "zstd").parquet(f"{path}/ids")
    ids = spark.read.schema("doc_id long, ids binary").parquet(f"{path}/ids")
    counts = np.zeros(size, dtype=np.int64)          # one counter per id of the vocabulary
    for r in ids.select("ids").mapInArrow(_count(size, kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/code")
    (ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
     .mapInArrow(_segments(lengths, kind), SEGMENT_COLUMNS)
     .write.option("compression", "uncompressed").parquet(f"{path}/segments"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with_ids, the ids, from the files alone."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first().lengths), dtype=np.uint8)
    segments = spark.read.schema(SEGMENT_COLUMNS).parquet(f"{path}/segments")
    # ids before each part: one number per written partition
    totals = sorted((r.part, r.n) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    spec = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return segments.select("part", "before", "payload").mapInArrow(_read(lengths, base, with_ids), spec)


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write to a new shared folder and read back (see the module)."""
    path = shared_dir(docs.sparkSession)
    write_token_files(docs, path, **options)
    return read_token_files(docs.sparkSession, path)
