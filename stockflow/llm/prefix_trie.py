"""Conversation prefix trie by vertical bitmaps.

Every conversation is rebuilt as a mixture of two: its first h turns are those of the first conversation of its
block of ``block`` ids, the rest are its own (``rebuilt``; h comes from a hash of the id). The trie has
one node per distinct sequence of first turns.

1. *Turns.* A turn is 120 bits of the SHA-256 of its role and text; texts travel no further. Positions come
   from a numbering per (conversation, range of turn numbers) shifted by the earlier ranges' counts, so a
   very long conversation is not one window.
2. *Shards.* Conversations are dealt to shards by hash, in segments of ``SEGMENT`` turns. A shard indexes
   (position, turn) to the bitset of its conversations. Depth first, a node's children are the
   intersections of its bitset with the next position's postings: the lowest conversation left names the next
   turn, its children take their conversations out. Popcounts are the node's members, bits without a next
   turn are the conversations that end there. A node with one conversation left is a chain without
   intersections.
3. *Merge.* A node is named by the 128-bit sum of hashes of its (position, turn) pairs. Shards' nodes are added up by
   name (partial aggregates, so common prefixes don't meet in one task).
4. *Subtrees.* Nodes with the same least member form a chain from one depth to the end. Chains hang on nodes of
   other chains; totals go up the chains by doubling (a logarithm of rounds), and inside a chain running
   sums from below give every node's subtree.
5. *Ends.* Members that end at a node are joined in blocks of ids, and the blocks of a node are streamed
   through SHA-256 in id order.

Defined cases: rows without a conv_id belong to no conversation and are left out; a null turn comes first,
equal turn numbers are ordered by the turns' digests; null roles and texts count as empty; repeated rows
are turns of their own; a conversation may have no turn left and then ends at the root; empty tables give an
empty result. Only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stockflow.llm.frames import stored
from stockflow.session import ship_package

BLOCK, HEADS = 5, 9
SHARD_ROWS = 50_000          # turns a shard is made for
SEGMENT = 1024               # turns of one conversation that one shard may hold
RANGE_BITS, END_BITS = 10, 12
_MASK = (1 << 64) - 1


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (the turn's name), bytes (UTF-8 bytes of its text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.conv(F.substring(name, 1, 15), 16, 10).cast("long").alias("t1"), F.conv(F.substring(name, 16, 15), 16, 10).cast("long").alias("t2"),
        F.octet_length(text).cast("long").alias("bytes"))
    turns = stored(turns.withColumn("range", F.shiftright("turn", RANGE_BITS)))
    inner = Window.partitionBy("conv_id", "range").orderBy(F.asc_nulls_first("turn"), "t1", "t2")
    earlier = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("range")).rowsBetween(Window.unboundedPreceding, -1)
    shift = turns.groupBy("conv_id", "range").count().select(
        F.col("conv_id").alias("c"), F.col("range").alias("g"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"))
    rows = turns.withColumn("pos", F.row_number().over(inner))
    return rows.join(shift, (rows["conv_id"] == shift["c"]) & rows["range"].eqNullSafe(shift["g"])).select(
        "conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "t1", "t2", "bytes")


def rebuilt(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """conv_id, pos, t1, t2, bytes of the rebuilt conversations; one row with pos 0 for each conversation."""
    turns = stored(numbered(conversations))
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    heads_of = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % block).alias("base"),
                            (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_size"))
    plan = stored(heads_of.join(base, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken")))
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    head = plan.join(first, "base").where("pos <= h").select("conv_id", "pos", "t1", "t2", "bytes")
    tail = turns.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "bytes")
    zero = F.lit(0).cast("long")
    return head.unionByName(tail).unionByName(plan.select("conv_id", *[zero.alias(c) for c in ("pos", "t1", "t2", "bytes")]))


NODE = "k1 long, k2 long, depth long, p1 long, p2 long, least long, n long, bytes long, ends array<long>"


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


class Shard:
    """Conversations of one shard and segment, by index: their rows (hash pair, bytes) in order of position."""

    def __init__(self, first: int):
        self.first = first                       # position before the first row
        self.ids: list[int] = []
        self.rows: list[list[tuple[int, int, int]]] = []
        self.roots: list[tuple[int, int]] = []   # path before the first row
        self.ended: list[bool] = []              # whether the conversation ends within these rows

    def nodes(self) -> Iterator[tuple]:
        postings: list[dict[tuple[int, int, int], int]] = []
        for c, turns in enumerate(self.rows):
            bit = 1 << c
            for p, t in enumerate(turns):
                if p == len(postings):
                    postings.append({})
                postings[p][t] = postings[p].get(t, 0) | bit
        starts: dict[tuple[int, int], int] = {}
        for c, k in enumerate(self.roots):
            starts[k] = starts.get(k, 0) | 1 << c
        for key, members in starts.items():
            # (path, members, rows taken); the root itself is a node of the first segment only
            todo = [(key, members, 0)]
            while todo:
                path, left, p = todo.pop()
                depth = self.first + p
                going = left
                ends = []
                if not left & (left - 1):
                    yield from self.chain(path, left.bit_length() - 1, p)
                    continue
                scan = left
                while scan:
                    c = (scan & -scan).bit_length() - 1
                    scan &= scan - 1
                    if len(self.rows[c]) == p:
                        going &= ~(1 << c)
                        if self.ended[c]:
                            ends.append(self.ids[c])
                if p or not self.first:
                    yield from self.node(path, depth, left, p, ends)
                while going:
                    c = (going & -going).bit_length() - 1
                    t = self.rows[c][p]
                    child = left & postings[p][t]
                    going &= ~child
                    todo.append(((path[0] + t[0], path[1] + t[1]), child, p + 1))

    def node(self, path, depth: int, left: int, p: int, ends: list[int]) -> Iterator[tuple]:
        c = (left & -left).bit_length() - 1
        t = self.rows[c][p - 1] if p else (0, 0, 0)
        yield (_signed(path[0]), _signed(path[1]), depth, _signed(path[0] - t[0]), _signed(path[1] - t[1]),
               self.ids[c], left.bit_count(), t[2], ends)

    def chain(self, path, c: int, p: int) -> Iterator[tuple]:
        turns = self.rows[c]
        for q in range(p, len(turns) + 1):
            if q > p:
                path = path[0] + turns[q - 1][0], path[1] + turns[q - 1][1]
            if q or not self.first:
                yield from self.node(path, self.first + q, 1 << c, q, [self.ids[c]] if q == len(turns) and self.ended[c] else [])


def _tries(segment: int):
    """Rows sorted by (segment, shard, conv_id, pos) to the nodes of each shard; conversations of a shard come in id order."""
    spec = pa.schema([(n, pa.int64()) for n in ("k1", "k2", "depth", "p1", "p2", "least", "n", "bytes")] + [("ends", pa.list_(pa.int64()))])

    def out(shard: Shard) -> Iterator[pa.RecordBatch]:
        held = []
        for x in shard.nodes():
            held.append(x)
            if len(held) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), spec)], schema=spec)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), spec)], schema=spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, last = None, None, None
        for batch in batches:
            for seg, no, conv, pos, h1, h2, size, b1, b2, ended in zip(*(batch.column(i).to_pylist() for i in range(10))):
                if (seg, no) != at:
                    if shard is not None:
                        yield from out(shard)
                    at, shard, last = (seg, no), Shard(seg * segment), None
                if conv != last:
                    last = conv
                    shard.ids.append(conv)
                    shard.rows.append([])
                    shard.roots.append((int(b1) & _MASK, int(b2) & _MASK))
                    shard.ended.append(ended)
                if pos:
                    shard.rows[-1].append((h1, h2, size))
        if shard is not None:
            yield from out(shard)
    return run


def trie_nodes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (k1, k2, depth, p1, p2, conv_id, n, bytes) and ends (k1, k2, conv_id) of rebuilt conversations."""
    spark = turns.sparkSession
    ship_package(spark)
    turns = stored(turns)
    shards = max(1, -(-turns.count() // SHARD_ROWS))
    seg = F.when(F.col("pos") > 0, F.expr(f"(pos - 1) div {SEGMENT}")).otherwise(F.lit(0)).cast("long")
    hashed = turns.select("conv_id", "pos", "bytes", seg.alias("seg"),
                          F.when(F.col("pos") > 0, F.xxhash64("t1", "t2", "pos")).otherwise(F.lit(0)).alias("h1"),
                          F.when(F.col("pos") > 0, F.xxhash64("pos", "t2", "t1", F.lit(1))).otherwise(F.lit(0)).alias("h2"))
    # the path before a segment is the sum of the earlier segments' hashes
    sums = hashed.groupBy("conv_id", "seg").agg(*[F.sum(F.col(h).cast("decimal(38,0)")).alias(h) for h in ("h1", "h2")])
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sums = sums.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), (F.col("seg") == F.max("seg").over(whole)).alias("ended"),
                       *[F.coalesce(F.sum(h).over(before), F.lit(0)).cast("decimal(38,0)").cast("string").alias(b) for h, b in (("h1", "b1"), ("h2", "b2"))])
    dealt = hashed.join(sums, (F.col("conv_id") == F.col("c")) & (F.col("seg") == F.col("s"))).select(
        "seg", F.pmod(F.xxhash64("conv_id"), F.lit(shards)).alias("shard"), "conv_id", "pos", "h1", "h2", "bytes", "b1", "b2", "ended")
    local = stored(dealt.repartition("seg", "shard").sortWithinPartitions("seg", "shard", "conv_id", "pos").mapInArrow(_tries(SEGMENT), NODE))
    nodes = local.groupBy("k1", "k2").agg(
        F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("least").alias("conv_id"),
        F.sum("n").alias("n"), F.max("bytes").alias("bytes"))
    return stored(nodes), local.select("k1", "k2", F.explode("ends").alias("conv_id"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids sorted by (node, block) to one SHA-256 per node."""
    key, h = None, None
    for batch in batches:
        done = []
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (k1, k2) != key:
                if key is not None:
                    done.append((*key, h.hexdigest()))
                key, h = (k1, k2), hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done)], names=["e1", "e2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([h.hexdigest()])], names=["e1", "e2", "ends_sha256"])


def end_lists(ends: DataFrame) -> DataFrame:
    """e1, e2, ends_sha256 of every node at which conversations end."""
    blocks = ends.groupBy("k1", "k2", F.shiftright("conv_id", END_BITS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return (blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block")
            .mapInArrow(_digests, "e1 long, e2 long, ends_sha256 string"))


def _totals(chains: DataFrame) -> DataFrame:
    """c, leaves, saved: each chain's sums with those of all chains below it (up: the chain it hangs on).

    Doubling: after round k a chain holds the sums of its descendants closer than 2**k, and its pointer is
    2**k chains up."""
    state = chains
    while True:
        state = stored(state, waves=1)
        if state.where("up is not null").limit(1).count() == 0:
            return state.drop("up")
        add = state.where("up is not null").groupBy(F.col("up").alias("u")).agg(F.sum("leaves").alias("al"), F.sum("saved").alias("a_s"))
        far = state.select(F.col("c").alias("f"), F.col("up").alias("far"))
        state = (state.join(add, state["c"] == add["u"], "left").join(far, F.col("up") == F.col("f"), "left")
                 .select("c", F.col("far").alias("up"), (F.col("leaves") + F.coalesce("al", F.lit(0))).alias("leaves"),
                         (F.col("saved") + F.coalesce("a_s", F.lit(0))).alias("saved")))


def subtrees(nodes: DataFrame) -> DataFrame:
    """Nodes with parent_conv_id, n_children, n_leaves and saved (sums over their subtrees)."""
    spans = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("last"))
    heads = nodes.join(spans.select(F.col("conv_id").alias("c"), "top"), (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("top")), "left_semi")
    owner = nodes.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("conv_id").alias("up"))
    tops = stored(heads.where("depth > 0").join(owner, (F.col("p1") == F.col("o1")) & (F.col("p2") == F.col("o2")))
                  .select(F.col("conv_id").alias("c"), "up", (F.col("depth") - 1).alias("at")))
    hanging = tops.groupBy("up", "at").agg(F.count("*").alias("hung"))
    one = nodes.join(hanging, (F.col("conv_id") == F.col("up")) & (F.col("depth") == F.col("at")), "left").drop("up", "at")
    one = one.join(spans.withColumnRenamed("conv_id", "s"), F.col("conv_id") == F.col("s")).drop("s")
    children = F.coalesce("hung", F.lit(0)) + F.when(F.col("depth") < F.col("last"), 1).otherwise(0)
    one = stored(one.withColumn("n_children", children).withColumn("leaf", F.when(children == 0, 1).otherwise(0))
                 .withColumn("weight", (F.col("n") - 1) * F.col("bytes")))
    own = one.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("weight").alias("saved")).withColumnRenamed("conv_id", "c")
    total = _totals(own.join(tops.select("c", "up"), "c", "left").select("c", "up", "leaves", "saved"))
    below = (tops.join(total, "c").groupBy("up", "at").agg(F.sum("leaves").alias("bl"), F.sum("saved").alias("bs")))
    one = (one.join(below, (F.col("conv_id") == F.col("up")) & (F.col("depth") == F.col("at")), "left")
           .withColumn("leaf", F.col("leaf") + F.coalesce("bl", F.lit(0))).withColumn("weight", F.col("weight") + F.coalesce("bs", F.lit(0)))
           .withColumn("part", F.shiftright("depth", RANGE_BITS)).drop("up", "at", "bl", "bs"))
    # running sums from the deepest node of a chain on, in parts of a chain carried on by the parts below
    inside = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = one.groupBy("conv_id", "part").agg(F.sum("leaf").alias("l"), F.sum("weight").alias("w")).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("l").over(deeper), F.lit(0)).alias("cl"),
        F.coalesce(F.sum("w").over(deeper), F.lit(0)).alias("cw"))
    one = one.withColumn("il", F.sum("leaf").over(inside)).withColumn("iw", F.sum("weight").over(inside))
    one = one.join(carry, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")))
    hung_on = tops.select(F.col("c").alias("head"), F.col("up").alias("parent"), (F.col("at") + 1).alias("head_depth"))
    one = one.join(hung_on, (F.col("conv_id") == F.col("head")) & (F.col("depth") == F.col("head_depth")), "left")
    return one.select("k1", "k2", "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
                      F.col("n").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
                      (F.col("il") + F.col("cl")).cast("long").alias("n_leaves"), (F.col("iw") + F.col("cw")).cast("long").alias("saved_tokens"))


def conversation_trie(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, ends = trie_nodes(rebuilt(conversations, block, heads))
    lists = end_lists(ends)
    return (subtrees(nodes).join(lists, (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
