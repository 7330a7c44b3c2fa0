"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

``ngram_components`` links two documents when the Jaccard similarity of their sets of distinct word
n-grams reaches num/den and returns the component of every row.

Plan (every step a DataFrame job, nothing whole on the driver):

1. *Rarity.* One pass counts all n-grams of all texts into a fixed table of ``SKETCH`` hashed counters.
   A second table counts words. Any fixed total
   order of n-grams keeps prefix filtering exact; the counters only make it rare-first.
2. *Classes.* A second pass turns each text into its set, the 128-bit digest of the set and the set's
   prefix (the first |x| - ceil(t|x|) + 1 n-grams in rare-first order). Equal sets form one class.
3. *Prefix join.* Classes that share a prefix n-gram are candidates. Copies must not become all pairs,
   so star rounds compare, per prefix n-gram, only leaders with the other classes: those whose prefix is
   shared most, a group's least edited members, and mostly the same ones for all n-grams of a group. Verified links give
   labels (classes with one label are connected). The last round compares every remaining pair whose
   labels differ (pairs under one label can't change the result), so no link is lost; components are then
   found among the labels. N-grams that would make more than ``HOT`` such pairs a posting are hot: the classes that have
   one are counted, ordered and joined anew among themselves, a level at a time, as far as that thins them out.
4. *Filters.* Sizes must fit (length), the first common n-gram must leave room for the needed overlap in both
   sets (positional), and the Hamming bound from the counts of both sets over
   ``PARTS`` ranges of the n-gram order must not exceed what the threshold allows (suffix filter,
   applied from position 0).
5. *Verification.* Each candidate pair is verified once on whole texts, streamed past its leader;
   leaders with many partners are salted.

Defined cases: null and empty texts (or texts without words) have no n-grams, size 0 and no link,
their component is their own doc_id; a text of fewer than n words is one n-gram of all its words; rows
with equal texts or ids are answered row by row; a null doc_id gets the least known id of its component
(null if there is none). An empty table gives an empty result. Only the columns named by the arguments
are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockflow.llm import counters, textkit as tk
from stockflow.llm.frames import BROADCAST_ROWS, bitmap, by_key, components, fresh, stored
from stockflow.session import ship_package

SKETCH = 1 << 21
LEVEL_SKETCH = 1 << 23        # counters where the classes with hot n-grams are counted anew
WORDS = 1 << 18
SLOTS = 1 << 23              # one bit each: which hashed n-grams are in two classes or more
PARTS = 32
PARTNERS_PER_TASK = 2_000
KIN = 100                    # steps of the share of a prefix that other classes have, too
LEADERS = 4                  # one leader per n-gram in the first star round; each further round has as many times more
HOT = 4                      # pairs of different labels per posting, beyond which an n-gram is hot
LEVELS = 3                   # of counting the classes with hot n-grams anew
THINNED = 0.8                # another level must leave at most this share of the classes


def row_sets(data: np.ndarray, off: np.ndarray, n: int, weights: np.ndarray | None = None):
    """Sorted distinct n-gram hashes of every row (lower-cased A-Z, words without white space).

    With weights (one per hashed word) the result is (hashes, weight of each n-gram) per row.
    """
    start, end, row = tk.words(data, off, tk.SPACE_SEPARATED)
    wh = tk.word_hashes(data, start, end, lower=True)
    at = tk.run_offsets(tk.row_counts(row, len(off) - 1))
    sh = tk.shingle_hashes(wh, n)
    if weights is not None:
        of_word = np.zeros(len(wh) + 1, dtype=np.int64)
        np.cumsum(weights[(wh & tk.U64(len(weights) - 1)).astype(np.int64)], out=of_word[1:])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if weights is None:
            out.append(np.unique(sh[a: b - n + 1]) if b - a >= n else tk.shingle_hashes(wh[a:b], b - a) if b > a else sh[:0])
        elif b - a >= n:
            u, first = np.unique(sh[a: b - n + 1], return_index=True)
            first += a
            out.append((u, of_word[first + n] - of_word[first]))
        else:
            u = tk.shingle_hashes(wh[a:b], b - a) if b > a else sh[:0]
            out.append((u, np.zeros(len(u), dtype=np.int64)))
    return out


def _count_ngrams(n: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots + WORDS, dtype=np.uint32)
        for batch in batches:
            for _, data, off in tk.batch_slices(batch, "text"):
                sets = row_sets(data, off, n)
                if sets:
                    np.add.at(counts, (np.concatenate(sets) & tk.U64(slots - 1)).astype(np.int64), np.uint32(1))
                start, end, _ = tk.words(data, off, tk.SPACE_SEPARATED)
                wh = tk.word_hashes(data, start, end, lower=True)
                np.add.at(counts, (wh & tk.U64(WORDS - 1)).astype(np.int64) + slots, np.uint32(1))
        yield from counters.emit(counts)
    return run


def _total(slots: int):
    """The sum of the n-grams' counters of each batch of segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = sum(int(counters.numbers(c.as_py()).sum()) for s, c in zip(batch.column(0).to_pylist(), batch.column(1))
                        if s * counters.SEGMENT < slots)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["total"])
    return run


def _ranks(slots: int, noise: float):
    """Segments of counters to segments of tiers (n-grams) and weights (words); those that are all 0 go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = [], []
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = counters.numbers(c.as_py())
                if s * counters.SEGMENT < slots:
                    c = np.ceil(np.log2(1 + np.maximum(c.astype(np.float32) - np.float32(noise), 0))).astype(np.uint8)
                else:
                    c = np.floor(4 * np.log2(1 + c)).astype("<i2")
                if c.any():
                    ids.append(s), blobs.append(c.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["segment", "ranks"])
    return run


def ngram_rarity(texts: DataFrame, n: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(tier of every hashed n-gram, weight of every hashed word) over all texts, two tables of fixed size.

    The tier is 0 for n-grams whose counter doesn't stand out of the others' noise, else the bit length of
    the excess; the weight of a word is 4 log2 of its counter. N-grams are ordered by (tier, sum of
    their words' weights, hash): frequent passages last, then n-grams of common words, rare ones first.
    Counters become tiers and weights inside the tasks: the driver gets and holds one byte a counter.
    """
    tasks = 2 * max(texts.sparkSession.sparkContext.defaultParallelism, 1)      # each hands on a whole table
    counts = stored(counters.added(texts.select("text").coalesce(tasks).mapInArrow(_count_ngrams(n, slots), counters.SPEC)), waves=1)
    mean = (counts.mapInArrow(_total(slots), "total long").agg(F.sum("total")).first()[0] or 0) / slots
    tiers, words = np.zeros(slots, dtype=np.uint8), np.zeros(WORDS, dtype=np.int16)
    for row in counts.mapInArrow(_ranks(slots, mean + 4 * np.sqrt(mean)), "segment int, ranks binary").collect():
        at = row.segment * counters.SEGMENT
        if at < slots:
            tiers[at: at + counters.SEGMENT] = np.frombuffer(bytes(row.ranks), dtype=np.uint8)
        else:
            words[at - slots: at - slots + counters.SEGMENT] = np.frombuffer(bytes(row.ranks), dtype="<i2")
    return tiers, words


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def _features(n: int, num: int, den: int, rarity):
    """Rows (doc_id, text key) to (…, size, digest, prefix, parts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier, weights = rarity.value
        for batch in batches:
            for rows, data, off in tk.batch_slices(batch, "text"):
                sizes, digests, prefixes, parts = [], [], [], []
                for u, weight in row_sets(data, off, n, weights):
                    sizes.append(len(u))
                    if not len(u):
                        digests.append(None), prefixes.append(np.zeros(0, np.int64)), parts.append(np.zeros(0, np.int32))
                        continue
                    digests.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                    order = np.argsort((tier[(u & tk.U64(len(tier) - 1)).astype(np.int64)].astype(np.int64) << 32) + weight, kind="stable")
                    prefixes.append(u[order[: prefix_length(len(u), num, den)]].view(np.int64))
                    parts.append(np.bincount((u >> tk.U64(59)).astype(np.int64), minlength=PARTS).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    tk.list_array(np.concatenate(prefixes), tk.run_offsets([len(p) for p in prefixes]), pa.int64()),
                    tk.list_array(np.concatenate(parts), tk.run_offsets([len(p) for p in parts]), pa.int32()),
                ], names=["doc_id", "tkey", "size", "class", "prefix", "parts"])
    return run


def _postings(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            grams = lists.values.to_numpy()[off[0]: off[-1]]
            off = off - off[0]
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            at = np.flatnonzero(tk.marked(slots.value, grams))
            rows = pa.array(row[at])
            kin = np.bincount(row[at], minlength=len(off) - 1) / np.maximum(np.diff(off), 1)
            yield pa.RecordBatch.from_arrays([pa.array(grams[at]), batch.column(0).take(rows), batch.column(1).take(rows),
                                              pa.array((at - off[row[at]]).astype(np.int32)), pa.array((kin[row[at]] * KIN).astype(np.int32))],
                                             names=["gram", "id", "size", "pos", "kin"])
    return run


def _verify_stream(n: int, num: int, den: int):
    """Texts sorted by (leader, salt, role): role 0 is the leader, the rest are its candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, None
        for batch in batches:
            for rows, data, off in tk.batch_slices(batch, "text"):
                leads, salts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                roles, ids = rows.column(2).to_pylist(), rows.column(3).to_pylist()
                a, b, common = [], [], []
                for i, u in enumerate(row_sets(data, off, n)):
                    if roles[i] == 0:
                        key, lead = (leads[i], salts[i]), u
                        continue
                    if key != (leads[i], salts[i]):
                        raise ValueError("a candidate came without its leader")
                    both = len(np.intersect1d(lead, u, assume_unique=True))
                    if den * both >= num * (len(lead) + len(u) - both):
                        a.append(leads[i]), b.append(ids[i]), common.append(both)
                if a:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(common, pa.int64())], names=["a", "b", "common"])
    return run


def _needed(nx, ny, num: int, den: int):
    """Least overlap that reaches the threshold: ceil(num / (num + den) * (|x| + |y|))."""
    return F.ceil(F.lit(num) * (nx + ny) / F.lit(num + den))


def _fits(num: int, den: int):
    """Length and positional filter at one common n-gram of sets with sizes xs, ys and positions xp, yp (from 0).

    The first common n-gram of a linked pair has all of their overlap from its positions on, so it passes; a later one
    that fails is not needed to find the pair.

    Plain columns, the same for either order of the two sets: on structs, least() and greatest() would be generated
    again for every use, into methods that take the compiler more than a gigabyte."""
    xs, ys, xp, yp = (F.col(c) for c in ("xs", "ys", "xp", "yp"))
    most = F.least(xs - xp, ys - yp)
    return (F.lit(den) * F.least(xs, ys) >= F.lit(num) * F.greatest(xs, ys)) & (most >= _needed(xs, ys, num, den))


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, star_rounds: int = 2,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Component of every row by n-gram Jaccard links of at least num/den.

    Returns doc_id, tkey (64-bit key of the text), n_shingles, class (digest of the set, null without
    words), component (its root class) and component_id (least doc_id of the component, itself included), one
    row per input row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rarity = spark.sparkContext.broadcast(ngram_rarity(texts, n, SKETCH))
    keyed = texts.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    feats = stored(keyed.mapInArrow(
        _features(n, num, den, rarity),
        f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, tkey long, size long, class binary, prefix array<long>, parts array<int>"))
    rarity.destroy()                                 # all that needs it is written
    # equal sets have equal sizes, prefixes and parts: any row of a class stands for it, under a number of 8 bytes
    classes = stored(feats.where("class is not null").groupBy("class").agg(
        F.min(F.struct("doc_id", "tkey")).alias("rep"), F.min("doc_id").alias("least"),
        *[F.first(c).alias(c) for c in ("size", "prefix", "parts")]).withColumn("id", F.monotonically_increasing_id()))
    entry = F.shiftleft(F.col("size"), 32) + F.col("pos")
    size, pos = (lambda e: F.shiftright(e, 32)), (lambda e: F.col(e).bitwiseAND((1 << 32) - 1))
    pair = (F.lit(den) * size("e0") >= F.lit(num) * size("e1")) & (
        F.least(size("e0") - pos("e0"), size("e1") - pos("e1")) >= _needed(size("e0"), size("e1"), num, den))

    def shared_postings(prefixes: DataFrame) -> DataFrame:
        """Postings of the n-grams that may join two classes; only these (and a few that share a slot) move again.
        Of exactly two postings both sizes and positions are known here, so the filters apply at once."""
        grams = (prefixes.select("size", F.posexplode("prefix").alias("pos", "gram")).select("gram", entry.alias("e")).groupBy("gram")
                 .agg(F.count("*").alias("n"), F.min("e").alias("e0"), F.max("e").alias("e1"))
                 .where((F.col("n") > 2) | ((F.col("n") == 2) & pair)).select("gram"))
        grams = stored(grams)
        slots = spark.sparkContext.broadcast(bitmap(grams, "gram", SLOTS))
        postings = prefixes.select("id", "size", "prefix").mapInArrow(_postings(slots), "gram long, id long, size long, pos int, kin int")
        out = stored(postings.join(grams, "gram"))
        slots.destroy()
        return out

    shared = shared_postings(classes)
    parts = classes.select("id", "parts")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, text) of each class among the ids."""
        need = stored(ids.join(classes.select("id", "rep"), "id"), waves=1)
        known = need.count()
        side = F.broadcast(need) if known <= BROADCAST_ROWS else need
        found = (keyed.join(side, keyed["doc_id"].eqNullSafe(side["rep.doc_id"]) & (keyed["tkey"] == side["rep.tkey"]))
                 .select("id", "text"))
        found = stored(found)
        if found.count() > known:                    # repeated rows (equal id and text)
            found = stored(found.dropDuplicates(["id"]))
        return found

    def filtered(pairs: DataFrame) -> DataFrame:
        """Tight positional filter at the first common n-gram of each pair, then the suffix filter."""
        # the smaller set (then the smaller number) comes first, so a pair has one name
        swap = (F.col("xs") > F.col("ys")) | ((F.col("xs") == F.col("ys")) & (F.col("xi") > F.col("yi")))
        pairs = pairs.where(_fits(num, den)).withColumn("swap", swap).select(
            *[F.when(F.col("swap"), F.col(f"{v}{c}")).otherwise(F.col(f"{u}{c}")).alias(name)
              for name, u, v, c in (("a", "x", "y", "i"), ("b", "y", "x", "i"), ("pa", "x", "y", "p"), ("pb", "y", "x", "p"),
                                    ("na", "x", "y", "s"), ("nb", "y", "x", "s"))])
        first = pairs.groupBy("a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"),
                                           F.first("na").alias("na"), F.first("nb").alias("nb"))
        need = _needed(F.col("na"), F.col("nb"), num, den)
        first = first.where(F.lit(1) + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) >= need)
        gap = F.aggregate(F.zip_with("qa", "qb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
        return (first.join(parts.select(F.col("id").alias("a"), F.col("parts").alias("qa")), "a")
                .join(parts.select(F.col("id").alias("b"), F.col("parts").alias("qb")), "b")
                .where(gap <= F.col("na") + F.col("nb") - 2 * need).select("a", "b"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (a: leader), each verified once on whole texts."""
        found = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        degree = pairs.groupBy("a").agg(F.count("*").alias("deg")).withColumn(
            "salts", F.ceil(F.col("deg") / PARTNERS_PER_TASK).cast("int"))
        leaders = (degree.join(found, degree["a"] == found["id"])
                   .select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"),
                           F.col("a").alias("id"), "text"))
        members = (pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
                   .join(found.withColumnRenamed("id", "b"), "b")
                   .select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id"), "text"))
        return (leaders.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
                .mapInArrow(_verify_stream(n, num, den), "a long, b long, common long"))

    def relabelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return postings.withColumn("comp", F.col("id"))
        return (postings.join(labels, postings["id"] == labels["node"], "left")
                .select("gram", "id", "size", "pos", "kin", F.coalesce("label", "id").alias("comp")))

    def open_grams(labelled: DataFrame) -> DataFrame:
        """(gram, hot): n-grams of two labels or more; hot ones would make more than HOT pairs a posting."""
        k = labelled.groupBy("gram", "comp").agg(F.count("*").alias("k")).groupBy("gram").agg(
            F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q"))
        return stored(k.where("n * n > q").select("gram", (F.expr("n * n - q") > 2 * HOT * F.col("n")).alias("hot")), waves=1)

    def star(labelled: DataFrame, r: int) -> DataFrame:
        """Candidates of an n-gram's leaders with its other classes."""
        # the class with most of its prefix in others leads: a group's least edited copy, the same one for most of its n-grams
        draw = F.xxhash64("id", F.lit(r))
        lead = labelled.groupBy("gram", F.pmod(F.xxhash64("id"), F.lit(LEADERS ** r)).alias("draw")).agg(
            F.max(F.struct("kin", draw.alias("h"), "size", "id", "pos", "comp")).alias("l"))
        return filtered(labelled.join(lead, "gram").where("comp <> l.comp").select(
            F.col("l.size").alias("xs"), F.col("l.id").alias("xi"), F.col("l.pos").alias("xp"),
            F.col("size").alias("ys"), F.col("id").alias("yi"), F.col("pos").alias("yp")))

    def across(labelled: DataFrame) -> DataFrame:
        """Candidates of different labels: all pairs of postings that can pass the filters."""
        # bounds over a label's members in a group tell whether any pair can pass the length and positional filters
        comps = labelled.groupBy("gram", "comp").agg(F.min("size").alias("lo"), F.max("size").alias("hi"),
                                                     F.max(F.col("size") - F.col("pos")).alias("rest"))
        least = _needed(F.col("s.lo"), F.col("t.lo"), num, den)
        cross = (comps.alias("s").join(comps.alias("t"), "gram")
                 .where(F.expr(f"s.comp < t.comp and {den} * s.hi >= {num} * t.lo and {den} * t.hi >= {num} * s.lo"))
                 .where(F.least("s.rest", "t.rest") >= least)
                 .select("gram", F.col("s.comp").alias("ca"), F.col("t.comp").alias("cb")))
        x, y = (labelled.select("gram", F.col("comp").alias(c), F.col("size").alias(f"{k}s"), F.col("id").alias(f"{k}i"),
                                F.col("pos").alias(f"{k}p")) for c, k in (("ca", "x"), ("cb", "y")))
        return filtered(cross.join(x, ["gram", "ca"]).join(y, ["gram", "cb"]).select("xs", "xi", "xp", "ys", "yi", "yp"))

    def across_hot(labelled: DataFrame) -> DataFrame:
        """As across(), where many pairs are left: the suffix filter applies before a pair becomes a row."""
        both = labelled.join(parts, "id")
        x, y = (both.select("gram", *[F.col(c).alias(f"{k}{a}") for c, a in (
            ("comp", "c"), ("size", "s"), ("id", "i"), ("pos", "p"), ("parts", "q"))]) for k in "xy")
        gap = F.aggregate(F.zip_with("xq", "yq", lambda u, v: F.abs(u - v)), F.lit(0), lambda t, u: t + u)
        room = F.col("xs") + F.col("ys") - 2 * _needed(F.col("xs"), F.col("ys"), num, den)
        return filtered(x.join(y, "gram").where("xc < yc").where(_fits(num, den)).where(gap <= room)
                        .select("xs", "xi", "xp", "ys", "yi", "yp"))

    def all_across(labels: DataFrame | None) -> DataFrame:
        """Every remaining candidate pair of different labels.

        A pair that shares a hot n-gram is left to the next level: the classes with a hot n-gram are counted, ordered and
        cut to prefixes anew among themselves, where common passages are told from rare ones with less noise. The
        other pairs share n-grams that are not hot only, so the filters see their first common one. Where
        a level no longer thins them out, hot n-grams are compared like the others, too.

        Each level's pairs are written before the next begins: as one plan, the driver would hold all levels'
        broadcast sides and plan texts at once."""
        found, postings, before = [], shared, classes.count()
        for level in range(LEVELS):
            labelled = relabelled(postings, labels)
            grams = open_grams(labelled)
            labelled = stored(labelled.join(grams, "gram"))
            ids = stored(labelled.where("hot").select("id").distinct(), waves=1)
            left = ids.count()
            if not left or level == LEVELS - 1 or left > THINNED * before:
                found.append(stored(across(labelled.where("not hot")), waves=1))
                if left:
                    found.append(stored(across_hot(labelled.where("hot")), waves=1))
                break
            found.append(stored(across(labelled.where("not hot")), waves=1))
            before = left
            texts = texts_of(ids)
            weights = spark.sparkContext.broadcast(ngram_rarity(texts, n, LEVEL_SKETCH))
            prefixes = stored(texts.select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("tkey"), "text").mapInArrow(
                _features(n, num, den, weights), "id long, tkey long, size long, class binary, prefix array<long>, parts array<int>")
                .select("id", "size", "prefix"))
            weights.destroy()
            postings = shared_postings(prefixes)
        return functools.reduce(DataFrame.unionByName, found).distinct() if len(found) > 1 else found[0]

    tried = links = labels = None
    for r in range(star_rounds + 1):
        if links is not None:
            labels = stored(components(links).withColumnRenamed("root", "label"), waves=1)
        if r == star_rounds:
            pairs = all_across(labels)
        elif r == 0:
            pairs = star(relabelled(shared, None), r)
        else:                                        # more leaders, where one has left much to compare
            labelled = stored(relabelled(shared, labels))
            pairs = star(labelled.join(open_grams(labelled).where("hot").select("gram"), "gram"), r)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, waves=1)
        new = stored(verified(pairs), waves=1)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = new if links is None else links.unionByName(new)

    # labels stand for their classes: components are searched among the links between different labels
    named = labels if labels is not None else links.select(F.col("a").alias("node"), F.col("a").alias("label")).where("false")
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = (ends.join(named.select(F.col("node").alias(end), F.col("label").alias("l")), end, "left")
                .withColumn(end, F.coalesce("l", end)).drop("l"))
    roots = components(ends.where("a <> b"))
    label = (classes.select("class", "least", "id").join(named, F.col("id") == F.col("node"), "left")
             .select("class", "least", F.coalesce("label", "id").alias("label"))
             .join(roots, F.col("label") == F.col("node"), "left").select("class", "least", F.coalesce("root", "label").alias("comp")))
    label = stored(label, waves=1)
    least = label.groupBy("comp").agg(F.min("least").alias("component_id"))
    label = label.join(least, "comp").select(F.col("class").alias("c"), F.col("comp").alias("component"), "component_id")
    return (feats.select("doc_id", "tkey", "size", "class").join(label, feats["class"] == F.col("c"), "left")
            .select("doc_id", "tkey", F.col("size").alias("n_shingles"), "class", "component",
                    F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def ngram_dedupe(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of docs with one document kept per component: the one with the least doc_id (null last, then text key).

    Documents without words are their own groups. Repeated rows (equal id and text) are one document: one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey")
    rows = stored(ngram_components(docs, n, num, den).groupBy("component", "doc_id", "tkey").agg(F.count("*").alias("copies")))
    best = rows.where("component is not null").groupBy("component").agg(F.min(order).alias("best"))
    out = rows.join(best, "component", "left").where(F.col("best").isNotNull() & (order != F.col("best")))
    out = stored(out.select("doc_id", "tkey"))
    left = by_key(docs, out, "left_anti")
    several = rows.where("copies > 1").select("doc_id", "tkey")
    once, again = by_key(left, several, "left_anti"), by_key(left, several, "left_semi")
    t, = fresh(docs, "tkey")
    again = again.withColumn(t, F.xxhash64("text")).dropDuplicates(["doc_id", t]).select(*docs.columns)
    return once.unionByName(again)
