"""Operators on edge rows and empty tables against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stockflow.llm import (decontam, frames, licenses, line_dedup, ngram_join, packing, quality, repeats, sharding, textkit as tk, token_files, toxicity)

WORD = r"[^\x20\x09-\x0D]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def variants(n: int, seed: int) -> list[tuple[int, str]]:
    """Texts of which many are edited copies of a few."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(20, 120))] for _ in range(6)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w) + rng.choice([".", "", "\nThe end of it. " + " ".join(words[:30])])))
    return out


def shingles(text: str | None, n: int) -> frozenset:
    w = re.findall(WORD, (text or "").translate(LOW))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def roots(sets: list[frozenset], num: int, den: int) -> list[int]:
    par = list(range(len(sets)))
    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_ngram_components(spark, edge_docs, edge_rows, no_docs):
    rows = [(100 + i, t) for i, t in variants(120, 1)]
    docs = edge_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    sets = [shingles(t, 4) for _, t in [*edge_rows, *rows]]
    ids = [i for i, _ in [*edge_rows, *rows]]
    group = roots(sets, 85, 100)
    least = defaultdict(lambda: None)
    for g, i in zip(group, ids):
        if i is not None:
            least[g] = i if least[g] is None else min(least[g], i)
    want = Counter((i, len(s), least[g] if s else i) for i, s, g in zip(ids, sets, group))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, 4, 85, 100).collect())
    assert (got - want, want - got) == (Counter(), Counter())
    assert ngram_join.ngram_components(no_docs, 4, 85, 100).collect() == []


def near_copies(n: int, seed: int) -> list[tuple[int, str]]:
    """Texts with one to three words of one base changed."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(150), rng.randint(1, 3)):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return [*rows, (n, " ".join(base))]


def test_ngram_components_of_near_copies_make_few_pairs(spark, monkeypatch):
    """A group of near copies meets its leaders, not all of its members."""
    rows, made, plain = near_copies(150, 3), [], ngram_join.stored
    def counted(df, *args, **options):
        out = plain(df, *args, **options)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out
    monkeypatch.setattr(ngram_join, "stored", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    group = roots([shingles(t, 4) for _, t in rows], 85, 100)
    assert got == {i: rows[g][0] for (i, _), g in zip(rows, group)}
    assert sum(made) <= 10 * len(rows)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_ngram_components_with_hot_ngrams(spark, monkeypatch, levels):
    """Every n-gram of two labels is hot: the classes go through all levels, and no link is lost."""
    for name, value in (("HOT", 0), ("LEVELS", levels), ("THINNED", 1), ("LEVEL_SKETCH", 1 << 12)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = variants(120, 1) + [(200 + i, t) for i, t in near_copies(20, 5)]
    group = roots([shingles(t, 4) for _, t in rows], 85, 100)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(
        spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100, star_rounds=1).collect()}
    assert got == {i: rows[g][0] for (i, _), g in zip(rows, group)}


def test_ngram_components_hot_levels_are_small_plans(spark, monkeypatch):
    """No step's plan joins the frames of several levels: the driver holds the broadcast sides of one at a time."""
    for name, value in (("HOT", 0), ("LEVELS", 3), ("THINNED", 1), ("LEVEL_SKETCH", 1 << 12)):
        monkeypatch.setattr(ngram_join, name, value)
    joins, plain = [], ngram_join.stored
    def counted(df, *args, **options):
        joins.append(len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString())))
        return plain(df, *args, **options)
    monkeypatch.setattr(ngram_join, "stored", counted)
    rows = variants(120, 1) + [(200 + i, t) for i, t in near_copies(20, 5)]
    group = roots([shingles(t, 4) for _, t in rows], 85, 100)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(
        spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100, star_rounds=1).collect()}
    assert got == {i: rows[g][0] for (i, _), g in zip(rows, group)}
    assert max(joins) <= 6


@pytest.mark.parametrize("links, steps", [
    ([], 0), ([(5, 5)], 0),
    ([(1, 9), (9, 1), (8, 1), (2, 3), (3, 2), (4, 4)], 0),             # stars, some links twice and reversed
    ([(i, i + 1) for i in range(40)] + [(50, 7), (60, 61)], 9)])
def test_components_take_no_step_beyond_stars(spark, monkeypatch, links, steps):
    """Roots are right, and links that are stars around the least node are not dealt out again to find that out."""
    written, plain = [], frames.stored
    def counted(df, *args, **options):
        written.append(1)
        return plain(df, *args, **options)
    monkeypatch.setattr(frames, "stored", counted)
    got = sorted(tuple(r) for r in frames.components(spark.createDataFrame(links, "a long, b long")).collect())
    least = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == sorted(least.items())
    assert len(written) - 1 <= steps


def test_ngram_rarity_takes_a_few_bytes_a_counter_on_the_driver(spark):
    """Counters become tiers and weights in the tasks; the tables are those of the counters of all rows."""
    rows, slots = variants(120, 4) + [(200 + i, t) for i, t in near_copies(40, 6)], 1 << 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("text")
    tracemalloc.start()
    try:
        tiers, weights = ngram_join.ngram_rarity(docs, 4, slots)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * (slots + ngram_join.WORDS)
    data, off = tk.text_buffers(pa.array([t for _, t in rows], pa.string()))
    counts = np.bincount(np.concatenate(ngram_join.row_sets(data, off, 4)) & np.uint64(slots - 1), minlength=slots)
    start, end, _ = tk.words(data, off, tk.SPACE_SEPARATED)
    words = np.bincount(tk.word_hashes(data, start, end, lower=True) & np.uint64(ngram_join.WORDS - 1), minlength=ngram_join.WORDS)
    noise = counts.mean() + 4 * np.sqrt(counts.mean())
    assert tiers.any() and (tiers == np.ceil(np.log2(1 + np.maximum(counts - noise, 0)))).all()
    assert (weights == np.floor(4 * np.log2(1 + words))).all()


def test_ngram_dedupe_keeps_one_of_each_group(spark, edge_docs, edge_rows):
    kept = ngram_join.ngram_dedupe(edge_docs)
    assert kept.columns == edge_docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert max(got.values()) == 1
    copies = [k for k in got if k[1] and k[1].startswith("one two three four five six")]
    assert copies == [(1, edge_rows[0][1])]
    assert {(3, None), (4, ""), (5, "  \n\t "), (6, "word"), (8, "two words")} <= set(got)
    assert ((6, "word") in got) and ((7, "Word") not in got)


def test_repeats(spark, edge_docs, edge_rows, no_docs):
    rows = [(100 + i, t) for i, t in variants(60, 2)] + [(300, "ab" * 400), (301, ("ab" * 60) + "c" + "ba" * 70)]
    docs = edge_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    key = {(r.doc_id, r.text): r.t for r in docs.selectExpr("doc_id", "text", "xxhash64(text) t").collect()}
    every = [*edge_rows, *rows]
    order = sorted(set(every), key=lambda r: (r[0] is None, r[0] or 0, key[r]))
    seen, want_of = set(), {}
    for r in order:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 99):
            if b[a:a + 100] in seen:
                gone[a:a + 100] = b"\1" * 100
            seen.add(b[a:a + 100])
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        want_of[r] = (r[0], len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in repeats.repeat_digest(docs).collect())
    assert got == Counter(want_of[r] for r in every)
    assert repeats.repeat_digest(no_docs).collect() == []


def test_repeats_keep_the_first_of_repeated_rows(spark):
    """Rows with equal id and text are one document: alone they lose nothing, and a later document loses its copy."""
    rng = random.Random(8)
    own, part = ("".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (400, 130))
    rows = [(1, own), (1, own), (1, own), (2, part + "x" + own[:60]), (2, part + "x" + own[:60]), (3, "begin " + part[:121] + " end"),
            (None, own[::-1]), (None, own[::-1])]
    got = Counter((r.doc_id, bytes(r.kept).decode(), r.n_removed) for r in
                  repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == Counter([(i, t, 0) if i != 3 else (3, "begin  end", 121) for i, t in rows])


def test_line_dedup(spark, edge_docs, no_docs):
    line = " ".join(f"v{i}" for i in range(60)) + "."
    short = "Short line here."
    rows = [(50, f"{short}\nOwn start of the first.\n{line}\n{short}"), (51, f"Other begin.\n{line}\nOther end."), (52, line),
            (53, "A clean text. It has two lines.\nAnd a third one."), (54, f"{line}\n{line}"), (55, f"{short}\nNothing else repeats here.")]
    docs = edge_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    out = {(r.doc_id, r.text) for r in line_dedup.dedupe_lines(docs).collect()}
    assert {(50, rows[0][1]), (51, "Other begin.\nOther end."), (52, ""), (53, rows[3][1]), (54, ""), (55, rows[5][1]), (3, None), (4, "")} <= out
    left = line_dedup.drop_repeated_lines(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert 52 not in ids and 54 not in ids and ids[2] == 2 and ids[None] == 2 and {3, 4, 5} <= set(ids)
    assert line_dedup.line_digest(no_docs).collect() == []


def test_line_dedup_finds_every_long_run(spark):
    """Every run of two or more lines with at least min_words words that stands earlier is deleted."""
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 99)) for _ in range(rng.randint(3, 14))) + "." for _ in range(80)]
    rows = []
    for i in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 4))] + pool[(a := rng.randint(0, 70)): a + rng.randint(2, 8)] + [f"own {i} line."]
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first: set[str] = set()
    for i, t in rows:
        kept = set(got[i].split("\n"))
        for line in t.split("\n"):
            assert line in kept or line in first or t.split("\n").count(line) > 1     # nothing is lost
        first |= set(t.split("\n"))


def brute_lines(rows: list[tuple[int, str]], least: int = 20) -> Counter:
    """What is left of each text when every run of lines with at least ``least`` words that stands earlier goes."""
    seen, out = set(), Counter()
    for i, t in rows:
        lines = t.split("\n")
        count = [len(x.split()) for x in lines]
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(count[a:b]) >= least:
                    if (run := tuple(lines[a:b])) in seen:
                        gone.update(range(a, b))
                    seen.add(run)
        out[i, tuple(x for k, x in enumerate(lines) if k not in gone), sum(count[k] > 0 for k in gone)] += 1
    return out


def line_result(spark, rows: list[tuple[int, str]]) -> Counter:
    out = line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return Counter((r.doc_id, tuple(r.text.rstrip("\n").split("\n")) if r.text else (), r._n_removed) for r in out)


def test_line_dedup_with_a_common_line(spark):
    """Runs around a line that stands first elsewhere, and a text's own repeats of it, are found."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    pool = ["In.", "Un.", "In."] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) + "." for _ in range(12)]
    rows = [(0, "In.\nNothing else of it."), (1, "Un.\n" + "\n".join(["In."] * 53) + "\nend one")]
    song = [rng.choice(pool) for _ in range(60)]
    for i in range(2, 60):
        a = rng.randint(0, 50)
        rows.append((i, "\n".join([rng.choice(pool) for _ in range(rng.randint(1, 9))] + song[a: a + rng.randint(3, 14)] + [f"own {i}"])))
    want = brute_lines(rows)
    assert sum(k[2] for k in want) > 60
    assert line_result(spark, rows) == want


def test_line_dedup_finds_every_run_of_twenty_words(spark):
    """Also runs of two lines of fewer than 20 words each, against brute force; blank lines count as lines."""
    rng = random.Random(11)
    pool = [" ".join(f"p{i}q{k}" for k in range(rng.randint(8, 19))) for i in range(60)]
    rows = []
    for i in range(80):
        a, b = rng.randint(0, 58), rng.randint(0, 55)
        rows.append((i, "\n".join([f"own {i} first", *pool[a: a + 2], f"own {i} middle", *pool[b: b + rng.randint(1, 5)], *[""] * rng.randint(0, 1), *pool[a: a + 2], f"own {i}"])))
    want = brute_lines(rows)
    assert sum(k[2] for k in want) > 200
    assert line_result(spark, rows) == want


def test_license_scan(spark, edge_docs, no_docs):
    from stockflow.llm.license_texts import MIT
    known = licenses.known_licenses(spark)
    rows = [(60, "Copyright (c) 2020 Someone\n\n" + MIT.replace("sublicense", "sub-license").upper()), (61, "Text.\nReleased under the MIT Licence!\nMore."),
            (62, "© 1999 A\nlicensed under cc by-nc 4.0"), (62, "© 1999 A\nlicensed under cc by-nc 4.0")]
    docs = edge_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = Counter((r.doc_id, r.license_id, r.n_notice_lines, r.notices) for r in licenses.scan_licenses(docs, known).collect())
    assert got[60, "MIT", 0, ""] == 1 and got[61, None, 1, "MIT"] == 1 and got[62, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"] == 2
    assert got[2, None, 0, ""] == 2 and got[3, None, 0, ""] == 1
    assert licenses.scan_licenses(no_docs, known).collect() == []


def test_sharding(edge_docs, edge_rows, no_docs):
    rows = sharding.shard_documents(edge_docs, shards=3, rows_per_block=2).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 3) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in edge_rows)
    assert sharding.shard_documents(no_docs).collect() == []


def test_token_files(spark, edge_docs, edge_rows, no_docs):
    from tokenizers import Tokenizer
    from stockflow.llm.tokens import tokenizer_path
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = sorted(token_files.token_files(edge_docs).collect(), key=lambda r: r.start)
    at, ids = 0, [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = Counter()
    for i, t in edge_rows:
        raw = b"".join(x.to_bytes(4, "little") for x in [*tok.encode(t or "", add_special_tokens=False).ids, 1])
        want[i, len(raw) // 4, zlib.crc32(raw)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert token_files.token_files(no_docs).collect() == []


def test_packing(edge_docs, edge_rows, no_docs):
    rows = packing.pack_documents(edge_docs.coalesce(1), with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends[r.sequence_id] == r.offset
        ends[r.sequence_id] += r.length
    assert all(n & (n - 1) == 0 and n <= 2048 for n in ends.values())
    assert sum(r.length for r in rows if r.start == 0 and r.doc_id == 3) == 1
    assert len({r.sequence_id for r in rows}) == len(ends) and packing.pack_documents(no_docs).collect() == []


def test_quality(edge_docs, edge_rows, tiny_labels, no_labels, no_docs):
    def brute(text):
        t = text or ""
        w = re.findall(WORD, t)
        seen, dup = set(), 0
        for x in (x for x in t.split("\n") if re.search(WORD, x)):
            dup += x in seen
            seen.add(x)
        n = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if n[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)
    for labels in (tiny_labels, no_labels):
        rows = quality.rate_documents(edge_docs, labels).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == Counter(
            (i, *brute(t)) for i, t in edge_rows)
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality.rate_documents(no_docs, tiny_labels).collect() == []


def test_quality_counts_every_trusted_document(spark, monkeypatch):
    docs = spark.range(20_500).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert not quality.likelihood_ratios(docs, labels).any()
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 10)
    assert not quality.likelihood_ratios(docs, labels).any()


def test_toxicity(edge_docs, edge_rows, tiny_labels, no_labels, no_docs):
    for labels in (tiny_labels, no_labels):
        rows = toxicity.score_documents(edge_docs, labels).collect()
        assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in rows)
    assert toxicity.score_documents(no_docs, tiny_labels).collect() == []
    assert toxicity.drop_toxic(edge_docs, no_labels).columns == edge_docs.columns


def test_toxicity_trains_on_every_sample(monkeypatch):
    """Texts that sort last reach the ordinary dictionary however many stand before them."""
    trained = []
    monkeypatch.setattr(toxicity, "_dictionary", lambda samples, size: trained.append(samples) or b"x" * 64)
    rows = [(f"a{chr(97 + i // 26)}{chr(97 + i % 26)} " + "ordinary words " * 400, 0, False) for i in range(650)]
    toxicity.fit([*rows, ("zulu " * 8, 0, False), ("bad thing", 1, False), ("bad thing here", 1, True), ("fine", 0, True)])
    assert len(trained[1]) > 60_000 and any(b"zulu" in s for s in trained[1])


def test_toxicity_on_held_out_documents(spark):
    from stockflow.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, label[r.doc_id]) for r in QUERIES["op5_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in label]
    toxic, fine = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in fine) / len(toxic) / len(fine)
    assert auc > 0.95
    assert sum(s >= 0.5 for s in fine) < 0.02 * len(fine) and sum(s >= 0.5 for s in toxic) > 0.8 * len(toxic)


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "one TWO three"), (2, "five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (3, None), (4, "..."),
                                   (5, "word"), (None, "two words"), (6, "x"), (7, "one two three"), (7, "one two three")], "item_id long, text string")
    rows = {(r.doc_id, r.n_words): r for r in decontam.contamination(edge_docs, bench).collect()}
    assert rows[1, 12].n_hit == 3 and rows[1, 12].n_items == 2 and rows[1, 12].items_sha256 == hashlib.sha256(b"1,7").hexdigest()
    assert rows[9, 13].n_hit == 3 and rows[6, 1].n_hit == 1 and rows[7, 1].contaminated
    assert rows[8, 2].n_hit == 2 and rows[8, 2].n_items == 0 and rows[3, 0].n_hit == 0 and not rows[3, 0].contaminated
    assert len(decontam.contamination(edge_docs, bench).collect()) == edge_docs.count()
    assert decontam.contamination(no_docs, bench).collect() == []
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.contamination(edge_docs, empty).collect())
    left = decontam.drop_contaminated(edge_docs, bench)
    assert left.columns == edge_docs.columns and {1, 2, 6, 7, 8, 9}.isdisjoint({r.doc_id for r in left.collect()})


@pytest.mark.parametrize("name", ["op2_license_scans", "op10_decontamination"])
def test_sql_parity(spark, name):
    import duckdb
    from stockflow.llm.queries import ORACLES, QUERIES
    sf = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(want)
