"""Conversation trie, personal data and phrases: brute force, SQL parity, edge rows, empty tables, small limits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stockflow.llm import phrases, pii, prefix_trie

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- trie -----------------------------------------------------------------------------------

def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = Counter()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(made[c]) == len(p)))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(spark, rows):
    schema = "conv_id long, turn long, role string, text string, pos string, depth string, id int, k1 string, n string"
    return spark.createDataFrame([(*r, "p", "d", 1, "k", "n") for r in rows], schema)


@pytest.mark.parametrize("segment,shard,bits", [(1024, 50_000, 10), (3, 20, 1)])
def test_trie(spark, monkeypatch, segment, shard, bits):
    """Copies, ties, null columns, turnless and long conversations; also with tiny segments, shards and ranges."""
    rng = random.Random(3)
    rows = []
    song = [("user" if i % 2 == 0 else "assistant", f"turn {i} é") for i in range(40)]
    for c in [*range(60), 1000, 5003]:
        n = rng.randint(1, 12)
        lines = song[:n] if rng.random() < 0.6 else [(rng.choice(["user", None]), rng.choice(["hello", "", None, f"own {c}"])) for _ in range(n)]
        rows += [(c, i if i % 7 else None, *x) for i, x in enumerate(lines)]
    rows += [(70, i, *song[i % 40]) for i in range(35)] + [(71, i, *song[i % 40]) for i in range(35)] + [(72, 0, "user", "x")] * 3
    rows += [(None, 0, "user", "nobody"), (None, 1, None, None)]
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard)
    monkeypatch.setattr(prefix_trie, "RANGE_BITS", bits)
    monkeypatch.setattr(prefix_trie, "END_BITS", bits)
    got = Counter(tuple(r[c] for c in TRIE) for r in prefix_trie.conversation_trie(conversations(spark, rows)).collect())
    want = brute_trie(rows)
    assert (got - want, want - got) == (Counter(), Counter())


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(conversations(spark, [])).collect() == []


# -- personal data -----------------------------------------------------------------------------

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def pii_texts():
    rng = random.Random(9)
    bits = ["a.b@c.d", "x@y", "é ü@ö.de", "a@b.c_x@d.e", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "0010.0.0.255", "4111 1111 1111 1111",
            "4111-1111-1111-1111", "4111111111111112", "4111111111111111 4111111111111111", "+1 (269) 555-3296 45241322646", "+1 (269) 555-3296",
            "+49 30 1234567", "+1", "++12 345-67.8901", "word", "漢字", ".", ",", " ", "\n", "-", "12", "+", "@", "a@b-.c", "5555555555554444x", "v1.2.3.4"]
    return [rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(300)] + [
        "a" * 60_000 + "@b.co", "a.b." * 20_000, "1" * 60_000, "1 " * 30_000, "x@" + "y." * 20_000 + "z", "+" * 30_000, "+1" + " " * 30_000]


def test_personal_data_base_spans(spark, edge_docs, edge_rows, no_docs):
    rows = [(100 + i, t) for i, t in enumerate(pii_texts())] + [(100, "a.b@c.d"), (100, "a.b@c.d"), (None, "mail a.b@c.d now")]
    docs = edge_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = pii.personal_data(docs).collect()
    want = Counter()
    for i, t in [*edge_rows, *rows]:
        s = base_spans(t)
        n = Counter(x[3] for x in s)
        want[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined(s).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    text = defaultdict(set)
    for i, t in [*edge_rows, *rows]:
        text[i].add(joined(base_spans(t)))
    for r in got:
        listed = [x for x in r.spans.split(",") if x]
        assert any(set(b.split(",")) - {""} <= set(listed) for b in text[r.doc_id])
        assert listed == sorted(listed, key=lambda x: (int(x.split(":")[1]), [k for k, _ in BASE].index(x.split(":")[0])))
    assert pii.personal_data(no_docs).collect() == []


def test_personal_data_adds_swallowed_spans_only(spark):
    phone = "+1 (269) 555-3296"
    rows = [(i, f"call {phone} or write to c{i}@example.com from 10.0.{i}.1, card 4111 1111 1111 1111.") for i in range(40)]
    rows += [(50, f"text {phone} 4111111111111111 text"), (51, "4111111111111111 5555555555554444 both"), (52, "reach me: jane (at) example (dot) com"),
             (53, "version 1.2.3.4.5 of 2024-01-02, order 123-4567, isbn 9781234567890, at noon dot and 12:30:45"), (54, "4111111111111112")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "phone:5:22,card:23:39" and got[51] == "card:0:16,card:17:33"
    assert got[52] == "email:10:37" and got[53] == "ip:8:15" and got[54] == ""
    assert all(got[i] == joined(base_spans(t)) for i, t in rows[:40])


def test_reliabilities_rank_the_labelers():
    """Two good labelers, one that guesses: EM finds the true share and trusts the good ones."""
    rng = random.Random(1)
    seen, truth = Counter(), 0
    for _ in range(4000):
        y = rng.random() < 0.7
        truth += y
        good = [(1 if y else -1) if rng.random() < 0.9 else (-1 if y else 1) for _ in range(3)]
        seen[(*good, rng.choice([-1, 0, 1]))] += 1
    q, rates, share = pii.reliabilities(list(seen.items()))
    assert abs(share - truth / 4000) < 0.05
    assert all(rates[j][1][1] > 0.8 and rates[j][0][1] < 0.2 for j in range(3)) and abs(rates[3][1][1] - rates[3][0][1]) < 0.1


def test_personal_data_runs_without_python(spark):
    docs = spark.createDataFrame([(1, "a.b@c.d")], "doc_id long, text string")
    plan = pii.personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Pandas|Arrow|BatchEvalPython|InPython", plan)


# -- phrases ---------------------------------------------------------------------------------------

def brute_phrases(rows, least):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(100 * b >= 80 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items() if g == lang)
        if not inside:
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for r, (s, a, p, left, right) in enumerate(sorted(v)[:50], 1)}


def phrase_rows():
    rng = random.Random(7)
    words = ["the", "of", "The", "and", "a\xa0b", "x*", "漢字", "in", "es", "en"]
    passage = "once upon a time there was a hot pair"
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "!\n", "\t", "  "]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "es", None, "und"]), text + (f" {passage}." if i % 2 else "") + rng.choice(["", " the of the of the of"])))
    return [*rows, ("en", None), (None, ""), ("en", " \t\n "), ("fr", "seul"), *[("en", passage)] * 9]


@pytest.mark.parametrize("hot,held,chunk", [(1 << 17, 1 << 20, 1 << 17), (8, 40, 16)])
def test_collocations(spark, monkeypatch, hot, held, chunk):
    """Also where pairs are routed by three words and tasks hold and sort only a few pointers at a time."""
    rows = phrase_rows()
    monkeypatch.setattr(phrases, "HOT_PAIR", hot)
    monkeypatch.setattr(phrases, "HELD_ROWS", held)
    monkeypatch.setattr(phrases, "CHUNK_ROWS", chunk)
    docs = spark.createDataFrame([(t, g, "a", 1, "k") for g, t in rows], "text string, lang string, phrase string, words int, key string").repartition(3)
    got = {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(docs, least=5, top=50).collect()}
    want = brute_phrases(rows, 5)
    assert len(want) > 40 and got == want
    assert phrases.collocations(docs.where("false")).collect() == []


def test_pointers_meet_in_few_tasks(spark, monkeypatch):
    """Texts in many partitions make as few pointers as texts in a few: equal ones are added up per core."""
    rows, made, plain = phrase_rows() * 4, spark.sparkContext.accumulator(0), phrases._pointers
    def counted(*args):
        run = plain(*args)
        def go(batches):
            for out in run(batches):
                made.add(len(out))
                yield out
        return go
    monkeypatch.setattr(phrases, "_pointers", counted)
    monkeypatch.setattr(phrases, "POINTER_WAVES", 1)
    docs, of = spark.createDataFrame(rows, "lang string, text string"), {}
    for parts in (spark.sparkContext.defaultParallelism, 40):
        before = made.value
        want = phrases.phrase_counts(docs.repartition(parts), least=5).collect()
        of[parts] = (Counter(map(tuple, want)), made.value - before)
    few, many = of.values()
    assert few[0] == many[0] and many[1] <= 1.5 * few[1]


def test_held_pointers_keep_the_heavy_ones():
    def batch(keys, c):
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(["en"] * n), pa.array(keys, pa.int64()), pa.array([False] * n),
                                           pa.array([2] * n, pa.int32()), pa.array([f"a {k}" for k in keys]),
                                           pa.array([c] * n, pa.int64())], names=phrases.FIELDS)
    held, out = phrases.Held(20), []
    for turn in range(10):
        for b in (batch(range(5), 3), batch(range(100 + 20 * turn, 120 + 20 * turn), 1)):
            out += list(held.add(b))
    out += list(held.rest())
    total, rows = Counter(), Counter()
    for b in out:
        for r in b.to_pylist():
            total[r["phrase"]] += r["c"]
            rows[r["phrase"]] += 1
    assert total == Counter({f"a {k}": 30 for k in range(5)} | {f"a {k}": 1 for k in range(100, 300)})
    assert max(rows.values()) == 1


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 4, (300, 4)).astype(np.int32)
    symbols[rng.random(300) < 0.3, 2:] = -1
    symbols[:, 0] = 0
    weight = rng.integers(1, 5, 300)
    got = Counter({tuple(symbols[at, 1: d + 1]): w for at, d, w in phrases.quicksort(symbols, weight, np.zeros(300, dtype=bool), 9)})
    want = Counter()
    for row, w in zip(symbols, weight):
        for d in range(1, 4):
            if row[d] >= 0:
                want[tuple(row[1: d + 1])] += int(w)
    assert got == Counter({k: v for k, v in want.items() if v >= 9})


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op13_phrase_collocations"])
def test_sql_parity(spark, name):
    import duckdb
    from stockflow.llm.queries import ORACLES, QUERIES
    sf = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert want and Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(want)
