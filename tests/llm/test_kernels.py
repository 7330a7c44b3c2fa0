"""Kernels without Spark: words, hashes, tokens, suffix array, Huffman codes."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from stockflow.llm import textkit as tk
from stockflow.llm.packing import Packer
from stockflow.llm.repeats import pieces, suffix_array
from stockflow.llm.sharding import jump_hash
from stockflow.llm.token_files import code_lengths, canonical_codes, decode_stream, decode_table, encode_stream
from stockflow.llm.tokens import Encoder, tokenizer_path

TEXT = st.text(alphabet=st.sampled_from(list("aAbZz09 \n\t\r.,!-éß×漢́\x1c\x00'<|")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_follow_the_pattern(texts):
    data, off = tk.text_buffers(pa.array(texts, pa.string()))
    for table, pattern, low in ((tk.SPACE_SEPARATED, r"[^\x20\x09-\x0D]+", False), (tk.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        start, end, row = tk.words(data, off, table)
        got = [(r, data[a:b].tobytes().decode()) for r, a, b in zip(row, start, end)]
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, (t or "").translate(lower) if low else t or "")]
        assert [(r, w.translate(lower) if low else w) for r, w in got] == want
        h = tk.word_hashes(data, start, end, lower=True).tolist()
        by_word: dict[str, int] = {}
        for (_, w), x in zip(got, h):
            assert by_word.setdefault(w.translate(lower), x) == x
        assert len(set(by_word.values())) == len(by_word)


def test_word_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(tk, "CHUNK", 16)
    data, off = tk.text_buffers(pa.array(["ab " + "q" * 50 + " cd", "q" * 50]))
    start, end, _ = tk.words(data, off, tk.SPACE_SEPARATED)
    h = tk.word_hashes(data, start, end)
    assert h[1] == h[3] and len(set(h.tolist())) == 3


def test_batches_and_texts_tokenise_like_the_tokenizer():
    rng = random.Random(5)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "B", "é", "É", "é", "́", "1", "23", "'s", "'LL", "!!", "#", "<|endoftext|>", "\x1c", "漢字",
            "İ", "ﬁ", "ß", "×", "÷", "\x00", "word", "The", "각"]
    texts = ["".join(rng.choice(bits[:14] if rng.random() < .7 else bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + ["", "a b" * 2000]
    for name, keep in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        enc = Encoder(tokenizer_path(name), keep)
        want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert [enc.ids_of(t).tolist() for t in texts] == want
        flat, at = enc.batch(*tk.text_buffers(pa.array(texts)))
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_long_texts_are_cut_safely(monkeypatch):
    import stockflow.llm.tokens as tokens
    monkeypatch.setattr(tokens, "STRETCH", 20)
    text = "Some words,  two spaces \n and 漢字 lines. " * 9
    for name, keep in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        enc = Encoder(tokenizer_path(name), keep)
        assert enc.ids_of(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffix_array(symbols):
    s = [*symbols, 0]
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    part = rng.integers(97, 101, 400, dtype=np.uint8)
    a = np.concatenate([rng.integers(97, 123, 90, dtype=np.uint8), part])
    b = np.concatenate([rng.integers(97, 123, 33, dtype=np.uint8), part, rng.integers(97, 123, 50, dtype=np.uint8)])
    def keys(x):
        first, count, anchor, gram, _ = pieces(x)
        return {int(f) + w: (int(g), int(at) - int(f) - w) for f, c, at, g in zip(first, count, anchor, gram) for w in range(c)}
    ka, kb = keys(a), keys(b)
    for i in range(300):
        assert ka[90 + i] == kb[33 + i]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000))
def test_huffman_round_trip(values):
    ids = np.array(values, dtype=np.uint16)
    counts = np.bincount(ids, minlength=301)
    lengths = code_lengths(counts, 12)
    used = lengths[lengths > 0].astype(float)
    assert (lengths > 0).tolist() == (counts > 0).tolist() and lengths.max() <= 12 and (2.0 ** -used).sum() <= 1
    stream, marks = encode_stream(ids, canonical_codes(lengths), lengths)
    assert (decode_stream(stream, marks, len(ids), *decode_table(lengths)) == ids).all()


def test_code_lengths_are_optimal_without_a_limit():
    import heapq
    counts = np.random.default_rng(1).integers(1, 1000, 60)
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert int((counts * code_lengths(counts, 24)).sum()) == total
    assert int((counts * code_lengths(counts, 6)).sum()) >= total


def test_jump_hash_moves_rows_only_into_the_new_shard():
    keys = np.arange(-5000, 5000)
    for n in (1, 2, 7, 40):
        a, b = jump_hash(keys, n), jump_hash(keys, n + 1)
        assert a.min() >= 0 and a.max() < n and set(b[a != b]) <= {n}
    assert np.bincount(jump_hash(keys, 10)).min() > 850


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 6000), max_size=60))
def test_packer_fills_every_sequence(sizes):
    p = Packer((2048, 1024, 512, 256), 1 << 14, 0)
    for k, n in enumerate(sizes):
        p.add((k, n), np.full(n, k, dtype="<u4"))
    p.finish()
    seqs: dict[int, int] = {}
    seen: dict[int, list] = {}
    for (doc, _), start, ids, seq, at, tier, _ in p.out:
        assert seqs.get(seq, 0) == at
        seqs[seq] = at + len(ids)
        seen.setdefault(doc, []).append((start, len(ids)))
    assert all(n & (n - 1) == 0 and n <= 2048 for n in seqs.values())
    for k, n in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at
            at += length
        assert at == n
