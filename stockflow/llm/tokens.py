"""Exact, cached tokenising of whole texts in Spark tasks with the public tokenizer files.

Both tokenizers cut a text into pre-tokens (words, numbers, runs of signs) by a pattern and merge bytes
inside each. Where a text holds only plain letters, digits, signs and white space, that pattern is
applied here (for whole batches on byte classes where there is no apostrophe) and each distinct pre-token
goes to the tokenizer's merge model once. Any other text is
cut at spaces where no rule looks across (for the tokenizer that keeps a space with the next word: at
single spaces between two other non-white characters) and each distinct piece goes through the whole
tokenizer once. ``ids_of`` therefore equals ``encode(text)``; the tests hold both against each other.

Words repeat all over a corpus: each worker keeps the ids of those it has met, at most ``CACHE`` of
them (a full cache starts afresh), so memory is bounded and results don't change. Long texts are taken
in stretches of about ``STRETCH`` characters, cut at such spaces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from stockflow.llm import textkit as tk

CACHE = 400_000
LONG = 48
STRETCH = 1 << 19
_L = "A-Za-zÀ-ÖØ-öø-ÿ"          # letters that stay single letters under NFC and lower-casing
_S = r"""!"#$%&'()*+,\-./:;=>?@\[\]\\^_`{|}~"""    # ASCII signs without <, which may open a special token
_PLAIN = re.compile(f"[{_L}{_S}0-9 \n\t\r]*")
#: fixed patterns: the pre-token rules of the two tokenizer files on the plain characters
_WORD_RULE = re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[{_S}]+")
_BYTE_RULE = re.compile(rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[{_S}]+|\s+(?!\S)|\s+")


_WHITE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[list(b" \n\t\r")] = _WHITE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[list(b"!\"#$%&()*+,-./:;=>?@[]\\^_`{|}~")] = _SIGN         # no apostrophe: it may open a contraction
_CLASS[0x80:0xC0] = _CLASS[0xC3] = _LETTER                        # the two bytes of a Latin-1 letter


def _odd_bytes(data: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where a text leaves the plain characters: other bytes, or two bytes that are no Latin-1 letter."""
    odd = c == _OTHER
    high = data >= 0x80
    if high.any():
        lead = data == 0xC3
        tail = high & ~lead
        after = np.zeros(len(data), dtype=bool)
        after[1:] = lead[:-1]
        odd |= tail != after
        odd |= tail & ((data == 0x97) | (data == 0xB7))
        odd[-1] |= lead[-1]
    return odd


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()


class _Cache(dict):
    """text -> little-endian ids as bytes, computed when first asked for."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, text: str) -> bytes:
        ids = array("I", self.compute(text)).tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(text) <= LONG:
            self[text] = ids
        return ids


class Encoder:
    """keep_space: the space belongs to the word after it, and case counts."""

    def __init__(self, path: str, keep_space: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.keep_space = keep_space
        self.words = _Cache(self._merge)
        self.pieces = _Cache(self._whole)
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)

    def _merge(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_ALPHABET))]

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def ids_of(self, text: str) -> np.ndarray:
        """All ids of a text."""
        return np.frombuffer(b"".join(map(self._stretch, stretches(text))), dtype="<u4")

    def batch(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice (UTF-8 bytes and n + 1 offsets): flat ids and n + 1 offsets."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros(n + 1, dtype=np.int64)
        c = _CLASS[data]
        strange = np.bincount(np.searchsorted(off, np.flatnonzero(_odd_bytes(data, c)), side="right") - 1, minlength=n) > 0
        if strange.any():
            sizes = np.diff(off)
            plain = ~np.repeat(strange, sizes)
            flat, where = self.batch(data[plain], tk.run_offsets(np.where(strange, 0, sizes)))
            parts = [self.ids_of(data[off[r]: off[r + 1]].tobytes().decode()) if odd_text else flat[where[r]: where[r + 1]]
                     for r, odd_text in enumerate(strange.tolist())]
            return np.concatenate(parts), tk.run_offsets(np.array([len(x) for x in parts]))
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[0] = True
        cut[1:-1] = c[1:] != c[:-1]
        if self.keep_space:
            # the last white character before a word stands alone, a space goes with the word
            after = np.flatnonzero((c[1:] != _WHITE) & (c[:-1] == _WHITE)) + 1
            first = np.zeros(len(data) + 1, dtype=bool)
            first[off] = True
            after = after[~first[after]]
            cut[after - 1] = True
            cut[after] = data[after - 1] != 0x20
        else:
            cut[:-1] |= c == _DIGIT
        cut[off] = True
        at = np.flatnonzero(cut)
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        known = self.words
        ids = [known[w] for w in words.dictionary.to_pylist()] if self.keep_space else [
            b"" if w.isspace() else known[w.lower()] for w in words.dictionary.to_pylist()]
        lists = pa.ListArray.from_arrays(pa.array(tk.run_offsets(np.array([len(x) // 4 for x in ids])).astype(np.int32)),
                                         pa.array(np.frombuffer(b"".join(ids), dtype="<u4")))
        lists = lists.take(words.indices)
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        where = ends[np.searchsorted(at, off)].astype(np.int64)
        return flat, where

    def _stretch(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            if self.keep_space:
                return b"".join(map(self.words.__getitem__, _BYTE_RULE.findall(text)))
            return b"".join(map(self.words.__getitem__, _WORD_RULE.findall(text.lower())))
        if not self.keep_space:
            return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        pieces: list[list[str]] = []
        last = ""
        for p in text.split(" "):
            if last and p and not last[-1].isspace() and not p[0].isspace():
                pieces.append(["", p])
            elif pieces:
                pieces[-1].append(p)
            else:
                pieces.append([p])
            last = p
        return b"".join(map(self.pieces.__getitem__, [" ".join(x) for x in pieces]))


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about STRETCH characters, cut before single spaces between non-white characters."""
    a, n = 0, len(text)
    while n - a > STRETCH:
        cut = text.find(" ", a + STRETCH)
        while cut != -1 and (cut + 1 >= n or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[a:cut]
        a = cut
    yield text[a:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, keep_space: bool) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, keep_space)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
