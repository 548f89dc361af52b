"""Token ids of whole texts by the tokenizers library, with the ids of pieces remembered.

A text is cut at every blank that follows something other than white space. Both tokenizer
kinds used here end a token there whatever lies to the left and right, so the ids of the pieces,
put together, are the ids of the text; special tokens hold no blank. Arrow cuts the texts of a batch and
lists its distinct pieces, so Python looks up each of them once a batch; the library encodes each piece
once for as long as the memory of a Python worker holds it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A blank after white space, where no text is cut.
GLUED = (r"[ \t\n\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] ")
CUT = re.compile(r"(?<=\S) ")
#: Longest piece that is remembered, and about how many bytes a generation of them takes; a worker
#: holds two. Bytes of a remembered piece besides its text and ids. Most runs of marks that are remembered.
LONGEST, REMEMBERED, ENTRY, SIGNS_KEPT = 48, 60_000_000, 180, 500
#: Latin letters, then marks, then perhaps a line break, letters and marks. Both tokenizer kinds end a
#: unit wherever these change, so the ids of such a piece are those of its parts.
LETTERS, SIGNS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]", r"[!-&(-/:-@\[-`{-~]"
UNITS = re.compile(f"({LETTERS}+)({SIGNS}*)(?:(\n{LETTERS}+)({SIGNS}*))?")
#: Names that byte-level models give to bytes: printing ones their own, the others the characters
#: from 256 on in order.
_own = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(b) for b in _own} | {
    b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _own)}
BYTES_OF = {c: "".join(BYTE_NAMES[b] for b in chr(c).encode()) for c in range(0x250)}
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Cut(NamedTuple):
    """Texts in pieces; each piece but the first of a text lacks the blank before it. ``words`` are the
    distinct ones, without the first of each text: those are the ``heads``. ``place`` gives for all pieces
    in order their place in words + heads, ``first`` where each text's begin (one bound more)."""

    words: list[str]
    heads: list[str]
    place: np.ndarray
    first: np.ndarray


def cut(texts: pa.Array) -> Cut:
    """The pieces of an Arrow column of texts; null is empty."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    if pc.any(pc.match_substring_regex(texts, GLUED)).as_py():
        lists = pa.array([CUT.split(t) for t in _listed(texts)], lists.type)
    first = lists.offsets.to_numpy().astype(np.int64)
    parts = lists.flatten()
    head = np.zeros(len(parts), bool)
    head[first[:-1]] = True
    rest = parts.filter(pa.array(~head)).dictionary_encode()
    words = _listed(rest.dictionary)
    place = np.empty(len(parts), np.int64)
    place[~head] = rest.indices.to_numpy()
    place[head] = len(words) + np.arange(len(texts))
    return Cut(words, _listed(parts.take(pa.array(first[:-1]))), place, first)


def _listed(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def strung(values: list[bytes], made: Cut) -> tuple[np.ndarray, np.ndarray]:
    """The values of all pieces in order as one run of bytes, and where each text's begin (one bound more).
    ``values`` are those of words + heads."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(made.place))
    _, bounds, data = taken.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(taken) + 1)
    return np.frombuffer(data or b"", np.uint8, bounds[-1]), bounds[made.first]


class Memory:
    """Values of pieces, in two generations: when the younger is full, the older one goes."""

    def __init__(self):
        self.known: dict[str, object] = {}
        self.before: dict[str, object] = {}
        self.held = 0

    def values(self, words: list[str], make: Callable[[list[str]], list], size: Callable[[object], int], most: int) -> list:
        """The value of each distinct word; ``make`` gives those that are not remembered."""
        found = list(map(self.known.get, words))
        missing = [i for i, v in enumerate(found) if v is None]
        for i, v in zip(missing, map(self.before.get, [words[i] for i in missing])):
            found[i] = v
        new = [i for i in missing if found[i] is None]
        for i, v in zip(new, make([words[i] for i in new])):
            found[i] = v
        kept = [i for i in missing if len(words[i]) <= LONGEST]
        self.known.update((words[i], found[i]) for i in kept)
        self.held += sum(len(words[i]) + size(found[i]) for i in kept) + ENTRY * len(kept)
        if self.held > most:
            self.known, self.before, self.held = {}, self.known, 0
        return found


class Encoder:
    def __init__(self, path: str, plain_specials: bool = False):
        """``plain_specials``: the strings of special tokens are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_specials
        self.memory = Memory()
        self.folds = self.tokenizer.normalizer is not None
        self.signs: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        # With a token for the end of a word, white space has none.
        self.blank, self.line = ("", []) if self.tokenizer.model.end_of_word_suffix else (BYTE_NAMES[32], self.batch(["\n"])[0])
        probe = ["Hello", "the,", "éÀÿn", "Straße.", "naïve%%%", "a", "of.\nThe,***", "a\nbé"]
        self.plain = self.composed(probe) == [self.value(i) for i in self.batch([" " + w for w in probe])]

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def unit(self, word: str, before: str) -> list[int]:
        """The ids of a word of letters, which goes to the library's model as it is: nothing before the
        model would cut or change it."""
        return [t.id for t in self.tokenize(before + (word if word.isascii() else word.translate(BYTES_OF)))]

    def composed(self, words: list[str]) -> list[bytes | None]:
        """What is remembered of each word that ``UNITS`` describes, put together from its parts, and
        None for the others. Parts that occur in several words are encoded once."""
        match, plus, blank, signs = UNITS.fullmatch, self.plus, self.blank, self.signs
        spaced: dict[str, bytes] = {}
        broken: dict[str, bytes] = {} if blank else spaced
        if len(signs) > SIGNS_KEPT:
            signs.clear()
        out: list[bytes | None] = []
        for found in map(match, map(str.lower, words) if self.folds else words):
            if found is None:
                out.append(None)
                continue
            word, sign, more, last = found.groups()
            value = spaced.get(word)
            if value is None:
                value = spaced[word] = self.value(self.unit(word, blank))
            if sign:
                if sign not in signs:
                    signs[sign] = self.value(self.batch([sign])[0])
                value = plus(value, signs[sign])
            if more:
                part = broken.get(more[1:])
                if part is None:
                    part = broken[more[1:]] = self.value(self.line + self.unit(more[1:], ""))
                value = plus(value, part)
                if last:
                    if last not in signs:
                        signs[last] = self.value(self.batch([last])[0])
                    value = plus(value, signs[last])
            out.append(value)
        return out

    def value(self, ids: list[int]) -> bytes:
        """What is remembered of a piece: its ids as unsigned 32-bit integers."""
        return array("I", ids).tobytes()

    def plus(self, value: bytes, more: bytes) -> bytes:
        return value + more

    def size(self, value: bytes) -> int:
        return len(value)

    def long_ids(self, text: str) -> list[int]:
        return self.batch([text])[0]

    def fresh(self, words: list[str]) -> list:
        """The values of words with a blank before each, not looked up."""
        short = [w if len(w) <= LONGEST else "" for w in words]
        out = self.composed(short) if self.plain else [None] * len(words)
        rest = [i for i, value in enumerate(out) if value is None]
        for i, ids in zip(rest, self.batch([" " + short[i] for i in rest])):
            out[i] = self.value(ids if short[i] == words[i] else self.long_ids(" " + words[i]))
        return out

    def values(self, made: Cut) -> list:
        """The values of words + heads."""
        heads = [
            self.value(ids if len(h) <= LONGEST else self.long_ids(h))
            for h, ids in zip(made.heads, self.batch([h if len(h) <= LONGEST else "" for h in made.heads]))
        ]
        return self.memory.values(made.words, self.fresh, self.size, REMEMBERED) + heads

    def encode(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces in order."""
        made = cut(pa.array(texts, pa.string()))
        values, place = self.values(made), made.place.tolist()
        return [[values[i] for i in place[a:b]] for a, b in pairwise(made.first.tolist())]

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text of an Arrow column its ids as unsigned 32-bit integers; null is empty."""
        made = cut(texts)
        data, bounds = strung(self.values(made), made)
        ids = data.view(np.uint32)
        return [ids[a:b] for a, b in pairwise((bounds // 4).tolist())]


def texts_of(column) -> list[str]:
    """The texts of an Arrow column; null is empty."""
    return [t or "" for t in column.to_pylist()]
