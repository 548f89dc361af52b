"""BPE encoding and decoding of whole texts; long unsplit text by tree concatenation.

A long stretch that the tokenizer does not split is cut in halves down to short leaves. The
leaves are encoded side by side, then neighbours are joined: a window of tokens around the
join is encoded anew, and grows until its first and last token are those that were there. Then
every pair of neighbouring tokens is one that BPE leaves apart, and the whole is exactly what
encoding it in one piece gives.
"""

from __future__ import annotations

import hashlib
import json
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from flowgauge.llm.common import in_slices
from flowgauge.llm.tokens import Encoder, texts_of

LEAF, WINDOW = 512, 8
SCHEMA = "doc_id long, ids binary, decoded string"
_trees: dict[str, "TreeEncoder"] = {}


class TreeEncoder(Encoder):
    """Encoder that remembers ids and decoded text, and encodes long stretches as trees."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.names: list[str] = []
        super().__init__(path)
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.last = self.tokenizer.model
        self.inner = BPE(vocab=model["vocab"], merges=merges) if self.suffix else self.last
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.leaf = leaf

    def value(self, ids: list[int]) -> tuple[bytes, str]:
        if not self.names:
            self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        return super().value(ids), " ".join([self.names[i] for i in ids])

    def plus(self, value: tuple[bytes, str], more: tuple[bytes, str]) -> tuple[bytes, str]:
        return value[0] + more[0], f"{value[1]} {more[1]}" if value[1] else more[1]

    def size(self, value: tuple[bytes, str]) -> int:
        return len(value[0]) + len(value[1]) + 100

    def model_ids(self, text: str, last: bool) -> list[int]:
        return [t.id for t in (self.last if last else self.inner).tokenize(text)] if text else []

    def text_of(self, ids: list[int]) -> str:
        return "".join([self.tokenizer.id_to_token(i) for i in ids])

    def joined(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The ids of two neighbouring stretches; ``last`` if the right one ends the word."""
        width = WINDOW
        while left and right:
            a, b = max(0, len(left) - width), min(len(right), width)
            ends = last and b == len(right)
            text = self.text_of(left[a:] + right[:b])
            if ends and self.suffix:
                text = text.removesuffix(self.suffix)
            new = self.model_ids(text, ends)
            if (a == 0 or new[0] == left[a]) and (b == len(right) or new[-1] == right[b - 1]):
                return left[:a] + new + right[b:]
            width *= 2
        return left or right

    def tree(self, text: str) -> list[int]:
        """The ids of one unsplit stretch."""
        leaves = [text[i : i + self.leaf] for i in range(0, len(text), self.leaf)]
        final = len(leaves) - 1
        with ThreadPoolExecutor(2) as pool:
            level = list(pool.map(self.model_ids, leaves, [i == final for i in range(len(leaves))]))
        while len(level) > 1:
            level = [
                self.joined(level[i], level[i + 1], i + 2 >= len(level)) if i + 1 < len(level) else level[i]
                for i in range(0, len(level), 2)
            ]
        return level[0] if level else []

    def long_ids(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            if self.tokenizer.normalizer is not None:
                part = self.tokenizer.normalizer.normalize_str(part)
            for stretch, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                ids += self.tree(stretch) if len(stretch) > self.leaf else self.model_ids(stretch, True)
        return ids


def tree_encoder(path: str) -> TreeEncoder:
    if path not in _trees:
        _trees[path] = TreeEncoder(path)
    return _trees[path]


def encode_decode(texts: list[str], path: str) -> list[tuple[bytes, str]]:
    """For each text its ids as unsigned 32-bit integers and the decoded text."""
    out = []
    for values in tree_encoder(path).encode(texts):
        out.append((b"".join([v[0] for v in values]), " ".join([v[1] for v in values if v[1]])))
    return out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``docs`` (doc_id, text, ...).

    ids are little-endian unsigned 32-bit integers. A null or blank text has no ids and decodes
    to the empty text. Repeated rows and null doc_ids stay; other columns play no part.
    """
    return _run(docs, path, SCHEMA, lambda ids, text: (ids, text))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), the digests taken where the text is encoded,
    so that ids and texts need not leave the task."""

    def digest(ids: bytes, text: str):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _run(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _run(docs: DataFrame, path: str, schema: str, make) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in in_slices(batch, "text"):
                rows = [make(*pair) for pair in encode_decode(texts_of(part.column("text")), path)]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
