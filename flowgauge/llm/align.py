"""Token alignment of two tokenizers over the same texts.

Both tokenizers encode a space and the whole text. Neither has a token across a blank that follows
something other than white space, so the ids of the pieces between such blanks, put together, are the
ids of the text (``tokens``); both sides' ids of a piece are remembered together. The tokens of a batch
of texts lie one after the other: the bytes where tokens of both sides end, the groups and the links are
found for all of them at once.

A group ends at every byte where tokens of both sides end. Its last two tokens are linked. The counts
of linked id pairs over the corpus come from a second pass over the links: summed in every
task, then by pair. Of two tokens that end together the bytes of one end with those of the other, so the
pairs that can occur are bounded by the vocabularies (``possible_pairs``), whatever the corpus; their
counts are what a third pass gets by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import in_slices, written
from flowgauge.llm.tokens import BYTE_NAMES, Encoder, Memory, cut, strung

#: Bytes of pieces with their ids on both sides in a generation, about; a worker remembers two.
REMEMBERED = 80_000_000
SPACE_MARK = "▁"
_sides: dict[tuple[str, str], "Aligner"] = {}


class ByteSide:
    """Byte-level BPE: ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, plain_specials=True)
        tokenizer = self.encoder.tokenizer
        code = {name: byte for byte, name in BYTE_NAMES.items()}
        self.bytes = []
        for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
            token = tokenizer.id_to_token(i)
            known = token is not None and all(c in code for c in token)
            self.bytes.append(bytes(code[c] for c in token) if known else (token or "").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.encoder.batch([" " + t for t in texts])]


class PieceSide:
    """Pieces with byte fallback; the tokenizer itself puts the space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())

        self.splits = self._splits()
        one = self.model.encode("a")
        self.blank = self.model.encode("a ")[len(one) :]

    def _splits(self) -> bool:
        """Whether a text is encoded piece by piece: it is not rewritten but for the space before it, and
        no token goes on after a blank that follows something else."""
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        rules = spec.normalizer_spec
        kept = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
        own = any(p.type == p.USER_DEFINED for p in spec.pieces) or spec.trainer_spec.treat_whitespace_as_suffix
        return bool(kept and not rules.remove_extra_whitespaces and not own and not any(
            SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in spec.pieces))

    def ids(self, words: list[str]) -> list[list[int]]:
        """The ids of each word with a blank before it; the model itself adds one to what is not empty."""
        return [ids if w else self.blank for w, ids in zip(words, self.model.encode(words, num_threads=1))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can end together: those of which one's bytes end with the other's."""
    many_a: dict[bytes, int] = {}
    many_b: dict[bytes, int] = {}
    for tokens, many in ((a, many_a), (b, many_b)):
        for token in tokens:
            many[token] = many.get(token, 0) + 1
    longer_a = sum(n * many_b.get(t[i:], 0) for t, n in many_a.items() for i in range(len(t)))
    return longer_a + sum(n * many_a.get(t[i:], 0) for t, n in many_b.items() for i in range(1, len(t)))


class Aligner:
    """Encodes texts on both sides and aligns them, many at once."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = ByteSide(path_a), PieceSide(path_b)
        self.sizes = [np.array([len(t) for t in s.bytes], np.int64) for s in self.sides]
        self.tokens = [pa.array(s.bytes, pa.large_binary()) for s in self.sides]
        self.width = len(self.sides[1].bytes)
        # What follows an id tells whether its side's group goes on.
        ends = zip(self.sides, (",|", ",;"))
        self.names = pa.array([f"{i}{c}" for s, two in ends for c in two for i in range(len(s.bytes))], pa.large_string())
        self.memory = Memory()

    @property
    def held(self) -> int:
        return self.memory.held

    def fresh(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of words with a blank before each, on both sides."""
        a, b = self.sides
        return list(zip(a.encoder.fresh(words), map(a.encoder.value, b.ids(words))))

    def heads(self, heads: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of what begins a text; it has its own blank, or is empty."""
        a, b = self.sides
        of_b = [ids if h else [] for h, ids in zip(heads, b.ids([h[1:] for h in heads]))]
        return [(a.encoder.value(x), a.encoder.value(y)) for x, y in zip(a.encoder.batch(heads), of_b)]

    def ids(self, spaced: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts one after the other, and where each text's begin (one bound
        more). The texts have the space before them."""
        a, b = self.sides
        if not b.splits:
            texts = [t[1:] for t in spaced.to_pylist()]
            both = [side.encode(texts) for side in self.sides]
            return [(np.concatenate(ids), np.cumsum([0, *map(len, ids)])) for ids in both]
        made = cut(spaced)
        values = self.memory.values(made.words, self.fresh, lambda v: len(v[0]) + len(v[1]) + 100, REMEMBERED)
        values += self.heads(made.heads)
        out = []
        for side in (0, 1):
            data, first = strung([v[side] for v in values], made)
            out.append((data.view(np.uint32), first // 4))
        return out

    def joined(self, side: int, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, put together."""
        _, bounds, data = self.tokens[side].take(pa.array(ids)).buffers()
        return np.frombuffer(data or b"", np.uint8, np.frombuffer(bounds, np.int64, len(ids) + 1)[-1])

    def whole(self, side: int, ids: np.ndarray, first: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For each text whether the bytes of its tokens are its own; texts lie in ``data`` from ``begin``."""
        ends = np.concatenate(([0], np.cumsum(self.sizes[side][ids])))[first]
        own = self.joined(side, ids)
        if np.array_equal(ends, begin) and np.array_equal(own, data):
            return np.ones(len(begin) - 1, bool)
        return np.array([np.array_equal(own[i:j], data[k:m]) for (i, j), (k, m) in zip(pairwise(ends), pairwise(begin))])

    def grouped(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> Iterator[tuple[str, bytes]]:
        """Groups and links of texts whose tokens follow each other, over the same bytes on both sides."""
        (end_a, closes_a), (end_b, closes_b) = ends = [
            (at, np.zeros(len(at), bool)) for at in (np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b)))]
        for (at, closes), (other, _) in zip(ends, reversed(ends)):
            mark = np.zeros(int(at[-1]) + 1 if len(at) else 1, bool)
            mark[other] = True
            closes[:] = mark[at]
        last_a, last_b = np.flatnonzero(closes_a), np.flatnonzero(closes_b)
        links = (a[last_a].astype(np.int64) * self.width + b[last_b]).tobytes()
        # Tokens in the order of groups, a group's A side first.
        n_a, n_b = np.concatenate(([0], last_a + 1)), np.concatenate(([0], last_b + 1))
        place_a = np.arange(len(a)) + n_b[np.cumsum(closes_a) - closes_a]
        place_b = np.arange(len(b)) + n_a[1:][np.cumsum(closes_b) - closes_b]
        name = np.empty(len(a) + len(b), np.int64)
        name[place_a] = a + closes_a * len(self.sizes[0])
        name[place_b] = b + closes_b * self.width + 2 * len(self.sizes[0])
        _, bounds, text = self.names.take(pa.array(name)).buffers()
        at = np.frombuffer(bounds, np.int64, len(name) + 1)[first_a + first_b].tolist()
        text = memoryview(text or b"")
        link = (8 * np.searchsorted(last_a, first_a)).tolist()
        for (i, j), (k, m) in zip(pairwise(at), pairwise(link)):
            yield str(text[i : max(i, j - 1)], "ascii"), links[k:m]

    def aligned(self, a: list[int], b: list[int]) -> tuple[str, bytes]:
        """Groups and links of two stretches of tokens over the same bytes."""
        ids = np.array(a, np.uint32), np.array(b, np.uint32)
        return next(self.grouped(*ids, *(np.array([0, len(i)]) for i in ids)))

    def documents(self, texts: list[str | None] | pa.Array) -> Iterator[tuple[int, int, str, bytes]]:
        """(n_a, n_b, groups, links) of every text; links are pairs as a * width + b, eight bytes each."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        large = pa.large_string()
        spaced = pc.binary_join_element_wise(pa.scalar(" ", large), texts.cast(large), pa.scalar("", large))
        _, bounds, data = spaced.buffers()
        begin = np.frombuffer(bounds, np.int64, len(spaced) + 1)
        data = np.frombuffer(data, np.uint8, begin[-1])
        sides = self.ids(spaced)
        good = np.diff(begin) > 1
        for side, (ids, first) in enumerate(sides):
            good &= self.whole(side, ids, first, data, begin)
        counts = [np.where(good, np.diff(first), 0) for _, first in sides]
        kept = [ids if good.all() else ids[np.repeat(good, np.diff(first))] for ids, first in sides]
        firsts = [np.concatenate(([0], np.cumsum(n))) for n in counts]
        yield from ((n_a, n_b, *made) for n_a, n_b, made in zip(*(n.tolist() for n in counts), self.grouped(*kept, *firsts)))


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two tokenizer files."""
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = Aligner(path_a, path_b)
    return _sides[path_a, path_b]


def alignments(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, groups, links) for every row of ``docs`` (doc_id, text, ...).

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in token ids, or its SHA-256 with ``digest`` ('' without tokens);
    ``links`` the linked pairs in order, see ``pair_counts``. Null and empty texts, and texts that a
    tokenizer does not give back byte by byte, have no tokens. Special tokens' strings are plain
    text. Repeated rows and null doc_ids stay; other columns play no part. A text is encoded whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("groups", pa.string()), ("links", pa.binary())])

    def run(batches):
        made = aligner(path_a, path_b)
        for batch in batches:
            for part in in_slices(batch, "text", 2_000_000):
                rows = []
                for n_a, n_b, groups, links in made.documents(part.column("text")):
                    rows.append((n_a, n_b, hashlib.sha256(groups.encode()).hexdigest() if digest and n_a else groups, links))
                columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *columns], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_a long, n_b long, groups string, links binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): links of each id pair over all rows of ``aligned`` (links, ...), a pair being
    a * width + b. Summed within a task first, so a task passes on at most the possible pairs."""

    def run(batches):
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            links = np.frombuffer(b"".join(batch.column("links").to_pylist()), np.int64)
            found, n = np.unique(links, return_counts=True)
            both, at = np.unique(np.concatenate((pairs, found)), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate((counts, n)))
            pairs, counts = both, total
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    partial = aligned.select("links").mapInArrow(run, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    count_sum adds up the corpus-wide counts of a document's links; n_best are the links whose count
    is the highest of their B id. Every group ends in one link, so n_links equals n_groups.
    """
    rows = written(alignments(docs, path_a, path_b, digest=True), "alignments")
    table = written(pair_counts(rows), "pair-counts").toArrow()  # no more rows than possible_pairs
    pairs, counts = (table.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs)
    shared = docs.sparkSession.sparkContext.broadcast((pairs[order].tobytes(), counts[order].tobytes()))

    def run(batches):
        import sentencepiece

        width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
        pairs, counts = (np.frombuffer(x, np.int64) for x in shared.value)
        best = np.zeros(width, np.int64)
        np.maximum.at(best, pairs % width, counts)
        top = counts == best[pairs % width]
        for batch in batches:
            out = []
            for links in batch.column("links").to_pylist():
                at = np.searchsorted(pairs, np.frombuffer(links, np.int64))
                out.append((len(at), int(top[at].sum()), int(counts[at].sum())))
            n, n_best, total = (pa.array([r[i] for r in out], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_a", "n_b")), n, n, n_best, total, batch.column("groups")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                "count_sum long, groups_sha256 string")
