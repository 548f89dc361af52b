"""Periodic runs of words, found by internal pattern matching.

A run is a longest stretch of consecutive words with smallest period q and a length of at least
``4 * q`` (and 6). Such a stretch holds an aligned block of L words, L the power of two with
``(2L - 1) / 3 <= q < (4L - 1) / 3``, that occurs again q words later. So for every aligned block of
every length 2, 4, 8, ... the next occurrences in the window after it are asked for, and no others:

- The suffixes of a text are sorted by prefix doubling; when blocks of L words have been compared, all
  occurrences of a block are one range of the suffix array.
- A wavelet tree over the suffix array gives the smallest position of a range that is not below a
  bound (range successor), with a few bit counts per level. All queries of a batch go together.
- Occurrences closer than half a block form an arithmetic progression, whose end is where the
  progression's difference stops being a period. If q <= L the first occurrence lies q later; else the
  last one of the block's own progression and the last one of a progression after it do.

Every candidate (block, q) is then extended to both sides as far as q is a period, word by word,
so nothing rests on hashes. Words are compared as numbers that stand for their exact bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowgauge.llm.common import in_slices

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Bytes of a text that are cut into words at once, and words that are joined at once.
CUT, JOINED = 1 << 20, 1 << 16
BLANKS = b" \t\n\r\x0b\x0c"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size, whole."""
    if len(text) <= CUT:
        yield text.split()
        return
    at = 0
    while at < len(text):
        stop = min(len(text), at + CUT)
        while stop < len(text) and text[stop] not in BLANKS:
            after = [i for i in (text.find(bytes([b]), stop, stop + CUT) for b in BLANKS) if i >= 0]
            stop = min(after, default=min(len(text), stop + CUT))
        yield text[at:stop].split()
        at = stop


class Words:
    """Numbers of the words of a batch of texts, and the words behind them."""

    def __init__(self, texts: list[bytes]):
        known: dict[bytes, int] = {}
        parts, sizes = [], []
        for text in texts:
            n = 0
            for words in words_of(text):
                parts.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words)))
                n += len(words)
            sizes.append(n)
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.names = list(known)

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the words of ``ids`` joined by one space."""
        out = hashlib.sha256()
        for at in range(0, len(ids), JOINED):
            out.update((b" " if at else b"") + b" ".join([self.names[i] for i in ids[at : at + JOINED].tolist()]))
        return out.hexdigest()

    def text(self, ids: np.ndarray) -> str:
        return b" ".join([self.names[i] for i in ids.tolist()]).decode()


class WaveletTree:
    """Range successor over an array of whole numbers below 2 ** bits, kept as bit planes: each level
    holds one bit of every value, zeros before ones for the next, and counts of ones by 64 places."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1 == 1
            plane = np.zeros(len(values) // 64 + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            plane.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(plane) + 1, np.int64)
            np.cumsum(np.bitwise_count(plane), out=ones[1:])
            self.levels.append((plane, ones, len(values) - int(ones[-1])))
            values = np.concatenate((values[~bit], values[bit]))

    def ones(self, level: int, place: np.ndarray) -> np.ndarray:
        """Ones of a level before each place."""
        plane, before, _ = self.levels[level]
        cell = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return before[cell] + np.bitwise_count(plane[cell] & mask)

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Values of each range [low, high) that are smaller than its bound (of ``bits`` bits)."""
        count = np.zeros(len(low), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one_low, one_high = self.ones(level, low), self.ones(level, high)
            right = (bound >> b) & 1 == 1
            count += np.where(right, (high - low) - (one_high - one_low), 0)
            zeros = self.levels[level][2]
            low = np.where(right, zeros + one_low, low - one_low)
            high = np.where(right, zeros + one_high, high - one_high)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of each range with so many values of it before it in order."""
        value = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            one_low, one_high = self.ones(level, low), self.ones(level, high)
            held = (high - low) - (one_high - one_low)
            right = rank >= held
            rank = np.where(right, rank - held, rank)
            value = value * 2 + right
            zeros = self.levels[level][2]
            low = np.where(right, zeros + one_low, low - one_low)
            high = np.where(right, zeros + one_high, high - one_high)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value of each range that is not below its bound, or -1."""
        out = np.full(len(low), -1, np.int64)
        some = np.flatnonzero(bound < (1 << self.bits))
        rank = self.below(low[some], high[some], bound[some])
        left = rank < high[some] - low[some]
        some, rank = some[left], rank[left]
        out[some] = self.smallest(low[some], high[some], rank)
        return out


def suffixes(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of each text, one after the other, as far as blocks need it, and for every
    block length the aligned blocks that occur more than once in their text: (length, places, range
    starts, range ends)."""
    n, sizes = len(ids), np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = doc * (int(ids.max()) + 1 if n else 1) + ids
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), np.diff(key[order]) != 0)))
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    size = np.zeros(n + 1, np.int64)
    size[first] = np.diff(np.append(first, n))
    active = np.flatnonzero(size[rank[order]] > 1)
    blocks, length, longest = [], 1, int(sizes.max()) if len(sizes) else 0
    # The longest run of a text has period n // TIMES, and its block at most 3/2 of that.
    while len(active) and 2 * length <= 3 * (longest // TIMES) / 2 + 1:
        suffix = order[active]
        after = suffix + length
        inside = after < bounds[doc[suffix] + 1]
        second = np.zeros(len(suffix), np.int64)
        second[inside] = rank[after[inside]] + 1
        both = rank[suffix] * (n + 1) + second
        sort = np.argsort(both, kind="stable")
        both, suffix = both[sort], suffix[sort]
        order[active] = suffix
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        held = np.diff(np.append(first, len(both)))
        start = np.repeat(active[first], held)
        rank[suffix] = start
        size[active] = 0
        size[active[first]] = held
        length *= 2
        again = np.repeat(held, held) > 1
        active, suffix, start, held = active[again], suffix[again], start[again], np.repeat(held, held)[again]
        place = suffix - bounds[doc[suffix]]
        whole = (place % length == 0) & (suffix + length <= bounds[doc[suffix] + 1])
        blocks.append((length, suffix[whole], start[whole], (start + held)[whole]))
    return order, blocks


class Periods:
    """Where a distance between equal words begins and ends, for the texts of a batch."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        self.ids, self.bounds = ids, bounds

    def around(self, doc: np.ndarray, period: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of its text around each place in which ``period`` is a period, given that it is
        one at the place: start and end, counted from the start of the text."""
        start, end = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        order = np.lexsort((period, doc))
        cut = np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(period[order]) != 0)) + 1
        for group in np.split(order, cut) if len(order) else []:
            own = self.ids[self.bounds[doc[group[0]]] : self.bounds[doc[group[0]] + 1]]
            q = int(period[group[0]])
            breaks = np.flatnonzero(own[q:] != own[:-q])
            at = np.searchsorted(breaks, place[group])
            edges = np.concatenate(([-1], breaks, [len(own) - q]))
            start[group] = edges[at] + 1
            end[group] = edges[at + 1] + q
        return start, end


def candidates(ids: np.ndarray, bounds: np.ndarray, periods: Periods) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, place in the text) such that every run is met by one of them."""
    order, blocks = suffixes(ids, bounds)
    n, sizes = len(ids), np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found = [(np.zeros(0, np.int64),) * 3]
    if not any(len(b[1]) for b in blocks):
        return found[0]
    tree = WaveletTree(order - bounds[doc[order]], max(1, int(sizes.max() - 1).bit_length()))
    for length, place, low, high in blocks:
        most = -(-(4 * length - 1) // 3) - 1  # longest period that this length is for
        text = doc[place]
        place = place - bounds[text]
        following = tree.successor(low, high, place + 1)

        def ends(at: np.ndarray, follows: np.ndarray, near: np.ndarray) -> np.ndarray:
            """The last occurrence of the progression that each occurrence belongs to."""
            last, step = at.copy(), follows - at
            some = np.flatnonzero((follows >= 0) & (2 * step <= length))
            _, end = periods.around(text[near[some]], step[some], at[some])
            last[some] += step[some] * ((end - length - at[some]) // step[some])
            return last

        near = np.flatnonzero((following >= 0) & (following - place <= most))
        found.append((text[near], (following - place)[near], place[near]))
        base = before = ends(place[near], following[near], near)
        while len(near):
            next_ = tree.successor(low[near], high[near], before + 1)
            left = (next_ >= 0) & (next_ - place[near] <= most)
            near, next_, base = near[left], next_[left], base[left]
            before = ends(next_, tree.successor(low[near], high[near], next_ + 1), near)
            for period, at in ((before - base, base), (next_ - place[near], place[near])):
                found.append((text[near], period, at))
    text, period, place = (np.concatenate([f[i] for f in found]) for i in range(3))
    return text, period, place


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of all texts as (text, start, length, period), by text, start, period."""
    periods = Periods(ids, bounds)
    doc, period, place = candidates(ids, bounds, periods)
    start, end = periods.around(doc, period, place)
    length = end - start
    long = length >= np.maximum(LEAST, TIMES * period)
    doc, start, length, period = doc[long], start[long], length[long], period[long]
    order = np.lexsort((period, length, start, doc))  # of one stretch the smallest period counts
    doc, start, length, period = doc[order], start[order], length[order], period[order]
    same = (np.diff(doc) == 0) & (np.diff(start) == 0) & (np.diff(length) == 0)
    keep = np.concatenate((np.ones(min(len(doc), 1), bool), ~same))
    doc, start, length, period = doc[keep], start[keep], length[keep], period[keep]
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of a document of the query: those of one in ten repeat from a place on."""
    if doc_id is None or not len(ids):
        return ids
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return ids
    g = h // 10
    a = g % len(ids)
    p = 1 + (len(ids) - a) // (3 + g % 8)
    out = ids.copy()
    out[a:] = ids[a + np.arange(len(ids) - a) % p]
    return out


def collapsed(ids: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The words that are left when each run keeps its first period only."""
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return ids[np.cumsum(edge[:-1]) == 0]


def _run(docs: DataFrame, schema: str, make, change=None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for part in in_slices(batch, "text"):
                keys = part.column("doc_id").cast(pa.int64())
                words = Words([t or b"" for t in part.column("text").cast("binary").to_pylist()])
                if change:
                    for i, key in enumerate(keys.to_pylist()):
                        own = slice(words.bounds[i], words.bounds[i + 1])
                        words.ids[own] = change(words.ids[own], key)
                doc, start, length, period = runs_of(words.ids, words.bounds)
                at = np.searchsorted(doc, np.arange(len(keys) + 1))
                rows = []
                for i, key in enumerate(keys.to_pylist()):
                    own = slice(at[i], at[i + 1])
                    ids = words.ids[words.bounds[i] : words.bounds[i + 1]]
                    rows.append((key, *make(words, ids, start[own], length[own], period[own])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of ``docs`` (doc_id, text, ...).

    ``runs`` holds (start, length, period) of each run in words, by start and period; ``collapsed`` is
    the text's words, joined by one space, without what a run repeats. A null or blank text has no
    words, no runs and collapses to the empty text. Repeated rows and null doc_ids stay; other columns
    play no part. A text is worked on whole, in one task, with about 60 bytes of memory a word.
    """

    def make(words, ids, start, length, period):
        own = [{"start": s, "length": n, "period": q} for s, n, q in zip(start.tolist(), length.tolist(), period.tolist())]
        return own, words.text(collapsed(ids, start, length, period))

    return _run(docs, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string", make)


DIGESTS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def digests(docs: DataFrame, change=planted) -> DataFrame:
    """The number of runs, the longest (ties: smallest start, then period) and digests of all runs
    and of the collapsed words, for every row. ``change`` is applied to each document's words first;
    the query's makes the words of one document in ten periodic. A null doc_id changes nothing."""

    def make(words, ids, start, length, period):
        listed = "".join([f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist())])
        best: tuple = (None,) * 4
        if len(start):
            i = int(np.argmax(length))  # the first of the longest, and they are by start and period
            n, q = int(length[i]), int(period[i])
            best = (int(start[i]), n, q, 1000 * n // q)
        return len(start), *best, hashlib.sha256(listed.encode()).hexdigest(), words.digest(collapsed(ids, start, length, period))

    return _run(docs, DIGESTS, make, change)
