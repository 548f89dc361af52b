"""Packing of token pieces into sequences: dominance reduction, then best fit.

Only lengths matter for where a piece can go, and there are no more of them than tokens in a
sequence. The plan is made from the counts by length: sets of lengths, each with how many
sequences hold it. Pieces are then numbered within their length, over all tasks, and a number
leads to its place. So the plan covers all pieces, and its size depends on the capacity only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import in_slices
from flowgauge.llm.sharding import with_slots
from flowgauge.llm.tokens import encoder

CAPACITY = 2048
END = 0
Pattern = list[tuple[int, int]]  # (length, copies)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row of ``docs`` (doc_id, text, ...).

    ids (little-endian unsigned 32-bit) end with id 0; a null text has no others. Only documents
    longer than ``capacity`` are cut, into pieces of that length and a last one.
    """

    def run(batches):
        for batch in batches:
            for part in in_slices(batch, "text"):
                rows: list[list] = [[], [], [], [], []]
                for key, values in zip(part.column("doc_id").to_pylist(), encoder(path).ids(part.column("text"))):
                    ids = values.tobytes() + END.to_bytes(4, "little")
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        for column, value in zip(rows, (key, piece, start, len(own) // 4, own)):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, types)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix sets that dominate every other set with the same longest piece; ``counts`` keeps the rest.

    For a longest piece a that leaves room r, and b the longest other piece within r:
    nothing fits: a alone. b fills r: any set beside a could lie where b lay. No two others fit
    together: b is as good as any single one. No three fit: with y the longest beside b, and y at
    least as long as any piece within r / 2, b and y are as good as any two.
    """
    fixed: list[tuple[Pattern, int]] = []
    lengths = sorted(n for n, held in counts.items() if held)

    def largest(limit: int, used: Counter) -> int:
        at = bisect_right(lengths, limit) - 1
        while at >= 0 and counts[lengths[at]] <= used[lengths[at]]:
            at -= 1
        return lengths[at] if at >= 0 else 0

    def smallest(n: int, used: Counter) -> list[int]:
        out: list[int] = []
        for length in lengths:
            out += [length] * min(n - len(out), counts[length] - used[length])
            if len(out) == n:
                break
        return out

    changed = True
    while changed:
        changed = False
        for a in reversed(lengths[:]):
            while counts[a]:
                room, used = capacity - a, Counter([a])
                b = largest(room, used)
                if not b:
                    chosen = used
                else:
                    low = smallest(3, used)
                    pair = used + Counter([b])
                    y = largest(room - b, pair)
                    if b == room or len(low) < 2 or sum(low[:2]) > room:
                        chosen = pair
                    elif (len(low) < 3 or sum(low) > room) and y and y >= largest(room // 2, used):
                        chosen = pair + Counter([y])
                    else:
                        break
                times = min(counts[n] // need for n, need in chosen.items())
                fixed.append((list(chosen.items()), times))
                for n, need in chosen.items():
                    counts[n] -= need * times
                changed = True
        lengths = [n for n in lengths if counts[n]]
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each into the fullest sequence with room; equal sequences move together."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, Pattern]]] = {}

    def put(room: int, times: int, pattern: Pattern) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((times, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, times, pattern = capacity, left, []
            else:
                room = rooms[at]
                times, pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            copies = room // length
            full = min(times, left // copies)
            put(room - copies * length, full, [*pattern, (length, copies)])
            left -= full * copies
            times -= full
            if times and 0 < left < copies:
                put(room - left * length, 1, [*pattern, (length, left)])
                left, times = 0, times - 1
            if pattern:
                put(room, times, pattern)
    return [(pattern, times) for groups in open_.values() for times, pattern in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Sets of lengths and how many sequences hold each."""
    rest = dict(counts)
    fixed = reduce_dominated(rest, capacity)
    return fixed + best_fit({n: held for n, held in rest.items() if held}, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (length between 1 and ``capacity``, ...) with sequence_id and offset.

    Sequences are numbered from 0; pieces of one lie without gaps from offset 0. Columns named
    slot, sequence_id or offset are replaced. No rows give no sequences.
    """
    kept = [c for c in pieces.columns if c not in ("slot", "sequence_id", "offset")]
    numbered = with_slots(pieces.select(*kept), "length", list(order))
    counts = {r[0]: r[1] for r in numbered.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    base, taken, runs = 0, Counter(), {n: [] for n in counts}
    for pattern, times in plan(counts, capacity):
        offset = 0
        for length, copies in pattern:
            runs[length].append((taken[length], copies, base, offset))
            taken[length] += copies * times
            offset += length * copies
        base += times
    places = {n: np.array(rows, np.int64).T for n, rows in runs.items()}

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            slot = batch.column("slot").to_numpy()
            sequence, offset = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, copies, start, at = places[int(n)]
                run = np.searchsorted(first, slot[own], side="right") - 1
                nth = slot[own] - first[run]
                sequence[own] = start[run] + nth // copies[run]
                offset[own] = at[run] + nth % copies[run] * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(*kept).schema)
    return numbered.select(*kept, "slot").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of ``docs``.

    A sequence is the ids of its pieces by offset. Rows that repeat a doc_id, or have none, are
    documents of their own.
    """
    pieces = token_pieces(docs, path, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return pack(pieces, capacity, ("doc_id", "piece", "ids_crc32", "ids")).drop("ids_crc32")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``packed_sequences`` with ids_crc32, a digest, in place of ids."""
    return packed_sequences(docs, path, capacity).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
