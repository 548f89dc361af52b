"""Hashes of the words of many texts at once, with numpy.

A word is a longest run of bytes other than space and \\x09-\\x0D, so words are whole at byte
level too. A word's hash is a polynomial over its bytes modulo 2**64, read off running sums.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power(len(data) + 1)
    blank = SPACE[data]
    word = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    start, end = word[::2], word[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    return start, mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one bound more
    than texts). Memory beyond the result is bounded by blocks that are cut at blanks."""
    joined = b"\n".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    if lower:
        data = LOWER[data]
    starts, hashes, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        if stop < len(data):
            while stop < len(data) and not SPACE[data[stop]]:
                blank = np.flatnonzero(SPACE[data[stop : stop + BLOCK]])
                stop = stop + int(blank[0]) if len(blank) else min(len(data), stop + BLOCK)
        start, found = _block(data[at:stop])
        starts.append(start + at)
        hashes.append(found)
        at = stop
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(begin, np.concatenate(([0], np.cumsum(lengths))))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), bounds


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` word hashes, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x100000001B3) + hashes[i : i + n]
    return mixed(total + np.uint64(width))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of runs of ``width`` words, ascending; fewer words are one run."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(width, len(hashes))))


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; null is empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]
