"""Vectorised 64-bit hashes of words and word sequences.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes do not depend on
position, machine or partitioning. Equality of sequences is decided on these
64-bit values.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 22
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[at] = np.cumprod(steps)
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits (finaliser of a public 64-bit mixer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair, in one pass over ``values``."""
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = separators[data]
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    return turns[::2], turns[1::2]


def word_hashes(raw: bytes, lower: bool = False, separators: np.ndarray = SPACE) -> np.ndarray:
    """One hash per word. Texts of any length go through in pieces cut between words."""
    data = np.frombuffer(raw, np.uint8)
    out = []
    while len(data):
        cut = len(data)
        if cut > _PIECE:
            later = np.flatnonzero(separators[data[_PIECE:]])
            cut = _PIECE + int(later[0]) if len(later) else len(data)
        piece, data = data[:cut], data[cut:]
        starts, ends = word_bounds(piece, separators)
        if lower:
            piece = LOWER[piece]
        out.append(spans(piece.astype(np.uint64) + np.uint64(1), starts, ends))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return spans(words, starts, starts + size)


def found_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Binary probe: which values stand in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values
