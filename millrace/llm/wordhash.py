"""Hashes of white-space separated words of many texts at once, on arrays of bytes.

A word's hash is a polynomial over its bytes modulo 2**64 with one random 64-bit value per byte, mixed with its length;
prefix sums over a block of text give the hashes of all its words without a loop.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once, if white space allows; bounds the arrays to some 40 bytes per byte of this.
BLOCK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: list[np.ndarray] = []


def _block(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and the places where they begin and end."""
    if not _tables or len(_tables[0]) < len(data) + 1:
        n = max(BLOCK, len(data)) + 1
        _tables[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * _tables[0][: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _tables[1][starts] + (ends - starts).astype(np.uint64)), starts, ends


def words_of(data: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of ``data``; ``fold`` lower-cases A-Z."""
    table, found, at = _FOLDED if fold else _TABLE, [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data) and not _SPACE[data[end]]:
            back = np.flatnonzero(_SPACE[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # a word longer than a block
                while end < len(data) and not _SPACE[data[end : end + BLOCK]].any():
                    end += BLOCK
                end = end + int(np.argmax(_SPACE[data[end : end + BLOCK]])) + 1 if end < len(data) else len(data)
        h, s, e = _block(data[at:end], table)
        found.append((h, s + at, e + at))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_hashes(texts: list[bytes | None], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order and the number of words of each text; ``fold`` lower-cases A-Z."""
    texts = [t or b"" for t in texts]
    hashes, starts, _ = words_of(np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), fold)
    return hashes, np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash for each ``width`` consecutive words; windows that cross texts are the caller's to leave out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, factor = np.zeros(n, dtype=np.uint64), np.uint64((0xD6E8FEB86659FD93 + 2 * salt * 0x5851F42D4C957F2D) & (2**64 - 1) | 1)
    for k in range(width):
        out *= factor
        out += words[k : k + n]
    return mix(out)


def inside_texts(counts: np.ndarray, width: int) -> np.ndarray:
    """For each window over all words, whether it lies in one text."""
    n = int(counts.sum())
    ok = np.ones(max(0, n - width + 1), dtype=bool)
    for e in np.cumsum(counts)[:-1].tolist():
        ok[max(0, e - width + 1) : e] = False
    return ok


def split_texts(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
