"""Elias-Fano sequences in flat bytes: ascending numbers in about log2(universe / n) + 2 bits each.

The low bits of every number stand side by side; the high bits are a bit vector in which number i has its one at
(high part + i), with the ones and zeros before each of its words.  All operations take arrays; the data may be a
memory map, of which nothing is copied.
"""

from __future__ import annotations

import numpy as np

_ONE, _BYTES, _TOPS = np.uint64(1), np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: By byte and r, the place of its r-th one.
_IN_BYTE = np.array([(*(k for k in range(8) if b >> k & 1), *[0] * 8)[r] for b in range(256) for r in range(8)], dtype=np.uint64)


def build(values: np.ndarray, universe: int) -> bytes:
    """The bytes for ascending ``values`` (64-bit unsigned), all below ``universe``; a whole number of 8-byte words."""
    n = len(values)
    low = min(56, max(0, (universe // max(1, n)).bit_length() - 1))  # low bits are read from 8 bytes at any bit
    if low:
        bits = np.zeros((n, low), dtype=np.uint8)
        for k in range(low):
            bits[:, k] = (values >> np.uint64(k)) & _ONE
        lows = np.packbits(bits.reshape(-1), bitorder="little")
    else:
        lows = np.zeros(0, np.uint8)
    lows = np.concatenate([lows, np.zeros(8 + -len(lows) % 8, np.uint8)])
    high = (values >> np.uint64(low)).astype(np.int64)
    size = -(-(n + int(universe >> low) + 2) // 64) * 64
    upper = np.zeros(size, dtype=np.uint8)
    upper[high + np.arange(n)] = 1
    words = np.packbits(upper, bitorder="little").view("<u8")
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)])
    zeros = np.arange(len(ranks), dtype=np.uint64) * np.uint64(64) - ranks
    last = int(values[-1]) if n else 0
    width = 4 if size < 1 << 32 else 8
    head = np.array([n, low, len(lows), len(words), last, width], dtype="<u8")
    counts = np.concatenate([ranks, zeros]).astype(f"<u{width}").tobytes()
    return head.tobytes() + lows.tobytes() + words.tobytes() + counts


class Sequence:
    def __init__(self, data: np.ndarray):
        n, low, n_low, n_words, last, width = (int(x) for x in data[:48].view("<u8"))
        self.n, self.low, self.last = n, low, np.uint64(last)
        lows = data[48 : 48 + n_low]
        self.lows = np.lib.stride_tricks.as_strided(lows[:8].view("<u8"), shape=(n_low - 7,), strides=(1,), writeable=False)
        at = 48 + n_low
        self.words = data[at : at + 8 * n_words].view("<u8")
        counts = data[at + 8 * n_words : at + 8 * n_words + 2 * width * (n_words + 1)].view(f"<u{width}")
        self.ones, self.zeros = counts[: n_words + 1], counts[n_words + 1 :]
        self.size = at + 8 * n_words + 2 * width * (n_words + 1)
        self.mask = np.uint64((1 << low) - 1)

    @staticmethod
    def _in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The place of the ``r``-th one in each word: its byte by sums of the bytes' ones, then a table."""
        x = words - ((words >> _ONE) & np.uint64(0x5555555555555555))
        x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
        sums = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
        r = r.astype(np.uint64)
        place = np.bitwise_count(((r * _BYTES | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)
        rest = r - ((sums << np.uint64(8)) >> place & np.uint64(0xFF))
        byte = (words >> place) & np.uint64(0xFF)
        return (place + _IN_BYTE[(byte << np.uint64(3) | rest).astype(np.int64)]).astype(np.int64)

    def _select(self, i: np.ndarray, ones: bool, following: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The places of the ``i``-th ones (or zeros), and if asked for of those after them."""
        ranks = self.ones if ones else self.zeros
        word = np.searchsorted(ranks, i.astype(ranks.dtype), side="right") - 1
        w = self.words[word] if ones else ~self.words[word]
        bit = self._in_word(w, i - ranks[word].astype(np.int64))
        place = 64 * word + bit
        if not following:
            return place, None
        above = w & ~((_ONE << bit.astype(np.uint64)) * np.uint64(2) - _ONE)
        after = 64 * word + np.bitwise_count((above & (~above + _ONE)) - _ONE)
        rest = np.flatnonzero(above == 0)
        if len(rest):
            after[rest] = self._select(i[rest] + 1, ones)[0]
        return place, after

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        return self.lows[bit >> 3] >> (bit & 7).astype(np.uint64) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The ``i``-th numbers."""
        i = np.asarray(i, dtype=np.int64)
        high = self._select(i, True)[0] - i
        return high.astype(np.uint64) << np.uint64(self.low) | self._low(i)

    def get_both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``i``-th numbers and those after them."""
        i = np.asarray(i, dtype=np.int64)
        place, after = self._select(i, True, True)
        low = np.uint64(self.low)
        return (place - i).astype(np.uint64) << low | self._low(i), (after - i - 1).astype(np.uint64) << low | self._low(i + 1)

    def find(self, target: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | None = None) -> np.ndarray:
        """Where each target stands among the numbers ``first`` to ``last`` (exclusive), -1 if it doesn't."""
        high = (target >> np.uint64(self.low)).astype(np.int64)
        # A high part's numbers stand between the zero before it (none before the first) and its own.
        before, own = np.full(len(target), -1, dtype=np.int64), np.zeros(len(target), dtype=np.int64)
        some = np.flatnonzero(high > 0)
        before[some], own[some] = self._select(high[some] - 1, False, True)
        none = np.flatnonzero(high == 0)
        own[none] = self._select(high[none], False)[0]
        a, b = np.maximum(before + 1 - high, first), own - high
        if last is not None:
            b = np.minimum(b, last)
        end, low = b, target & self.mask
        # What is still searched: its place in the result, its bounds and what it looks for.
        at = np.flatnonzero(a < b)
        lo, hi, wanted = a[at], b[at], low[at]
        while len(at):
            mid = (lo + hi) >> 1
            less = self._low(mid) < wanted
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            open_ = lo < hi
            a[at[~open_]] = lo[~open_]
            at, lo, hi, wanted = at[open_], lo[open_], hi[open_], wanted[open_]
        inside = np.flatnonzero((a < end) & (a < self.n))
        hit = inside[self._low(a[inside]) == low[inside]]
        out = np.full(len(target), -1, dtype=np.int64)
        out[hit] = a[hit]
        return out
