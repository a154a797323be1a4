"""A minimal perfect hash of 128-bit keys, with a fingerprint, a count and a number for each, in one flat file.

Keys that meet no other at a level set their bit there; the others go on to the next level.  The rank of a key's bit
over all levels is its place in the arrays.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.wordhash import mix

#: Bits per key of a level; more levels than any build needs.
GAMMA, LEVELS = 2, 60
_MAGIC = 0x4D5048323031


def _slots(hi: np.ndarray, lo: np.ndarray, level: int, bits: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return mix(mix(hi ^ salt) + lo) % np.uint64(bits)


def build(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> bytes:
    """The file for distinct keys ``(hi, lo)``; ``counts`` are kept as 32 bits (larger ones as the largest)."""
    sizes, maps, rest = [], [], np.arange(len(hi))
    while len(rest):
        if len(sizes) == LEVELS:
            raise ValueError("keys repeat")
        bits = -(-max(64, GAMMA * len(rest)) // 64) * 64
        slot = _slots(hi[rest], lo[rest], len(sizes), bits)
        alone = np.bincount(slot.astype(np.int64), minlength=bits) == 1
        maps.append(np.packbits(alone, bitorder="little"))
        sizes.append(bits)
        rest = rest[~alone[slot.astype(np.int64)]]
    words = np.concatenate(maps).view("<u8") if maps else np.zeros(0, "<u8")
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)]).astype("<u8")
    head = np.array([_MAGIC, len(hi), len(sizes), len(words), *sizes], dtype="<u8")
    draft = Table(np.concatenate([head, words, ranks]).view(np.uint8), arrays=False)
    place = draft.places(hi, lo)
    finger, number, count = np.zeros(len(hi), "<u8"), np.zeros(len(hi), "<i8"), np.zeros(len(hi), "<u4")
    finger[place], number[place], count[place] = lo, numbers, np.minimum(counts, 2**32 - 1)
    return np.concatenate([head, words, ranks]).tobytes() + finger.tobytes() + number.tobytes() + count.tobytes()


class Table:
    """Reads such a file; ``data`` may be a memory map."""

    def __init__(self, data: np.ndarray, arrays: bool = True):
        head = data[:32].view("<u8").tolist()
        if head[0] != _MAGIC:
            raise ValueError("not a table of this kind")
        self.n, levels, words = head[1:]
        at = 32 + 8 * levels
        self.sizes = data[32:at].view("<u8").tolist()
        self.words, at = data[at : at + 8 * words].view("<u8"), at + 8 * words
        self.ranks, at = data[at : at + 8 * words + 8].view("<u8"), at + 8 * words + 8
        if arrays:
            self.fingers = data[at : at + 8 * self.n].view("<u8")
            self.numbers = data[at + 8 * self.n : at + 16 * self.n].view("<i8")
            self.counts = data[at + 16 * self.n : at + 20 * self.n].view("<u4")

    def places(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Each key's place, -1 for a key that no level has; a key that isn't in the table may get any place."""
        out, rest, first = np.full(len(hi), -1, dtype=np.int64), np.arange(len(hi)), 0
        for level, bits in enumerate(self.sizes):
            if not len(rest):
                break
            slot = _slots(hi[rest], lo[rest], level, bits)
            word, bit = (first + slot // np.uint64(64)).astype(np.int64), slot % np.uint64(64)
            w = self.words[word]
            hit = (w >> bit) & np.uint64(1) == 1
            below = w[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[rest[hit]] = self.ranks[word[hit]].astype(np.int64) + np.bitwise_count(below)
            rest = rest[~hit]
            first += bits // 64
        return out

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Each key's place, -1 where its fingerprint differs."""
        place = self.places(hi, lo)
        known = place >= 0
        known[known] = self.fingers[place[known]] == lo[known]
        return np.where(known, place, -1)
