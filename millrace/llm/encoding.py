"""Exact encoding of long texts by the tokenizers library, with a cache of words on arrays.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so its ids are the ids of its words in a row.  Words
are looked up by 64-bit hash, all of a group of texts at once, in an open-addressing table of places in a pool of ids;
words that it lacks are encoded together, in one call of the library.  Ids come as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

from millrace.llm.wordhash import words_of

#: Unicode white space other than ASCII, the rest of the class ``\s`` of the tokenizers' patterns.
WIDE_SPACE = "\x85\xa0                　"
_S = f"\t-\r {WIDE_SPACE}"
#: Where the byte-level tokenizer always cuts: it joins a single space to the word after it.
CHUNK = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Characters that end a word of letters as one pre-token of their own, however many follow each other.
MARKS = ".,;:!?#*$%&|<>()[]{}\"+-=_/~^@"
#: Bytes of text whose words are looked up together; words that the table holds and its slots; cores that are kept.
GROUP, LIMIT, SLOTS, CORES = 1 << 18, 2_000_000, 1 << 22, 150_000


class Encoder:
    """Encodes texts.  ``kind`` "word": white space is dropped; "byte": a word has the space before it, if single."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.byte = kind == "byte"
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        # By id: whether a token ends a word, begins with a space, is a line feed.
        self.final, self.spaced, self.feeds = (np.zeros(max(vocabulary.values()) + 1, dtype=bool) for _ in range(3))
        for token, k in vocabulary.items():
            self.final[k], self.spaced[k], self.feeds[k] = token.endswith("</w>"), token[0] == "Ġ", token == "Ċ"
        self.marks: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.int32)
        self.pool, self.used, self.n = np.zeros(1 << 22, self.width), 0, 0
        self.cores: dict[str, bytes] = {}

    def ids(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self.ids(marks)
        return self.marks[marks]

    def _together(self, words: list[str], before: str) -> list[bytes]:
        """The ids of words of letters, each after ``before`` (a space or a line feed; only the byte kind keeps it)."""
        text = before.join(["", *words])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.width)
        if self.byte:
            edges = [*np.flatnonzero((self.spaced if before == " " else self.feeds)[ids]).tolist(), len(ids)]
        else:
            edges = [0, *(np.flatnonzero(self.final[ids]) + 1).tolist()]
        if len(edges) != len(words) + 1 or edges[0] or edges[-1] != len(ids):
            return [self.ids(before + w) for w in words]
        flat, k = ids.tobytes(), ids.itemsize
        return [flat[k * i : k * j] for i, j in zip(edges, edges[1:], strict=False)]

    def _learn(self, words: list[tuple[str, str]]) -> list[bytes]:
        """The ids of distinct words, given with what stands before each: nothing, a space or a line feed."""
        made, new, byte, cores = [], {" ": {}, "\n": {}}, self.byte, self.cores
        for before, w in words:
            core = w.rstrip(MARKS)
            low = core if byte else core.lower()
            if not low.isalpha() or not byte and "Σ" in core:  # the letter whose lower case depends on its place
                made.append(self.ids(before + w))
                continue
            space = " " if not byte or before == " " else "\n"
            key = space + low
            made.append((key, before, w[len(core) :]))
            if key not in cores:
                new[space][low] = None
        if len(self.cores) > CORES:
            keep = {m[0] for m in made if isinstance(m, tuple)}
            self.cores = {k: v for k, v in self.cores.items() if k in keep}
        for space, found in new.items():
            if found:
                self.cores.update(zip([space + w for w in found], self._together(list(found), space), strict=True))
        feed, cores, known = np.dtype(self.width).itemsize, self.cores, self.marks
        for k, m in enumerate(made):
            if m.__class__ is tuple:
                key, before, marks = m
                ids = cores[key]
                if byte and not before:
                    ids = ids[feed:]  # without the line feed
                made[k] = ids + (known.get(marks) or self._marks(marks)) if marks else ids
        return made

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it isn't there."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == h, slot, -1)
        rest = np.flatnonzero((found != h) & (found != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)
            found = self.keys[slot[rest]]
            same = found == h[rest]
            out[rest[same]] = slot[rest[same]]
            rest = rest[~same & (found != 0)]
        return out

    def _insert(self, h: np.ndarray, ids: list[bytes]) -> None:
        sizes = np.array([len(x) for x in ids], dtype=np.int64) // np.dtype(self.width).itemsize
        flat = np.frombuffer(b"".join(ids), dtype=self.width)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), self.n + len(h)
        slot, rest = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(h))
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.at[slot[won]], self.size[slot[won]] = h[won], at[won], sizes[won]
            lost = np.ones(len(h), dtype=bool)
            lost[won] = False
            rest = rest[lost[rest]]
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        group, held = [], 0
        for text in texts:
            group.append(text or "")
            held += len(group[-1])
            if held >= GROUP:
                yield from self._group(group)
                group, held = [], 0
        if group:
            yield from self._group(group)

    def encode(self, text: str | None) -> bytes:
        return next(self._group([text or ""]))

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        raw = [t.encode() for t in texts]
        odd: set[int] = set()
        if self.byte:
            odd = {k for k, t in enumerate(texts) if not t.isascii() and any(c in t for c in WIDE_SPACE)}
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        h, starts, ends = words_of(data)
        lengths = np.array([len(t) for t in raw])
        last = np.cumsum(lengths + 1)
        edges = np.concatenate([[0], np.searchsorted(starts, last)])
        before = np.full(len(h), 32, dtype=np.uint8)
        if self.byte:
            before = data[np.maximum(starts - 1, 0)].copy()
            inside = np.concatenate([[0], np.cumsum(ends - starts)])
            n = np.diff(edges)
            # One separator between words and none elsewhere; all of them spaces or line feeds.
            plain = (lengths - np.diff(inside[edges]) == np.maximum(n - 1, 0)) & ((n > 0) | (lengths == 0))
            before[edges[:-1][n > 0]] = 0
            bad = np.concatenate([[0], np.cumsum(~np.isin(before, (0, 10, 32)))])
            plain &= np.diff(bad[edges]) == 0
            odd |= set(np.flatnonzero(~plain).tolist())
            h = np.where(before == 32, h, h * np.uint64(0x9E3779B97F4A7C15) + before)
        h = np.where(h == 0, np.uint64(1), h)
        if self.n + len(h) > LIMIT:
            self._clear()
        slot = self._find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            where = missing[first]
            name = {0: "", 10: "\n", 32: " "}
            words = [(name.get(b, " "), data[s:e].tobytes().decode()) for b, s, e in zip(before[where].tolist(), starts[where].tolist(), ends[where].tolist(), strict=True)]
            self._insert(new, self._learn(words))
            slot[missing] = self._find(h[missing])
        size = self.size[slot].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.at[slot].astype(np.int64) - total[:-1], size) + np.arange(total[-1])].astype("<u4")
        for k, (a, b) in enumerate(zip(total[edges[:-1]].tolist(), total[edges[1:]].tolist(), strict=True)):
            if k in odd:
                yield np.frombuffer(b"".join(map(self.ids, CHUNK.findall(texts[k]))), dtype=self.width).astype("<u4").tobytes()
            else:
                yield ids[a:b].tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The encoder of this process: Python workers are reused from task to task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def forget() -> None:
    """Drops the encoders of this process, which other operators don't need."""
    _encoders.clear()
