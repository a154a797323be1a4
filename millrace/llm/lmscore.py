"""Language-model scoring with an Elias-Fano n-gram trie in memory-mapped files.

Level 1 has the vocabulary: ascending 64-bit word hashes and ascending sums of counts (exact counts by difference).
Level k has, for each node of level k - 1, the words that follow it: ascending pointers to the node's range, and the
words' numbers, made ascending over all ranges by adding each range's base.  A word is looked up in its context's range
only.  Every entry has its discounted probability and every context its back-off weight, in 8 bits each.  Nodes are
dealt out over shards by their numbers: of one word's n-grams, those of order 2 are in one shard (as many as there are
words, at most), and those of higher orders in all.

    p1(w) = (c(w) + 1) / (N + V + 1)
    pk(w | context) = max(c - D, 0) / C(context) + weight(context) * pk-1(w | shorter context)

All n-grams of the training documents are kept; what is discounted goes to the context's weight, so the probabilities of
a context add up to one, but for the rounding of weights.  Documents are hashed once: chunk files have their tokens as
places in the chunk's own list of words, so that later passes look up that list only.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import chunks as C
from millrace.llm.eliasfano import Sequence, build
from millrace.llm.memory import small_batches, tidy
from millrace.llm.storage import drop, get, is_mapped, mapped, put, shared_folder, written
from millrace.llm.wordhash import split_texts, word_hashes

#: Discount; steps of the stored logarithms: log10 p by 1/20 (down to 10**-12.75), log10 of a weight by 1/64.
DISCOUNT, P_STEP, W_STEP = 0.75, 20, 64
PROBABILITIES, WEIGHTS = (10.0 ** (-np.arange(256) / step) for step in (P_STEP, W_STEP))
#: Bytes of levels that a process holds at most where files can't be mapped; node and word numbers are below LIMIT.
HELD, LIMIT = 256 << 20, 1 << 32
#: Shards at most: a chunk looks into all of them, and each knows where the others' nodes stand.
SHARDS = 1 << 15
#: The token after each text's words, as a hash; no word has it but by chance.
END = np.uint64(0x2545F4914F6CDD1D)


def training(doc_id, fold: int = 2, folds: int = 7) -> bool:
    """Whether a document is learnt from: CRC-32 of its id as text (null: empty) is not ``fold`` modulo ``folds``."""
    return crc32(str(doc_id).encode() if doc_id is not None else b"") % folds != fold


class Streams:
    """A chunk's tokens: for each document an END that begins it, its words, and its END; as places in the chunk's list
    of distinct hashes, and as word numbers once the vocabulary is there."""

    def __init__(self, ids: list, counts: np.ndarray, place_of: np.ndarray):
        self.ids, self.counts, self.tokens, n = ids, counts, place_of, counts + 2
        ends = np.cumsum(n)
        self.first, self.last = ends - n, ends - 1
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.place = np.arange(int(n.sum()), dtype=np.int32) - np.repeat((ends - n).astype(np.int32), n)
        self.learn = np.array([training(i) for i in ids], dtype=bool)

    @staticmethod
    def of_texts(ids: list, texts: list[bytes | None]) -> tuple[Streams, np.ndarray, np.ndarray]:
        """The tokens, the ascending hashes that they are places of, and how often training documents have each."""
        words, counts = word_hashes(texts, fold=True)
        n = counts + 2
        tokens = np.full(int(n.sum()), END, dtype=np.uint64)
        inside = np.ones(len(tokens), dtype=bool)
        ends = np.cumsum(n)
        inside[ends - n] = inside[ends - 1] = False
        tokens[inside] = words
        order = np.argsort(tokens)
        h = tokens[order]
        starts = C.starts_of(h)
        places = np.empty(len(h), dtype="<u4")
        places[order] = np.repeat(np.arange(len(starts), dtype="<u4"), np.diff(np.concatenate([starts, [len(h)]])))
        s = Streams(ids, counts, places)
        learnt = np.bincount(places[s.learn[s.doc] & (s.place > 0)], minlength=len(starts))
        return s, h[starts], learnt

    def save(self) -> bytes:
        known = np.array([i is not None for i in self.ids], dtype=np.uint8)
        ids = np.array([i or 0 for i in self.ids], dtype="<i8")
        head = np.array([len(ids), len(self.tokens)], dtype="<u8").tobytes()
        return head + C.squeeze(known.tobytes() + ids.tobytes() + self.counts.astype("<u4").tobytes() + C.planes(self.tokens))

    @staticmethod
    def load(data: bytes) -> Streams:
        n, m = np.frombuffer(data[:16], dtype="<u8").tolist()
        raw = C.unsqueeze(data[16:])
        ids = [i if k else None for k, i in zip(raw[:n], np.frombuffer(raw[n : 9 * n], dtype="<i8").tolist(), strict=True)]
        return Streams(ids, np.frombuffer(raw[9 * n : 13 * n], dtype="<u4").astype(np.int64), C.unplanes(raw[13 * n :], "<u4", m))


def _two(a: np.ndarray, b: np.ndarray) -> bytes:
    return C.squeeze(C.planes(a.astype("<u8")) + C.planes(b.astype("<u8")))


def _both(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = C.unsqueeze(data)
    return C.unplanes(raw[: len(raw) // 2], "<u8", len(raw) // 16), C.unplanes(raw[len(raw) // 2 :], "<u8", len(raw) // 16)


class Vocabulary:
    """Level 1: shards by the top of the hash; a word's number is its shard's first number and its place there."""

    def __init__(self, folder: str, sizes: list[int]):
        self.first, self.n, self.folder, self.shards = np.cumsum([0, *sizes]), sum(sizes), folder, len(sizes)
        if self.n >= LIMIT:
            raise OverflowError(f"{self.n} distinct words; numbers have 32 bits")

    def part(self, k: int) -> tuple[Sequence, Sequence]:
        """A shard's hashes and sums; words come in the order of shards, so one is open at a time."""
        data = mapped(f"{self.folder}/1-{k}")
        hashes = Sequence(data)
        return hashes, Sequence(data[hashes.size :])

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The number of each of some ascending hashes, -1 if it is unknown."""
        number = np.full(len(h), -1, dtype=np.int64)
        for shard, a, b in C.runs(C.shard_of(h, self.shards)):
            at = self.part(shard)[0].find(h[a:b] - np.uint64(_base(shard, self.shards)))
            some = np.flatnonzero(at >= 0)
            number[a + some] = self.first[shard] + at[some]
        return number

    def counts(self, number: np.ndarray) -> np.ndarray:
        """The count of each of some numbers, which ascend but for those that are -1; 0 for -1."""
        count, some = np.zeros(len(number), dtype=np.int64), np.flatnonzero(number >= 0)
        for k, a, b in C.runs(np.searchsorted(self.first, number[some], side="right") - 1):
            first, last = self.part(k)[1].get_both(number[some[a:b]] - self.first[k])
            count[some[a:b]] = (last - first).astype(np.int64)
        return count


def _base(shard: int, shards: int) -> int:
    """The least hash of a shard, by C.shard_of."""
    return -(-(shard << 32) // shards) << 32


class Level:
    """Level k of one shard: what follows each node of level k - 1."""

    def __init__(self, data: np.ndarray):
        self.parents, self.n = (int(x) for x in data[:16].view("<u8"))
        self.pointers = Sequence(data[16:])
        at = 16 + self.pointers.size
        self.words = Sequence(data[at:])
        at += self.words.size
        self.p, self.weight, self.size = data[at : at + self.n], data[at + self.n : at + self.n + self.parents], len(data)

    def find(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The entry of each word after its node, -1 if none; nodes ascend, so each range is read once."""
        starts = C.starts_of(node)
        unique, of = node[starts], np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(node)]])))
        first, last = (x.astype(np.int64) for x in self.pointers.get_both(unique))
        base = np.zeros(len(unique), dtype=np.uint64)
        full = last > first
        some = full & (first > 0)
        base[some] = self.words.get(first[some] - 1) + np.uint64(1)
        out, open_ = np.full(len(node), -1, dtype=np.int64), np.flatnonzero(full[of])
        if len(open_):
            k = of[open_]
            target = base[k] + word[open_].astype(np.uint64)
            inside = target <= self.words.last
            open_, k = open_[inside], k[inside]
            out[open_] = self.words.find(target[inside], first[k], last[k])
        return out


def _level(parents: int, node: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
    """The file of a level from its distinct (node, word) pairs in order, with counts."""
    if parents >= LIMIT:
        raise OverflowError(f"{parents} nodes in a shard; numbers have 32 bits")
    total = np.bincount(node, weights=count, minlength=parents)
    p = np.minimum(np.ceil(-np.log10(np.maximum(count - DISCOUNT, 1e-9) / total[node]) * P_STEP), 255).astype(np.uint8)
    mass = np.bincount(node, weights=10.0 ** (-p.astype(float) / P_STEP), minlength=parents)
    weight = np.clip(np.round(-np.log10(np.clip(1 - mass, 1e-4, 1)) * W_STEP), 0, 255).astype(np.uint8)
    ends = np.cumsum(np.bincount(node, minlength=parents))
    starts = C.starts_of(node)
    # Each range begins one above the last number of the range before.
    last = word[np.concatenate([starts[1:], [len(node)]]) - 1] + 1 if len(node) else np.zeros(0, np.int64)
    base = np.cumsum(last) - last
    words = (word + np.repeat(base, np.diff(np.concatenate([starts, [len(node)]])))).astype(np.uint64)
    pointers = build(np.concatenate([[0], ends]).astype(np.uint64), len(node) + 1)
    data = pointers + build(words, int(words[-1]) + 1 if len(words) else 1) + p.tobytes() + weight.tobytes()
    return np.array([parents, len(node)], dtype="<u8").tobytes() + data + bytes(-len(data) % 8)


class Trie:
    """The levels that there are, and walks along all n-grams of a chunk at once.

    ``entries[k]`` has how many entries each shard has in level k.  Entry e of shard a is a node of shard (a + e) modulo
    the number of shards in the level above, where the nodes that come from shard 0 stand first."""

    def __init__(self, folder: str, shards: int, words: int, entries: dict[int, list[int]]):
        self.folder, self.shards, self.words, self.n = folder, shards, words, {k: np.array(v, dtype=np.int64) for k, v in entries.items()}
        self.order, self.held, self.bytes = max([1, *entries]), OrderedDict(), 0

    def level(self, k: int, shard: int) -> Level:
        """A level of a shard, opened when it is needed; where files aren't mapped, the oldest ones go."""
        if (k, shard) in self.held:
            self.held.move_to_end((k, shard))
            return self.held[k, shard]
        path = f"{self.folder}/{k}-{shard}"
        level = self.held[k, shard] = Level(mapped(path))
        if not is_mapped(path):
            self.bytes += level.size
            while self.bytes > HELD and len(self.held) > 1:
                self.bytes -= self.held.popitem(last=False)[1].size
        return level

    def nodes_from(self, k: int, shard: int) -> np.ndarray:
        """Where the nodes that come from each shard of level k - 1 stand in a shard of level k; at last their number."""
        n, rest = self.n[k - 1], (shard - np.arange(self.shards)) % self.shards
        return np.concatenate([[0], np.cumsum(np.maximum(0, (n - rest + self.shards - 1) // self.shards))])

    def parents(self, level: int, shard: int) -> int:
        """How many nodes a shard of a level has."""
        return -(-(self.words - shard) // self.shards) if level == 2 else int(self.nodes_from(level, shard)[-1])

    def contexts(self, number: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """For k from 2 to one above the trie's order: the tokens whose k - 1 tokens before them are a node, in the
        order of shards, that node and its shard, and (up to the order) the entry that each token is there, -1 if it is
        none."""
        at = np.flatnonzero(number >= 0)
        shard, node = (number[at] % self.shards).astype(np.int32), number[at] // self.shards
        for k in range(2, self.order + 2):
            # An n-gram that ends at a token is the context of the token after it, if one stands there.
            ok = at + 1 < len(place)
            at, shard, node = at[ok] + 1, shard[ok], node[ok]
            ok = place[at] > 0
            at, shard, node = at[ok], shard[ok], node[ok]
            if k > 2:
                own, shard = shard, ((shard + node) % self.shards).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            at, shard, node = at[order], shard[order], node[order]
            if k > 2:
                own = own[order]
                for part, a, b in C.runs(shard):
                    node[a:b] = self.nodes_from(k, part)[own[a:b]] + node[a:b] // self.shards
            if k > self.order:
                yield k, at, node, shard, None
                return
            entry = self.entries(k, shard, node, number[at])
            yield k, at, node, shard, entry
            ok = entry >= 0
            at, shard, node = at[ok], shard[ok], entry[ok]

    def entries(self, k: int, shard: np.ndarray, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The entries of level k, -1 where there are none; shards ascend."""
        out = np.full(len(node), -1, dtype=np.int64)
        key = node.astype(np.uint64) << np.uint64(32) | np.maximum(word, 0).astype(np.uint64)
        for part, a, b in C.runs(shard):
            order = np.argsort(key[a:b])
            ks = key[a:b][order]
            starts = C.starts_of(ks)
            found = self.level(k, part).find((ks[starts] >> np.uint64(32)).astype(np.int64), (ks[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64))
            out[a + order] = np.repeat(found, np.diff(np.concatenate([starts, [len(ks)]])))
        out[word < 0] = -1
        return out

    def scores(self, s: Streams, number: np.ndarray, count: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token log10 of the base probability and log10 of the model's; of END at a start 0."""
        p = (count + 1) / (total + self.words + 1)
        base = np.log10(p)
        for k, at, node, shard, entry in self.contexts(number, s.place):
            if entry is None:
                break
            weight, seen = np.empty(len(at)), np.zeros(len(at))
            for part, a, b in C.runs(shard):
                level = self.level(k, part)
                weight[a:b] = WEIGHTS[level.weight[node[a:b]]]
                some = a + np.flatnonzero(entry[a:b] >= 0)
                seen[some] = PROBABILITIES[level.p[entry[some]]]
            p[at] = seen + weight * p[at]
        model = np.log10(p)
        base[s.place == 0] = model[s.place == 0] = 0
        return base, model


_tries: dict[tuple, Trie] = {}


def _trie(folder: str, shards: int, words: int, entries: dict[int, list[int]]) -> Trie:
    """The trie of this process; files that are mapped once serve all of its tasks."""
    if (folder, len(entries)) not in _tries:
        _tries.clear()
        _tries[folder, len(entries)] = Trie(folder, shards, words, entries)
    return _tries[folder, len(entries)]


def _stage(docs: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """Writes the documents' tokens as chunk files: ``file``, ``size`` (bytes of text) and ``tokens`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(forget_encoders=True)
        ids, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 24

        def save() -> pa.RecordBatch:
            nonlocal number
            file = f"{number}-{uuid.uuid4().hex}"
            s, hashes, learnt = Streams.of_texts(ids, texts)
            put(f"{folder}/n-{file}", s.save())
            put(f"{folder}/h/{file}", _two(hashes, learnt))
            number += 1
            return pa.RecordBatch.from_pydict({"file": [file], "size": pa.array([size], pa.int64())})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), split_texts(b.column(1)), strict=True):
                if ids and (size + len(t or b"") > C.CHUNK_BYTES or len(ids) == C.CHUNK_DOCS):
                    yield save()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
        if ids:
            yield save()
        ids, texts = [], []
        tidy()

    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`")).mapInArrow(run, "file string, size long")
    return written(rows, "lm-chunks")


def lm_scores(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the training documents of ``docs`` and scores all of them: one row per row, with its id,
    ``held_out, n_tokens, n_known, train_tokens, base_score`` and ``score``.

    Tokens: words between ASCII white space, A-Z lower-cased, and one end.  Null and empty texts are their end alone;
    texts of any length are whole (a chunk has one at least).  Ids are whole numbers; a null id counts as the empty text
    in the choice of training documents.  Repeated rows count as often as they occur.  Extra columns are ignored; empty
    tables give no rows.  With no training document every token is unknown.  Words are 64-bit hashes.
    """
    spark = docs.sparkSession
    trie = shared_folder(spark, "lm-trie")
    listed = _stage(docs, id_col, text_col, trie)
    chunks, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards, parts = int(min(SHARDS, max(1, size // 6 // C.SHARD))), int(min(max(1, chunks), C.TASKS))
    spread = listed.select("file").repartition(parts, "file")
    sent = "shard int, n int, data binary"

    def send(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        out = [(shard, len(key), C.squeeze(C.planes(np.diff(key, prepend=np.uint64(0))) + C.planes(count.astype("<u4")))) for shard, key, count in rows]
        return pd.DataFrame(out, columns=["shard", "n", "data"])

    def merge(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order and their counts over all chunks."""
        keys, counts = [], []
        for n, data in zip(rows["n"], rows["data"], strict=True):
            raw = C.unsqueeze(data)
            keys.append(np.cumsum(C.unplanes(raw[: 8 * n], "<u8", n), dtype=np.uint64))
            counts.append(C.unplanes(raw[8 * n :], "<u4", n))
        key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order_ = np.argsort(key)
        key = key[order_]
        starts = C.starts_of(key)
        return key[starts], np.add.reduceat(count[order_], starts) if len(starts) else count

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for file in rows["file"]:
                h, n = _both(get(f"{trie}/h/{file}"))
                h, n = h[n > 0], n[n > 0]
                yield send([(shard, h[a:b], n[a:b]) for shard, a, b in C.runs(C.shard_of(h, shards))])

    def write_words(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        key, count = merge(rows)
        base = _base(shard, shards)
        top, key = _base(shard + 1, shards) - base, key - np.uint64(base)
        sums = np.concatenate([[0], np.cumsum(count)]).astype(np.uint64)
        put(f"{trie}/1-{shard}", build(key, top) + build(sums, int(sums[-1]) + 1))
        return pd.DataFrame({"shard": [shard], "n": [len(key)], "tokens": [int(count.sum())]})

    words = spread.mapInPandas(count_words, sent).repartition(min(shards, C.TASKS), "shard").groupBy("shard").applyInPandas(write_words, "shard int, n long, tokens long")
    made = {r["shard"]: r for r in words.collect()}  # a row a shard
    for k in range(shards):
        if k not in made:
            put(f"{trie}/1-{k}", build(np.zeros(0, np.uint64), 1) + build(np.zeros(1, np.uint64), 1))
    sizes, total = [made[k]["n"] if k in made else 0 for k in range(shards)], sum(r["tokens"] for r in made.values())

    n_words = sum(sizes)

    def save_numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(trie, sizes)
        for rows in batches:
            for file in rows["file"]:
                number = vocabulary.look_up(_both(get(f"{trie}/h/{file}"))[0])
                put(f"{trie}/v-{file}", _two(number + 1, vocabulary.counts(number)))
            yield rows[["file"]]

    def load(file: str) -> tuple[Streams, np.ndarray, np.ndarray]:
        """A chunk's tokens, their numbers and counts."""
        s = Streams.load(get(f"{trie}/n-{file}"))
        number, count = (x.astype(np.int64) for x in _both(get(f"{trie}/v-{file}")))
        return s, (number - 1)[s.tokens], count[s.tokens]

    numbered = written(spread.mapInPandas(save_numbers, "file string"), "lm-numbered").repartition(parts, "file")
    drop(spark, f"{trie}/h")  # nothing later reads the hashes
    entries: dict[int, list[int]] = {}

    for level in range(2, order + 1):

        def count_ngrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = _trie(trie, shards, n_words, entries)
            for rows in batches:
                for file in rows["file"]:
                    s, number, _ = load(file)
                    *_, (_, at, node, shard, _) = t.contexts(np.where(s.learn[s.doc], number, -1), s.place)
                    key = node.astype(np.uint64) << np.uint64(32) | number[at].astype(np.uint64)
                    out = []
                    for part, a, b in C.runs(shard):
                        k = np.sort(key[a:b])
                        starts = C.starts_of(k)
                        out.append((part, k[starts], np.diff(np.concatenate([starts, [len(k)]]))))
                    yield send(out)

        def write_ngrams(rows: pd.DataFrame) -> pd.DataFrame:
            shard = int(rows["shard"].iloc[0])
            key, count = merge(rows)
            parents = _trie(trie, shards, n_words, entries).parents(level, shard)
            put(f"{trie}/{level}-{shard}", _level(parents, (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), count))
            return pd.DataFrame({"shard": [shard], "n": [len(key)]})

        found = numbered.mapInPandas(count_ngrams, sent).repartition(min(shards, C.TASKS), "shard").groupBy("shard").applyInPandas(write_ngrams, "shard int, n long")
        there = {r["shard"]: r["n"] for r in found.collect()}  # two numbers a shard
        t, none = Trie(trie, shards, n_words, entries), np.zeros(0, np.int64)
        for k in set(range(shards)) - set(there):  # shards without an n-gram
            put(f"{trie}/{level}-{k}", _level(t.parents(level, k), none, none, none))
        entries = {**entries, level: [there.get(k, 0) for k in range(shards)]}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _trie(trie, shards, n_words, entries)
        for rows in batches:
            for file in rows["file"]:
                s, number, count = load(file)
                base, model = t.scores(s, number, count, total)
                known = np.bincount(s.doc, weights=(count > 0) & (s.place > 0), minlength=len(s.ids)).astype(np.int64)
                yield pd.DataFrame(
                    {
                        "id": pd.array(s.ids, dtype="Int64"), "held_out": ~s.learn, "n_tokens": s.counts + 1, "n_known": known, "train_tokens": total,
                        "base_score": np.bincount(s.doc, weights=base, minlength=len(s.ids)), "score": np.bincount(s.doc, weights=model, minlength=len(s.ids)),
                    }
                )

    scored = numbered.mapInPandas(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
