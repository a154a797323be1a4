"""Order-preserving packing of documents into token sequences by dynamic programming with a monotone queue.

The token stream of a partition, in its order, is cut into windows of at most ``size`` tokens.  Cuts may fall at ends
of documents (free), at the end of every sentence and, inside long ones, every few tokens (both at a penalty in tokens,
for what a truncated document costs).  The plan minimises padding plus penalties over all of these places: a window is
padded to ``size`` unless its length is a power of two.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.encoding import encoder
from millrace.llm.memory import small_batches, tidy

#: Penalties in tokens for a cut at the end of a sentence and inside one: higher ones truncate fewer documents and pad more.
SENTENCE_CUT, INNER_CUT = 64, 256
#: Tokens between possible cuts inside a sentence.
FARTHEST = 32
#: Tokens that are planned together; the last window of a plan is planned again with what follows.
SEGMENT = 1 << 20


def plan_cuts(pos: list[int], penalty: list[int], size: int) -> list[int]:
    """The cheapest cuts among the ascending positions ``pos`` (from 0, gaps at most ``size``), with both ends."""
    n = len(pos)
    cost, back, key = [0] * n, [0] * n, [0] * n
    at = {p: i for i, p in enumerate(pos)}.get
    powers = [1 << k for k in range(6, size.bit_length()) if 1 << k < size]
    queue: deque[int] = deque()
    for j in range(1, n):
        k = key[j - 1]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j - 1)
        p = pos[j]
        while pos[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        c = key[i] + size - p
        for s in powers:
            x = at(p - s)
            if x is not None and cost[x] < c:
                c, i = cost[x], x
        c += penalty[j]
        cost[j], back[j], key[j] = c, i, c + p
    cuts, j = [], n - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return [0, *cuts[::-1]]


def candidates(ids: np.ndarray, ends: np.ndarray, ender: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Where the stream ``ids`` may be cut and what each cut costs; ``ends``: after each document's last id."""
    cost = np.full(len(ids) + 1, -1, dtype=np.int32)
    cost[1:][ender[ids]] = SENTENCE_CUT
    cost[ends] = cost[0] = 0
    pos = np.flatnonzero(cost >= 0)
    step = min(FARTHEST, size)
    wide = np.flatnonzero(np.diff(pos) > step)
    if len(wide):
        cost[np.concatenate([np.arange(pos[w] + step, pos[w + 1], step) for w in wide])] = INNER_CUT
        pos = np.flatnonzero(cost >= 0)
    return pos.tolist(), cost[pos].tolist()


def sentence_enders(tokenizer) -> np.ndarray:
    """By id, whether a token ends a sentence: its text without the word-end mark ends in . ! or ?"""
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    table = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, k in vocabulary.items():
        table[k] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
    return table


class Packer:
    """Takes documents in order and yields pieces (doc, start, bytes of ids, doc_tokens, sequence, offset)."""

    def __init__(self, ender: np.ndarray, size: int):
        self.ender, self.size, self.sequence = ender, size, 0
        self.docs: list[tuple] = []  # (doc, bytes of all its ids, ids already placed)
        self.held = 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        self.docs.append((doc, ids, 0))
        self.held += len(ids) // 4
        if self.held >= SEGMENT:
            yield from self.flush(False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        if not self.held:
            return
        stream = np.frombuffer(b"".join(ids[4 * k :] for _, ids, k in self.docs), dtype="<u4")
        ends = np.cumsum([len(ids) // 4 - k for _, ids, k in self.docs])
        cuts = plan_cuts(*candidates(stream, ends, self.ender, self.size), self.size)
        if last:  # what remains goes into windows whose lengths are powers of two, which need no padding
            p, end = cuts[-2], cuts.pop()
            while p < end:
                p += 1 << ((end - p).bit_length() - 1) if end - p < self.size else self.size
                cuts.append(p)
        d, rest = 0, cuts[-1] if last else cuts[-2]
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        ends = ends.tolist()
        for a, b in zip(cuts, cuts[1:] if last else cuts[1:-1], strict=False):
            p = a
            while p < b:
                while ends[d] <= p:
                    d += 1
                doc, ids, k = self.docs[d]
                q, first = min(b, ends[d]), k + p - starts[d]
                yield doc, first, ids[4 * first : 4 * (first + q - p)], len(ids) // 4, self.sequence, p - a
                p = q
            self.sequence += 1
        kept = [(doc, ids, max(k, k + rest - s)) for (doc, ids, k), s, e in zip(self.docs, starts, ends, strict=True) if e > rest]
        self.docs, self.held = kept, (ends[-1] - rest)


def pack(
    docs: DataFrame, tokenizer: str, kind: str = "word", size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs ``docs`` and returns one row per piece: id, ``start, length, ids`` (little-endian unsigned 32-bit bytes),
    ``doc_tokens, sequence_id, offset``.

    A document is its text's ids and then ``end_id``; each id lies in exactly one piece.  ``sequence_id`` is the
    partition's number times 2**33 plus a count, so nothing is shuffled and no task waits for another; the order of
    each partition is kept.  A null or empty text is its end id alone; empty tables give no rows; repeated rows and
    null ids are documents of their own; extra columns are ignored.  Texts of any length are cut, never dropped.
    """
    fields = docs.select(F.col(f"`{id_col}`")).schema.fields[0].dataType.simpleString()
    schema = f"`{id_col}` {fields}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, kind)
        packer = Packer(sentence_enders(code.tokenizer), size)
        base, end, rows, held = TaskContext.get().partitionId() << 33, np.array([end_id], dtype="<u4").tobytes(), [], 0

        def out() -> pa.RecordBatch:
            doc, start, ids, total, seq, off = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, type=of), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(total, pa.int64()), pa.array([base + s for s in seq], pa.int64()), pa.array(off, pa.int64())],
                [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        docs_of, of = deque(), None

        def texts() -> Iterator[str | None]:
            """The texts of all batches; those that are encoded together may come from several."""
            nonlocal of
            for b in batches:
                of = b.schema.field(0).type
                docs_of.extend(b.column(0).to_pylist())
                for t in b.column(1):
                    yield t.as_py()

        def pieces() -> Iterator[tuple]:
            for ids in code.encode_all(texts()):
                yield from packer.add(docs_of.popleft(), ids + end)
            yield from packer.flush()

        for piece in pieces():
            rows.append(piece)
            held += len(piece[2])
            if held >= 8 << 20:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()
        tidy()

    return small_batches(docs).select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
