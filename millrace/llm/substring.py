"""Substring dedup by fixed-block anchors, without pairs of documents.

Documents are put into chunk files in the shared folder.  In a first exchange every chunk sends, by hash shard, the
sets of its rolling windows of BLOCK words, marked where one is a non-overlapping reference block (it begins at a
multiple of BLOCK words): a window of WINDOW = 2 * BLOCK - 1 words holds exactly one block of its document.  The
answer is one bit per hash, whether it is a reference block somewhere and stands in two documents.  Hits are extended
to all windows of WINDOW words around them, and a second exchange settles those exactly: the smallest id per window.
Overlapping windows cover the maximal repeats.  Only sets of hashes travel, once per chunk however often they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import chunks as C
from millrace.llm.storage import get, written
from millrace.llm.wordhash import inside_texts, window_hashes, word_hashes

LEAST_ID = -(2**63)


class Chunk:
    """A chunk file's documents in id order, with their words' hashes."""

    def __init__(self, data: bytes):
        self.ids, self.texts = C.read(data)
        self.words, self.counts = word_hashes(self.texts, fold=False)
        number = np.array([LEAST_ID if i is None else i for i in self.ids], dtype=np.int64)
        self.rank = np.cumsum(np.diff(number, prepend=number[:1]) != 0) if len(number) else np.zeros(0, np.int64)
        self.number = number
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)

    def first_keys(self, block: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each rolling window its key (shard, then 32 bits of hash), whether it lies in one text, and if it is a block."""
        h = window_hashes(self.words, block)
        key = C.shard_of(h, shards) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        begin = np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        aligned = ((np.arange(len(self.words)) - begin) % block == 0)[: len(h)]
        return key, inside_texts(self.counts, block), aligned


def _set_of(key: np.ndarray, doc: np.ndarray, aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, whether each stands in two documents, and whether it is a block in one."""
    both = np.sort(key << np.uint64(12) | doc.astype(np.uint64))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    keys = both >> np.uint64(12)
    starts = C.starts_of(keys)
    unique = keys[starts]
    several = np.diff(np.concatenate([starts, [len(keys)]])) > 1
    blocks = np.zeros(len(unique), dtype=bool)
    blocks[np.searchsorted(unique, key[aligned])] = True
    return unique, several, blocks


def _bits(rows: pd.DataFrame, n_of: dict[int, tuple[int, int]], n: int) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    for shard, bits in zip(rows["shard"], rows["bits"], strict=True):
        a, b = n_of[int(shard)]
        out[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
    return out


def _runs_of(*sorted_: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, in arrays that are sorted together."""
    new = np.ones(len(sorted_[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    return new


def substring_dedup(docs: DataFrame, block: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_words, n_removed`` and ``text`` (the kept words, joined by one space).

    Words are runs of characters other than ASCII white space.  A word goes if a window of ``2 * block - 1`` words over
    it also begins in a document with a smaller id; windows are judged on the input.  Ids are whole numbers; null ids
    count as one document below all others, and rows with one id as one document.  Null and empty texts have no words
    and come back as ''.  Texts of any length are whole (a chunk has one at least).  Repeats within one document stay;
    of repeated rows under different ids the smallest id keeps its words.  Windows are told apart by 96 bits and the bits
    of their shard.  Extra columns are ignored; empty tables give no rows.
    """
    window = 2 * block - 1
    folder, listed, shards, parts = C.stage(docs, id_col, text_col, "substring-chunks")
    chunks = listed.select(F.col("file").alias("chunk"))

    def send_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name in rows["chunk"]:
                c = Chunk(get(f"{folder}/{name}"))
                key, ok, aligned = c.first_keys(block, shards)
                unique, several, blocks = _set_of(key[ok], c.doc[: len(key)][ok], aligned[ok])
                out = []
                for shard, a, b in C.runs(unique >> np.uint64(32)):
                    v = (unique[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    data = C.planes(np.diff(v, prepend=np.uint32(0))) + np.packbits(several[a:b]).tobytes() + np.packbits(blocks[a:b]).tobytes()
                    out.append((shard, name, b - a, C.squeeze(data)))
                yield pd.DataFrame(out, columns=["shard", "chunk", "n", "data"])

    def answer_blocks(rows: pd.DataFrame) -> pd.DataFrame:
        vs, several, blocks = [], [], []
        for n, data in zip(rows["n"], rows["data"], strict=True):
            raw, flags = C.unsqueeze(data), -(-n // 8)
            vs.append(np.cumsum(C.unplanes(raw[: 4 * n], "<u4", n), dtype=np.uint32))
            several.append(np.unpackbits(np.frombuffer(raw[4 * n : 4 * n + flags], np.uint8), count=n))
            blocks.append(np.unpackbits(np.frombuffer(raw[4 * n + flags :], np.uint8), count=n))
        v = np.concatenate(vs).astype(np.uint64)
        both = np.sort(v << np.uint64(32) | np.arange(len(v), dtype=np.uint64))
        at, v = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), both >> np.uint64(32)
        starts = C.starts_of(v)
        length = np.diff(np.concatenate([starts, [len(v)]]))
        hit = ((length > 1) | np.maximum.reduceat(np.concatenate(several)[at], starts).astype(bool)) & np.maximum.reduceat(np.concatenate(blocks)[at], starts).astype(bool)
        out = np.zeros(len(v), dtype=bool)
        out[at] = np.repeat(hit, length)
        ends = np.cumsum(rows["n"].to_numpy())
        bits = [np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, rows["n"], strict=True)]
        return pd.DataFrame({"chunk": rows["chunk"], "shard": rows["shard"], "bits": bits})

    answer = "chunk string, shard int, bits binary"
    sent = chunks.repartition(parts, "chunk").mapInPandas(send_blocks, "shard int, chunk string, n int, data binary")
    first = written(sent.repartition(min(shards, C.TASKS), "shard").groupBy("shard").applyInPandas(answer_blocks, answer), "substring-hits")

    def windows(c: Chunk, rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Starts of the windows around hits and, of the distinct ones in order, shard, hash, smallest rank, and which is whose."""
        key, ok, aligned = c.first_keys(block, shards)
        unique, _, _ = _set_of(key[ok], c.doc[: len(key)][ok], aligned[ok])
        hit_of = _bits(rows, {s: (a, b) for s, a, b in C.runs(unique >> np.uint64(32))}, len(unique))
        hit = np.zeros(len(key), dtype=bool)
        hit[ok] = hit_of[np.searchsorted(unique, key[ok])]
        total = np.concatenate([[0], np.cumsum(hit)])
        whole = inside_texts(c.counts, window)
        starts = np.flatnonzero(whole & (total[block : block + len(whole)] - total[: len(whole)] > 0))
        h, g = window_hashes(c.words, window, 1)[starts], window_hashes(c.words, window, 2)[starts]
        shard, g = C.shard_of(g, shards), g.astype(np.uint32)  # the shard and 96 bits tell windows apart
        order = np.lexsort((h, shard))  # stable: equal windows stay in the documents' order
        other, differ = _runs_of(shard[order], h[order]), g[order]
        if (~other[1:] & (differ[1:] != differ[:-1])).any():
            order = np.lexsort((g, h, shard))
            other = _runs_of(shard[order], h[order], g[order])
        of = np.zeros(len(order), dtype=np.int64)
        of[order] = np.cumsum(other) - 1
        least = order[other]
        return starts, shard[least], h[least], g[least], c.doc[starts[least]], of

    def send_windows(rows: pd.DataFrame) -> pd.DataFrame:
        name, out = rows["chunk"].iloc[0], []
        c = Chunk(get(f"{folder}/{name}"))
        _, shard, h, g, doc, _ = windows(c, rows)
        for s, a, b in C.runs(shard):
            out.append((s, name, b - a, C.squeeze(C.planes(np.diff(h[a:b], prepend=np.uint64(0))) + C.planes(g[a:b]) + C.planes(c.number[doc[a:b]]))))
        return pd.DataFrame(out, columns=["shard", "chunk", "n", "data"])

    def answer_windows(rows: pd.DataFrame) -> pd.DataFrame:
        hs, gs, ids = [], [], []
        for n, data in zip(rows["n"], rows["data"], strict=True):
            raw = C.unsqueeze(data)
            hs.append(np.cumsum(C.unplanes(raw[: 8 * n], "<u8", n), dtype=np.uint64))
            gs.append(C.unplanes(raw[8 * n : 12 * n], "<u4", n))
            ids.append(C.unplanes(raw[12 * n :], "<i8", n))
        h, g, ids = np.concatenate(hs), np.concatenate(gs), np.concatenate(ids)
        order = np.argsort(h, kind="stable")
        other, differ = _runs_of(h[order]), g[order]
        if (~other[1:] & (differ[1:] != differ[:-1])).any():  # windows whose first 64 bits are alike
            order = np.lexsort((g, h))
            other = _runs_of(h[order], g[order])
        starts = np.flatnonzero(other)
        least = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.concatenate([starts, [len(h)]])))
        out = np.zeros(len(h), dtype=bool)
        out[order] = least < ids[order]
        ends = np.cumsum(rows["n"].to_numpy())
        bits = [np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, rows["n"], strict=True)]
        return pd.DataFrame({"chunk": rows["chunk"], "shard": rows["shard"], "bits": bits})

    asked = first.repartition(parts, "chunk").groupBy("chunk").applyInPandas(send_windows, "shard int, chunk string, n int, data binary")
    second = asked.repartition(min(shards, C.TASKS), "shard").groupBy("shard").applyInPandas(answer_windows, answer)

    def remove(rows: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(get(f"{folder}/{rows['chunk'].iloc[0]}"))
        starts, shard, h, _, doc, of = windows(c, rows[rows["step"] == 1])
        smaller = _bits(rows[rows["step"] == 2], {s: (a, b) for s, a, b in C.runs(shard)}, len(h))
        gone = smaller[of] | (c.rank[c.doc[starts]] > c.rank[doc[of]] if len(of) else np.zeros(0, dtype=bool))
        edge = np.zeros(len(c.words) + window + 1, dtype=np.int32)
        edge[starts[gone]] += 1
        edge[starts[gone] + window] -= 1
        covered = np.cumsum(edge)[: len(c.words)] > 0
        texts, n_removed, at = [], [], 0
        for text, n in zip(c.texts, c.counts.tolist(), strict=True):
            words, mask = (text or b"").split(), covered[at : at + n]
            removed = int(mask.sum())
            if removed:
                words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            texts.append(b" ".join(words).decode())
            n_removed.append(removed)
            at += n
        ids = pd.array(c.ids, dtype="Int64")
        return pd.DataFrame({"id": ids, "n_words": c.counts.astype(np.int64), "n_removed": n_removed, "text": texts})

    none = F.lit(None)
    every = chunks.select("chunk", none.cast("int").alias("shard"), none.cast("binary").alias("bits"), F.lit(0).alias("step"))
    answers = every.unionByName(first.withColumn("step", F.lit(1))).unionByName(second.withColumn("step", F.lit(2)))
    kept = answers.repartition(parts, "chunk").groupBy("chunk").applyInPandas(remove, "id long, n_words long, n_removed long, text string")
    return kept.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", F.col("text").alias(text_col))


def query(spark, sf_dir: str) -> DataFrame:
    kept = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 13), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f),
k AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM d) ANTI JOIN r USING (doc_id, p)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM k GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
