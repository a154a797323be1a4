"""The nearest of many vectors to a bounded set of questions: products of matrices in tasks, exact scores for what they leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Products that a task holds at once, candidates that it holds a question (times k) before it cuts them, and tasks at
#: most: each hands on k rows a question, so that what is shuffled grows with the questions alone.
PRODUCTS, HELD, TASKS = 2_000_000, 4, 48
#: Scores this near may change places when they are rounded to 9 decimals.
SLACK = 2e-9


def rounded(score: np.ndarray) -> np.ndarray:
    """To 9 decimals, halves away from zero."""
    return np.sign(score) * np.floor(np.abs(score) * 1e9 + 0.5) / 1e9


def plain(v: Column, dim: int) -> Column:
    """Whether a vector has a score with other such ones: of length ``dim``, not zero, without nulls and without values that
    aren't finite."""
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((F.size(v) == dim) & (size > 0) & (size < float("inf")), F.lit(False))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up from the first to the last as ``vectors.dot`` does."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def first_places(group: np.ndarray, key: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that are among the first ``k`` of their group by key, largest first, ties by the smaller tie."""
    order = np.lexsort((tie, -key, group))
    g = group[order]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(g)), 0))
    return order[np.arange(len(g)) - start < k]


def search(vectors: DataFrame, qids: pa.Array, questions: np.ndarray, kind: str, k: int, wanted: np.ndarray | None = None) -> DataFrame:
    """Rows (qid, doc, score, key) of the ``k`` nearest vectors of each question within each task; ``key`` is the score to 9
    decimals.  ``vectors`` (doc, v) are plain ones; with ``cluster``, a vector meets only the questions for which
    ``wanted`` (question by cluster) says so."""
    n, dim = questions.shape
    unit = questions / np.linalg.norm(questions, axis=1, keepdims=True)
    size = np.sqrt(_dot(questions, questions))
    doc = vectors.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(n, -np.inf)
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def cut() -> None:
            group, score = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            docs = pa.concat_arrays([h[2] for h in held])
            key = rounded(score)
            keep = first_places(group, key, np.unique(docs.to_numpy(zero_copy_only=False), return_inverse=True)[1], k)
            group, score = group[keep], score[keep]
            full = np.bincount(group, minlength=n) >= k
            least = np.full(n, np.inf)
            np.minimum.at(least, group, score)
            floor[full] = least[full] - SLACK
            held[:] = [(group, score, docs.take(pa.array(keep)))]

        def meet(x: np.ndarray, length: np.ndarray, docs: pa.Array, asked: np.ndarray | None) -> None:
            some = unit if asked is None else unit[asked]
            own = floor if asked is None else floor[asked]
            products = some @ (x / length[:, None]).T
            if len(x) > k and (fresh := np.isneginf(own)).any():
                own = own.copy()
                own[fresh] = np.partition(products[fresh], -k, axis=1)[:, -k] - SLACK
            q, row = np.nonzero(products >= own[:, None])
            q = q if asked is None else asked[q]
            for at in range(0, len(q), PRODUCTS // 16):
                i, r = q[at : at + PRODUCTS // 16], row[at : at + PRODUCTS // 16]
                held.append((i, _dot(x[r], questions[i]) / (np.sqrt(_dot(x[r], x[r])) * size[i]), docs.take(pa.array(r))))
            if sum(len(h[0]) for h in held) > max(HELD * k * n, 100_000):
                cut()

        step = max(64, PRODUCTS // n)
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim)
                length, docs = np.linalg.norm(x, axis=1), part.column("doc")
                if wanted is None:
                    meet(x, length, docs, None)
                    continue
                own = part.column("cluster").to_numpy()
                for c in np.unique(own):
                    rows, asked = np.flatnonzero(own == c), np.flatnonzero(wanted[:, c])
                    if len(asked):
                        meet(x[rows], length[rows], docs.take(pa.array(rows)), asked)
        if held:
            cut()
            group, score, docs = held[0]
            for at in range(0, len(group), 100_000):
                g, s = group[at : at + 100_000], score[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(g)), docs.slice(at, 100_000), pa.array(s), pa.array(rounded(s))], ["qid", "doc", "score", "key"])

    rows = vectors.select("doc", "v", *(["cluster"] if wanted is not None else []))
    return rows.coalesce(TASKS).mapInArrow(run, f"qid {kind}, doc {doc}, score double, key double")
