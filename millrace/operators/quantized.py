"""Cosine search on 8-bit codes: an index of a byte a component with each vector's scale and error, an integer inner product
over all codes, and exact scores for the few vectors that are left.

A vector v of unit length is ``scale * codes + rest`` with ``error = |rest|``, so the exact score of v and a question w lies
within ``error_v + error_w * (1 + error_v)`` of the product of their codes and scales.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vectors import cosine
from millrace.operators.lexical import ranked
from millrace.operators.nearest import PRODUCTS, TASKS

#: Bytes of questions that go to all codes at once; more questions are taken in several passes of that size.
QUESTION_BYTES = 16 << 20
#: How many times as many vectors as asked for are scored exactly, and the slack of double precision in bounds.
OVER, SLACK = 4, 1e-9


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and errors of vectors, after they were brought to unit length; of zero vectors all zero."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    scale = np.abs(x).max(axis=1, initial=0) / 127
    codes = np.rint(np.divide(x, scale[:, None], out=np.zeros_like(x), where=scale[:, None] > 0)).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


@dataclass
class Codes:
    """The index (doc, codes, scale, error) and the vectors (doc, v) that exact scores are taken from."""

    codes: DataFrame
    vectors: DataFrame
    dim: int

    def save(self, path: str) -> None:
        self.codes.withColumn("dim", F.lit(self.dim)).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, vectors: DataFrame, doc: str = "vec_id", vector: str = "embedding") -> Codes:
        rows = spark.read.parquet(path)
        first = rows.select("dim").first()
        return Codes(rows.drop("dim"), vectors.select(F.col(doc).alias("doc"), F.col(vector).alias("v")), first[0] if first else 1)


def build(vectors: DataFrame, doc: str = "vec_id", vector: str = "embedding") -> Codes:
    """Codes of all vectors; null vectors, and those that aren't as long as the longest, are left out."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(doc).alias("doc"), F.col(vector).cast("array<double>").alias("v"))
    dim = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    rows = rows.where((F.size("v") == dim) & F.expr("forall(v, x -> x is not null)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, scale, error = _codes(b.column("v").flatten().to_numpy().reshape(b.num_rows, dim))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)], ["doc", "codes", "scale", "error"])

    kind = rows.schema["doc"].dataType.simpleString()
    return Codes(rows.mapInArrow(run, f"doc {kind}, codes binary, scale double, error double"), rows, max(1, dim))


def search(index: Codes, queries: DataFrame, k: int, exact: bool = True, over: int = OVER) -> DataFrame:
    """Rows (qid, doc, score, rank from 0) of the ``k`` nearest vectors of each query (qid, vector); ties by doc.

    ``exact``: whatever could be among them by its bounds is scored, so none is missed; else the ``over * k`` best by
    codes are.  Zero vectors and zero questions have no score.  The stated questions are the small side: they are
    brought to the tasks in passes of a checked size."""
    n = queries.where(F.col("vector").isNotNull()).count()
    passes, found = max(1, -(-n * index.dim * 8 // QUESTION_BYTES)), None
    for p in range(passes):
        asked = queries.where(F.col("vector").isNotNull() & (F.pmod(F.xxhash64("qid"), F.lit(passes)) == p)).select("qid", F.col("vector").cast("array<double>").alias("q")).collect()
        asked = [r for r in asked if len(r["q"]) == index.dim and any(r["q"])]
        if asked:
            part = _near(index, [r["qid"] for r in asked], np.array([r["q"] for r in asked], dtype=float), queries.schema["qid"].dataType.simpleString(), k, exact, over)
            found = part if found is None else found.unionByName(part)
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, doc {index.codes.schema['doc'].dataType.simpleString()}"
    if found is None:
        return queries.sparkSession.createDataFrame([], f"{kinds}, score double, rank int")
    if exact:  # every vector whose greatest possible score reaches the k-th of the least possible ones
        floor = ranked(found.select("qid", "doc", "low"), ["qid"], [F.desc("low")], k).where(F.col("rank") == k - 1).select("qid", F.col("low").alias("floor"))
        left = found.join(floor, "qid", "left").where("floor is null OR high >= floor").select("qid", "doc")
    else:
        left = ranked(found, ["qid"], [F.desc(F.col("low") + F.col("high")), F.asc("doc")], over * k).select("qid", "doc")
    scored = left.join(index.vectors, "doc").join(queries.select("qid", F.col("vector").alias("q")), "qid").select("qid", "doc", cosine(F.col("v"), F.col("q")).alias("score"))
    return ranked(scored.where("score is not null"), ["qid"], [F.desc(F.round("score", 9)), F.asc("doc")], k)


def _near(index: Codes, qids: list, questions: np.ndarray, kind: str, k: int, exact: bool, over: int) -> DataFrame:
    """Bounds (qid, doc, low, high) of what each task's codes could bring among the first; few products are held at once."""
    q_codes, q_scale, q_error = _codes(questions)
    dim = index.dim
    whole = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # products of codes are whole numbers: exact in either
    q = q_codes.astype(whole).T

    n, m = len(qids), k if exact else over * k
    step, ids = max(64, PRODUCTS // max(1, n)), pa.array(qids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What the m-th best vector of the task has at least, a question, and what may be among them.
        best, held = np.full((n, m), -np.inf), []

        def cut() -> None:
            if not held:
                return
            col, low, high = (np.concatenate([h[i] for h in held]) for i in range(3))
            keep = np.flatnonzero((high if exact else low + high) >= best.min(axis=1)[col])
            held[:] = [(col[keep], low[keep], high[keep], pa.concat_arrays([h[3] for h in held]).take(pa.array(keep)))]

        size = 0
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, step):
                b = whole_batch.slice(at, step)
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), dtype=np.int8).reshape(-1, dim)
                scale, error = b.column("scale").to_numpy(), b.column("error").to_numpy()
                score = (q.T @ codes.astype(whole).T).astype(float) * scale * q_scale[:, None]
                slack = error + q_error[:, None] * (1 + error) + SLACK
                score[:, scale == 0] = -np.inf
                low, high = score - slack, score + slack
                told = low if exact else low + high
                keep = ((high if exact else told) >= best.min(axis=1)[:, None]) & np.isfinite(score)
                if np.count_nonzero(keep) > m * n:  # what is known already leaves much
                    best = np.partition(np.concatenate([best, told], axis=1), -m, axis=1)[:, -m:]
                    keep &= (high if exact else told) >= best.min(axis=1)[:, None]
                col, row = np.nonzero(keep)
                held.append((col, low[col, row], high[col, row], b.column("doc").take(pa.array(row))))
                size += len(col)
                if size > PRODUCTS:
                    cut()
                    size = len(held[0][0]) // 2  # what stays doesn't cause a cut by itself
        cut()
        for col, low, high, doc in held:
            for at in range(0, len(col), 100_000):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(col[at : at + 100_000])), doc.slice(at, 100_000), pa.array(low[at : at + 100_000]), pa.array(high[at : at + 100_000])], ["qid", "doc", "low", "high"])

    return index.codes.select("doc", "codes", "scale", "error").coalesce(TASKS).mapInArrow(run, f"qid {kind}, doc {index.codes.schema['doc'].dataType.simpleString()}, low double, high double")
