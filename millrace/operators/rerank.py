"""Second-stage ranking by expressions; a model can be put in as a function on columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.tags import extract_tags
from millrace.operators.lexical import ranked


def terms_of(question: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(question), r"\s+"), lambda w: w != ""))


def lexical_score(question: Column, text: Column, tags: Column, score: Column) -> Column:
    """The score, a quarter per tag in common, a twentieth per word of the question in the text."""
    common = F.size(F.array_intersect(extract_tags(question), F.coalesce(tags, F.array().cast("array<string>"))))
    words = F.size(F.filter(terms_of(question), lambda w: F.contains(F.lower(text), w)))
    return F.round(score + 0.25 * common + 0.05 * words, 4)


def mock_score(question: Column, text: Column, rank: Column) -> Column:
    hit = F.exists(terms_of(question), lambda w: F.contains(F.lower(text), w))
    return F.round(1 - 0.05 * rank + F.when(hit, 1.0).otherwise(0.0), 4)


def model_score(score: Callable[[list[str], list[str]], list[float]], question: Column, text: Column, fallback: Column) -> Column:
    """Scores of a model on pairs of question and text, in Arrow batches; a batch that it fails on has ``fallback``."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series, other: pd.Series) -> pd.Series:
        try:
            return pd.Series([float(x) for x in score(q.fillna("").tolist(), t.fillna("").tolist())])
        except Exception:  # the model's own failure
            return other

    return F.round(run(question, text, fallback.cast("double")), 4)


def reranker(name: str = "lexical", model: Callable | None = None) -> Callable[[DataFrame], Column]:
    """How hits (question, text, tags, score, rank) are scored: "lexical", "mock", or "model" with one that is given."""
    words = lambda h: lexical_score(F.col("question"), F.col("text"), F.col("tags"), F.col("score"))
    if name == "mock":
        return lambda h: mock_score(F.col("question"), F.col("text"), F.col("rank"))
    if name == "model" and model is not None:
        return lambda h: model_score(model, F.col("question"), F.col("text"), words(h))
    if name in ("lexical", "model"):
        return words
    raise ValueError(f"no reranker {name!r}")


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """The ``k`` best hits of each question by ``score``, ties by their rank before."""
    hits = hits.withColumn("rerank_score", score).withColumnRenamed("rank", "rank_before")
    return ranked(hits, ["qid"], [F.desc("rerank_score"), F.asc("rank_before"), F.asc("doc")], k)
