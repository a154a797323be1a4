"""Retrieval quality: hit rate, mean reciprocal rank, precision, latency."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds_keyword(text: Column, tags: Column, keywords: Column) -> Column:
    """Any keyword as a part of the text or the tags, whatever the case."""
    where = F.lower(F.concat_ws(" ", text, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))
    return F.exists(keywords, lambda k: F.contains(where, F.lower(k)))


def per_question(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """From hits (qid, place, relevant): hit, reciprocal rank and precision, both to 4 decimals, and the number of chunks."""
    g = hits.groupBy("qid").agg(F.min(F.when(F.col("relevant"), F.col("place"))).alias("first"), F.avg(F.col("relevant").cast("double")).alias("p"), F.count("*").alias("chunks"))
    out = questions.select("qid").join(g, "qid", "left")
    return out.select(
        "qid", F.col("first").isNotNull().alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("reciprocal_rank"),
        F.round(F.coalesce("p", F.lit(0.0)), 4).alias("precision"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"),
    )


def totals(results: DataFrame) -> DataFrame:
    rate = F.avg(F.col("hit").cast("double"))
    rating = F.when(rate >= 0.8, "excellent").when(rate >= 0.6, "good").when(rate >= 0.4, "fair").otherwise("poor")
    return results.agg(
        F.count("*").alias("questions"), F.count_if("hit").alias("hits"), (F.count("*") - F.count_if("hit")).alias("misses"), F.round(rate, 4).alias("hit_rate"),
        F.round(F.avg("reciprocal_rank"), 4).alias("mrr"), F.round(F.avg("precision"), 4).alias("mean_precision"), rating.alias("rating"),
        *([F.round(F.avg("latency_ms")).cast("long").alias("mean_latency_ms")] if "latency_ms" in results.columns else []),
    )


def sample(chunks: DataFrame, n: int, seed: int = 0, least: int = 200, key: str = "point_id") -> DataFrame:
    """``n`` chunks of more than ``least`` characters, by a hash of their key and the seed: the same for the same seed."""
    drawn = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)
    return chunks.where(F.length("text") > least).withColumn("__d", drawn).orderBy("__d", key).limit(n).drop("__d")


def synthetic_pairs(chunks: DataFrame, make: Callable[[str], dict]) -> DataFrame:
    """Rows (query, context, answer, source_file, chunk_id) that a model makes of chunks; a chunk that it fails on, or of
    which it says less than a query and an answer, has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, name, chunk in zip(b["text"], b["filename"], b["chunk_id"], strict=True):
                try:
                    said = make(text)
                except Exception:  # the model's own failure
                    continue
                if isinstance(said, dict) and said.get("query") and said.get("answer"):
                    rows.append((said["query"], text, said["answer"], name, chunk))
            yield pd.DataFrame(rows, columns=["query", "context", "answer", "source_file", "chunk_id"])

    return chunks.select("text", "filename", "chunk_id").mapInPandas(run, "query string, context string, answer string, source_file string, chunk_id string")


def ocr_benchmark(pages: DataFrame) -> DataFrame:
    """Pages (confidence, is_table, seconds): counts, mean confidence, seconds a page."""
    n = F.greatest(F.count("*"), F.lit(1))
    return pages.agg(
        F.count("*").alias("pages"), F.count_if(F.col("confidence") < 0.70).alias("low_quality"), F.count_if("is_table").alias("table_pages"),
        F.round(F.coalesce(F.sum("confidence"), F.lit(0.0)) / n, 4).alias("mean_confidence"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)) / n, 4).alias("seconds_per_page"),
    )
