"""Fusion of dense and lexical candidates: weighted reciprocal ranks, one score, authority, threshold, page diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.tags import asks_exactly, authority
from millrace.operators import ontology, rerank

RRF_K, THRESHOLD, PER_PAGE = 40, 0.38, 2
#: Weights of dense and lexical ranks: when the question names a tag, and otherwise.
TAGGED, PLAIN = (0.30, 0.70), (0.70, 0.30)


def weights(tagged: Column) -> tuple[Column, Column]:
    return tuple(F.when(tagged, a).otherwise(b) for a, b in zip(TAGGED, PLAIN, strict=True))


def unified_score(dense: Column, bm25: Column, dw: Column, bw: Column) -> Column:
    """Both: a weighted sum with BM25 scaled to at most .95; one alone: itself, BM25 scaled to at most .90."""
    d, b = F.coalesce(dense, F.lit(0.0)), F.coalesce(bm25, F.lit(0.0))
    return F.when((d > 0) & (b > 0), dw * d + bw * F.least(F.lit(0.95), b / 12)).when(d > 0, d).otherwise(F.least(F.lit(0.90), b / 12))


def fuse(dense: DataFrame, sparse: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Rows (qid, doc, dense, bm25, rrf, score, rank) from (qid, doc, score, rank) of both sides.

    ``questions`` has (qid, tagged).  Both sides are put under each other and added up by document: one shuffle, no
    outer join.  The best ``3 k`` stay; a question without lexical hits keeps all its dense ones, by score.
    """
    dw, bw = weights(F.col("tagged"))
    d = dense.select("qid", "doc", F.col("score").alias("dense"), F.lit(None).cast("double").alias("bm25"), F.col("rank"))
    s = sparse.select("qid", "doc", F.lit(None).cast("double").alias("dense"), F.col("score").alias("bm25"), F.col("rank"))
    # Dealt out here: adaptive execution may give both sides of the union other partitions than it has said.  By both
    # columns, as a dealing by qid alone is left out where both sides say that they have it.
    both = d.unionByName(s).repartition("qid", "doc").join(questions.select("qid", "tagged"), "qid")
    part = F.when(F.col("dense").isNotNull(), dw).otherwise(bw) / (RRF_K + F.col("rank"))
    found = both.groupBy("qid", "doc", "tagged").agg(
        F.max("dense").alias("dense"), F.max("bm25").alias("bm25"), F.sum(part).alias("rrf"), F.min(F.when(F.col("dense").isNotNull(), F.col("rank"))).alias("d_rank"), F.min("rank").alias("s_rank")
    )
    found = found.withColumn("score", unified_score(F.col("dense"), F.col("bm25"), dw, bw))
    q = Window.partitionBy("qid")
    found = found.withColumn("has_sparse", F.count("bm25").over(q) > 0)
    order = [F.when(F.col("has_sparse"), F.round("rrf", 12)).desc(), F.round("score", 12).desc(), F.col("d_rank").asc_nulls_last(), F.asc("s_rank"), F.asc("doc")]
    found = found.withColumn("rank", F.row_number().over(q.orderBy(*order)) - 1)
    return found.where(~F.col("has_sparse") | (F.col("rank") < 3 * k)).drop("d_rank", "s_rank", "has_sparse")


def diversify(hits: DataFrame, k: int, per_page: int = PER_PAGE, page: tuple[str, ...] = ("filename", "page_number"), threshold: float | None = THRESHOLD) -> DataFrame:
    """Hits of at least ``threshold``, at most ``per_page`` of a page in rank order, the first ``k`` of each question."""
    if threshold is not None:
        hits = hits.where(F.col("score") >= threshold)
    on_page = F.row_number().over(Window.partitionBy("qid", *page).orderBy("rank", "doc"))
    hits = hits.withColumn("on_page", on_page).where(F.col("on_page") <= per_page).drop("on_page")
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc"))).where(F.col("place") <= k)


def prepare(questions: DataFrame, units: DataFrame) -> DataFrame:
    """Questions (qid, text) with what each side searches for: ``dense_query`` (the question with spoken codes, a bar, the
    question with definitions, where codes were added), ``lexical_query`` (the first four boosts behind the question) and
    ``tagged``.  Blank questions go."""
    asked = questions.where(F.length(F.trim("text")) > 0)
    out = ontology.expand(asked, units)
    enriched = ontology.expand_acronyms(F.col("text"))
    dense = F.when(enriched != F.trim("text"), F.concat(enriched, F.lit(" | "), F.col("dense_text"))).otherwise(F.col("dense_text"))
    words = F.concat_ws(" ", F.trim("text"), F.array_join(F.slice("boosts", 1, 4), " "))
    return out.select(*asked.columns, dense.alias("dense_query"), F.trim(words).alias("lexical_query"), asks_exactly("text").alias("tagged"))


def retrieve(index, vectors: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = 4, threshold: float = THRESHOLD, criteria: dict | None = None, prefilter: bool = False, score=None) -> DataFrame:
    """The whole retrieval for a table of questions (qid, text, vector; by choice ``lexical_query`` and ``tagged``, see
    ``prepare``).  The plan is lazy but for what bounds it: the questions are counted, and an index that isn't
    one of segments writes the postings of their terms, which a ``scope`` around the use of the hits deletes.

    ``index``: postings, or a view of segments.  ``criteria`` filter vectors before the ranking.  Lexical hits are filtered after it, which leaves gaps in their
    ranks; ``prefilter`` filters them before as well.  ``chunks`` has doc, filename, page_number, location, revision.
    ``score`` (a function of hits with question, text, tags, score and rank; see ``rerank.reranker``) ranks again.
    """
    from millrace.operators import dense as D
    from millrace.operators import lexical as L
    from millrace.operators.segments import View

    questions = questions.where(F.length(F.trim("text")) > 0)
    if "tagged" not in questions.columns:
        questions = questions.withColumn("tagged", asks_exactly("text"))
    # A question without a vector has no dense hits: rows without a score would take places of lexical ones.
    near = D.search(vectors, questions.where("vector IS NOT NULL"), 2 * k, "doc", "embedding", criteria)
    kept = chunks.where(D.matches(chunks, criteria)).select("doc") if criteria and prefilter else None
    if kept is not None and not isinstance(index, View):
        index = L.Index(index.postings.join(kept, "doc", "left_semi"), index.lengths, index.stats)
    asked = questions.select("qid", (F.col("lexical_query") if "lexical_query" in questions.columns else F.col("text")).alias("text"))
    words = index.search(asked, 2 * k, only=kept) if isinstance(index, View) else L.search(index, asked, 2 * k)
    if criteria and not prefilter:
        words = words.join(chunks.where(D.matches(chunks, criteria)).select("doc"), "doc", "left_semi")
    named = chunks.withColumnRenamed("text", "body") if "text" in chunks.columns else chunks
    fused = fuse(near, words, questions, k).join(named, "doc").join(questions.select("qid", F.col("text").alias("question")), "qid")
    factor = authority(F.col("filename"), F.col("location"), F.col("question"), F.col("revision"))
    fused = fused.withColumn("score", F.round(F.col("score") * factor, 4))
    if "body" in fused.columns:
        fused = fused.withColumnRenamed("body", "text")
    found = diversify(fused, k, threshold=threshold)
    if score is not None:
        found = rerank.rerank(found, score(found), k).withColumn("place", F.col("rank") + 1)
    return found.drop("question")
