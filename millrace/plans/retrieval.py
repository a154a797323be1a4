"""Lexical, dense and hybrid retrieval for stated sets of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.tags import authority
from millrace.functions.text import tokens
from millrace.operators import dense as D
from millrace.operators import evaluate, fusion, rerank
from millrace.operators import evidence as E
from millrace.operators import lexical as L
from millrace.plans.register import BM25_SQL, DENSE_SQL, query, table

K = 10


def questions(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 100 = 0")
    return docs.select(F.col("doc_id").alias("qid"), F.array_join(F.slice(tokens("text"), 2, 5), " ").alias("text"))


def vector_questions(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def index(spark, d):
    return L.build_index(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def sparse(spark, d, k):
    return L.search(index(spark, d), questions(spark, d), k)


def dense(spark, d, k, criteria=None):
    return D.search(table(spark, d, "embeddings"), vector_questions(spark, d), k, criteria=criteria)


@query("bm25_topk", f"WITH {BM25_SQL} SELECT qid, doc, round(score, 6) AS score, rank FROM sr WHERE rank < {K}")
def bm25_topk(spark, d):
    return sparse(spark, d, K).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_doc_stats", f"WITH {BM25_SQL} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM p) AS postings, (SELECT count(DISTINCT term) FROM p) AS terms FROM st")
def bm25_doc_stats(spark, d):
    i = index(spark, d)
    p = i.postings.agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))
    return i.stats.join(F.broadcast(p)).select("n", F.round("avgdl", 6).alias("avgdl"), "postings", "terms")


@query("bm25_idf", f"WITH {BM25_SQL} SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, st GROUP BY term")
def bm25_idf(spark, d):
    i = index(spark, d)
    return L.idf(i.postings, i.stats).select("term", "df", F.round("idf", 6).alias("idf"))


@query("dense_topk", f"WITH {DENSE_SQL} SELECT qid, doc, round(score, 6) AS score, rank FROM dr WHERE rank < {K}")
def dense_topk(spark, d):
    return dense(spark, d, K).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("dense_clustered_topk", f"WITH {DENSE_SQL} SELECT qid, doc, round(score, 6) AS score, rank FROM dr WHERE rank < {K}")
def dense_clustered_topk(spark, d):
    """The nearest vectors of each question by the index, which finds them all."""
    index = D.build_clusters(table(spark, d, "embeddings"))
    return D.search_clusters(index, vector_questions(spark, d), K).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "dense_filtered_topk",
    f"""WITH {DENSE_SQL}, f AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) - 1 AS rank
    FROM dense JOIN embeddings ON vec_id = doc WHERE label IN (1, 3, 5)) SELECT qid, doc, round(score, 6) AS score, rank FROM f WHERE rank < {K}""",
)
def dense_filtered_topk(spark, d):
    return dense(spark, d, K, {"label": [1, 3, 5]}).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FUSED = f"""
c AS (SELECT qid, doc, score AS dense, NULL AS bm25, rank FROM dr WHERE rank < {2 * K} UNION ALL SELECT qid, doc, NULL, score, rank FROM sr WHERE rank < {2 * K}),
fu AS (SELECT qid, doc, max(dense) AS dense, max(bm25) AS bm25, sum(CASE WHEN dense IS NOT NULL THEN 0.7 ELSE 0.3 END / (40 + rank)) AS rrf,
    min(CASE WHEN dense IS NOT NULL THEN rank END) AS d_rank, min(rank) AS s_rank FROM c GROUP BY ALL),
fs AS (SELECT *, CASE WHEN dense > 0 AND bm25 > 0 THEN 0.7 * dense + 0.3 * least(0.95, bm25 / 12) WHEN dense > 0 THEN dense ELSE least(0.9, coalesce(bm25, 0) / 12) END AS score,
    count(bm25) OVER (PARTITION BY qid) > 0 AS has FROM fu),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN has THEN round(rrf, 12) END DESC, round(score, 12) DESC, d_rank NULLS LAST, s_rank, doc) - 1 AS rank FROM fs)"""


def fused(spark, d):
    qs = questions(spark, d).select("qid").unionByName(vector_questions(spark, d).select("qid")).distinct().withColumn("tagged", F.lit(False))
    return fusion.fuse(dense(spark, d, 2 * K), sparse(spark, d, 2 * K), qs, K)


@query("hybrid_rrf", f"WITH {BM25_SQL}, {DENSE_SQL}, {_FUSED} SELECT qid, doc, round(rrf, 6) AS rrf, rank FROM fr WHERE NOT has OR rank < {3 * K}")
def hybrid_rrf(spark, d):
    return fused(spark, d).select("qid", "doc", F.round("rrf", 6).alias("rrf"), F.col("rank").cast("long").alias("rank"))


@query("hybrid_unified", f"WITH {BM25_SQL}, {DENSE_SQL}, {_FUSED} SELECT qid, doc, round(score, 6) AS score FROM fr WHERE NOT has OR rank < {3 * K}")
def hybrid_unified(spark, d):
    return fused(spark, d).select("qid", "doc", F.round("score", 6).alias("score"))


@query("dense_only_fallback", f"WITH {DENSE_SQL} SELECT qid, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, rank) - 1 AS rank FROM dr WHERE rank < {2 * K}")
def dense_only_fallback(spark, d):
    qs = vector_questions(spark, d).select("qid").withColumn("tagged", F.lit(False))
    none = dense(spark, d, 1).where("false")
    return fusion.fuse(dense(spark, d, 2 * K), none, qs, K).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("postfilter_rank_gaps", f"WITH {BM25_SQL} SELECT qid, doc, rank FROM sr JOIN documents ON doc = doc_id WHERE rank < {2 * K} AND lang = 'en'")
def postfilter_rank_gaps(spark, d):
    kept = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    return sparse(spark, d, 2 * K).join(kept, "doc", "left_semi").select("qid", "doc", F.col("rank").cast("long").alias("rank"))


@query(
    "page_diversity",
    f"""WITH {BM25_SQL}, {DENSE_SQL}, {_FUSED}, h AS (SELECT fr.*, source AS filename, doc % 5 AS page FROM fr JOIN documents ON doc = doc_id WHERE (NOT has OR rank < {3 * K}) AND round(score, 9) >= 0.38),
    g AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY qid, filename, page ORDER BY rank, doc) <= 2)
    SELECT qid, doc, place FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY rank, doc) AS place FROM g) WHERE place <= {K}""",
)
def page_diversity(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("filename"), (F.col("doc_id") % 5).alias("page_number"))
    hits = fused(spark, d).withColumn("score", F.round("score", 9)).join(docs, "doc")
    return fusion.diversify(hits, K).select("qid", "doc", F.col("place").cast("long").alias("place"))


_AUTH = {0: "safety_audit_2024.pdf", 1: "sop_start.docx", 2: "unit_pid_7.dwg", 3: "blank_form.xlsx", 4: "notes.txt"}
_AUTH_SPARK = "element_at(array(" + ", ".join(f"'{v}'" for v in _AUTH.values()) + "), cast(doc_id % 5 + 1 as int))"
_REV = "element_at(array('Superseded', 'Draft', 'Rev 2', 'Active'), cast(doc_id % 4 + 1 as int))"


@query(
    "authority_score",
    """WITH t AS (SELECT doc_id, ['safety_audit_2024.pdf', 'sop_start.docx', 'unit_pid_7.dwg', 'blank_form.xlsx', 'notes.txt'][doc_id % 5 + 1] AS f,
    ['Superseded', 'Draft', 'Rev 2', 'Active'][doc_id % 4 + 1] AS r, lower(text) AS q FROM documents)
    SELECT doc_id, round(CASE WHEN f LIKE '%audit%' THEN CASE WHEN regexp_matches(q, 'audit|report|incident|accident|mah|inspection|safety') THEN 1.65 ELSE 1.35 END
    WHEN f LIKE '%sop%' THEN 1.25 WHEN f LIKE '%pid%' THEN 1.15 WHEN f LIKE '%blank%' THEN 0.65 ELSE 1.0 END
    * CASE r WHEN 'Superseded' THEN 0.4 WHEN 'Draft' THEN 0.75 WHEN 'Rev 2' THEN 1.05 ELSE 1 END, 4)::DOUBLE AS authority FROM t""",
)
def authority_score(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", authority(F.expr(_AUTH_SPARK), F.lit(""), F.col("text"), F.expr(_REV)).cast("double").alias("authority"))


_TOP = f"WITH {BM25_SQL}, t AS (SELECT sr.qid, doc, rank, score, text FROM sr JOIN documents ON doc = doc_id WHERE rank < {K})"
_Q = f"q2 AS (SELECT doc_id AS qid, array_to_string(list_slice(w, 2, 6), ' ') AS question FROM d WHERE doc_id % 100 = 0)"


def top_hits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", "source", "lang")
    return L.with_documents(sparse(spark, d, K).join(questions(spark, d).withColumnRenamed("text", "question"), "qid"), docs)


@query(
    "rerank_lexical",
    f"""{_TOP}, {_Q}, s AS (SELECT qid, doc, rank, round(round(score, 6) + 0.05 * len(list_filter(list_distinct(string_split(question, ' ')), lambda x: x <> '' AND contains(lower(text), x))), 4) AS rerank_score
    FROM t JOIN q2 USING (qid)) SELECT qid, doc, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank, doc) - 1 AS rank FROM s""",
)
def rerank_lexical(spark, d):
    score = rerank.lexical_score(F.col("question"), F.col("text"), F.lit(None).cast("array<string>"), F.round("score", 6))
    return rerank.rerank(top_hits(spark, d), score, K).select("qid", "doc", "rerank_score", F.col("rank").cast("long").alias("rank"))


@query(
    "rerank_mock",
    f"""{_TOP}, {_Q} SELECT qid, doc, round(1 - 0.05 * rank + CASE WHEN len(list_filter(string_split(question, ' '), lambda x: x <> '' AND contains(lower(text), x))) > 0 THEN 1 ELSE 0 END, 4)::DOUBLE AS rerank_score
    FROM t JOIN q2 USING (qid)""",
)
def rerank_mock(spark, d):
    hits = top_hits(spark, d)
    return hits.select("qid", "doc", rerank.mock_score(F.col("question"), F.col("text"), F.col("rank")).cast("double").alias("rerank_score"))


_EVAL = f"""{_TOP}, e AS (SELECT qid, min(CASE WHEN quality = 1 THEN rank + 1 END) AS first, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS p, count(*) AS chunks
    FROM t LEFT JOIN labels ON doc = doc_id GROUP BY qid),
r AS (SELECT doc_id AS qid, first IS NOT NULL AS hit, round(coalesce(1 / first, 0), 4) AS rr, round(coalesce(p, 0), 4) AS p FROM documents LEFT JOIN e ON doc_id = e.qid WHERE doc_id % 100 = 0)"""


@query(
    "eval_metrics",
    f"""{_EVAL} SELECT count(*) AS questions, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 4)::DOUBLE AS hit_rate,
    round(avg(rr), 4)::DOUBLE AS mrr, round(avg(p), 4)::DOUBLE AS mean_precision,
    CASE WHEN avg(hit::INT) >= 0.8 THEN 'excellent' WHEN avg(hit::INT) >= 0.6 THEN 'good' WHEN avg(hit::INT) >= 0.4 THEN 'fair' ELSE 'poor' END AS rating FROM r""",
)
def eval_metrics(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("doc"), "quality")
    hits = sparse(spark, d, K).join(labels, "doc", "left").select("qid", (F.col("rank") + 1).alias("place"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("relevant"))
    return evaluate.totals(evaluate.per_question(hits, questions(spark, d)))


@query("confidence_class", f"WITH {DENSE_SQL} SELECT qid, CASE WHEN max(score) >= 0.75 THEN 'HIGH' WHEN max(score) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM dense WHERE doc <> qid GROUP BY qid")
def confidence_class(spark, d):
    hits = dense(spark, d, 2).where("doc <> qid")
    return hits.groupBy("qid").agg(F.max("score").alias("s")).select("qid", E.confidence(F.col("s")).alias("confidence"))


@query(
    "context_sources",
    f"""{_TOP}, s AS (SELECT qid, string_agg(source, ',' ORDER BY rank) AS sources, count(*) AS n, max(CASE WHEN rank = 0 THEN score END) AS top FROM t JOIN documents ON doc = doc_id GROUP BY qid)
    SELECT doc_id AS qid, s.qid IS NOT NULL AS found, coalesce(n, 0) AS n, sources, CASE WHEN top >= 0.75 THEN 'HIGH' WHEN top >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
    FROM documents LEFT JOIN s ON s.qid = doc_id WHERE doc_id % 100 = 0""",
)
def context_sources(spark, d):
    hits = top_hits(spark, d).select(
        "qid", "doc", (F.col("rank") + 1).alias("place"), F.col("source").alias("filename"), (F.col("doc") % 5).alias("page_number"), F.round("score", 4).alias("score"), "text", F.lit("").alias("parent_text"), F.lit("").alias("parent_id")
    )
    out = E.contract(questions(spark, d), hits, K)
    return out.select("qid", "found", F.col("stats.final").cast("long").alias("n"), F.when(F.col("found"), F.array_join(F.transform("sources", lambda s: s["filename"]), ",")).alias("sources"), "confidence")
