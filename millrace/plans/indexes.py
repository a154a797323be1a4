"""Indexes that change in steps: segments, versions, codes of vectors, automata, logs; each held against a full build."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from millrace.functions.tags import extract_tags
from millrace.operators import phrases, quantized, sketches, sync
from millrace.operators.audit import AuditLog
from millrace.operators.providers import MockEmbedder
from millrace.operators.segments import Index
from millrace.plans.register import AUGMENTED_SQL, BM25_SQL, DENSE_SQL, TOKENS_SQL, augmented, query, table
from millrace.plans.retrieval import K, questions, vector_questions
from millrace.shared import shared_folder

#: Documents in three changes: two thirds, then the others with new texts for every tenth, then every seventh goes.
_NEW = "coalesce(text, '') || ' replaced by ' || CAST(doc_id AS {s})"
_FINAL = f"""fin AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN {_NEW.format(s='VARCHAR')} ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"""


def _documents(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("doc"), "doc_id", "text")


def changed(spark, d) -> Index:
    index, docs = Index(spark, shared_folder(spark, "segments")), _documents(spark, d)
    index.change(docs.where("doc_id % 3 <> 2"))
    index.change(docs.where("doc_id % 3 = 2 OR doc_id % 10 = 1").withColumn("text", F.expr(f"if(doc_id % 10 = 1, {_NEW.format(s='string')}, text)")))
    index.change(None, docs.where("doc_id % 7 = 3"))
    return index


_CHANGED_BM25 = BM25_SQL.replace("FROM documents)", "FROM fin)", 1).replace("q AS (SELECT qid, term, count(*) AS times FROM (SELECT doc_id AS qid, unnest(list_slice(w, 2, 6)) AS term FROM d", f"q AS (SELECT qid, term, count(*) AS times FROM (SELECT doc_id AS qid, unnest(list_slice({TOKENS_SQL}, 2, 6)) AS term FROM documents")


@query("segment_topk", f"WITH {_FINAL}, {_CHANGED_BM25} SELECT qid, doc, round(score, 6) AS score, rank FROM sr WHERE rank < {K}")
def segment_topk(spark, d):
    """The best documents by segments, blocks and tombstones, after three changes."""
    found = changed(spark, d).view().search(questions(spark, d), K)
    return found.select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("segment_chunks", f"WITH {_FINAL} SELECT doc_id, md5(coalesce(text, '')) AS text FROM fin")
def segment_chunks(spark, d):
    return changed(spark, d).view().chunks().select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@query("segment_two_writers", "SELECT doc_id, 2::BIGINT AS version FROM documents")
def segment_two_writers(spark, d):
    """Two writers at once, of different documents: both changes are in the index, in one version each."""
    path, docs = shared_folder(spark, "two-writers"), _documents(spark, d)
    with ThreadPoolExecutor(2) as both:
        list(both.map(lambda k: Index(spark, path).change(docs.where(F.pmod("doc_id", F.lit(2)) == k)), (0, 1)))
    view = Index(spark, path).view()
    return view.chunks().select("doc_id", F.lit(view.version).cast("long").alias("version"))


@query("quantized_topk", f"WITH {DENSE_SQL} SELECT qid, doc, round(score, 6) AS score, rank FROM dr WHERE rank < {K}")
def quantized_topk(spark, d):
    """The nearest vectors by 8-bit codes and their bounds, which leave none out."""
    found = quantized.search(quantized.build(table(spark, d, "embeddings")), vector_questions(spark, d), K)
    return found.select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FOLDED = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "phrases_in_texts",
    f"""WITH a AS ({AUGMENTED_SQL}), w AS (SELECT list_slice(regexp_extract_all({_FOLDED.format(c='text')}, '[a-z]+'), 1, 2) AS w FROM benchmark),
    p AS (SELECT DISTINCT 'PT-' || CAST(100 + doc_id % 400 AS VARCHAR) AS phrase FROM documents UNION SELECT DISTINCT 'XV-' || CAST(10 + doc_id % 7 AS VARCHAR) FROM documents UNION SELECT DISTINCT w[1] || ' ' || w[2] FROM w WHERE len(w) = 2)
    SELECT doc_id, phrase, CAST(strpos({_FOLDED.format(c='text')}, {_FOLDED.format(c='phrase')}) - 1 AS BIGINT) AS first FROM a JOIN p ON contains({_FOLDED.format(c='text')}, {_FOLDED.format(c='phrase')})""",
)
def phrases_in_texts(spark, d):
    """All tags of the documents, and what the benchmark's items begin with, in all texts: one pass."""
    docs = augmented(table(spark, d, "documents"))
    tags = docs.select(F.explode(extract_tags(F.regexp_extract("text", r"Inspect (PT-\d+ and XV-\d+) at [^@]*$", 1))).alias("phrase"))
    words = F.slice(F.regexp_extract_all(F.expr(_FOLDED.format(c="text")), F.lit("[a-z]+"), F.lit(0)), 1, 2)
    begun = table(spark, d, "benchmark").select(words.alias("w")).where("size(w) = 2").select(F.array_join("w", " ").alias("phrase"))
    return phrases.find_phrases(docs, tags.unionByName(begun)).select(F.col("doc").alias("doc_id"), "phrase", "first")


@query("audit_counters", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, count(*) FILTER (WHERE event_id % 3 = 0) AS local_events, count(*) FILTER (WHERE event_id % 3 <> 0) AS external_events FROM events GROUP BY ALL")
def audit_counters(spark, d):
    """Running totals of a log that a stream reads in two goes; events that are written twice count once."""
    folder = shared_folder(spark, "audit-log")
    log, e = AuditLog(spark, f"{folder}/log"), table(spark, d, "events")
    rows = e.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("events").alias("component"), F.col("event_type").alias("operation"), F.lit("").alias("target"),
        F.lit("ok").alias("status"), (F.col("event_id") % 3 == 0).alias("is_local"), F.col("user_id").cast("string").alias("details"), "event_id",
    )
    for part in ("event_id % 2 = 0", "event_id % 2 = 1 OR event_id % 5 = 0"):
        log.append(rows.where(part))
        log.count(f"{folder}/totals", f"{folder}/state").awaitTermination()
    return AuditLog(spark, f"{folder}/log").totals(f"{folder}/totals").withColumn("day", F.col("day").cast("string"))


@query("stream_sync", r"SELECT CAST(item_id AS VARCHAR) AS name, sha256(text || chr(10)) AS file_hash, 'indexed' AS status FROM benchmark WHERE regexp_matches(text, '\S') AND item_id % 5 <> 0")
def stream_sync(spark, d):
    """The registry after a stream of files in two goes; files that went between them are gone, a repeated batch adds nothing."""
    folder = shared_folder(spark, "stream-sync")
    texts = table(spark, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("value"))
    for part in ("item_id % 5 = 0", "item_id % 5 <> 0"):
        texts.where(part).repartition(8, "item_id").write.mode("overwrite").partitionBy("item_id").text(f"{folder}/in")
        sync.follow(spark, f"{folder}/in", f"{folder}/index", f"{folder}/state", MockEmbedder(8)).awaitTermination()
    view = Index(spark, f"{folder}/index").view()
    return sync.registry_of(view).select(F.regexp_extract("path", r"item_id=(\d+)", 1).alias("name"), "file_hash", "status")


@query("term_sketches", f"WITH w AS (SELECT lang, unnest({TOKENS_SQL}) AS term FROM documents) SELECT lang, count(DISTINCT term) AS terms, true AS within FROM w GROUP BY lang UNION ALL SELECT 'all', count(DISTINCT term), true FROM w")
def term_sketches(spark, d):
    """Different terms of each language and of all, from sketches of parts that are merged: within the stated error."""
    from millrace.functions.text import tokens

    words = table(spark, d, "documents").select("doc_id", "lang", F.explode(tokens("text")).alias("term"))
    kept = sketches.of_parts(words.withColumn("part", F.pmod("doc_id", F.lit(8))), ["part", "lang"], "term")
    told = sketches.merged(kept, ["lang"]).unionByName(sketches.merged(kept, []).withColumn("lang", F.lit("all")))
    exact = words.groupBy("lang").agg(F.count_distinct("term").alias("terms")).unionByName(words.agg(F.count_distinct("term").alias("terms")).withColumn("lang", F.lit("all")))
    return exact.join(told, "lang").select("lang", "terms", (F.abs(F.col("distinct") - F.col("terms")) <= sketches.ERROR * F.col("terms") + 1).alias("within"))
