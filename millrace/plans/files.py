"""Readers over files that are made of the documents, saved indexes and questions, streams that run to their end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions.text import json_reply, without_fence
from millrace.operators import agent, evaluate, lexical, recognition, rerank, sync
from millrace.operators import evidence as E
from millrace.plans.register import TOKENS_SQL, query, table
from millrace.plans.textual import SumEngine
from millrace.shared import shared_folder
from millrace.sources import readers, sinks
from millrace.streaming import streams

#: Files that are made at once.
FILES = 256
#: The words of each text that go into its file: its ASCII letters and digits, as words of one space between.
_WORDS = "array_join(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+', 0), ' ')"
_WORDS_SQL = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))"


def _pdf(lines: list[str]) -> bytes:
    content = ("BT /F1 9 Tf 20 800 Td 10 TL " + " T* ".join(f"({t}) Tj" for t in lines) + " ET").encode()
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [4 0 R] /Count 1 >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content), b"<< /Type /Page /Parent 2 0 R /Contents 3 0 R >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))


def made(kind: str, doc_id: int, words: str) -> bytes:
    """A file of a kind with a document's words: a heading and a body, or a header and a row."""
    if kind == "docx":
        return sinks.word(f"T{doc_id}", words)
    if kind == "xlsx":
        return sinks.excel([{"tag": f"PT-{doc_id}", "note": words or None}], f"S{doc_id % 3}")
    if kind == "pptx":
        return sinks.slides([{"title": f"T{doc_id}", "content": words}, {"title": "End", "content": ""}])
    if kind == "pdf":
        return _pdf([f"T{doc_id}", words])
    if kind == "dwg":
        return b"\0\1\2AC1027\0" + f"PT-{100 + doc_id % 50}\0{words}".encode()
    if kind == "html":
        return f"<html><script>x()</script><p>T{doc_id} &amp; {words}</p></html>".encode()
    return words.encode()


_NAMES = {"docx": "d{id}.docx", "xlsx": "d{id}.xlsx", "pptx": "d{id}.pptx", "pdf": "d{id}.pdf", "dwg": "Unit - A{code}-7 d{id}.dwg", "html": "d{id}.html", "txt": "d{id}.txt"}


def read(spark, d, kind: str):
    """Records of a file of this kind for each document."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(_WORDS).alias("w"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FILES):
                ids, words = (b.column(c).slice(at, FILES).to_pylist() for c in ("doc_id", "w"))
                names = [f"/data/PID/{_NAMES[kind].format(id=i, code=10000 + i % 1000)}" for i in ids]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([made(kind, i, w) for i, w in zip(ids, words, strict=True)], pa.binary())], ["path", "content"])

    records, errors = sync.parse(docs.mapInArrow(files, "path string, content binary"), readers.READERS | {"pdf": recognition.pdf_reader()})
    return records.withColumn("doc_id", F.regexp_extract("filename", r"d(\d+)\.", 1).cast("long")), errors


def _read(kind: str, sql: str):
    @query(f"read_{kind}", f"WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents) {sql}")
    def run(spark, d):
        records, _ = read(spark, d, kind)
        return records.select("doc_id", F.col("rec_idx").cast("long").alias("rec_idx"), "location", "content_type", F.md5("text").alias("text"))

    return run


_OUT = "SELECT doc_id, 0::BIGINT AS rec_idx, '{l}' AS location, 'document' AS content_type, md5({t}) AS text FROM d {w}"
_read("docx", _OUT.format(l="Document", t="'T' || CAST(doc_id AS VARCHAR) || CASE WHEN w <> '' THEN chr(10) || chr(10) || w ELSE '' END", w=""))
_read("txt", _OUT.format(l="Document", t="w", w="WHERE w <> ''"))
_read("html", _OUT.format(l="Document", t="trim('T' || CAST(doc_id AS VARCHAR) || ' & ' || w)", w=""))
_read("pdf", _OUT.format(l="Page 1", t="'T' || CAST(doc_id AS VARCHAR) || CASE WHEN w <> '' THEN chr(10) || w ELSE '' END", w=""))
_read("pptx", """SELECT doc_id, k::BIGINT AS rec_idx, 'Slide ' || CAST(k + 1 AS VARCHAR) AS location, 'document' AS content_type, md5(CASE k WHEN 0 THEN 'T' || CAST(doc_id AS VARCHAR) || CASE WHEN w <> '' THEN chr(10) || w ELSE '' END ELSE 'End' END) AS text FROM d, (VALUES (0), (1)) v(k)""")
_read(
    "xlsx",
    """SELECT doc_id, k::BIGINT AS rec_idx, 'Sheet S' || CAST(doc_id % 3 AS VARCHAR) || ', Row ' || CAST(k + 1 AS VARCHAR) AS location, 'document' AS content_type, md5('[Dataset: d' || CAST(doc_id AS VARCHAR) || '.xlsx | Sheet: S' || CAST(doc_id % 3 AS VARCHAR)
    || CASE k WHEN 0 THEN ' | Schema Headers]' || chr(10) || 'tag | note' ELSE ' | Row 2]' || chr(10) || CASE WHEN w <> '' THEN 'tag: PT-' || CAST(doc_id AS VARCHAR) || ' | note: ' || w ELSE 'PT-' || CAST(doc_id AS VARCHAR) END END) AS text FROM d, (VALUES (0), (1)) v(k)""",
)
_read(
    "dwg",
    """SELECT doc_id, 0::BIGINT AS rec_idx, 'CAD Drawing A' || CAST(10000 + doc_id % 1000 AS VARCHAR) || '-7' AS location, 'cad_drawing' AS content_type, md5('Drawing: Unit - A' || CAST(10000 + doc_id % 1000 AS VARCHAR) || '-7 d' || CAST(doc_id AS VARCHAR) || '.dwg' || chr(10) || 'Code: A' || CAST(10000 + doc_id % 1000 AS VARCHAR)
    || '-7' || chr(10) || 'Discipline: Piping and instrumentation' || chr(10) || 'Title: A' || CAST(10000 + doc_id % 1000 AS VARCHAR) || '-7 d' || CAST(doc_id AS VARCHAR) || chr(10) || 'Tags: PT-' || CAST(100 + doc_id % 50 AS VARCHAR)) AS text FROM d""",
)


@query("read_errors", "SELECT doc_id, doc_id % 3 = 0 AS failed FROM documents")
def read_errors(spark, d):
    """Broken office files beside good ones: each has its error, and the others are read."""
    files = table(spark, d, "documents").select(F.expr("'/in/d' || doc_id || if(doc_id % 3 = 0, '.docx', '.txt')").alias("path"), F.expr("cast('text ' || doc_id as binary)").alias("content"))
    records, errors = sync.parse(files)
    rows = records.select(F.col("source").alias("path"), F.lit(False).alias("failed")).unionByName(errors.select("path", F.lit(True).alias("failed")))
    return rows.select(F.regexp_extract("path", r"d(\d+)", 1).cast("long").alias("doc_id"), "failed")


@query("read_images", "WITH b AS (SELECT doc_id, list_sum(list_transform(range(0, 32), lambda i: CAST('0x' || substr(sha256(coalesce(text, '')), 2 * i + 1, 2) AS INTEGER)))::BIGINT AS s FROM documents) SELECT doc_id, true AS ocr_used, 'image' AS content_type FROM b")
def read_images(spark, d):
    """A PNG file for each document, read by a recognition engine."""
    from millrace.functions import images

    docs = table(spark, d, "documents").select("doc_id", F.expr("unhex(sha2(coalesce(text, ''), 256))").alias("p"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for at in range(0, b.num_rows, FILES):
                ids, pixels = (b.column(c).slice(at, FILES).to_pylist() for c in ("doc_id", "p"))
                pictures = [images.write_png(np.frombuffer(p, np.uint8).reshape(4, 8)) for p in pixels]
                yield pa.RecordBatch.from_arrays([pa.array([f"/p/d{i}.png" for i in ids], pa.string()), pa.array(pictures, pa.binary())], ["path", "content"])

    records, _ = sync.parse(docs.mapInArrow(files, "path string, content binary"), {"png": recognition.image_reader(SumEngine)})
    return records.select(F.regexp_extract("filename", r"d(\d+)", 1).cast("long").alias("doc_id"), "ocr_used", "content_type")


_BM25 = f"""d AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents)"""


@query("bm25_saved", f"WITH {_BM25}, p AS (SELECT doc_id AS doc, unnest(w) AS term FROM d) SELECT doc, term, count(*) AS tf, any_value(len(w))::INTEGER AS doc_len FROM p JOIN d ON d.doc_id = p.doc GROUP BY doc, term")
def bm25_saved(spark, d):
    """The postings of an index that was saved and loaded."""
    folder = shared_folder(spark, "bm25")
    lexical.build_index(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").save(folder)
    return lexical.Index.load(spark, folder).postings.select("doc", "term", F.col("tf").cast("long").alias("tf"), "doc_len")


@query("questions_saved", "SELECT 'Question ' || CAST(item_id AS VARCHAR) AS question, 'k' || CAST(item_id AS VARCHAR) || ',limit' AS keywords, 'c' AS category FROM benchmark")
def questions_saved(spark, d):
    """Questions that were written as the defaults of a missing file, and read."""
    rows = table(spark, d, "benchmark").select("item_id").collect()  # a stated set of questions
    path = f"{shared_folder(spark, 'questions')}/questions.json"
    asked = readers.read_questions(spark, path, [(f"Question {r['item_id']}", [f"k{r['item_id']}", "limit"], "c") for r in rows])
    return asked.select("question", F.array_join("expected_keywords", ",").alias("keywords"), "category")


@query("keyword_hits", "SELECT doc_id, contains(lower(coalesce(text, '') || ' PT-' || CAST(doc_id % 20 AS VARCHAR)), 'pt-7') OR contains(lower(coalesce(text, '')), 'the') AS hit FROM documents")
def keyword_hits(spark, d):
    docs = table(spark, d, "documents")
    hit = evaluate.holds_keyword(F.coalesce("text", F.lit("")), F.expr("array(concat('PT-', doc_id % 20))"), F.array(F.lit("pt-7"), F.lit("THE")))
    return docs.select("doc_id", hit.alias("hit"))


@query("rerank_tags", "SELECT doc_id, round(0.5 + 0.25 * (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END) + 0.05 * (CASE WHEN contains(lower(text), 'pt-' || CAST(10 + doc_id % 3 AS VARCHAR)) THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END), 4)::DOUBLE AS score FROM documents WHERE text IS NOT NULL")
def rerank_tags(spark, d):
    """Tags in common and words of the question, with a model that fails, so that the words count."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    hits = docs.select("doc_id", F.expr("concat('the PT-', 10 + doc_id % 3)").alias("question"), "text", F.expr("if(doc_id % 4 = 0, array(concat('PT-', 10 + doc_id % 3), 'XV-1'), array('XV-1'))").alias("tags"), F.lit(0.5).alias("score"), F.lit(0).alias("rank"))
    return hits.select("doc_id", rerank.reranker("model", lambda q, t: 1 / 0)(hits).alias("score"))


@query(
    "cited_sections",
    """SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1 AND coalesce(lang, '') <> '' AS whole, md5(CASE WHEN row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1 AND coalesce(lang, '') <> '' THEN 'section ' || lang ELSE 'chunk ' || CAST(doc_id AS VARCHAR) END) AS cited FROM documents""",
)
def cited_sections(spark, d):
    """A section's whole text at its first appearance for a question, its chunks' own texts afterwards."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("source").alias("qid"), F.col("doc_id").alias("place"), F.expr("'chunk ' || doc_id").alias("text"), F.coalesce("lang", F.lit("")).alias("parent_id"), F.expr("' section ' || coalesce(lang, '') || ' '").alias("parent_text"))
    return E.sources(rows).select("doc_id", "source", F.col("whole_section").alias("whole"), F.md5("cited").alias("cited"))


#: Replies of a planner to each turn of a conversation: as many searches for the whole turn as its length says, an answer
#: for turns of users, tools that there aren't for some; fenced, or cut short.
_STEPS = "concat(array_repeat(named_struct('tool', if(length(text) % 13 = 0, 'shell', 'rag_search'), 'params', named_struct('query', coalesce(text, ''))), cast(length(text) % 7 as int)), if(role = 'user', array(named_struct('tool', 'generate_response', 'params', named_struct('query', ''))), array()))"
_REPLY = f"to_json(named_struct('goal', coalesce(text, ''), 'steps', {_STEPS}))"


@query(
    "plans_checked",
    r"""WITH t AS (SELECT conv_id, turn, length(text) AS n, role = 'user' AS answers, regexp_matches(text, '[^\s\x0B\x1C-\x1F\x85]') AS asks FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, n % 11 <> 0 AND n % 7 + answers::INT BETWEEN 1 AND 5 AND (n % 7 = 0 OR n % 13 <> 0 AND asks AND answers) AS valid, n % 11 <> 0 AS parsed FROM t""",
)
def plans_checked(spark, d):
    """Replies of a planner, one a turn: whether they parse, and whether the plan may run."""

    @F.pandas_udf("boolean")
    def valid(replies: pd.Series) -> pd.Series:
        return pd.Series([agent.valid_plan(agent.parse_reply(r)) for r in replies])

    told = F.expr(f"CASE WHEN length(text) % 11 = 0 THEN substring(r, 1, length(r) - 3) WHEN length(text) % 2 = 1 THEN concat('Sure: ```json ', r, ' ```') ELSE r END")
    rows = table(spark, d, "conversations").where("text IS NOT NULL").withColumn("r", F.expr(_REPLY)).select("conv_id", "turn", told.alias("r"))
    return rows.select("conv_id", "turn", valid("r").alias("valid"), json_reply("r").isNotNull().alias("parsed"))


@query("code_checked", "SELECT doc_id, lang NOT IN ('de', 'fr') OR length(text) % 3 <> 0 AS allowed FROM documents WHERE text IS NOT NULL")
def code_checked(spark, d):
    """Pieces of code over whole texts, one a document, against the deny-list: fenced ones, and some that import or call
    what isn't allowed."""

    @F.pandas_udf("boolean")
    def allowed(code: pd.Series) -> pd.Series:
        return pd.Series([not agent.violations(c) for c in code])

    bad = "CASE WHEN length(text) % 3 <> 0 THEN 'print(len(t))' WHEN lang = 'de' THEN 'import socket' WHEN lang = 'fr' THEN 'eval(t)' ELSE 'x = 1' END"
    code = F.expr(f"concat('```python\\nt = ', regexp_extract(to_json(array(text)), '(?s)^.(.*).$', 1), '\\n', {bad}, '\\n```')")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", allowed(without_fence(code)).alias("allowed"))


def _streamed(spark, rows, name: str):
    """Rows as a stream of files, and a folder for what comes of it."""
    folder = shared_folder(spark, name)
    rows.write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder


@query("stream_windows", "WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def stream_windows(spark, d):
    """Windows of a stream that the watermark has closed by its end."""
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    events, folder = _streamed(spark, rows, "stream-windows")
    out = streams.tumbling(events, "at", "event_type")
    out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


#: A time for each turn: conversations begin 7 minutes after each other, turns follow by the minute.
_SAID = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(7 * conv_id + turn as int), 0)"


@query("stream_turns", """WITH t AS (SELECT conv_id, turn, 7 * conv_id + turn AS m FROM conversations), c AS (SELECT conv_id, max(m) + 30 <= (SELECT max(m) FROM t) - 10 AS closed FROM t GROUP BY conv_id)
    SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns, closed FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) JOIN c USING (conv_id) GROUP BY ALL""")
def stream_turns(spark, d):
    """The last six turns of each conversation, kept as the state of a stream, and whether it was idle so long that it went."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"), F.expr(_SAID).alias("at"))
    turns, folder = _streamed(spark, rows, "stream-turns")
    with streams.keeps_state(spark):
        out = streams.recent_turns(turns).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        out.foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/out").groupBy("conv_id").agg(F.max_by("turns", F.array_max("turns")).alias("turns"), F.bool_or("closed").alias("closed"))
    return found.select("conv_id", F.array_join(F.transform("turns", lambda t: t.cast("string")), ",").alias("turns"), "closed")


@query("stream_files", "SELECT '/d' || CAST(item_id AS VARCHAR) AS name, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS bytes FROM benchmark")
def stream_files(spark, d):
    """New files of a folder, as a stream brings them: a text and a line feed each."""
    folder = shared_folder(spark, "stream-files")
    texts = table(spark, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("value"))
    texts.repartition(8, "item_id").write.partitionBy("item_id").text(f"{folder}/in")
    streams.ingest(spark, f"{folder}/in", lambda b, n: b.selectExpr("path", "length(content) as bytes").write.mode("append").parquet(f"{folder}/out"), f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/out").select(F.concat(F.lit("/d"), F.regexp_extract("path", r"item_id=(\d+)", 1)).alias("name"), F.col("bytes").cast("long").alias("bytes"))
    return found.groupBy("name").agg(F.sum("bytes").alias("bytes"))
