"""Registry, graph, memory, audit, hand-off and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.vectors import document_id
from millrace.operators import graph, memory, registry
from millrace.plans.register import query, table
from millrace.sources import readers


def snapshots(spark, d):
    """Orders as a registry: odd keys are known, those divisible by 3 changed since, those divisible by 7 are gone."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("'/in/' || o_orderkey").alias("path"), F.col("o_orderstatus").alias("s"))
    known = o.where("k % 2 = 1").select("path", document_id("path").alias("document_id"), F.col("s").alias("file_hash"))
    current = o.where("k % 7 <> 0").select("path", document_id("path").alias("document_id"), F.expr("if(k % 3 = 0, s || '2', s)").alias("file_hash"))
    return current, known


_CHANGES = """WITH o AS (SELECT o_orderkey AS k, '/in/' || CAST(o_orderkey AS VARCHAR) AS path FROM orders),
c AS (SELECT path, CASE WHEN k % 7 = 0 THEN 'deleted' WHEN k % 2 = 0 THEN 'indexed' WHEN k % 3 = 0 THEN 'updated' ELSE 'skipped' END AS change FROM o WHERE k % 7 <> 0 OR k % 2 = 1)"""


@query("registry_sync", f"{_CHANGES} SELECT path, change FROM c")
def registry_sync(spark, d):
    return registry.compare(*snapshots(spark, d)).select("path", "change")


@query(
    "sync_summary",
    f"""{_CHANGES} SELECT count(*) AS total, count(*) FILTER (WHERE change = 'indexed') AS indexed, count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'skipped') AS skipped,
    count(*) FILTER (WHERE change = 'deleted') AS deleted, 0::BIGINT AS empty, 0::BIGINT AS failed, 0::BIGINT AS ocr_failed FROM c""",
)
def sync_summary(spark, d):
    return registry.summary(registry.compare(*snapshots(spark, d)))


@query("deleted_docs", f"{_CHANGES} SELECT path FROM c WHERE change = 'deleted'")
def deleted_docs(spark, d):
    current, known = snapshots(spark, d)
    return known.join(current, "path", "left_anti").select("path")


@query("registry_merge", "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status, o_orderpriority AS kind FROM orders")
def registry_merge(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"))
    rows = o.where("path % 3 = 0").select("path", F.lit("new").alias("status"), F.lit(None).cast("string").alias("kind"))
    return registry.merge(o, rows)


@query("replace_documents", "SELECT doc_id AS document_id, CASE WHEN doc_id % 4 = 1 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 4 <> 2")
def replace_documents(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    new = old.where("document_id % 4 = 1").select("document_id", F.lit("new").alias("lang"))
    return registry.replace_documents(old, new, old.where("document_id % 4 = 2"))


def edges(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    up = n.select(F.col("n_name").alias("src"), F.lit("lies in").alias("relation"), F.col("r_name").alias("dst"), F.lit("nation").alias("source"), F.col("n_nationkey").cast("long").alias("seq"))
    customers = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.lit("of").alias("relation"), F.col("c_nationkey"), F.col("c_custkey").cast("long").alias("seq"))
    down = customers.join(n.select("n_nationkey", F.col("n_name").alias("dst")), F.col("c_nationkey") == F.col("n_nationkey")).select("src", "relation", "dst", F.lit("customer").alias("source"), "seq")
    return graph.edges_of(up.unionByName(down))


_EDGES = """e AS (SELECT DISTINCT upper(n_name) AS src, upper(r_name) AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT upper('c' || CAST(c_custkey AS VARCHAR)), upper(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "graph_bfs",
    f"""WITH RECURSIVE {_EDGES}, s AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS seed FROM customer WHERE c_custkey % 100 = 0),
    b AS (SELECT seed, seed AS node, 0 AS hop FROM s UNION SELECT seed, dst, hop + 1 FROM b JOIN e ON node = src WHERE hop < 2) SELECT seed, node, min(hop) AS hop FROM b GROUP BY ALL""",
)
def graph_bfs(spark, d):
    seeds = table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("seed"))
    return graph.bfs(edges(spark, d), seeds, 2).select("seed", "node", "hop")


@query("graph_context", f"WITH {_EDGES} SELECT upper(n_name) AS seed, src || ' --[' || CASE WHEN dst = upper(n_name) THEN 'of' ELSE 'lies in' END || ']--> ' || dst AS line FROM nation JOIN e ON dst = upper(n_name) OR src = upper(n_name)")
def graph_context(spark, d):
    seeds = table(spark, d, "nation").select(F.upper("n_name").alias("seed"))
    return graph.context(edges(spark, d), seeds, 1)


@query("memory_last6", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def memory_last6(spark, d):
    return memory.last_turns(table(spark, d, "conversations"), 6).select("conv_id", "turn", "role")


@query("memory_summary", "SELECT conv_id, string_agg(role || ': ' || left(coalesce(text, ''), 600), chr(10) ORDER BY turn) AS summary FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id")
def memory_summary(spark, d):
    return memory.summary(table(spark, d, "conversations"))


def audit(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("host", F.expr("element_at(array('localhost', '10.1.2.3', 'example.org', '192.168.0.9', '172.16.0.1'), cast(event_id % 5 + 1 as int))")).withColumn("is_local", memory.is_local(F.col("host")))


@query("airgap_summary", "SELECT count(*) AS events, count(*) FILTER (WHERE event_id % 5 IN (0, 1, 3)) AS local_events, count(*) FILTER (WHERE event_id % 5 NOT IN (0, 1, 3)) AS external_events, count(*) FILTER (WHERE event_id % 5 NOT IN (0, 1, 3)) = 0 AS compliant FROM events")
def airgap_summary(spark, d):
    return memory.audit_totals(audit(spark, d))


@query("airgap_last10", "SELECT event_id, event_id % 5 IN (0, 1, 3) AS is_local FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def airgap_last10(spark, d):
    return memory.audit_last(audit(spark, d).withColumnRenamed("ts", "timestamp")).select("event_id", "is_local")


@query(
    "manifest_join",
    """WITH m AS (SELECT doc_id, 'd' || CAST(doc_id // 2 AS VARCHAR) || '.dwg' AS filename, lang, source FROM documents WHERE doc_id % 3 <> 0), f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY filename ORDER BY doc_id) = 1)
    SELECT d.doc_id, md5(coalesce(text, '') || CASE WHEN d.doc_id % 4 <> 0 THEN chr(10) || 'Processing: ' || coalesce(f.lang, 'render_to_image_then_vision_ocr') || chr(10) || 'Retrieval: ' || coalesce(f.source, 'multimodal') ELSE '' END) AS text
    FROM documents d LEFT JOIN f ON f.filename = 'd' || CAST(d.doc_id AS VARCHAR) || '.dwg'""",
)
def manifest_join(spark, d):
    """Drawings with what the first row of their name in a manifest says; other records stay."""
    docs = table(spark, d, "documents")
    manifest = docs.where("doc_id % 3 <> 0").select(F.expr("'d' || (doc_id div 2) || '.dwg'").alias("filename"), F.col("lang").alias("recommended_processing"), F.col("source").alias("retrieval_mode"), "doc_id")
    records = docs.select("doc_id", F.expr("'d' || doc_id || '.dwg'").alias("filename"), F.coalesce("text", F.lit("")).alias("text"), F.expr("if(doc_id % 4 <> 0, 'cad_drawing', 'document')").alias("content_type"))
    return readers.with_manifest(records, readers.first_rows(manifest, "doc_id")).select("doc_id", F.md5("text").alias("text"))
