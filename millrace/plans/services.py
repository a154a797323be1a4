"""Retrieval with tagged questions, tools over hits, synchronisation, registry lookups, and what is said of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import tags as T
from millrace.functions.text import is_insufficient
from millrace.functions.vectors import document_id
from millrace.operators import evaluate, fusion, graph, ontology, registry, sync
from millrace.operators import evidence as E
from millrace.operators import lexical as L
from millrace.plans.register import AUGMENTED_SQL, COSINE_SQL, TOKENS_SQL, augmented, query, table
from millrace.shared import shared_folder
from millrace.sources import sinks
from millrace.streaming import streams

K = 5
#: A file name, a revision and a page for each document, and a question for each whose id is a multiple of 50: every other
#: one names a tag.
_NAME = "element_at(array('safety_audit_2024.pdf', 'sop_start.docx', 'unit_pid_7.dwg', 'blank_form.xlsx', 'notes.txt'), cast(doc_id % 5 + 1 as int))"
_REV = "element_at(array('Superseded', 'Draft', 'Rev 2', 'Active'), cast(doc_id % 4 + 1 as int))"
_ASKED = "if(doc_id % 100 = 0, concat('inspection of PT-', 100 + doc_id % 400), array_join(slice({w}, 2, 4), ' '))"


def documents(spark, d):
    docs = augmented(table(spark, d, "documents")).where("text IS NOT NULL")
    return docs.select(F.col("doc_id").alias("doc"), "text", "lang", F.expr(_NAME).alias("filename"), F.lit("").alias("location"), F.expr(_REV).alias("revision"), (F.col("doc_id") % 3).alias("page_number"))


def asked(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 50 = 0 AND text IS NOT NULL")
    words = r"regexp_extract_all(lower(text), '([a-z0-9]+(?:-[a-z0-9]+)?)', 1)"
    return docs.select(F.col("doc_id").alias("qid"), F.expr(_ASKED.format(w=words)).alias("text"))


def index(spark, d):
    return L.build_index(documents(spark, d), "doc", "text")


#: BM25 and cosine for these questions, by the definitions.
_RANKS = f"""
a AS ({AUGMENTED_SQL} WHERE text IS NOT NULL), d AS (SELECT doc_id, lang, text, {TOKENS_SQL} AS w FROM a),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term),
qs AS (SELECT doc_id AS qid, CASE WHEN doc_id % 100 = 0 THEN 'inspection of PT-' || CAST(100 + doc_id % 400 AS VARCHAR) ELSE array_to_string(list_slice({TOKENS_SQL}, 2, 5), ' ') END AS question FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({TOKENS_SQL.replace('text', 'question')}) AS term FROM qs) GROUP BY ALL),
sp AS (SELECT qid, p.doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.w) / avgdl))) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN d ON d.doc_id = p.doc, st GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) - 1 AS rank FROM sp),
de AS (SELECT qs.qid, v.vec_id AS doc, {COSINE_SQL.format(a='v.embedding', b='e.embedding')} AS score FROM qs JOIN embeddings e ON e.vec_id = qs.qid, embeddings v {{dense}}),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) - 1 AS rank FROM de)"""
_HITS = f"""
c AS (SELECT qid, doc, score AS dense, NULL AS bm25, rank FROM dr WHERE rank < {2 * K} UNION ALL SELECT qid, doc, NULL, score, rank FROM sr {{sparse}} rank < {2 * K}),
tq AS (SELECT qid, question, len(list_filter(regexp_extract_all(upper(question), '\\b([A-Z]{{{{1,5}}}}-\\d{{{{1,5}}}}[A-Z]?|[A-Z]{{{{2,4}}}}\\d{{{{2,4}}}}[A-Z]?)\\b', 1), lambda x: len(x) >= 4)) > 0
    OR regexp_matches(question, '\\b(?:[A-Z0-9]{{{{2,6}}}}-[A-Z0-9]{{{{2,6}}}}|ERR[_-]?[A-Z0-9]+|0x[0-9A-Fa-f]+|E-\\d{{{{2,4}}}})\\b') AS tagged FROM qs),
w AS (SELECT *, CASE WHEN tagged THEN 0.3 ELSE 0.7 END AS dw, CASE WHEN tagged THEN 0.7 ELSE 0.3 END AS bw FROM c JOIN tq USING (qid)),
fu AS (SELECT qid, doc, question, dw, bw, max(dense) AS dense, max(bm25) AS bm25, sum(CASE WHEN dense IS NOT NULL THEN dw ELSE bw END / (40 + rank)) AS rrf,
    min(CASE WHEN dense IS NOT NULL THEN rank END) AS d_rank, min(rank) AS s_rank FROM w GROUP BY ALL),
fs AS (SELECT *, CASE WHEN dense > 0 AND bm25 > 0 THEN dw * dense + bw * least(0.95, bm25 / 12) WHEN dense > 0 THEN dense ELSE least(0.9, coalesce(bm25, 0) / 12) END AS score,
    count(bm25) OVER (PARTITION BY qid) > 0 AS has FROM fu),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN has THEN round(rrf, 12) END DESC, round(score, 12) DESC, d_rank NULLS LAST, s_rank, doc) - 1 AS rank FROM fs),
au AS (SELECT fr.qid, fr.doc, fr.rank, ['safety_audit_2024.pdf', 'sop_start.docx', 'unit_pid_7.dwg', 'blank_form.xlsx', 'notes.txt'][doc % 5 + 1] AS filename, doc % 3 AS page_number,
    round(fr.score * round(CASE doc % 5 WHEN 0 THEN CASE WHEN regexp_matches(lower(question), 'audit|report|incident|accident|mah|inspection|safety') THEN 1.65 ELSE 1.35 END WHEN 1 THEN 1.25 WHEN 2 THEN 1.15 WHEN 3 THEN 0.65 ELSE 1.0 END
    * CASE doc % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.75 WHEN 2 THEN 1.05 ELSE 1 END, 4), 4) AS score FROM fr JOIN d ON d.doc_id = fr.doc WHERE NOT has OR rank < {3 * K}),
pg AS (SELECT * FROM au WHERE score >= 0.38 QUALIFY row_number() OVER (PARTITION BY qid, filename, page_number ORDER BY rank, doc) <= 2),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, doc) AS place FROM pg) WHERE place <= {K})""".replace("{{{{", "{").replace("}}}}", "}")


def retrieved(spark, d, criteria=None):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    questions = asked(spark, d).join(vectors.select(F.col("doc").alias("qid"), F.col("embedding").alias("vector")), "qid", "left")
    docs = documents(spark, d)
    if criteria:
        vectors = vectors.join(docs.select("doc", "lang"), "doc")
    # A question without a vector searches by words alone.
    found = fusion.retrieve(index(spark, d), vectors, docs, questions, K, criteria=criteria)
    return found


@query("retrieve", f"WITH {_RANKS.format(dense='')}, {_HITS.format(sparse='WHERE')} SELECT qid, doc, place, filename, score::DOUBLE AS score FROM h")
def retrieve(spark, d):
    return retrieved(spark, d).select("qid", "doc", F.col("place").cast("long").alias("place"), "filename", F.col("score").cast("double").alias("score"))


@query(
    "retrieve_filtered",
    f"""WITH {_RANKS.format(dense="JOIN d ON d.doc_id = v.vec_id WHERE d.lang = 'en'")}, {_HITS.format(sparse="JOIN d ON d.doc_id = sr.doc WHERE d.lang = 'en' AND")} SELECT qid, doc, place, score::DOUBLE AS score FROM h""",
)
def retrieve_filtered(spark, d):
    return retrieved(spark, d, {"lang": "en"}).select("qid", "doc", F.col("place").cast("long").alias("place"), F.col("score").cast("double").alias("score"))


@query("evidence_answers", f"""WITH {_RANKS.format(dense='')}, {_HITS.format(sparse='WHERE')}, b AS (SELECT h.*, d.text FROM h JOIN d ON d.doc_id = h.doc), o AS (SELECT *, first_value(filename) OVER (PARTITION BY qid ORDER BY place) AS first FROM b),
    g AS (SELECT qid, string_agg(DISTINCT CASE WHEN filename <> first THEN filename END, ', ' ORDER BY CASE WHEN filename <> first THEN filename END) AS others, max(CASE WHEN place = 1 THEN score END) AS top FROM o GROUP BY qid)
    SELECT b.qid, md5('From ' || filename || ', page ' || CAST(page_number AS VARCHAR) || chr(10) || left(regexp_replace(text, '^ +| +$', '', 'g'), 1200) || coalesce(chr(10) || 'Also in: ' || others, '')) AS answer,
    CASE WHEN top >= 0.75 THEN 'HIGH' WHEN top >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM b JOIN g USING (qid) WHERE place = 1""")
def evidence_answers(spark, d):
    return E.evidence_answer(retrieved(spark, d)).select("qid", F.md5("answer").alias("answer"), "confidence")


@query("evidence_blocks", f"""WITH {_RANKS.format(dense='')}, {_HITS.format(sparse='WHERE')} SELECT qid, place, md5('[E' || CAST(place AS VARCHAR) || ']' || chr(10) || 'Document: ' || filename || chr(10) || 'Page: ' || CAST(page_number AS VARCHAR) || chr(10)
    || 'Location: Unknown' || chr(10) || 'Relevance: ' || CAST(score::DECIMAL(9, 4) AS VARCHAR) || chr(10) || regexp_replace(text, '^ +| +$', '', 'g') || chr(10)) AS block FROM h JOIN d ON d.doc_id = h.doc""")
def evidence_blocks(spark, d):
    hits = E.sources(retrieved(spark, d).withColumn("parent_id", F.lit("")).withColumn("parent_text", F.lit(""))).withColumn("score", F.col("score").cast("decimal(9,4)"))
    return hits.select("qid", F.col("place").cast("long").alias("place"), F.md5(E.evidence_block(hits)).alias("block"))


_TAGGED = f"""WITH {_RANKS.format(dense='')}, t AS (SELECT sr.qid, 'PT-' || CAST(100 + sr.qid % 400 AS VARCHAR) AS tag, sr.doc, rank + 1 AS place, text, ['safety_audit_2024.pdf', 'sop_start.docx', 'unit_pid_7.dwg', 'blank_form.xlsx', 'notes.txt'][sr.doc % 5 + 1] AS filename
    FROM sr JOIN d ON d.doc_id = sr.doc WHERE rank < {K} AND sr.qid % 100 = 0),
n AS (SELECT *, contains(upper(text), tag) OR (doc % 2 = 0 AND tag = 'PT-' || CAST(100 + doc % 400 AS VARCHAR)) AS named FROM t)"""


def tag_hits(spark, d):
    """Hits for each tag that is asked for; of every other document the tags are known, of the others the text tells."""
    hits = L.search(index(spark, d), asked(spark, d).where("qid % 100 = 0"), K).join(documents(spark, d), "doc")
    own = F.expr("if(doc % 2 = 0, array(concat('pt-', 100 + doc % 400)), null)")
    return hits.select("qid", F.expr("concat('PT-', 100 + qid % 400)").alias("tag"), "doc", (F.col("rank") + 1).alias("place"), "text", "filename", "page_number", F.lit("general").alias("document_type"), "score", own.alias("tags"))


@query("tag_references", f"{_TAGGED} SELECT qid, tag, doc, place, filename AS document, md5(CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END) AS excerpt FROM n WHERE named")
def tag_references(spark, d):
    return E.references(tag_hits(spark, d)).select("qid", "tag", "doc", F.col("place").cast("long").alias("place"), "document", F.md5("excerpt").alias("excerpt"))


_DOSSIER_SQL = f"""{_TAGGED}, k AS (SELECT DISTINCT tag, CAST(substr(tag, 4) AS BIGINT) % 200 = 100 AS known FROM t),
    s AS (SELECT tag, string_agg(left(text, 250), chr(10) ORDER BY place) AS notes FROM (SELECT * FROM n WHERE named QUALIFY row_number() OVER (PARTITION BY tag ORDER BY place) <= 2) GROUP BY tag),
    fi AS (SELECT tag, list_sort(list(DISTINCT filename)) AS every, list_sort(list(DISTINCT filename) FILTER (WHERE named)) AS found FROM n GROUP BY tag),
    r AS (SELECT k.tag, known, notes, CASE WHEN known THEN list_sort(list_distinct(list_concat(['atlas.pdf'], every))) ELSE coalesce(found, []) END AS documents FROM k LEFT JOIN fi USING (tag) LEFT JOIN s USING (tag))"""


def dossiers(spark, d):
    hits = tag_hits(spark, d)
    asked_tags = asked(spark, d).where("qid % 100 = 0").select(F.expr("concat('PT-', 100 + qid % 400)").alias("tag")).distinct()
    known = asked_tags.where("cast(substr(tag, 4) as bigint) % 200 = 100").select(
        "tag", F.lit("pressure").alias("service"), F.lit("Unit 7").alias("unit"), F.lit("12 bar").alias("trip_limit"), F.expr("array('atlas.pdf')").alias("referenced_documents")
    )
    return E.dossiers(asked_tags, known, hits)


@query("dossier_lookup", f"{_DOSSIER_SQL} SELECT tag, CASE WHEN known THEN 'known' WHEN notes IS NOT NULL THEN 'mined' ELSE 'none' END AS origin, array_to_string(documents, ',') AS documents, coalesce(md5(notes), '') AS notes FROM r")
def dossier_lookup(spark, d):
    return dossiers(spark, d).select("tag", "origin", F.array_join("documents", ",").alias("documents"), F.coalesce(F.md5(F.array_join("notes", "\n")), F.lit("")).alias("notes"))


@query("dossier_box", f"""{_DOSSIER_SQL} SELECT tag, CASE WHEN known OR notes IS NOT NULL THEN md5('ASSET ' || tag || CASE WHEN known THEN ' (Unit 7)' || chr(10) || 'Service: pressure' || chr(10) || 'Trip / limit: 12 bar' ELSE '' END
    || chr(10) || 'Documents: ' || array_to_string(documents, ', ') || coalesce(chr(10) || notes, '')) END AS box FROM r""")
def dossier_box(spark, d):
    found = dossiers(spark, d)
    return found.select("tag", F.md5(E.dossier_box(found)).alias("box"))


_UNITS = [("PT", "Pressure Transmitter", ["pressure sensor"], "Sends a measured pressure."), ("CDU", "Crude Distillation Unit", ["crude tower", "topping unit"], "Separates crude oil."), ("BS-VI", "Bharat Stage VI", ["ultra low sulphur"], "A fuel standard.")]
#: Whole turns of conversations with plant words put to their ends.
_TURN = "coalesce(text, '') || CASE (conv_id + turn) % 5 WHEN 0 THEN ' feeds the CDU and BS6 pool' WHEN 1 THEN ' relief valve near PT-' || CAST(100 + conv_id % 300 AS {s}) WHEN 2 THEN ' is the ESD armed' WHEN 3 THEN ' PT and CDU limits of XV-' || CAST(10 + turn AS {s}) ELSE '' END"
_TURNS_SQL = f"""t AS (SELECT conv_id, turn, trim({_TURN.format(s='VARCHAR')}, ' ') AS q FROM conversations WHERE length(trim({_TURN.format(s='VARCHAR')}, ' ')) > 0),
u(code, full_name, synonyms, context) AS (VALUES {', '.join(f"('{c}', '{n}', {s!r}, '{x}')" for c, n, s, x in _UNITS)}),
wo AS (SELECT conv_id, turn, i, CASE w[i] WHEN 'BS6' THEN 'BS-VI' WHEN 'BSVI' THEN 'BS-VI' ELSE w[i] END AS code FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(upper(q), '\\b([A-Z0-9_\\-./]+)\\b', 1) AS w FROM t))),
de AS (SELECT conv_id, turn, list_slice(list(code || ' (' || full_name || '): ' || context ORDER BY i, code || ' (' || full_name || '): ' || context), 1, 2) AS defs, flatten(list(list_concat([full_name], synonyms))) AS names FROM wo JOIN u USING (code) GROUP BY ALL),
tg AS (SELECT conv_id, turn, q, list_filter(regexp_extract_all(upper(q), '\\b([A-Z]{{1,5}}-\\d{{1,5}}[A-Z]?|[A-Z]{{2,4}}\\d{{2,4}}[A-Z]?)\\b', 1), lambda x: len(x) >= 4 AND x NOT IN ({', '.join(repr(u[0]) for u in ontology.UNITS)})) AS tags FROM t),
bo AS (SELECT tg.*, list_sort(list_distinct(list_concat(coalesce(names, []), tags))) AS boosts, q || coalesce(' | Context: ' || array_to_string(defs, ' '), '') AS dense FROM tg LEFT JOIN de USING (conv_id, turn))"""


def turns(spark, d):
    q = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("qid"), F.expr(f"trim({_TURN.format(s='string')})").alias("text"))
    return q.where("length(text) > 0")


@query("ontology_expand", f"WITH {_TURNS_SQL} SELECT conv_id, turn, array_to_string(boosts, ',') AS boosts, md5(dense) AS dense_text FROM bo")
def ontology_expand(spark, d):
    out = ontology.expand(turns(spark, d), ontology.table(spark, _UNITS))
    return out.select("qid.conv_id", "qid.turn", F.array_join("boosts", ",").alias("boosts"), F.md5("dense_text").alias("dense_text"))


@query("query_tags", f"WITH {_TURNS_SQL.replace('AND x NOT IN', 'OR x IN')} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(tags, lambda x: len(x) >= 4))), ',') AS tags FROM tg")
def query_tags(spark, d):
    return turns(spark, d).select("qid.conv_id", "qid.turn", F.array_join(T.query_tags("text"), ",").alias("tags"))


#: What spoken phrases and codes add to a question, one by one.
_ADDED_SQL = f"""ph(phrase, code) AS (VALUES {', '.join(f"('{p}', '{c}')" for p, c in ontology.PHRASES)}), un(code, name) AS (VALUES {', '.join(f"('{u[0]}', '{u[1]}')" for u in ontology.UNITS)}),
mm AS (SELECT conv_id, turn, ph.code AS added FROM bo JOIN ph ON contains(lower(q), phrase) AND NOT contains(upper(q), ph.code)
    UNION SELECT conv_id, turn, un.name FROM bo JOIN un ON list_contains(regexp_extract_all(upper(q), '\\b([A-Z0-9_-]+)\\b', 1), un.code) AND NOT contains(lower(q), lower(un.name))),
gg AS (SELECT conv_id, turn, string_agg(added, ' ' ORDER BY added) AS added FROM mm GROUP BY ALL)"""


@query("query_assembly", f"WITH {_TURNS_SQL}, {_ADDED_SQL} SELECT conv_id, turn, md5(CASE WHEN added IS NOT NULL THEN q || ' (' || added || ') | ' || dense ELSE dense END) AS dense_query, md5(trim(q || ' ' || array_to_string(list_slice(boosts, 1, 4), ' '), ' ')) AS lexical_query, len(list_filter(regexp_extract_all(upper(q), '\\b([A-Z]{{1,5}}-\\d{{1,5}}[A-Z]?|[A-Z]{{2,4}}\\d{{2,4}}[A-Z]?)\\b', 1), lambda x: len(x) >= 4)) > 0 OR regexp_matches(q, '\\b(?:[A-Z0-9]{{2,6}}-[A-Z0-9]{{2,6}}|ERR[_-]?[A-Z0-9]+|0x[0-9A-Fa-f]+|E-\\d{{2,4}})\\b') AS tagged FROM bo LEFT JOIN gg USING (conv_id, turn)")
def query_assembly(spark, d):
    out = fusion.prepare(turns(spark, d), ontology.table(spark, _UNITS))
    return out.select("qid.conv_id", "qid.turn", F.md5("dense_query").alias("dense_query"), F.md5("lexical_query").alias("lexical_query"), "tagged")


# Synchronisation of documents as files: those of odd ids are known, of them each third with another hash; multiples of 7
# are gone, and multiples of 11 are broken office files.


def sync_inputs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.expr("'/in/' || doc_id || if(doc_id % 11 = 0, '.docx', '.txt')").alias("path"))
    files = docs.where("doc_id % 7 <> 0").select("path", "content", document_id("path").alias("document_id"), F.sha2("content", 256).alias("file_hash"))
    known = docs.where("doc_id % 2 = 1").select(
        document_id("path").alias("document_id"), F.substring("path", 5, 100).alias("filename"), "path", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.sha2("content", 256)).alias("file_hash"), F.lit("txt").alias("file_type"),
        F.lit("general").alias("category"), F.lit("general").alias("document_type"), F.lit("indexed").alias("status"), F.lit(0).alias("ocr_used"), F.lit(9).alias("chunk_count"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    return files, known


def synced(spark, d):
    from millrace.operators.providers import MockEmbedder

    files, known = sync_inputs(spark, d)
    changes = registry.compare(files, known)
    wanted = files.join(changes.where("change IN ('indexed', 'updated')").select("path"), "path", "left_semi")
    records, errors = sync.parse(wanted)
    return sync.outcomes(changes, sync.chunked(records, MockEmbedder(8)), errors), known


_SYNC = r"""s AS (SELECT doc_id, '/in/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 11 = 0 THEN '.docx' ELSE '.txt' END AS path, sha256(coalesce(text, '')) AS hash,
    CASE WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 2 = 1 AND doc_id % 3 <> 0 THEN 'skipped' WHEN doc_id % 11 = 0 THEN 'failed' WHEN NOT regexp_matches(coalesce(text, ''), '\S') THEN 'empty'
    WHEN doc_id % 2 = 1 THEN 'updated' ELSE 'indexed' END AS status FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 2 = 1)"""


@query("sync_status", f"WITH {_SYNC} SELECT path, status, CAST(CASE WHEN status IN ('indexed', 'updated') THEN 1 ELSE 0 END AS BIGINT) AS chunk_count, status = 'failed' AS failed FROM s")
def sync_status(spark, d):
    done, _ = synced(spark, d)
    return done.select("path", "status", F.col("chunk_count").cast("long").alias("chunk_count"), F.col("error").isNotNull().alias("failed"))


@query("sync_totals", f"WITH {_SYNC} SELECT {', '.join(f'''count(*) FILTER (WHERE status = '{k}') AS {k}''' for k in ('indexed', 'updated', 'skipped', 'deleted', 'failed', 'empty'))}, 0::BIGINT AS ocr_processed, 0::BIGINT AS ocr_failed FROM s")
def sync_totals(spark, d):
    return sync.totals(synced(spark, d)[0])


@query("sync_registry", f"WITH {_SYNC} SELECT path, CASE WHEN status IN ('indexed', 'updated') THEN hash WHEN doc_id % 3 = 0 THEN 'old' ELSE hash END AS file_hash, CASE WHEN status IN ('indexed', 'updated') THEN 1 ELSE 9 END AS chunk_count FROM s WHERE status IN ('indexed', 'updated') OR status <> 'deleted' AND doc_id % 2 = 1")
def sync_registry(spark, d):
    done, known = synced(spark, d)
    return sync.registered(known, done, F.lit("2024-01-01").cast("timestamp")).select("path", "file_hash", "chunk_count")


def books(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("/in/"), "o_orderkey").alias("path"), F.concat("o_orderpriority", F.lit("-"), "o_orderkey").alias("filename"), F.concat(F.lit("d"), "o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status"))


_BOOKS = "b AS (SELECT '/in/' || CAST(o_orderkey AS VARCHAR) AS path, o_orderpriority || '-' || CAST(o_orderkey AS VARCHAR) AS filename, 'd' || CAST(o_orderkey AS VARCHAR) AS document_id, o_orderstatus AS status, o_custkey FROM orders)"


@query("registry_by_path", f"WITH {_BOOKS} SELECT path, filename, status FROM b WHERE path IN (SELECT '/in/' || CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity > 45)")
def registry_by_path(spark, d):
    paths = table(spark, d, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("/in/"), "l_orderkey").alias("path"))
    return registry.by_path(books(spark, d), paths).select("path", "filename", "status")


@query("registry_by_id", f"WITH {_BOOKS} SELECT document_id, filename FROM b WHERE document_id IN (SELECT 'd' || CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 7)")
def registry_by_id(spark, d):
    ids = table(spark, d, "lineitem").where("l_linenumber = 7").select(F.concat(F.lit("d"), "l_orderkey").alias("document_id"))
    return registry.by_id(books(spark, d), ids).select("document_id", "filename")


@query("registry_list", f"WITH {_BOOKS} SELECT document_id, filename FROM b")
def registry_list(spark, d):
    return registry.listed(books(spark, d)).select("document_id", "filename")


@query("registry_delete", f"WITH {_BOOKS} SELECT document_id, status FROM b WHERE status <> 'F'")
def registry_delete(spark, d):
    rows = books(spark, d)
    return registry.without(rows, rows.where("status = 'F'")).select("document_id", "status")


@query("payload_defaults", "SELECT doc_id, text, 'Unknown' AS filename, 1 AS page_number, coalesce(lang, 'general') AS category, 'general' AS document_type, false AS ocr_used, '' AS parent_id FROM documents")
def payload_defaults(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("category"))
    return registry.payload(rows, nulls=False).select("doc_id", "text", "filename", "page_number", F.coalesce("category", F.lit("general")).alias("category"), "document_type", "ocr_used", "parent_id")


@query("any_ocr", r"SELECT source, bool_or(length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 50 OR length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) < 25) AS ocr_used FROM documents GROUP BY source")
def any_ocr(spark, d):
    """Sources of which a document has too little text, so that it would be recognised."""
    return table(spark, d, "documents").withColumn("ocr", is_insufficient("text")).groupBy("source").agg(F.bool_or("ocr").alias("ocr_used"))


@query("synthetic_sample", "SELECT doc_id FROM documents WHERE length(text) > 200 ORDER BY sha256(CAST(doc_id AS VARCHAR) || ':7'), doc_id LIMIT 40")
def synthetic_sample(spark, d):
    """A sample is the feature: the first forty of all long texts by a hash."""
    return evaluate.sample(table(spark, d, "documents").select("doc_id", "text"), 40, 7, key="doc_id").select("doc_id")


_VERBS = "feeds|drains|measures|controls|protects|isolates|trips|supplies|cools|heats|monitors|opens|closes"
_LINKED = "coalesce(text, '') || ' PT-' || CAST(100 + doc_id % 400 AS {s}) || ' measures XV-' || CAST(10 + doc_id % 7 AS {s}) || '; XV-' || CAST(10 + doc_id % 7 AS {s}) || ' feeds the C-' || CAST(doc_id % 3 AS {s}) || '.'"


@query("triples", rf"""WITH t AS (SELECT doc_id, {_LINKED.format(s='VARCHAR')} AS t FROM documents), m AS (SELECT doc_id, unnest(regexp_extract_all(t, '\b[A-Z]{{1,5}}-\d{{1,5}}[A-Z]?\s+(?:{_VERBS})\s+(?:the\s+)?[A-Z]{{1,5}}-\d{{1,5}}[A-Z]?\b')) AS m FROM t WHERE length(t) > 100)
    SELECT doc_id, regexp_extract(m, '^(\S+)', 1) AS src, regexp_extract(m, '^\S+\s+(\S+)', 1) AS relation, regexp_extract(m, '(\S+)$', 1) AS dst FROM m""")
def triples(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(_LINKED.format(s="string")).alias("t"))
    return graph.triples(rows, "doc_id", "t").select(F.col("doc").alias("doc_id"), "src", "relation", "dst")


@query("graph_saved", "SELECT upper(c_name) AS src, upper(n_name) AS dst, 'of' AS relation FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def graph_saved(spark, d):
    """Edges written to the shared folder and read back."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    edges = graph.edges_of(rows.select(F.col("c_name").alias("src"), F.lit(" of ").alias("relation"), F.col("n_name").alias("dst"), F.lit("x").alias("source"), F.col("c_custkey").cast("long").alias("seq")))
    folder = shared_folder(spark, "graph")
    sinks.save_graph(edges, folder)
    return sinks.load_graph(spark, folder).select("src", "dst", "relation")


@query("audit_lines", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' | ' || CASE WHEN event_id % 3 = 0 THEN 'LOCAL' ELSE 'EXTERNAL' END || ' | events | ' || event_type || ' |  | ' || CAST(user_id AS VARCHAR) AS line FROM events")
def audit_lines(spark, d):
    """Lines written as text and read back."""
    e = table(spark, d, "events")
    rows = e.select(F.col("ts").cast("timestamp").alias("timestamp"), F.lit("events").alias("component"), F.col("event_type").alias("operation"), F.lit(None).cast("string").alias("target"), (F.col("event_id") % 3 == 0).alias("is_local"), F.col("user_id").cast("string").alias("details"))
    folder = shared_folder(spark, "audit")
    sinks.append_audit(rows, folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query("event_sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS s FROM events) GROUP BY ALL")
def event_sliding(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return streams.sliding(e, "at", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
