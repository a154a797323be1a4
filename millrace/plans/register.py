"""Registration of queries, and the pieces that their SQL has in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents with a tag, a measurement and a revision put to their ends: the corpus itself has none.
AUGMENTED = "text || ' Inspect PT-' || CAST(100 + doc_id % 400 AS {s}) || ' and XV-' || CAST(10 + doc_id % 7 AS {s}) || ' at ' || CAST(doc_id % 50 AS {s}) || '.5 bar Rev ' || CAST(doc_id % 9 AS {s})"


def augmented(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.expr(AUGMENTED.format(s="string")))


AUGMENTED_SQL = f"SELECT * REPLACE ({AUGMENTED.format(s='VARCHAR')} AS text) FROM documents"
TOKENS_SQL = "regexp_extract_all(lower(text), '([a-z0-9]+(?:-[a-z0-9]+)?)', 1)"
#: BM25 of the stated questions (each document whose id is a multiple of 100 asks with its tokens 2 to 6).
BM25_SQL = f"""
d AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term),
q AS (SELECT qid, term, count(*) AS times FROM (SELECT doc_id AS qid, unnest(list_slice(w, 2, 6)) AS term FROM d WHERE doc_id % 100 = 0) GROUP BY ALL),
sparse AS (SELECT qid, p.doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.w) / avgdl))) AS score
    FROM q JOIN p USING (term) JOIN f USING (term) JOIN d ON d.doc_id = p.doc, st GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) - 1 AS rank FROM sparse)"""
COSINE_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform({b}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"
DENSE_SQL = f"""
dense AS (SELECT q.vec_id AS qid, v.vec_id AS doc, {COSINE_SQL.format(a='v.embedding', b='q.embedding')} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) - 1 AS rank FROM dense)"""
