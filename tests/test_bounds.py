"""What tasks hold and hand on stays bounded, and results are those of the plain way."""

import html

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from support import DATA

from millrace.functions.vectors import cosine
from millrace.operators import dense, fusion, lexical, nearest, quantized, segments, sync
from millrace.operators.lexical import ranked
from millrace.plans import retrieval
from millrace.sources import sinks


def vectors(spark, n=600, dim=8):
    x = np.random.default_rng(1).standard_normal((n, dim)).round(1)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(n, None, 0), (n + 1, [0.0] * dim, 1), (n + 2, [1.0], 2), (n + 3, [float("nan")] * dim, 0), (n + 4, [None] * dim, 1), (n + 5, x[3].tolist(), 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4).cache()


def by_pairs(v, q, k):
    scored = v.crossJoin(q.select("qid", F.col("vector").alias("q"))).select("qid", F.col("vec_id").alias("doc"), cosine(F.col("embedding"), F.col("q")).alias("score"))
    return [tuple(map(str, r)) for r in ranked(scored, ["qid"], [F.desc(F.round("score", 9)), F.asc("doc")], k).orderBy("qid", "rank").collect()]


def test_dense_search_of_odd_vectors_and_few_of_them(spark):
    v = vectors(spark)
    for some, k in ((v, 5), (v.where("vec_id >= 597"), 20)):
        q = v.where("vec_id % 100 = 0 OR vec_id >= 600").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
        found = dense.search(some, q, k)
        assert [tuple(map(str, r)) for r in found.orderBy("qid", "rank").collect()] == by_pairs(some, q, k)


def test_tasks_hand_on_the_nearest_only(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PRODUCTS", 640)  # slices of 64 rows
    v = vectors(spark).where("vec_id < 600").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    q = np.array([r["v"] for r in v.orderBy("doc").limit(10).collect()])
    found = nearest.search(v, pa.array(range(10)), q, "long", 3)
    assert found.groupBy(F.spark_partition_id().alias("p"), "qid").count().agg(F.max("count")).first()[0] == 3
    best = ranked(found, ["qid"], [F.desc("key"), F.asc("doc")], 1)
    assert all(r["score"] > 0.999 for r in best.collect())


def test_codes_are_compared_slice_by_slice(spark, monkeypatch):
    v = vectors(spark).where("vec_id < 600")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, quantized.search(quantized.build(v), q, 4).collect()))
    assert [(a, b, str(s), r) for a, b, s, r in whole] == sorted((int(a), int(b), s, int(r)) for a, b, s, r in by_pairs(v, q, 4))
    monkeypatch.setattr(quantized, "PRODUCTS", 640)
    assert sorted(map(tuple, quantized.search(quantized.build(v), q, 4).collect())) == whole


def test_records_are_handed_on_by_many(monkeypatch):
    """A batch for each of a thousand files took longer than their reading."""
    files = pa.RecordBatch.from_pydict({"path": [f"/d{i}.txt" for i in range(1000)], "content": [b"x" * (i % 3) for i in range(1000)]})
    run = sync._records(sync.R.READERS, lambda b, k: b.column("content")[k].as_py())
    out = list(run(iter([files])))
    assert len(out) <= 2 and sum(b.num_rows for b in out) == sum(i % 3 > 0 for i in range(1000))
    monkeypatch.setattr(sync, "CHARS_AT_ONCE", 10)
    assert len(list(run(iter([files])))) > 50


def test_contents_come_to_a_task_by_few(spark, monkeypatch):
    """A task held thousands of files, however large: the session's batches are bounded, smaller ones stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    schema = sync.to_arrow_schema(sync.StructType.fromDDL(f"{sync.RECORDS}, error string"))

    def sizes(readers, content):
        return lambda batches: (pa.RecordBatch.from_pylist([{"source": "/d", "text": str(b.num_rows)}], schema) for b in batches)

    monkeypatch.setattr(sync, "_records", sizes)
    files = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("/d"), "id").alias("path"), F.lit(b"x").alias("content"))
    try:
        for most, rows in (("5000", [232, 256, 256, 256]), ("0", [232, 256, 256, 256]), ("400", [232, 256, 256, 256]), ("250", [250] * 4)):
            spark.conf.set(name, most)
            assert sorted(int(r["text"]) for r in sync.parse(files)[0].collect()) == rows
    finally:
        spark.conf.set(name, held)


def test_text_of_office_files_is_cleaned_as_before():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10400)]))
    assert sinks._clean(every) == html.escape("".join(c for c in every if c in "\t\n\r" or ord(c) >= 32))


def test_lexical_search_in_blocks(spark, monkeypatch):
    """The first k by blocks, tasks and passes are those of all pairs; ties go by document, also among many copies."""
    words = [f"w{x}" for x in np.random.default_rng(2).zipf(1.5, 6000) % 90]
    rows = [(d, " ".join(words[d * 8 : d * 8 + 8]) if d % 3 else "pump valve pump") for d in range(700)] + [(700, None), (701, "")]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(5)
    q = spark.createDataFrame([(1, "pump w1 w2"), (2, "w1 w1 w3"), (3, "absent"), (4, "w5 valve w90"), (5, None)], "qid long, text string")
    index = lexical.build_index(docs, "doc", "text")
    same = lambda i, k: [(r["qid"], r["doc"], r["rank"], round(r["score"], 9)) for r in lexical.search(i, q, k).orderBy("qid", "rank").collect()]
    whole = [r for r in same(index, None) if r[2] < 6]
    assert {r[0] for r in whole} == {1, 2, 4} and same(index, 6) == whole
    monkeypatch.setattr(lexical, "DOCS", 16)
    monkeypatch.setattr(lexical, "PAIRS", 3)
    assert same(index, 6) == whole and same(lexical.Index(index.postings, index.lengths, index.stats), 6) == whole
    wanted = lexical._counted(index.words, pa.array(["pump", "valve"]))
    found = lexical.best(wanted, lexical.Asked(pa.array([1]), pa.array(["pump", "valve"]), np.array([0, 2]), np.array([0, 1]), np.ones(2)), np.ones(2), 5.0, "long", 2)
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] == 2  # not a row for each copy


def test_hits_go_to_their_documents(spark, monkeypatch):
    """The texts of all documents were shuffled for those of the hits."""
    docs = spark.createDataFrame([(d, f"t{d}" if d % 5 else None) for d in range(60)], "doc long, text string").repartition(3)
    hits = spark.createDataFrame([(q, (q * r) % 65, r) for q in range(20) for r in range(4)], "qid long, doc long, rank int").distinct()
    plain = sorted(hits.join(docs, "doc").select("qid", "doc", "rank", "text").collect(), key=str)
    for at_once in (lexical.HITS, 7):
        monkeypatch.setattr(lexical, "HITS", at_once)
        found = lexical.with_documents(hits, docs)
        assert sorted(found.select("qid", "doc", "rank", "text").collect(), key=str) == plain
    # Also where Spark doesn't know that the hits are few.
    monkeypatch.setattr(lexical, "HITS", 250_000)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" not in retrieval.top_hits(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_question_without_a_vector_keeps_its_lexical_hits(spark):
    """Vectors without a score took places among the first 3 k."""
    docs = spark.createDataFrame([(d, "pump " * (1 + d % 7) + "x " * d, f"f{d}.txt", "", "Active", 1) for d in range(40)], "doc long, text string, filename string, location string, revision string, page_number int")
    vectors = spark.createDataFrame([(d, [1.0, float(d)]) for d in range(40)], "doc long, embedding array<double>")
    q = spark.createDataFrame([(1, "pump", None)], "qid long, text string, vector array<double>")
    found = fusion.retrieve(lexical.build_index(docs, "doc", "text"), vectors, docs, q, 5, threshold=0.0)
    assert {r["doc"] for r in found.collect()} == {r["doc"] for r in lexical.search(lexical.build_index(docs, "doc", "text"), q, 5).collect()}


def test_segments_are_searched_for_many_questions_as_for_few(spark, tmp_path, monkeypatch):
    index = segments.Index(spark, str(tmp_path))
    texts = [" ".join(f"w{(d * j) % 23}" for j in range(1, 9)) for d in range(120)]
    rows = lambda ids: spark.createDataFrame([(f"d{d}", d, texts[d]) for d in ids], "document_id string, doc long, text string")
    index.change(rows(range(100)))
    index.change(rows(range(90, 120)), rows([3, 4]).select("document_id"))
    q = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w5 absent w7"), (3, "absent"), (4, None)], "qid long, text string")
    of = lambda only: sorted((r["qid"], r["rank"], r["doc"], round(r["score"], 9)) for r in index.view().search(q, 7, only=only).collect())
    few = of(None)
    assert few
    assert len({r[0] for r in few}) == 2
    some = rows(range(0, 120, 2)).select("doc")
    part = of(some)
    monkeypatch.setattr(segments, "NAMED", 1)
    called = []
    plain = segments.View._many
    monkeypatch.setattr(segments.View, "_many", lambda self, *a: (called.append(1), plain(self, *a))[1])
    assert of(None) == few and of(some) == part and len(called) == 2
