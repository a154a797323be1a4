"""Codes, automata, the audit log, the document source, streams of files: parts on their own and hard rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import DATA

from millrace.operators import dense, phrases, quantized, sketches, sync
from millrace.operators.audit import AuditLog
from millrace.operators.providers import MockEmbedder
from millrace.operators.segments import Index


def test_codes_are_exact_or_recall_enough(spark, tmp_path, monkeypatch):
    rows = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    index = quantized.build(rows)
    index.save(str(tmp_path / "codes"))
    index = quantized.Codes.load(spark, str(tmp_path / "codes"), rows)
    want = {(r["qid"], r["rank"]): r["doc"] for r in dense.search(rows, asked, 10).collect()}
    monkeypatch.setattr(quantized, "QUESTION_BYTES", 64 * 8 * 4)  # several passes
    assert {(r["qid"], r["rank"]): r["doc"] for r in quantized.search(index, asked, 10).collect()} == want
    near = {(r["qid"], r["doc"]) for r in quantized.search(index, asked, 10, exact=False, over=1).collect()}
    recall = len(near & {(q, d) for (q, _), d in want.items()}) / len(want)
    assert recall >= 0.95, recall


def test_codes_of_hard_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [-1e-3, 1e-3])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0])], "qid string, vector array<double>")
    got = [(r["qid"], r["doc"], round(r["score"], 6)) for r in quantized.search(quantized.build(rows), q, 5).orderBy("rank").collect()]
    assert got == [("a", 1, 1.0), ("a", 6, 1.0), ("a", 7, round(-(0.5**0.5), 6))]
    assert quantized.search(quantized.build(rows.where("false")), q, 5).count() == 0 and quantized.search(quantized.build(rows), q.where("false"), 5).count() == 0
    codes, scale, error = quantized._codes(np.random.default_rng(0).normal(size=(50, 16)))
    assert (error <= scale * 2 + 1e-12).all() and np.abs(codes).max() == 127


@pytest.mark.parametrize("size", [1 << 20, 12])
def test_phrases(spark, monkeypatch, size):
    monkeypatch.setattr(phrases, "AUTOMATON_BYTES", size)
    texts = spark.createDataFrame([(1, "PT-1 and pt-10, xpt-1é PT-1"), (2, None), (3, ""), (None, "abab ABA"), (4, "é PT-1"), (4, "é PT-1")], "doc_id long, text string")
    names = spark.createDataFrame([("PT-1",), ("pt-1",), ("PT-10",), ("aba",), ("",), (None,), ("PT-1",)], "phrase string")
    got = sorted((r["doc"] or 0, r["phrase"], r["n"], r["first"]) for r in phrases.find_phrases(texts, names).collect())
    assert got == [(0, "aba", 2, 0), (1, "PT-1", 4, 0), (1, "PT-10", 1, 9), (1, "pt-1", 4, 0), (4, "PT-1", 1, 2), (4, "PT-1", 1, 2), (4, "pt-1", 1, 2), (4, "pt-1", 1, 2)]
    whole = sorted((r["doc"] or 0, r["phrase"], r["n"]) for r in phrases.find_phrases(texts, names, fold=False, whole_words=True).collect())
    assert whole == [(1, "PT-1", 2), (4, "PT-1", 1), (4, "PT-1", 1)]
    assert phrases.find_phrases(texts, names.where("false")).count() == 0


def test_an_audit_log_outlives_its_writer(spark, tmp_path):
    log, path = AuditLog(spark, str(tmp_path / "log")), str(tmp_path / "totals")
    assert log.table().count() == 0
    ids = [log.record("c", "op", "t" * 300, local=k % 2 == 0) for k in range(4)]
    assert log.record("c", "op", "again", event=ids[0]) == ids[0]
    with pytest.raises(ValueError):
        log.record("c", "op", "t", event="../x")
    rows = {r["id"]: r for r in AuditLog(spark, str(tmp_path / "log")).table().collect()}
    assert set(rows) == set(ids) and len(rows[ids[0]]["target"]) == 200 and rows[ids[0]]["timestamp"] is not None
    log.count(path, str(tmp_path / "state"), 1).awaitTermination()
    assert [r["events"] for r in log.totals(path).collect()] == [4]
    log.append(log.table().limit(2))  # written again under another file
    log.record("c", "op", "new", local=False)
    again = AuditLog(spark, str(tmp_path / "log"))
    again.count(path, str(tmp_path / "state")).awaitTermination()
    assert [(r["events"], r["local_events"], r["external_events"]) for r in again.totals(path).collect()] == [(5, 2, 3)] and again.table().count() == 5


def test_a_stream_of_files_is_a_synchronisation(spark, tmp_path):
    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.txt").write_text(f"The pump {k} has a seal.")
    run = lambda: sync.follow(spark, str(folder), index, str(tmp_path / "state"), MockEmbedder(8)).awaitTermination()
    run()
    (folder / "1.txt").unlink()
    (folder / "9.txt").write_text("Valve 9 closes at 5 bar.")
    run()
    view = Index(spark, index).view()
    names = {r["filename"] for r in sync.registry_of(view).collect()}
    assert names == {"0.txt", "2.txt", "3.txt", "9.txt"} and view.chunks().count() == 4
    version = view.version
    paths = spark.createDataFrame([(f"file:{folder}/9.txt",)], "path string")
    assert sync.take(spark, paths, 1, str(folder), index, MockEmbedder(8)) is None and Index(spark, index).view().version == version  # a batch again
    counts = sync.sync(spark, str(folder), index, MockEmbedder(8))
    assert counts["skipped"] == 4 and not counts["indexed"] and not counts["deleted"] and Index(spark, index).view().version == version
    assert not [f for f in os.listdir(index) if f.startswith("draft")]


def test_the_document_source(spark, tmp_path):
    from test_services import make_pdf

    from millrace.sources import datasource

    folder = tmp_path / "docs"
    folder.mkdir()
    for k in range(5):
        (folder / f"{k}.txt").write_text(f"Text {k}")
    (folder / "book.pdf").write_bytes(make_pdf([f"Page number {k} of this book" for k in range(5)]))
    (folder / "bad.docx").write_bytes(b"no zip")
    (folder / "left.bin").write_bytes(b"x")
    datasource.register(spark)
    load = lambda **o: spark.read.format(datasource.NAME).options(**o).load(str(folder))
    rows = load().collect()
    assert sorted(r["text"] for r in rows if r["extension"] == "txt") == [f"Text {k}" for k in range(5)]
    assert [r["page_number"] for r in sorted((r for r in rows if r["extension"] == "pdf"), key=lambda r: r["page_number"])] == [1, 2, 3, 4, 5]
    assert [r["path"].rsplit("/", 1)[-1] for r in rows if r["error"]] == ["bad.docx"]
    shared = load(pageBytes=str(os.path.getsize(folder / "book.pdf") // 2 - 1)).where("extension = 'pdf'")
    assert shared.rdd.getNumPartitions() == 3 and sorted(r["page_number"] for r in shared.collect()) == [1, 2, 3, 4, 5]
    assert load(partitionBytes="7").where("extension = 'txt'").rdd.getNumPartitions() == 5
    # Filters reach the listing: a file that they leave out isn't opened.
    (folder / "locked.txt").write_text("x")
    reader = datasource.DocumentReader({"path": str(folder)})
    left = list(reader.pushFilters([datasource.EqualTo(("extension",), "pdf"), datasource.EqualTo(("text",), "x")]))
    assert len(left) == 1 and [p.rsplit("/", 1)[-1] for p, _ in reader.listed()] == ["book.pdf"]


def test_sketches_merge(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("part"), F.when(F.col("id") % 10 < 5, "common").otherwise(F.col("id").cast("string")).alias("term"))
    rows = rows.unionByName(spark.createDataFrame([(0, None)], "part long, term string"))
    kept = sketches.of_parts(rows, ["part"], "term")
    assert kept.count() == 3
    whole = sketches.merged(kept, [], 3).first()
    assert abs(whole["distinct"] - 1501) <= sketches.ERROR * 1501 + 1 and (whole["top"][0]["item"], whole["top"][0]["count"]) == ("common", 1500)


def test_files_without_a_reader_are_not_listed(spark, tmp_path):
    from millrace.sources import readers

    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "t.csv").write_text("\ufeffTag,Limit\nPT-1,5 bar\n,\nPT-2,,odd\n", encoding="utf-8")
    (folder / "n.md").write_text("# Notes")
    (folder / "p.jpg").write_bytes(b"x")
    (folder / "x.bin").write_bytes(b"x")
    index = str(tmp_path / "i")
    assert sync.sync(spark, str(folder), index, MockEmbedder(8)) | {} == {"indexed": 2, "updated": 0, "skipped": 0, "deleted": 0, "failed": 0, "empty": 0, "ocr_processed": 0, "ocr_failed": 0}
    texts = [r["text"] for r in readers.read_csv("/a/t.csv", (folder / "t.csv").read_bytes())]
    assert texts == ["[Dataset: t.csv | Schema Headers]\nTag | Limit", "[Dataset: t.csv | Row 2]\nTag: PT-1 | Limit: 5 bar", "[Dataset: t.csv | Row 4]\nTag: PT-2 | Column 3: odd"]
