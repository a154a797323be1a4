"""The engine and its parts: recognition, PDF and pictures, sinks, synchronisation, tools, agent, command line."""

import io
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.engine import TOOLS, Cache, Engine
from millrace.functions import images, ocr
from millrace.operators import agent, evaluate, evidence, fusion, graph, lexical, ontology, providers, recognition, registry, rerank, sync
from millrace.sources import pdf, readers, sinks


def make_pdf(pages: list[str], compressed: bool = True) -> bytes:
    """A small PDF file: a page for each text, a line for each of its lines."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for text in pages:
        lines = " T* ".join(f"({t.replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj" for t in text.split("\n"))
        content = f"BT /F1 12 Tf 72 700 Td 14 TL {lines} ET".encode("cp1252")
        data = zlib.compress(content) if compressed else content
        objects.append(b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if compressed else b"", data))
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(objects))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("compressed", [True, False])
def test_pdf_pages_in_order(compressed):
    pages = ["First page\nwith (two) lines", "Zweite Seite: Ärger \\ 5 °C", ""]
    assert list(pdf.page_texts(make_pdf(pages, compressed))) == pages


def test_pdf_strings_and_broken_files():
    data = make_pdf(["x"], False).replace(b"(x) Tj", b"[(Pres) -20 (sure) -300 <4f4b>] TJ")
    assert list(pdf.page_texts(data)) == ["Pressure OK"]
    for bad in (b"", b"no pdf", b"%PDF-1.4 << /Encrypt 3 0 R >>"):
        with pytest.raises(ValueError):
            list(pdf.page_texts(bad))


@pytest.mark.parametrize("shape", [(7, 9), (5, 6, 3)])
def test_png_round_trip(shape):
    pixels = np.random.default_rng(3).integers(0, 256, shape).astype(np.uint8)
    assert (images.read_png(images.write_png(pixels)) == pixels).all()
    with pytest.raises(ValueError):
        images.read_png(b"GIF89a")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (6, 5)).astype(np.int64)
    rows = []
    for i in range(6):
        line = bytearray([kind])
        for k in range(5):
            a, b, c = (pixels[i, k - 1] if k else 0), (pixels[i - 1, k] if i else 0), (pixels[i - 1, k - 1] if i and k else 0)
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[kind]
            line.append(int(pixels[i, k] - guess) % 256)
        rows.append(bytes(line))
    head = images.write_png(pixels.astype(np.uint8))
    at, end = head.index(b"IDAT") - 4, head.index(b"IEND") - 4
    body = zlib.compress(b"".join(rows))
    assert (images.read_png(head[:at] + len(body).to_bytes(4, "big") + b"IDAT" + body + b"\0" * 4 + head[end:]) == pixels).all()


def test_pictures_are_prepared():
    page = np.full((120, 200), 230, np.uint8)
    for y in range(20, 100, 20):
        page[y : y + 4, 20:180] = 40
    assert images.otsu(page) in range(40, 230) and images.skew(page) == 0.0
    assert set(np.unique(images.preprocess(page, "heavy"))) == {0, 255} and (images.preprocess(page, "skip") == page).all()
    light = images.preprocess(page, "light")
    assert light.min() == 0 and light.max() == 255
    y, x = np.mgrid[:120, :200]
    turned = page[np.clip(np.round(y + (x - 100) * np.tan(np.radians(-4))), 0, 119).astype(int), x]
    assert abs(abs(images.skew(turned)) - 4) <= 0.5
    assert images.smaller(np.zeros((900, 500), np.uint8)).shape == (300, 167)


def test_statistics_of_no_picture(spark):
    rows = spark.createDataFrame([(1, b"\0\xff\0\xff", 2), (2, None, 2), (3, b"", 2), (4, b"abc", 2)], "id int, p binary, w int")
    got = {r["id"]: r["s"] for r in rows.select("id", images.image_statistics(F.col("p"), F.col("w")).alias("s")).collect()}
    assert got[1]["mean"] == 127.5 and got[1]["dark_ratio"] == 0.5 and all(got[k]["mean"] is None for k in (2, 3, 4))


def test_engines_by_name():
    assert isinstance(recognition.engine("mock"), recognition.MockEngine) and recognition.engine().available()
    with pytest.raises(ValueError, match="mock"):
        recognition.engine("none")
    recognition.register("other", lambda: recognition.MockEngine("from another"))
    try:
        assert recognition.engine().text == "from another" and list(recognition.ENGINES)[-1] == "mock"
    finally:
        del recognition.ENGINES["other"]


def broken():
    """An engine that fails; of a local class, which goes to workers by value."""

    class Broken:
        def available(self):
            return True

        def layout(self, pixels):
            raise RuntimeError("no ink")

    return Broken


def test_a_failing_engine_is_told(spark):
    Broken = broken()
    pages = spark.createDataFrame([("/a", 1, b"\0\xff\0\xff", 2, "skip")], "path string, page_number int, pixels binary, width int, tier string")
    row = recognition.recognize(pages, Broken).first()
    assert row["layout"] is None and row["ocr_error"] == "RuntimeError: no ink"
    report = recognition.quality_report(recognition.recognize(pages, Broken)).first()
    assert report["is_low_quality"] and report["avg_confidence"] == 0.0 and report["error"]


def test_pages_without_native_text_are_recognised():
    lines = lambda: recognition.MockEngine("1.2 Limits\nPT-101 at 5 bar", 0.8)
    read = recognition.pdf_reader(lines, lambda data, page, dpi: np.zeros((4, 4), np.uint8))
    long = "This page has enough native text of its own, so nothing is recognised on it."
    first, second = read("/x/a.pdf", make_pdf([long, "short"]))
    assert (first["ocr_used"], first["text"]) == (False, long)
    assert (second["page_number"], second["ocr_used"], second["ocr_confidence"], [b["type"] for b in second["blocks"]]) == (2, True, 0.8, ["heading", "paragraph"])
    assert [r["text"] for r in recognition.pdf_reader()("/x/a.pdf", make_pdf([long, "short"]))] == [long, "short"]
    picture = next(recognition.image_reader(lines)("/x/a.png", images.write_png(np.zeros((4, 4), np.uint8))))
    assert picture["content_type"] == "image" and not list(recognition.image_reader(lambda: recognition.MockEngine(""))("/x/a.png", images.write_png(np.zeros((4, 4), np.uint8))))


def test_descriptions():
    assert recognition.describe(b"ab", lambda prompt, data: f" {data} ") == "YWI=" and recognition.describe(b"ab", lambda *a: 1 / 0) == "" and recognition.describe(None, None) == ""


def test_repairs_follow_pythons_patterns(spark):
    """Numbers and marks of doubt over whole texts, with Python's own patterns."""
    import re

    texts = ["at 1O kpa and x1l bar, il a 5o%", "3.l bar (g) 1O.5 bar", "", "l2 mA; O kPa 12 V", "voil 5 bar\n10l V"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("t", ocr.fix_numbers("t").alias("n"), ocr.mark_doubtful("t", F.lit(0.5)).alias("m"), ocr.mark_doubtful("t", F.lit(0.9)).alias("k")).collect()
    number = re.compile(ocr.NUMBER)
    for r in rows:
        fixed = number.sub(lambda m: re.sub(r"(?<!\.)[lIL]", "1", m[1].translate(str.maketrans("Oo", "00"))) + " " + m[2], r["t"])
        assert r["n"] == fixed and r["k"] == r["t"] and r["m"] == re.sub(f"(?i)({ocr.NUMBER[4:]})", r"\1 [UNVERIFIED]", r["t"])


def test_change_log(spark):
    row = spark.range(1).select(ocr.repair_log(F.lit("PT l0O at 1O kpa\nLIMITS:\nfine"), F.lit(0.5)).alias("r"), ocr.repair_log(F.lit("fine"), F.lit(0.5)).alias("s")).first()
    assert row["r"]["text"] == "PT-100 at 10 kPa [UNVERIFIED]\nLIMITS:\nfine" and row["r"]["changed"] == ["tags", "numbers", "units", "doubt"]
    assert row["r"]["sections"][0]["content"] == "fine" and row["s"]["changed"] == []


def test_office_reports_are_read_back(spark, tmp_path):
    book = sinks.excel([{"tag": "PT-101", "bar": 5.5}, {"tag": "A & <B>", "note": "x"}])
    assert [r["text"].split("\n")[1] for r in readers.read_xlsx("/r/a.xlsx", book)] == ["tag | bar | note", "PT-101 | 5.5", "A & <B> | x"]
    table = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    assert len(list(readers.read_xlsx("/r/a.xlsx", sinks.excel(table)))) == 3
    assert next(readers.read_docx("/r/a.docx", sinks.word("Title", "One & two\nThree")))["text"] == "Title\n\nOne & two\n\nThree"
    deck = list(readers.read_pptx("/r/a.pptx", sinks.slides([{"title": "T1", "content": "a\nb"}, {"title": "T2"}])))
    assert [r["text"] for r in deck] == ["T1\na\nb", "T2"]
    with pytest.raises(ValueError):
        sinks.put_report(b"", str(tmp_path), "../x")
    assert sinks.put_report(b"x", str(tmp_path), "a.docx").endswith("a.docx")


def test_graph_round_trips(spark, tmp_path):
    assert sinks.load_graph(spark, str(tmp_path / "none")).count() == 0
    edges = [{"src": "A", "dst": "B & C", "relation": "FEEDS", "source": "f.pdf"}]
    assert [{k: e[k] for k in edges[0]} for e in sinks.read_graphml(sinks.graphml(edges))] == edges


def test_results_pairs_and_audit_are_written(spark, tmp_path):
    pairs = evaluate.synthetic_pairs(spark.createDataFrame([("text one", "f", "c1"), ("bad", "f", "c2")], "text string, filename string, chunk_id string"), lambda t: {"query": "q", "answer": t} if t != "bad" else {"query": "q"})
    for n in (1, 2):
        sinks.append_pairs(pairs, str(tmp_path / "qa"))
        assert spark.read.json(str(tmp_path / "qa")).count() == n
    results = spark.createDataFrame([(1, True, 1.0, 0.5, 2, 12.0)], "qid long, hit boolean, reciprocal_rank double, precision double, chunks long, latency_ms double")
    sinks.save_results(evaluate.totals(results), results, str(tmp_path / "eval"))
    assert spark.read.json(str(tmp_path / "eval/aggregate")).first()["mean_latency_ms"] == 12


def test_lookups_in_the_registry(spark):
    rows = spark.createDataFrame([("/b", "2", "b"), ("/a", "1", "a")], "path string, document_id string, filename string")
    assert registry.by_path(rows, "/a").first()["document_id"] == "1" and registry.by_id(rows, "2").first()["path"] == "/b"
    assert [r["filename"] for r in registry.listed(rows).collect()] == ["a", "b"] and registry.without(rows, rows.where("path = '/a'")).count() == 1
    row = registry.payload(spark.createDataFrame([(1, None)], "id int, category string")).first()
    assert row["category"] is None and row["filename"] == "Unknown" and row["tags"] == []
    assert registry.payload(spark.createDataFrame([(1, None)], "id int, category string"), nulls=True).first()["category"] == "general"


def test_code_runs_apart():
    assert agent.run_code("```python\nprint(6 * 7)\n```") == {"success": True, "output": "42"}
    assert agent.run_code("") == {"success": False, "output": "no code"}
    assert agent.run_code("import socket")["output"].startswith("blocked") and agent.run_code("eval('1')")["output"].startswith("blocked")
    assert agent.run_code("from urllib.request import urlopen")["output"].startswith("blocked") and "syntax" in agent.run_code("def")["output"]
    assert not agent.run_code("while True: pass", seconds=1)["success"] and not agent.run_code("1 / 0")["success"]


@pytest.mark.parametrize(
    "plan,good",
    [
        (None, False), ({"steps": []}, False), ({"steps": [{"tool": "unknown"}]}, False), ({"steps": [{"tool": "rag_search", "params": {"query": " "}}, {"tool": "generate_response"}]}, False),
        ({"steps": [{"tool": "rag_search", "params": {"query": "q"}}]}, False), ({"steps": [{"tool": "rag_search", "params": {"query": "q"}}, {"tool": "generate_response"}]}, True),
        ({"steps": [{"tool": "generate_response"}] * 6}, False), ({"steps": [{"tool": "python_repl", "params": {"code": "1"}}]}, True),
    ],
)
def test_plans_are_checked(plan, good):
    assert agent.valid_plan(plan) is good


def test_planner_falls_back():
    good = agent.fallback_plan("q")
    assert agent.Planner(lambda p: f"Here: ```json\n{json.dumps(good)}\n```").plan("x") == good
    for call in (lambda p: "nothing", lambda p: 1 / 0, None):
        assert agent.Planner(call).plan("x") == agent.fallback_plan("x")
    assert agent.fallback_plan("x", search=False)["steps"] == [{"id": 1, "tool": "generate_response", "params": {}}]


def test_agent_plans_again_and_streams():
    tried = []
    events = list(agent.Agent(lambda q: tried.append(q) or []).events("where is the relief valve"))
    assert len(tried) == 3 and tried[1] == "where relief valve" and events[-1]["sources"] == []
    events = list(agent.Agent(lambda q: [{"filename": "f", "text": "two words"}]).events("q"))
    assert "".join(e["text"] for e in events if e["type"] == "token") == events[-1]["answer"] == "[E1] f: two words" and events[-1]["sources"] == ["f"]
    assert list(agent.Agent(lambda q: []).events("  "))[0]["reason"] == "empty"
    plan = {"goal": "g", "steps": [{"tool": "python_repl", "params": {"code": "print(3)"}}, {"tool": "generate_response"}]}
    assert list(agent.Agent(lambda q: [], agent.Planner(lambda p: json.dumps(plan))).events("q"))[-1]["answer"] == "3"
    assert agent.verify("q", "", [])["missing_points"] == ["q"] and agent.verify("q", "c", ["s"])["sufficient"]


def test_embedder_failures_are_told(spark):
    class Odd:
        dimension = 2

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[1.0, 0.0] for _ in texts]

    rows = {r["text"]: r for r in providers.embed(spark.createDataFrame([("good",), ("bad",)], "text string").coalesce(1), Odd()).collect()}
    assert rows["good"]["embedding"] == [1.0, 0.0] and rows["bad"]["embedding"] is None and "bad text" in rows["bad"]["embed_error"]
    assert providers.embedder("mock", dimension=8).dimension == 8
    with pytest.raises(ValueError):
        providers.embedder("none")


def test_rerankers_by_name(spark):
    hits = spark.createDataFrame([("valve open", "the valve", ["PT-1"], 0.5, 0)], "question string, text string, tags array<string>, score double, rank int")
    score = lambda name, model=None: hits.select(rerank.reranker(name, model)(hits).alias("s")).first()["s"]
    assert score("lexical") == score("model") == 0.55 and score("mock") == 2.0
    assert score("model", lambda q, t: [0.25]) == 0.25 and score("model", lambda q, t: 1 / 0) == 0.55
    with pytest.raises(ValueError):
        rerank.reranker("none")


def test_clusters_find_what_the_exact_search_finds(spark):
    from support import DATA

    from millrace.operators import dense

    vectors = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = {(r["qid"], r["doc"]) for r in dense.search(vectors, asked, 10).collect()}
    index = dense.build_clusters(vectors)
    assert index.vectors.count() == vectors.count()
    assert {(r["qid"], r["doc"]) for r in dense.search_clusters(index, asked, 10, 4).collect()} == exact
    found = {(r["qid"], r["doc"]) for r in dense.search_clusters(index, asked, 10, len(index.centres) // 2, exact=False).collect()}
    assert len(found & exact) >= 0.9 * len(exact), len(found & exact) / len(exact)
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert dense.build_clusters(odd, clusters=2).vectors.count() == 2 and dense.build_clusters(odd.where("false")).vectors.count() == 0


def test_caches():
    lru, fifo = Cache(2), Cache(2, touch=False)
    for c in (lru, fifo):
        c.put("a", 1)
        c.put("b", 2)
        assert c.get("a") == 1
        c.put("c", 3)
    assert lru.get("b") is None and lru.get("a") == 1 and fifo.get("a") is None and fifo.get("b") == 2


def test_expansion_of_questions(spark):
    q = spark.createDataFrame([(1, "relief valve at the CDU"), (2, "  "), (3, "limit of PT-101"), (4, "error 0x1F")], "qid long, text string")
    rows = {r["qid"]: r for r in fusion.prepare(q, ontology.table(spark)).collect()}
    assert set(rows) == {1, 3, 4} and rows[1]["dense_query"].startswith("relief valve at the CDU (Crude Distillation Unit PSV) | relief valve at the CDU | Context: CDU")
    assert rows[1]["lexical_query"].startswith("relief valve at the CDU Crude Distillation Unit") and [rows[k]["tagged"] for k in (1, 3, 4)] == [False, True, True]


def test_triples_without_a_model(spark):
    text = "x" * 100 + " PT-101 measures the XV-20 and XV-20 feeds C-1."
    rows = graph.triples(spark.createDataFrame([(1, text), (2, "PT-1 feeds C-1")], "doc long, text string")).collect()
    assert [(r["src"], r["relation"], r["dst"]) for r in rows] == [("PT-101", "measures", "XV-20"), ("XV-20", "feeds", "C-1")]


def test_names_of_tags(spark):
    rows = spark.createDataFrame([("PT-1", ["pt-1"], "x"), ("PT-1", None, "at pt-1!"), ("PT-1", None, None), ("PT-1", [], "none")], "tag string, tags array<string>, text string")
    assert [r[0] for r in rows.select(evidence.names(F.col("tag"), F.col("tags"), F.col("text"))).collect()] == [True, True, False, False]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder, index = tmp_path_factory.mktemp("files"), tmp_path_factory.mktemp("index")
    (folder / "sop_pressure.txt").write_text("The trip limit of PT-101 is 12.5 bar(g). XV-301 closes in 5 seconds when PT-101 trips. " * 3)
    (folder / "pump.pdf").write_bytes(make_pdf(["Pump P-200 runs at 2900 rpm and feeds the column C-101 in normal operation.", "Second page of the pump manual, with seal data and so on for this pump."]))
    (folder / "report.xlsx").write_bytes(sinks.excel([{"tag": "PT-101", "value": 12.5}]))
    (folder / "broken.docx").write_bytes(b"no zip")
    (folder / "empty.txt").write_text("  ")
    e = Engine(spark, str(index), threshold=0.01)
    e.folder = str(folder)
    e.first = e.sync(e.folder)
    return e


def test_sync_reads_once_and_tells_failures(engine):
    assert engine.first == {"indexed": 3, "updated": 0, "skipped": 0, "deleted": 0, "failed": 1, "empty": 1, "ocr_processed": 0, "ocr_failed": 0}
    assert [d["filename"] for d in engine.list_registered_documents()] == ["pump.pdf", "report.xlsx", "sop_pressure.txt"]
    assert {d["filename"]: d["chunk_count"] for d in engine.list_registered_documents()} == {"pump.pdf": 2, "report.xlsx": 2, "sop_pressure.txt": 1}


def test_answers_and_tools(engine):
    found = engine.search("trip limit of PT-101", 2)
    assert found["found"] and found["sources"][0]["filename"] in ("sop_pressure.txt", "report.xlsx") and "[E1]" in found["context"]
    answer = engine.answer("trip limit of PT-101")
    assert "PT-101" in answer["answer"] and engine.answer("Trip limit of PT-101!") is answer
    stream = list(engine.answer_stream("trip limit of PT-101"))
    assert "".join(e["text"] for e in stream[:-1]) == answer["answer"] and stream[-1]["type"] == "done"
    assert engine.answer("hello")["sources"] == [] and engine.search(" ")["found"] is False
    tag = engine.tool("lookup_equipment_tag", tag=" pt-101 ")
    assert tag["tag"] == "PT-101" and tag["matches_found"] >= 2 and tag["dossier"]["origin"] == "mined" and "ASSET PT-101" in tag["dossier"]["box"]
    assert engine.tool("lookup_equipment_tag", tag="ZZ-999")["dossier"] is None
    assert "[E1]" in engine.tool("search_internal_knowledge", query="trip limit of PT-101", top_k=2)
    seen = engine.tool("inspect_scanned_document", file_path=f"{engine.folder}/pump.pdf", page_number=1)
    assert seen["success"] and "P-200" in seen["detected_industrial_tags"] and not engine.inspect_scanned_document(f"{engine.folder}/broken.docx")["success"]
    assert engine.tool("get_airgap_status")["compliant"] and {t["function"]["name"] for t in TOOLS} >= {"lookup_equipment_tag", "get_airgap_status"}
    with pytest.raises(ValueError):
        engine.tool("recreate")


def test_models_are_put_in(engine):
    engine.call, asked = (lambda p: asked.append(p) or ("limit of PT-101 trip" if "Rewrite" in p else "By the model [E1]")), []
    try:
        out = engine.answer("what about it", history=[("Which tag trips?", "PT-101")])
        assert out["answer"].startswith("By the model [E1]") and len(asked) == 2 and "Which tag trips?" in asked[0] and "limit of PT-101 trip" in asked[1]
        engine.call = lambda p: 1 / 0
        assert engine.answer("limit of PT-101 please")["answer"].startswith("From ")
    finally:
        engine.call = None


def test_agent_evaluation_and_health(engine, tmp_path):
    events = list(engine.run("trip limit of PT-101"))
    assert events[0]["type"] == "plan" and events[-1]["sources"]
    totals = engine.evaluate(save=str(tmp_path / "e"))
    assert totals["questions"] == 5 and totals["hits"] >= 1 and totals["mean_latency_ms"] >= 0
    assert engine.health()["index"].startswith("3 documents") and engine.health()["recognition"] == "MockEngine"
    made = engine.synthetic_questions(5, lambda t: {"query": "what?", "answer": t[:10]}, str(tmp_path / "qa"))
    assert made == 1


def test_sync_follows_changes(engine, spark):
    from pathlib import Path

    folder = Path(engine.folder)
    (folder / "sop_pressure.txt").write_text("The trip limit of PT-101 was raised to 14 bar(g).")
    (folder / "report.xlsx").unlink()
    (folder / "empty.txt").write_text("No longer empty.")
    assert engine.sync(engine.folder) == {"indexed": 1, "updated": 1, "skipped": 1, "deleted": 1, "failed": 1, "empty": 0, "ocr_processed": 0, "ocr_failed": 0}
    texts = [r["text"] for r in engine.tables()["chunks"].select("text").collect()]
    assert any("14 bar" in t for t in texts) and not any("12.5" in t for t in texts)
    (folder / "sop_pressure.txt").rename(folder / "sop_pressure.docx")  # now unreadable under another name
    counts = engine.sync(engine.folder)
    assert counts["deleted"] == 1 and counts["failed"] == 2
    engine.recreate()
    assert engine.tables() is None and engine.documents().count() == 0
    with pytest.raises(LookupError):
        engine.retrieve(["x"])


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from millrace.__main__ import main

    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.txt").write_text("The set pressure of PSV-9 is 7 bar and it opens at once when that is reached.")
    (folder / "p.png").write_bytes(images.write_png(np.zeros((4, 4), np.uint8)))
    run = lambda *a: (main(["--index", str(tmp_path / "i"), "--threshold", "0.01", *a], spark), capsys.readouterr().out)[1]
    assert json.loads(run("sync", str(folder)))["indexed"] == 2
    assert "7 bar" in run("ask", "set pressure of PSV-9") and json.loads(run("tag", "PSV-9"))["matches_found"] >= 1
    monkeypatch.setattr("sys.stdin", io.StringIO("set pressure of PSV-9\n"))
    assert "7 bar" in run("chat") and json.loads(run("eval"))["questions"] == 5
    assert len(json.loads(run("list"))) == 2 and "documents" in run("check") and json.loads(run("ocr", str(folder / "p.png")))["success"]
    assert json.loads(run("benchmark", str(folder)))["pages"] == 1 and "done" in run("agent", "set pressure of PSV-9")


def test_failed_documents_keep_what_is_known(spark):
    known = spark.createDataFrame([("d1", "a", "/a", "h", "txt", "c", "t", "indexed", None, None, 0, 3)], "document_id string, filename string, path string, file_hash string, file_type string, category string, document_type string, status string, created_at timestamp, updated_at timestamp, ocr_used int, chunk_count int")
    changes = spark.createDataFrame([("/a", "d1", "new", "updated")], "path string, document_id string, file_hash string, change string")
    none = providers.embed(spark.createDataFrame([], "document_id string, ocr_used boolean, file_type string, category string, document_type string, filename string, chunk_index long, text string"), providers.MockEmbedder())
    errors = spark.createDataFrame([("/a", "OCR failed")], "path string, error string")
    done = sync.outcomes(changes, none, errors)
    assert sync.totals(done).first().asDict() | {} == {"indexed": 0, "updated": 0, "skipped": 0, "deleted": 0, "failed": 1, "empty": 0, "ocr_processed": 0, "ocr_failed": 1}
    assert sync.registered(known, done, F.current_timestamp()).first()["file_hash"] == "h"
    assert lexical.searchable_text  # what the index reads of chunks
