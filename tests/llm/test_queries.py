"""Registered queries against their SQL or plain versions, on ordinary and on hard tables."""

import hashlib

import pytest
from brute import alignment, crc, ids_of, lm, personal
from support import DATA, compare

from millrace.llm import catalog

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_equal_sql(spark, name):
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_hard_rows_equal_sql(spark, edge, name):
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], edge)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, empty, name):
    assert catalog.queries()[name](spark, empty).count() == 0


def documents(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def check_pieces(texts, rows):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = ids_of(texts[d], "word_bpe_49k.json", 1), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / sum(r["length"] for r in rows)


@pytest.mark.parametrize("where", ["edge", "sf"])
def test_packing(spark, edge, where):
    folder = edge if where == "edge" else SF
    assert check_pieces(documents(spark, folder), catalog.queries()["op2_packing"](spark, folder).collect()) < 0.02


@pytest.mark.parametrize("where", ["edge", "sf"])
def test_token_store(spark, edge, where):
    folder, at = edge if where == "edge" else SF, 0
    rows = {r["doc_id"]: r for r in catalog.queries()["op5_token_store"](spark, folder).collect()}
    texts = documents(spark, folder)
    assert set(rows) == set(texts)
    for d in sorted(texts):
        ids = ids_of(texts[d], "byte_bpe_50k.json", 2)
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("where", ["edge", "sf"])
def test_lm_scores(spark, edge, where):
    folder = edge if where == "edge" else SF
    want = lm(documents(spark, folder))
    rows = catalog.queries()["op9_lm_scoring"](spark, folder).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("where", ["edge", "sf"])
def test_tokenizer_alignment(spark, edge, where):
    folder = edge if where == "edge" else SF
    texts = documents(spark, folder)
    want, counts = alignment(list(texts.values()))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    rows = {r["doc_id"]: r for r in catalog.queries()["op12_tokenizer_alignment"](spark, folder).collect()}
    assert set(rows) == set(texts)
    for d, (n_a, n_b, groups, links) in zip(texts, want, strict=True):
        r = rows[d]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, len(groups.split(";")) if groups else 0, len(links)), (d, texts[d])
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert (r["n_best"], r["count_sum"]) == (sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links))


@pytest.mark.parametrize("where", ["edge", "sf"])
def test_personal_data(spark, edge, where):
    folder = edge if where == "edge" else f"{DATA}/sf0.01"
    texts = documents(spark, folder)
    rows = {r["doc_id"]: r for r in catalog.queries()["op13_personal_data"](spark, folder).collect()}
    assert set(rows) == set(texts)
    for d, text in texts.items():
        want = [f"{k}:{s}:{e}" for k, s, e in personal(text)]
        assert rows[d]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [rows[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")]
        assert [x for x in rows[d]["spans"].split(",") if x.split(":")[0] in ("email", "ip", "card", "phone")] == want
    assert where == "edge" or sum(r["n_email"] for r in rows.values()) > 5


def test_tokenizer_alignment_of_hard_texts(spark):
    """Texts that a side doesn't give back, odd white space, null and repeated ids, repeated rows, clashing columns."""
    from public_tokenizers import path

    from millrace.llm.alignment import align_tokenizers

    texts = [None, "", " ", "  ", "a\r\n\r\nb", "x \r y\r", "tab\t \ttab  two", "odd\x85 \xa0 \u3000space\u2028", "a ▁ b", "the same", "the same", "don't, won't; can't.\n\n  ok:\n", "e\u0301\u200d👩‍👩‍👧 漢字かな", "y" * 3000, "\x00\x1c <s> </s> <|endoftext|> <0x0A>", "the▁", ");\r\n};\r\n", "1,234.5 +49"]
    ids = [None if k % 5 == 0 else k // 2 for k in range(len(texts))]
    ids[9] = ids[10] = 77
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, u int, h int, pos int")
    found, pairs = align_tokenizers(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    want, counts = alignment(texts)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    key = lambda x: str(x)
    got = sorted(((r["id"], r["n_a"], r["n_b"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in found.collect()), key=key)
    assert got == sorted(((i, a, b, len(x), sum(counts[y] == best[y[1]] for y in x), sum(counts[y] for y in x), g) for i, (a, b, g, x) in zip(ids, want, strict=True)), key=key)
    assert {(r["a"], r["b"]): r["n_times"] for r in pairs.collect()} == dict(counts)


def test_aligned_texts_are_cut_once(spark, edge, monkeypatch):
    """The texts' chunk files go when their stretches are counted: rows of documents come from the numbers of those."""
    from pathlib import Path
    from urllib.parse import urlparse

    from public_tokenizers import path

    from millrace.llm import alignment as A

    staged, stage = [], A.C.stage

    def run(*args):
        staged.append(stage(*args))
        return staged[-1]

    monkeypatch.setattr(A.C, "stage", run)
    texts = documents(spark, edge)
    docs = spark.read.parquet(f"{edge}/documents.parquet").select("doc_id", "text")
    found, _ = A.align_tokenizers(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    assert len(staged) == 1 and not Path(urlparse(staged[0][0]).path).exists()
    want, _ = alignment(list(texts.values()))
    assert {r["id"]: (r["n_a"], r["n_b"], r["n_links"], r["groups"]) for r in found.collect()} == {d: (a, b, len(links), g) for d, (a, b, g, links) in zip(texts, want, strict=True)}


def test_model_beats_its_base_on_held_out_texts(spark):
    held = [r for r in catalog.queries()["op9_lm_scoring"](spark, f"{DATA}/sf0.01").collect() if r["held_out"]]
    assert len(held) > 50 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_main_text_is_the_article(spark):
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in catalog.queries()["op3_html_extraction"](spark, SF).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_quality_verdict_follows_the_labels(spark):
    from pyspark.sql import functions as F

    judged = catalog.queries()["op4_quality_rules"](spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = (judged.where(F.col("quality") == q).agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good == 1.0 and bad < 0.1


def test_pipeline(spark, edge):
    """Each stage by the SQL or plain version of its operator, on what its predecessor kept."""
    import corpus_pipeline as P
    from support import tables

    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        out = stage(spark, docs, edge)
        con = tables(edge)
        con.execute("DROP VIEW documents")
        frame = docs.toPandas()
        con.register("documents", frame)
        if k < 4:
            assert out.columns == docs.columns
            after, old = {r["doc_id"]: r for r in out.collect()}, {r["doc_id"]: r for r in before}
            assert all(len(r["text"]) == r["n_chars"] and r["words"] == "clash" for r in after.values())
        if name == "quality rules":
            assert set(after) == {r[0] for r in con.execute(f"SELECT doc_id FROM ({catalog.oracle_sql()['op4_quality_rules']}) WHERE kept").fetchall()}
        elif name == "line dedup":
            want = dict(con.execute(f"SELECT doc_id, kept_sha256 FROM ({catalog.oracle_sql()['op7_line_dedup']})").fetchall())
            assert {d: hashlib.sha256(r["text"].encode()).hexdigest() for d, r in after.items()} == want
        elif name == "n-gram Jaccard join":
            roots = con.execute(catalog.oracle_sql()["op10_jaccard_join"].replace("SELECT d.doc_id, CAST", "SELECT d.doc_id AS d, CAST")).fetchall()
            assert set(after) == {r[2] for r in roots} and all(after[d] == old[d] for d in after)
        elif name == "benchmark decontamination":
            assert set(after) == {r[0] for r in con.execute(f"SELECT doc_id FROM ({catalog.oracle_sql()['op1_decontaminate']}) WHERE NOT contaminated").fetchall()}
        else:
            check_pieces({r["doc_id"]: r["text"] for r in before}, out.collect())
        docs = out if k == 4 else spark.createDataFrame(out.collect(), out.schema)
    assert {r[0] for r in P.run(spark, edge).select("doc_id").distinct().collect()} == {r["doc_id"] for r in before}


def test_pipeline_of_hard_rows(spark, edge, tmp_path):
    """Null and repeated ids are documents of their own, repeated rows count once, clashing columns come through."""
    import random

    import corpus_pipeline as P

    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n)) + "."
    passage = spark.read.parquet(f"{edge}/benchmark.parquet").where("item_id = 5").first()["text"]
    a, b, c = prose(60), prose(60), prose(300_000)
    rows = [(None, a), (None, b), (None, f"{passage} {prose(5)}"), (7, a + " more"), (7, prose(40)), (7, prose(40)), (8, c), (8, c), (9, None), (None, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __h int, __lead int, _ int, __row int, __key int")
    spark.read.parquet(f"{edge}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = sorted((r["doc_id"] or 0, r["text"][:20], r["__h"], r["_"], r["__key"]) for r in docs.collect())
    # The passage's document goes, and one of those that are near duplicates; the long one stays once.
    assert len(left) == 5 and [i for i, *_ in left].count(7) in (2, 3) and [i for i, *_ in left].count(8) == 1 and all(x[2:] == (1, 3, 5) for x in left)
    assert not any(t.startswith(passage[:20]) for _, t, *_ in left)
    assert sum(r["length"] for r in P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) > 300_000


def test_pipeline_of_empty_tables(spark, empty):
    import corpus_pipeline as P

    assert P.run(spark, empty).count() == 0


def test_stages_leave_only_their_rows(spark, edge):
    """A run deletes what its stages wrote on their way; the last stage's plan is still to run."""
    import os

    import corpus_pipeline as P

    from millrace.shared import shared_folder

    root = os.path.dirname(shared_folder(spark, "probe").removeprefix("file:"))
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    P.run(spark, edge).count()
    left = {d.rsplit("-", 1)[0] for d in set(os.listdir(root)) - before}
    assert left == {f"pipeline-{n.replace(' ', '-').lower()}" for n, _ in P.STAGES[:-1]}
