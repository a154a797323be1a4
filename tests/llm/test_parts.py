"""Parts of the training operators on their own, and passes over many chunks and shards."""

import math
import random

import numpy as np
import pytest
from brute import lm
from hypothesis import given, settings
from hypothesis import strategies as st
from support import DATA, compare

from millrace.llm import catalog, chunks, mph, packing, wordhash
from millrace.llm.eliasfano import Sequence, build
from millrace.llm.encoding import Encoder

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", ["op6_substring_dedup", "op10_jaccard_join"])
def test_many_shards_give_the_same_rows(spark, monkeypatch, name):
    monkeypatch.setattr(chunks, "SHARD", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = docs.repartition(5, "doc_id")

    class Session:  # the query's table in five partitions, and so in five chunks
        def __getattr__(self, k):
            return self if k == "read" else getattr(spark, k)

        def parquet(self, path):
            return frame

    compare(spark, lambda s, d: catalog.queries()[name](Session(), d), catalog.oracle_sql()[name], SF)


def test_many_shards_of_the_trie(spark, monkeypatch):
    from millrace.llm.lmscore import lm_scores

    monkeypatch.setattr(chunks, "SHARD", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4, "doc_id")
    want = lm({r["doc_id"]: r["text"] for r in docs.collect()})
    for r in lm_scores(docs).collect():
        assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2] and r["score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)


@pytest.mark.parametrize("op", ["lines", "substring", "jaccard", "quality", "decontaminate", "licenses", "lm", "pack"])
def test_null_ids_and_repeated_rows(spark, op):
    from millrace.llm.decontaminate import decontaminate
    from millrace.llm.jaccard import jaccard_components
    from millrace.llm.licenses import license_scan
    from millrace.llm.linededup import line_dedup
    from millrace.llm.lmscore import lm_scores
    from millrace.llm.quality import quality_rules
    from millrace.llm.substring import substring_dedup

    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text), (None, text), (1, text), (1, text), (2, None), (None, None), (3, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (4, text)], "item_id long, text string")
    run = {
        "lines": line_dedup, "substring": substring_dedup, "jaccard": jaccard_components, "quality": quality_rules, "licenses": license_scan, "lm": lm_scores,
        "decontaminate": lambda d: decontaminate(d, bench), "pack": lambda d: packing.pack(d, __import__("public_tokenizers").path("word_bpe_49k.json")),
    }[op]
    out = run(docs).collect()
    assert sum(op != "pack" or r["start"] == 0 for r in out) == len(rows)
    if op == "jaccard":
        assert {r["component_id"] for r in out if r["n_shingles"] == 36} == {1} and sum(r["leads"] for r in out) == 4
    if op == "substring":  # null ids are below all others
        assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 0), (0, 0), (0, 0), (1, 40), (1, 40), (2, 0), (3, 0)]
    if op == "decontaminate":
        assert sorted(r["n_hit"] for r in out) == [0, 0, 0, 40, 40, 40, 40] and {tuple(r["items"]) for r in out if r["n_hit"]} == {("4",)}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 1000))
def test_elias_fano(values, extra):
    v = np.array(sorted(values), dtype=np.uint64)
    s = Sequence(np.frombuffer(build(v, int(v[-1]) + 1 + extra if len(v) else 1 + extra), dtype=np.uint8))
    assert s.get(np.arange(len(v))).tolist() == v.tolist()
    if len(v) > 1:
        a, b = s.get_both(np.arange(len(v) - 1))
        assert a.tolist() == v[:-1].tolist() and b.tolist() == v[1:].tolist()
    found = s.find(np.arange(0, int(v[-1]) + 1 if len(v) else 1, dtype=np.uint64))
    assert [k >= 0 for k in found] == [x in set(values) for x in range(len(found))]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_minimal_perfect_hash(n):
    r = np.random.default_rng(n)
    hi, lo = r.integers(0, 2**64, (2, n + 500), dtype=np.uint64)
    t = mph.Table(np.frombuffer(mph.build(hi[:n], lo[:n], np.arange(n), -np.arange(n)), dtype=np.uint8))
    place = t.find(hi, lo)
    assert sorted(place[:n].tolist()) == list(range(n)) and (place[n:] == -1).all()
    assert t.counts[place[:n]].tolist() == list(range(n)) and t.numbers[place[:n]].tolist() == [-k for k in range(n)]


CHARS = list("aBzéßΣİ1!.,' ") + ["  ", "\n", "\t", "\xa0", " ", "\x1c", "\x85", "﻿", "'s", "漢", "́", "<|endoftext|>", "😀", "\r\n", "word", "Word,", "ﬁ", "Å"]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoding_is_the_librarys(name, kind):
    import public_tokenizers

    e, r = Encoder(public_tokenizers.path(name), kind), random.Random(4)
    texts = ["".join(r.choice(CHARS) for _ in range(r.randint(0, 16))) for _ in range(3000)] + [None, "x" * 3000]
    for text, ids in zip(texts, e.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def cost(cuts, pos, penalty, size):
    total, price = 0, dict(zip(pos, penalty, strict=True))
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = b - a
        total += price[b] + (0 if n == size or n >= 64 and n & (n - 1) == 0 else size - n)
    return total


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 9)), min_size=1, max_size=14))
def test_cuts_are_the_cheapest(gaps):
    size, pos, penalty = 128, [0], [0]
    for g, p in gaps:
        pos.append(pos[-1] + g)
        penalty.append(p)
    found = packing.plan_cuts(pos, penalty, size)
    best = {0: 0}
    for j in range(1, len(pos)):
        best[j] = min(best[i] + cost([pos[i], pos[j]], pos, penalty, size) for i in range(j) if pos[j] - pos[i] <= size)
    assert cost(found, pos, penalty, size) == best[len(pos) - 1]


def test_word_hashes_across_blocks(monkeypatch):
    monkeypatch.setattr(wordhash, "BLOCK", 64)
    monkeypatch.setattr(wordhash, "_tables", [])
    texts = [b"one two", None, b"", b"w" * 500, b" three\tONE\n", b"x " * 200]
    h, n = wordhash.word_hashes(texts, fold=True)
    assert n.tolist() == [2, 0, 0, 1, 2, 200] and h[0] == h[4] and len(set(h.tolist())) == 5


def test_store_round_trip_and_damage(spark, edge, tmp_path):
    import public_tokenizers
    from brute import ids_of

    from millrace.llm import tokenstore

    folder = f"file://{tmp_path}/store"
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    tokenstore.write_store(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["ids"] == ids_of(texts[r["id"]], "byte_bpe_50k.json", 2) for r in tokenstore.read_ids(spark, folder).collect())
    chunks_ = spark.read.parquet(f"{folder}/draft").where("kind = 'chunk'")
    assert chunks_.count() == chunks_.select("key").distinct().count()
    chunks_.withColumn("payload", chunks_["key"]).drop("kind").write.parquet(f"{folder}2/draft/kind=chunk")
    for part in ("manifest", "parts", "store"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{folder}2/{part}")
    with pytest.raises(Exception, match="damaged"):
        tokenstore.read_digests(spark, f"{folder}2").collect()


@pytest.mark.parametrize("lost", ["n_tokens > 3", "false"])
def test_store_tells_of_a_damaged_manifest(spark, edge, tmp_path, lost):
    import public_tokenizers

    from millrace.llm import tokenstore

    folder = f"file://{tmp_path}/store"
    tokenstore.write_store(spark.read.parquet(f"{edge}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    tokenstore.check_manifest(spark, folder)
    manifest = spark.read.parquet(f"{folder}/manifest")
    # The recipe of one document goes, or two recipes of one part get each other's root.
    changed = manifest.where(f"NOT (kind = 'document' AND {lost} AND local = 0)")
    if lost == "false":
        changed = changed.withColumn("root", tokenstore.F.expr("if(kind = 'document' AND local = 0, unhex(md5('x')), root)"))
    changed.write.partitionBy("kind").parquet(f"{folder}2/manifest")
    for part in ("parts", "store"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{folder}2/{part}")
    with pytest.raises(Exception, match="damaged|missing"):
        tokenstore.check_manifest(spark, f"{folder}2")


def test_merkle_grows_by_leaves():
    from hashlib import blake2b

    from millrace.llm.tokenstore import merkle

    def plain(leaves):
        while len(leaves) > 1:
            leaves = [blake2b(b"".join(leaves[i : i + 2]), digest_size=16).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else bytes(16)

    for n in range(20):
        leaves = [bytes([k] * 16) for k in range(n)]
        assert merkle(leaves) == plain(leaves)


def test_store_of_null_ids_and_repeated_rows(spark, tmp_path):
    import public_tokenizers
    from brute import ids_of

    from millrace.llm import tokenstore

    texts = [(None, "a text"), (None, "a text"), (3, None), (3, ""), (3, "longer than the others of its id"), (1, "word " * 30_000), (2, "a text")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], "doc_id long, text string, kind string, part int, root string")
    folder = f"file://{tmp_path}/store"
    tokenstore.write_store(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(tokenstore.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    assert [(r["id"], r["ids"]) for r in rows] == [(i, ids_of(t, "byte_bpe_50k.json", 2)) for i, t in sorted(texts, key=lambda x: (x[0] or 0, len(x[1] or "")))]
    digests = sorted(tokenstore.read_digests(spark, folder).collect(), key=lambda r: r["start"])
    assert [(r["id"], r["start"], r["n_tokens"]) for r in digests] == [(r["id"], r["start"], len(r["ids"])) for r in rows]


@pytest.mark.parametrize(
    "html,text",
    [
        ("<body><div class='has-sidebar'><article><h1>T</h1><p>a <b>b</b>c &amp; d&nbsp;e<p>f<br>g<div class='share'>x</div></article></div></body>", "T\n\na bc & d e\n\nf g"),
        ("<header>x</header><div class='cookie-banner'>We use cookies</div><p>Only <i>this</i>.</p><form>f</form><footer>z</footer>", "Only this."),
        ("<ul><li><a>m1</a><li><a>m2</a><li><a>m3</a></ul><p>Text <span class='ad'>buy</span> more</p><!-- <p>no</p> --><script>'</p>'</script>", "Text more"),
        ("<p>open <!-- never ends", "open"), ("a < b", "a < b"), ("", ""), ("<section id='comments'><article>no</article></section><p>yes", "yes"),
    ],
)
def test_main_text(html, text):
    from millrace.llm.sitestyle import Page

    assert Page(html).text(set()) == text


def test_branches_that_read_alike_on_a_site_go(spark):
    from millrace.llm.sitestyle import extract_main_text

    pages = [(i, f"http://h.org/{i}", f"<div class='x'>Same words everywhere</div><div class='y'><p>Story {i} is new</p></div>") for i in range(20)]
    pages += [(99, None, None), (100, "not a url", "<div class='x'>Same words everywhere</div>")]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 is new" and got[99] == "" and got[100] == "Same words everywhere"


def main_texts(spark, pages):
    from millrace.llm.sitestyle import extract_main_text

    return {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_copies_of_a_page_keep_their_text(spark):
    page = "<html><body><div class='x'>Site line</div><article><p>{}</p></article></body></html>".format
    copied = "The story that was copied again and again, with some words to it."
    pages = [(i, "http://copies.org/a", page(copied)) for i in range(12)]
    pages += [(100 + i, "http://mixed.org/a", page(copied)) for i in range(800)]
    pages += [(1000 + i, f"http://mixed.org/{i}", page(f"Story {i} is new and has words of its own.")) for i in range(200)]
    got = main_texts(spark, pages)
    assert {got[i] for i in range(12)} == {got[100 + i] for i in range(800)} == {copied}
    assert all(got[1000 + i] == f"Story {i} is new and has words of its own." for i in range(200))


def test_pages_and_articles_are_never_noise():
    from millrace.llm.sitestyle import Page

    page = Page("<html><body><div class='w'><article><p>The article of the page.</p></article></div><div class='x'>Words</div></body></html>")
    assert page.text(set(page.path[:5])) == "The article of the page."


POST = "The post of this page goes on for some sentences. It says more than a teaser says, and it has no link. That is what the reader came for."


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<div class='post'><p>{POST}</p></div><article class='card'><h3><a>Other one</a></h3><p>Read on.</p></article><article class='card'><h3><a>Other two</a></h3></article>", POST),
        (f"<article class='x'><p>One of many.</p></article><article class='x'><p>Two of many.</p></article><div class='post'><p>{POST}</p></div>", POST),
        (f"<div class='post'><p>{POST}</p></div><article><p>A short article.</p></article>", f"{POST}\n\nA short article."),
        (f"<div class='post'><p>{POST}</p></div><div><p>And more.</p></div>", f"{POST}\n\nAnd more."),
        (f"<div><p>Beside it.</p></div><article><p>{POST}</p></article>", POST),
        (f"<div><p>Beside it.</p></div><main><div class='post'><p>{POST}</p></div></main>", POST),
    ],
)
def test_text_outside_of_articles(html, text):
    from millrace.llm.sitestyle import Page

    assert Page(html).text(set()) == text


def test_branches_that_read_alike_on_a_small_site_go(spark):
    pages = [(i, f"http://small.org/{i}", f"<div class='x'>Same words</div><div class='y'><p>Story {i} is new here.</p></div>") for i in range(4)]
    pages += [(10 + i, f"http://print.org/{i}", f"<div class='x'>Visit {i}</div><div class='y'><p>{POST}</p></div>") for i in range(4)]
    got = main_texts(spark, pages)
    assert [got[i] for i in range(4)] == [f"Story {i} is new here." for i in range(4)]
    assert all(POST in got[10 + i] for i in range(4))


def test_pipeline_stages_tell_null_and_repeated_ids_apart(spark, tmp_path):
    import corpus_pipeline as P

    words = lambda name, n=40: " ".join(f"{name}{i}é" for i in range(n))
    spark.createDataFrame([(1, words("item"))], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = lambda stage, rows: sorted((r["doc_id"] or 0, r["text"] or "") for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect())
    rows = [(None, words("item")), (None, words("clean")), (None, None), (7, words("item") + " end"), (7, words("other")), (8, words("third"))]
    assert found(P.benchmark_stage, rows) == [(0, ""), (0, words("clean")), (7, words("other")), (8, words("third"))]
    near = words("near", 200)
    rows = [(None, near), (None, near + " a"), (None, near + " b"), (None, words("clean")), (None, words("clean"))]
    assert len(found(P.near_stage, rows)) == 2
    far = words("far", 200)
    rows = [(5, near), (5, far), (4, near + " a"), (6, far + " a"), (5, far + " b"), (5, far), (9, None)]
    kept = found(P.near_stage, rows)
    assert len(kept) == 3 and (4, near + " a") in kept and {(d, t[:3]) for d, t in kept} == {(4, "nea"), (5, "far"), (9, "")}


@pytest.mark.parametrize("block", [2, 128])
def test_no_link_inside_a_component_is_lost(spark, monkeypatch, block):
    from millrace.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", block)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[: 40 * k], f"new{k}", *base[40 * k + 1 :]]) for k in range(7)] + ["a pair of its own it is", "A pair of its own it is", "alone with these words here now"]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_components(docs, links=True).collect()}
    assert got == {**dict.fromkeys(range(7), 6), 7: 0, 8: 0, 9: 0, 10: 6}


def test_related_licenses_are_told_apart(spark):
    from millrace.llm.licenses import license_scan
    from millrace.llm.notices import NOTICES

    full = {n: t for n, _, t in NOTICES if len(t) > 120}
    texts = {
        "Licensed under the GNU General Public License": "gpl", "licensed under the GNU Lesser General Public License": "lgpl", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa", "Licensed under CC BY 4.0": "cc-by", "licensed under cc by-nc-sa 4.0": "cc-by,cc-by-nc-sa", "Released under the Apache License": "apache",
        "the reserved rights of all citizens": "", "All rights reserved": "all-rights-reserved", "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "A permission to copy the software is granted by the license of the author": "", "rights all reserved": "",
        **{f"Some words before it.\n{t}\nAnd words after it, which are not part of it.": n for n, t in full.items()},
        " ".join(f"{w}\n" if k % 7 == 0 else w for k, w in enumerate(full["mit"].split())): "mit",
        " ".join(w for k, w in enumerate(full["lgpl"].split()) if k % 20 != 19): "lgpl",
        " ".join(full["mit"].split()[:60]): "",
        "word " * 4090 + full["bsd-2-clause"] + " word" * 5000 + full["gpl"] + " " + full["agpl"]: "agpl,bsd-2-clause,gpl",
    }
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, w string, found int")
    got = {r["doc_id"]: r for r in license_scan(docs).collect()}
    assert {k: r["labels"] for k, r in got.items()} == dict(enumerate(texts.values()))
    assert all(f["at"] == 4090 for r in got.values() for f in r["found"] if f["label"] == "bsd-2-clause" and r["n_words"] > 5000)


def test_templates_of_any_length(spark):
    from millrace.llm.licenses import license_scan

    long = " ".join(f"w{k * 7919 % 1009}" for k in range(1500))
    cut = " ".join(w for k, w in enumerate(long.split()) if k % 10)
    docs = spark.createDataFrame([(0, "x " * 3000 + long), (1, "y " * 100 + cut), (2, " ".join(sorted(long.split()))), (3, "ab cd"), (4, "ab"), (5, "all rights reserved " * 3000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan(docs, templates=[("long", "l", long), ("pair", "p", "AB, cd"), ("r", "r", "all rights reserved")]).collect()}
    assert {k: r["labels"] for k, r in got.items()} == {0: "long", 1: "long" if got[1]["score"] >= 0.8 else "", 2: "", 3: "pair", 4: "", 5: "r"}
    assert got[0]["score"] == 1.0
    with pytest.raises(ValueError, match="two words"):
        license_scan(docs, templates=[("x", "x", "one")])


SITE_HEAD = "<html><body><div class='a1'><p>{}</p></div><div class='b7'><ul><li><a href='/x'>One</a></li><li><a href='/y'>Two</a></li></ul></div>"


def site(host: str, n: int, start: int) -> list[tuple]:
    """Pages without article, main or telling names: a slogan out of three, a list of links, a story, a note that every page has."""
    slogans = ["Best site there is", "Come again soon", "Tell your friends"]
    story = "<div class='c3'><h2>Story {0} of {1}</h2><p>It happened on day {0} and was told by {1}.</p><p>Nothing else was said about number {0}.</p></div>"
    return [(start + i, f"http://{host}/{i}", SITE_HEAD.format(slogans[i % 3]) + story.format(i, host) + "<div class='d9'><p>Written by the same hand as ever.</p></div></body></html>") for i in range(n)]


def plain_tree(pages: list[tuple]) -> dict:
    """By host and style path: number of different pages and their contents, by the standard library's parser."""
    from collections import Counter
    from html.parser import HTMLParser
    from urllib.parse import urlparse

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.nodes = [[(), [], []]], []
            self.nodes.append(self.stack[0])

        def handle_starttag(self, tag, attrs):
            node = [(*self.stack[-1][0], tag + "".join(f".{v}" for k, v in attrs if k == "class")), [], []]
            node[0] = tuple(x.translate(str.maketrans("123456789", "000000000")) if "." in x else x for x in node[0])
            self.stack[-1][2].append(tag)
            self.stack.append(node)
            self.nodes.append(node)

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            for n in self.stack:
                n[1].append(data)

    seen: dict = {}
    for host, html in {(urlparse(u).netloc, h) for _, u, h in pages}:
        t, own = Tree(), {}
        t.feed(html)
        for path, text, children in t.nodes:
            if text and not (path and path[-1] == "a"):
                own.setdefault(path, []).append((tuple(text), tuple(children)))
        for path, what in own.items():
            seen.setdefault((host, path), []).append((tuple(x for x, _ in what), tuple(x for _, x in what)))
    share = lambda v: 1.0 if len(v) == 1 else -sum(c / len(v) * math.log(c / len(v)) for c in Counter(v).values()) / math.log(len(v))
    return {k: (len(v), share([x for x, _ in v]), share([x for _, x in v])) for k, v in seen.items()}


def test_site_tree_is_that_of_a_plain_count(spark):
    from millrace.llm.sitestyle import site_paths

    pages = site("one.org", 30, 0) + site("two.org", 5, 100) + site("one.org", 30, 200)[:4]
    rows = site_paths(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = sorted((h, m, round(read, 9), round(look, 9)) for (h, _), (m, read, look) in plain_tree(pages).items())
    assert sorted((r["host"], r["m"], round(abs(r["read"]), 9), round(abs(r["look"]), 9)) for r in rows) == want


def test_the_tree_finds_the_text_without_names_and_articles(spark):
    pages = site("big.org", 40, 0) + site("small.org", 3, 100)
    got = main_texts(spark, pages)
    for page_id, url, _ in pages:
        host, i = url.split("/")[2:]
        lines = [f"Story {i} of {host}", f"It happened on day {i} and was told by {host}.", f"Nothing else was said about number {i}."]
        small = ["Best site there is", "Come again soon", "Tell your friends"][int(i) % 3]
        assert got[page_id].split("\n\n") == (lines if host == "big.org" else [small, *lines])


def test_what_the_tree_finds_important_beside_an_article_stays(spark):
    page = "<html><body><article><p>The first part of story {0}, which is longer than what follows it on this page.</p></article><div class='q'><p>The rest of story {0}.</p></div><div class='r'><p>Read us daily.</p></div></body></html>".format
    got = main_texts(spark, [(i, f"http://h.org/{i}", page(i)) for i in range(12)])
    assert all(got[i] == f"The first part of story {i}, which is longer than what follows it on this page.\n\nThe rest of story {i}." for i in range(12))


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article><p>We say <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p><p id='feedback'>What readers told us.</p><p class='survey search-results'>Half of them.</p><label>A label.</label></article>", "We say x=2 here.\n\nWhat readers told us.\n\nHalf of them.\n\nA label."),
        (f"<article><p>{POST}</p></article><article class='teaser'><h3><a>Other story</a></h3><p>Read on.</p></article>", POST),
        (f"<article><p>{POST}</p></article><article><h3><a>Other story</a></h3><p>Read on.</p></article>", POST),
        (f"<article><p>{POST}</p></article><article><h3>Second</h3><p>{POST}</p></article>", f"{POST}\n\nSecond\n\n{POST}"),
        (f"<article><p>{POST}</p></article><section class='comments'><p>I agree.</p></section><div class='survey'>Tell us!</div>", POST),
    ],
)
def test_names_are_a_prior(html, text):
    from millrace.llm.sitestyle import Page

    assert Page(html).text(set()) == text


def test_names_in_doubt_go_by_the_tree(spark):
    page = "<article><p>Story {0} has its words.</p><div class='notice'><p>{1}</p></div></article>".format
    pages = [(i, f"http://same.org/{i}", page(i, "Our terms have changed.")) for i in range(5)] + [(10 + i, f"http://own.org/{i}", page(i, f"Note {i}.")) for i in range(5)]
    got = main_texts(spark, pages)
    assert [got[i] for i in range(5)] == [f"Story {i} has its words." for i in range(5)]
    assert [got[10 + i] for i in range(5)] == [f"Story {i} has its words.\n\nNote {i}." for i in range(5)]


def test_hard_rows_of_pages(spark):
    from millrace.llm.sitestyle import extract_main_text

    long = "<article>" + "".join(f"<p>Line {i} of it.</p>" for i in range(60_000)) + "</article>"
    rows = [(1, None, None, "a", 1), (None, "http://h.org/1", "<p>x</p>", "b", 2), (None, "http://h.org/1", "<p>x</p>", "b", 2), (2, "", "", None, None), (3, "http://[bad", "<p>y &lt; z</p>", "c", 3), (4, "http://l.org/", long, "d", 4), (5, "http://d.org/", "<div>" * 3000 + "deep", "e", 5)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host string, noise int")
    got = extract_main_text(docs).collect()
    assert sorted((str(r["page_id"]), r["url"], len(r["text"])) for r in got) == sorted((str(i), u, n) for (i, u, *_), n in zip(rows, [0, 1, 1, 0, 5, sum(len(f"Line {i} of it.") + 2 for i in range(60_000)) - 2, 4], strict=True))


def test_components_with_hot_nodes(spark, monkeypatch):
    """Nodes and keys that count as hot join by the other way, with the same result."""
    from millrace.llm import components as K

    monkeypatch.setattr(K, "HOT", 3)
    r = random.Random(8)
    edges = [(0, k) for k in range(1, 40)] + [(100, 60), (60, 61), (61, 100)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(70)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x["node"]: x["root"] for x in K.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    large = spark.createDataFrame([(1, k) for k in range(10)] + [(2, 1), (3, 2)], "k int, v int")
    small = spark.createDataFrame([(1, "hot", 10), (2, "cold", 1)], "k int, s string, c long")
    for how, n in (("left", 12), ("inner", 11)):
        rows = K.join_hot(large, small, ["k"], how).collect()
        assert len(rows) == n and {(x["k"], x["s"]) for x in rows} == {(1, "hot"), (2, "cold")} | ({(3, None)} if how == "left" else set())
        monkeypatch.setattr(K, "HOT_ROWS", 0)  # too many hot keys for a broadcast
        assert len(K.join_hot(large, small, ["k"], how).collect()) == n
        monkeypatch.setattr(K, "HOT_ROWS", 500_000)


def test_leaders_of_many_pairs_are_dealt_out(spark, monkeypatch):
    from millrace.llm import jaccard

    monkeypatch.setattr(jaccard, "PAIRS", 2)
    base = [f"word{k}" for k in range(60)]
    texts = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(0, 60, 59)] + [" ".join([*base, f"tail{k}"]) for k in range(20)] + ["something else that is on its own and shares no word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert len({got[k] for k in range(2, 22)}) == 1 and got[22] == 22
    exact = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_components(docs, links=True).collect()}
    assert all(exact[k] >= 19 for k in range(2, 22)) and exact[22] == 0


def test_shingles_in_several_passes(spark, edge, monkeypatch):
    """A benchmark whose shingles don't fit one broadcast gives the same rows."""
    from millrace.llm import decontaminate as D

    docs, bench = (spark.read.parquet(f"{edge}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = lambda: sorted(tuple(map(str, r)) for r in D.decontaminate(docs, bench).collect())
    whole = rows()
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", 15)
    assert rows() == whole


def test_words_of_a_chunk_are_cut_once():
    import re

    from public_tokenizers import path

    from millrace.llm import alignment as A

    class Cut:
        def __init__(self, pattern):
            self.pattern, self.seen = re.compile(pattern), []

        def findall(self, text):
            self.seen.append(text)
            return self.pattern.findall(text)

    cut = Cut(A.cuts(A.Pieces(path("piece_bpe_32k.model")).pieces))
    texts = ["so, it is, so, it\nis, so,", None, "", "it  is,\tso, ", "so, ", "end\n", " ", "\n", "x\r y", "漢字 a² é, ½", "is\n it", "ends\u2028", "so,\n\nso,"] * 3
    different, n, numbers = A._stretches(cut, [None if t is None else t.encode() for t in texts])
    assert cut.seen.count(" so,") == cut.seen.count(" is,") == 1
    assert len(set(different.to_pylist())) == len(different)
    found, want = iter(np.array(different)[numbers].tolist()), [cut.pattern.findall(f" {t}") if t else [] for t in texts]
    assert [[next(found) for _ in range(k)] for k in n.tolist()] == want and next(found, None) is None
