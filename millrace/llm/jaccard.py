"""N-gram Jaccard join of documents by prefix lists, with skipping by position and answers taken over from leaders.

Equal shingle sets are one class; only classes are joined.  A first exchange counts the classes of every shingle.  In
a set's order (rarest first) only the first n - ceil(t n) + 1 shingles need lists, and those in no other class none, so
a set with enough shingles of its own drops out here.  A list's entries have the shingle's position: entries whose rests
are too short for the threshold are skipped.  In each list the set with the lowest position leads: it is compared with
the others, and what lies in its component has its answers by the leader.  Only sets of one list that are still in
different components are compared with each other afterwards.  That finds the components; where the number of links is
asked for, the sets of a component are compared with each other at last, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import chunks as C
from millrace.llm.components import HOT_ROWS, components, join_hot
from millrace.llm.memory import tidy
from millrace.llm.storage import get, written
from millrace.llm.wordhash import mix, window_hashes, word_hashes

#: Counts of classes per shingle are exact below this; more common shingles are ordered by hash.
MOST_COUNTED = (1 << 16) - 1
#: Sets of a component that are compared with as many others at once, and shingles that are looked at at once for that.
BLOCK, SLICE = 128, 4096
#: Pairs of one set that a task compares at once on average: a leader of more is dealt out over several.
PAIRS = 512


class Sets:
    """The shingle sets of a chunk's documents: ascending distinct hashes, one document after the other."""

    def __init__(self, data: bytes, width: int):
        self.ids, texts = C.read(data)
        words, counts = word_hashes(texts, fold=True)
        h = window_hashes(words, width)
        first = (np.cumsum(counts) - counts).tolist()
        parts = []
        for a, n in zip(first, counts.tolist(), strict=True):
            if n >= width:
                s = np.sort(h[a : a + n - width + 1])
                parts.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            else:
                parts.append(window_hashes(words[a : a + n], n, n) if n else np.zeros(0, np.uint64))
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.ends = np.cumsum(self.sizes)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums over each set that don't depend on an order."""
        out = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.tokens ^ np.uint64(salt)), dtype=np.uint64)])
            out.append((total[self.ends] - total[self.ends - self.sizes]).view(np.int64))
        return out[0], out[1]

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of some rows one after the other, and the row of each."""
        keep = np.zeros(len(self.sizes), dtype=bool)
        keep[rows] = True
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = keep[doc]
        return self.tokens[at], doc[at]


def _keys(tokens: np.ndarray, shards: int) -> np.ndarray:
    return C.shard_of(tokens, shards) << np.uint64(32) | (tokens & np.uint64(0xFFFFFFFF))


def _text_keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the hash that Spark's xxhash64 gives, and its bytes; a null text is the seed and 0."""
    from xxhash import xxh64_intdigest

    h = np.array([42 if t is None else xxh64_intdigest(t, seed=42) for t in texts], dtype=np.uint64).view(np.int64)
    return h, np.array([len(t or b"") for t in texts], dtype=np.int32)


def _common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of some sets shares with each of others."""
    a, b = np.concatenate(xs), np.concatenate(ys)
    of_a, of_b = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (xs, ys))
    shared, out = np.intersect1d(a, b), np.zeros((len(xs), len(ys)), dtype=np.int64)
    sides = []
    for tokens, of, n in ((a, of_a, len(xs)), (b, of_b, len(ys))):
        at = np.searchsorted(shared, tokens)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == tokens[ok]
        order = np.argsort(at[ok], kind="stable")
        sides.append((at[ok][order], of[ok][order], n))
    for start in range(0, len(shared), SLICE):
        held = []
        for at, of, n in sides:
            lo, hi = np.searchsorted(at, [start, start + SLICE])
            m = np.zeros((n, min(SLICE, len(shared) - start)), dtype=np.float32)
            m[of[lo:hi], at[lo:hi] - start] = 1
            held.append(m)
        out += (held[0] @ held[1].T).astype(np.int64)
    return out


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, with ``links`` ``n_links`` (sets other than its own that are linked
    to its set directly, all of them), ``component_id`` and ``leads`` (true for one row of each component); also ``text_hash`` (Spark's
    xxhash64) and ``text_bytes``, which tell rows of one id apart.

    A set: distinct ``width``-word shingles of the text, A-Z lower-cased, words between ASCII white space; with fewer
    words the whole sequence as one.  Sets link when their intersection is at least ``percent`` of their union;
    ``component_id`` is the smallest id reachable.  Without words a document is empty and on its own.  Ids are whole
    numbers; null ids are never the smallest (a component of them alone has a null id).  Repeated rows link with each
    other.  Extra columns are ignored; empty tables give no rows.  Shingles are 64-bit hashes, classes 128-bit sums.
    """
    t = percent
    folder, listed, shards, parts = C.stage(docs, id_col, text_col, "jaccard-chunks")
    shards = min(C.SHARDS, 3 * shards)  # a shard's sums need some ten arrays of its hashes
    bits = C.CHUNK_DOCS.bit_length() - 1

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for chunk, file in zip(rows["chunk"], rows["file"], strict=True):
                data = get(f"{folder}/{file}")
                s = Sets(data, width)
                a, b = s.digests()
                sid = (chunk << bits) + np.arange(len(s.ids))
                h, size = _text_keys(C.read(data)[1])
                yield pd.DataFrame({"id": pd.array(s.ids, dtype="Int64"), "sid": sid, "n": s.sizes, "a": a, "b": b, "h": h, "size": size})

    spread = listed.repartition(parts, "chunk")
    sets = written(spread.mapInPandas(digest, "id long, sid long, n long, a long, b long, h long, size int"), "jaccard-sets")
    classes = written(sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("sid").alias("class"), F.min("id").alias("least"), F.count("*").alias("c")), "jaccard-classes")
    leads = classes.groupBy(F.shiftright("class", bits).alias("chunk")).agg(F.collect_list((F.col("class") % (1 << bits)).cast("int")).alias("rows"))
    held = written(listed.join(leads, "chunk"), "jaccard-leads")  # at most CHUNK_DOCS rows a chunk

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for chunk, file, lead in zip(rows["chunk"], rows["file"], rows["rows"], strict=True):
                tokens, _ = Sets(get(f"{folder}/{file}"), width).of(np.asarray(lead, dtype=np.int64))
                key = np.sort(_keys(tokens, shards))
                starts = C.starts_of(key)
                n = np.minimum(np.diff(np.concatenate([starts, [len(key)]])), MOST_COUNTED).astype("<u2")
                key, out = key[starts], []
                for shard, a, b in C.runs(key >> np.uint64(32)):
                    v = (key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    out.append((shard, chunk, b - a, C.squeeze(C.planes(np.diff(v, prepend=np.uint32(0))) + C.planes(n[a:b]))))
                yield pd.DataFrame(out, columns=["shard", "chunk", "n", "data"])

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        vs, cs = [], []
        for n, data in zip(rows["n"], rows["data"], strict=True):
            raw = C.unsqueeze(data)
            vs.append(np.cumsum(C.unplanes(raw[: 4 * n], "<u4", n), dtype=np.uint32))
            cs.append(C.unplanes(raw[4 * n :], "<u2", n))
        v = np.concatenate(vs).astype(np.uint64)
        both = np.sort(v << np.uint64(32) | np.arange(len(v), dtype=np.uint64))
        at = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = C.starts_of(both >> np.uint64(32))
        total = np.minimum(np.add.reduceat(np.concatenate(cs)[at].astype(np.int64), starts), MOST_COUNTED)
        out = np.zeros(len(v), dtype="<u2")
        out[at] = np.repeat(total, np.diff(np.concatenate([starts, [len(v)]])))
        ends = np.cumsum(rows["n"].to_numpy())
        data = [C.squeeze(C.planes(out[e - n : e])) for e, n in zip(ends, rows["n"], strict=True)]
        del vs, cs, v, both, at, total
        tidy()
        return pd.DataFrame({"chunk": rows["chunk"], "shard": rows["shard"], "n": rows["n"], "data": data})

    counted = held.repartition(parts, "chunk").mapInPandas(count, "shard int, chunk long, n int, data binary")
    answers = counted.repartition(min(shards, C.TASKS), "shard").groupBy("shard").applyInPandas(add_up, "chunk long, shard int, n int, data binary")

    def index(key: tuple, chunk_rows: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        """Prefix entries of the chunk's classes, and the sets of those that have any."""
        out: dict[str, list] = {"kind": [], "sid": [], "token": [], "n": [], "pos": [], "tokens": []}
        for file, lead in zip(chunk_rows["file"], chunk_rows["rows"], strict=True):
            tokens, doc = Sets(get(f"{folder}/{file}"), width).of(np.asarray(lead, dtype=np.int64))
            k = _keys(tokens, shards)
            unique = np.sort(k)
            unique = unique[C.starts_of(unique)]
            total = np.zeros(len(unique), dtype=np.int64)
            of = {int(s): C.unplanes(C.unsqueeze(d), "<u2", n) for s, n, d in zip(answer["shard"], answer["n"], answer["data"], strict=True)}
            for shard, a, b in C.runs(unique >> np.uint64(32)):
                total[a:b] = of[shard]
            freq = total[np.searchsorted(unique, k)]
            for row, a, b in C.runs(doc):
                n = b - a
                prefix = n - -(-t * n // 100) + 1
                mine = freq[a:b]
                if int((mine < 2).sum()) >= prefix:
                    continue
                order = np.lexsort((tokens[a:b], mine))[:prefix]
                pos = np.flatnonzero(mine[order] > 1)
                sid = (key[0] << bits) + row
                out["kind"] += [0] * len(pos) + [1]
                out["sid"] += [sid] * (len(pos) + 1)
                out["token"] += [*tokens[a:b][order[pos]].view(np.int64).tolist(), 0]
                out["n"] += [n] * (len(pos) + 1)
                out["pos"] += [*pos.tolist(), 0]
                out["tokens"] += [None] * len(pos) + [tokens[a:b].tobytes()]
        return pd.DataFrame(out)

    left = held.repartition(parts, "chunk").groupBy("chunk")
    schema = "kind int, sid long, token long, n int, pos int, tokens binary"
    indexed = left.cogroup(answers.repartition(parts, "chunk").groupBy("chunk")).applyInPandas(index, schema)
    indexed = written(indexed, "jaccard-index", "kind")
    entries = indexed.where("kind = 0").select("token", "sid", "n", "pos")
    candidates = indexed.where("kind = 1").select("sid", "n", "tokens")

    def fits(a: str, b: str) -> str:
        """Sizes within the threshold, and the rests of both sets as long as the overlap that it needs."""
        need = f"ceil({t} * ({a}.n + {b}.n) / {100 + t})"
        return f"100 * least({a}.n, {b}.n) >= {t} * greatest({a}.n, {b}.n) AND least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {need}"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= t * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked)], ["a", "b", "linked"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Compares pairs; a set of many pairs stands in as many copies as its pairs are dealt out over."""
        pairs = written(pairs, "jaccard-pairs")
        for side, other, tokens in (("b", "a", "y"), ("a", "b", "x")):
            # Sets of more than PAIRS pairs, so at most a PAIRS-th of the pairs' number: 12 bytes each.
            often = pairs.groupBy(side).agg(F.count("*").alias("c")).where(F.col("c") > PAIRS).select(side, F.ceil(F.col("c") / PAIRS).cast("int").alias("copies"))
            often = written(often, "jaccard-often")
            sets_ = candidates.select(F.col("sid").alias(side), F.col("tokens").alias(tokens)).join(often, side, "left")
            copied = sets_.withColumn("part", F.explode(F.expr("sequence(0, coalesce(copies, 1) - 1)"))).drop("copies")
            dealt = pairs.join(near_(often), side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
            pairs = dealt.join(copied, [side, "part"]).drop("part")
        return pairs.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, linked boolean")

    def near_(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= HOT_ROWS else rows

    first = entries.groupBy("token").agg(F.min(F.struct("pos", "n", "sid")).alias("f"), F.count("*").alias("c")).where("c > 1")
    leaders = first.select("token", "f.*")
    pairs = entries.alias("e").join(leaders.alias("l"), "token").where(f"e.sid <> l.sid AND {fits('e', 'l')}")
    pairs = pairs.select(F.least("e.sid", "l.sid").alias("a"), F.greatest("e.sid", "l.sid").alias("b")).distinct()
    known = written(verified(pairs), "jaccard-known")
    labels = components(known.where("linked"))
    placed = entries.join(first.select("token"), "token").join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    placed = written(placed.select("token", "sid", "n", "pos", F.coalesce("root", "sid").alias("root")), "jaccard-placed")
    split = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    rest = written(placed.join(split, "token"), "jaccard-rest")
    # Components of a list that could hold a link at all, by their longest rests and sizes; then their members.
    groups = rest.groupBy("token", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("room"))
    near = f"p.root < q.root AND 100 * p.hi >= {t} * q.lo AND 100 * q.hi >= {t} * p.lo AND least(p.room, q.room) >= ceil({t} * (p.lo + q.lo) / {100 + t})"
    near = groups.alias("p").join(groups.alias("q"), "token").where(near).select("token", F.col("p.root").alias("r"), F.col("q.root").alias("s"))
    left = near.join(rest.withColumnRenamed("root", "r"), ["token", "r"]).select("token", "s", F.struct("sid", "n", "pos").alias("x"))
    cross = left.join(rest.select("token", F.col("root").alias("s"), F.struct("sid", "n", "pos").alias("y")), ["token", "s"]).where(fits("x", "y"))
    cross = cross.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()
    more = written(verified(cross.join(known.select("a", "b"), ["a", "b"], "left_anti")), "jaccard-more")
    labels = components(known.where("linked").unionByName(more.where("linked")).select("a", "b"))

    def count_links(rows: pd.DataFrame) -> pd.DataFrame:
        """The links of two blocks' sets with each other, or of a block's own."""
        p, q = rows["p"].iloc[0], rows["q"].iloc[0]
        blocks = [rows[rows["own"] == k] for k in (p, q)]
        if not len(blocks[0]) or not len(blocks[1]):  # a block that no set fell into
            return pd.DataFrame({"class": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        x, y = ([np.frombuffer(s, dtype="<u8") for s in b["tokens"]] for b in blocks)
        common = _common(x, y)
        linked = 100 * common >= t * (np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None] - common)
        if p == q:
            np.fill_diagonal(linked, False)
        out = [(blocks[0]["node"].to_numpy(), linked.sum(axis=1)), (blocks[1]["node"].to_numpy(), linked.sum(axis=0))][: 1 if p == q else 2]
        return pd.DataFrame({"class": np.concatenate([n for n, _ in out]), "n": np.concatenate([c for _, c in out]).astype(np.int64)})

    def degrees() -> DataFrame:
        """``class, n_links`` of the sets that have any.  All sets of a component are compared, but for pairs on their own."""
        placed = labels.join(labels.groupBy("root").agg(F.count("*").alias("k")), "root")
        placed = written(placed.withColumn("blocks", F.expr(f"cast(ceil(k / {BLOCK}) as int)")), "jaccard-members")
        members = candidates.select(F.col("sid").alias("node"), "tokens").join(placed.where("k > 2"), "node")
        dealt = members.withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        dealt = dealt.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "tokens")
        counted = dealt.groupBy("root", "p", "q").applyInPandas(count_links, "class long, n long").groupBy("class").agg(F.sum("n").alias("n_links"))
        return counted.unionByName(placed.where("k = 2").select(F.col("node").alias("class"), F.lit(1).cast("long").alias("n_links")))

    found = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"), F.min("class").alias("lead"))
    found = found.join(least, "root")
    counted = ["n_links"] if links else []
    if links:
        found = found.join(degrees(), "class", "left")
    found = found.select("n", "a", "b", "c", "component_id", *counted, "root")
    rows = join_hot(sets, found, ["n", "a", "b"])
    chosen = rows.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "sid")).alias("c")).select(F.col("c.sid").alias("sid"), F.lit(True).alias("leads"))
    return rows.join(chosen, "sid", "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("leads", F.lit(False)).alias("leads"),
        F.col("h").alias("text_hash"), F.col("size").alias("text_bytes"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def links_query(spark, sf_dir: str) -> DataFrame:
    """The join with each document's number of links, all of them."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=True).select("doc_id", "n_shingles", "n_links", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
#: The same with the number of sets that are linked to a document's own; documents of one set have one of them as key.
LINKS_SQL = (
    SQL[: SQL.rindex("SELECT d.doc_id")].rstrip()
    + r""",
e AS (SELECT p.a, min(p.b) AS b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE c = x.n AND c = y.n GROUP BY p.a),
k AS (SELECT d.doc_id, least(d.doc_id, coalesce(e.b, d.doc_id)) AS k FROM d LEFT JOIN e ON e.a = d.doc_id),
g AS (SELECT l.a, count(DISTINCT y.k) AS n_links FROM l JOIN k x ON x.doc_id = l.a JOIN k y ON y.doc_id = l.b WHERE x.k <> y.k GROUP BY l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g ON g.a = d.doc_id
"""
)
