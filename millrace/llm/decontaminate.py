"""Benchmark decontamination as a prefix-filtered set join of built-in operators only.

The windows of the benchmark are the small side.  A first pass over the documents counts the benchmark's shingles, and
nothing else.  Each window then needs one prefix token, its rarest shingle over all documents: a text that contains the
window contains that shingle too (the threshold is full containment, so the necessary prefix has length one).  A second
pass joins the documents' shingles with these few; the shingle's place in the window gives where the window would begin,
length and position bounds drop what cannot fit, and the words that stand there decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import exprs as X
from millrace.llm.storage import written

#: Rows of shingles (16 to 32 bytes each) that are broadcast at once; beyond that the documents are read in several passes.
BROADCAST_SHINGLES = 500_000


def _hash(width: int) -> str:
    """The shingle that begins at place ``pos`` of the words ``w``, null beyond the last; a hash knows its width."""
    at = ", ".join(f"get(w, pos + {k})" for k in range(width))
    return f"if(pos + {width} <= size(w), xxhash64({width}, {at}), null)"


def _places(texts: DataFrame, widths: list[int]) -> DataFrame:
    """``texts`` (key, words w) with a row for each place ``pos`` and shingle ``h``: loops of generated code, no arrays of hashes."""
    rows = texts.select("*", F.posexplode("w").alias("pos", "word")).drop("word")
    if len(widths) == 1:
        return rows.withColumn("h", F.expr(_hash(widths[0])))
    return rows.withColumn("h", F.explode(F.expr(f"array({', '.join(map(_hash, widths))})")))


def _in_blocks(rows: DataFrame, name: str, one_pass) -> DataFrame:
    """What ``one_pass`` finds for the rows of a small side (column ``h``), dealt into blocks that may be broadcast."""
    blocks = max(1, -(-rows.count() // BROADCAST_SHINGLES))
    found = None
    for k in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == k) if blocks > 1 else rows
        part = written(one_pass(F.broadcast(mine)), name)
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, share: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    with_key: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words, n_hit, n_items, items`` (sorted array) and ``contaminated``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.  A
    document word inside any occurrence of a window is hit; ``items`` have an occurring window; ``contaminated`` is
    ``n_hit > 0 and share * n_hit >= n_words``.

    Null or empty texts have no words and are never hit; null or wordless items have no windows; an item whose id is
    null still hits words but is not listed.  Repeated rows of either table are judged alike, each document row giving
    a row.  Extra columns are ignored, whatever their names.  Texts are taken whole.  ``with_key`` adds the row's
    ``__key`` (``exprs.with_row_key``), by which verdicts join back where ids are null or repeated.
    """
    key = ["__key"] if with_key else []
    docs = X.with_row_key(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__t")), "__id", "__t")
    texts = docs.select("__key", F.expr(X.plain_words("__t")).alias("w"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.expr(X.plain_words(f"`{item_text_col}`")).alias("w")).where("size(w) > 0")
    windows = items.select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")).alias("win")).distinct()
    windows = written(windows, "decontaminate-windows")
    widths = sorted(r[0] for r in windows.select(F.least(F.size("win"), F.lit(shingle)).alias("s")).distinct().collect())  # at most `shingle` rows
    words = F.expr("cast(size(w) as bigint)").alias("n_words")
    if not widths:
        none = docs.select("__id", "__key", F.expr(X.plain_words("__t")).alias("w"))
        return none.select(
            F.col("__id").alias(id_col), words, F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"),
            F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"), *key,
        )
    distinct = windows.select("win", F.col("win").alias("w")).distinct()
    per_width = [_places(distinct.where(F.least(F.size("win"), F.lit(shingle)) == s), [s]).select("win", F.col("pos").alias("offset"), "h").where("h IS NOT NULL") for s in widths]
    wanted = per_width[0]
    for more in per_width[1:]:
        wanted = wanted.unionByName(more)
    wanted = written(wanted, "decontaminate-shingles")

    def count(index: DataFrame) -> DataFrame:
        return _places(texts.select("w"), widths).select("h").join(index, "h").groupBy("h").agg(F.count("*").alias("c"))

    counts = _in_blocks(wanted.select("h").distinct(), "decontaminate-counts", count)
    # The rarest shingle of each window over all documents; a window with one that no document has cannot occur.
    rarest = wanted.join(counts, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h", "offset")).alias("p")).where("p.c > 0")
    # Windows that have a prefix token in common at one place, and one size, are one row.
    prefix = written(rarest.select("p.h", "p.offset", F.size("win").alias("m")).distinct(), "decontaminate-prefix")

    def probe(index: DataFrame) -> DataFrame:
        """Places of documents where a window would begin, with the words that stand there; a place past an end of the
        text is none.  The words are cut from the text behind the join, in the same stage, so that texts don't travel."""
        places = _places(texts, widths).join(index, "h").select("__key", "m", F.expr("pos - offset").alias("at"), "w").where("at >= 0 AND at + m <= size(w)")
        return places.select("__key", "at", "m", F.expr("slice(w, at + 1, m)").alias("win"))

    found = _in_blocks(prefix, "decontaminate-places", probe).distinct()
    found = written(found.join(windows.select("win").distinct(), "win", "left_semi"), "decontaminate-found")
    spans = "sort_array(collect_set(struct(at as a, at + m as b)))"
    union = "aggregate(v, struct(0L as n, 0 as e), (s, x) -> struct(s.n + greatest(0, x.b - greatest(s.e, x.a)) as n, greatest(s.e, x.b) as e), s -> s.n)"
    hit = found.groupBy("__key").agg(F.expr(spans).alias("v")).select("__key", F.expr(union).alias("n_hit"))
    # An item's name joins each document that it is in once.
    named = found.select("__key", "win").distinct().join(windows, "win").select("__key", "item").distinct()
    held = hit.join(named.groupBy("__key").agg(F.sort_array(F.collect_list("item")).alias("items")), "__key", "left")
    out = docs.select("__id", "__key", F.expr(f"cast(size({X.plain_words('__t')}) as bigint)").alias("n_words")).join(held, "__key", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("bigint")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(
        F.col("__id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
        F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words").alias("contaminated"), *key,
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS m, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS k
    FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM bw),
p AS (SELECT r, m, i, array_to_string(list_slice(w, i + 1, i + m), ' ') AS k
    FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT DISTINCT r, i, p.m, item_id FROM p JOIN bw ON p.m = bw.m AND p.k = bw.k),
hw AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS x FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
