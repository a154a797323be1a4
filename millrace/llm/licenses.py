"""License scan: an exact set-similarity join of text blocks with license templates, in built-in operators only.

The tokens of a set are pairs of neighbouring words, so that order counts.  A template of at most S words (S a power of
two) is held against blocks of 2 S words that start every S words: any S words in a row lie whole in a block, however
their lines are wrapped, and templates may have any length.  The template side is a fixed list and becomes a literal
index.  Tokens have one global order, by how many documents hold the rarer of their words.  A template of n tokens with
threshold t needs o = ceil(t n) of them in a block, so a block must hold one of its n - o + 1 first (prefix), at least o
template tokens at all (length), and as many from its first hit on in the order (position).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import exprs as X
from millrace.llm.notices import NOTICES

#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words between the starts of a template's blocks, at least; words that are looked at together, a multiple of all steps.
LEAST_STEP, SEGMENT = 8, 4096
_FOUND = "array<struct<label:string,at:bigint,words:bigint,containment:double>>"


def words_of_template(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def step_of(n_words: int) -> int:
    """The least power of two that isn't below the words of a template."""
    return max(LEAST_STEP, 1 << (n_words - 1).bit_length())


def _sql(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"array({', '.join(map(_sql, value))})" if isinstance(value, (list, tuple)) else str(value)


def license_scan(
    docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str, str]] = NOTICES, phrases: dict[str, str] = PHRASES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words, n_base, first_word, last_word, base_labels, found, labels, score``.

    Base: places (word numbers from 0) where the words of a phrase stand consecutively.  A template (label, family, text
    of two words or more) matches a block if its containment, |block and template| over |template| on distinct pairs of
    words, is at least ``threshold``.  ``found``: a struct (label, at, words, containment) for each match, from the
    first of the template's pairs in the block to the last; a match goes if one of its family that shares a word with it
    has a higher containment, or an equal one of a template with more pairs (equal in both: both stay).  ``labels``: base
    labels and those found.  ``score``: 1 with a base place, else the largest containment found, else 0.

    Null and empty texts have no words, no labels and score 0.  Texts of any length are read whole, in segments, so that
    the work grows with the length.  Empty tables give empty results; repeated rows are judged alike; columns other than
    the two named are ignored.  The global order needs one count per template word, some hundred rows.
    """
    words = [words_of_template(t) for _, _, t in templates]
    if any(len(w) < 2 for w in words):
        raise ValueError("a template needs two words")
    vocabulary = sorted({w for t in words for w in t})
    d = docs.select(F.col(f"`{id_col}`").alias("__id"), F.expr(X.plain_words(f"`{text_col}`")).alias("w"))
    held = d.select(F.explode(F.expr(f"array_intersect({_sql(vocabulary)}, w)")).alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    counts = {r["t"]: r["c"] for r in held.collect()}  # at most one row for each word of the templates
    rarer = lambda pair: min(pair.split(), key=lambda x: (counts.get(x, 0), x))
    place = lambda pair: (counts.get(rarer(pair), 0), pair)
    order = [sorted({f"{a} {b}" for a, b in zip(t, t[1:], strict=False)}, key=place) for t in words]
    need = [math.ceil(round(threshold * len(t), 9)) for t in order]
    index: dict[str, list[int]] = {}
    for k, t in enumerate(order):
        for pair in t[: len(t) - need[k] + 1]:
            index.setdefault(pair, []).append(k)
    steps = [step_of(len(t)) for t in words]
    segment = max(SEGMENT, 4 * max(steps))
    ordered = _sql(sorted({p for t in order for p in t}, key=place))
    rare = _sql(sorted({rarer(p) for p in index}))
    entries = f"array({', '.join(f'named_struct({_sql('t')}, {_sql(p)}, {_sql('e')}, {_sql(ks)})' for p, ks in sorted(index.items()))})"
    families = sorted({f for _, f, _ in templates})
    step, least, size = (f"get({_sql(x)}, {{}})" for x in (steps, need, [len(t) for t in order]))
    label, family, texts = (f"get({_sql(x)}, {{}})" for x in ([n for n, _, _ in templates], [families.index(f) for _, f, _ in templates], order))
    # A segment's pairs that are in any template, in global order (inter), and where they stand (hits: i, place in inter).
    hits = "filter(transform(bg, (t, i) -> struct(i as i, array_position(inter, t) as g)), h -> h.g > 0)"
    inside = f"h.i >= c.n * {step.format('c.k')} AND h.i + 1 < (c.n + 2) * {step.format('c.k')}"
    # Blocks that hold a prefix pair of a template, with the place of the first such pair; blocks belong to the segment in which they start.
    starts = f"filter(transform(array(-1, 0), o -> struct(k as k, h.i div {step.format('k')} + o as n, x.g as g, h.i as i)), c -> c.n >= 0 AND c.n * {step.format('c.k')} < {segment} AND c.i + 1 < (c.n + 2) * {step.format('c.k')})"
    prefixed = f"filter(transform(inter, (t, z) -> struct(z + 1 as g, get(filter({entries}, e -> e.t = t), 0).e as e)), x -> x.e IS NOT NULL)"
    candidates = f"flatten(transform({prefixed}, x -> flatten(transform(filter(hits, h -> h.g = x.g), h -> flatten(transform(x.e, k -> {starts}))))))"
    blocks = "transform(array_distinct(transform(cs, c -> struct(c.k as k, c.n as n))), c -> struct(c.k as k, c.n as n, array_min(transform(filter(cs, y -> y.k = c.k AND y.n = c.n), y -> y.g)) as g))"
    # Length and position: template pairs of the block that don't come before its first prefix pair; then the verification.
    enough = f"size(array_distinct(transform(filter(hits, h -> {inside} AND h.g >= c.g), h -> h.g))) >= {least.format('c.k')}"
    theirs = f"filter(hits, h -> {inside} AND array_contains({texts.format('c.k')}, get(inter, cast(h.g - 1 as int))))"
    measured = X.let(theirs, "m", f"struct(c.k as k, size(array_distinct(transform(m, h -> h.g))) as o, {segment}L * s + m[0].i as at, m[size(m) - 1].i - m[0].i + 2L as words)")
    verified = f"filter(transform(filter(bs, c -> {enough}), c -> {measured}), x -> x.o >= {least.format('x.k')})"
    per_segment = X.let(
        "transform(sequence(0, size(ws) - 2), i -> concat(get(ws, i), ' ', get(ws, i + 1)))", "bg",
        X.let(f"array_intersect({ordered}, bg)", "inter", X.let(hits, "hits", X.let(candidates, "cs", X.let(blocks, "bs", verified)))),
    )
    matches = "array<struct<k:int,o:int,at:bigint,words:bigint>>"
    per_segment = X.let(
        f"slice(w, {segment} * s + 1, {segment + 2 * max(steps)})", "ws",
        f"if(size(ws) < 2 OR NOT arrays_overlap(ws, {rare}), cast(array() as {matches}), cast({per_segment} as {matches}))",
    )
    everywhere = f"array_distinct(flatten(transform(sequence(0, (size(w) - 1) div {segment}), s -> {per_segment})))"
    share = lambda x: f"{x}.o / {size.format(f'{x}.k')}"
    better = f"({share('y')} > {share('x')} OR {share('y')} = {share('x')} AND {size.format('y.k')} > {size.format('x.k')})"
    beaten = f"exists(ms, y -> {family.format('y.k')} = {family.format('x.k')} AND y.at < x.at + x.words AND x.at < y.at + y.words AND {better})"
    found = X.let(everywhere, "ms", f"transform(filter(ms, x -> NOT {beaten}), x -> struct({label.format('x.k')} as label, x.at as at, x.words as words, {share('x')} as containment))")
    found = f"if(size(w) < 2 OR NOT arrays_overlap(w, {rare}), cast(array() as {_FOUND}), cast({found} as {_FOUND}))"
    places = []
    for phrase, name in phrases.items():
        p = phrase.split()
        test = " AND ".join(f"coalesce(get(w, i + {k}) = {_sql(x)}, false)" for k, x in enumerate(p))
        last = _sql(p[-1])  # the rarer end first: most texts are settled by one look
        places.append(f"if(array_contains(w, {last}) AND array_contains(w, {_sql(p[0])}), transform(filter(sequence(0, size(w) - 1), i -> {test}), i -> struct(cast(i as bigint) as at, {_sql(name)} as label)), cast(array() as array<struct<at:bigint,label:string>>))")
    d = d.select("__id", F.expr("cast(size(w) as bigint)").alias("n_words"), F.expr(f"sort_array(concat({', '.join(places)}))").alias("base"), F.expr(found).alias("found"))
    return d.select(
        F.col("__id").alias(id_col), "n_words", F.expr("cast(size(base) as bigint)").alias("n_base"),
        F.expr("get(base, 0).at").alias("first_word"), F.expr("get(base, size(base) - 1).at").alias("last_word"),
        F.expr("array_join(sort_array(array_distinct(transform(base, x -> x.label))), ',')").alias("base_labels"),
        "found",
        F.expr("array_join(sort_array(array_distinct(concat(transform(base, x -> x.label), transform(found, x -> x.label)))), ',')").alias("labels"),
        F.expr("if(size(base) > 0, 1D, coalesce(array_max(transform(found, x -> x.containment)), 0D))").alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


_PHRASE_ROWS = ", ".join(f"({p.split()!r}, '{v}')" for p, v in PHRASES.items())
_NOTICE_ROWS = ", ".join("({}, '{}', '{}', '{}')".format(k, n, f, " ".join(words_of_template(t))) for k, (n, f, t) in enumerate(NOTICES))
#: By the definition: each pair of words of a text that a template has, in each block that holds it; no order, no filter.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ph(p, label) AS (VALUES {_PHRASE_ROWS}),
b AS (SELECT r, i, label FROM (SELECT r, w, p, label, unnest(range(0, len(w) - len(p) + 1)) AS i FROM d, ph WHERE list_has_all(w, p)) WHERE list_slice(w, i + 1, i + len(p)) = p),
ba AS (SELECT r, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY r),
te AS (SELECT k, label, family, string_split(t, ' ') AS tw FROM (VALUES {_NOTICE_ROWS}) v(k, label, family, t)),
tp AS (SELECT DISTINCT k, tw[i] || ' ' || tw[i + 1] AS pair FROM (SELECT k, tw, unnest(range(1, len(tw))) AS i FROM te)),
tn AS (SELECT k, count(*) AS n FROM tp GROUP BY k),
ts AS (SELECT k, label, family, n, greatest({LEAST_STEP}, CAST(pow(2, ceil(log2(len(tw)))) AS BIGINT)) AS step FROM te JOIN tn USING (k)),
dp AS (SELECT r, i, w[i + 1] || ' ' || w[i + 2] AS pair FROM (SELECT r, w, unnest(range(0, len(w) - 1)) AS i FROM d)),
h AS (SELECT r, i, k, pair, step, unnest([i // step - 1, i // step]) AS nr FROM dp JOIN tp USING (pair) JOIN ts USING (k)),
m AS (SELECT r, k, nr, count(DISTINCT pair) AS o, min(i) AS fro, max(i) + 2 AS upto FROM h
    WHERE nr >= 0 AND i + 2 <= step * nr + 2 * step GROUP BY r, k, nr),
f AS (SELECT DISTINCT r, k, label, family, n, fro, upto, o / n AS c FROM m JOIN ts USING (k) WHERE o >= ceil(round(0.8 * n, 9))),
g AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.r = x.r AND y.family = x.family AND y.fro < x.upto AND x.fro < y.upto
    AND (y.c > x.c OR y.c = x.c AND y.n > x.n))),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM g) GROUP BY r),
sc AS (SELECT r, max(c) AS c FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(ba.n, 0) AS BIGINT) AS n_base, CAST(ba.f AS BIGINT) AS first_word, CAST(ba.l AS BIGINT) AS last_word,
    coalesce(ba.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, CASE WHEN ba.n > 0 THEN 1 ELSE coalesce(sc.c, 0) END::DOUBLE AS score
FROM d LEFT JOIN ba USING (r) LEFT JOIN al USING (r) LEFT JOIN sc USING (r)
"""
