"""Line-first quality rules, as built-in expressions of one projection: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import exprs as X

#: Characters that the base rule counts as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Phrases of page furniture; a line of at most ``MAX_FURNITURE_WORDS`` words that is made of them for the most part of its
#: letters and digits is boilerplate.  They are matched as whole words, whatever stands between.
FURNITURE = [
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "follow us on", "forgot password", "home page", "log in", "lorem ipsum", "newsletter", "privacy policy",
    "read more", "share this", "sign in", "sign up", "skip to content", "terms of service", "terms of use",
    "aceptar cookies", "accepter les cookies", "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "impressum", "leer más", "lire la suite",
    "mehr lesen", "mentions légales", "nach oben", "politique de confidentialité", "política de privacidad", "retour en haut", "todos los derechos reservados", "tous droits réservés", "volver arriba",
]
MAX_FURNITURE_WORDS = 12
#: Marks between the entries of a menu, and marks of punctuation, of one of which a line of so many words has one at least.
#: A row of a Markdown table is neither a menu nor a line of symbols.
TABLE_ROW = r"^[\x20\x09]*[|].*[|][\x20\x09\x0D]*$"
SEPARATORS, PUNCTUATION, UNPUNCTUATED = "[|»›•·>]", "[.,;:!?…。、！？،؟।]", 25


def _line_fails(line: str) -> str:
    """True when a line that has words breaks a rule: symbols, shouting, repetition, no letter or digit, furniture,
    navigation (three marks between entries, and entries of three words at most), a run of words without punctuation."""
    n_sep = f"(length({line}) - length(regexp_replace({line}, r'{SEPARATORS}', '')))"
    n_sym = f"(length({line}) - length(regexp_replace({line}, r'{SYMBOLS}', '')))"
    # Words with a space of their own on either side, so that neighbouring phrases don't share one.
    words = rf"concat(' ', regexp_replace(trim(regexp_replace(lower({line}), r'[^\p{{L}}\p{{N}}]+', ' ')), ' ', '  '), ' ')"
    phrases = "|".join(f" {p.replace(' ', '  ')} " for p in FURNITURE)
    rest = f"length(replace(regexp_replace({words}, '{phrases}', ''), ' ', ''))"
    loud = "size(filter(w, x -> x rlike '!!|[?][?]|[.]{4}'))"
    first = dict.fromkeys(p.split()[0] for p in FURNITURE)  # most lines have no phrase's first word
    rules = " OR ".join(
        [
            f"({n_sym} >= 2 AND 10 * {n_sym} >= 3 * size(w) AND NOT {line} rlike r'{TABLE_ROW}')",
            f"(size(w) >= 3 AND 2 * {loud} >= size(w))",
            "(size(w) >= 12 AND 4 * size(array_distinct(w)) <= size(w))",
            f"(not {line} rlike r'[\\p{{L}}\\p{{N}}]')",
            f"(size(w) <= {MAX_FURNITURE_WORDS} AND lower({line}) rlike '{'|'.join(first)}' AND 2 * {rest} < length(replace({words}, ' ', '')))",
            f"(size(w) >= {UNPUNCTUATED} AND NOT {line} rlike r'{PUNCTUATION}')",
            f"({n_sep} >= 3 AND 3 * {n_sep} >= size(w) AND NOT {line} rlike r'{TABLE_ROW}')",
        ]
    )
    return f"(size(w) > 0 AND ({rules}))"


def quality_rules(
    docs: DataFrame, text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20, max_lost_percent: int = 40
) -> DataFrame:
    """Cleans each text line by line and judges it; returns ``docs`` with the columns below, one row per input row.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (counts over the whole text), ``base_failed``,
    ``clean_text`` (the lines that pass, joined by a line feed), ``lost_chars`` (code points of failing lines) and
    ``kept``: false if ``base_failed`` or if failing lines hold over ``max_lost_percent`` of the code points of all
    lines with words.  Existing columns of these names are replaced; others stay.

    A null text counts as empty: no words, ``base_failed``, ``clean_text`` ''.  Empty tables give empty results;
    repeated rows are judged alike; a text of any length is one row and is never cut.
    """
    own = X.free_prefix(docs)
    text_col = f"`{text_col}`"
    d = docs.withColumn(f"{own}w", F.expr(X.space_words(text_col))).withColumn(f"{own}l", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    windows = X.let(
        f"transform({own}w, w -> xxhash64(w))",
        "h",
        "if(size(h) < 5, cast(array() as array<bigint>), transform(sequence(0, size(h) - 5), i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4))))",
    )
    runs = X.let(
        "sort_array(transform(wh, (x, i) -> struct(x as h, i as i)))",
        "s",
        "sort_array(filter(transform(s, (e, k) -> if(coalesce(e.h = get(s, k - 1).h, false) OR coalesce(e.h = get(s, k + 1).h, false), e.i, -1)), v -> v >= 0))",
    )
    repeats = X.let(windows, "wh", f"if(size(array_distinct(wh)) = size(wh), 0L, {X.covered(runs, '5')})")
    worded = rf"filter({own}l, l -> l rlike r'[^\x20\x09-\x0D]')"
    judged = f"transform({own}l, l -> {X.let(X.space_words('l'), 'w', f'struct(l as line, size(w) > 0 as worded, {_line_fails("l")} as fails)')})"
    d = d.withColumns(
        {
            f"{own}j": F.expr(judged),
            "n_words": F.expr(f"cast(size({own}w) as bigint)"),
            "word_chars": F.expr(f"cast(length(regexp_replace(coalesce({text_col}, ''), r'{X.SPACE}', '')) as bigint)"),
            "n_symbols": F.expr(f"cast(length(coalesce({text_col}, '')) - length(regexp_replace(coalesce({text_col}, ''), r'{SYMBOLS}', '')) as bigint)"),
            "n_dup_lines": F.expr(X.let(worded, "ls", "cast(size(ls) - size(array_distinct(ls)) as bigint)")),
            "n_repeat_words": F.expr(repeats),
        }
    )
    lost = X.total(f"transform(filter({own}j, j -> j.fails), j -> cast(length(j.line) as bigint))")
    whole = X.total(f"transform(filter({own}j, j -> j.worded), j -> cast(length(j.line) as bigint))")
    d = d.withColumns(
        {
            "lost_chars": F.expr(lost),
            f"{own}whole": F.expr(whole),
            "clean_text": F.expr(f"array_join(transform(filter({own}j, j -> not j.fails), j -> j.line), '\n')"),
            "base_failed": F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words"),
        }
    )
    return d.withColumn("kept", F.expr(f"NOT base_failed AND 100 * lost_chars <= {max_lost_percent} * {own}whole")).drop(f"{own}w", f"{own}l", f"{own}j", f"{own}whole")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, unnest(range(0, len(w) - 4)) AS i, w FROM w WHERE len(w) >= 5),
k AS (SELECT r, i, md5(array_to_string(list_slice(w, i + 1, i + 5), chr(10))) AS k FROM g),
dup AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest(range(0, 5)) AS o) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, length(line) - length(regexp_replace(line, '{SYMBOLS}', '', 'g')) AS s,
    length(line) - length(regexp_replace(line, '{SEPARATORS}', '', 'g')) AS p,
    ' ' || replace(trim(regexp_replace(lower(line), '[^\pL\pN]+', ' ', 'g')), ' ', '  ') || ' ' AS plain FROM l),
lf AS (SELECT r, line, len(w) > 0 AS worded, len(w) > 0 AND (
    (s >= 2 AND 10 * s >= 3 * len(w) AND NOT regexp_matches(line, '^[ \x09]*[|].*[|][ \x09\x0D]*$'))
    OR (len(w) >= 3 AND 2 * len(list_filter(w, lambda x: regexp_matches(x, '!!|[?][?]|[.]{{4}}'))) >= len(w))
    OR (len(w) >= 12 AND 4 * len(list_distinct(w)) <= len(w))
    OR NOT regexp_matches(line, '[\pL\pN]')
    OR (len(w) <= 12 AND 2 * length(regexp_replace(plain, ' accept  cookies | all  rights  reserved | back  to  top | click  here | cookie  policy | enable  javascript | follow  us  on | forgot  password | home  page | log  in | lorem  ipsum | newsletter | privacy  policy | read  more | share  this | sign  in | sign  up | skip  to  content | terms  of  service | terms  of  use | aceptar  cookies | accepter  les  cookies | alle  rechte  vorbehalten | cookies  akzeptieren | datenschutzerklärung | impressum | leer  más | lire  la  suite | mehr  lesen | mentions  légales | nach  oben | politique  de  confidentialité | política  de  privacidad | retour  en  haut | todos  los  derechos  reservados | tous  droits  réservés | volver  arriba |[ ]', '', 'g'))
        < length(replace(plain, ' ', '')))
    OR (len(w) >= {UNPUNCTUATED} AND NOT regexp_matches(line, '{PUNCTUATION}'))
    OR (p >= 3 AND 3 * p >= len(w) AND NOT regexp_matches(line, '^[ \x09]*[|].*[|][ \x09\x0D]*$'))) AS fails FROM lw),
a AS (SELECT r, count(*) FILTER (WHERE worded) - count(DISTINCT line) FILTER (WHERE worded) AS dups,
    coalesce(sum(length(line)) FILTER (WHERE fails), 0) AS lost, coalesce(sum(length(line)) FILTER (WHERE worded), 0) AS whole FROM lf GROUP BY r),
o AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols, dups AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, lost, whole
    FROM d JOIN w USING (r) JOIN a USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 40 * whole AS kept, CAST(lost AS BIGINT) AS lost_chars
FROM o
"""
