"""Text expressions: tokens, predicates, conversation tests, JSON replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern of tokens: words with at most one inner hyphen; other letters than ASCII part words.
TOKEN = r"([a-z0-9]+(?:-[a-z0-9]+)?)"
#: Fixed greetings.
GREETINGS = [
    "hello", "hi", "hey", "good morning", "good afternoon", "good evening", "greetings", "who are you", "what are you", "what can you do", "help",
    "thanks", "thank you", "bye", "goodbye", "namaste",
]
#: Fixed parts of questions that follow up on earlier ones.
FOLLOWUPS = [
    "it", "that", "they", "this", "those", "its", "what about", "how about", "and for", "same for", "what is it", "what does it", "and what", "also",
]
#: Fixed pattern of tags that make a short question stand for itself.
OWN_TAG = r"(?i)\b(?:[A-Z]{2,6}-[A-Z0-9]{2,6}|PT|FT|LT|XV|FV|ESD)\b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased lexical tokens; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def stripped(text: Column | str) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def searchable(text: Column, tags: Column, filename: Column, section: Column) -> Column:
    """What an index reads of a chunk: nulls add nothing."""
    return F.concat_ws(" ", text, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "), filename, section)


def is_insufficient(text: Column | str, least: int = 50) -> Column:
    """Too little native text: short, or mostly other characters than letters and digits."""
    t = stripped(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.coalesce((F.length(t) < least) | (letters < least / 2), F.lit(True))


def is_conversational(question: Column | str) -> Column:
    """A greeting as a whole, or up to three words with a one-word greeting."""
    clean = F.regexp_replace(F.lower(stripped(question)), r"(?U)[^\w\s]", "")
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    known = F.array(*map(F.lit, GREETINGS))
    return F.coalesce(F.array_contains(known, clean) | ((F.size(words) > 0) & (F.size(words) <= 3) & F.arrays_overlap(words, known)), F.lit(False))


def is_followup(question: Column | str, whole_words: bool = False, earlier: Column | int = 1) -> Column:
    """A question that needs the turns before it: up to four words without a tag, or with a phrase that points back.

    ``earlier``: how many turns there are before it; without any there is nothing to follow up on.  Phrases are looked
    for as parts of words too; ``whole_words`` asks for word boundaries."""
    q = F.lower(stripped(question))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    tagged = col(question).rlike(OWN_TAG)
    clean = F.regexp_replace(q, r"(?U)[^\w\s]", " ")
    if whole_words:
        points = clean.rlike(r"\b(?:" + "|".join(FOLLOWUPS) + r")\b")
    else:
        points = F.exists(F.array(*map(F.lit, FOLLOWUPS)), lambda p: F.contains(clean, p))
    history = F.lit(earlier) if isinstance(earlier, int) else F.coalesce(earlier, F.lit(0))
    return F.coalesce((history > 0) & (((words <= 4) & ~tagged) | points), F.lit(False))


def json_reply(text: Column | str) -> Column:
    """The first of these that parses: all of a model's reply, its fenced part, its outermost braces (VARIANT)."""
    t = col(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))


def without_fence(code: Column | str) -> Column:
    return F.regexp_replace(stripped(code), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")


def cache_key(question: Column | str) -> Column:
    """SHA-256 of the question without case and punctuation."""
    return F.sha2(stripped(F.regexp_replace(F.lower(col(question)), r"(?U)[^\w\s]", "")), 256)


def is_heading(line: Column | str) -> Column:
    """A short line in capitals, or numbered like 1.2 and capitalised."""
    t = col(line)
    capitals = (F.upper(t) == t) & t.rlike(r"\p{L}")
    return (F.length(t) < 80) & (capitals | t.rlike(r"^\d+\.\d+\s+[A-Z]"))


#: A character that parts a text at the matches of a pattern.
MARK = "\x01"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it, and inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def substitute(text: Column, pattern: str, fix) -> Column:
    """``text`` with each match of ``pattern`` (never empty) replaced by ``fix(match)``: a callback in built-in expressions."""

    def replaced(t: Column) -> Column:
        # A split by a pattern compiles it for each text, a replacement once; texts that have the mark are split by the pattern.
        marked = F.split(F.regexp_replace(t, pattern, MARK), MARK, -1)
        gaps = F.when(F.contains(t, F.lit(MARK)), F.split(t, pattern, -1)).otherwise(marked)
        hits = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), fix)
        padded = F.concat(hits, F.array(F.lit("")))
        return F.array_join(F.flatten(F.zip_with(gaps, padded, lambda g, h: F.array(F.coalesce(g, F.lit("")), F.coalesce(h, F.lit(""))))), "")

    return bound(text, replaced)
