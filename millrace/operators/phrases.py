"""Which of many phrases stand in which texts: one automaton of all of them, and one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases in one automaton, which every task gets; more phrases are taken in several passes over the texts.
AUTOMATON_BYTES = 8 << 20
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_held: dict[int, object] = {}


def _automaton(phrases: list[str], fold: bool):
    """The automaton of this worker for these phrases; the last one is kept, as tasks of one pass share a worker."""
    import ahocorasick

    key = hash((tuple(phrases), fold))
    if key not in _held:
        _held.clear()
        made = ahocorasick.Automaton()
        for p in phrases:
            form = p.translate(_FOLD) if fold else p
            made.add_word(form, (*made.get(form, (len(form),)), p))  # phrases that differ in case only share a place
        made.make_automaton()
        _held[key] = made
    return _held[key]


def find_phrases(texts: DataFrame, phrases: DataFrame, doc: str = "doc_id", text: str = "text", phrase: str = "phrase", fold: bool = True, whole_words: bool = False) -> DataFrame:
    """Rows (doc, phrase, n, first) for each text and each phrase that stands in it: how often, overlaps included, and where
    first (code points, from 0).

    ``fold``: A-Z are as a-z, in both; ``whole_words``: no letter, digit or underscore stands directly before or behind.
    Phrases are distinct; null and empty ones are left out, and so are null texts.  Rows that repeat a text each have
    their rows.  The phrases are the side whose size is checked: each pass takes as many as fit ``AUTOMATON_BYTES``.
    """
    wanted = phrases.where(F.length(phrase) > 0).select(F.col(phrase).alias("phrase")).distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()[0]
    passes = max(1, -(-size // AUTOMATON_BYTES))
    kind = texts.schema[doc].dataType.simpleString()
    rows, out = texts.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text")), None
    for p in range(passes):
        part = [r[0] for r in wanted.where(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == p).orderBy("phrase").collect()] if size else []
        found = rows.mapInArrow(_finder(part, fold, whole_words), f"doc {kind}, phrase string, n long, first long")
        out = found if out is None else out.unionByName(found)
    return out


def _finder(phrases: list[str], fold: bool, whole_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(phrases, fold) if phrases else None
        for b in batches:
            at, names, counts, firsts = [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist() if automaton else []):
                form, found = text.translate(_FOLD) if fold else text, {}
                for last, held in automaton.iter(form):
                    first = last - held[0] + 1
                    if whole_words and (_joins(form[first - 1 : first]) or _joins(form[last + 1 : last + 2])):
                        continue
                    for name in held[1:]:
                        seen = found.get(name)
                        found[name] = (seen[0] + 1, seen[1]) if seen else (1, first)
                for name, (n, first) in found.items():
                    at.append(k)
                    names.append(name)
                    counts.append(n)
                    firsts.append(first)
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())], ["doc", "phrase", "n", "first"])

    return run


def _joins(c: str) -> bool:
    return c.isalnum() or c == "_"
