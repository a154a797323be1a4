"""SQL expression builders shared by the native text operators.

Each builder returns Spark SQL text.  ``let`` binds a value once: a lambda body that names an outer expression
would evaluate that expression for every element, and the optimizer may inline a column alias into the body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space that separates words, and what separates the letters-and-digits words.
SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only; every other character stays as it is."""
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def space_words(text: str) -> str:
    return f"array_remove(split(coalesce({text}, ''), r'{SPACE}'), '')"


def plain_words(text: str) -> str:
    return f"array_remove(split({ascii_lower(f'coalesce({text}, "")'.replace(chr(34), chr(39)))}, r'{NOT_WORD}'), '')"


def total(values: str) -> str:
    return f"aggregate({values}, 0L, (a, x) -> a + x)"


def covered(starts: str, width: str) -> str:
    """Positions covered by windows of ``width`` that begin at the ascending, distinct ``starts``."""
    return let(starts, "st", total(f"transform(st, (v, k) -> cast(least({width}, coalesce(get(st, k + 1) - v, {width})) as bigint))"))


def with_row_key(docs: DataFrame, id_col: str, text_col: str, name: str = "__key") -> DataFrame:
    """Adds a key: rows with one id and one text share it, so that repeated rows and null ids join back exactly."""
    return docs.withColumn(name, F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("h"), F.length(f"`{text_col}`").alias("n")))


def free_prefix(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` has, for columns that come and go."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix
