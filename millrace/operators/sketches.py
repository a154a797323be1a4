"""Sketches of parts of a table that are kept and merged: how many different values there are, and which are the commonest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The size of a count sketch (2^LG registers), and four of its standard errors (1.04 / 2^(LG / 2) each).
LG = 13
ERROR = 4 * 1.04 / 2 ** (LG / 2)
#: Values that a sketch of the commonest ones follows.
TRACKED = 10_000


def of_parts(rows: DataFrame, parts: list[str], value: str) -> DataFrame:
    """A row for each part: ``distinct_sketch`` and ``top_sketch`` of a column (nulls are left out)."""
    rows = rows.where(F.col(value).isNotNull())
    return rows.groupBy(*parts).agg(F.hll_sketch_agg(value, F.lit(LG)).alias("distinct_sketch"), F.expr(f"approx_top_k_accumulate(`{value}`, {TRACKED})").alias("top_sketch"))


def merged(sketches: DataFrame, parts: list[str], k: int = 10) -> DataFrame:
    """Sketches of larger parts: ``distinct`` (a count within ``ERROR`` of the true one, almost always) and ``top``, the ``k``
    commonest values with counts (item, count), exact while no part has more than ``TRACKED`` different values."""
    out = sketches.groupBy(*parts).agg(F.hll_union_agg("distinct_sketch").alias("d"), F.expr(f"approx_top_k_combine(top_sketch, {TRACKED})").alias("t"))
    return out.select(*parts, F.hll_sketch_estimate("d").alias("distinct"), F.expr(f"approx_top_k_estimate(t, {k})").alias("top"))
