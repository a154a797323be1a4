"""Connected components by alternating star operations on DataFrames; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.storage import written

#: Rows of one key above which the key is hot, and rows (some 50 bytes each) of a small side that are broadcast at most.
HOT, HOT_ROWS = 50_000, 500_000


def join_hot(large: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``large`` joined with ``small``, which has each key once and in ``c`` how many rows of ``large`` have it.

    Rows of hot keys meet theirs without a shuffle: there are at most a HOT-th as many hot keys as rows; if those are
    too many for a broadcast, they are shuffled like the others.  ``c`` is dropped."""
    small = written(small, "by-key")
    hot = small.where(F.col("c") > HOT)
    n = hot.count()
    if not 0 < n <= HOT_ROWS:
        return large.join(small.drop("c"), keys, how)
    hot = F.broadcast(hot.drop("c"))
    own = large.join(hot, keys)
    others = large.join(hot.select(*keys), keys, "left_anti").join(small.where(F.col("c") <= HOT).drop("c"), keys, how)
    return own.select(*others.columns).unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a``, ``b``, whole numbers): root is the component's
    smallest node.  Edges with a null end are none.  Each round's edges are written to the shared folder; a round about
    halves the longest path.  Nodes of many edges are joined without a shuffle of those."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n, before = e.count(), None
    join = (lambda large, small, key: join_hot(large, small, [key], "inner")) if n > HOT else (lambda large, small, key: large.join(small.drop("c"), key))
    while True:
        # Large star: every larger neighbour of a node points at the smallest node around it.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("c")).select("a", F.least("a", "m").alias("m"), "c")
        large = join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the smaller neighbours of a node, and itself, point at the smallest of them.
        large = large.where("a <> b").distinct()
        if n > HOT:
            large = written(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = join(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = written(small.where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
