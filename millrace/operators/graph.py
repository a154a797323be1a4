"""A relation graph in an edge table, and bounded breadth-first search in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.shared import written


def edges_of(triples: DataFrame) -> DataFrame:
    """Edges from triples (src, relation, dst, source, seq): names trimmed and in capitals, blanks left out, and of
    several triples between two nodes the last."""
    clean = triples.select(F.upper(F.trim("src")).alias("src"), F.upper(F.trim("dst")).alias("dst"), F.trim("relation").alias("relation"), "source", "seq")
    clean = clean.where("src <> '' AND dst <> '' AND relation <> ''")
    return clean.groupBy("src", "dst").agg(F.max_by("relation", "seq").alias("relation"), F.max_by("source", "seq").alias("source"), F.max("seq").alias("seq"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Rows (seed, node, parent, hop) of the search trees of all seeds (column ``seed``), along edge directions.

    A node's parent is the smallest of the hop before; nodes that a seed has reached are left out by anti join.  Every
    hop but the last is written to the shared folder, so that no plan holds another."""
    kind = seeds.schema["seed"].dataType
    front = seeds.select("seed", F.col("seed").alias("node"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("hop")).distinct()
    seen = front
    for hop in range(1, depth + 1):
        step = front.select("seed", "node").join(edges, F.col("node") == F.col("src")).groupBy("seed", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "parent", F.lit(hop).alias("hop"))
        if hop < depth:
            front = written(front, "graph-hop")
        seen = seen.unionByName(front)
    return seen


def context(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Lines "A --[relation]--> B" of each seed's tree, and of the edges that lead to the seed."""
    tree = bfs(edges, seeds, depth).where("hop > 0").join(edges, (F.col("parent") == F.col("src")) & (F.col("node") == F.col("dst"))).select("seed", "src", "relation", "dst")
    into = edges.join(seeds.select("seed").distinct(), F.col("dst") == F.col("seed")).select("seed", "src", "relation", "dst")
    line = F.concat("src", F.lit(" --["), "relation", F.lit("]--> "), "dst")
    return tree.unionByName(into).distinct().select("seed", line.alias("line"))


#: Verbs of a sentence that stand for a relation, for the stand-in that needs no model.
VERBS = "feeds|drains|measures|controls|protects|isolates|trips|supplies|cools|heats|monitors|opens|closes"


def triples(chunks: DataFrame, doc: str = "doc", text: str = "text", least: int = 100) -> DataFrame:
    """Rows (doc, seq, src, relation, dst) of texts over ``least`` characters: a tag, a verb, and a tag behind it.

    A stand-in for a model that reads triples; callers with one give its rows to ``edges_of``."""
    tag = r"[A-Z]{1,5}-\d{1,5}[A-Z]?"
    pattern = rf"\b({tag})\s+({VERBS})\s+(?:the\s+)?({tag})\b"
    t = F.col(text)
    parts = [F.regexp_extract_all(t, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    rows = chunks.where(F.length(t) > least).select(F.col(doc).alias("doc"), F.posexplode(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("src", "relation", "dst"), strict=True)))).alias("seq", "x"))
    return rows.select("doc", "seq", "x.src", "x.relation", "x.dst")
