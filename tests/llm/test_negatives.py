"""Hard negatives over many cells, blocks and groups, and hard rows."""

import numpy as np
import pytest
from support import DATA, compare

from millrace.llm import negatives
from millrace.llm.negatives import hard_negatives


@pytest.mark.parametrize("pivots", [1, 7, 40])
def test_cells_change_no_result(spark, monkeypatch, pivots):
    """Small blocks and groups, so that a cell is many rows; copies and clusters, so that bounds leave blocks out."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "GROUP", 4)
    monkeypatch.setattr(negatives, "PART", 3)
    r = np.random.default_rng(1)
    centres = r.integers(-900, 900, (12, 6))
    rows = [(k, int(r.integers(0, 4)), [int(x) for x in centres[k % 12] + r.integers(-40, 40, 6)]) for k in range(900)]
    rows += [(900 + k, k % 2, [100, 200, 300, 0, 0, 0]) for k in range(400)]  # a third are copies
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<bigint>")
    got = sorted(map(tuple, hard_negatives(docs, F.col("vec_id") % 20 == 0, pivots=pivots).collect()))
    ids, labels, x = np.array([a for a, _, _ in rows]), np.array([b for _, b, _ in rows]), np.array([c for _, _, c in rows])
    want = []
    for a in range(0, len(rows), 20):
        s = x @ x[a]
        order = np.lexsort((ids, -s))
        for p in [k for k in order if labels[k] == labels[a] and k != a][:5]:
            near = [k for k in order if labels[k] != labels[a] and 50 * s[p] <= 100 * s[k] <= 95 * s[p]][:3]
            want += [(a, int(ids[p]), rank + 1, int(ids[k]), int(s[p]), int(s[k])) for rank, k in enumerate(near)]
    assert got == sorted(want) and len(got) > 300


def test_bounds_leave_blocks_out(spark, monkeypatch):
    """On vectors in clusters most pairs of a group and a cell never meet."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(negatives, "BLOCK", 16)
    seen, plain = [], negatives._search

    def counted(*args):
        groups, windows, blocks, cells, *rest = args
        out = plain(*args)
        seen.append((args[-1], groups.count() * blocks.count(), out.select("group", "id").distinct().count()))
        return out

    monkeypatch.setattr(negatives, "_search", counted)
    r = np.random.default_rng(2)
    centres = 3000 * np.eye(8, dtype=int)
    rows = [(k, k % 3, [int(v) for v in centres[k % 8] + r.integers(-30, 30, 8)]) for k in range(1600)]
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<bigint>")
    assert hard_negatives(docs, F.col("vec_id") % 40 == 0, low=97, high=100, pivots=8).count() > 100
    assert all(found < 300 for first, _, found in seen if not first)


def test_wide_and_exact_products(spark):
    """Products beyond double precision are exact; components that leave 32 bits raise."""
    from pyspark.sql import functions as F

    big = 2_000_000_000
    rows = [(0, 0, [big, 3]), (1, 0, [big, 1]), (2, 0, [big, 2]), (3, 1, [big // 2, 5]), (4, 1, [big // 2, 4])]
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<bigint>")
    got = [(r["positive_id"], r["negative_id"], r["negative_score"]) for r in hard_negatives(docs, F.col("vec_id") == 0).orderBy("positive_id", "rank").collect()]
    assert got == [(1, 3, big * big // 2 + 15), (1, 4, big * big // 2 + 12), (2, 3, big * big // 2 + 15), (2, 4, big * big // 2 + 12)]
    with pytest.raises(ValueError, match="components"):
        hard_negatives(docs.withColumn("embedding", F.expr("array(5000000000)")), F.lit(True))


def test_query_equals_sql_at_size(spark):
    compare(spark, negatives.query, negatives.SQL, f"{DATA}/sf0.1")
