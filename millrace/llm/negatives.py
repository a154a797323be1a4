"""Hard negatives by a distributed k-nearest join over Voronoi cells.

An inner product becomes a distance: candidates get one more component, the root of what their squared norm lacks to the
greatest one, anchors get a zero.  Pivots are fitted on a bounded sample; every candidate goes to its nearest one, and a
cell's candidates, in the order of their distance to the pivot, are cut into blocks of bounded size (rings).  Anchors are
cut into groups by their nearest pivot.  A group meets the blocks of its nearest cells first; the scores found bound what
is left, and a block goes to a group only if its ring could hold a candidate that one of the group's anchors still needs,
by the triangle inequality and by the plane between two pivots.  A group and a block meet in one row, as a product of two
small matrices; a cell of any size is many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.storage import written

#: Candidates that pivots are fitted on at most, drawn by a hash; rounds of fitting; pivots and their bytes at most.
SAMPLE, ROUNDS, PIVOTS, PIVOT_BYTES = 20_000, 4, 4096, 8 << 20
#: Candidates of a block, anchors of a group, blocks that one join key holds, cells that a group searches first.
BLOCK, GROUP, PART, PROBES = 1024, 128, 64, 2
#: Rows of a partition when blocks are cut; absolute values of components are below this.
ROWS, WIDEST = 1 << 16, 1 << 31
_BLOCKS = "cell int, block long, near double, far double, low long, high long, ids binary, labels binary, vectors binary"
_GROUPS = "group long, g_low long, g_high long, a_ids binary, a_labels binary, anchors binary"
_HITS = "group long, at int, w int, anchor long, id long, score long"
_ANY = 1 << 62


@dataclass
class Cells:
    """Pivots with the augmented component last, the greatest squared norm, the dimension, and what cells hold."""

    pivots: np.ndarray
    most: float
    dim: int
    exact: bool  # whether products are exact in double precision
    near: np.ndarray | None = None
    far: np.ndarray | None = None
    parts: np.ndarray | None = None

    def distances(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        own = (vectors**2).sum(axis=1)
        lift = np.zeros(len(vectors)) if anchors else np.sqrt(np.maximum(self.most - own, 0))
        p = self.pivots
        d2 = own[:, None] + (lift**2)[:, None] + (p**2).sum(axis=1) - 2 * (vectors @ p[:, :-1].T + lift[:, None] * p[:, -1])
        return np.sqrt(np.maximum(d2, 0))

    def reach(self, anchors: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance between an anchor and a candidate of that score."""
        return np.sqrt(np.maximum((anchors**2).sum(axis=1) + self.most - 2 * score.astype(float), 0))


def _unpack(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i4").reshape(-1, dim)


def _fit(sample: np.ndarray, most: float, pivots: int, seed: int) -> np.ndarray:
    """Pivots by k-means on a sample of vectors, augmented."""
    x = np.concatenate([sample, np.sqrt(np.maximum(most - (sample**2).sum(axis=1), 0))[:, None]], axis=1)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(pivots, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _place(cells: Cells):
    """Rows (id, label, anchor, v) with the nearest pivot and the distance to it, as a candidate and as an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, n = b.column("v"), b.num_rows
            sizes = np.diff(v.offsets.to_numpy())
            full = np.zeros((n, cells.dim), dtype="<i4")  # shorter vectors end in zeros
            row, place = np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            full[row, place] = v.flatten().to_numpy()
            out = []
            for anchors in (False, True):
                d = cells.distances(full.astype(float), anchors)
                cell = np.argmin(d, axis=1)
                out += [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(n), cell])]
            packed = pa.array([r.tobytes() for r in full], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("anchor"), packed, *out[:3]], ["id", "label", "anchor", "v", "cell", "dist", "a_cell"])

    return run


def _pack(groups: bool, most: int):
    """Consecutive rows of one cell as blocks of ``most`` rows, or groups; inside, rows are in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def save(rows: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            rows.sort(key=lambda r: r[1])
            labels, ids = np.array([r[2] for r in rows], dtype="<i8"), np.array([r[1] for r in rows], dtype="<i8")
            low, high, data = int(labels.min()), int(labels.max()), [ids.tobytes(), labels.tobytes(), b"".join(r[4] for r in rows)]
            if groups:
                return pa.RecordBatch.from_pydict({"group": pa.array([number], pa.int64()), "g_low": pa.array([low], pa.int64()), "g_high": pa.array([high], pa.int64()), **{k: [x] for k, x in zip(("a_ids", "a_labels", "anchors"), data, strict=True)}})
            return pa.RecordBatch.from_pydict({
                "cell": pa.array([rows[0][0]], pa.int32()), "block": pa.array([number], pa.int64()), "near": [min(r[3] for r in rows)], "far": [max(r[3] for r in rows)],
                "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64()), **{k: [x] for k, x in zip(("ids", "labels", "vectors"), data, strict=True)},
            })

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):  # cell, id, label, dist, v
                if held and (held[0][0] != r[0] or len(held) == most):
                    yield save(held)
                    held = []
                held.append(r)
        if held:
            yield save(held)

    return run


def _targets(cells: Cells, first: bool):
    """For each group and its windows (anchor's place, number, lowest and highest score), the cells to search, by part, with
    the distances to the pivot between which candidates may be; ``first``: the nearest cells, else all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"group": [], "cell": [], "part": [], "d_low": [], "d_high": []}
            for group, data, at, lo, hi in zip(*(b.column(c).to_pylist() for c in ("group", "anchors", "at", "lo", "hi")), strict=True):
                if not at:
                    continue
                anchors = _unpack(data, cells.dim).astype(float)
                d = cells.distances(anchors, True)
                order = np.argsort(d.mean(axis=0), kind="stable")
                chosen = np.zeros(d.shape[1], dtype=bool)
                chosen[[j for j in order.tolist() if cells.parts[j]][:PROBES]] = True
                at, lo, hi = np.array(at), np.array(lo), np.array(hi)
                own, dw = anchors[at], d[at]
                slack = 1e-6 * (1 + cells.most**0.5 + np.sqrt((own**2).sum(axis=1)))
                widest, closest = cells.reach(own, lo) + slack, np.maximum(cells.reach(own, hi) - slack, 0)
                low = np.maximum(dw - widest[:, None], closest[:, None] - dw)  # of a candidate's distance to the pivot
                high = dw + widest[:, None]
                mine = int(np.argmin(d[0]))  # the plane between this pivot and another bounds that one's candidates
                between = np.sqrt(((cells.pivots - cells.pivots[mine]) ** 2).sum(axis=1))
                plane = np.where(between > slack.max(), (dw**2 - dw[:, mine : mine + 1] ** 2) / (2 * np.maximum(between, slack.max())), 0) - slack[:, None]
                useful = (lo <= hi)[:, None] & (low <= cells.far + slack[:, None]) & (high >= cells.near - slack[:, None]) & (plane <= widest[:, None])
                wanted = useful.any(axis=0) & (cells.parts > 0) & (chosen if first else ~chosen)
                for j in np.flatnonzero(wanted).tolist():
                    own_low, own_high = low[useful[:, j], j].min(), high[useful[:, j], j].max()
                    for part in range(int(cells.parts[j])):
                        for k, x in zip(out, (group, j, part, own_low, own_high), strict=True):
                            out[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["group"], pa.int64()), pa.array(out["cell"], pa.int32()), pa.array(out["part"], pa.int32()), pa.array(out["d_low"], pa.float64()), pa.array(out["d_high"], pa.float64())], [*out])

    return run


def _meet(cells: Cells, k: int, same: bool):
    """Rows of a group with its windows and a block: the ``k`` best candidates of each window in that block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = float if cells.exact else np.int64
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("group", "a_ids", "a_labels", "anchors", "at", "w", "lo", "hi", "ids", "labels", "vectors")}
            found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
            for i in range(b.num_rows):
                a_ids, a_labels = (np.frombuffer(cols[c][i], dtype="<i8") for c in ("a_ids", "a_labels"))
                ids, labels = (np.frombuffer(cols[c][i], dtype="<i8") for c in ("ids", "labels"))
                anchors, vectors = _unpack(cols["anchors"][i], cells.dim), _unpack(cols["vectors"][i], cells.dim)
                at, w, lo, hi = (np.array(cols[c][i], dtype=np.int64) for c in ("at", "w", "lo", "hi"))
                scores = (anchors.astype(kind) @ vectors.astype(kind).T).astype(np.int64)
                fits = a_labels[:, None] == labels
                fits = fits & (a_ids[:, None] != ids) if same else ~fits
                mine = scores[at]
                left = np.where(fits[at] & (mine >= lo[:, None]) & (mine <= hi[:, None]), mine, -_ANY * 2)
                rows = np.arange(len(at))
                for _ in range(min(k, len(ids))):
                    best = np.argmax(left, axis=1)  # the smallest id of equal scores, by the order inside a block
                    score = left[rows, best]
                    rows_ok = score > -_ANY * 2
                    if not rows_ok.any():
                        break
                    left[rows, best] = -_ANY * 2
                    n = int(rows_ok.sum())
                    for held, x in zip(found, (np.full(n, cols["group"][i]), at[rows_ok], w[rows_ok], a_ids[at[rows_ok]], ids[best[rows_ok]], score[rows_ok]), strict=True):
                        held.append(x)
            g, at, w, anchor, ids, score = (np.concatenate(x) for x in found)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(at.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(anchor), pa.array(ids), pa.array(score)], ["group", "at", "w", "anchor", "id", "score"])

    return run


def _search(groups: DataFrame, windows: DataFrame, blocks: DataFrame, cells: Cells, k: int, same: bool, first: bool) -> DataFrame:
    """The best candidates of each window (group, at, w, lo, hi) in each block that its group must see."""
    listed = windows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("at", "w", "lo", "hi"))).alias("l")).select("group", *(f"l.{c}" for c in ("at", "w", "lo", "hi")))
    asked = groups.join(listed, "group")  # a group has GROUP anchors at most
    goals = asked.select("group", "anchors", "at", "lo", "hi").mapInArrow(_targets(cells, first), "group long, cell int, part int, d_low double, d_high double")
    labels = "low <= g_high AND high >= g_low" if same else "NOT (low = high AND g_low = g_high AND low = g_low)"
    met = goals.join(asked, "group").join(blocks, ["cell", "part"]).where(f"far >= d_low - 1e-6 * (1 + abs(d_low)) AND near <= d_high AND {labels}")
    names = ["group", "a_ids", "a_labels", "anchors", "at", "w", "lo", "hi", "ids", "labels", "vectors"]
    return met.select(*names).mapInArrow(_meet(cells, k, same), _HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("group", "at", "w").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _join(groups: DataFrame, windows: DataFrame, blocks: DataFrame, cells: Cells, k: int, same: bool) -> DataFrame:
    """Exact: the nearest cells' k-th scores narrow the windows, then every other cell that may hold a better one."""
    first = written(_best(_search(groups, windows, blocks, cells, k, same, True), k), "negatives-first")
    kth = first.where(F.col("rank") == k).select("group", "at", "w", F.col("score").alias("kth"))
    narrowed = windows.join(kth, ["group", "at", "w"], "left").select("group", "at", "w", F.greatest("lo", F.coalesce("kth", "lo")).alias("lo"), "hi")
    return _best(first.drop("rank").unionByName(_search(groups, narrowed, blocks, cells, k, same, False)), k)


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", pivots: int | None = None, seed: int = 0,
) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vector_col`` holds arrays of whole numbers, a score is their inner product; higher scores come first, ties by smaller
    id.  The rows for which ``anchor`` holds are anchors; an anchor's positives are its first ``positives`` others of its
    label, and for each of these the first ``negatives`` rows of other labels with ``low * positive <= 100 * negative <=
    high * positive`` are returned (none for a negative positive_score); all, if there are fewer.

    Rows take no part whose id, label or vector is null, or that have a null component.  A shorter vector counts as if it
    ended in zeros.  Rows that share an id are candidates of their own but never each other's positives; each of them that
    is an anchor has its own rows.  Components of 2^31 and more raise, as their products leave 64 bits.  Empty tables give
    empty results; other columns are ignored, whatever their names.  ``pivots``: a 2048th of the rows, at most ``PIVOTS``
    and ``PIVOT_BYTES``, by default; they are fitted on about ``SAMPLE`` rows, twice that at most, and change no result.
    """
    spark = rows.sparkSession
    taken = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<bigint>").alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where("id is not null AND label is not null AND v is not null AND forall(v, x -> x is not null)")
    taken = written(taken.withColumn("n2", F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * x)")), "negatives-rows")
    n, most, dim, widest = taken.agg(F.count("*"), F.max("n2"), F.max(F.size("v")), F.max(F.expr("coalesce(array_max(transform(v, x -> abs(x))), 0)"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if widest >= WIDEST:
        raise ValueError(f"components must be below {WIDEST}; one is {widest}")
    dim = max(1, dim)
    count = pivots or max(1, min(PIVOTS, PIVOT_BYTES // (8 * dim + 8), n // (2 * BLOCK)))
    share = int(min(1.0, SAMPLE / n) * 1_000_000) + 1
    drawn = taken.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < share).select("v").limit(2 * SAMPLE).collect()  # at most 2 SAMPLE rows
    sample = np.zeros((max(1, len(drawn)), dim))
    for k, r in enumerate(drawn):
        sample[k, : len(r["v"])] = r["v"]
    cells = Cells(_fit(sample, most, count, seed), most, dim, widest * widest * dim < 1 << 53)

    placed = taken.select("id", "label", "anchor", F.col("v").cast("array<int>").alias("v")).mapInArrow(_place(cells), "id long, label long, anchor boolean, v binary, cell int, dist double, a_cell int")
    placed = written(placed, "negatives-placed")
    parts = max(1, -(-n // ROWS), min(16, -(-n // BLOCK)))
    by = ["cell", "label", "dist", "id"]
    blocks = placed.select("cell", "id", "label", "dist", "v").repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_pack(False, BLOCK), _BLOCKS)
    blocks = written(blocks, "negatives-blocks")
    near, far, held = (np.zeros(len(cells.pivots)) for _ in range(3))
    for r in blocks.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.count("*").alias("n")).collect():  # PIVOTS rows at most
        near[r["cell"]], far[r["cell"]], held[r["cell"]] = r["near"], r["far"], r["n"]
    cells.near, cells.far, cells.parts = near, far, -(-held // PART)
    of = spark.createDataFrame([(j, int(p)) for j, p in enumerate(cells.parts) if p], "cell int, parts int")
    blocks = blocks.join(F.broadcast(of), "cell").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")).drop("parts")

    by = ["a_cell", "label", "id"]
    groups = placed.where("anchor").select("a_cell", "id", "label", "dist", "v").repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_pack(True, GROUP), _GROUPS)
    groups = written(groups, "negatives-groups")
    every = F.explode(F.expr("sequence(0, cast(octet_length(a_ids) div 8 as int) - 1)")).alias("at")
    windows = groups.select("group", every).select("group", "at", F.lit(0).alias("w"), F.lit(-_ANY).cast("long").alias("lo"), F.lit(_ANY).cast("long").alias("hi"))
    found = written(_join(groups, windows, blocks, cells, positives, True), "negatives-positives")
    # Scores are far below 2^56, so the bounds fit as well.
    windows = found.select("group", "at", F.col("rank").alias("w"), F.expr(f"cast(ceil(cast(score as decimal(20,0)) * {low} / 100) as bigint)").alias("lo"), F.expr(f"cast(floor(cast(score as decimal(20,0)) * {high} / 100) as bigint)").alias("hi"))
    hard = _join(groups, windows, blocks, cells, negatives, False)
    pairs = found.select("group", "at", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(pairs, ["group", "at", "w"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("forall(embedding, x -> x is not null AND abs(x) < float('Infinity'))")
    label = F.expr("if(vec_id % 7 = 0, pmod(label + 1, 10), label)").alias("label")
    return hard_negatives(rows.select("vec_id", label, F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("embedding")), F.col("vec_id") % 50 == 0)


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v, true), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
