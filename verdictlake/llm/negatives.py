"""Hard negatives by a pivot table.

Scores are integer inner products of quantised vectors. With one more component, what a row's length lacks of the longest row's, all rows lie on a sphere, and
a row's inner product with an anchor (whose own further component is 0) falls as their Euclidean distance grows. Every row stores its distances to a few
pivots; by the triangle inequality the difference and the sum of the anchor's and the row's distance to a pivot bracket their distance, hence the
score. Rows whose bracket leaves the wanted range are passed over, whole groups of rows first by the least and greatest stored distances; survivors are scored
exactly. Rows are sorted by nearest pivot and distance to it, so that groups are narrow.

Stated anchors meet all rows in blocks: a block of anchors travels to every task, which keeps its best few of each; two scans a block,
one for positives, one for negatives. Nothing is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, new_path, shuffle_partitions, written

#: Pivots, and rows among which they are chosen.
PIVOTS, CHOICE = 8, 2048
#: Anchors in a block (with 64 components they are some 1.2 MB) and rows in a group.
ANCHORS, GROUP = 2048, 2048
#: Pairs of which at most this share survive are scored one by one, else by a matrix product.
FEW = 0.05
_LEAST = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component; beyond ``limit`` it is ``limit``, so that no inner product leaves 64 bits."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(x.cast("double") * scale))).cast("long"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, short ones filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Sphere:
    """Distances of rows and anchors to pivots: ``square`` is the greatest squared length of a row."""

    def __init__(self, pivots: np.ndarray, square: float):
        self.pivots, self.square = pivots.astype(np.float64), square
        self.extra = self._extra(self.pivots)

    def _extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (x**2).sum(1), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(2 * (self.square - x @ self.pivots.T - np.outer(self._extra(x), self.extra)), 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        return np.sqrt(np.maximum(self.square + (q**2).sum(1)[:, None] - 2 * q @ self.pivots.T, 0))


def choose_pivots(sample: np.ndarray, square: float, n: int = PIVOTS) -> np.ndarray:
    """Rows of ``sample`` far from each other: the longest, then always the one farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample.astype(np.float64) ** 2).sum(1)))]
    least = np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        least = np.minimum(least, Sphere(sample[chosen[-1:]], square).of_rows(sample)[:, 0])
        chosen.append(int(np.argmax(least)))
    return sample[chosen]


class Anchors:
    """A block of anchors: ids, labels, vectors, distances to the pivots; for negatives also the ranges that their positives set."""

    def __init__(self, ids, labels, vectors: np.ndarray, sphere: Sphere, exact: bool, low=None, high=None):
        self.ids, self.labels, self.vectors, self.exact = np.asarray(ids, np.int64), np.asarray(labels, np.int64), vectors, exact
        self.far, self.square, self.low, self.high = sphere.of_anchors(vectors), sphere.square, low, high
        self.lengths = (vectors.astype(np.float64) ** 2).sum(1)
        # distances near 0 are known to some 1e-8 of the longest; whole scores are 1 apart
        self.slack = 0.5 + 1e-6 * (self.square + self.lengths)

    def most(self, a: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Upper bound of the score of anchors ``a`` with rows at least ``near`` away."""
        return (self.square + self.lengths[a][:, None] - near**2) / 2 + self.slack[a][:, None]

    def least(self, a: np.ndarray, far: np.ndarray) -> np.ndarray:
        return (self.square + self.lengths[a][:, None] - far**2) / 2 - self.slack[a][:, None]

    def scores(self, a: np.ndarray, rows: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Exact scores of the pairs that are alive; the others have the least number there is."""
        out = np.full(alive.shape, _LEAST)
        if alive.mean() <= FEW:
            i, j = np.nonzero(alive)
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                out[x, y] = (self.vectors[a[x]] * rows[y]).sum(1)
        elif self.exact:  # sums below 2 ** 53
            out[alive] = (self.vectors[a].astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)[alive]
        else:
            out[alive] = (self.vectors[a] @ rows.T)[alive]
        return out


def _best(scores: np.ndarray, ids: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best few of each row of ``scores`` and of those known: by falling score, then id. Columns stand in order of id."""
    k = known[0].shape[1]
    found, names = np.full((len(scores), k), _LEAST), np.zeros((len(scores), k), np.int64)
    scores, line = scores.copy(), np.arange(len(scores))
    for c in range(min(k, scores.shape[1])):
        place = scores.argmax(1)
        found[:, c], names[:, c] = scores[line, place], ids[place]
        scores[line, place] = _LEAST
    both, who = np.hstack([known[0], found]), np.hstack([known[1], names])
    order = np.lexsort((who, -np.maximum(both, _LEAST + 1)), axis=1)[:, :k]
    return np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)


def _groups(batches, width: int):
    """(ids, labels, vectors, distances) of groups of rows, in order of id."""
    for whole in batches:
        for at in range(0, whole.num_rows, GROUP):
            batch = whole.slice(at, GROUP)
            ids = batch.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            far = _matrix(batch.column("far"), len(batch.column("far")[0]))
            yield ids[order], batch.column("label").to_numpy()[order], _matrix(batch.column("v"), width)[order], far[order]


def _bounds(block: Anchors, a: np.ndarray, far: np.ndarray, above: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    near, beyond = np.zeros((len(a), len(far))), np.full((len(a), len(far)), np.inf) if above else None
    for p in range(far.shape[1]):
        own = block.far[a, p][:, None]
        np.maximum(near, np.abs(own - far[:, p]), out=near)
        if above:
            np.minimum(beyond, own + far[:, p], out=beyond)
    return near, beyond


def _gap(block: Anchors, far: np.ndarray) -> np.ndarray:
    """Least distance of each anchor to a group of rows, by the group's least and greatest distances to the pivots."""
    return np.maximum(np.maximum(far.min(0) - block.far, block.far - far.max(0)), 0).max(1)[:, None]


def _positives(block: Anchors, k: int, width: int):
    def run(batches):
        best = (np.full((len(block.ids), k), _LEAST), np.zeros((len(block.ids), k), np.int64))
        for ids, labels, rows, far in _groups(batches, width):
            everyone = np.arange(len(block.ids))
            hopeful = block.most(everyone, _gap(block, far))[:, 0] >= best[0][:, -1]
            for label in np.unique(labels):
                a, r = np.flatnonzero(hopeful & (block.labels == label)), np.flatnonzero(labels == label)
                if not len(a):
                    continue
                near, _ = _bounds(block, a, far[r])
                alive = (block.most(a, near) >= best[0][a, -1:]) & (ids[r] != block.ids[a][:, None])
                if alive.any():
                    new = _best(block.scores(a, rows[r], alive), ids[r], (best[0][a], best[1][a]))
                    best[0][a], best[1][a] = new
        i, j = np.nonzero(best[0] > _LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[1][i, j]), pa.array(best[0][i, j])], ["anchor", "id", "score"])

    return run


def _negatives(block: Anchors, k: int, width: int):
    def run(batches):
        slots = block.low.shape[1]
        best = [(np.full((len(block.ids), k), _LEAST), np.zeros((len(block.ids), k), np.int64)) for _ in range(slots)]
        lowest, highest = block.low.min(1), block.high.max(1)
        for ids, labels, rows, far in _groups(batches, width):
            hopeful = (block.most(np.arange(len(block.ids)), _gap(block, far))[:, 0] >= lowest) & (lowest <= highest)
            for label in np.unique(block.labels[hopeful]):
                a, r = np.flatnonzero(hopeful & (block.labels == label)), np.flatnonzero(labels != label)
                if not len(r):
                    continue
                near, beyond = _bounds(block, a, far[r], True)
                alive = (block.most(a, near) >= lowest[a][:, None]) & (block.least(a, beyond) <= highest[a][:, None])
                if not alive.any():
                    continue
                scores = block.scores(a, rows[r], alive)
                for s, known in enumerate(best):
                    fit = (scores >= block.low[a, s][:, None]) & (scores <= block.high[a, s][:, None])
                    some = np.flatnonzero(fit.any(1))
                    if len(some):
                        new = _best(np.where(fit[some], scores[some], _LEAST), ids[r], (known[0][a[some]], known[1][a[some]]))
                        known[0][a[some]], known[1][a[some]] = new
        for s, (scores, names) in enumerate(best):
            i, j = np.nonzero(scores > _LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), s)), pa.array(names[i, j]), pa.array(scores[i, j])], ["anchor", "slot", "id", "score"])

    return run


def pivot_table(vectors: DataFrame, scale: int) -> tuple[DataFrame, Sphere, int, bool]:
    """(id, label, v, far), written in order of nearest pivot and distance to it, of (id, label, vector); the pivots; components of a vector; whether sums stay below 2 ** 53."""
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~wrong)
    width = max(1, good.agg(F.max(F.size("vector"))).first()[0] or 0)
    limit = math.isqrt((1 << 62) // width)
    rows = written(good.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), quantised(F.col("vector"), scale, limit).alias("v")), "quantised")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    square = float(rows.agg(F.max(squares)).first()[0] or 0.0)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(CHOICE).select("v").toArrow().column("v").combine_chunks()
    sphere = Sphere(choose_pivots(_matrix(sample, width) if len(sample) else np.zeros((1, width), np.int64), square), square)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            far = sphere.of_rows(_matrix(batch.column("v"), width))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(far.argmin(1)), pa.array(far.min(1))], [*batch.schema.names, "far", "pivot", "nearest"])

    measured = written(rows.mapInArrow(run, "id long, label long, v array<long>, far array<double>, pivot long, nearest double"), "measured")
    order = ["pivot", "nearest", "id"]
    table = written(measured.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).select("id", "label", "v", "far"), "pivot-table")
    drop(rows, measured)
    return table, sphere, width, square < 1 << 52


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.

    A component counts as floor(scale * x); scores are integer inner products; ties go to the smaller id. ``anchors`` is a condition on ``id_col``. Rows with a null id, label
    or vector, or a component that is null or not finite, take no part. Vectors may differ in length: what one lacks is 0, so that an empty vector
    scores 0 with all. A component that is so large that an inner product could leave 64 bits is cut to the greatest that cannot (some 2.6e8 with 64 components).
    Other rows that share an anchor's id are taken for it and are neither its positives nor its negatives; of rows that repeat an id each counts, and each anchor row has its own
    results. Anchors without positives, and positives without a fitting negative (as all with a negative score), have no row. An empty table gives an
    empty result; other columns do not matter.
    """
    spark = rows.sparkSession
    table, sphere, width, exact = pivot_table(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")), scale)
    asked = written(table.select(F.col("id").alias(id_col), "label", "v").where(anchors).select(F.col(f"`{id_col}`").alias("id"), "label", "v", F.monotonically_increasing_id().alias("tie")), "anchors")
    blocks = max(1, math.ceil(asked.count() / ANCHORS))
    path = new_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/block=none")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("tie"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if block.num_rows:
            _mine(block, table, sphere, width, exact, positives, negatives, low, high).write.parquet(f"{path}/block={b}")
    drop(table, asked)
    return spark.read.schema(schema).parquet(path).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _mine(block: pa.Table, table: DataFrame, sphere: Sphere, width: int, exact: bool, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Results of a block of anchors."""
    ids, labels = block.column("id").to_numpy(), block.column("label").to_numpy()
    vectors = _matrix(block.column("v").combine_chunks(), width)
    every = Window.partitionBy("anchor")
    met = table.mapInArrow(_positives(Anchors(ids, labels, vectors, sphere, exact), positives, width), "anchor long, id long, score long")
    met = met.withColumn("slot", F.row_number().over(every.orderBy(F.desc("score"), "id")) - 1).where(F.col("slot") < positives).collect()  # a few of each anchor
    slots = max((r.slot for r in met), default=0) + 1
    lows, highs = np.zeros((len(ids), slots), np.int64), np.full((len(ids), slots), -1, np.int64)  # nothing fits where there is no positive
    for r in met:
        least, most = -(-low * r.score // 100), high * r.score // 100
        lows[r.anchor, r.slot], highs[r.anchor, r.slot] = (least, most) if least <= most else (0, -1)
    # what no positive asks for must not widen the range of those that do
    empty = lows > highs
    lows[empty], highs[empty] = np.iinfo(np.int64).max, _LEAST + 1
    found = table.mapInArrow(_negatives(Anchors(ids, labels, vectors, sphere, exact, lows, highs), negatives, width), "anchor long, slot long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= negatives)
    known = table.sparkSession.createDataFrame(
        pa.table({
            "anchor": pa.array([r.anchor for r in met], pa.int64()), "slot": pa.array([r.slot for r in met], pa.int64()), "anchor_id": pa.array([int(ids[r.anchor]) for r in met], pa.int64()),
            "positive_id": pa.array([r.id for r in met], pa.int64()), "positive_score": pa.array([r.score for r in met], pa.int64()),
        })
    )
    return ranked.join(F.broadcast(known), ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
