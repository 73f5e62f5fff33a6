"""Approximate nearest neighbours: an inverted file of cells with product-quantised residuals, re-ranked exactly.

Centres of cells and code books are learnt from a bounded sample; every row is then assigned to its nearest centre and coded, in one pass. The index is
written by cell, and a search reads the cells that its queries probe and no others. Rows of a cell are scored by tables of
distances to code words; each task keeps its best few per query, and those of all tasks are scored again by their whole vectors. A cell with very many rows
is many files and many tasks: nothing gathers it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import shared
from .retrieval import DIGITS, cosine, ranked

#: Rows from which centres and code books are learnt; words of a code book; components of a coded part.
FIT_ROWS, WORDS, PART = 50_000, 256, 4
#: Cells at most, and queries that are searched at once.
CELLS, QUERIES = 4096, 4096
#: Distances that a task holds at once: 8 MB.
AT_ONCE = 1 << 20
#: Found rows that a task holds beside the best of each query.
HELD = 250_000
#: Centres that are drawn far from each other, at most; more are drawn at random.
SPREAD = 512
#: Share of their neighbours that rows of the sample must find in the probed cells, and how many rows and neighbours are tried.
TARGET, TRIED, NEIGHBOURS = 0.97, 256, 10


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row."""
    out = np.empty(len(x), np.int64)
    step, length = max(64, AT_ONCE // len(centres)), (centres**2).sum(1)
    for at in range(0, len(x), step):
        out[at : at + step] = (length - 2 * x[at : at + step] @ centres.T).argmin(1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres of ``k`` groups at most; a group that runs empty takes the row that is farthest from its own centre."""
    x = np.asarray(x, np.float64)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    random = np.random.default_rng(seed)
    if k > SPREAD:
        centres = distinct[random.choice(len(distinct), k, replace=False)]
    else:  # each centre is drawn by its squared distance to those before it
        centres, far = distinct[[random.integers(len(distinct))]], np.full(len(distinct), np.inf)
        while len(centres) < k:
            far = np.minimum(far, ((distinct - centres[-1]) ** 2).sum(1))
            centres = np.vstack([centres, distinct[random.choice(len(distinct), p=far / far.sum())]])
    for _ in range(rounds):
        own = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(counts == 0)
        centres = sums / np.maximum(counts, 1)[:, None]
        if len(empty):
            far = np.argsort(-((x - centres[own]) ** 2).sum(1))[: len(empty)]
            centres[empty] = x[far]
    return centres


def probes_needed(x: np.ndarray, centres: np.ndarray) -> int:
    """The least number of cells in which rows of the sample find ``TARGET`` of their nearest others."""
    asked, own = x[:TRIED], nearest(x, centres)
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    turn = np.argsort(np.argsort((centres**2).sum(1) - 2 * asked @ centres.T, axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(turn, own[best], 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, math.ceil(TARGET * len(needed)) - 1)])


class CellIndex:
    """Rows (cell, doc_id, code) by cell, and whole vectors (doc_id, embedding), both written; centres, code books, and the number of cells that a search reads."""

    def __init__(self, rows: DataFrame, vectors: DataFrame, centres: np.ndarray, books: list[np.ndarray], n: int, probes: int):
        self.rows, self.vectors, self.centres, self.books, self.n, self.probes = rows, vectors, centres, books, n, probes

    @classmethod
    def build(cls, vectors: DataFrame, cells: int | None = None, part: int = PART, fit_rows: int = FIT_ROWS) -> CellIndex:
        """An index for cosine similarity of (doc_id, embedding). Null and empty vectors are not in it; vectors must be of one length. Every other row is."""
        spark = vectors.sparkSession
        kept = shared.written(vectors.where(F.size("embedding") > 0).select("doc_id", "embedding"), "vectors")
        n = kept.count()
        sample = kept if n <= fit_rows else kept.sample(fit_rows / n, 3)
        found = sample.select("embedding").toArrow().column("embedding").combine_chunks()
        x = _unit(_matrix(found)) if len(found) else np.zeros((0, part))
        centres = k_means(x, cells or min(CELLS, max(1, round(math.sqrt(n))))) if len(x) else np.zeros((1, part))
        rest = x - centres[nearest(x, centres)] if len(x) else x
        books = [k_means(rest[:, at : at + part], WORDS) if len(x) else np.zeros((1, part)) for at in range(0, rest.shape[1], part)]
        sent = spark.sparkContext.broadcast((centres, books))

        def coded(batches):
            middle, known = sent.value
            for batch in batches:
                v = _unit(_matrix(batch.column("embedding")))
                cell = nearest(v, middle)
                left = v - middle[cell]
                codes = np.column_stack([nearest(left[:, k * part : (k + 1) * part], b) for k, b in enumerate(known)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("doc_id"), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "doc_id", "code"])

        id_type = kept.schema["doc_id"].dataType.simpleString()
        made = shared.written(kept.mapInArrow(coded, f"cell int, doc_id {id_type}, code binary"), "coded")
        path = shared.new_path(spark, "cells")
        # by cell and id: a large cell is dealt to several tasks
        made.repartitionByRange(shared.shuffle_partitions(spark), "cell", "doc_id").write.partitionBy("cell").parquet(path)
        rows = spark.read.schema(f"doc_id {id_type}, code binary, cell int").parquet(path)
        rows.scratch_path = path
        shared.drop(made)
        return cls(rows, kept, centres, books, n, probes_needed(x, centres))

    def drop(self) -> None:
        shared.drop(self.rows, self.vectors)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, again: int | None = None, same: bool = True) -> DataFrame:
        """(query_id, doc_id, rank, score): about the nearest rows of each (query_id, embedding). ``probes`` cells are read for each query (if not given, as many as the sample needed), ``again`` rows (20 ``k``) are scored exactly."""
        spark = queries.sparkSession
        probes, again = min(len(self.centres), probes or self.probes), again or 20 * k
        asked = queries.select("query_id", "embedding").where(F.size("embedding") > 0)
        blocks = max(1, math.ceil(asked.count() / QUERIES)) if self.n else 0
        types = {f.name: f.dataType.simpleString() for f in queries.schema}
        doc_type = self.rows.schema["doc_id"].dataType.simpleString()
        out = []
        for b in range(blocks):
            some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
            if not some.num_rows:
                continue
            ids, q = some.column("query_id").combine_chunks(), _unit(_matrix(some.column("embedding").combine_chunks()))
            far = (self.centres**2).sum(1) - 2 * q @ self.centres.T
            probed = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
            cells = np.unique(probed)
            rows = self.rows if len(cells) == len(self.centres) else self.rows.where(F.col("cell").isin(cells.tolist()))
            found = rows.mapInArrow(self._scorer(ids, to_arrow_type(queries.schema["query_id"].dataType), q, probed, again, same), f"query_id {types['query_id']}, doc_id {doc_type}, near float")
            out.append(found)
        if not out:
            return spark.createDataFrame([], f"query_id {types['query_id']}, doc_id {doc_type}, rank int, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "doc_id")
        best = reduce(DataFrame.unionByName, out).withColumn("r", F.row_number().over(order)).where(F.col("r") <= again).drop("r", "near")
        whole = best.join(self.vectors, "doc_id").join(asked.withColumnRenamed("embedding", "q"), "query_id")
        return ranked(whole.select("query_id", "doc_id", F.round(cosine(F.col("q"), F.col("embedding")), DIGITS).alias("score")), k)

    def _scorer(self, ids: pa.Array, id_type: pa.DataType, q: np.ndarray, probed: np.ndarray, again: int, same: bool):
        centres, books, names = self.centres, self.books, ids.to_pylist()

        def run(batches):
            own = np.array(names)
            part = books[0].shape[1]
            least = np.full(len(names), -np.inf)
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            doc_type = None

            def best(parts):
                """The best few of each query."""
                who, what, score = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((what, -score, who))
                who, what, score = who[order], what[order], score[order]
                turn = np.arange(len(who)) - np.searchsorted(who, who)
                least[who[turn == again - 1]] = score[turn == again - 1]
                return [(who[turn < again], what[turn < again], score[turn < again])]

            size = 0
            for whole in batches:
                cell_of = whole.column("cell").to_numpy()
                for c in np.unique(cell_of):
                    who = np.flatnonzero((probed == c).any(1))
                    if not len(who):
                        continue
                    mine = whole.take(pa.array(np.flatnonzero(cell_of == c))).sort_by("doc_id")
                    for batch in (mine.slice(at, 4096) for at in range(0, mine.num_rows, 4096)):
                        doc_type, docs = batch.column("doc_id").type, batch.column("doc_id").to_numpy(zero_copy_only=False)
                        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(docs), -1)
                        for some in (who[at : at + 512] for at in range(0, len(who), 512)):
                            score = np.repeat((q[some] @ centres[c])[:, None], len(docs), 1)
                            # inner products of queries and code words: a row's is that with its centre plus one number per coded part
                            for k, b in enumerate(books):
                                score += (q[some, k * part : (k + 1) * part] @ b.T)[:, code[:, k]]
                            if same:
                                score[own[some][:, None] == docs] = -np.inf
                            keep = min(again, len(docs))
                            top = np.argpartition(1e-13 * np.arange(len(docs)) - score, keep - 1, axis=1)[:, :keep]  # rows stand by id: of equal ones the first
                            value = np.take_along_axis(score, top, 1).ravel()
                            asking = np.repeat(some, keep).astype(np.int32)
                            good = np.isfinite(value) & (value >= least[asking])
                            held.append((asking[good], docs[top].ravel()[good], value[good]))
                            size += int(good.sum())
                            if size > HELD + again * len(names):
                                held = best(held)
                                size = len(held[0][0])
            if held:
                who, what, score = best(held)[0]
                yield pa.RecordBatch.from_arrays([pa.array(names, id_type).take(pa.array(who)), pa.array(what, doc_type), pa.array(score.astype(np.float32))], ["query_id", "doc_id", "near"])

        return run


def recall(found: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_exact, n_found, recall): the share of each query's first ``k`` exact neighbours that are among its first ``k`` found ones."""
    both = exact.where(F.col("rank") <= k).select("query_id", "doc_id").join(found.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 6))
