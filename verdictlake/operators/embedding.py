"""Text vectors by a truncated singular value decomposition of the term-document matrix.

Words are hashed to a fixed number of signed features, so that the matrix has as many columns however large the corpus is. It is written once,
a row per document. A randomised range finder multiplies it with a block of random columns, and by itself transposed, a few times: each task multiplies its
rows and emits its share of the product, the shares are added block by block of features, and only the sum, of a size that does not depend on the
corpus (``FEATURES`` x some 288 numbers), comes to the driver for the orthogonal basis of the next pass.

A vector is a document's weights times the right singular vectors, each divided by its singular value, at unit length. New documents
and queries are folded in by the same product: nothing is fitted again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import shared

#: Columns of the matrix, dimensions of a vector, further random columns, passes, and documents that are fitted at most (others are folded in).
FEATURES, DIMENSIONS, MORE, PASSES, FIT_DOCS = 1 << 15, 256, 32, 2, 500_000
#: Features of a block that is added up at once, and entries that are multiplied at once.
BLOCK, ENTRIES = 512, 1 << 14
#: Singular values below this share of the greatest are noise.
NOISE = 1e-3


def hashed_rows(docs: DataFrame, features: int = FEATURES) -> DataFrame:
    """(doc_id, features, weights) of (doc_id, text): distinct features in order, and for each the sum over its words of 1 + ln(count), with the word's sign."""
    words = docs.select("doc_id", F.transform(T.words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("w"))
    id_type = words.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("w")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            word = lists.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
            head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (word[1:] != word[:-1]))) if len(row) else np.zeros(0, np.int64)
            weight = (1 + np.log(np.diff(np.append(head, len(row))))) * np.where(word[head] >> 40 & 1, 1.0, -1.0)
            row, place = row[head], word[head] % features
            order = np.lexsort((place, row))
            row, place, weight = row[order], place[order], weight[order]
            head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1]))) if len(row) else np.zeros(0, np.int64)
            sums = np.add.reduceat(weight, head) if len(head) else np.zeros(0)
            ends = np.searchsorted(row[head], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[head].astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.astype(np.float32)))],
                ["doc_id", "features", "weights"],
            )

    return words.mapInArrow(run, f"doc_id {id_type}, features array<int>, weights array<float>")


def _sparse(batch: pa.RecordBatch, idf: np.ndarray):
    """(row, feature, weight) of a batch, rows at unit length."""
    lists = batch.column("features")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    row, place = np.repeat(np.arange(batch.num_rows), sizes), lists.flatten().to_numpy(zero_copy_only=False)
    weight = batch.column("weights").flatten().to_numpy(zero_copy_only=False) * idf[place]
    length = np.sqrt(np.bincount(row, weight.astype(np.float64) ** 2, batch.num_rows))
    return row, place, (weight / np.where(length > 0, length, 1)[row]).astype(np.float32)


def _gathered(key: np.ndarray, other: np.ndarray, weight: np.ndarray, matrix: np.ndarray, size: int, out: np.ndarray | None = None) -> np.ndarray:
    """out[key] += weight * matrix[other], with ``key`` in order. A key's entries (no more than there are rows or features) are added in one go, so that a sum does not depend on what is around it."""
    out = np.zeros((size, matrix.shape[1]), np.float32) if out is None else out
    at = 0
    while at < len(key):
        to = int(np.searchsorted(key, key[min(at + ENTRIES, len(key)) - 1], "right"))
        k = key[at:to]
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        out[k[head]] += np.add.reduceat(matrix[other[at:to]] * weight[at:to, None], head, axis=0)
        at = to
    return out


def fit_tasks(spark) -> int:
    """Tasks of a pass: each emits a share as large as the product (38 MB), so there are no more of them than run at once, however many partitions the session shuffles."""
    return max(1, min(shared.shuffle_partitions(spark), spark.sparkContext.defaultParallelism))


def _product(rows: DataFrame, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A' A basis, (A basis)' (A basis)) for the weighted rows A."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((idf, basis))
    features, wide = basis.shape

    def share(batches):
        weights, z = sent.value
        total, square = np.zeros((features, wide), np.float32), np.zeros((wide, wide))
        for whole in batches:
            for batch in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                row, place, weight = _sparse(batch, weights)
                y = _gathered(row, place, weight, z, batch.num_rows)
                square += y.T.astype(np.float64) @ y
                order = np.argsort(place, kind="stable")
                _gathered(place[order], row[order], weight[order], y, features, total)
        if square.any():
            for at in range(0, features, BLOCK):
                yield pa.RecordBatch.from_pydict({"block": [at], "data": [total[at : at + BLOCK].tobytes()]})
            yield pa.RecordBatch.from_pydict({"block": [-1], "data": [square.tobytes()]})

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                part = np.frombuffer(data.as_buffer(), np.float64 if block < 0 else np.float32)
                sums[block] = sums[block] + part if block in sums else part.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({"block": list(sums), "data": [x.tobytes() for x in sums.values()]})

    parts = rows.coalesce(fit_tasks(spark)).mapInArrow(share, "block long, data binary")
    found = parts.repartition(shared.shuffle_partitions(spark), "block").mapInArrow(added, "block long, data binary").collect()
    out, square = np.zeros((features, wide), np.float32), np.zeros((wide, wide))
    for r in found:
        if r.block < 0:
            square = np.frombuffer(r.data, np.float64).reshape(wide, wide)
        else:
            out[r.block : r.block + BLOCK] = np.frombuffer(r.data, np.float32).reshape(-1, wide)
    sent.unpersist()
    return out, square


class TextVectors:
    """Fitted factors: ``idf`` of features, ``factors`` (features x dimensions, divided by the singular values) and ``values`` (the singular values)."""

    def __init__(self, idf: np.ndarray, factors: np.ndarray, values: np.ndarray):
        self.idf, self.factors, self.values = idf, factors, values

    @classmethod
    def fit(cls, docs: DataFrame, dimensions: int = DIMENSIONS, features: int = FEATURES, more: int = MORE, passes: int = PASSES, fit_docs: int = FIT_DOCS, seed: int = 11) -> TextVectors:
        """Factors of (doc_id, text). Of more than ``fit_docs`` documents a sample of about so many is fitted. Documents without words, or with a null text, count for nothing; without any, vectors are zeros."""
        n = docs.count()
        some = docs if n <= fit_docs else docs.sample(fit_docs / n, seed)
        rows = shared.written(hashed_rows(some, features), "term-document")
        n = rows.count()
        idf = np.full(features, np.log(1 + n), np.float32)
        for r in rows.select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect():  # as many as features at most
            idf[r.f] = np.log(1 + n / r.n)
        wide = min(dimensions + more, features)
        basis = np.random.default_rng(seed).standard_normal((features, wide)).astype(np.float32)
        for _ in range(passes):
            basis = np.linalg.qr(_product(rows, idf, basis)[0])[0].astype(np.float32)
        values, turn = np.linalg.eigh(_product(rows, idf, basis)[1])
        shared.drop(rows)
        order = np.argsort(-values)[:dimensions]
        sigma = np.sqrt(np.maximum(values[order], 0))
        good = sigma > NOISE * max(sigma[0], 1e-12) if len(sigma) else np.zeros(0, bool)
        return cls(idf, (basis @ turn[:, order[good]].astype(np.float32) / sigma[good].astype(np.float32)).astype(np.float32), sigma[good])

    def embed(self, docs: DataFrame) -> DataFrame:
        """(doc_id, embedding) of (doc_id, text): unit vectors; zeros for texts without known words."""
        rows = hashed_rows(docs, len(self.idf))
        sent = docs.sparkSession.sparkContext.broadcast((self.idf, self.factors))

        def run(batches):
            weights, factors = sent.value
            for whole in batches:
                for batch in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                    row, place, weight = _sparse(batch, weights)
                    y = _gathered(row, place, weight, factors, batch.num_rows)
                    length = np.linalg.norm(y, axis=1, keepdims=True)
                    y = y / np.where(length > 0, length, 1)
                    ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * y.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["doc_id", "embedding"])

        return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, embedding array<float>")
