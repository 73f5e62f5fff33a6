"""Dense retrieval with vectors of texts (singular value decomposition) and with an approximate index.

What a decomposition or an index of cells gives has no SQL form: rows are held against exact search in tests, and what can be
told of all rows (that each has a unit vector, that each is indexed, that recall is 0.9 or more) has an oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann
from ..operators import retrieval as R
from ..operators.embedding import TextVectors
from ..sources import shared
from . import ranking

_FITTED: dict[tuple, tuple[str, TextVectors, DataFrame]] = {}
_CELLS: dict[tuple, tuple[str, ann.CellIndex]] = {}


def fitted(spark, sf_dir) -> tuple[TextVectors, DataFrame]:
    """The factors of the documents and their vectors (doc_id, embedding), kept for the application. When the table changes, only new documents are embedded, with the same factors."""
    path = f"{sf_dir}/documents.parquet"
    key, state = (spark.sparkContext.applicationId, path), shared.version(spark, path)
    old = _FITTED.get(key)
    if old is None or old[0] != state:
        docs = ranking.docs_of(spark, sf_dir)
        model = TextVectors.fit(docs) if old is None else old[1]
        made = model.embed(docs) if old is None else R.upsert_vectors(old[2], docs, model.embed)
        _FITTED[key] = old = (state, model, shared.written(made, "text-vectors"))
    return old[1], old[2]


def cells(spark, sf_dir, name: str, vectors: DataFrame) -> ann.CellIndex:
    """An approximate index, kept for the application and built again when the table's files change."""
    path = f"{sf_dir}/{name}.parquet"
    key, state = (spark.sparkContext.applicationId, path), shared.version(spark, path)
    old = _CELLS.get(key)
    if old is None or old[0] != state:
        if old is not None:
            old[1].drop()
        _CELLS[key] = old = (state, ann.CellIndex.build(vectors))
    return old[1]


def _asked(spark, sf_dir, model: TextVectors) -> DataFrame:
    q = ranking.queries_of(spark, sf_dir)
    return model.embed(q.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))).withColumnRenamed("doc_id", "query_id")


def _text_dense(spark, sf_dir, k: int) -> DataFrame:
    model, vectors = fitted(spark, sf_dir)
    return R.dense(_asked(spark, sf_dir, model), vectors, k=k, same=False)


def lsa_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's vector has unit length; documents without words have none but zeros."""
    length = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return fitted(spark, sf_dir)[1].select("doc_id", (F.abs(length - 1) < 1e-4).alias("unit"))


def lsa_topk(spark, sf_dir):
    return _text_dense(spark, sf_dir, 10).select("query_id", "doc_id", "rank", "score")


def lsa_hybrid_rrf(spark, sf_dir):
    """Lists by text vectors and by BM25 as one."""
    return R.rrf(_text_dense(spark, sf_dir, 10), R.bm25(ranking.queries_of(spark, sf_dir), ranking.words_index(spark, sf_dir))).select("query_id", "doc_id", "rank", "score")


def lsa_pipeline_compare(spark, sf_dir):
    """Sparse, dense (exact and by cells), both, and both re-ranked, by the same measures."""
    q, d, g = ranking.queries_of(spark, sf_dir), ranking.docs_of(spark, sf_dir), shared.written(ranking.gold(spark, sf_dir), "gold")
    model, vectors = fitted(spark, sf_dir)
    # written: each list is part of up to three others, and is searched once
    bm25, dense = shared.written(R.bm25(q, ranking.words_index(spark, sf_dir), 50), "bm25"), shared.written(_text_dense(spark, sf_dir, 50), "dense")
    near = cells(spark, sf_dir, "documents", vectors).search(_asked(spark, sf_dir, model), 50, same=False)
    fused = shared.written(R.rrf(bm25, dense, top=50), "fused")
    lists = {"bm25": bm25, "dense": dense, "dense_cells": near, "hybrid": fused, "rerank": R.lexical_rerank(fused, q, d, 50)}
    return reduce(DataFrame.unionByName, [shared.written(R.mean_metrics(R.retrieval_metrics(x, g, q)), n).withColumn("pipeline", F.lit(n)) for n, x in lists.items()])


def ann_topk(spark, sf_dir):
    q, v = ranking.vectors(spark, sf_dir)
    return cells(spark, sf_dir, "embeddings", v).search(q).select("query_id", "doc_id", "rank", "score")


def ann_recall(spark, sf_dir):
    """Share of each query's exact neighbours that the index of cells finds."""
    q, v = ranking.vectors(spark, sf_dir)
    return ann.recall(cells(spark, sf_dir, "embeddings", v).search(q), R.dense(q, v))


def lsa_ann_recall(spark, sf_dir):
    """The same for passages and documents as text vectors."""
    model, vectors = fitted(spark, sf_dir)
    q = _asked(spark, sf_dir, model)
    return ann.recall(cells(spark, sf_dir, "documents", vectors).search(q, same=False), R.dense(q, vectors, same=False))


def ann_coverage(spark, sf_dir):
    """Rows in the index, queries with neighbours, and whether recall is 0.9 or more on the whole."""
    q, v = ranking.vectors(spark, sf_dir)
    index = cells(spark, sf_dir, "embeddings", v)
    per = ann_recall(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_queries"), (F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("recalled"))
    return per.join(F.broadcast(index.rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"))))


QUERIES = {f.__name__: f for f in (lsa_vectors, lsa_topk, lsa_hybrid_rrf, lsa_pipeline_compare, lsa_ann_recall, ann_topk, ann_recall, ann_coverage)}

ORACLE_SQL = {
    "lsa_vectors": rf"select doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{ranking._W}')) > 0 as unit from documents",
    "ann_coverage": "select count(*) filter (vec_id % 20 = 0) as n_queries, true as recalled, count(*) as n_rows, count(distinct vec_id) as n_ids from embeddings",
}
