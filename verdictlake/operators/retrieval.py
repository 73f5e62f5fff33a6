"""Ranking: BM25, dense similarity, reciprocal-rank fusion, lexical re-ranking, parents of ranked children.

Ranked lists are DataFrames (query_id, doc_id, rank, score). Scores are rounded to six digits
before ranking, with the document's id as tie-break, so that ranks do not depend on the order of sums.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..sources.shared import shuffle_partitions
from .index import DIGITS, Index, overlap_terms

# Fixed value: the constant of reciprocal-rank fusion.
RRF_K = 60
#: A query set whose terms number at most this is broadcast; a larger one is joined by a shuffle.
BROADCAST_TERMS = 200_000


def small(df: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, which is counted first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds rank by falling score, then id; keeps the first ``k``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame | Index, k: int | None = 10) -> DataFrame:
    """Best documents for each (query_id, query); a term that a query repeats counts as often. Scores of 0 are left out.

    ``docs`` is an index, or (doc_id, text), of which one is built for this search.
    """
    index = docs if isinstance(docs, Index) else Index.build(docs)
    return ranked(index.bm25(queries, k), k)


def lexical_overlap(queries: DataFrame, docs: DataFrame | Index, k: int | None = 10) -> DataFrame:
    """Documents by the share of a query's distinct terms that they contain; an index is one of ``overlap_terms``."""
    index = docs if isinstance(docs, Index) else Index.build(docs, overlap_terms)
    return ranked(index.overlap(queries, k), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


#: Queries in a block of the exhaustive search: of 64 dimensions they are 2 MB, which travel to every task.
QUERY_BLOCK = 4096
#: Queries and rows whose scores a task holds at once: 8 MB.
SCORED_QUERIES, SCORED_ROWS = 512, 2048
#: Dimensions of hashed vectors.
DIMENSIONS = 64


def hashed_vectors(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, embedding) of (doc_id, text): words counted by a hash of their first and last letter and length; zeros without words.

    An embedder that needs no model and is the same everywhere; any other that gives (doc_id, embedding) takes its place.
    """
    words = docs.select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    id_type = words.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("w")
            place = np.fromiter(((31 * ord(w[0]) + 7 * ord(w[-1]) + len(w)) % dimensions for w in lists.flatten().to_pylist()), np.int64)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            counts = np.bincount(row * dimensions + place, minlength=batch.num_rows * dimensions).astype(np.float64)
            whole = pa.FixedSizeListArray.from_arrays(pa.array(counts), dimensions).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), whole], ["doc_id", "embedding"])

    return words.mapInArrow(run, f"doc_id {id_type}, embedding array<double>")


def upsert_vectors(known: DataFrame, docs: DataFrame, embed=hashed_vectors) -> DataFrame:
    """``known`` (doc_id, embedding) and the vectors of those of ``docs`` that it has not: only new texts are embedded."""
    return known.unionByName(embed(docs.join(known.select("doc_id"), "doc_id", "left_anti")))


def dense(queries: DataFrame, docs: DataFrame, metric: str = "cosine", k: int = 10, block: int = QUERY_BLOCK, same: bool = True) -> DataFrame:
    """Nearest rows of (doc_id, embedding) for each (query_id, embedding), exhaustively. With ``same``, both are ids of the same things: a row is not its own neighbour.

    The stated queries are dealt into blocks that go to every task; a task compares its rows with a block
    in matrix products of bounded size and emits its own best ``k`` per query, so what is shuffled is k rows per query
    and task. Scores are similarities: the negated distance for ``l2``. Vectors that are null or empty are nobody's neighbour and have none.
    """
    asked = queries.select("query_id", "embedding").where(F.size("embedding") > 0)
    blocks = max(1, math.ceil(asked.count() / block))
    types = {f.name: f.dataType.simpleString() for f in (*queries.schema, *docs.schema)}
    schema = f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double"
    import numpy as np

    out = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        out.append(docs.select("doc_id", "embedding").where(F.size("embedding") > 0).mapInArrow(_best_of_task([r.query_id for r in rows], to_arrow_type(queries.schema["query_id"].dataType), np.array([r.embedding for r in rows], np.float64), metric, k, same), schema))
    return ranked(reduce(DataFrame.unionByName, out), k)


def _best_of_task(ids: list, id_type, q, metric: str, k: int, same: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        if not ids:
            return
        own, doc_type = np.array(ids), None
        places = [slice(at, at + SCORED_QUERIES) for at in range(0, len(ids), SCORED_QUERIES)]
        # of each block of queries: who, what and score by who, falling score and id, and the least score that a full list has
        best: list = [None] * len(places)
        least = np.full(len(ids), -np.inf)
        for whole in batches:
            for batch in (whole.slice(at, SCORED_ROWS) for at in range(0, whole.num_rows, SCORED_ROWS)):
                doc_type, d = batch.column("doc_id").type, batch.column("doc_id").to_numpy(zero_copy_only=False)
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(d), -1)
                for n, place in enumerate(places):
                    s = _scores(q[place], x, metric)
                    if same:
                        s[own[place][:, None] == d] = -np.inf
                    s[~np.isfinite(s)] = -np.inf
                    bar = least[place]
                    if len(d) > k:
                        bar = np.maximum(bar, np.partition(s, len(d) - k, axis=1)[:, len(d) - k])
                    i, j = np.nonzero((s >= bar[:, None]) & (s > -np.inf))  # what equals the bar may have a smaller id
                    found = (i, d[j], s[i, j])
                    who, what, score = found if best[n] is None else (np.concatenate(z) for z in zip(best[n], found))
                    order = np.lexsort((what, -score, who))
                    who, what, score = who[order], what[order], score[order]
                    turn = np.arange(len(who)) - np.searchsorted(who, who)
                    least[place][who[turn == k - 1]] = score[turn == k - 1]
                    best[n] = (who[turn < k], what[turn < k], score[turn < k])
        for place, kept in zip(places, best):
            if kept is not None:
                yield pa.RecordBatch.from_arrays([pa.array(ids[place], id_type).take(pa.array(kept[0])), pa.array(kept[1], doc_type), pa.array(kept[2])], ["query_id", "doc_id", "score"])

    return run


def _scores(q, x, metric: str):
    """Rounded similarities of all rows of ``q`` and ``x``."""
    import numpy as np

    s = q @ x.T
    if metric == "l2":
        s = -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * s, 0))
    elif metric == "cosine":
        s /= np.sqrt((q**2).sum(1)[:, None] * (x**2).sum(1)) + 1e-300
    return np.round(s, DIGITS)


def parents_of(ranked_children: DataFrame, children: DataFrame, parents: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, parent_id, rank, child_id, source): the parent of each ranked child, once, where its best child stands.

    ``children`` is (child_id, parent_id), ``parents`` (parent_id, source). Children that nobody knows are dropped; a parent that is not
    among ``parents`` is kept with an empty source.
    """
    found = ranked_children.withColumnRenamed("doc_id", "child_id").join(children.select("child_id", "parent_id"), "child_id")
    first = found.groupBy("query_id", "parent_id").agg(F.min(F.struct("rank", "child_id")).alias("best"))
    order = Window.partitionBy("query_id").orderBy("best.rank", "best.child_id")
    out = first.withColumn("rank", F.row_number().over(order))
    out = out if k is None else out.where(F.col("rank") <= k)
    known = parents.groupBy("parent_id").agg(F.min("source").alias("source"))
    return out.join(known, "parent_id", "left").select("query_id", "parent_id", "rank", F.col("best.child_id").alias("child_id"), F.coalesce("source", F.lit("")).alias("source"))


def resolved(results: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """``results`` (with child_id, id, text, parent_id, any of them null) with ``key``: what one list calls by an id and another by its text is the same.

    The child's id, else the id, else the id of the child with the same text, else the first child of the parent, else null.
    """
    by_text = children.groupBy("text").agg(F.min("child_id").alias("of_text")).withColumnRenamed("text", "text_")
    by_parent = children.join(parents.select("parent_id").distinct(), "parent_id", "left_semi").groupBy("parent_id").agg(F.min("child_id").alias("of_parent")).withColumnRenamed("parent_id", "parent_")
    out = results.join(by_text, F.col("text") == F.col("text_"), "left").join(by_parent, F.col("parent_id") == F.col("parent_"), "left")
    return out.withColumn("key", F.coalesce("child_id", "id", "of_text", "of_parent")).drop("text_", "of_text", "parent_", "of_parent")


def rrf(*lists: DataFrame, k: int = RRF_K, top: int | None = 10) -> DataFrame:
    """Reciprocal-rank fusion of any number of ranked lists."""
    everything = reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", "rank") for x in lists])
    scores = everything.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), DIGITS + 2).alias("score"))
    return ranked(scores, top)


def lexical_rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, top: int | None = 10) -> DataFrame:
    """Candidates again, by coverage of the query's terms, then overlap, then their old rank."""
    asked = queries.select("query_id", T.terms(F.coalesce("query", F.lit(""))).alias("qt"))
    wanted = small(candidates.select("doc_id").distinct())
    texts = docs.join(wanted, "doc_id", "left_semi").select("doc_id", T.terms(F.coalesce("text", F.lit(""))).alias("dt"))
    both = candidates.select("query_id", "doc_id", F.col("rank").alias("old_rank")).join(asked, "query_id").join(texts, "doc_id")
    both = both.repartition(shuffle_partitions(docs.sparkSession), "query_id")  # few bytes but much work: a fixed number of partitions is not merged by size
    overlap = F.size(F.array_intersect("qt", "dt"))
    scored = both.select("query_id", "doc_id", "old_rank", overlap.alias("overlap"), F.round(overlap / F.greatest(F.size("qt"), F.lit(1)), DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("overlap"), F.asc("old_rank"), F.asc("doc_id"))
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.where(F.col("rank") <= top)


def retrieval_metrics(lists: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_relevant, recall_5, recall_10, mrr, ndcg_10) for every query; with nothing relevant recall and NDCG are 1."""
    gold = relevant.select("query_id", "doc_id").distinct()
    counts = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = lists.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"], "left_semi")
    per = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= 5).alias("h5"), F.count(F.lit(1)).alias("h10"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = queries.select("query_id").join(counts, "query_id", "left").join(per, "query_id", "left")
    n = F.col("n_relevant")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "query_id", F.coalesce(n, F.lit(0)).alias("n_relevant"),
        F.round(F.when(n.isNull(), 1.0).otherwise(zero(F.col("h5") / n)), DIGITS).alias("recall_5"), F.round(F.when(n.isNull(), 1.0).otherwise(zero(F.col("h10") / n)), DIGITS).alias("recall_10"),
        F.round(zero(1 / F.col("first")), DIGITS).alias("mrr"), F.round(F.when(n.isNull(), 1.0).otherwise(zero(F.col("dcg") / F.when(n.isNotNull(), ideal))), DIGITS).alias("ndcg_10"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10")])
