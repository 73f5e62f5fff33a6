"""A term index that is written once and searched often.

Documents are dealt to shards by a hash of their id. A posting row holds a shard's documents with one term (ids, counts and lengths as
arrays), so a hot term is split over the shards and no row is larger than a shard. A search reads the rows of the terms that it asks for,
brings a shard's rows together, and scores block of queries by shard as one matrix product; a shard emits its own best documents only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..sources import shared

# BM25 parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6
#: Documents of a shard, about.
SHARD_DOCS = 2048
#: Queries, and pairs of query and term, that are asked at once: they travel to every task.
BLOCK_QUERIES, BLOCK_PAIRS = 1000, 1_000_000
#: Asked terms that are sought in the files' statistics, at most.
PUSHED_TERMS = 500
#: Terms of a shard in one matrix product.
BLOCK_TERMS = 4096


def bm25_words(text: Column) -> Column:
    return T.words(F.coalesce(text, F.lit("")))


def overlap_terms(text: Column) -> Column:
    return T.terms(F.coalesce(text, F.lit("")))


def counted(docs: DataFrame, tokens: Callable[[Column], Column], shards: int, parts: int) -> DataFrame:
    """(shard, doc_id, dl, term, tf): terms of each document. Rows are dealt by shard, and all that follows keeps that."""
    t = T.evaluated(docs.select("doc_id", "text"), {"w": tokens(F.col("text")), "shard": F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")})
    dealt = t.select("shard", "doc_id", "w").repartition(parts, "shard")
    words = dealt.select("shard", "doc_id", F.size("w").alias("dl"), F.explode_outer("w").alias("term")).where("term is not null")
    return words.groupBy("shard", "doc_id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def statistics(terms: DataFrame, n: int) -> DataFrame:
    """(term, df, ctf, idf) from (term, df, ctf); negative idf becomes EPSILON times the mean idf of all terms."""
    raw = terms.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", "ctf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


class Index:
    """Postings (shard, term, docs, tfs, dls) and terms (term, df, ctf, idf) in the shared folder, and the corpus's size."""

    def __init__(self, spark: SparkSession, postings: DataFrame, terms: DataFrame, n: int, avgdl: float, tokens: Callable[[Column], Column], id_type: str):
        self.spark, self.postings, self.terms, self.n, self.avgdl, self.tokens, self.id_type = spark, postings, terms, n, avgdl, tokens, id_type

    @classmethod
    def build(cls, docs: DataFrame, tokens: Callable[[Column], Column] = bm25_words, shard_docs: int = SHARD_DOCS) -> Index:
        """An index of (doc_id, text). The texts are tokenised and shuffled once."""
        spark, n = docs.sparkSession, docs.count()
        shards = max(1, math.ceil(n / shard_docs))
        rows = counted(docs, tokens, shards, min(shards, 4 * shared.shuffle_partitions(spark)))
        posting = F.collect_list(F.struct("doc_id", "tf", "dl"))
        by_term = rows.groupBy("shard", "term").agg(posting.alias("p")).select("shard", "term", F.col("p.doc_id").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
        postings = shared.written(by_term.sortWithinPartitions("term", "shard"), "postings")
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
        known = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.sum(total(F.col("tfs"))).alias("ctf"))
        terms = shared.written(statistics(known, n), "terms")
        size = terms.agg(F.sum("ctf")).first()[0] or 0
        return cls(spark, postings, terms, n, size / n if n else 0.0, tokens, docs.schema["doc_id"].dataType.simpleString())

    def drop(self) -> None:
        shared.drop(self.postings, self.terms)

    def bm25(self, queries: DataFrame, k: int | None = 10) -> DataFrame:
        """(query_id, doc_id, score): the best ``k`` documents of each shard for each (query_id, query); repeated query terms count as often; scores of 0 are left out."""
        return self._search(queries, k, True)

    def overlap(self, queries: DataFrame, k: int | None = 10) -> DataFrame:
        """(query_id, doc_id, score): documents by the share of a query's distinct terms that they contain."""
        return self._search(queries, k, False)

    def _hits(self, wanted: DataFrame, terms: list[str]) -> DataFrame:
        """(shard, t, idf, docs, tfs, dls): postings of the asked terms."""
        rows = self.postings.where(F.col("term").isin(terms)) if len(terms) <= PUSHED_TERMS else self.postings  # files are sorted by term: few terms read few of their parts
        return rows.join(F.broadcast(wanted), "term").select("shard", "t", "idf", "docs", "tfs", "dls")

    def _search(self, queries: DataFrame, k: int | None, weighted: bool) -> DataFrame:
        words = T.evaluated(queries.select("query_id", "query"), {"w": self.tokens(F.col("query"))})
        asked = words.select("query_id", F.size(F.array_distinct("w")).alias("n"), F.explode_outer("w").alias("term")).where("term is not null").groupBy("query_id", "n", "term").agg(F.count(F.lit(1)).alias("qtf"))
        asked = asked.join(self.terms.select("term", "idf"), "term")
        few = asked.limit(BLOCK_PAIRS + 1).collect()
        if len(few) <= BLOCK_PAIRS and len({r.query_id for r in few}) <= BLOCK_QUERIES:
            parts = [few]
        else:
            size = asked.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("query_id").alias("queries")).first()
            blocks = max(2, math.ceil(size.pairs / BLOCK_PAIRS), math.ceil(size.queries / BLOCK_QUERIES))
            parts = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect() for b in range(blocks))
        types = {f.name: f.dataType.simpleString() for f in queries.schema}
        schema = f"query_id {types['query_id']}, doc_id {self.id_type}, score double"
        out = []
        for rows in parts:
            ids = sorted({r.query_id for r in rows})
            terms = sorted({r.term for r in rows})
            at, place = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(ids)}
            pairs = sorted((at[r.term], place[r.query_id], float(r.qtf) if weighted else 1 / r.n) for r in rows)
            idf = {r.term: r.idf for r in rows}
            wanted = self.spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "t": pa.array(range(len(terms)), pa.int32()), "idf": pa.array([idf[t] if weighted else 1.0 for t in terms], pa.float64())}))
            hits = self._hits(wanted, terms)  # as many terms as a block has pairs at most
            dealt = hits.repartition(shared.shuffle_partitions(self.spark), "shard").sortWithinPartitions("shard")
            out.append(dealt.mapInArrow(_scorer(ids, to_arrow_type(queries.schema["query_id"].dataType), pairs, self.avgdl if weighted else None, k), schema))
        return reduce(DataFrame.unionByName, out)


def _scorer(ids: list, id_type: pa.DataType, pairs: list, avgdl: float | None, k: int | None):
    """Scores of a block of queries for the documents of each shard, from posting rows that are sorted by shard."""

    def run(batches):
        import numpy as np

        t_of, q_of, weight_of = (np.array([p[j] for p in pairs], kind) for j, kind in ((0, np.int64), (1, np.int64), (2, np.float64)))

        def scored(parts: list[pa.RecordBatch]):
            rows = pa.Table.from_batches(parts).combine_chunks()
            t, idf = rows.column("t").to_numpy(), rows.column("idf").to_numpy()
            lists = rows.column("docs").combine_chunks()
            lengths = lists.value_lengths().to_numpy()
            docs, column = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            if avgdl is None:
                weight = np.ones(len(column))
            else:
                tf, dl = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.float64) for c in ("tfs", "dls"))
                weight = np.repeat(idf, lengths) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            if "gone" in rows.column_names:  # bits of deleted documents, by their place in the shard
                places = rows.column("places").combine_chunks().flatten().to_numpy()
                for bits in rows.column("gone").unique().to_pylist():
                    if bits is not None:
                        dead = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[places].astype(bool)
                        weight[dead] = 0.0
            known, number = np.unique(t, return_inverse=True)
            line, scores = np.repeat(number, lengths), np.zeros((len(ids), len(docs)))
            for at in range(0, len(known), BLOCK_TERMS):
                part = known[at : at + BLOCK_TERMS]
                inside = (line >= at) & (line < at + len(part))
                by_doc = np.zeros((len(part), len(docs)))
                by_doc[line[inside] - at, column[inside]] = weight[inside]
                by_query = np.zeros((len(ids), len(part)))
                place = np.searchsorted(part, t_of)
                own = (place < len(part)) & (part[np.minimum(place, len(part) - 1)] == t_of)
                by_query[q_of[own], place[own]] = weight_of[own]
                scores += by_query @ by_doc
            scores = np.round(scores, DIGITS)
            # documents stand in order of id: a stable sort breaks ties by it
            best = np.argsort(-scores, axis=1, kind="stable")[:, : len(docs) if k is None else k]
            top = np.take_along_axis(scores, best, axis=1)
            q, j = np.nonzero(top > 0)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type).take(pa.array(q)), pa.array(docs, lists.type.value_type).take(pa.array(best[q, j])), pa.array(top[q, j])], ["query_id", "doc_id", "score"])

        held, shard = [], None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            at = 0
            while at < len(shards):
                to = int(np.searchsorted(shards, shards[at], "right"))
                if held and shards[at] != shard:
                    yield scored(held)
                    held = []
                shard = shards[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield scored(held)

    return run


_BUILT: dict[tuple, Index] = {}


def kept(spark: SparkSession, path: str, name: str, docs: Callable[[], DataFrame], tokens: Callable[[Column], Column] = bm25_words) -> Index:
    """The index of a table, built when it is first asked for in an application and again once the table's files have changed."""
    key = (spark.sparkContext.applicationId, path, name, tokens.__name__)
    state = shared.version(spark, path)
    found = _BUILT.get(key)
    if found is None or found.state != state:
        if found is not None:
            found.drop()
        found = Index.build(docs(), tokens)
        found.state = state
        _BUILT[key] = found
    return found
