"""Retrieval queries: benchmark passages search documents; vectors whose id is divisible by 20 search all vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators import index as I
from ..operators import retrieval as R
from ..sources import shared
from ..sources.tables import spread, table

_W = r"[\p{L}\p{N}_]+"


def queries_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def docs_of(spark, sf_dir) -> DataFrame:
    return spread(spark, sf_dir, "documents").select("doc_id", "text")


def words_index(spark, sf_dir) -> I.Index:
    """The documents' words, kept for the application."""
    return I.kept(spark, f"{sf_dir}/documents.parquet", "documents", lambda: docs_of(spark, sf_dir))


def terms_index(spark, sf_dir) -> I.Index:
    return I.kept(spark, f"{sf_dir}/documents.parquet", "documents", lambda: docs_of(spark, sf_dir), I.overlap_terms)


def children_of(spark, sf_dir) -> DataFrame:
    """(child_id, parent_id, text): windows of the documents."""
    w = chunking.child_windows(docs_of(spark, sf_dir))
    return w.select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("window").cast("string")).alias("child_id"), F.col("doc_id").alias("parent_id"), F.col("chunk").alias("text"))


def children_index(spark, sf_dir) -> I.Index:
    return I.kept(spark, f"{sf_dir}/documents.parquet", "children", lambda: children_of(spark, sf_dir).withColumnRenamed("child_id", "doc_id"))


_VECTORS: dict[tuple, tuple[str, DataFrame]] = {}


def text_vectors(spark, sf_dir) -> DataFrame:
    """(doc_id, embedding) of the documents' texts, kept for the application; what is new since is added."""
    path = f"{sf_dir}/documents.parquet"
    key, state = (spark.sparkContext.applicationId, path), shared.version(spark, path)
    old = _VECTORS.get(key)
    if old is None or old[0] != state:
        docs = docs_of(spark, sf_dir)
        _VECTORS[key] = (state, shared.written(R.hashed_vectors(docs) if old is None else R.upsert_vectors(old[1], docs), "vectors"))
    return _VECTORS[key][1]


def _dense(spark, sf_dir, k: int) -> DataFrame:
    q = R.hashed_vectors(queries_of(spark, sf_dir).select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))).withColumnRenamed("doc_id", "query_id")
    return R.dense(q, text_vectors(spark, sf_dir), k=k, same=False)


def vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), v


def containing(q: DataFrame, d: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents whose text has a query's text word for word.

    A query's words other than its first and last are whole words of any text that contains it, so queries meet only documents
    that have their longest pair of such words, a key that splits the corpus finely. Queries without such a pair meet all documents.
    """
    words = lambda c: F.split(F.translate(c, "\n\t\r", "   "), " ")
    # an expression inside a lambda is evaluated for each element: the words are bound as a lambda's argument instead
    pairs_of = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    pairs = lambda w: F.get(F.transform(F.array(w), lambda x: F.array_distinct(pairs_of(x))), 0)
    asked = q.withColumn("w_", words("query")).withColumn("w_", F.slice("w_", 2, F.greatest(F.size("w_") - 2, F.lit(0))))
    asked = asked.withColumn("k", F.array_max(F.transform(pairs(F.col("w_")), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]).drop("w_")
    grams = d.select("doc_id", F.explode(pairs(words("text"))).alias("k"))
    met = shared.written(grams.join(R.small(asked.where("k is not null").select("query_id", "k")), "k").select("query_id", "doc_id").distinct(), "candidates")
    # texts are fetched for candidates only
    keyed = d.join(R.small(met), "doc_id").join(R.small(q), "query_id").where(F.contains("text", F.col("query"))).select("query_id", "doc_id")
    scanned = d.join(R.small(asked.where("k is null")), F.contains(d["text"], F.col("query"))).select("query_id", "doc_id")
    return keyed.unionByName(scanned).distinct()


def gold(spark, sf_dir) -> DataFrame:
    """(query_id, doc_id): documents that contain a passage word for word."""
    return containing(queries_of(spark, sf_dir), docs_of(spark, sf_dir))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(queries_of(spark, sf_dir), words_index(spark, sf_dir)).select("query_id", "doc_id", "rank", "score")


def bm25_corpus_stats(spark, sf_dir):
    return words_index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def lexical_topk(spark, sf_dir):
    return R.lexical_overlap(queries_of(spark, sf_dir), terms_index(spark, sf_dir)).select("query_id", "doc_id", "rank", "score")


def child_to_parent(spark, sf_dir):
    """Passages search windows of documents; the windows lead to their documents and these to their sources."""
    children = children_of(spark, sf_dir).select("child_id", "parent_id")
    parents = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("parent_id"), "source")
    # written, so that its rows can be counted: while they are few, windows and documents are not moved for them
    top = shared.written(R.bm25(queries_of(spark, sf_dir), children_index(spark, sf_dir), 20), "ranked")
    return R.parents_of(R.small(top), children, parents, 5).select("query_id", "parent_id", "rank", "child_id", "source")


def dense_text_topk(spark, sf_dir):
    """Passages and documents as hashed vectors."""
    return _dense(spark, sf_dir, 10).select("query_id", "doc_id", "rank", "score")


def id_resolution(spark, sf_dir):
    """Results that name a window by its id, by another id, by its text or by its document only."""
    c = children_of(spark, sf_dir)
    parents = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("parent_id"))
    kind = F.col("parent_id") % 4
    none = F.lit(None).cast("string")
    named = c.select(
        F.col("child_id").alias("row_id"), F.when(kind == 0, F.col("child_id")).otherwise(none).alias("child_id"), F.when(kind == 1, F.concat(F.lit("x"), "child_id")).otherwise(none).alias("id"),
        F.when(kind == 3, F.col("text")).otherwise(none).alias("text"), F.when(kind == 2, F.col("parent_id")).alias("parent_id"),
    )
    return R.resolved(named, c, parents).select("row_id", "key")


def dense_topk(spark, sf_dir):
    return R.dense(*vectors(spark, sf_dir)).select("query_id", "doc_id", "rank", "score")


def rrf_three_way(spark, sf_dir):
    q, v = vectors(spark, sf_dir)
    return R.rrf(*[R.dense(q, v, m) for m in ("cosine", "l2", "dot")]).select("query_id", "doc_id", "rank", "score")


def hybrid_rrf(spark, sf_dir):
    """Dense and sparse lists as one."""
    return R.rrf(_dense(spark, sf_dir, 10), R.bm25(queries_of(spark, sf_dir), words_index(spark, sf_dir))).select("query_id", "doc_id", "rank", "score")


def lexical_rerank(spark, sf_dir):
    q = queries_of(spark, sf_dir)
    return R.lexical_rerank(R.bm25(q, words_index(spark, sf_dir), 50), q, docs_of(spark, sf_dir)).select("query_id", "doc_id", "old_rank", "rank", "overlap", "score")


def retrieval_metrics(spark, sf_dir):
    q = queries_of(spark, sf_dir)
    return R.retrieval_metrics(R.bm25(q, words_index(spark, sf_dir)), gold(spark, sf_dir), q)


def gap_report(spark, sf_dir):
    """Queries whose relevant documents are not all among the first ten."""
    return retrieval_metrics(spark, sf_dir).where("recall_10 < 1").select("query_id", "n_relevant", "recall_10")


def pipeline_compare(spark, sf_dir):
    """Sparse, dense, both, and both re-ranked, by the same measures."""
    q, d, g = queries_of(spark, sf_dir), docs_of(spark, sf_dir), shared.written(gold(spark, sf_dir), "gold")
    # written: each list is part of up to three others, and is searched once
    bm25, dense = shared.written(R.bm25(q, words_index(spark, sf_dir), 50), "bm25"), shared.written(_dense(spark, sf_dir, 50), "dense")
    fused = shared.written(R.rrf(bm25, dense, top=50), "fused")
    lists = {"bm25": bm25, "dense": dense, "hybrid": fused, "rerank": R.lexical_rerank(fused, q, d, 50)}
    # a row each, written: each list is planned by itself
    return reduce(DataFrame.unionByName, [shared.written(R.mean_metrics(R.retrieval_metrics(x, g, q)), n).withColumn("pipeline", F.lit(n)) for n, x in lists.items()])


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_corpus_stats, lexical_topk, child_to_parent, dense_topk, dense_text_topk, id_resolution, rrf_three_way, hybrid_rrf, lexical_rerank, retrieval_metrics, gap_report, pipeline_compare)}

_BM25 = rf"""
tok as materialized (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_W}') as w from documents),
st as materialized (select count(*) as n, avg(len(w)) as avgdl from tok),
dfs as (select term, count(*) as df from (select unnest(list_distinct(w)) as term from tok) group by term),
raw as materialized (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as r from dfs, st),
mean as materialized (select avg(r) as m from raw),
idf as materialized (select term, df, case when r < 0 then 0.25 * m else r end as idf from raw, mean),
qt as materialized (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest(regexp_extract_all(lower(text), '{_W}')) as term from benchmark) group by all),
tf as materialized (select doc_id, dl, term, count(*) as tf from (select doc_id, len(w) as dl, unnest(w) as term from tok) where term in (select term from qt) group by all),
sc as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from tf join qt using (term) join idf using (term), st group by all),
bm as materialized (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc where score > 0)"""
_QX = r"""
qx as (select item_id as query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}')) as t from benchmark),
dx as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]{3,}')) as t from documents)"""
_LEX = _QX + r""",
qe as (select query_id, len(t) as n, unnest(t) as term from qx), de as (select doc_id, unnest(t) as term from dx),
lx as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(count(*) / n, 6) as score from qe join de using (term) group by query_id, doc_id, n))"""
_DENSE = rf"""
tv as (select 'd' as kind, doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '{_W}') as w from documents union all select 'q', item_id, regexp_extract_all(lower(coalesce(text, '')), '{_W}') from benchmark),
tb as (select kind, id, (31 * ord(x) + 7 * ord(x[-1]) + length(x)) % 64 as b, count(*)::double as c from (select kind, id, unnest(w) as x from tv) group by all),
tn as (select kind, id, sqrt(sum(c * c)) as n from tb group by all),
dn as (select q.id as query_id, d.id as doc_id, round(sum(q.c * d.c) / (any_value(qn.n) * any_value(dn.n)), 6) as score from tb q join tb d using (b) join tn qn on qn.kind = 'q' and qn.id = q.id join tn dn on dn.kind = 'd' and dn.id = d.id where q.kind = 'q' and d.kind = 'd' group by q.id, d.id),
dz as (select query_id, doc_id, score from dn union all select q.id, d.id, 0.0 from (select id from tv where kind = 'q') q, (select id from tv where kind = 'd') d where (q.id, d.id) not in (select (query_id, doc_id) from dn)),
de as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from dz)"""
_CHILDREN = r"""
ct as materialized (select doc_id, regexp_extract_all(text, '\S+\s*') as t from documents), cw as materialized (select doc_id, t, unnest(range(0, len(t), 96)) as start from ct where len(t) > 0),
ch as materialized (select doc_id || ':' || (start // 96) as child_id, doc_id as parent_id, array_to_string(t[start + 1 : start + 128], '') as text from cw)"""
_VEC = """
v as (select vec_id, cast(embedding as double[]) as e from embeddings), q as (select vec_id as query_id, e as qe from v where vec_id % 20 = 0),
p as (select query_id, vec_id as doc_id, round(list_cosine_similarity(qe, e), 6) as cosine, round(-list_distance(qe, e), 6) as l2, round(list_inner_product(qe, e), 6) as dot from q join v on vec_id <> query_id)"""
_RANKS = " union all ".join(f"select query_id, doc_id, row_number() over (partition by query_id order by {m} desc, doc_id) as rank from p qualify rank <= 10" for m in ("cosine", "l2", "dot"))


def _fuse(lists: str) -> str:
    return f"select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, score from (select query_id, doc_id, round(sum(1 / (60 + rank)), 8) as score from ({lists}) group by all)"


def _rerank(candidates: str) -> str:
    return f"""select query_id, doc_id, old_rank, row_number() over (partition by query_id order by score desc, overlap desc, old_rank, doc_id) as rank, overlap, score from
        (select query_id, doc_id, c.rank as old_rank, len(list_intersect(qx.t, dx.t)) as overlap, round(len(list_intersect(qx.t, dx.t)) / greatest(len(qx.t), 1), 6) as score from {candidates} c join qx using (query_id) join dx using (doc_id))"""


_GOLD = "gold as (select item_id as query_id, doc_id from benchmark b join documents d on contains(d.text, b.text))"


def _metrics(lists: str) -> str:
    return f"""select b.item_id as query_id, coalesce(g.n, 0) as n_relevant, round(case when g.n is null then 1.0 else coalesce(h5 / g.n, 0) end, 6) as recall_5, round(case when g.n is null then 1.0 else coalesce(h10 / g.n, 0) end, 6) as recall_10,
        round(coalesce(1 / first, 0), 6) as mrr, round(case when g.n is null then 1.0 else coalesce(dcg / (select sum(1 / log2(i + 1)) from range(1, least(g.n, 10) + 1) t(i)), 0) end, 6) as ndcg_10
        from benchmark b left join (select query_id, count(*) as n from gold group by 1) g on g.query_id = b.item_id
        left join (select query_id, count(*) filter (rank <= 5) as h5, count(*) as h10, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from {lists} l join gold using (query_id, doc_id) where rank <= 10 group by 1) h on h.query_id = b.item_id"""


def _means(name: str, lists: str) -> str:
    return f"select '{name}' as pipeline, count(*) as n_queries, round(avg(recall_5), 4) as recall_5, round(avg(recall_10), 4) as recall_10, round(avg(mrr), 4) as mrr, round(avg(ndcg_10), 4) as ndcg_10 from ({_metrics(lists)})"


ORACLE_SQL = {
    "bm25_topk": f"with {_BM25} select query_id, doc_id, rank, score from bm where rank <= 10",
    "bm25_corpus_stats": f"with {_BM25} select term, df, round(idf, 6) as idf from idf",
    "lexical_topk": f"with {_LEX} select query_id, doc_id, rank, score from lx where rank <= 10",
    "dense_topk": f"with {_VEC} select query_id, doc_id, row_number() over (partition by query_id order by cosine desc, doc_id) as rank, cosine as score from p qualify rank <= 10",
    "rrf_three_way": f"with {_VEC}, l as ({_RANKS}) select * from ({_fuse('from l')}) where rank <= 10",
    "hybrid_rrf": f"with {_BM25}, {_DENSE} select * from ({_fuse('select query_id, doc_id, rank from bm where rank <= 10 union all select query_id, doc_id, rank from de where rank <= 10')}) where rank <= 10",
    "dense_text_topk": f"with {_DENSE} select query_id, doc_id, rank, score from de where rank <= 10",
    "child_to_parent": f"""with {_CHILDREN}, {_BM25.replace("from documents", "from (select child_id as doc_id, text from ch)")}, f as (select query_id, parent_id, min(rank) as r from bm join ch on ch.child_id = bm.doc_id where rank <= 20 group by all),
        p as (select query_id, parent_id, r, row_number() over (partition by query_id order by r) as rank from f)
        select p.query_id, parent_id, p.rank, bm.doc_id as child_id, coalesce(d.source, '') as source from p join bm on bm.query_id = p.query_id and bm.rank = p.r left join documents d on d.doc_id = parent_id and d.doc_id % 7 <> 0 where p.rank <= 5""",
    "id_resolution": f"""with {_CHILDREN}, bt as (select text, min(child_id) as k from ch group by 1), bp as (select parent_id, min(child_id) as k from ch where parent_id % 2 = 0 group by 1)
        select child_id as row_id, case parent_id % 4 when 0 then child_id when 1 then 'x' || child_id when 3 then bt.k else bp.k end as key from ch left join bt using (text) left join bp using (parent_id)""",
    "lexical_rerank": f"with {_BM25}, {_LEX} select * from ({_rerank('(from bm where rank <= 50)')}) where rank <= 10",
    "retrieval_metrics": f"with {_BM25}, {_GOLD} {_metrics('(from bm where rank <= 10)')}",
    "gap_report": f"with {_BM25}, {_GOLD} select query_id, n_relevant, recall_10 from ({_metrics('(from bm where rank <= 10)')}) where recall_10 < 1",
    "pipeline_compare": f"""with {_BM25}, {_DENSE}, {_QX}, {_GOLD}, b50 as (select query_id, doc_id, rank from bm where rank <= 50), l50 as (select query_id, doc_id, rank from de where rank <= 50),
        f50 as (select * from ({_fuse("from b50 union all from l50")}) where rank <= 50), r50 as ({_rerank("f50")})
        {_means("bm25", "b50")} union all {_means("dense", "l50")} union all {_means("hybrid", "f50")} union all {_means("rerank", "r50")}""",
}
