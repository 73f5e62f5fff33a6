"""A term index that is updated in place, beside one that is built at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.segments import SegmentedIndex
from ..sources import shared
from . import ranking


_UPDATED: dict[tuple, tuple[str, SegmentedIndex]] = {}


def updated_index(spark, sf_dir) -> SegmentedIndex:
    """The documents in three parts, some of them as drafts that later parts replace, less those whose id leaves 5 over 11. Kept for the application while the table's files stay."""
    path = f"{sf_dir}/documents.parquet"
    key, state = (spark.sparkContext.applicationId, path), shared.version(spark, path)
    if _UPDATED.get(key, ("",))[0] != state:
        _UPDATED[key] = (state, _updated(spark, sf_dir))
    return _UPDATED[key][1]


def _updated(spark, sf_dir) -> SegmentedIndex:
    docs = ranking.docs_of(spark, sf_dir).where("doc_id is not null")
    index = SegmentedIndex(spark, shared.new_path(spark, "segmented"))
    index.add(docs.where("doc_id % 3 = 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("draft draft "), "text")).otherwise(F.col("text"))))
    index.add(docs.where("doc_id % 3 = 1"))
    index.delete(docs.where("doc_id % 11 = 5 and doc_id % 3 <> 2"))
    index.add(docs.where("(doc_id % 3 = 2 or doc_id % 10 = 0) and (doc_id % 11 <> 5 or doc_id % 3 = 2)"))
    index.delete(docs.where("doc_id % 11 = 5"))
    return index


def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages search an index after additions, replacements and deletions."""
    return R.bm25(ranking.queries_of(spark, sf_dir), updated_index(spark, sf_dir)).select("query_id", "doc_id", "rank", "score")


def segment_statistics(spark, sf_dir):
    """Statistics of the live documents of an updated index."""
    return updated_index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


QUERIES = {f.__name__: f for f in (bm25_segments, segment_statistics)}

_LIVE = ranking._BM25.replace("from documents", "from (select * from documents where doc_id % 11 <> 5)")
ORACLE_SQL = {
    "bm25_segments": f"with {_LIVE} select query_id, doc_id, rank, score from bm where rank <= 10",
    "segment_statistics": f"with {_LIVE} select term, df, round(idf, 6) as idf from idf",
}
