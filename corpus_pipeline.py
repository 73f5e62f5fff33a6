"""A corpus from raw documents to packed training sequences: the stages in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents, whatever others there are beside doc_id, text and lang. For all of them: a null text counts as
empty, texts of any length are read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm import decontaminate, exact_dedup, langid, minhash, packing, queries
from verdictlake.llm.scratch import drop, written

#: Documents of which at least so many hundredths of all five-word shingles are shared are near-duplicates.
NEAR_PER_CENT = 80
#: Keys of dropped rows that are broadcast, at most: some 10 MB. More are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Words and ids that a worker keeps: workers live through all stages, and what they keep adds up.
WORD_BYTES = 48 << 20


def _without(docs: DataFrame, gone: DataFrame, keys: dict) -> DataFrame:
    """Rows of ``docs`` that agree with none of the table ``gone`` in all keys (name in ``gone`` -> column); nulls are equal.

    Its distinct keys are written and counted: few are broadcast, and the texts are not moved.
    """
    gone = written(gone.select(*keys).distinct(), "dropped")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), *[c.alias(f"{k}_") for k, c in keys.items()])
    same = [rows[f"{k}_"].eqNullSafe(gone[k]) for k in keys]
    out = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti").select("row_.*")
    out.scratch_tables = [gone]
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which no language can be told (no letter, or no text), also where there is no language to learn. Each row is judged by itself."""
    model = queries.language_model(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict_language(docs, model, with_text=True)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select("row_.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays. Rows that agree in id and text, null ids too, stay or go together."""
    found = exact_dedup.exact_dedup(docs)
    out = _without(docs, found.where("not kept"), {"doc_id": F.col("doc_id"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "raw_hash": F.xxhash64("text")})
    drop(found)
    return out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays. Rows that share an id stay or go together; those with a null id or no words stay."""
    found = minhash.near_duplicates(docs, per_cent=NEAR_PER_CENT)
    out = _without(docs, found.where("not kept"), {"doc_id": F.col("doc_id")})
    drop(found)
    return out


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Each row is judged by itself."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. Rows that repeat are packed one by one; a null id stays null."""
    return packing.pack_documents(docs, remembered_bytes=WORD_BYTES)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmarks), ("packing", pack)]

#: Tokenisation, MinHash groups and learnt languages have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        kept = written(made, f"stage-{name}")
        drop(docs, *getattr(made, "scratch_tables", ()))
        docs = kept
    return docs
