"""Scans and sinks: JSON records, parquet tables, idempotent uploads, multi-source unions."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from . import shared

METADATA = "source_document string, page_number int, section_inferred string, content_type string"
RECORD = "source_document string, page_number int, section_inferred string, content_type string, raw_content string, table_index int"
PARENT = f"parent_id string, text_content string, metadata struct<{', '.join(p.strip().replace(' ', ':', 1) for p in METADATA.split(','))}>"
CHILD = f"child_id string, {PARENT}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of at most so many bytes is dealt out before work that costs far more per row than moving the row.
SPREAD_BYTES = 1 << 30


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly work per row. A small one may be a single row group, and so a single task: its rows are dealt over all cores. A large one is split as it is."""
    df = table(spark, sf_dir, name)
    return df.repartition(spark.sparkContext.defaultParallelism) if shared.size(spark, f"{sf_dir}/{name}.parquet") <= SPREAD_BYTES else df


#: Bytes of a table's files for each partition that it is dealt to.
DEAL_BYTES = 2 << 20


def parts_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    return max(shared.shuffle_partitions(spark), math.ceil(shared.size(spark, f"{sf_dir}/{name}.parquet") / DEAL_BYTES))


def dealt(spark: SparkSession, sf_dir: str, name: str, columns: list[str], *keys: str) -> DataFrame:
    """Columns of a table, dealt by key to as many partitions as the table's bytes ask for. What groups, joins and orders by the keys afterwards keeps them, so that a task's share does not grow with the table."""
    return table(spark, sf_dir, name).select(*columns).repartition(parts_of(spark, sf_dir, name), *keys)


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of a JSON file that holds one array. Content that is a table stays JSON text; see ``split_content``."""
    return spark.read.schema(schema).json(path, multiLine=True)


def split_content(records: DataFrame, raw: str = "raw_content") -> DataFrame:
    """Adds text (null for tables) and table_rows (null for text)."""
    rows = F.from_json(raw, "array<array<string>>")
    is_table = F.col("content_type") == "table"
    return records.withColumns({"text": F.when(~is_table, F.col(raw)), "table_rows": F.when(is_table, rows)})


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, one overwrite per path, so that writing again changes nothing."""
    df.write.mode("overwrite").json(path)


#: Folders that a table of documents is dealt to.
BUCKETS = 64


def replace_documents(new: DataFrame, path: str, key: str = "document_id", buckets: int = BUCKETS) -> None:
    """Appends by document: rows of documents that occur in ``new`` are replaced, others stay.

    Documents are dealt to folders by a hash; only folders that a new document falls in are read and written again.
    """
    spark = new.sparkSession
    fresh = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except AnalysisException:  # nothing was written yet
        old = None
    if old is not None:
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
        kept = old.where(F.col("bucket").isin(touched)).join(fresh.select(key).distinct(), key, "left_anti")
        fresh = shared.written(kept.unionByName(fresh, allowMissingColumns=True), "documents")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    shared.drop(fresh)


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Parquet tables of a folder as views, for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def read_evolved(spark: SparkSession, path: str, defaults: dict) -> DataFrame:
    """A table whose files may lack columns that were added later: these have their defaults."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.withColumns({k: F.coalesce(F.col(k), v) if k in df.columns else v for k, v in defaults.items()})


def write_summary(metrics: DataFrame, path: str, title: str = "Summary") -> None:
    """A small table of metrics as JSON lines and as a markdown table, in two folders; again changes nothing."""
    rows = metrics.coalesce(1)
    rows.write.mode("overwrite").json(f"{path}/json")
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = metrics.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(metrics.columns) + " |"), (3, "| " + " | ".join([":---"] * len(metrics.columns)) + " |")], "n int, value string")
    body = rows.select(F.lit(4).alias("n"), line([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in metrics.columns]).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("n", "value").select("value").write.mode("overwrite").text(f"{path}/markdown")


def ready(statuses: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Documents that are ready; a table of ids (document_id) restricts them, none does not."""
    out = statuses.where("status = 'ready'")
    return out if ids is None else out.join(ids.select("document_id"), "document_id", "left_semi")


def union_sources(seeded: DataFrame, uploaded: DataFrame | None, include_seeded: bool = True, include_uploaded: bool = False) -> DataFrame:
    """Chunks by source mode: seeded, both, or uploaded only; excluding the seeded ones forces uploads on."""
    one = seeded.withColumn("source_type", F.lit("seeded"))
    if uploaded is None or (include_seeded and not include_uploaded):
        return one
    two = uploaded.withColumn("source_type", F.lit("uploaded_document"))
    return one.unionByName(two, allowMissingColumns=True) if include_seeded else two


def register_uploads(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with document_id by content; copies beyond the first (by path) are replays of it."""
    from pyspark.sql import Window

    named = files.withColumn("document_id", content_id(F.col(content)))
    turn = F.row_number().over(Window.partitionBy("document_id").orderBy("path"))
    return named.withColumn("idempotent_replay", turn > 1)


def without_nulls(metadata: str):
    """A map without its null values."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull())


def tolerant_map(json: str):
    """A JSON object as a map of strings; an empty map if it does not parse."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def tolerant_field(json: str, path: str, kind: str, default):
    """The value at a path of a JSON text as ``kind``, or ``default`` where the text does not parse, the path leads nowhere, or the value is of another kind or null."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), path, kind), F.lit(default).cast(kind))


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as (path, modificationTime, length, content, document_id)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("document_id", content_id(F.col("content")))
