"""Document ingestion as a stream: stage events to latest status, retries and dead letters.

Events are (event_id, ts, document_id, event_type, failed). A failed event is retried until its document
has failed ``MAX_RETRIES`` times; the next failure is a dead letter. State is kept per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.manifest import Manifest

MAX_RETRIES = 3
EVENT = "event_id long, ts timestamp, document_id long, event_type string, failed boolean"
#: Event type -> status that it leads to.
STATUS = {"signup": "received", "view": "parsing", "click": "indexing", "purchase": "ready", "error": "failed"}


def latest_status(events: DataFrame, status: dict | None = None) -> DataFrame:
    """(document_id, status, event_id, n_events): latest wins by event id, never by arrival. Works on batches and streams alike."""
    mapping = F.create_map(*[F.lit(x) for kv in (status or STATUS).items() for x in kv])
    rows = events.withColumn("status", F.coalesce(mapping[F.col("event_type")], F.lit("quarantined")))
    return rows.groupBy("document_id").agg(F.max_by("status", "event_id").alias("status"), F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n_events"))


def retries(events: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """(document_id, event_id, attempt, outcome) of failed events, in batch: retry up to ``most`` times, then dead_letter."""
    w = Window.partitionBy("document_id").orderBy("event_id")
    failed = events.where("failed").withColumn("attempt", F.row_number().over(w))
    return failed.select("document_id", "event_id", "attempt", F.when(F.col("attempt") <= most, "retry").otherwise("dead_letter").alias("outcome"))


def retries_stream(events: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """The same over a stream: the count per document is state that outlives micro-batches."""
    import pandas as pd

    def run(key, frames, state):
        n = state.get[0] if state.exists else 0
        for frame in frames:
            ids = sorted(frame["event_id"].tolist())
            out = pd.DataFrame({"document_id": key[0], "event_id": ids, "attempt": range(n + 1, n + 1 + len(ids))})
            out["outcome"] = ["retry" if a <= most else "dead_letter" for a in out["attempt"]]
            n += len(ids)
            yield out
        state.update((n,))

    return events.where("failed").groupBy("document_id").applyInPandasWithState(run, "document_id long, event_id long, attempt int, outcome string", "n int", "append", "NoTimeout")


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once although it may be delivered again within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by type and event-time window (an extension: the reviewed process has no event time)."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("int")).alias("n_failed")).select(F.col("w.start").alias("start"), "event_type", "n", "n_failed")


def upsert_sink(path: str, key: str = "document_id"):
    """For ``foreachBatch``: writes a batch under its number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


#: Folders of keys of a merged table.
BUCKETS = 32


def merge_sink(path: str, key: str = "document_id", order: str = "event_id", buckets: int = BUCKETS):
    """For ``foreachBatch``: one row per key, the one with the greatest ``order``, whatever batches come, again or late.

    A batch is merged with the buckets of keys that it touches; these are written beside the old ones, and a manifest that names
    the new ones is renamed into place with the batch's number. A batch that runs again finds its number, or its rows, there already and changes nothing; a run that dies leaves the old
    table. Rows without a key are left out; of rows of one key and order the greatest stays.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        manifest = Manifest(spark, path, {"buckets": {}, "last": None, "count": buckets})
        if manifest.state["last"] == number:
            return
        count, known = manifest.state["count"], manifest.state["buckets"]
        rows = batch.where(F.col(key).isNotNull()).withColumn("bucket_", F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))
        touched = [r.bucket_ for r in rows.select("bucket_").distinct().collect()]  # as many as there are buckets
        old = [known[str(b)] for b in touched if str(b) in known]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket_", F.pmod(F.xxhash64(key), F.lit(count)).cast("int")))
        whole = F.struct(order, *[c for c in batch.columns if c != order])
        merged = rows.groupBy("bucket_", key).agg(F.max(whole).alias("r")).select("bucket_", *[F.col(f"r.{c}").alias(c) for c in batch.columns])
        place = manifest.new_path("rows")
        merged.write.partitionBy("bucket_").parquet(place)
        manifest.commit({"buckets": known | {str(b): f"{place}/bucket_={b}" for b in touched}, "last": number, "count": count})

    return write


def merged_table(spark, path: str, schema) -> DataFrame:
    """The rows that a :func:`merge_sink` committed."""
    known = Manifest(spark, path, {"buckets": {}}).state["buckets"]
    return spark.read.schema(schema).parquet(*known.values()) if known else spark.createDataFrame([], schema)


#: Wire format of an event.
WIRE = "event_id string, event_type string, document_id string, content_hash string, source_path string, original_filename string, produced_at timestamp, retry_count int, metadata map<string,string>"
TOPICS = ("document.ingested", "document.parsed", "embedding.created")


def encoded(events: DataFrame) -> DataFrame:
    """(key, value): events as JSON, keyed by document, so that a document's events keep their order."""
    return events.select(F.col("document_id").cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def decoded(messages: DataFrame, schema: str = WIRE, topics: tuple = TOPICS) -> DataFrame:
    """Events of (key, value), with ``problem``: null, ``malformed`` or ``unsupported``. Nothing is dropped."""
    e = F.from_json(F.col("value").cast("string"), schema)
    rows = messages.select("key", "value", e.alias("e"))
    problem = F.when(F.col("e").isNull() | F.col("e.document_id").isNull(), "malformed").when(~F.coalesce(F.col("e.event_type"), F.lit("")).isin(list(topics)), "unsupported")
    return rows.select("key", "value", problem.alias("problem"), "e.*")


def next_events(events: DataFrame, failed: str = "failed", most: int = MAX_RETRIES) -> DataFrame:
    """What follows each event: the next stage's event, the same once more with a higher retry count, or a dead letter."""
    following = F.when(F.col("event_type") == TOPICS[0], TOPICS[1]).when(F.col("event_type") == TOPICS[1], TOPICS[2])
    route = F.when(F.col(failed) & (F.col("retry_count") < most), F.col("event_type")).when(F.col(failed), "dead_letter").otherwise(F.coalesce(following, F.lit("done")))
    return events.withColumns({"next": route, "next_retry": F.when(F.col(failed), F.col("retry_count") + 1).otherwise(0)})


def dead_letters(events: DataFrame, error: str = "error", trace: str = "traceback", failed: str = "failed", most: int = MAX_RETRIES) -> DataFrame:
    """(key, value) of events that failed and may not be tried again: the whole event with its error and trace, as JSON keyed by document."""
    last = events.where(F.col(failed) & (F.col("retry_count") >= most))
    whole = F.struct(*[F.col(c) for c in events.columns if c not in (error, trace, failed)])
    return last.select(F.col("document_id").cast("string").alias("key"), F.to_json(F.struct(whole.alias("event"), F.col(error).alias("error"), F.col(trace).alias("traceback"))).alias("value"))


def updated(statuses: DataFrame, changes: DataFrame, at: str = "at") -> DataFrame:
    """(document_id, state, updated_at): open maps of states after partial changes (document_id, change, at), applied in order of time.

    A change names only the keys that it sets; others stay. A document without a state begins with its first change.
    """
    rows = changes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(at, F.map_entries("change").alias("change")))).alias("c"))  # maps have no order, their entries have
    both = statuses.select("document_id", "state", F.col("updated_at").alias("old_at")).join(rows, "document_id", "full")
    empty = F.create_map().cast("map<string,string>")
    merge = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    state = F.aggregate(F.coalesce("c", F.array().cast(both.schema["c"].dataType)), F.coalesce("state", empty), lambda s, x: merge(s, F.map_from_entries(x["change"])))
    return both.select("document_id", state.alias("state"), F.coalesce(F.element_at("c", -1)[at], F.col("old_at")).alias("updated_at"))


def kafka_source(spark, servers: str, topics: tuple = TOPICS) -> DataFrame:
    """Messages from the earliest offset; the stream's checkpoint keeps the offsets. Needs Spark's Kafka connector."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()


def kafka_sink(events: DataFrame, servers: str, topic: str, checkpoint: str):
    return encoded(events).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def notify(callback, keep: int = 1000):
    """For ``foreachBatch``: hands a batch's finished documents to ``callback``, ``keep`` at a time through an iterator."""

    def run(batch: DataFrame, number: int) -> None:
        part = []
        for row in batch.where("status in ('ready', 'failed')").toLocalIterator():
            part.append(row.asDict())
            if len(part) == keep:
                callback(number, part)
                part = []
        if part:
            callback(number, part)

    return run
