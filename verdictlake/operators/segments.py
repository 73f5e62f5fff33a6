"""A term index that is updated in place: immutable segments, bitmaps of deleted documents, merges.

A segment holds what was added at once: postings by bucket of terms and shard of documents, documents with their terms (so that a deletion knows what it
takes from the statistics), and the terms' counts. New versions of known documents delete the old ones. A deletion writes bits of the documents' places in
their shards and the counts that go; postings stay as they are, and a search passes over documents whose bit is set. Statistics are those of the live documents: the
segments' counts less those that went, so that scores equal those of an index built anew.

The state is a manifest that names segments, bitmaps and statistics. A change writes all of its tables first and then the next manifest, whose name no other
change can take: a change that dies leaves the old state, and of two at once one fails. When a size class has ``MERGE`` segments they become one, without
their deleted documents; a segment that has lost half of its documents is written anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared
from ..sources.manifest import Manifest
from . import index as I

#: Segments of a size class that are merged; a class holds sizes of one power of this.
MERGE = 4
#: Documents of a bucket of postings, about: a segment has as many buckets as its size asks for.
BUCKET_DOCS = 100_000
#: Rows of bitmaps (4 KB each) and of ids that are broadcast, at most.
BROADCAST_BITMAPS, BROADCAST_IDS = 2_000, 200_000
#: Shards of a task, about: tasks grow in number with the documents, not in size.
TASK_SHARDS = 2
_LOCAL = 1 << 24


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _join(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


class SegmentedIndex(I.Index):
    """Searches like an index that was built at once. ``path`` is a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column] = I.bm25_words):
        self.spark, self.path, self.tokens = spark, path, tokens
        self.manifest = Manifest(spark, path, {"segments": [], "bitmaps": None, "terms": None, "n": 0, "tokens": 0, "id_type": "bigint"})
        self._open(self.manifest.state)

    def _open(self, state: dict) -> None:
        self.state, self.n, self.id_type = state, state["n"], state["id_type"]
        self.avgdl = state["tokens"] / state["n"] if state["n"] else 0.0
        schema = "term string, df long, ctf long, idf double"
        self.terms = self.spark.read.schema(schema).parquet(state["terms"]) if state["terms"] else self.spark.createDataFrame([], schema)

    def _commit(self, state: dict) -> None:
        self.manifest.commit(state)
        self._open(state)

    @property
    def version(self) -> int:
        return self.manifest.version

    def _new(self, name: str) -> str:
        return self.manifest.new_path(name)

    # tables of the state
    def _docs(self, segments: list[dict]) -> DataFrame:
        """(seg, shard, place, doc_id, dl, words, tfs) of documents, deleted ones too."""
        schema = f"shard long, place long, doc_id {self.id_type}, dl int, words array<string>, tfs array<int>"
        parts = [self.spark.read.schema(schema).parquet(_join(s["path"], "docs")).withColumn("seg", F.lit(s["no"]).cast("long")) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema + ", seg long")

    def _bitmaps(self) -> DataFrame:
        schema = "seg long, shard long, gone binary"
        return self.spark.read.schema(schema).parquet(self.state["bitmaps"]) if self.state["bitmaps"] else self.spark.createDataFrame([], schema)

    def _live(self, segments: list[dict]) -> DataFrame:
        bits = _small(self._bitmaps(), BROADCAST_BITMAPS)
        rows = self._docs(segments).join(bits, ["seg", "shard"], "left")
        byte = "cast(conv(hex(substring(gone, cast(place div 8 as int) + 1, 1)), 16, 10) as int)"
        gone = F.expr(f"gone is not null and (shiftright({byte}, cast(place % 8 as int)) & 1) = 1")
        return rows.where(~F.coalesce(gone, F.lit(False))).drop("gone")

    def _terms_of(self, segments: list[dict]) -> DataFrame:
        parts = [self.spark.read.parquet(_join(s["path"], "terms")) for s in segments]
        parts += [self.spark.read.parquet(p) for s in segments for p in s["lost"]]
        return reduce(DataFrame.unionByName, parts)

    # changes
    def _written(self, docs: DataFrame, no: int) -> dict | None:
        """A segment of (doc_id, dl, words, tfs)."""
        docs = shared.written(docs, "segment-docs")
        size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens")).first()
        if not size.n:
            shared.drop(docs)
            return None
        path = self._new("segment")
        shards = max(1, math.ceil(size.n / I.SHARD_DOCS))
        shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long")
        # a shard holds some 2,048 documents, and a bitmap 32,768 places
        placed = docs.withColumn("shard", shard).repartition(self._tasks(size.n), "shard").withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("doc_id")).cast("long") - 1)
        placed.select("shard", "place", "doc_id", "dl", "words", "tfs").write.parquet(_join(path, "docs"))
        # dealt by shard once: the postings of a shard are made where its documents are
        placed = self.spark.read.parquet(_join(path, "docs")).repartition(self._tasks(size.n), "shard")
        entries = placed.select("shard", "place", "doc_id", "dl", F.explode(F.arrays_zip("words", "tfs")).alias("e")).select("shard", "place", "doc_id", "dl", F.col("e.words").alias("term"), F.col("e.tfs").alias("tf"))
        buckets = max(1, size.n // BUCKET_DOCS)
        posting = F.sort_array(F.collect_list(F.struct("place", "doc_id", "tf", "dl")))
        rows = entries.groupBy("shard", "term").agg(posting.alias("p")).select("shard", "term", F.col("p.doc_id").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"), F.col("p.place").alias("places"))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        # a bucket is several tasks, by shard: none gathers all documents of a bucket or of a hot term
        parts = math.ceil(shards / buckets / TASK_SHARDS)
        rows = rows.withColumn("part_", F.pmod("shard", F.lit(parts)))
        rows.repartition(max(shared.shuffle_partitions(self.spark), buckets * parts), "bucket", "part_").drop("part_").sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(_join(path, "postings"))
        entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("ctf")).write.parquet(_join(path, "terms"))
        shared.drop(docs)
        return {"no": no, "path": path, "n": size.n, "live": size.n, "tokens": size.tokens or 0, "buckets": buckets, "lost": []}

    def _next(self, segments: list[dict], bitmaps: str | None) -> None:
        """Statistics of the segments' live documents, and the manifest."""
        n, tokens, terms = sum(s["live"] for s in segments), sum(s["tokens"] for s in segments), None
        if segments:
            counts = self._terms_of(segments).groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf")).where("df > 0")
            terms = self._new("statistics")
            counts = shared.written(counts, "counts")
            I.statistics(counts, n).write.parquet(terms)
            shared.drop(counts)
        self._commit({"segments": segments, "bitmaps": bitmaps, "terms": terms, "n": n, "tokens": tokens, "id_type": self.id_type})

    def _tasks(self, n: int) -> int:
        return max(shared.shuffle_partitions(self.spark), math.ceil(n / (TASK_SHARDS * I.SHARD_DOCS)))

    def _without(self, ids: DataFrame) -> tuple[list[dict], str | None]:
        """Segments and bitmaps after the documents of ``ids`` went."""
        segments = [dict(s, lost=list(s["lost"])) for s in self.state["segments"]]
        if not segments:
            return segments, self.state["bitmaps"]
        gone, live, known = ids.select("doc_id").distinct(), self._live(segments), sum(s["n"] for s in segments)
        going = live.join(F.broadcast(gone), "doc_id", "left_semi") if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else live.repartition(self._tasks(known), "doc_id").join(gone, "doc_id", "left_semi")
        going = shared.written(going, "going")
        per = {r.seg: r for r in going.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens")).collect()}
        if not per:
            shared.drop(going)
            return segments, self.state["bitmaps"]
        for s in segments:
            if s["no"] in per:
                lost = self._new("lost")
                words = going.where(F.col("seg") == s["no"]).select(F.explode(F.arrays_zip("words", "tfs")).alias("e")).groupBy(F.col("e.words").alias("term"))
                words.agg((-F.count(F.lit(1))).alias("df"), (-F.sum("e.tfs")).cast("long").alias("ctf")).write.parquet(lost)
                s["lost"].append(lost)
                s["live"] -= per[s["no"]].n
                s["tokens"] -= per[s["no"]].tokens or 0
        bits = going.groupBy("seg", "shard").agg(F.expr("bitmap_construct_agg(place)").alias("gone"))
        bits = self._bitmaps().unionByName(bits).groupBy("seg", "shard").agg(F.expr("bitmap_or_agg(gone)").alias("gone"))
        path = self._new("bitmaps")
        bits.write.parquet(path)
        shared.drop(going)
        return segments, path

    def add(self, docs: DataFrame) -> None:
        """Adds (doc_id, text); documents that are known get the new text. Of rows that repeat an id in ``docs`` the greatest text stays; null ids are left out."""
        if not self.state["segments"]:
            self.id_type = docs.schema["doc_id"].dataType.simpleString()
        dealt = docs.where("doc_id is not null").select("doc_id", "text").repartition(self._tasks(docs.count()), "doc_id")
        rows = dealt.groupBy("doc_id").agg(F.max("text").alias("text")).select("doc_id", self.tokens(F.col("text")).alias("w"))
        words = rows.select("doc_id", F.size("w").alias("dl"), F.explode_outer("w").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        pairs = F.filter(F.collect_list(F.struct("term", "tf")), lambda x: x["term"].isNotNull())
        whole = shared.written(words.groupBy("doc_id", "dl").agg(pairs.alias("p")).select("doc_id", F.greatest("dl", F.lit(0)).alias("dl"), F.col("p.term").alias("words"), F.col("p.tf").alias("tfs")), "added")
        segments, bitmaps = self._without(whole)
        made = self._written(whole, 1 + max((s["no"] for s in segments), default=0))
        shared.drop(whole)
        self._next(segments + ([made] if made else []), bitmaps)
        self.merge()

    def delete(self, ids: DataFrame) -> None:
        """Deletes the documents of (doc_id); unknown ones do not matter."""
        segments, bitmaps = self._without(ids)
        self._next(segments, bitmaps)
        self.merge()

    def merge(self, everything: bool = False) -> None:
        """Merges size classes that are full and segments that have lost half of their documents; with ``everything`` all segments become one."""
        while True:
            segments = self.state["segments"]
            size_class: dict[int, list[dict]] = {}
            for s in segments:
                size_class.setdefault(int(math.log(max(s["live"], 1), MERGE)), []).append(s)
            due = segments if everything and len(segments) > 1 else next((c for c in size_class.values() if len(c) >= MERGE), None) or [s for s in segments if 2 * s["live"] <= s["n"]][:1]
            if not due:
                return
            made = self._written(self._live(due).select("doc_id", "dl", "words", "tfs"), 1 + max(s["no"] for s in segments))
            names = {s["no"] for s in due}
            self._next([s for s in segments if s["no"] not in names] + ([made] if made else []), self.state["bitmaps"])

    # search
    def _hits(self, wanted: DataFrame, terms: list[str]) -> DataFrame:
        """Postings of the asked terms in all segments, read from their buckets only."""
        schema = f"shard long, term string, docs array<{self.id_type}>, tfs array<int>, dls array<int>, places array<long>, bucket int"
        parts = []
        for s in self.state["segments"]:
            rows = self.spark.read.schema(schema).parquet(_join(s["path"], "postings"))
            if s["buckets"] > 1:
                of = wanted.select(F.pmod(F.xxhash64("term"), F.lit(s["buckets"])).alias("b")).distinct().collect()  # as many as buckets
                if len(of) < s["buckets"]:
                    rows = rows.where(F.col("bucket").isin([r.b for r in of]))
            parts.append(rows.withColumn("seg", F.lit(s["no"]).cast("long")))
        if not parts:
            parts = [self.spark.createDataFrame([], schema + ", seg long")]
        hits = reduce(DataFrame.unionByName, parts).join(F.broadcast(wanted), "term").join(_small(self._bitmaps(), BROADCAST_BITMAPS), ["seg", "shard"], "left")
        return hits.select((F.col("seg") * _LOCAL + F.col("shard")).alias("shard"), "t", "idf", "docs", "tfs", "dls", "places", "gone")
