"""Merged state, ranges of sorted rows, graphs in folders, tolerant fields."""

import random
import re

import pytest

from verdictlake.operators import graph, workflow
from verdictlake.sources import tables
from verdictlake.sources.manifest import Conflict, Manifest
from verdictlake.streaming import ingest

SCHEMA = "document_id string, event_id long, status string"


def test_batches_in_any_order_leave_one_row_per_key(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"d{r.randrange(30)}", k, r.choice("abc")) for k in range(200)] + [(None, 999, "x")]
    path, sink = str(tmp_path / "state"), ingest.merge_sink(str(tmp_path / "state"), buckets=4)
    assert ingest.merged_table(spark, path, SCHEMA).count() == 0
    parts = [rows[k::5] for k in range(5)]
    for number, k in enumerate((4, 0, 0, 2, 1, 3, 4)):
        sink(spark.createDataFrame(parts[k], SCHEMA), number)
    sink(spark.createDataFrame([("d0", 10**6, "never")], SCHEMA), 6)  # its number is committed: a replay
    want = {}
    for d, k, s in rows:
        if d is not None:
            want[d] = max(want.get(d, (-1, "")), (k, s))
    assert {x.document_id: (x.event_id, x.status) for x in ingest.merged_table(spark, path, SCHEMA).collect()} == want
    assert ingest.merged_table(spark, path, SCHEMA).count() == len(want)


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    ingest.merge_sink(path)(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.merge_sink(path)(spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], SCHEMA), 1)
    assert [tuple(x) for x in ingest.merged_table(spark, path, SCHEMA).collect()] == [("a", 1, "x")]
    one, two = (Manifest(spark, path, {}) for _ in range(2))
    one.commit(one.state)
    with pytest.raises(Conflict):
        two.commit(two.state)


def test_a_stream_that_restarts_equals_the_batch(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "state", "checkpoint"))
    rows = [(f"d{k % 7}", k, f"s{k}") for k in range(60)]
    for turn in range(2):
        for k in range(3):
            spark.createDataFrame(rows[turn * 30 + k * 10 : turn * 30 + k * 10 + 10], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(ingest.merge_sink(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = {x.document_id: (x.event_id, x.status) for x in ingest.merged_table(spark, path, SCHEMA).collect()}
    assert got == {d: (k, s) for d, k, s in rows}


def test_sorted_rows(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 as k", "id as v").unionByName(spark.range(400).selectExpr("500L as k", "id + 5000 as v"))
    found = workflow.SortedRows(df, "k")
    keys = sorted([r.k for r in df.collect()])
    for a, b in ((0, 5), (495, 520), (1390, 1500), (2000, 2010), (7, 7)):
        assert [r.k for r in found.range(a, b).collect()] == keys[a:b]
    whole = found.range(0, 10**6).collect()
    assert len({r.v for r in whole}) == 1400 and found.range(600, 700).collect() == whole[600:700]
    plan = found.range(0, 5)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part_", plan) and len(found.starts) > 1
    assert workflow.row_range(df.where("1 = 0"), "k", 0, 5).count() == 0


def test_graph_folder(spark, tmp_path):
    nodes = spark.createDataFrame([("a", {"kind": "x", "n": "1"}), ("b", {})], "id string, attrs map<string,string>")
    edges = spark.createDataFrame([("a", "b", "R", {"limit": "5"}), ("b", "a", None, {})], "src string, dst string, relation string, attrs map<string,string>")
    for _ in range(2):
        graph.write_graph(nodes, edges, str(tmp_path / "g"))
    back = graph.read_graph(spark, str(tmp_path / "g"))
    key = lambda df: sorted((repr([x.asDict() if hasattr(x, "asDict") else x for x in r]) for r in df.collect()))
    assert key(back[0]) == key(nodes) and key(back[1].select(*edges.columns)) == key(edges)


def test_tolerant_fields(spark):
    rows = [('{"a": {"b": 7}}',), ('{"a": {"b": "8"}}',), ('{"a": {"b": "x"}}',), ('{"a": [1',), ("",), (None,), ("[1]",), ('{"a": {"b": null}}',), ('{"a": {"b": 1.5}}',)]
    got = [r.x for r in spark.createDataFrame(rows, "j string").select(tables.tolerant_field("j", "$.a.b", "int", -1).alias("x")).collect()]
    assert got == [7, 8, -1, -1, -1, -1, -1, -1, 1]
