"""An index after additions, replacements, deletions and merges equals one that is built at once."""

import random

import pytest

from verdictlake.operators import index as I
from verdictlake.operators import retrieval as R
from verdictlake.operators import segments
from verdictlake.sources import shared


def rows_of(df):
    return sorted((r.query_id, r.doc_id, r.rank, r.score) for r in df.collect())


@pytest.mark.parametrize("merge,bucket_docs,shard_docs", [(2, 12, 32)])
def test_updates_equal_a_rebuild(spark, monkeypatch, merge, bucket_docs, shard_docs):
    for module, name, value in ((segments, "MERGE", merge), (segments, "BUCKET_DOCS", bucket_docs), (I, "SHARD_DOCS", shard_docs)):
        monkeypatch.setattr(module, name, value)
    r = random.Random(merge)
    words = [f"w{k}" for k in range(40)] + ["the"] * 10
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 25)))
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    queries = spark.createDataFrame([(k, f"w{k} the w{k + 3} w{k}") for k in range(12)], "query_id int, query string")
    path, live = shared.new_path(spark, "test-index"), {}
    index = segments.SegmentedIndex(spark, path)
    assert rows_of(R.bm25(queries, index)) == []
    for step in range(2):
        new = {i: text() for i in r.sample(range(90), 40)} | {100 + step: None}
        index.add(frame(new))
        live |= new
        gone = r.sample(sorted(live), 12 + 20 * step)
        index.delete(frame({i: "" for i in [*gone, 10**6]}))
        live = {i: t for i, t in live.items() if i not in gone}
    again = segments.SegmentedIndex(spark, path)  # as another application finds it
    assert again.version == index.version and (again.n, again.avgdl) == (index.n, index.avgdl) and again.n == len(live)
    assert rows_of(R.bm25(queries, again)) == rows_of(R.bm25(queries, frame(live)))
    if merge == 2:
        assert len(again.state["segments"]) < 4
    # of two writers that start from the same state the second fails and changes nothing
    again.delete(frame({sorted(live)[0]: ""}))
    before = index.version
    with pytest.raises(RuntimeError):
        index.delete(frame({sorted(live)[1]: ""}))
    assert index.version == before and segments.SegmentedIndex(spark, path).version == again.version
    again.merge(everything=True)
    live.pop(sorted(live)[0])
    assert len(again.state["segments"]) == 1 and again.state["segments"][0]["n"] == len(live)
    assert rows_of(R.bm25(queries, again)) == rows_of(R.bm25(queries, frame(live)))
    again.delete(frame(dict.fromkeys(live, "")))
    assert again.n == 0 and rows_of(R.bm25(queries, again)) == []
