"""Semantics that the oracle tables do not reach: edge cases, properties, streams."""

import math
import random

from pyspark.sql import functions as F

from verdictlake.functions import text as T
from verdictlake.operators import chunking, evidence, graph, index, retrieval, rules, workflow
from verdictlake.plans import ranking
from verdictlake.plans.policy import POLICY
from verdictlake.sources import tables
from verdictlake.streaming import ingest


def audit(spark, *queries):
    df = spark.createDataFrame(list(enumerate(queries)), "id int, query string")
    facts = rules.request_facts(df, POLICY)
    rows = rules.audit_checks(facts, POLICY).select("id", "checks", rules.status_of(F.col("checks")).alias("s")).orderBy("id").collect()
    assert [r.s for r in rows] == [r.status for r in rules.audit_status(facts, POLICY).orderBy("id").collect()]
    return [(r.s, {c.name: c.result for c in r.checks}) for r in rows]


def test_verdicts(spark):
    got = audit(
        spark,
        "Remit $1,800,000 USD to an overseas vendor for licensing.",
        "Remit $400,000 to an overseas vendor under the ceiling.",
        "Wire $750,000 to a newly onboarded overseas beneficiary.",
        "Advance $250,000 to an overseas vendor whose director owns a 3.1% promoter stake.",
        "Use $12,500,000 to acquire 45% equity of a foreign company.",
        "Pay $850,000 overseas; cumulative quarterly remittances have already reached $4,600,000 usd.",
        "Move $900,000 overseas to an anonymous crypto wallet.",
        "",
    )
    assert [s for s, _ in got] == ["NON_COMPLIANT", "COMPLIANT", "ACTION_REQUIRED", "NON_COMPLIANT", "NON_COMPLIANT", "NON_COMPLIANT", "ACTION_REQUIRED", "ACTION_REQUIRED"]
    assert got[3][1]["Director Exposure Risk"] == "FAIL" and got[5][1]["Cumulative Quarterly Exposure"] == "FAIL"
    assert got[6][1]["Digital Asset Beneficiary Verification"] == "REVIEW"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a a d"), (3, "e f"), (4, None), (5, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "b b c"), (2, "zz")], "query_id int, query string")
    texts = [["a", "b", "b", "c"], ["a", "a", "d"], ["e", "f"], [], []]
    n, avgdl = 5, 9 / 5
    df = {t: sum(t in x for x in texts) for x in texts for t in x}
    raw = {t: math.log(n - v + 0.5) - math.log(v + 0.5) for t, v in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    want = sum(idf[t] * texts[0].count(t) * 2.5 / (texts[0].count(t) + 1.5 * (0.25 + 0.75 * 4 / avgdl)) for t in ["b", "b", "c"])
    rows = retrieval.bm25(q, docs).collect()
    assert [(r.query_id, r.doc_id, r.rank, r.score) for r in rows] == [(1, 1, 1, round(want, 6))]


def test_rrf_ignores_order_of_lists(spark):
    rng = random.Random(1)
    lists = [spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(rng.sample(range(20), 10))], "query_id int, doc_id int, rank int") for _ in range(3)]
    one = [tuple(r) for r in retrieval.rrf(*lists).orderBy("rank").collect()]
    assert one == [tuple(r) for r in retrieval.rrf(*lists[::-1]).orderBy("rank").collect()]


def test_dense_blocks_agree(spark):
    rng = random.Random(2)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "doc_id long, embedding array<double>")
    q = v.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    for metric in ("cosine", "l2", "dot"):
        one = sorted(map(tuple, retrieval.dense(q, v, metric, 3).collect()))
        assert one == sorted(map(tuple, retrieval.dense(q, v, metric, 3, block=4).collect())) and len(one) == 36


def test_metrics_edges(spark):
    lists = spark.createDataFrame([(1, 9, 1), (1, 5, 2), (1, 8, 3), (2, 1, 1)], "query_id int, doc_id int, rank int")
    gold = spark.createDataFrame([(1, 9), (1, 8)], "query_id int, doc_id int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    m = {r.query_id: r for r in retrieval.retrieval_metrics(lists, gold, q).collect()}
    assert round(m[1].ndcg_10, 4) == round((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)), 4) and m[1].mrr == 1
    assert (m[2].recall_10, m[2].mrr, m[3].ndcg_10) == (1.0, 0.0, 1.0)


def test_gold_is_plain_containment(spark):
    queries = ["alpha beta gamma delta", "one\ntwo three four five", "x\ty z\tw v", "tail pre fix mid wor", "two  blanks in  here", "short", "a b c", "", None, "ünï çödé wörds hère ok", "漢字のテキスト"]
    texts = ["alpha beta gamma delta", "(alpha beta gamma delta)", "tab\talpha beta gamma deltas", "so one\ntwo three four five.", "so one two three four five.", "x\ty z\tw v", "retail pre fix mid words", "two  blanks in  here!", "two blanks in here", "shorten", "xa b cx", "“ünï çödé wörds hère ok”", "前漢字のテキスト後", "", None, "one"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {(i, k) for i, a in enumerate(queries) for k, t in enumerate(texts) if a is not None and t is not None and a in t}
    got = [tuple(r) for r in ranking.containing(q, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_windows_cover_every_token(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{k}" for k in range(n))) for n in (0, 1, 96, 97, 100, 300)], "doc_id int, text string")
    got = {}
    for r in chunking.child_windows(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    assert 0 not in got and len(got[96]) == 1 and sorted(s for s, _ in got[100]) == [0, 96]
    for n, w in got.items():
        assert set().union(*(range(s, s + k) for s, k in w)) == set(range(n))


def test_parent_pack_keeps_large_items_whole(spark):
    items = spark.createDataFrame([(1, 1, "s", "x " * 600), (1, 2, "s", "y"), (1, 3, "t", "z"), (1, 4, "t", None)], "d int, o int, s string, t string")
    got = sorted((r.parent, r.section, r.n_items, r.n_tokens) for r in chunking.parent_pack(items, "d", "o", "t", "s").collect())
    assert got == [(1, "s", 1, 600), (2, "s", 1, 1), (3, "t", 1, 1)]


def test_points_outside_boxes(spark):
    p = spark.createDataFrame([(1, 5.0, 5.0), (1, 50.0, 5.0), (2, 5.0, 5.0)], "page int, x double, y double")
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.page, r.x) for r in chunking.outside_boxes(p, b, "page").collect()) == [(1, 50.0), (2, 5.0)]


def test_graph_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert sorted((r.node, r.hops) for r in graph.shortest_paths(e, roots).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_paths_of_any_length(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([(k, k + 1) for k in range(19)] + [(19, 3)], "src int, dst int")
    roots = spark.createDataFrame([(0,)], "root int")
    assert sorted((r.node, r.hops) for r in graph.shortest_paths(e, roots).collect()) == [(k, k) for k in range(20)]
    assert graph.shortest_paths(e, roots, 2).count() == 3


def test_expand_chunks(spark):
    expanded = spark.createDataFrame([(1, "n", "m", "out", "R")], "query_id int, node string, neighbour string, direction string, relation string")
    chunks = spark.createDataFrame([("m", "p1", "The Ceiling"), ("m", "p2", "none"), ("m", "p3", "a vendor")], "node string, parent_id string, text string")
    context = spark.createDataFrame([(1, "p3")], "query_id int, parent_id string")
    assert [r.parent_id for r in graph.expand_chunks(expanded, chunks, context).collect()] == ["p1"]


def test_paths_along_a_long_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(30)], "src int, dst int")
    roots = spark.createDataFrame([(0,), (25,)], "root int")
    want = sorted([(0, k, k) for k in range(31)] + [(25, k, k - 25) for k in range(25, 31)])
    assert sorted((r.root, r.node, r.hops) for r in graph.shortest_paths(e, roots).collect()) == want


def test_graph_file(spark, tmp_path):
    import json

    path = tmp_path / "g.json"
    path.write_text(json.dumps({"nodes": [{"id": "a", "kind": "x"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "relation": "R", "limit": "5"}]}))
    nodes, edges = graph.read_graph(spark, str(path))
    assert {(r.id, tuple(r.attrs.items())) for r in nodes.collect()} == {("a", (("kind", "x"),)), ("b", ())}
    assert [(r.src, r.dst, r.relation, r.attrs) for r in edges.collect()] == [("a", "b", "R", {"limit": "5"})]
    for _ in range(2):
        graph.write_graph(nodes, edges, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "nodes")).count() == 2 and spark.read.json(str(tmp_path / "out" / "links")).count() == 1


def test_index_agrees_with_brute_force(spark, monkeypatch):
    """Shards, blocks of terms and blocks of queries, with ties, repeated words, empty texts and words that nobody has."""
    rng = random.Random(3)
    monkeypatch.setattr(index, "BLOCK_QUERIES", 3)
    texts = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(60, None)]
    asked = [(k, " ".join(rng.choice("abcdefghz") for _ in range(rng.randint(0, 5)))) for k in range(8)]
    docs, q = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(asked, "query_id int, query string")
    words = {k: (t or "").split() for k, t in texts}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = {w: sum(w in x for x in words.values()) for w in "abcdefgh"}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    want = []
    for i, t in asked:
        scores = {k: round(sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / avgdl)) for w in t.split() if w in x), 6) for k, x in words.items()}
        best = sorted((-s, k) for k, s in scores.items() if s > 0)[:4]
        want += [(i, k, place + 1) for place, (_, k) in enumerate(best)]
    for shard_docs in (7, 1000):
        built = index.Index.build(docs, shard_docs=shard_docs)
        assert sorted((r.query_id, r.doc_id, r.rank) for r in retrieval.bm25(q, built, 4).collect()) == sorted(want)
    assert retrieval.bm25(q.where("1 = 0"), docs).count() == 0 and retrieval.bm25(q, docs.where("1 = 0")).count() == 0


def test_index_follows_its_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    read = lambda: spark.read.parquet(path)
    spark.createDataFrame([(1, "a b")], "doc_id int, text string").write.parquet(path)
    one = index.kept(spark, path, "t", read)
    assert index.kept(spark, path, "t", read) is one and one.n == 1
    spark.createDataFrame([(2, "c")], "doc_id int, text string").write.mode("append").parquet(path)
    assert index.kept(spark, path, "t", read).n == 2


def test_vectors_are_added_once(spark):
    docs = spark.createDataFrame([(1, "a bb"), (2, None), (3, "Ab")], "doc_id int, text string")
    some = retrieval.hashed_vectors(docs.where("doc_id < 3"))
    got = {r.doc_id: r.embedding for r in retrieval.upsert_vectors(some, docs).collect()}
    assert set(got) == {1, 2, 3} and sum(got[1]) == 2 and sum(got[2]) == 0 and got[3][(31 * 97 + 7 * 98 + 2) % 64] == 1


def test_parents_of_children(spark):
    top = spark.createDataFrame([(1, "a:0", 1), (1, "b:0", 2), (1, "a:1", 3), (1, "gone", 4), (2, "c:0", 1)], "query_id int, doc_id string, rank int")
    children = spark.createDataFrame([("a:0", "a"), ("a:1", "a"), ("b:0", "b"), ("c:0", "c")], "child_id string, parent_id string")
    parents = spark.createDataFrame([("a", "x"), ("b", "y")], "parent_id string, source string")
    got = sorted((r.query_id, r.rank, r.parent_id, r.child_id, r.source) for r in retrieval.parents_of(top, children, parents).collect())
    assert got == [(1, 1, "a", "a:0", "x"), (1, 2, "b", "b:0", "y"), (2, 1, "c", "c:0", "")]


def test_golden_statuses(spark):
    """Sixteen requests in own words, one per regression vector of the survey; on twelve the rules alone give what is expected."""
    said = [
        ("Remit $1,800,000 USD to an overseas vendor for licensing.", "NON_COMPLIANT", True), ("Remit $400,000 USD overseas to a vendor.", "COMPLIANT", True), ("Wire $750,000 to a newly onboarded overseas beneficiary.", "ACTION_REQUIRED", True),
        ("Advance $250,000 to an overseas vendor whose director owns a 3.1% promoter stake.", "NON_COMPLIANT", True), ("Pay $12,500,000 for 45% of the equity of a foreign company.", "NON_COMPLIANT", True), ("Pay $150,000 to an offshore cloud provider.", "COMPLIANT", True),
        ("Pay $850,000 overseas; cumulative quarterly remittances have already reached $4,600,000 usd.", "NON_COMPLIANT", True), ("Move $900,000 overseas to an anonymous crypto wallet.", "ACTION_REQUIRED", True), ("Remit $1,490,000 USD to a foreign vendor.", "COMPLIANT", True),
        ("Remit $1,510,000 USD to a foreign vendor.", "NON_COMPLIANT", True), ("Wire overseas without any originator details.", "COMPLIANT", False), ("Which limit of 2.5 percent holds for a promoter?", "ACTION_REQUIRED", False),
        ("May 45 per cent of the equity be held from overseas?", "ACTION_REQUIRED", False), ("Is a notice needed within the country?", "ACTION_REQUIRED", False), ("Quarterly payments of $4,600,000 usd were made overseas before another one of $850,000.", "NON_COMPLIANT", True),
        ("May a digital wallet be paid without kyc from offshore?", "ACTION_REQUIRED", True),
    ]
    got = [s for s, _ in audit(spark, *(q for q, _, _ in said))]
    assert got == [s for _, s, _ in said] and sum(ok for _, _, ok in said) == 12


def test_accuracy_by_the_last_record(spark):
    golden = spark.createDataFrame([(1, " q one ", "A", 5.0, 9.0, "s"), (2, "q two", "A", 0.0, 9.0, None), (3, "q three", "A", 1.0, 1.0, "s")], "id int, query string, status string, value double, ceiling double, source string")
    seed = spark.createDataFrame([("q one", "B", 5.0, 9.0, "s", 1), ("q one ", "A", 5.005, 8.0, "t", 2), ("q two", "A", 7.0, 9.0, None, 1)], "query string, status string, value double, ceiling double, source string, at int")
    got = {r.id: (r.matched, r.status_ok, r.value_ok, r.ceiling_ok, r.source_ok) for r in rules.accuracy(golden, seed).collect()}
    assert got == {1: (True, True, True, False, False), 2: (True, True, True, True, True), 3: (False, None, None, None, None)}


def test_checks_without_evidence_get_the_first_item(spark):
    items = spark.createDataFrame([(1, 7, 2, "src0", "no such word", []), (1, 8, 1, "src9", "nothing", [])], "r int, i int, place int, source string, snippet string, criteria array<string>")
    checks = spark.createDataFrame([(1, "Transactional Exposure"), (1, "Foreign Investment Route"), (1, "Unknown"), (2, "Unknown")], "r int, check string")
    got = {(r.r, r.check, r.i, r["rank"]) for r in evidence.check_evidence(checks, items, "r", "i", POLICY, place="place").collect()}
    assert got == {(1, "Transactional Exposure", 7, 1), (1, "Foreign Investment Route", 8, 1), (1, "Unknown", 8, 1)}


def test_origin_and_footer(spark):
    df = spark.createDataFrame([("pay from Unit North  East to x",), ("the Unit Global pays",), ("someone pays",)], "q string")
    assert [r.x for r in df.select(T.origin(F.col("q"), "Unit", ("Unit Global", "Unit Home")).alias("x")).collect()] == ["Unit North East", "Unit Global", "Unit Home"]
    foot = spark.createDataFrame([("Website: www.fema.rbi.org.in   E-mail: x",), ("Website : www.fema.rbi.org.in email : fedcofid@rbi.org.in 12",), ("Page 3",)], "q string")
    assert [r.x for r in foot.select(T.line_signature(F.col("q")).alias("x")).collect()] == ["website: www.fema.rbi.org.in e-mail: x", "<rbi-contact-footer>", "page #"]


def test_summary_and_views(spark, tmp_path):
    m = spark.createDataFrame([("bm25", 0.5, None), ("dense", 0.25, 1)], "pipeline string, recall double, n int")
    for _ in range(2):
        tables.write_summary(m, str(tmp_path), "Retrieval")
    lines = [r.value for r in spark.read.text(str(tmp_path / "markdown")).collect()]
    assert lines == ["# Retrieval", "", "| pipeline | recall | n |", "| :--- | :--- | :--- |", "| bm25 | 0.5 |  |", "| dense | 0.25 | 1 |"]
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    tables.register(spark, "/root/testdata/sf0.001", ["region"])
    assert spark.sql("select count(*) as n from region").first().n == 5


def test_tables_evolve(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1,)], "id int").write.parquet(path)
    spark.createDataFrame([(2, "x")], "id int, note string").write.mode("append").parquet(path)
    rows = tables.read_evolved(spark, path, {"note": F.lit("none"), "state": F.lit("open")}).collect()
    assert sorted((r.id, r.note, r.state) for r in rows) == [(1, "none", "open"), (2, "x", "open")]


def test_ready_ids(spark):
    s = spark.createDataFrame([("a", "ready"), ("b", "ready"), ("c", "parsing")], "document_id string, status string")
    ids = spark.createDataFrame([("a",), ("c",)], "document_id string")
    assert {r.document_id for r in tables.ready(s).collect()} == {"a", "b"} and [r.document_id for r in tables.ready(s, ids).collect()] == ["a"]


def test_batches_and_notices(spark, tmp_path):
    path = str(tmp_path / "status")
    sink, seen = ingest.upsert_sink(path), []
    df = spark.createDataFrame([("a", "ready"), ("b", "parsing"), ("c", "failed")], "document_id string, status string")
    for _ in range(2):
        sink(df, 0)
    assert spark.read.parquet(path).count() == 3
    ingest.notify(lambda number, rows: seen.append((number, sorted(r["document_id"] for r in rows))), keep=1)(df, 4)
    assert sorted(seen) == [(4, ["a"]), (4, ["c"])]


def test_transitions(spark):
    df = spark.createDataFrame([(True, False, "RESOLVED"), (True, False, "CLOSED"), (False, True, "CLOSED"), (False, False, "CLOSED")], "a boolean, b boolean, new string")
    got = [r.x for r in df.select(workflow.transition(F.col("a"), F.col("b"), F.lit("OPEN"), F.col("new")).alias("x")).collect()]
    assert got == ["RESOLVED", None, "CLOSED", None]


def test_records_roundtrip(spark, tmp_path):
    import json

    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"source_document": "a", "page_number": 1, "content_type": "text", "raw_content": "hello"}, {"source_document": "a", "page_number": 2, "content_type": "table", "raw_content": [["x", "y"], ["1", "2"]], "table_index": 1}]))
    rows = tables.split_content(tables.read_records(spark, str(path))).orderBy("page_number").collect()
    assert rows[0].text == "hello" and rows[0].table_rows is None and rows[1].table_rows == [["x", "y"], ["1", "2"]]


def test_replacing_documents_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "chunks")
    one = spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, n int")
    tables.replace_documents(one, path)
    tables.replace_documents(one.where("document_id = 'a'").withColumn("n", F.lit(2)), path)
    tables.replace_documents(one.where("document_id = 'a'").withColumn("n", F.lit(2)), path)
    assert sorted((r.document_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]


def test_source_modes(spark):
    s, u = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "y")], "x int, z string")
    assert tables.union_sources(s, u).count() == 1 and tables.union_sources(s, u, True, True).count() == 2
    assert [r.source_type for r in tables.union_sources(s, u, False, False).collect()] == ["uploaded_document"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", i % 3, "error" if i % 2 else "click", bool(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, document_id long, event_type string, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    for k in range(4):
        df.where(F.col("event_id") % 4 == k).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(ingest.EVENT).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = ingest.retries_stream(read()).writeStream.format("memory").queryName("retries").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, ingest.retries(df).collect()))
    assert sorted(map(tuple, spark.table("retries").collect())) == want
    q = ingest.latest_status(read()).writeStream.format("memory").queryName("status").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("status").collect())) == sorted(map(tuple, ingest.latest_status(df).collect()))
    q = ingest.deduplicated(read().union(read())).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 40


def test_page_regions_keep_most_of_a_page(spark):
    pages = spark.createDataFrame([("f", p, 100.0) for p in range(5)], "file string, page int, height double")
    lines = spark.createDataFrame([("f", p, 0.0, 4.0, f"Page {p}") for p in range(5)] + [("f", 0, 95.0, 99.0, "once"), ("f", 1, 95.0, 99.0, "Section 1")] + [("f", p, 92.0, 97.0, "Section 4") for p in range(5)], "file string, page int, y0 double, y1 double, text string")
    assert {(r.top, r.bottom) for r in chunking.page_regions(lines, pages).collect()} == {(6.0, 100.0)}
    tall = lines.where("text like 'Page%'").withColumn("y1", F.lit(9.0))
    assert {(r.top, r.bottom) for r in chunking.page_regions(tall, pages, least_height=0.95).collect()} == {(0.0, 100.0)}


def test_row_range(spark):
    assert [r.id for r in workflow.row_range(spark.range(20), "id", 5, 8).collect()] == [5, 6, 7]


def test_scan_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"abc")
    assert {r.document_id for r in tables.scan_files(spark, str(tmp_path)).collect()} == {"doc_ba7816bf8f01cfea"}


def test_expiry_and_resume(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:11:00",)], "t string").withColumn("t", F.to_timestamp("t"))
    assert [r.x for r in df.select(workflow.expired(F.col("t"), F.to_timestamp(F.lit("2024-01-01 00:13:00")), 12).alias("x")).collect()] == [True, False]
    work, done = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, True), (2, False)], "k int, success boolean")
    assert [r.k for r in workflow.remaining(work, done, "k").collect()] == [2]


def test_messages_are_never_dropped(spark):
    m = spark.createDataFrame([("1", '{"event_id":"e","event_type":"document.parsed","document_id":"1","retry_count":0}'), ("2", "{broken"), ("3", None), ("4", '{"event_type":"x","document_id":"4"}')], "key string, value string")
    assert sorted((r.key, r.problem) for r in ingest.decoded(m).collect()) == [("1", None), ("2", "malformed"), ("3", "malformed"), ("4", "unsupported")]


def test_citation_state(spark):
    df = spark.createDataFrame([("a", ["a"], 0), ("b", ["a"], 0), ("b", ["a"], 1), (None, [], 1)], "s string, c array<string>, r int")
    assert [r.x for r in df.select(rules.citation_state(F.col("s"), F.col("c"), F.col("r")).alias("x")).collect()] == ["complete", "retry", "breaker", "breaker"]
