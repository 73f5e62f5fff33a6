"""The corpus pipeline stage by stage, each on what its predecessor kept, against brute force."""

import re
import zlib

import corpus_pipeline
import test_llm as brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        if name == "packing":
            brute.check_pieces(rows, list(before.items()), 2048)
            break
        assert docs.columns == columns
        after = {r.doc_id for r in rows}
        if name == "language":
            want = {i for i, t in before.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "exact_dedup":
            want = {r[0] for r in brute.exact_brute(before.items()) if r[3]}
        elif name == "near_dedup":
            want = {r[0] for r in brute.near_brute(list(before.items()), corpus_pipeline.NEAR_PER_CENT) if r[3]}
        else:
            bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {i for i, t in before.items() if not any(b in " ".join(t.lower().split()) for b in bench)}
        assert after == want, name
        docs = spark.createDataFrame(rows, docs.schema)


def test_stages_on_edges(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, names that the stages use themselves."""
    long = "word and another, über 12 " * 20_000
    texts = [(1, "a  b\tc"), (2, "abc"), (3, " a b c "), (4, None), (5, ""), (None, "null id"), (None, "null id"), (6, long), (7, long + " "), (8, "same text"), (8, "same text"), (8, "other text"), (9, "é x@y.zz"), (10, "12 ."), (11, long + "x"), (None, None)]
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", "x", 1, "y", "z", True) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_ string, doc_id_ int, raw_hash string, t_ string, kept boolean")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.columns and stage(spark, docs.where("1 = 0"), SF).count() == 0, name
        got = out.collect()
        assert all(tuple(r) in rows for r in got), name
        kept[name] = sorted(((r.doc_id, r.text) for r in got), key=repr)
    every = sorted(texts, key=repr)
    assert kept["language"] == [x for x in every if re.search(r"[^\W\d_]", x[1] or "")]
    stays = {(r[0], r[5]) for r in brute.exact_brute(texts) if r[3]}
    assert len(kept["exact_dedup"]) == sum((i, len(t or "")) in stays for i, t in texts) and {(i, len(t or "")) for i, t in kept["exact_dedup"]} == stays
    assert {i for i, _ in kept["near_dedup"]} == {1, 2, 4, 5, None, 6, 8, 9, 10} and kept["decontamination"] == every
    pieces = corpus_pipeline.pack(spark, docs, SF)
    brute.check_pieces(pieces.collect(), texts, 2048)
    assert corpus_pipeline.pack(spark, docs.where("1 = 0"), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_language_stage_without_languages(spark):
    rows = [(1, "some text", None), (2, "é", None), (3, "12 .", None), (4, "", None), (5, None, None), (None, "漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, None}
    # labelled rows outside the learning fold teach nothing either
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 3 == 1)
    tiny = spark.createDataFrame([(held, "some text", "en")], docs.schema)
    assert corpus_pipeline.language(spark, tiny, SF).count() == 1


def test_workers_keep_nothing_of_other_stages(spark):
    """A worker that encoded texts has forgotten the vocabulary once a task of another operator runs in it, and a packing task finds it again."""
    from verdictlake.llm import textops, tokens

    tokens.encoder.cache_clear()
    kept = tokens.encoder(None, 1 << 20)
    seen = []
    assert list(textops.lean(lambda rows: (seen.append(tokens.encoder.cache_info().currsize) or r for r in rows), "encoder")([1, 2])) == [1, 2]
    assert seen == [1, 1] and tokens.encoder(None, 1 << 20) is kept
    assert list(textops.lean(lambda rows: (seen.append(tokens.encoder.cache_info().currsize) or r for r in rows))([3])) == [3]
    assert seen[2:] == [0]
