"""Repeated passages against brute force."""

import collections
import hashlib
import random

import pytest

from verdictlake.llm import queries, suffix

SF = "/root/testdata/sf0.001"


def brute(rows, width):
    """Sorted (id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = collections.Counter(), []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[k : k + width] for k in range(len(b) - width + 1))
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def corpus(seed, n=60):
    """Texts that share passages, near copies, periodic texts, repeats inside a text."""
    r = random.Random(seed)
    text = lambda k, letters="abcdé ": "".join(r.choice(letters) for _ in range(k))
    shared = [text(r.randint(20, 120)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 60)) for _ in range(r.randint(1, 4))]
        for s in r.sample(shared, r.randint(0, 3)):
            a = r.randint(0, len(s) // 2)
            parts.insert(r.randint(0, len(parts)), s[a : a + r.randint(10, len(s))])
        rows.append((i, "".join(parts)))
    base = text(400)
    for i in range(n, n + 12):
        edited = list(base)
        for _ in range(r.randint(0, 6)):
            edited[r.randrange(len(edited))] = r.choice("xyz")
        rows.append((i, "".join(edited)))
    rows += [(900, "a" * 200), (901, "ab" * 90), (902, base), (903, base), (903, base), (904, None), (905, ""), (None, base[:150]), (None, text(90)), (906, text(9))]
    return rows


@pytest.mark.parametrize("width,spans,gram", [(40, (32, 4, 1), 6), (24, (8, 2, 1), 3), (30, (16, 16, 1), 8), (12, (1,), 8)])
def test_remove_repeats(spark, width, spans, gram):
    rows = corpus(width)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as k1", "text as t_", "1 as numbers").repartition(5)
    assert found(suffix.remove_repeats(df, width=width, spans=spans, gram=gram)) == brute(rows, width)


def test_hot_digits_texts_moved_and_small_slices(spark, monkeypatch):
    """Cores that many runs have are dealt by both digits, texts go to the numbers, slices cut every text."""
    for name, value in (("HOT", 1 / 500), ("SAMPLE", 150), ("BROADCAST_NUMBERS", 0), ("SLICE", 97)):
        monkeypatch.setattr(suffix, name, value)
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    rows = corpus(3) + [(1000 + i, "".join(r.choice("abcdefgh ") for _ in range(30)) + passage + "".join(r.choice("abcdefgh ") for _ in range(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    calls = []
    hot = suffix._hot
    monkeypatch.setattr(suffix, "_hot", lambda *a: calls.append(hot(*a)) or calls[-1])
    assert found(suffix.remove_repeats(df, width=40, spans=(32, 4, 1), gram=6)) == brute(rows, 40)
    assert len(calls[0]["cores"]) and len(calls[0]["pairs"])


def test_kept_bytes_and_empty_table(spark):
    rows = [("x", "abcdefgh" * 3 + "end"), ("y", "start" + "abcdefgh"), ("z", None)]
    df = spark.createDataFrame(rows, "name string, body string")
    out = {r.name: bytes(r.kept) for r in suffix.remove_repeats(df, "name", "body", width=8, spans=(4, 1), gram=2).collect()}
    assert out == {"x": b"end", "y": b"start", "z": b""}
    assert suffix.remove_repeats(df.where("1 = 0"), "name", "body").count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(df, "name", "body", width=8)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.op13_suffix(spark, SF)) == brute(rows, 400)
