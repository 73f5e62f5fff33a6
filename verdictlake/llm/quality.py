"""Quality classification by compression.

Two Zstandard dictionaries are built, one from good and one from bad labelled texts. A text is
compressed in blocks with either; the difference of the two sizes, normalised by their sum, says
which kind it resembles, and a logistic calibration on labelled texts that did not build the
dictionaries turns this into a score. A block stands alone, so that a dictionary counts as much at
the end of a long text as at its start. Two halves of the labelled texts build a pair of
dictionaries each: one calibrates the other, and a text's difference is the mean of both.

Every feature is a normalised difference of two sizes of the text: compressed with the good and the bad dictionary, without
and with the good one, without and with the bad one, and as it is and compressed without. The last three enter the calibration under a stronger ridge than the
first: with few labels that decides alone. (The README has the ablation.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written
from .textops import batches, utf8

BLOCK = 1024
#: Labelled rows of each class that are collected for learning, about, the bytes of their texts, and the longest text that is.
FIT_ROWS, FIT_BYTES, FIT_TEXT_BYTES = 2500, 32 << 20, 4 << 20
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
#: Ridge of the intercept and the difference, and of everything else.
RIDGE, RIDGE_REST = 0.1, 3.0


def _compressors(pairs: list):
    """(compressor without a dictionary, pairs of compressors with a good and a bad one)."""
    import zstandard as z

    def one(dictionary: bytes | None):
        data = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_AUTO) if dictionary else None
        if data is not None:
            data.precompute_compress(level=LEVEL)
        return z.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)

    return one(None), [tuple(one(d) for d in pair) for pair in pairs]


def features(raw: bytes, plain, pairs) -> np.ndarray:
    """Normalised size differences of a text in UTF-8: bad dictionary less good one, none less good, none less bad (means over the pairs of dictionaries), raw less compressed."""
    alone, sizes = 0, np.zeros((len(pairs), 2))
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        alone += len(plain.compress(part))
        sizes += [(len(good.compress(part)), len(bad.compress(part))) for good, bad in pairs]
    apart = lambda one, other: np.mean((one - other) / np.maximum(one + other, 1))
    return np.array([apart(sizes[:, 1], sizes[:, 0]), apart(alone, sizes[:, 0]), apart(alone, sizes[:, 1]), apart(np.float64(len(raw)), np.float64(alone))])


def _expand(x: np.ndarray) -> np.ndarray:
    """Intercept, difference, then the other features, squares and products, so that the calibration can bend."""
    k = x.shape[1]
    return np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i in range(k) for j in range(i, k))])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    ridge = np.array([RIDGE, RIDGE] + [RIDGE_REST] * (x.shape[1] - 2))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard as z

    samples = [t[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    try:
        return z.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=6).as_bytes()
    except z.ZstdError:  # too few samples to train on: the texts themselves are the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"."


def _mark(*columns: str):
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> dict:
    """A model from (key, text) and (key, label) with label 0 or 1.

    Of each class about ``fit_rows`` labels are taken, by a hash of the key, which bounds what is broadcast to the documents; of the
    documents that they name, which may share a key, about ``fit_rows`` with ``fit_bytes`` of text in all are collected, by a hash of the text; those
    longer than ``FIT_TEXT_BYTES`` teach nothing. Labels that are null or neither 0 nor 1, and null keys, are ignored; labels that
    repeat count once. Without both classes the score is the share of label 1, and 0.5 without any.
    """
    known = labels.where("label in (0, 1) and key is not null").select("key", "label").distinct()
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return {"constant": counts.get(1, 0) / total if total else 0.5}
    rate = {k: min(1.0, fit_rows / counts[k]) for k in (0, 1)}
    chosen = known.where(_mark("key") < F.when(F.col("label") == 1, rate[1]).otherwise(rate[0]))
    texts = docs.select("key", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= FIT_TEXT_BYTES)
    found = written(texts.join(F.broadcast(chosen), "key").select("key", "label", "text"), "labelled")
    share = {r.label: min(1.0, 2 * fit_rows / r.n, fit_bytes / max(r.size, 1)) for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    rows = found.where(_mark("text", "key") < F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))).select("label", "text", _mark("key").alias("m")).collect()
    drop(found)
    rows = sorted(((r.m, r.label, r.text.encode()) for r in rows), key=lambda r: (r[0], r[1], r[2]))
    if len({y for _, y, _ in rows}) < 2:
        return {"constant": sum(y for _, y, _ in rows) / len(rows) if rows else 0.5}
    halves = [[r for k in (0, 1) for r in [r for r in rows if r[1] == k][h::2]] for h in (0, 1)]
    pairs = [[_dictionary([t for _, label, t in half if label == k]) for k in (1, 0)] for half in halves]
    x, y = [], []
    for h in (0, 1):
        plain, (pair,) = _compressors([pairs[h]])
        x += [features(t, plain, [pair]) for _, _, t in halves[1 - h]]
        y += [label for _, label, _ in halves[1 - h]]
    x, y = np.stack(x), np.array(y, float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic(_expand((x - mean) / scale), y)
    # classes were sampled at their own rates: the intercept goes back to the true odds
    w[0] -= np.log(rate[1] * share[1] / (rate[0] * share[0]))
    return {"dictionaries": pairs, "mean": mean, "scale": scale, "w": w, "low": x.min(axis=0), "high": x.max(axis=0)}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Columns of ``docs`` under ``row_`` (without the text), score (0 to 1), size_difference.

    Null text counts as empty; an empty text's difference is 0. Texts of any length are read whole; equal texts have equal scores, however
    often they occur; an empty table gives an empty result.
    """
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row_"), F.col(f"`{text}`").alias("t_"))
    schema = f"row_ {source.schema['row_'].dataType.simpleString()}, score double, size_difference double"

    def run(rows):
        plain, pairs = _compressors(model.get("dictionaries", []))
        for whole in rows:
            for batch in batches(whole, "t_"):
                if not pairs:
                    out, difference = np.full(batch.num_rows, float(model["constant"])), np.zeros(batch.num_rows)
                else:
                    data, offsets = utf8(batch.column("t_"))
                    raw = data.tobytes()
                    x = np.stack([features(raw[offsets[k] : offsets[k + 1]], plain, pairs) for k in range(batch.num_rows)])
                    difference = x[:, 0]
                    z = _expand((np.clip(x, model["low"], model["high"]) - model["mean"]) / model["scale"]) @ model["w"]
                    out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("row_"), pa.array(out, pa.float64()), pa.array(difference, pa.float64())], ["row_", "score", "size_difference"])

    return source.mapInArrow(run, schema)
