"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point alone. An n-gram's
vector binds the permuted vectors of its letters by multiplication; a text's vector bundles
those of its n-grams by addition, and so does a language's prototype with the n-grams of its
training texts. A text takes the language whose prototype has the largest cosine.

Prototypes are centred on their mean and weighted alike, as all languages share frequent n-grams.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written
from .textops import batches, lean

DIMENSIONS = 1024
GRAM = 3
#: Rows per language that the prototypes are learnt from, about; fewer where a language has fewer.
FIT_ROWS = 3000
#: n-gram vectors remembered per worker.
REMEMBERED = 60_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Space:
    """Vectors of n-grams; the same in every process."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.letters: dict[int, np.ndarray] = {}
        self.order, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.vectors = np.empty((REMEMBERED, dimensions), np.int8)  # memory is taken only as rows are written

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64(code + 1)).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams that are given as packed code points."""
        out = np.ones((len(grams), self.dimensions), np.int8)
        for k in range(self.gram):
            codes, inverse = np.unique((grams >> np.uint64(21 * k)) & np.uint64(0x1FFFFF), return_inverse=True)
            rows = np.stack([np.roll(self.letter(int(c)), k) for c in codes]) if len(codes) else np.zeros((0, self.dimensions), np.int8)
            out *= rows[inverse]
        return out

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct n-grams; frequent ones are remembered."""
        at = np.searchsorted(self.order, grams)
        known = at < len(self.order)
        known[known] = self.order[at[known]] == grams[known]
        if known.all():
            return self.vectors[self.places[at]]
        new = grams[~known]
        vectors = self.bind(new)
        out = np.empty((len(grams), self.dimensions), np.int8)
        out[known], out[~known] = self.vectors[self.places[at[known]]], vectors
        used = len(self.order)
        if used + len(new) <= REMEMBERED:
            self.vectors[used : used + len(new)] = vectors
            merged, places = np.concatenate([self.order, new]), np.concatenate([self.places, np.arange(used, used + len(new))])
            sort = np.argsort(merged)
            self.order, self.places = merged[sort], places[sort]
        return out

    def grams(self, text: str) -> np.ndarray:
        """Packed n-grams of letters; a run of other characters is one blank, also before and after the text."""
        codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        letter = codes > 0
        if not letter.any():
            return np.zeros(0, np.uint64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first character after a letter
        codes = np.concatenate([[0], codes[keep], [0]]).astype(np.uint64)
        n = len(codes) - self.gram + 1
        packed = np.zeros(max(n, 0), np.uint64)
        for k in range(self.gram):
            packed |= codes[k : k + n] << np.uint64(21 * k)
        return packed

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """Sum of the vectors of n-grams, repeats counted."""
        total = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(grams), 1 << 20):
            distinct, counts = np.unique(grams[at : at + (1 << 20)], return_counts=True)
            for k in range(0, len(distinct), 8192):
                total += counts[k : k + 8192].astype(np.float32) @ self.lookup(distinct[k : k + 8192]).astype(np.float32)
        return total


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text falls in a fold; a null id falls in none."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_prototypes(labelled: DataFrame, fit_rows: int = FIT_ROWS, dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, learnt from (key, text, lang) rows with a language.

    Of each language about ``fit_rows`` rows are taken, by a hash of the key and text, so that what is read for learning is bounded per
    language; the driver receives one vector per task and language, and the model is one vector (4 KB) per language.
    Rows without a language or text teach nothing; repeated rows count as often, but are taken or left together; an empty table gives no language.
    """
    known = labelled.where("lang is not null and text is not null")
    counts = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n_")), "languages")
    n = counts.count()
    if not n:
        drop(counts)
        return [], np.zeros((0, dimensions), np.float32)
    part = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / float(1 << 30) < F.lit(float(fit_rows)) / F.col("n_")
    sample = known.join(counts, "lang").where(part).select("text", "lang").repartition(max(8, 2 * n))  # counts are a small table, which the planner broadcasts

    def run(rows):
        space, sums = Space(dimensions, gram), {}
        for whole in rows:
            for batch in batches(whole, "text"):
                texts: dict[str, list] = {}
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    grams = space.grams(text)
                    if len(grams):
                        texts.setdefault(lang, []).append(grams[:])
                for lang, grams in texts.items():
                    # each text weighs alike, whatever its length
                    for g in grams:
                        v = space.bundle(g)
                        sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<f4").tobytes() for v in sums.values()], pa.binary())], ["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for r in sorted(sample.mapInArrow(lean(run), "lang string, v binary").collect(), key=lambda r: (r.lang, r.v)):
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.v, "<f4").astype(np.float64)
    drop(counts)
    langs = sorted(total)
    if not langs:
        return [], np.zeros((0, dimensions), np.float32)
    p = np.stack([total[x] / np.linalg.norm(total[x]) for x in langs])
    return langs, p.astype(np.float32)


def predict_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", dimensions: int = DIMENSIONS, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Columns of ``docs`` under ``row_`` (without the text, unless ``with_text``), lang_pred, score, margin.

    score is the cosine with the language's prototype, at least 0; margin is its lead over the
    next one; of equal ones the first in the order of names wins. Null texts and those without a letter get ``und`` and 0, as do all
    where the model knows no language. Texts of any length are read whole, slice by slice; repeated rows are scored one by one;
    an empty table gives an empty result.
    """
    langs, prototypes = model
    centre = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(dimensions, np.float32)
    centred = prototypes - centre
    if len(langs):
        centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if with_text or c != text]).alias("row_")
    source = docs.select(row) if with_text else docs.select(row, F.col(f"`{text}`").alias("t_"))  # the text travels once
    place = docs.columns.index(text)
    schema = f"row_ {source.schema['row_'].dataType.simpleString()}, lang_pred string, score double, margin double"

    def run(rows):
        space = Space(dimensions, gram)
        for whole in rows:
            if with_text:
                whole = pa.RecordBatch.from_arrays([whole.column("row_"), whole.column("row_").flatten()[place]], ["row_", "t_"])
            for batch in batches(whole, "t_"):
                pred, score, margin = [], [], []
                for t in batch.column("t_").to_pylist():
                    grams = space.grams(t) if t else ()
                    if len(grams) == 0 or not langs:
                        pred.append(UNKNOWN), score.append(0.0), margin.append(0.0)
                        continue
                    v = space.bundle(grams)
                    v /= max(float(np.linalg.norm(v)), 1e-9)
                    own = v - centre * float(v @ centre) / max(float(centre @ centre), 1e-9)
                    likeness = centred @ (own / max(float(np.linalg.norm(own)), 1e-9))
                    best = int(likeness.argmax())
                    rest = np.delete(likeness, best)
                    pred.append(langs[best])
                    score.append(float(min(1.0, max(0.0, prototypes[best] @ v))))
                    margin.append(float(likeness[best] - rest.max()) if len(rest) else float(likeness[best]))
                yield pa.RecordBatch.from_arrays([batch.column("row_"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["row_", "lang_pred", "score", "margin"])

    return source.mapInArrow(lean(run), schema)
