"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.llm import negatives


def brute(rows, every, scale=256, positives=5, k=3, low=50, high=95):
    good = [(i, y, [math.floor(scale * np.float32(x).item()) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in good:
        if i % every:
            continue
        others = [(-score(v, w), j, z == y) for j, z, w in good if j != i]
        for p, j, _ in sorted(x for x in others if x[2])[:positives]:
            fit = sorted((s, n) for s, n, same in others if not same and -low * p <= -100 * s <= -high * p)[:k]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "vec_id as id", "1 as v", "2 as far", "label as anchor").repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,block,group,few", [(1, 2048, 2048, 0.05), (2, 7, 16, 1.0), (3, 5, 50, 0.0)])
def test_hard_negatives(spark, monkeypatch, seed, block, group, few):
    for name, value in (("ANCHORS", block), ("GROUP", group), ("FEW", few), ("PIVOTS", 3), ("CHOICE", 40)):
        monkeypatch.setattr(negatives, name, value)
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(6)] for _ in range(4)]
    rows = [(i, r.randrange(3), [round((c + r.gauss(0, 0.1)) * 16) / 16 for c in r.choice(centres)]) for i in range(240)]
    rows += [(300, 1, None), (305, None, rows[0][2]), (None, 1, rows[0][2]), (310, 1, [1.0, None]), (315, 1, [float("nan")]), (320, 1, [float("inf")]), (325, 2, []), (330, 1, [0.5, 0.5]), (335, 0, rows[5][2])]
    rows += [(5, *rows[5][1:]), (400, 1, rows[7][2]), (401, 1, rows[7][2]), (402, 2, rows[7][2]), (403, 2, rows[7][2]), (410, 9, rows[3][2])]
    assert found(negatives.hard_negatives(made(spark, rows), F.col("vec_id") % 5 == 0)) == brute(rows, 5)


def test_large_components_and_empty_table(spark):
    rows = [(0, 1, [1e30, 1.0]), (5, 1, [1e30, 0.0]), (6, 2, [6e6, 0.0]), (7, 2, [-1e30, 3.0]), (8, 2, [3e6, 1e6])]
    limit = math.isqrt((1 << 62) // 2)
    cut = [(i, y, [max(-limit / 256, min(limit / 256, float(np.float32(x)))) for x in v]) for i, y, v in rows]
    out = found(negatives.hard_negatives(made(spark, rows), F.col("vec_id") % 5 == 0))
    q = {i: [max(-limit, min(limit, math.floor(256 * float(np.float32(x))))) for x in v] for i, _, v in rows}
    assert cut and out and all(r[4] == sum(a * b for a, b in zip(q[r[0]], q[r[1]])) and r[5] == sum(a * b for a, b in zip(q[r[0]], q[r[3]])) for r in out)
    assert negatives.hard_negatives(made(spark, rows).where("1 = 0"), F.col("vec_id") % 5 == 0).count() == 0
    assert negatives.hard_negatives(made(spark, [(1, 1, [1.0])]), F.col("vec_id") % 5 == 0).count() == 0


def test_brackets_hold():
    """Every score lies between its bounds."""
    r = np.random.default_rng(0)
    x = r.integers(-80, 80, (300, 9))
    square = float((x**2).sum(1).max())
    sphere = negatives.Sphere(negatives.choose_pivots(x[:50], square, 4), square)
    block = negatives.Anchors(np.arange(20), np.zeros(20), x[:20] * 3, sphere, True)
    a, far = np.arange(20), sphere.of_rows(x)
    near, beyond = negatives._bounds(block, a, far, True)
    s = (x[:20] * 3) @ x.T
    assert (block.least(a, beyond) <= s).all() and (s <= block.most(a, near)).all() and (block.most(a, negatives._gap(block, far)) >= s).all()
