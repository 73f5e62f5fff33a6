"""Page scans, text outside boxes, and sections and bodies of scanned pages."""

import os
import random
import time

import compare
import numpy as np
import pytest

from verdictlake.operators import chunking
from verdictlake.plans import scans
from verdictlake.sources import layout

SF = "/root/testdata/sf0.001"


def test_layout():
    page = """<head><title>No</title></head><p>One two<br>three &amp; four</p><script>x</script><ul><li>a<li>b c</ul>
      <table><tr><th>Name</th><th>Age of it</th></tr><tr><td>Ann<b>a</b></td><td>3</td></tr><tr><td></td></tr></table><p>""" + "word " * 45
    items = layout.laid_out(page)
    words = [(i[1], i[3], i[5]) for i in items if i[0] == "word"]
    assert words[:8] == [(0.0, 0.0, "One"), (0.0, 24.0, "two"), (12.0, 0.0, "three"), (12.0, 36.0, "&"), (12.0, 48.0, "four"), (24.0, 0.0, "a"), (36.0, 0.0, "b"), (36.0, 12.0, "c")]
    assert words[8:13] == [(48.0, 0.0, "Name"), (48.0, 150.0, "Age"), (48.0, 174.0, "of"), (48.0, 192.0, "it"), (60.0, 0.0, "Anna")]
    boxes = {i[0]: i for i in items if i[0] != "word"}
    assert boxes["ul"][1:3] == (24.0, 48.0) and boxes["table"][6] == [["Name", "Age of it"], ["Anna", "3"], [""]] and boxes["table"][1] == 48.0
    after = [w for w in words if w[2] == "word"]
    assert len(after) == 45 and {w[0] for w in after} == {after[0][0] + 12 * k for k in range(3)} and after[0][0] >= boxes["table"][2]
    assert layout.laid_out(None) == layout.laid_out("") == [] and layout.laid_out("</ul></table>plain")[0][5] == "plain"


def test_references_without_semicolon(spark, tmp_path):
    """Words, lines and text of pages that break off inside a reference agree with SQL."""
    cut = ["and&amp", "and&am", "and&", "&quot", "a&lt b&copy c", "&amp;&amp", "&amp;lt;", "&amp;&middot;", "&nosuch;", "&ampx; y", "R&D;", "&#x27;x", "&#x27 y"]
    pages = [(k, f"http://a.b/{k}", f"<h1>Title {t}</h1><ul><li>in {t}</li></ul><p><b>{t}</b> x {t}") for k, t in enumerate(cut)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "parts"))
    os.rename(next((tmp_path / "parts").glob("*.parquet")), tmp_path / "pages.parquet")
    for t in set(compare.TABLES) - {"pages"}:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    assert [i[5] for i in layout.laid_out("<p>and&amp</p><p>&amp;&lt;")] == ["and&amp", "&<"]
    for name, sql in scans.ORACLE_SQL.items():
        assert compare.difference(spark, str(tmp_path), scans.QUERIES[name], sql) == ""


def test_scan_edges(spark):
    rows = [(1, None), (1, ""), (2, "<p>a b"), (2, "<p>a b"), (None, "x"), (3, "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"), (4, "w " * 300_000)]
    df = spark.createDataFrame(rows, "page_id int, html string").selectExpr("*", "1 as kind", "2 as id_")
    out = layout.scan(df)
    counts = {r.page_id: r["count"] for r in layout.words(out).groupBy("page_id").count().collect()}
    assert counts == {2: 4, None: 1, 3: 4, 4: 300_000}
    assert layout.boxes(out).first().cells == [["1", "2"], ["3", "4"]] and layout.scan(df.where("1 = 0")).count() == 0
    assert "html" not in str(layout.words(layout.scan(df.select("page_id", "html")).select("page_id", "kind", "text", "cells")).columns)


def brute_outside(points, boxes):
    return list((p, x, y) for p, x, y in points if None in (x, y) or not any(q == p and a <= x <= c and b <= y <= d for q, a, b, c, d in boxes))


def test_outside_boxes(spark):
    r = random.Random(2)
    points = [(r.randrange(3), r.uniform(-50, 50), r.uniform(-50, 50)) for _ in range(800)] + [(0, None, 1.0), (1, 5.0, 5.0), (1, 5.0, 5.0), (2, -4.0, 8.0)]
    boxes = [(r.randrange(3), x, y, x + r.choice([0, 0.3, 4, 30]), y + r.choice([0, 0.2, 5])) for x, y in [(r.uniform(-60, 50), r.uniform(-60, 50)) for _ in range(60)]] + [(1, 5.0, 5.0, 5.0, 5.0), (2, -4.0, 0.0, 0.0, 8.0), (2, 9.0, 9.0, 1.0, 1.0)]
    p, b = spark.createDataFrame(points, "page int, x double, y double"), spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((tuple(x) for x in chunking.outside_boxes(p, b, "page").collect()), key=repr)
    assert got == sorted(brute_outside(points, boxes), key=repr)
    assert chunking.outside_boxes(p, b.where("1 = 0"), "page").count() == len(points)


def test_a_hot_page_is_split(spark):
    """100,000 points and 10,000 boxes of one page take linear time."""
    n, m = 100_000, 10_000
    p = spark.range(n).selectExpr("1 as page", "(id * 7919 % 100003) / 10.0 as x", "(id * 104729 % 100019) / 10.0 as y")
    b = spark.range(m).selectExpr("1 as page", "(id * 6133 % 9973) * 1.0 as x0", "(id * 3571 % 9967) * 1.0 as y0").selectExpr("page", "x0", "y0", "x0 + 20 as x1", "y0 + 5 as y1")
    began = time.time()
    n_out = chunking.outside_boxes(p, b, "page").count()
    took = time.time() - began
    x, y = (np.array([getattr(r, c) for r in p.select(c).collect()]) for c in ("x", "y"))
    inside = np.zeros(n, bool)
    for r in b.collect():
        inside |= (x >= r.x0) & (x <= r.x1) & (y >= r.y0) & (y <= r.y1)
    assert n_out == n - inside.sum() and took < 60


@pytest.mark.parametrize("name", ["page_bodies", "page_sections"])
def test_scanned_records(spark, name):
    """Bodies and sections against plain computation from the lines, whose own oracle is SQL."""
    db = compare.oracle
    lines = db(SF, scans.ORACLE_SQL["page_lines"].replace("select page_id, line, n_words, content from pl", "select page_id, url, top, content from pl"))[1]
    got = [tuple(r) for r in scans.QUERIES[name](spark, SF).collect()]
    if name == "page_bodies":
        heights = {}
        for page, url, top, _ in lines:
            heights[page] = max(heights.get(page, 0), top + 12)
        assert sorted(p for _, p, _, _ in got) == sorted(heights) and all(0 <= t < b <= heights[p] and b - t >= 0.7 * heights[p] for _, p, t, b in got)
        return
    import hashlib
    import re

    text = {}
    for page, line, _, content in db(SF, scans.ORACLE_SQL["page_text"])[1]:
        text.setdefault(page, []).append((line, content))
    want = set()
    for page, found in text.items():
        section, seen = None, set()
        for k, (_, content) in enumerate(sorted(found)):
            if re.search(r"^[^.,|]{1,40}\.?$", content.strip()):
                section = content.strip()
            elif (section, content) not in seen:
                seen.add((section, content))
                want.add((page, k, hashlib.md5(content.encode()).hexdigest(), section))
    assert set(got) == want
