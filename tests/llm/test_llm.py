"""Corpus operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import html
import random
import re
import time
import unicodedata
import zlib

import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdictlake.llm import decontaminate, exact_dedup, html_text, langid, minhash, packing, pii, quality, queries, textops, tokenfile, tokens, warc

SF = "/root/testdata/sf0.001"
LONG = "word and another, über 12 " * 20_000
TEXTS = [(1, "a  b\tc"), (2, "abc"), (3, " a b c "), (4, None), (5, ""), (None, "null id"), (6, LONG), (7, LONG + " "), (8, "same text"), (8, "same text"), (9, "é\U0001f600 x@y.zz"), (10, " \n\t"), (11, "one")]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use themselves."""
    rows = [(i, t, "en" if t else None, "s", "x", "y", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_ string, t_ string, kept int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def none_of(df):
    return df.where("1 = 0")


# exact de-duplication
def exact_brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0))
    out = []
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0d]", "", t or "")
        c, null, best = min(groups[key])
        keep = None if null else best
        out.append((i, keep, len(groups[key]), keep == i and -c == len(t or ""), hashlib.sha256(key.encode()).hexdigest(), len(t or "")))
    return sorted(out, key=repr)


def test_exact_edges(edge, docs, texts):
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(edge).drop("raw_hash").collect()), key=repr) == exact_brute(TEXTS)
    assert exact_dedup.exact_dedup(none_of(edge)).count() == 0
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(docs, block_bytes=64).drop("raw_hash").collect()), key=repr) == exact_brute(texts.items())


def test_exact_with_colliding_fingerprints(edge):
    bad = lambda block: (F.length(block).cast("long") % 2, F.lit(0).cast("long"))
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(edge, block_bytes=5000, fingerprint=bad).drop("raw_hash").collect()), key=repr) == exact_brute(TEXTS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_corpus_oracle(spark, name):
    assert compare.difference(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


# tokens
def test_tokens_equal_the_library():
    e = tokens.Encoder(remembered=50)
    rng = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\t", "don't", "'ll", ".", "...", "é", "中", "　", " ", "\x1c", "\x85", "​", "12", "<|endoftext|>", "\U0001f600", "word,", "Word!!", "́"]
    rows = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [LONG[:5000], ""]
    for at in range(0, len(rows), 100):
        want = e.tokenizer.encode_batch_fast(rows[at : at + 100], add_special_tokens=False)
        assert [x.tolist() for x in e.encode(rows[at : at + 100])] == [w.ids for w in want]


def ids_of(text, end):
    return np.array([*tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_best_fit_by_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        window = rng.choice([8, 13, 64])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 60))]
        open_, want = [], []
        for p in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fit = [c for c, w in open_ if c >= lengths[p]]
            if fit:
                k = next(k for k in reversed(range(len(open_))) if open_[k][0] == min(fit))
                c, w = open_.pop(k)
            else:
                c, w = window, len(want)
                want.append([])
            want[w].append(lengths[p])
            if c > lengths[p]:
                open_.append((c - lengths[p], w))
        got = [[lengths[p] for p in w] for w in packing.best_fit_decreasing(lengths, window)]
        assert sorted(map(sum, got)) == sorted(map(sum, want)) and len(got) == len(want)
        cover = collections.Counter()
        packed = packing.pack(lengths, window)
        for w in packed:
            assert 0 < sum(b - a for _, a, b in w) <= window
            for p, a, b in w:
                cover.update((p, k) for k in range(a, b))
        assert cover == collections.Counter((p, k) for p, n in enumerate(lengths) for k in range(n))
        assert len(packed) <= -(-sum(lengths) // window) + 1


def check_pieces(rows, source, window):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in source}
    for i, t in source:
        if sum(j == i for j, _ in source) > 1:
            continue
        want, at = ids_of(t, 1), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = np.frombuffer(r.ids, f"<u{r.id_bytes}")
            assert r.start == at and r.length == len(part) and r.doc_tokens == len(want) and (part == want[at : at + len(part)]).all()
            assert r.ids_crc32 == zlib.crc32(part.astype("<u4").tobytes())
            at += len(part)
        assert at == len(want)
    for rows_ in by_sequence.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and {r.window_tokens for r in rows_} == {at}


def test_packing(edge, docs, texts):
    for window, buffer in ((2048, 10**9), (64, 500)):
        check_pieces(packing.pack_documents(edge, window=window, buffer_tokens=buffer).collect(), TEXTS, window)
    rows = packing.pack_documents(docs).collect()
    check_pieces(rows, list(texts.items()), 2048)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) * 2048 - total < 2048 * docs.rdd.getNumPartitions()
    assert packing.pack_documents(none_of(edge)).count() == 0


def test_padding(spark, edge):
    assert [packing.padded_length(n) for n in (1, 2, 3, 1000, 1024, 1025, 2047, 2048)] == [1, 2, 2048, 2048, 1024, 2048, 2048, 2048]
    for window, buffer in ((2048, 10**9), (64, 500)):
        pieces = packing.pack_documents(edge, window=window, buffer_tokens=buffer).cache()
        parts = collections.defaultdict(dict)
        for r in pieces.collect():
            parts[r.sequence_id][r.offset] = (np.frombuffer(r.ids, f"<u{r.id_bytes}"), r.id_bytes)
        whole = packing.padded_sequences(pieces, 7).collect()
        assert len(whole) == len(parts) > 0
        for r in whole:
            ids = np.concatenate([parts[r.sequence_id][k][0] for k in sorted(parts[r.sequence_id])])
            got = np.frombuffer(r.ids, f"<u{parts[r.sequence_id][0][1]}")
            assert r.n_tokens == len(ids) and len(got) == r.padded_tokens == packing.padded_length(len(ids), window)
            assert (got[: len(ids)] == ids).all() and (got[len(ids) :] == 7).all()
    # sequences whose tokens number a power of two stay as they are
    one = spark.createDataFrame([(1, "")], "doc_id long, text string")
    assert [(r.padded_tokens, len(r.ids)) for r in packing.padded_sequences(packing.pack_documents(one)).collect()] == [(1, 2)]


def test_token_files(spark, edge, docs, texts):
    for df, source, size in ((edge, TEXTS, 3000), (docs, list(texts.items()), 10**9)):
        rows = sorted(tokenfile.read_tokens(spark, tokenfile.write_tokens(df, file_tokens=size)).collect(), key=lambda r: r.start)
        order = sorted(source, key=lambda r: (r[0] is not None, r[0] or 0))
        assert [r.doc_id for r in rows] == [i for i, _ in order]
        at = 0
        for r, (_, t) in zip(rows, order, strict=True):
            want = ids_of(t, 2)
            assert r.start == at and r.n_tokens == len(want) and bytes(r.ids) == want.tobytes() and r.ids_crc32 == zlib.crc32(want.tobytes())
            at += len(want)
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(none_of(edge))).count() == 0


def test_random_access():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 1 << 26, 5000), rng.integers(0, 200, 700), np.array([7]), np.array([1 << 31])):
        f = tokenfile.TokenFile(tokenfile.to_bytes([3, None], np.array([1, len(ids)]), ids.astype("<u4")))
        assert f.documents(0, 2)[0] == [3, None] and [f.token(i) for i in range(len(ids))] == ids.tolist()
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids))):
            assert f.tokens(a, b).tolist() == ids[a:b].tolist()


def test_token_files_are_read_by_ranges(monkeypatch):
    """A file with a null id, documents across the blocks that are read at once, and no more bytes read than are asked for."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 9, 300)
    ids, ends, names = rng.integers(0, 1 << 20, lengths.sum()).astype("<u4"), np.cumsum(lengths), [None, *range(299)]
    raw, asked = tokenfile.to_bytes(names, ends, ids), []

    class Source:
        def read_at(self, n, place):
            asked.append(n)
            return raw[place : place + n]

    f = tokenfile.TokenFile(Source())
    del asked[:]
    assert f.token(700) == ids[700] and f.tokens(500, 520).tolist() == ids[500:520].tolist() and sum(asked) < 600
    for a, b in ((0, 300), (0, 1), (1, 2), (7, 9), (130, 300)):
        got = f.documents(a, b)
        assert got[0] == names[a:b] and got[1].tolist() == [0, *ends][a:b] and got[2].tolist() == ends[a:b].tolist()


def test_large_documents_are_read_alone(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(tokenfile, "READ_DOCS", 7)
    monkeypatch.setattr(tokenfile, "READ_TOKENS", 100)
    monkeypatch.setattr(tokenfile, "FILE_DOCS", 30)
    rows = tokenfile.read_tokens(spark, tokenfile.write_tokens(docs)).collect()
    assert {r.doc_id: bytes(r.ids) for r in rows} == {i: ids_of(t, 2).tobytes() for i, t in texts.items()}
    assert sorted(r.start for r in rows) == [0, *np.cumsum([r.n_tokens for r in sorted(rows, key=lambda r: r.start)])[:-1].tolist()]


# pages
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use</div>
{open}<h2>Head &amp; line</h2><p>Hello<b> wor</b>ld.<script>var x="</p>"</script></p><div class="ad">Buy this now, it is really good and long text too</div><p>More
  text &lt;b&gt; &#233;</p><form><input>Your name</form><p>End</p>{close}
<aside>Side</aside><section id="comments"><article class="comment"><p>Nice article, thanks for writing it!</p></article></section><footer>F<p>G</footer></body></html>"""


@pytest.mark.parametrize(("open_", "close"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ("", "")])
def test_article(open_, close):
    assert html_text.main_text(PAGE.replace("{open}", open_).replace("{close}", close)) == "Head & line\nHello world.\nMore text <b> é\nEnd"


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for p in pages.collect():
        m = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want[p.page_id] = "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|article)>", m)) if x)
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op4_html_text(spark, SF).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_page_edges(spark):
    rows = [(1, None), (2, ""), (3, "plain"), (4, "<p>a"), (5, "<div class='ad"), (6, "<article>x<p>y</article><article>" + "z " * 50_000 + "</article>"), (7, "<!-- <p>no</p>"), (7, "a < b <c"), (8, "<nav>open <article><p>kept</p></article>")]
    df = spark.createDataFrame(rows, "page_id int, html string").withColumn("h_", F.lit(1))
    got = collections.defaultdict(list)
    for r in html_text.extract(df).select("row_.page_id", "text", "n_chars").collect():
        got[r.page_id].append(r.text)
    assert got[1] == got[2] == [""] and got[3] == ["plain"] and got[4] == ["a"] and got[8] == ["kept"] and len(got[6][0]) > 50_000 and len(got[7]) == 2
    assert html_text.extract(none_of(df)).count() == 0


def test_every_run_of_a_page_is_kept():
    one, two, three = (f"Paragraph {k} of the story, which is long enough to be a line of prose." for k in "ABC")
    p = lambda *t: "".join(f"<p>{x}</p>" for x in t)
    teaser = f"<aside><article>{p('Another story that only asks to be read, next to this one')}</article></aside>"
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(9)) + "</ul>"
    links = p("".join(f"<a href='/{k}'>A headline of another story, number {k}, as long as prose</a>" for k in range(3)))
    kept = lambda *t: "\n".join(t)
    assert html_text.main_text(f"<article>{p(one)}</article><nav>x</nav><article>{p('Short.')}</article><article>{p(two, three)}</article>") == kept(one, "Short.", two, three)
    assert html_text.main_text(f"<main><article>{p(one)}</article><article>{p(two)}</article></main><main>{p(three)}</main>") == kept(one, two, three)
    for inset in ("<aside>Side</aside>", "<nav>Menu</nav>", "<div class='related'>More</div>", teaser):
        assert html_text.main_text(f"<body>{p(one)}{inset}{p(two, three)}</body>") == kept(one, two, three)
        assert html_text.main_text(f"<article>{p(one)}{inset}{p(two, three)}</article>") == kept(one, two, three)
    assert html_text.main_text(f"{menu}<nav>x</nav>{p(one, two, three)}<nav>x</nav>{links}<nav>x</nav>{menu}") == kept(one, two, three)
    assert html_text.main_text(f"<p><a href='/'>Home</p>{p(one)}<nav>x</nav>{p(two, three)}") == kept("Home", one, two, three)
    assert html_text.main_text(f"<div class='related-layout'><article>{p(one)}</article></div>") == one


def test_the_distribution_finds_bodies():
    long = [f"Sentence {k} of the story, which goes on for a while and ends here." for k in range(6)]
    p, want = "".join(f"<p>{x}</p>" for x in long), "\n".join(long)
    items = "".join(f"<li>Item {k}</li>" for k in range(8))
    assert html_text.main_text(f"<ul>{items}</ul>{p}<ul>{items}</ul>") == want  # a menu that nothing names, without links
    assert html_text.main_text(f"{p}<p>The end.</p>") == want + "\nThe end."
    assert html_text.main_text("<div>" + "</div><div>".join(long) + f"</div><ul>{items}</ul>") == want
    for attributes in ("class='post-share-story'", "class='notice-board-history'", "class='widget'", "class='hidden-gems'"):
        assert html_text.main_text(f"<body><div {attributes}>{p}</div></body>") == want, attributes
    assert html_text.main_text(f"<article>{p}<p class='notice-board-history'>Why notices hang there.</p></article>") == want + "\nWhy notices hang there."
    for gone in ("<div class='x' hidden>not seen, though it is as long as any other line</div>", "<div hidden class='x'>not seen at all</div>", "<div class='ad-slot top'>Buy this now, it is really good</div>", "<div class='cookieNotice'>We use them all</div>"):
        assert html_text.main_text(f"{p}{gone}") == want, gone
    teasers = "".join(f"<p><a href='/{k}'>Another story, number {k}, that only asks to be read</a></p>" for k in range(5))
    assert html_text.main_text(f"{p}{teasers}") == want
    assert html_text.main_text("<nav>a</nav><div class='ad'>Buy this now, it is really good and long text too</div><footer>b</footer>") == ""
    assert html_text.main_text("<div id='comments'>" + p + "</div>") == ""
    assert html_text.main_text("<div>" + "word " * 200_000 + "</div>") == ("word " * 200_000).strip()


def test_marks_are_weights():
    long = [f"Sentence {k} of the story, which goes on for a while and ends here." for k in range(6)]
    p, want = "".join(f"<p>{x}</p>" for x in long), "\n".join(long)
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(5)) + "</ul>"
    talk = "<p>Nice article, thanks a lot for writing it, I liked it very much!</p>" * 2
    assert html_text.main_text(f"<article class='teaser'><p>Another story that asks to be read</p></article><div id='story'>{p}</div>") == want
    assert html_text.main_text(f"<article><p>Another story that asks to be read</p></article><div id='story'>{p}</div>").endswith(want)
    for body in ("article", "main"):
        assert html_text.main_text(f"<{body}>{menu}{p}<div>Sign up to our newsletter</div>{p}{menu}</{body}>") == want + "\n" + want
        assert html_text.main_text(f"<{body}>{p}<div class='user-comments'>{talk}</div></{body}>") == want
        assert html_text.main_text(f"<{body}>{p}<div class='discussion'>{talk}</div></{body}>").startswith(want)  # a section of the text may be called so
    assert html_text.main_text(f"<div>{p}</div><div class='discussion'>{talk}</div>") == want
    assert html_text.main_text(f"<div>By law we tell you here that all of this is without warranty.</div><div id='story'>{p}</div>") == want
    assert html_text.main_text(f"<div>{p}</div><div>{p}</div>") == want + "\n" + want
    assert html_text.main_text(f"<div>{p}</div>" * 3 + "<div>Made by us</div>") == "\n".join([want] * 3)


def test_pages_without_marks(spark):
    """With all tags and names that say what a part is made neutral, no line of an article is lost, and menus, adverts and footers go."""
    lost = menus = gained = n = 0
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(?:article|nav|aside|header|footer|form)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", page.html))
        want, got = html_text.main_text(page.html).split("\n"), html_text.main_text(plain).split("\n")
        links = {" ".join(html.unescape(x).split()) for x in re.findall(r"<li><a[^>]*>(.*?)</a>", page.html)} - set(want)
        n, lost, menus, gained = n + 1, lost + len(set(want) - set(got)), menus + len(links & set(got)), gained + bool(set(got) - set(want))
    assert lost == menus == 0 and gained <= 0.02 * n, (lost, menus, gained, n)


def test_runs_lie_between_surges_and_dives():
    rng = random.Random(9)
    for _ in range(300):
        weights = [rng.choice([None, 0, 5, 15, 50]) for _ in range(rng.randint(0, 14))]
        runs, known = html_text.between_surges_and_dives(weights), [x or 0 for x in weights]
        windows = [(a, a + html_text.WINDOW, sum(known[max(a, 0) : max(a + html_text.WINDOW, 0)])) for a in range(1 - html_text.WINDOW, len(known))]
        least = min(html_text.SURGE, max((w[2] for w in windows), default=0))
        inside = {k for a, b, total in windows if total >= least > 0 for k in range(max(a, 0), min(b, len(known))) if weights[k] is not None}
        covered = {k for a, b in runs for k in range(a, b)}
        assert inside <= covered and all(weights[a] is not None and weights[b - 1] is not None for a, b in runs)
        assert not {k for k in covered - inside if weights[k] is not None}


@pytest.mark.parametrize("part", ['<a "', "<!--", "<p ", "<", "<div class='ad'>", "<script>", "</", "&amp;", "<aside><article>"])
def test_pages_take_linear_time(part):
    def seconds(n):
        start = time.perf_counter()
        html_text.main_text(part * n)
        return time.perf_counter() - start

    assert seconds(40_000) < 8 * max(seconds(10_000), 0.02)


# quality
def test_quality_holds_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good, bad = np.array([r.score for r in rows if r.quality]), np.array([r.score for r in rows if not r.quality])
    assert right > 0.97 and (good[:, None] > bad).mean() > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark, edge):
    docs = edge.select(F.col("doc_id").alias("key"), "text")
    labels = edge.select(F.col("doc_id").alias("key"), (F.col("doc_id") % 2).cast("int").alias("label"))
    rows = quality.score(edge, quality.fit(docs, labels)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(edge, quality.fit(docs, labels.where("label = 1"))).collect()} == {1.0}
    assert {r.score for r in quality.score(edge, quality.fit(docs, none_of(labels))).collect()} == {0.5}
    assert {r.score for r in quality.score(edge, quality.fit(none_of(docs), labels)).collect()} == {0.5}


# decontamination
def brute_tiles(a, b, least):
    """Greedy string tiling by trying every pair of places."""
    ua, ub, out = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and ua[i + n] and ub[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        ua[i : i + n], ub[j : j + n] = [False] * n, [False] * n
        out += n


def test_tiles_cover_like_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        a = [rng.randint(1, 6) for _ in range(rng.randint(0, 30))]
        b = [rng.randint(1, 6) for _ in range(rng.randint(0, 20))]
        found = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        used_a, used_b = set(), set()
        for p, q, n in found:
            assert n >= 3 and a[p : p + n] == b[q : q + n]
            assert not used_a & set(range(p, p + n)) and not used_b & set(range(q, q + n))
            used_a |= set(range(p, p + n))
            used_b |= set(range(q, q + n))
        assert abs(len(used_b) - brute_tiles(a, b, 3)) <= 3


def test_tiles_leave_no_run_behind():
    # the run i0..i5 meets a marked tile at its end both times: only its rest i0..i4 is free
    text, item = [*range(5, 14), 90, *range(6), 91, *range(6)], list(range(20))
    assert sum(n for _, _, n in decontaminate.tiles(np.array(text, np.uint64) + np.uint64(1), np.array(item, np.uint64) + np.uint64(1))) == 14
    rng = random.Random(7)
    for _ in range(200):
        a = [rng.randint(1, 4) for _ in range(rng.randint(0, 30))]
        b = [rng.randint(1, 4) for _ in range(rng.randint(0, 24))]
        found = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sum(n for _, _, n in found) == brute_tiles(a, b, 3)


def test_short_items_are_compared_whole(spark):
    items = [(1, "Yes, it is"), (2, "one two three four"), (3, "alone"), (4, "one two three four five"), (5, ""), (6, None), (7, "YES it is")]
    texts = [(1, "I say: yes -- it is so"), (2, "yes is it"), (3, "one two three four"), (4, "four three two one alone"), (5, "alone"), (6, None), (7, "yes it")]
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    found = sorted((r.doc_id, r.item_id, r.coverage, r.item_tokens) for r in got.collect())
    assert found == [(1, 1, 1.0, 3), (1, 7, 1.0, 3), (3, 2, 1.0, 4), (4, 3, 1.0, 1), (5, 3, 1.0, 1)]


def test_decontamination(spark, edge):
    item = " ".join(f"tok{k}" for k in range(40))
    w = item.split()
    docs = spark.createDataFrame(
        [(1, "intro " + item + " end"), (2, " ".join(w[20:] + ["x"] * 9 + w[:20])), (3, " ".join(w[:10])), (4, " ".join(w[::-1])), (5, None), (6, ""), (None, item.upper()), (7, "a, b. " * 30_000 + item), (8, item), (8, item)],
        "doc_id long, text string",
    ).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(100, item), (101, None), (102, ""), (103, "two words"), (104, "zz yy xx ww vv uu tt"), (100, item)], "item_id long, text string")
    for block in (4 << 20, 60):
        got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs.drop("item_id"), bench, block_bytes=block).collect())
        assert set(got) == {(1, 100), (2, 100), (None, 100), (7, 100), (8, 100)} and got[(8, 100)] == 4
        assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(edge, none_of(bench)).count() == 0 and decontaminate.decontaminate(edge, none_of(bench)).count() == len(TEXTS)
    assert decontaminate.contaminated(none_of(edge), bench).count() == 0


def test_decontamination_beyond_ascii(spark, monkeypatch):
    items = {1: "Äpfel über große Öfen künftig schön färben", 2: "l'été déjà passé où naît l'œuvre", 3: "机器学习模型需要大量的训练数据", 4: "ภาษาไทยไม่มีช่องว่าง", 5: "ΟΔΥΣΣΕΥΣ ήλθε από την Τροία πίσω", 6: "plain words of ascii only here"}
    copies = {
        1: [items[1].upper(), items[1].replace(" ", "\u00a0"), "„" + items[1].replace(" ", " — ") + "“", unicodedata.normalize("NFD", items[1])],
        2: [items[2].upper(), items[2].replace("'", "’"), "«" + items[2] + "»"],
        3: [items[3], "前文。" + items[3] + "，后文", items[3][:7] + "。" + items[3][7:]],
        4: [items[4], "ก" + items[4]],
        5: [items[5].lower(), items[5].upper()],
        6: ["é " + items[6].upper(), "“plain” words…of\u2003ascii–only here"],
    }
    rows = [(10 * i + k, t) for i, c in copies.items() for k, t in enumerate(c)] + [(97, "ganz anderer Text über schöne Gärten"), (98, "今天天气很好"), (99, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(10 * i + k, i) for i, c in copies.items() for k in range(len(c))}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [97, 98, 99]
    column = pa.array([t for _, t in rows] + ["", "字", "字a字", None])
    one = decontaminate.token_hashes(column)
    monkeypatch.setattr(decontaminate, "SLICE", 5)
    two = decontaminate.token_hashes(column)
    each = [decontaminate.token_hashes(column[k : k + 1])[0] for k in range(len(column))]
    assert all(np.array_equal(x, y) for x, y in zip(one, two, strict=True)) and [len(x) for x in each] == np.diff(one[1]).tolist() and np.array_equal(np.concatenate(each), one[0])


def test_leaks_of_the_tables(spark, texts):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    tok = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    want = {(d, i) for d, t in texts.items() for i, b in bench.items() if " ".join(tok(b)) in " ".join(tok(t))}
    assert want <= {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, SF).collect()}


# personal data
BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            if k == 0 or k == 1 and all(int(p) <= 255 for p in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and total % 10 == 0 or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans(spark, edge, texts):
    rng = random.Random(6)
    alphabet = ["1", "23", "4111 1111 1111 1111", ".", "+", "-", " ", "(", ")", "a@b.c", "_x", "@", "255", "256.1.1.1", "1.2.3.4", "é", "+1 (743) 555-3824", "%"]
    extra = [(1000 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12)))) for k in range(1500)]
    source = [(i, t) for i, t in texts.items()] + extra + [(5000, "1" * 60_000 + " " + "a" * 60_000), (5001, None), (5002, "")]
    df = spark.createDataFrame(source, "doc_id long, text string").withColumn("pii_text", F.lit("z"))
    got = {r.doc_id: r.s for r in pii.find_spans(df).select("doc_id", "pii_text", pii.spans_text(F.col("base_spans")).alias("s")).collect()}
    assert got == {i: base_spans(t) for i, t in source}
    assert pii.find_spans(none_of(edge)).count() == 0 and pii.find_spans(edge).count() == len(TEXTS)


def test_every_octet(spark):
    """Parts up to 255 count, with and without zeros before them."""
    rows = [(k * 4 + z, f"ip {'0' * z}{k}.0.00.{k} x") for k in range(301) for z in range(4)]
    got = {r.doc_id: len(r.base_spans) for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i // 4 <= 255) for i, _ in rows}
    some = spark.createDataFrame([(1, "host 10.0.0.1 and 127.0.0.1 and 192.168.0.1 and 0.0.0.0 ok, 1.2.3.0256 not")], "doc_id long, text string")
    assert len(pii.find_spans(some).first().base_spans) == 4


def test_added_spans(spark):
    rows = [(1, "mail bob [at] host [dot] com now"), (2, "Tel. (555) 123-4567"), (3, "order 555-222-1111"), (4, "date 2024-01-02 version 10.20.30"), (5, "look at that. Then"), (6, "card 4111.1111.1111.1111"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.s, s.e) for s in r.added_spans] for r in pii.find_spans(df).collect()}
    assert got[1] == [("email", 5, 28)] and got[2] == [("phone", 5, 19)] and got[6] == [("card", 5, 24)] and not (got[3] or got[4] or got[5] or got[7])
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1] == "mail [EMAIL] now" and clean[5] == rows[4][1] and clean[7] is None


PLANTED = {"email": r"[\w.]+@mail\d\.example\.com", "ip": r"\d{1,3}(?:\.\d{1,3}){3}", "card": r"(?<!\d)\d{16}(?!\d)", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}"}


def rewritten(kind, found, rng):
    """A piece of personal data of the tables in a form that no base pattern matches, with what people write before it."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "email":
        user, host = found.split("@")
        return rng.choice(["mail ", "contact ", ""]) + "{}", rng.choice([f"{user}[at]{host}", f"{user} (at) " + host.replace(".", " [dot] "), f"{user} @ {host}", user + "(at)" + host.replace(".", "(dot)")])
    if kind == "card":
        return rng.choice(["card ", "visa: ", "pay with "]) + "{}", rng.choice("._/").join(digits[k : k + 4] for k in range(0, 16, 4))
    if kind == "phone":
        return rng.choice(["phone: ", "call me on ", "Tel. ", "mobile "]) + "{}", rng.choice([f"({digits[1:4]}) {digits[4:7]}-{digits[7:11]}", f"0{digits[1:4]}-{digits[4:7]}-{digits[7:11]}", f"{digits[1:4]}.{digits[4:7]}.{digits[7:11]}"])
    return rng.choice(["ip ", "host ", "server: "]) + "{}", ":".join(f"{rng.randrange(1 << 16):04x}" for _ in range(8))


def test_added_spans_on_planted_data(spark):
    """The tables' own personal data, rewritten in place, is found again; what is added to texts as they are counts as wrong."""
    rng, rows, planted = random.Random(11), [], collections.Counter()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect() if r.text and len(r.text) < 20_000]
    for i, t in texts:
        hits = [(m.start(), m.end(), kind, m[0]) for kind in pii.KINDS for m in re.finditer(PLANTED[kind], t)]
        if not hits:
            continue
        a, b, kind, found = min(hits)
        left, new = rewritten(kind, found, rng)
        start = a + len(left) - 2
        rows.append((i, t[:a] + left.format(new) + t[b:], kind, start, start + len(new)))
        planted[kind] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, a int, b int")
    caught = collections.Counter()
    for r in pii.find_spans(df).select("kind", "a", "b", "added_spans").collect():
        caught[r.kind] += any(s.kind == r.kind and s.s < r.b and r.a < s.e for s in r.added_spans)
    recall = {k: caught[k] / planted[k] for k in planted}
    wrong = sum(len(r.added_spans) for r in pii.find_spans(spark.createDataFrame(texts, "doc_id long, text string")).select("added_spans").collect())
    print("planted", dict(planted), "recall", recall, "added to", len(texts), "texts as they are:", wrong)
    assert set(planted) == set(pii.KINDS) and all(x >= 0.9 for x in recall.values()) and wrong <= 0.02 * sum(planted.values())


def test_personal_data_plan_is_native(spark):
    plan = queries.op7_pii(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# archives
def test_archives(spark):
    rows = [(1, "http://a/\r\nx", "<p>1"), (2, None, "<p>1"), (3, "u", None), (4, "u", ""), (None, "u", "<p>1"), (5, "ü", "é" * 40_000), (6, "v", "<p>2"), (6, "v", "<p>2"), (7, "big", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("r", F.lit(0))
    for least in (0, 3):
        got = collections.defaultdict(list)
        for r in warc.read_archives(spark, warc.write_archives(df, least_bytes=least)).collect():
            got[r.page_id].append(r)
        for i, url, body in rows:
            raw = (body or "").encode()
            for r in got[i]:
                assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.sha1_base32(raw))
                assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
        kinds = {i: [(r.record_type, r.refers_to) for r in x] for i, x in got.items()}
        assert kinds[1] == kinds[None] == [("revisit", 2)] and kinds[2] == [("response", None)] and kinds[6] == [("response", None)] * 2
        assert kinds[3] == ([("revisit", 4)] if least == 0 else [("response", None)])
    assert warc.read_archives(spark, warc.write_archives(none_of(df))).count() == 0


def test_archive_layout(tmp_path):
    import io

    class Kept(io.BytesIO):
        def close(self):
            self.raw = self.getvalue()

    out = Kept()
    w = warc.Writer(out)
    for k in range(50):
        w.add(warc.record(k, f"http://x/{k}", f"<p>page {k}</p>".encode() * 9, "D", None, False, 9))
    w.close()
    assert int.from_bytes(out.raw[:4], "little") == warc.DICTIONARY_FRAME
    assert [h["X-Page-ID"] for h, _ in warc.read_archive(io.BytesIO(out.raw))] == [str(k) for k in range(50)]


# language
def test_language_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, edge):
    model = langid.fit_prototypes(edge.select(F.col("doc_id").alias("key"), "text", "lang"))
    got = collections.defaultdict(set)
    for r in langid.predict_language(edge, model).select("row_.doc_id", "row_.kept", "lang_pred", "score").collect():
        got[r.doc_id].add((r.lang_pred, 0 <= r.score <= 1))
    assert got[4] == got[5] == got[10] == {("und", True)} and got[6] == {("en", True)}
    empty = langid.fit_prototypes(none_of(edge).select(F.col("doc_id").alias("key"), "text", "lang"))
    assert {r.lang_pred for r in langid.predict_language(edge, empty).collect()} == {"und"}


def test_binding_is_the_same_everywhere():
    a, b = langid.Space(64), langid.Space(64)
    g = np.unique(a.grams("Hyperdimensional vectors, bound and bundled"))
    assert (a.lookup(g) == b.bind(g)).all() and len(a.grams("123 -- !")) == 0
    x, y, z = (b.letter(ord(c)) for c in "abc")
    packed = np.array([ord("a") | ord("b") << 21 | ord("c") << 42], np.uint64)
    assert (b.bind(packed)[0] == x * np.roll(y, 1) * np.roll(z, 2)).all()


# near-duplicates
def near_brute(source, per_cent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in source]
    root = {i: i for i, _ in source}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= per_cent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def test_near_edges(edge, docs, texts):
    assert sorted((tuple(r) for r in minhash.near_duplicates(edge).collect()), key=repr) == near_brute(TEXTS)
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=repr) == near_brute(list(texts.items()))
    assert minhash.near_duplicates(none_of(edge)).count() == 0


def test_near_chains_and_crowds(spark):
    """Chains whose ends differ, and a crowd that shares bands although few of it are linked."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    rows, k = [], 0
    for _ in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 4, 12, 16])):
            w[rng.randrange(400)] = f"n{rng.randint(0, 10**6)}"
        rows.append((k := k + 1, " ".join(w)))
    w = list(base)
    for _ in range(40):
        for _ in range(5):
            w[rng.randrange(400)] = f"m{rng.randint(0, 10**6)}"
        rows.append((k := k + 1, " ".join(w)))
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == near_brute(rows)


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    test_near_chains_and_crowds(spark)


def test_estimate_is_corrected():
    rng = np.random.default_rng(2)
    common, only = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    a, b = np.unique(np.concatenate([common, only[:1000]])), np.unique(np.concatenate([common, only[1000:]]))
    same = np.frombuffer(minhash.signature(a).tobytes(), np.uint8) == np.frombuffer(minhash.signature(b).tobytes(), np.uint8)
    assert abs(minhash.estimate(same.sum()) - 0.6) < 0.12


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.c: r.comp for r in minhash.components(links).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100}


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(9)
    rows = ["".join(rng.choice("ab  \né") for _ in range(rng.randint(0, 40))) for _ in range(50)] + ["x" * 100]
    one = textops.word_hashes(*textops.utf8(pa.array(rows)))
    monkeypatch.setattr(textops, "SLICE", 16)
    two = textops.word_hashes(*textops.utf8(pa.array(rows)))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
    split = [re.findall(r"[^ \n]+", r) for r in rows]
    names = {}
    for words, a, b in zip(split, one[1], one[1][1:], strict=False):
        assert b - a == len(words)
        for w, h in zip(words, one[0][a:b], strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
