"""Scanned pages: words with their places, body regions, text outside boxes, lines, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..sources import layout, shared
from ..sources.tables import spread

_SCANNED: dict[tuple, tuple[str, DataFrame]] = {}


def scanned(spark, sf_dir) -> DataFrame:
    """The scan of all pages, written once and kept for the application while the table's files stay."""
    path = f"{sf_dir}/pages.parquet"
    key, state = (spark.sparkContext.applicationId, path), shared.version(spark, path)
    if _SCANNED.get(key, ("",))[0] != state:
        _SCANNED[key] = (state, shared.written(layout.scan(spread(spark, sf_dir, "pages")), "scanned"))
    return _SCANNED[key][1]


def _lines(words: DataFrame) -> DataFrame:
    return chunking.group_lines(words.select("page_id", "top", F.col("x0").alias("x"), F.col("text").alias("word")), "page_id")


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every page with its place."""
    return layout.words(scanned(spark, sf_dir)).select("page_id", "top", "x0", "x1", F.col("text").alias("word"))


def page_lines(spark, sf_dir):
    return _lines(layout.words(scanned(spark, sf_dir)))


def page_text(spark, sf_dir):
    """Lines of the words that lie in no list or table box."""
    s = scanned(spark, sf_dir)
    points = layout.words(s).withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("top") + F.col("bottom")) / 2})
    found = layout.boxes(s).select("page_id", "x0", F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1"))
    # words may stand beyond the right margin: what counts of a box is its height
    return _lines(chunking.outside_boxes(points, found.withColumn("x1", F.lit(1e6)), "page_id"))


def page_bodies(spark, sf_dir):
    """What is left of each page without the headers and footers that its site repeats."""
    s = scanned(spark, sf_dir)
    host = spread(spark, sf_dir, "pages").select("page_id", F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("")).alias("file"))
    lines = _lines(layout.words(s)).join(layout.words(s).select("page_id", "top").distinct().withColumn("line", F.dense_rank().over(_by_page())), ["page_id", "line"])
    rows = lines.join(host, "page_id").select("file", F.col("page_id").alias("page"), F.col("top").alias("y0"), (F.col("top") + layout.LINE).alias("y1"), F.col("content").alias("text"))
    pages = rows.groupBy("file", "page").agg(F.max("y1").alias("height"))
    return chunking.page_regions(rows, pages).select("file", "page", "top", "bottom")


def _by_page():
    from pyspark.sql import Window

    return Window.partitionBy("page_id").orderBy("top")


def page_sections(spark, sf_dir):
    """Text of scanned pages by section: short lines without inner punctuation stand for headings."""
    heading = lambda line: T.is_heading(line) | F.trim(line).rlike(r"^[^.,|]{1,40}\.?$")
    lines = page_text(spark, sf_dir)
    docs = lines.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("text"))
    return chunking.sections(docs, "page_id", "text", heading).select("page_id", "line_no", F.md5("line").alias("line_md5"), "section")


QUERIES = {f.__name__: f for f in (page_words, page_lines, page_text, page_bodies, page_sections)}

_TAGS = "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".replace(" ", "|")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_decode = "x"
for _a, _b in _ENTITIES:
    _decode = f"replace({_decode}, '{_a}', '{_b}')"
# a letter that no page has marks what stands in a list
_WORDS = rf"""hp as (select page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<head>.*?</head>|<script>.*?</script>|<style>.*?</style>', '', 'g'), '<li>', '<li>' || chr(1), 'g') as h from pages),
hb as (select page_id, url, generate_subscripts(b, 1) as block, unnest(b) as x from (select page_id, url, regexp_split_to_array(h, '</?(?:{_TAGS})(?:\s[^>]*)?>') as b from hp)),
hw as (select page_id, url, block, x[1] = chr(1) as listed, list_filter(regexp_split_to_array({_decode.replace("x", "regexp_replace(replace(x, chr(1), ''), '<[^>]*>', '', 'g')", 1)}, '\s+'), lambda w: w <> '') as ws from hb),
ho as (select *, list_transform(range(1, len(ws) + 1), lambda i: list_sum(list_transform(ws[1 : i - 1], lambda w: length(w) + 1))::bigint) as os from hw where len(ws) > 0),
hr as (select *, coalesce(sum(coalesce(os[-1], 0) // 100 + 1) over (partition by page_id order by block rows between unbounded preceding and 1 preceding), 0)::bigint as before from ho),
pw as materialized (select page_id, url, listed, 12.0::double * (before + coalesce(o, 0) // 100) as top, 6.0::double * (coalesce(o, 0) % 100) as x0, 6.0::double * (coalesce(o, 0) % 100 + length(word)) as x1, word from (select page_id, url, listed, before, unnest(os) as o, unnest(ws) as word from hr)),
pl as materialized (select page_id, url, top, dense_rank() over (partition by page_id order by top) as line, n_words, content from (select page_id, any_value(url) as url, top, count(*) as n_words, string_agg(word, ' ' order by x0) as content from pw group by page_id, top))"""
_TEXT = """pt as materialized (select page_id, dense_rank() over (partition by page_id order by top) as line, n_words, content from (select page_id, top, count(*) as n_words, string_agg(word, ' ' order by x0) as content from pw where not listed group by page_id, top))"""

ORACLE_SQL = {
    "page_words": f"with {_WORDS} select page_id, top, x0, x1, word from pw",
    "page_lines": f"with {_WORDS} select page_id, line, n_words, content from pl",
    "page_text": f"with {_WORDS}, {_TEXT} select page_id, line, n_words, content from pt",
}
