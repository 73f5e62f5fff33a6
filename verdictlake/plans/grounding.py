"""Queries over evidence: context scoring and packing, selection, routing, citations.

A passage's context blocks are its fifty best documents; the policy below names sources and terms of the tables at hand.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import evidence as E
from ..operators import names
from ..operators import retrieval as R
from ..operators import rules
from ..sources import shared
from ..sources.shared import shuffle_partitions
from ..sources.tables import dealt, table
from . import ranking
from .policy import POLICY, SOURCES

#: Terms and routes that the invented prose of the tables has.
TABLE_POLICY = replace(
    POLICY,
    documents={"first": ("src0",), "second": ("src1",), "third": ("src2",), "fourth": ("src3",), "near": ("src4", "src5"), "rest": tuple(f"src{k}" for k in range(6, 20))},
    priority=(("first", 35, ()), ("second", 30, ("that", "with")), ("third", 30, ("ered", "tion")), ("fourth", 18, ("zzz",))),
    co_occurrence=((("the", "and"), ("license", "token")), (("er",), ("worthless", "555-")), (("qqq",), ("the",))),
    routes={"Exposure": (("first", "second", "third"), ("tion", "the", "license")), "Source": (("near",), ("ered", "token")), "Overlay": (("rest",), ("555-", "and", "with"))},
)
CEILING = 5.0


def blocks(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    q, d = ranking.queries_of(spark, sf_dir), ranking.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # written, so that it is searched once and its rows can be counted: while they are few, documents are not moved for them
    top = shared.written(R.bm25(q, ranking.words_index(spark, sf_dir), k).select("query_id", "doc_id", F.col("rank").alias("place")).join(q, "query_id"), "blocks")
    return d.join(R.small(top), "doc_id").repartition(shuffle_partitions(spark), "query_id")  # few bytes but much work: a fixed number of partitions is not merged by size


def _scored(spark, sf_dir):
    return E.context_score(blocks(spark, sf_dir), TABLE_POLICY)


def context_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("query_id", "doc_id", "score")


def context_pack(spark, sf_dir):
    top = E.diverse_top(_scored(spark, sf_dir), "query_id", "source", "place")
    header = F.concat(F.lit("\n--- Ranked Evidence "), F.col("rank").cast("string"), F.lit(": "), F.col("source"), F.lit(" (Retrieved #"), F.col("place").cast("string"), F.lit(") ---\n"))
    return E.pack_budget(top, "query_id", "text", header).select("query_id", "doc_id", "rank", F.length("part").alias("n_chars"), F.md5("part").alias("part_md5"))


def _evidence(spark, sf_dir):
    items = blocks(spark, sf_dir, 20).withColumn("snippet", F.left("text", F.lit(E.SNIPPET_CHARS)))
    return E.evidence_scores(items, T.query_terms(F.col("query")), F.lit(CEILING), F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))


def _selected(spark, sf_dir):
    return E.select_evidence(_evidence(spark, sf_dir), "query_id", "place")


def evidence_scores(spark, sf_dir):
    return _evidence(spark, sf_dir).select("query_id", "doc_id", "priority", F.array_join("criteria", ",").alias("criteria"), F.array_join("matched_transaction", " ").alias("matched"))


def evidence_select(spark, sf_dir):
    return _selected(spark, sf_dir).select("query_id", "doc_id", "rank", "priority")


def promoted_source(spark, sf_dir):
    """Orders whose strongest line states the rule directly."""
    items = _line_evidence(spark, sf_dir)
    scored = E.evidence_scores(items, F.array(F.lit("goods")), F.col("ceiling"), F.col("expected"))
    return E.promoted_source(E.select_evidence(scored, "l_orderkey", "l_linenumber"), "l_orderkey", "source", SOURCES)


def _line_evidence(spark, sf_dir):
    """Line items as evidence for their order: a sentence each, some of which state the order's ceiling as a rule."""
    li, o = dealt(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"], "l_orderkey"), ranking.table(spark, sf_dir, "orders")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("l_suppkey"), F.max("l_returnflag").alias("l_returnflag"))
    asked = o.select(F.col("o_orderkey").alias("l_orderkey"), ((F.col("o_orderkey") % 3 + 1) * 1000).cast("double").alias("ceiling"), F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("expected"))
    amount = F.concat(F.lit("$"), F.format_number((F.col("l_linenumber") % 3 + 1) * 1000, 0))
    said = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Remittance for goods is capped at "), amount, F.lit(" as a limit.")))
    said = said.when(F.col("l_returnflag") == "A", F.concat(F.lit("Goods for "), amount, F.lit(" were sent."))).otherwise("Compliance was not looked at.")
    return li.join(asked, "l_orderkey").select("l_orderkey", "l_linenumber", F.concat(F.lit("src"), (F.col("l_suppkey") % 20).cast("string")).alias("source"), said.alias("snippet"), "ceiling", "expected")


def evidence_reselect(spark, sf_dir):
    """What the strongest item promotes is the primary source of a second selection."""
    items = _line_evidence(spark, sf_dir)
    found = E.reselected(items, "l_orderkey", "l_linenumber", F.array(F.lit("goods")), F.col("ceiling"), "expected", SOURCES)
    return found.select("l_orderkey", "l_linenumber", "rank", "priority", "primary")


def check_evidence(spark, sf_dir):
    items = shared.written(_selected(spark, sf_dir).select("query_id", "doc_id", "source", "snippet", "criteria", F.col("rank").alias("place")), "selected")
    names = F.explode(F.array(*[F.lit(n) for n in TABLE_POLICY.check_routes]))
    checks = ranking.queries_of(spark, sf_dir).select("query_id", names.alias("check"))
    return E.check_evidence(checks, items, "query_id", "doc_id", TABLE_POLICY, place="place").withColumnRenamed("check", "check_name")


def _cited(spark, sf_dir):
    pages = _selected(spark, sf_dir).select("query_id", "source", (F.col("doc_id") % 7 + 1).alias("page"))
    return E.citations(pages, "query_id", "source", "page")


def citation_list(spark, sf_dir):
    return _cited(spark, sf_dir).select("query_id", F.array_join("citations", "; ").alias("citations"))


def citation_validity(spark, sf_dir):
    """The query's own source against the documents of its context."""
    context = blocks(spark, sf_dir, 20).groupBy("query_id").agg(F.collect_set("source").alias("docs"))
    q = ranking.queries_of(spark, sf_dir).join(context, "query_id", "left")
    own = F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    return q.select("query_id", rules.citation_state(own, F.coalesce("docs", F.array().cast("array<string>")), F.col("query_id") % 2).alias("state"))


def citation_coverage(spark, sf_dir):
    """Sources named in citations against those that hold the passage."""
    want = ranking.gold(spark, sf_dir).join(ranking.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("query_id").agg(F.collect_set("source").alias("want"))
    df = ranking.queries_of(spark, sf_dir).join(_cited(spark, sf_dir), "query_id", "left").join(want, "query_id", "left")
    none = F.array().cast("array<string>")
    found = E.cited_sources(F.coalesce("citations", none), tuple(f"{s} (" for s in SOURCES))
    found = F.transform(found, lambda s: F.replace(s, F.lit(" ("), F.lit("")))
    return df.select("query_id", F.size(found).alias("n_cited"), F.round(E.coverage(found, F.coalesce("want", none)), 6).alias("coverage"))


def source_mentions(spark, sf_dir):
    """Parts' names and nations' names that occur in documents' texts, of all of them at once."""
    listed = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).unionByName(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")))
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower(F.substring("source", 1, 20)), " ")).alias("name"))
    frequent = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("name")).where(F.length("name") >= 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return names.occurring(docs, listed.unionByName(words).unionByName(frequent), "doc_id", "text").select("doc_id", "name")


QUERIES = {f.__name__: f for f in (source_mentions, context_score, context_pack, evidence_scores, evidence_select, promoted_source, evidence_reselect, check_evidence, citation_list, citation_validity, citation_coverage)}


def _any(column: str, terms) -> str:
    return "(" + " or ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _count(column: str, terms) -> str:
    return "(" + " + ".join(f"cast(contains({column}, '{t}') as int)" for t in terms) + ")"


def _hits(column: str, array: str) -> str:
    return f"len(list_filter({array}, lambda x: contains({column}, x)))"


_STOP = ", ".join(f"'{w}'" for w in config.QUERY_STOP_WORDS)
_TERMS = f"list_filter(list_distinct(regexp_extract_all(q, '[a-z][a-z0-9_-]{{3,}}')), lambda x: x not in ({_STOP}))"
_PRIORITY = " + ".join(f"case when source in {s + ('',)}" + (f" and {_any('q', t)}" if t else "") + f" then {p} else 0 end" for s, p, t in TABLE_POLICY.source_priority)
_PAIRS = " + ".join(f"case when {_any('q', a)} and {_any('t', b)} then {config.CO_OCCURRENCE_POINTS} else 0 end" for a, b in TABLE_POLICY.co_occurrence)
_RULE_LIST = "[" + ", ".join(f"'{t}'" for t in config.RULE_TERMS) + "]"
_BASE = f"""{ranking._BM25}, bl as (select query_id, doc_id, rank as place, lower(trim(b.text)) as q, d.text, lower(trim(d.text)) as t, d.source from bm join benchmark b on b.item_id = query_id join documents d using (doc_id) where rank <= 50)"""
_SCORED = f"""{_BASE}, cs as (select * from (select *, {_PRIORITY} + 3 * {_hits('t', _TERMS)} + 10 * {_count('t', config.RULE_TERMS)} + {_PAIRS} as score from bl) where score <> 0)"""
_EVIDENCE = f"""{_BASE}, e0 as (select query_id, doc_id, place, source, lower(trim(text[1:{E.SNIPPET_CHARS}])) as s, {_TERMS} as terms from bl where place <= 20),
    e1 as (select *, list_sort(list_filter(terms, lambda x: contains(s, x))) as mt, {_hits('s', _RULE_LIST)} > 0 as mr, contains(s, '5') or contains(s, '5.00') as mc, source = 'src' || (query_id % 20) as ps from e0),
    ev as (select *, case when mc and len(mt) > 0 and mr then 80 else 0 end + case when ps then 20 else 0 end + case when mc then 30 else 0 end + case when len(mt) > 0 then 15 else 0 end + case when mr then 10 else 0 end as priority, mc and len(mt) > 0 and mr as direct from e1 where mc or ps or len(mt) > 0 or mr),
    t8 as (select *, bool_or(direct) over (partition by query_id) as anyd from (select *, row_number() over (partition by query_id order by priority desc, place) as pl from ev qualify pl <= 8)),
    sel as (select *, row_number() over (partition by query_id order by cast(direct as int) desc, pl) as rank from t8 where not anyd or direct or ps)"""
_LINES = """l0 as (select l_orderkey, l_linenumber, max(l_suppkey) as l_suppkey, max(l_returnflag) as l_returnflag from lineitem group by 1, 2), li as (select l_orderkey, l_linenumber, 'src' || (l_suppkey % 20) as source, (l_orderkey % 3 + 1) * 1000 as ceiling, 'src' || (o_custkey % 20) as expected,
    case l_returnflag when 'R' then 'Remittance for goods is capped at $' || format('{:,}', (l_linenumber % 3 + 1) * 1000) || ' as a limit.' when 'A' then 'Goods for $' || format('{:,}', (l_linenumber % 3 + 1) * 1000) || ' were sent.' else 'Compliance was not looked at.' end as snippet
    from l0 join orders on o_orderkey = l_orderkey)"""


def _line_pass(name: str, expected: str, lines: str = "li") -> str:
    """One selection: marks of each line, its points, the eight best, then the direct ones and those of the primary source if any is direct."""
    return f"""{name}0 as (select *, contains(lower(snippet), 'goods') as f, {_any('lower(snippet)', config.RULE_TERMS)} as r, source = {expected} as ps,
        contains(snippet, format('{{:,}}', cast(ceiling as bigint))) or contains(snippet, cast(ceiling as varchar)) as c from {lines}),
    {name}1 as (select *, c and f and r as direct, case when c and f and r then 80 else 0 end + case when ps then 20 else 0 end + case when c then 30 else 0 end + case when f then 15 else 0 end + case when r then 10 else 0 end as priority from {name}0),
    {name}2 as (select *, row_number() over (partition by l_orderkey order by priority desc, l_linenumber) as place from {name}1 where priority > 0 qualify place <= 8),
    {name} as (select *, row_number() over (partition by l_orderkey order by cast(direct as int) desc, place) as rank from (select *, bool_or(direct) over (partition by l_orderkey) as anyd from {name}2) where not anyd or direct or ps)"""


_ROUTES = " union all ".join(f"select '{n}' as check_name, [{', '.join(repr(x) for x in s)}] as docs, [{', '.join(repr(x) for x in t)}] as rt" for n, (s, t) in TABLE_POLICY.check_routes.items())
ORACLE_SQL = {
    "source_mentions": r"""with l as (select distinct name from (select unnest(string_split(lower(p_name), ' ')) as name from part union all select lower(n_name) from nation union all select lower(source) from documents
        union all select unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 5)) from benchmark) where name <> '')
        select doc_id, name from (select doc_id, lower(text) as t from documents) join l on contains(t, name)""",
    "context_score": f"with {_SCORED} select query_id, doc_id, cast(score as integer) as score from cs",
    "context_pack": rf"""with {_SCORED}, f as (select *, row_number() over (partition by query_id, source order by score desc, place) as turn from cs),
        r as (select *, row_number() over (partition by query_id order by case when turn = 1 then 0 else 1 end, score desc, place) as rank from f qualify rank <= 14),
        h as (select *, chr(10) || '--- Ranked Evidence ' || rank || ': ' || source || ' (Retrieved #' || place || ') ---' || chr(10) as header from r),
        b as (select *, 18000 - coalesce(sum(length(header) + length(text) + 1) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) - length(header) as room from h),
        p as (select query_id, doc_id, rank, header || text[1:cast(room as bigint)] || chr(10) as part from b where room > 0)
        select query_id, doc_id, rank, length(part) as n_chars, md5(part) as part_md5 from p""",
    "evidence_scores": f"""with {_EVIDENCE} select query_id, doc_id, priority, array_to_string(list_filter([case when direct then 'direct_threshold_rule_match' end, case when ps then 'primary_source_match' end, case when mc then 'ceiling_value_match' end, case when len(mt) > 0 then 'transaction_fact_match' end, case when mr then 'rule_language_match' end], lambda x: x is not null), ',') as criteria, array_to_string(mt[1:8], ' ') as matched from ev""",
    "evidence_select": f"with {_EVIDENCE} select query_id, doc_id, rank, priority from sel",
    "promoted_source": f"with {_LINES}, {_line_pass('a', 'expected')} select l_orderkey, source as promoted from a where rank = 1 and direct",
    "evidence_reselect": f"""with {_LINES}, {_line_pass('a', 'expected')}, p as (select l_orderkey, source as promoted from a where rank = 1 and direct),
        li2 as (select li.* exclude (expected), coalesce(promoted, expected) as expected from li left join p using (l_orderkey)), {_line_pass('b', 'expected', 'li2')}
        select l_orderkey, l_linenumber, rank, priority, expected as primary from b""",
    "check_evidence": f"""with {_EVIDENCE}, ro as ({_ROUTES}), c as (select query_id, check_name, doc_id, rank as place, 30 + 8 * {_hits('s', 'rt')} + case when direct then 20 else 0 end as points from sel join ro on list_contains(docs, source)),
        k as (select query_id, check_name, doc_id, points, row_number() over (partition by query_id, check_name order by points desc, place) as rank from c qualify rank <= 3)
        select * from k union all select query_id, check_name, doc_id, null, 1 from sel cross join (select check_name from ro) where rank = 1 and (query_id, check_name) not in (select (query_id, check_name) from k)""",
    "citation_list": f"with {_EVIDENCE} select query_id, array_to_string(list_sort(list_distinct(list(source || ' (Page ' || (doc_id % 7 + 1) || ')'))), '; ') as citations from sel group by query_id",
    "citation_validity": f"with {_BASE}, c as (select query_id, list(distinct source) as docs from bl where place <= 20 group by 1) select item_id as query_id, case when coalesce(list_contains(docs, 'src' || (item_id % 20)), false) then 'complete' when item_id % 2 >= 1 then 'breaker' else 'retry' end as state from benchmark left join c on query_id = item_id",
    "citation_coverage": f"""with {_EVIDENCE}, {ranking._GOLD}, f as (select query_id, list(distinct source) as found from sel group by 1), w as (select query_id, list(distinct source) as want from gold join documents using (doc_id) group by 1)
        select item_id as query_id, cast(coalesce(len(found), 0) as integer) as n_cited, round(case when coalesce(len(want), 0) = 0 then 1.0 else coalesce(len(list_intersect(found, want)), 0) / len(want) end, 6) as coverage from benchmark left join f on f.query_id = item_id left join w on w.query_id = item_id""",
}
