"""Scoring context blocks, packing them into a budget, selecting and routing evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..config import Policy
from ..functions import text as T

# Budget of a packed context and lengths of lists.
MAX_BLOCKS, MAX_CHARS = 14, 18_000
MAX_EVIDENCE, MAX_PER_CHECK, SNIPPET_CHARS = 8, 3, 600


def source_priority(source: Column, query: Column, policy: Policy) -> Column:
    """Points of a source for a request."""
    out = F.lit(0)
    for names, points, terms in policy.source_priority:
        hit = source.isin(list(names))
        out = out + F.when(hit & T.contains_any(query, terms) if terms else hit, points).otherwise(0)
    return out


def context_score(blocks: DataFrame, policy: Policy, query: str = "query", text: str = "text", source: str = "source") -> DataFrame:
    """``blocks`` (a row per query and block) with ``score``; rows that score 0 are left out."""
    q, t = T.normalized(F.col(query)), T.normalized(F.col(text))
    spelled = F.array_distinct(F.flatten(F.transform(T.amounts(q), T.money_terms)))
    hits = lambda terms: F.size(F.filter(terms, lambda x: F.contains(F.col("t_"), x)))
    pair = lambda p: F.when(T.contains_any(F.col("q_"), p[0]) & T.contains_any(F.col("t_"), p[1]), config.CO_OCCURRENCE_POINTS).otherwise(0)
    df = T.evaluated(blocks, {"q_": q, "t_": t, "terms_": T.query_terms(q), "money_": spelled})
    score = source_priority(F.col(source), F.col("q_"), policy) + 3 * hits("terms_") + 12 * hits("money_") + 10 * T.count_terms(F.col("t_"), config.RULE_TERMS)
    score = reduce(lambda a, p: a + pair(p), policy.co_occurrence, score)
    return T.evaluated(df, {"score": score}).where("score <> 0").drop("q_", "t_", "terms_", "money_")


def diverse_top(scored: DataFrame, query_id: str, source: str, index: str, k: int = MAX_BLOCKS) -> DataFrame:
    """The best block of each source first, then the rest by score: ``rank`` 1..k per query."""
    by_source = Window.partitionBy(query_id, source).orderBy(F.desc("score"), F.asc(index))
    first = scored.withColumn("turn", F.row_number().over(by_source))
    order = Window.partitionBy(query_id).orderBy(F.asc(F.when(F.col("turn") == 1, 0).otherwise(1)), F.desc("score"), F.asc(index))
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("turn")


def pack_budget(ranked: DataFrame, query_id: str, text: str, header: Column, max_chars: int = MAX_CHARS) -> DataFrame:
    """Blocks in order of rank while the budget lasts: the last is cut to what is left; headers count."""
    before = Window.partitionBy(query_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    df = ranked.withColumn("header_", header).withColumn("full_", F.length("header_") + F.length(text) + 1)
    left = F.lit(max_chars) - F.coalesce(F.sum("full_").over(before), F.lit(0)) - F.length("header_")
    df = df.withColumn("left_", left).where("left_ > 0")
    return df.withColumn("part", F.concat("header_", F.left(text, F.col("left_").cast("int")), F.lit("\n"))).drop("header_", "full_", "left_")


def evidence_scores(items: DataFrame, terms: Column, ceiling: Column, expected_source: Column, snippet: str = "snippet", source: str = "source") -> DataFrame:
    """``items`` with priority and criteria; items without any are left out. ``terms``: transaction terms (array)."""
    s = T.normalized(F.col(snippet))
    rule = F.array(*[F.lit(t) for t in config.RULE_TERMS])
    df = T.evaluated(items, {"s_": s, "fact_terms": terms, "ceiling_terms": T.money_terms(ceiling)})
    df = T.evaluated(df, {"matched_transaction": T.matched_terms(F.col("s_"), F.col("fact_terms")), "matched_rule": T.matched_terms(F.col("s_"), rule), "matched_ceiling": T.matched_terms(F.col("s_"), F.col("ceiling_terms"))})
    has = lambda c: F.size(c) > 0
    tests = {
        "direct_threshold_rule_match": has("matched_ceiling") & has("matched_transaction") & has("matched_rule"),
        "primary_source_match": F.coalesce(F.col(source) == expected_source, F.lit(False)),
        "ceiling_value_match": has("matched_ceiling"),
        "transaction_fact_match": has("matched_transaction"),
        "rule_language_match": has("matched_rule"),
    }
    points = reduce(lambda a, kv: a + F.when(kv[1], config.EVIDENCE_WEIGHTS[kv[0]]).otherwise(0), tests.items(), F.lit(0))
    criteria = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    slim = {c: F.slice(c, 1, 8) for c in ("matched_transaction", "matched_rule")}
    return T.evaluated(df, {"priority": points, "criteria": criteria}).where("priority > 0").withColumns(slim).drop("s_", "fact_terms", "ceiling_terms")


def select_evidence(scored: DataFrame, request: str, index: str, k: int = MAX_EVIDENCE) -> DataFrame:
    """The best ``k`` items of each request; if one states the rule directly, only direct ones and then those of the primary source."""
    w = Window.partitionBy(request).orderBy(F.desc("priority"), F.asc(index))
    top = scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    direct = F.array_contains("criteria", "direct_threshold_rule_match")
    top = top.withColumn("direct", direct).withColumn("any_direct", F.max("direct").over(Window.partitionBy(request)))
    kept = top.where(~F.col("any_direct") | F.col("direct") | F.array_contains("criteria", "primary_source_match"))
    order = Window.partitionBy(request).orderBy(F.desc(F.col("direct").cast("int")), F.asc("place"))
    return kept.withColumn("rank", F.row_number().over(order)).drop("place", "any_direct")


def promoted_source(selected: DataFrame, request: str, source: str, known: tuple) -> DataFrame:
    """(request, promoted): the source of the strongest item if that states the rule directly."""
    return selected.where((F.col("rank") == 1) & F.col("direct") & F.col(source).isin(list(known))).select(request, F.col(source).alias("promoted"))


def reselected(items: DataFrame, request: str, index: str, terms: Column, ceiling: Column, expected: str, known: tuple, snippet: str = "snippet", source: str = "source", k: int = MAX_EVIDENCE) -> DataFrame:
    """Evidence selected twice: what the first pass promotes is the primary source of the second, which adds ``primary``."""
    choose = lambda df, column: select_evidence(evidence_scores(df, terms, ceiling, F.col(column), snippet, source), request, index, k)
    promoted = promoted_source(choose(items, expected), request, source, known)
    again = items.join(promoted, request, "left").withColumn("primary", F.coalesce("promoted", expected)).drop("promoted")
    return choose(again, "primary")


def check_evidence(checks: DataFrame, items: DataFrame, request: str, index: str, policy: Policy, source: str = "source", snippet: str = "snippet", place: str | None = None, k: int = MAX_PER_CHECK) -> DataFrame:
    """(request, check, item, points, rank): the best items of each check by its route; a check that has none gets the request's first item.

    ``place`` names the items' order (their index, if there is no other). The fallback has no points. A check of a request without items has no row.
    """
    spark, place = checks.sparkSession, place or index
    routes = F.broadcast(spark.createDataFrame([(n, list(s), list(t)) for n, (s, t) in policy.check_routes.items()], "check string, docs array<string>, route_terms array<string>"))
    asked = checks.select(request, "check").distinct()
    both = asked.join(routes, "check").join(items, request).where(F.array_contains(F.col("docs"), F.col(source)))
    hits = F.size(F.filter("route_terms", lambda t: F.contains(F.col("s_"), t)))
    direct = F.when(F.array_contains("criteria", "direct_threshold_rule_match"), 20).otherwise(0)
    scored = both.withColumn("s_", T.normalized(F.col(snippet))).withColumn("points", 30 + 8 * hits + direct)
    w = Window.partitionBy(request, "check").orderBy(F.desc("points"), F.asc(place), F.asc(index))
    routed = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(request, "check", index, "points", "rank")
    first = items.groupBy(request).agg(F.min(F.struct(F.col(place).alias("p"), F.col(index).alias("i")))["i"].alias(index))
    bare = asked.join(routed.select(request, "check").distinct(), [request, "check"], "left_anti").join(first, request)
    return routed.unionByName(bare.select(request, "check", index, F.lit(None).cast("int").alias("points"), F.lit(1).alias("rank")))


def citations(evidence: DataFrame, request: str, source: str, page: str) -> DataFrame:
    """(request, citations): distinct "source (Page n)", sorted."""
    return evidence.groupBy(request).agg(F.array_sort(F.collect_set(F.concat(F.col(source), F.lit(" (Page "), F.col(page).cast("string"), F.lit(")")))).alias("citations"))


def cited_sources(citations_: Column, known: tuple) -> Column:
    """Those known sources that are a substring of a citation."""
    return F.filter(F.array(*[F.lit(k) for k in known]), lambda k: F.exists(citations_, lambda c: F.contains(c, k)))


def coverage(found: Column, expected: Column) -> Column:
    """Share of the expected that was found; 1 if nothing is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(found, expected)) / F.size(expected))
