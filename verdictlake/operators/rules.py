"""Requests to facts, facts to checks, checks to a status: one select each, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import Policy
from ..functions import text as T


def request_facts(requests: DataFrame, policy: Policy, query: str = "query") -> DataFrame:
    """``requests`` with the facts that rules need, read from the request's text.

    The first number of the text is the transaction value, 0 if there is none; the ceiling is the policy's.
    """
    df = T.evaluated(requests, {"q_": F.coalesce(F.col(query), F.lit(""))})
    df = T.evaluated(df, {"low_": T.normalized(F.col("q_"))})
    q, low = F.col("q_"), F.col("low_")
    abroad = T.contains_any(low, config.JURISDICTION_TERMS)
    facts = {
        "transaction_value": F.coalesce(T.first_amount(q), F.lit(0.0)),
        "allowed_ceiling": F.lit(policy.ceiling),
        "source_doc": T.first_route(low, config.SOURCE_ROUTES, config.DEFAULT_SOURCE),
        "transaction_type": T.first_route(low, config.TYPE_ROUTES, config.DEFAULT_TYPE),
        "origin_entity": T.origin(q, policy.group, policy.units),
        "destination": T.destination(q),
        "jurisdiction": F.when(abroad, f"{policy.country} outbound remittance").otherwise("Unspecified jurisdiction"),
        "currency": T.currency(q, policy.currency),
    }
    return T.evaluated(df, facts).withColumn("payment_purpose", F.col("transaction_type")).drop("q_", "low_")


def scenario(query: Column) -> Column:
    """Text that the rules look at: the request and its extracted facts, in lower case."""
    parts = [query, *(F.col(c) for c in ("transaction_type", "origin_entity", "destination", "jurisdiction", "payment_purpose"))]
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


#: Names of the checks in their order; the last four are made only where the scenario asks for them.
CHECKS = tuple(config.CHECK_ROUTES)


def _verdict(bad: Column, yes: str, no: str) -> Column:
    return F.when(bad, yes).otherwise(no)


def _measured(facts: DataFrame, query: str) -> DataFrame:
    """``facts`` with the scenario and what the checks measure in it."""
    df = T.evaluated(facts, {"scenario": scenario(F.col(query))})
    s = F.col("scenario")
    has = lambda terms: T.contains_any(s, terms)
    share = F.when(F.contains(s, F.lit("%")), F.coalesce(F.array_max(T.percents(s)), F.lit(0.0))).otherwise(0.0)
    total = F.when(has(config.CUMULATIVE_ANCHORS), T.money_after(s, config.CUMULATIVE_ANCHORS)).otherwise(0.0)
    insider = has(config.INSIDER_TERMS) & has(config.CREDIT_TERMS)
    marks = {
        "max_share": share, "cumulative": total, "abroad": has(config.CROSS_BORDER), "gap": has(config.KYC_TERMS), "crypto": has(config.CRYPTO_TERMS), "foreign": has(config.INVESTMENT_TERMS),
        "lending": has(config.DIRECTOR_TERMS), "insider": insider, "unknown": F.coalesce(F.col("source_doc"), F.lit("")).isin("", "N/A"),
    }
    return T.evaluated(df, {"m": F.struct(*[c.alias(k) for k, c in marks.items()])})


def _results(policy: Policy, rules: str | None) -> dict[str, Column]:
    """Result of each check, null where it is not made; reads columns of :func:`_measured`."""
    m, value = F.col("m"), F.col("transaction_value")
    wide = (value > policy.investment_value_limit) | (m["max_share"] > policy.investment_ownership_limit)
    conflict = (m["max_share"] > policy.ownership_limit) & m["insider"]
    found = (
        _verdict(value > F.col("allowed_ceiling"), "FAIL", "PASS"),
        _verdict(m["unknown"], "FAIL", "PASS"),
        _verdict(F.size(rules) > 0, "PASS", "REVIEW") if rules else F.lit("PASS"),
        _verdict(m["abroad"], "PASS", "REVIEW"),
        _verdict(m["gap"] | m["crypto"], "REVIEW", "PASS"),
        _verdict(m["unknown"], "REVIEW", "PASS"),
        F.when(m["foreign"], _verdict(wide, "FAIL", "REVIEW")),
        F.when(m["lending"], _verdict(conflict, "FAIL", "REVIEW")),
        F.when(m["cumulative"] != 0, _verdict(m["cumulative"] + value > policy.cumulative_limit, "FAIL", "PASS")),
        F.when(m["crypto"], "REVIEW"),
    )
    return dict(zip(CHECKS, found, strict=True))


def audit_status(facts: DataFrame, policy: Policy, query: str = "query", rules: str | None = None) -> DataFrame:
    """``facts`` with ``status``, from the checks' results alone: none of their texts is written."""
    results = list(_results(policy, rules).values())
    any_ = lambda r: F.coalesce(reduce(lambda a, b: a | b, [c.eqNullSafe(F.lit(r)) for c in results]), F.lit(False))
    return _measured(facts, query).withColumn("status", F.when(any_("FAIL"), "NON_COMPLIANT").when(any_("REVIEW"), "ACTION_REQUIRED").otherwise("COMPLIANT")).drop("m", "scenario")


def audit_checks(facts: DataFrame, policy: Policy, query: str = "query", rules: str | None = None) -> DataFrame:
    """``facts`` with ``checks``: an array of (name, actual, result, variance), six base checks and up to four that the scenario asks for.

    ``rules`` names an array column of applicable rules; without it one rule is taken to apply.
    """
    df = T.evaluated(_measured(facts, query), {"r": F.struct(*[c.alias(k) for k, c in _results(policy, rules).items()])})
    m, value, unit = F.col("m"), F.col("transaction_value"), F.col("currency")
    source = F.when(m["unknown"], "N/A").otherwise(F.col("source_doc"))
    total, route = m["cumulative"] + value, F.concat(F.col("origin_entity"), F.lit(" -> "), F.col("destination"))
    actual = dict(zip(CHECKS, (
        T.money(value, unit), source, F.concat_ws(" | ", "transaction_type", route, "payment_purpose"), F.concat_ws(" | ", route, "jurisdiction"),
        _verdict(m["gap"], "Beneficiary or originator verification requires review", "No explicit evidence gap detected"), source, F.col("payment_purpose"), F.col("destination"),
        F.concat(T.money(total, unit), F.lit(" including current transaction")), F.col("destination"),
    ), strict=True))
    variance = {"Transactional Exposure": value - F.col("allowed_ceiling"), "Cumulative Quarterly Exposure": total - policy.cumulative_limit}
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(k).alias("name"), actual[k].alias("actual"), F.col("r")[k].alias("result"), variance.get(k, none).alias("variance")) for k in CHECKS]
    made = F.array_compact(F.array(*[F.when(F.col("r")[k].isNotNull(), row) for k, row in zip(CHECKS, rows, strict=True)]))
    return T.evaluated(df, {"checks": made}).drop("m", "r")


def status_of(checks: Column) -> Column:
    """Any FAIL: NON_COMPLIANT; else any REVIEW: ACTION_REQUIRED; else COMPLIANT."""
    any_ = lambda r: F.exists(checks, lambda c: c["result"] == r)
    return F.when(any_("FAIL"), "NON_COMPLIANT").when(any_("REVIEW"), "ACTION_REQUIRED").otherwise("COMPLIANT")


def reported_status(checks: Column, source: Column, ceiling: Column, value: Column) -> Column:
    """Status of a record: from its checks; without checks from source and amounts."""
    bare = F.when(F.coalesce(source, F.lit("N/A")) == "N/A", "ACTION_REQUIRED").when((ceiling > 0) & (value > ceiling), "NON_COMPLIANT").otherwise("COMPLIANT")
    return F.when(F.coalesce(F.size(checks), F.lit(0)) > 0, status_of(checks)).otherwise(bare)


def findings(checks: Column) -> Column:
    """A sentence for each check that failed or needs review; a default one if there is none."""
    bad = F.filter(checks, lambda c: c["result"].isin("FAIL", "REVIEW"))
    said = F.transform(bad, lambda c: F.when(c["result"] == "FAIL", F.concat(c["name"], F.lit(" failed: actual value is "), c["actual"], F.lit("."))).otherwise(F.concat(c["name"], F.lit(" remains marked for reviewer confirmation."))))
    return F.when(F.size(bad) == 0, F.array(F.lit("No deterministic deficiency was identified."))).otherwise(said)


def filtered_findings(said: Column, has_direct: Column) -> Column:
    """Findings without those that miss evidence for the primary source, where an item states the rule directly."""
    text = lambda f: T.normalized(f)
    moot = lambda f: F.contains(text(f), F.lit("primary rule source")) & (F.contains(text(f), F.lit("lack of evidence")) | F.contains(text(f), F.lit("human review is needed")))
    return F.when(has_direct, F.filter(said, lambda f: ~moot(f))).otherwise(said)


def recommended_action(checks: Column, has_evidence: Column) -> Column:
    any_ = lambda r: F.exists(checks, lambda c: c["result"] == r)
    return F.when(any_("FAIL"), "BLOCK").when(any_("REVIEW") | ~has_evidence, "REQUEST_MORE_EVIDENCE").otherwise("APPROVE")


def reasoning() -> Column:
    return F.concat(
        F.lit("The selected rule applies because "), F.col("source_doc"), F.lit(" governs the "), F.col("transaction_type"), F.lit(" involving "), F.col("origin_entity"),
        F.lit(" and "), F.col("destination"), F.lit(" for "), F.col("payment_purpose"), F.lit(" in "), F.col("jurisdiction"), F.lit("."),
    )


def verdict_report(audited: DataFrame, evidence: str | None = None) -> DataFrame:
    """``audited`` (with checks) and ``report``: the verdict in seven markdown sections."""
    status = status_of(F.col("checks"))
    row = lambda k, v: F.concat(F.lit(f"| {k} | "), v, F.lit(" |"))
    facts = F.concat_ws(
        "\n", F.lit("| Field | Value |"), F.lit("| :--- | :--- |"), row("Transaction Type", F.col("transaction_type")), row("Origin", F.col("origin_entity")), row("Counterparty", F.col("destination")),
        row("Jurisdiction", F.col("jurisdiction")), row("Value", T.money(F.col("transaction_value"), F.col("currency"))), row("Ceiling", T.money(F.col("allowed_ceiling"), F.col("currency"))), row("Rule Source", F.col("source_doc")),
    )
    checks = F.array_join(F.transform("checks", lambda c: F.concat(F.lit("| "), c["name"], F.lit(" | "), c["actual"], F.lit(" | "), c["result"], F.lit(" |"))), "\n")
    trail = F.coalesce(F.nullif(F.array_join(evidence, "\n"), F.lit("")), F.lit("No transaction-specific evidence selected.")) if evidence else F.lit("No transaction-specific evidence selected.")
    problems = F.array_join(F.transform(findings(F.col("checks")), lambda f: F.concat(F.lit("* "), f)), "\n")
    has_evidence = F.size(evidence) > 0 if evidence else F.lit(False)
    sections = [("1. VERDICT", F.concat(F.lit("**"), status, F.lit("**"))), ("2. FACTS", facts), ("3. RATIONALE", reasoning()), ("4. CHECKS", F.concat(F.lit("| Check | Actual | Result |\n| :--- | :--- | :--- |\n"), checks)), ("5. EVIDENCE", trail), ("6. FINDINGS", problems), ("7. ACTION", F.concat(F.lit("**"), recommended_action(F.col("checks"), has_evidence), F.lit("**")))]
    return audited.withColumn("report", F.concat_ws("\n\n", *[F.concat(F.lit(f"## {h}\n"), b) for h, b in sections]))


def synchronized(checks: Column, source: Column) -> Column:
    """Checks after the primary source changed: its own check follows."""
    known = F.coalesce(source, F.lit("N/A")) != "N/A"
    return F.transform(checks, lambda c: F.when(c["name"] == "Primary Rule Source", F.struct(c["name"].alias("name"), F.coalesce(source, F.lit("N/A")).alias("actual"), F.when(known, "PASS").otherwise("FAIL").alias("result"), c["variance"].alias("variance"))).otherwise(c))


def citation_state(source: Column, context_sources: Column, retries: Column) -> Column:
    """complete if the source is among the context's documents; else retry once, then the breaker trips."""
    return F.when(F.array_contains(context_sources, F.coalesce(source, F.lit("N/A"))), "complete").when(retries >= 1, "breaker").otherwise("retry")


def cleaned_facts(facts: DataFrame, query: str = "query", destination: str = "destination", currency: str = "currency") -> DataFrame:
    """Repairs facts that extraction confuses: a counterparty that is an amount or a currency is read from the text again; currencies are upper-case."""
    again = T.destination(F.coalesce(F.col(query), F.lit("")))
    return facts.withColumns({destination: F.when(T.currency_or_amount(F.col(destination)), again).otherwise(F.col(destination)), currency: F.upper(currency)})


def reconciled(records: DataFrame, value: str, ceiling: str, status: str, unit: str = "USD") -> DataFrame:
    """``records`` (amounts as text) with numbers, shown amounts and a status that asks for action where an amount is no number."""
    number = lambda c: F.replace(F.replace(F.col(c), F.lit("$"), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    df = T.evaluated(records, {"value_number": number(value), "ceiling_number": number(ceiling)})
    known = F.col("value_number").isNotNull() & F.col("ceiling_number").isNotNull()
    shown = lambda c: T.money(F.col(c), F.lit(unit))
    return df.withColumns({"reported_status": F.when(known, F.col(status)).otherwise("ACTION_REQUIRED"), "value_shown": shown("value_number"), "ceiling_shown": shown("ceiling_number"), "variance_shown": T.money(F.col("value_number") - F.col("ceiling_number"), F.lit(unit))})


def accuracy(golden: DataFrame, records: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Golden cases (id, query, status, value, ceiling, source) against records (query, status, value, ceiling, source, at) of the same trimmed text.

    Of records with the same text the last counts. One row per case: id, matched, and whether status, value, ceiling and source agree (null where
    no record matches). An expected value of 0 agrees with any.
    """
    last = records.withColumn("text_", F.trim("query")).groupBy("text_").agg(F.max_by(F.struct("status", "value", "ceiling", "source"), "at").alias("r"))
    both = golden.withColumn("text_", F.trim("query")).join(last, "text_", "left")
    r, near = F.col("r"), lambda a, b: F.abs(a - b) <= tolerance
    same = {"status_ok": F.col("status") == r["status"], "value_ok": (F.col("value") == 0) | near(F.col("value"), r["value"]), "ceiling_ok": near(F.col("ceiling"), r["ceiling"]), "source_ok": F.col("source").eqNullSafe(r["source"])}
    return both.select("id", r.isNotNull().alias("matched"), *[F.when(r.isNotNull(), F.coalesce(c, F.lit(False))).alias(k) for k, c in same.items()])
