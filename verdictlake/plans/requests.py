"""Queries over transaction requests: facts, checks, verdicts. Requests are written from orders, customers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import rules, workflow
from ..sources.tables import spread, table
from .policy import POLICY


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, user_id, created_at, query): a request in words for every order."""
    orders, customer, nation = spread(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    n = F.broadcast(nation.select("n_nationkey", F.initcap(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("place")))
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.concat(F.lit("$"), F.format_number(F.round(F.col("o_totalprice") * 10).cast("long"), 0))
    share = F.concat((F.col("o_orderkey") % 60).cast("string"), F.lit("."), (F.col("o_custkey") % 10).cast("string"), F.lit("%"))
    unit = F.concat(F.lit("from Unit "), F.regexp_replace("place", "[^A-Za-z ]", ""), F.lit("x"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    query = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", say("Remit ", value, " USD ", unit, " to an overseas software vendor for licensing."))
        .when(F.col("c_mktsegment") == "BUILDING", say("Send ", value, " EUR ", unit, " to a newly onboarded wire beneficiary when approved"))
        .when(F.col("c_mktsegment") == "FURNITURE", say("Use ", value, " to acquire equity, ", share, " ownership, of a foreign holding"))
        .when(F.col("c_mktsegment") == "MACHINERY", say("Advance ", value, " to a vendor whose director owns a ", share, " promoter stake"))
        .otherwise(say("Cumulative quarterly remittances have already reached ", value, " USD, pay cloud service fee of $900,000 ", unit, " to an offshore provider"))
    )
    return df.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), query.alias("query"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.request_facts(requests(spark, sf_dir), POLICY)


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.audit_checks(facts(spark, sf_dir), POLICY)


def request_facts(spark, sf_dir):
    return facts(spark, sf_dir).select("request_id", "transaction_value", "allowed_ceiling", "source_doc", "transaction_type", "origin_entity", "destination", "jurisdiction", "currency")


def audit_checks(spark, sf_dir):
    # outer: the optimiser would otherwise push a copy of all rules below the generator, as a filter on the array's size
    return audited(spark, sf_dir).select("request_id", F.inline_outer("checks")).withColumnRenamed("name", "check_name")


def audit_status(spark, sf_dir):
    return rules.audit_status(facts(spark, sf_dir), POLICY).select("request_id", "status")


def status_counts(spark, sf_dir):
    return workflow.status_counts(audit_status(spark, sf_dir), "status", ("COMPLIANT", "NON_COMPLIANT", "ACTION_REQUIRED"))


def findings(spark, sf_dir):
    return audited(spark, sf_dir).select("request_id", F.array_join(rules.findings(F.col("checks")), "\n").alias("findings"))


def recommended_action(spark, sf_dir):
    evidence = F.col("user_id") % 2 == 0
    return audited(spark, sf_dir).select("request_id", rules.recommended_action(F.col("checks"), evidence).alias("action"))


def verdict_report(spark, sf_dir):
    return rules.verdict_report(audited(spark, sf_dir)).select("request_id", "report")


def fingerprint(spark, sf_dir):
    f = facts(spark, sf_dir)
    seal = workflow.fingerprint(("id", F.col("request_id")), ("query", F.col("query")), ("source", F.col("source_doc")))
    return f.select("request_id", seal.alias("sha256"), F.upper(F.left(seal, F.lit(12))).alias("record_id"))


def request_terms(spark, sf_dir):
    """Scalar functions on request texts: terms, money variants, snippets."""
    r = requests(spark, sf_dir)
    q = F.col("query")
    return r.select(
        "request_id", F.array_join(F.array_sort(T.query_terms(q)), " ").alias("query_terms"), F.array_join(F.array_sort(T.split_terms(T.destination(q))), "|").alias("destination_terms"),
        F.array_join(F.array_sort(T.money_terms(F.get(T.amounts(q), 0))), " ").alias("money_terms"), T.snippet(q, 40).alias("snippet"), F.size(T.percents(q)).alias("n_percents"), T.money_after(F.lower(q), config.CUMULATIVE_ANCHORS).alias("cumulative"),
    )


def ceiling_variance(spark, sf_dir):
    """Orders against the ceiling of their customer's segment (twice its mean account balance times 50)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    ceiling = customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal") * 100, 0).alias("ceiling"))
    df = orders.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(ceiling), "c_mktsegment")
    variance = F.round(F.col("o_totalprice") - F.col("ceiling"), 2)
    return df.select("o_orderkey", "ceiling", variance.alias("variance"), F.when(F.col("o_totalprice") > F.col("ceiling"), "FAIL").otherwise("PASS").alias("result"))


def cumulative_exposure(spark, sf_dir):
    """Running total of a customer's orders within a quarter, against a limit."""
    o = table(spark, sf_dir, "orders").withColumn("quarter", F.date_trunc("quarter", "o_orderdate"))
    w = Window.partitionBy("o_custkey", "quarter").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    total = F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w) / 100, 2)
    return o.select("o_orderkey", "o_custkey", F.date_format("quarter", "yyyy-MM-dd").alias("quarter"), total.alias("running_total"), F.when(total > 800_000, "FAIL").otherwise("PASS").alias("result"))


def ownership_limit(spark, sf_dir):
    """Shares written as text, read back and held against the limit."""
    li = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("owns "), F.format_number(F.round(F.col("l_discount") * 100).cast("long"), 0), F.lit(" % and "), F.format_number(F.round(F.col("l_tax") * 100).cast("long"), 0), F.lit("% of it"))
    top = F.array_max(T.percents(text))
    return li.groupBy("l_orderkey").agg(F.max(top).alias("max_share"), F.count(F.lit(1)).alias("n_lines")).withColumn("result", F.when(F.col("max_share") > POLICY.ownership_limit, "FAIL").otherwise("PASS"))


QUERIES = {f.__name__: f for f in (audit_status, request_facts, audit_checks, status_counts, findings, recommended_action, verdict_report, fingerprint, request_terms, ceiling_variance, cumulative_exposure, ownership_limit)}


# The same in SQL, written independently of the operators.
def _like(column: str, terms) -> str:
    return "(" + " or ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _route(column: str, routes, default: str) -> str:
    return "case " + " ".join(f"when {_like(column, t)} then '{n}'" for n, t in routes) + f" else '{default}' end"


_NUMBER = r"\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
_REQUESTS = r"""
r0 as (select o_orderkey, o_custkey, o_orderdate, c_mktsegment as seg, '$' || format('{:,}', cast(round(o_totalprice * 10) as bigint)) as v,
    cast(o_orderkey % 60 as varchar) || '.' || cast(o_custkey % 10 as varchar) || '%' as share,
    'from Unit ' || regexp_replace('Nation ' || split_part(n_name, '_', 2), '[^A-Za-z ]', '', 'g') || 'x' as unit
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
req as (select o_orderkey as request_id, o_custkey as user_id, o_orderdate as created_at, case seg
    when 'AUTOMOBILE' then 'Remit ' || v || ' USD ' || unit || ' to an overseas software vendor for licensing.'
    when 'BUILDING' then 'Send ' || v || ' EUR ' || unit || ' to a newly onboarded wire beneficiary when approved'
    when 'FURNITURE' then 'Use ' || v || ' to acquire equity, ' || share || ' ownership, of a foreign holding'
    when 'MACHINERY' then 'Advance ' || v || ' to a vendor whose director owns a ' || share || ' promoter stake'
    else 'Cumulative quarterly remittances have already reached ' || v || ' USD, pay cloud service fee of $900,000 ' || unit || ' to an offshore provider' end as query from r0)"""
_FACTS = (
    _REQUESTS
    + rf""",
f0 as (select *, lower(trim(query)) as low, regexp_extract(query, '(?i)\bto\s+(?:an?\s+)?([^.,]+?)(?:\s+violates|\s+for|\s+when|$)', 1) as d0, regexp_extract(query, '(?i)\bfrom\s+(Unit\s+[A-Za-z ]+?)\s+to\b', 1) as o0 from req),
facts as (select *, coalesce(try_cast(replace(nullif(regexp_extract(query, '{_NUMBER}', 1), ''), ',', '') as double), 0.0) as transaction_value, 1500000.0::double as allowed_ceiling,
    {_route("low", config.SOURCE_ROUTES, config.DEFAULT_SOURCE)} as source_doc, {_route("low", config.TYPE_ROUTES, config.DEFAULT_TYPE)} as transaction_type,
    case when o0 = '' and regexp_matches(query, '(?i)\bUnit Global\b') then 'Unit Global' when o0 = '' then 'Unit Home' else trim(regexp_replace(o0, '\s+', ' ', 'g')) end as origin_entity,
    case when trim(d0) = '' then 'Unknown counterparty' else lower(d0[1]) || trim(regexp_replace(d0, '\s+', ' ', 'g'))[2:] end as destination,
    case when {_like("low", config.JURISDICTION_TERMS)} then 'Home outbound remittance' else 'Unspecified jurisdiction' end as jurisdiction,
    upper(coalesce(nullif(regexp_extract(query, '(?i)\b(USD|INR|EUR|GBP)\b', 1), ''), 'USD')) as currency from f0)"""
)
_CHECKS = (
    _FACTS
    + rf""",
s0 as (select *, transaction_type as payment_purpose, lower(query || ' ' || transaction_type || ' ' || origin_entity || ' ' || destination || ' ' || jurisdiction || ' ' || transaction_type) as s, origin_entity || ' -> ' || destination as route from facts),
s1 as (select *, coalesce(list_max(list_transform(regexp_extract_all(s, '([0-9]+(?:\.[0-9]+)?)\s*%', 1), lambda x: cast(x as double))), 0) as max_share,
    coalesce(try_cast(replace(coalesce({", ".join(f"nullif(regexp_extract(s, '{a}[^$0-9]{{0,80}}\\$?\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), '')" for a in config.CUMULATIVE_ANCHORS)}), ',', '') as double), 0) as cumulative,
    {_like("s", config.CRYPTO_TERMS)} as crypto, {_like("s", config.KYC_TERMS)} as gap from s0),
checks as (
    select request_id, 1 as n, 'Transactional Exposure' as check_name, '$' || format('{{:,.2f}}', transaction_value) || ' ' || currency as actual, case when transaction_value > allowed_ceiling then 'FAIL' else 'PASS' end as result, transaction_value - allowed_ceiling as variance from s1
    union all select request_id, 2, 'Primary Rule Source', source_doc, 'PASS', null from s1
    union all select request_id, 3, 'Rule Applicability', transaction_type || ' | ' || route || ' | ' || payment_purpose, 'PASS', null from s1
    union all select request_id, 4, 'Cross-Border Classification', route || ' | ' || jurisdiction, case when {_like("s", config.CROSS_BORDER)} then 'PASS' else 'REVIEW' end, null from s1
    union all select request_id, 5, 'KYC / Wire Transfer Evidence', case when gap then 'Beneficiary or originator verification requires review' else 'No explicit evidence gap detected' end, case when gap or crypto then 'REVIEW' else 'PASS' end, null from s1
    union all select request_id, 6, 'Regulatory Overlay', source_doc, 'PASS', null from s1
    union all select request_id, 7, 'Foreign Investment Route', payment_purpose, case when transaction_value > 10000000 or max_share > 40 then 'FAIL' else 'REVIEW' end, null from s1 where {_like("s", config.INVESTMENT_TERMS)}
    union all select request_id, 8, 'Director Exposure Risk', destination, case when max_share > 2.5 and {_like("s", config.INSIDER_TERMS)} and {_like("s", config.CREDIT_TERMS)} then 'FAIL' else 'REVIEW' end, null from s1 where {_like("s", config.DIRECTOR_TERMS)}
    union all select request_id, 9, 'Cumulative Quarterly Exposure', '$' || format('{{:,.2f}}', cumulative + transaction_value) || ' ' || currency || ' including current transaction', case when cumulative + transaction_value > 5000000 then 'FAIL' else 'PASS' end, cumulative + transaction_value - 5000000 from s1 where cumulative <> 0
    union all select request_id, 10, 'Digital Asset Beneficiary Verification', destination, 'REVIEW', null from s1 where crypto),
status as (select request_id, case when bool_or(result = 'FAIL') then 'NON_COMPLIANT' when bool_or(result = 'REVIEW') then 'ACTION_REQUIRED' else 'COMPLIANT' end as status from checks group by request_id),
found as (select request_id, coalesce(string_agg(case result when 'FAIL' then check_name || ' failed: actual value is ' || actual || '.' when 'REVIEW' then check_name || ' remains marked for reviewer confirmation.' end, chr(10) order by n) filter (result <> 'PASS'), 'No deterministic deficiency was identified.') as findings from checks group by request_id)"""
)
_STOP = ", ".join(f"'{w}'" for w in config.QUERY_STOP_WORDS)
ORACLE_SQL = {
    "audit_status": f"with {_CHECKS} select * from status",
    "request_facts": f"with {_FACTS} select request_id, transaction_value, allowed_ceiling, source_doc, transaction_type, origin_entity, destination, jurisdiction, currency from facts",
    "audit_checks": f"with {_CHECKS} select request_id, check_name, actual, result, cast(variance as double) as variance from checks",
    "status_counts": f"with {_CHECKS} select 'ALL' as status, count(*) as n from status union all select k.s, count(status.status) from (values ('COMPLIANT'), ('NON_COMPLIANT'), ('ACTION_REQUIRED')) k(s) left join status on status.status = k.s group by k.s",
    "findings": f"with {_CHECKS} select * from found",
    "recommended_action": f"with {_CHECKS} select request_id, case status when 'NON_COMPLIANT' then 'BLOCK' when 'ACTION_REQUIRED' then 'REQUEST_MORE_EVIDENCE' else case when user_id % 2 = 0 then 'APPROVE' else 'REQUEST_MORE_EVIDENCE' end end as action from status join req using (request_id)",
    "verdict_report": f"""with {_CHECKS}, t as (select request_id, string_agg('| ' || check_name || ' | ' || actual || ' | ' || result || ' |', chr(10) order by n) as lines from checks group by request_id)
        select request_id, '## 1. VERDICT' || chr(10) || '**' || status || '**' || chr(10) || chr(10) || '## 2. FACTS' || chr(10) || '| Field | Value |' || chr(10) || '| :--- | :--- |' || chr(10)
        || '| Transaction Type | ' || transaction_type || ' |' || chr(10) || '| Origin | ' || origin_entity || ' |' || chr(10) || '| Counterparty | ' || destination || ' |' || chr(10) || '| Jurisdiction | ' || jurisdiction || ' |' || chr(10)
        || '| Value | $' || format('{{:,.2f}}', transaction_value) || ' ' || currency || ' |' || chr(10) || '| Ceiling | $' || format('{{:,.2f}}', allowed_ceiling) || ' ' || currency || ' |' || chr(10) || '| Rule Source | ' || source_doc || ' |' || chr(10) || chr(10)
        || '## 3. RATIONALE' || chr(10) || 'The selected rule applies because ' || source_doc || ' governs the ' || transaction_type || ' involving ' || origin_entity || ' and ' || destination || ' for ' || payment_purpose || ' in ' || jurisdiction || '.' || chr(10) || chr(10)
        || '## 4. CHECKS' || chr(10) || '| Check | Actual | Result |' || chr(10) || '| :--- | :--- | :--- |' || chr(10) || lines || chr(10) || chr(10) || '## 5. EVIDENCE' || chr(10) || 'No transaction-specific evidence selected.' || chr(10) || chr(10)
        || '## 6. FINDINGS' || chr(10) || '* ' || replace(findings, chr(10), chr(10) || '* ') || chr(10) || chr(10) || '## 7. ACTION' || chr(10) || '**' || case status when 'NON_COMPLIANT' then 'BLOCK' else 'REQUEST_MORE_EVIDENCE' end || '**' as report
        from s1 join status using (request_id) join t using (request_id) join found using (request_id)""",
    "fingerprint": f"""with {_FACTS}, h as (select request_id, sha256('{{"id":"' || request_id || '","query":"' || query || '","source":"' || source_doc || '"}}') as sha256 from facts) select request_id, sha256, upper(sha256[1:12]) as record_id from h""",
    "request_terms": rf"""with {_FACTS}, a as (select *, transaction_value as v, replace(lower(destination), '-', ' ') as dn from facts)
        select request_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(low, '[a-z][a-z0-9_-]{{3,}}')), lambda x: x not in ({_STOP}))), ' ') as query_terms,
        array_to_string(list_sort(list_distinct(list_concat([lower(destination)], list_filter(regexp_split_to_array(dn, '\s+'), lambda x: length(x) >= 4)))), '|') as destination_terms,
        case when v > 0 then array_to_string(list_sort(list_distinct([cast(cast(floor(v) as bigint) as varchar), format('{{:,}}', cast(floor(v) as bigint)), format('{{:,.0f}}', v), format('{{:,.2f}}', v)])), ' ') else '' end as money_terms,
        case when length(query) > 40 then query[1:37] || '...' else query end as snippet, cast(len(regexp_extract_all(query, '([0-9]+(?:\.[0-9]+)?)\s*%', 1)) as integer) as n_percents,
        coalesce(try_cast(replace(coalesce({", ".join(f"nullif(regexp_extract(low, '{a}[^$0-9]{{0,80}}\\$?\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), '')" for a in config.CUMULATIVE_ANCHORS)}), ',', '') as double), 0) as cumulative from a""",
    "ceiling_variance": "with c as (select c_mktsegment, round(avg(c_acctbal) * 100, 0) as ceiling from customer group by 1) select o_orderkey, ceiling, round(o_totalprice - ceiling, 2) as variance, case when o_totalprice > ceiling then 'FAIL' else 'PASS' end as result from orders join customer on o_custkey = c_custkey join c using (c_mktsegment)",
    "cumulative_exposure": "with t as (select o_orderkey, o_custkey, date_trunc('quarter', o_orderdate) as q, round(cast(sum(cast(round(o_totalprice * 100) as bigint)) over (partition by o_custkey, date_trunc('quarter', o_orderdate) order by o_orderdate, o_orderkey rows unbounded preceding) as double) / 100, 2) as running_total from orders) select o_orderkey, o_custkey, strftime(q, '%Y-%m-%d') as quarter, running_total, case when running_total > 800000 then 'FAIL' else 'PASS' end as result from t",
    "ownership_limit": "select l_orderkey, max(greatest(round(l_discount * 100), round(l_tax * 100)))::double as max_share, count(*) as n_lines, case when max(greatest(round(l_discount * 100), round(l_tax * 100))) > 2.5 then 'FAIL' else 'PASS' end as result from lineitem group by l_orderkey",
}
