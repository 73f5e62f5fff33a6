"""Queries over repairs and transport: cleaned facts, reconciled amounts, page regions, merged maps, event routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, rules, workflow
from ..sources import shared, tables
from ..sources.tables import table
from ..streaming import ingest
from . import requests


def fact_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the counterparties are amounts or currencies and are read again."""
    f = requests.facts(spark, sf_dir)
    broken = F.when(F.col("request_id") % 3 == 0, "USD").when(F.col("request_id") % 3 == 1, "$1,250.00").otherwise(F.col("destination"))
    return rules.cleaned_facts(f.withColumn("destination", broken).withColumn("currency", F.lower("currency"))).select("request_id", "destination", "currency")


def reconciliation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderpriority") == "5-LOW", "pending").otherwise(F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0)))
    rows = o.select("o_orderkey", value.alias("value"), F.lit("250,000").alias("ceiling"), F.lit("COMPLIANT").alias("status"))
    return rules.reconciled(rows, "value", "ceiling", "status").select("o_orderkey", "reported_status", "value_shown", "ceiling_shown", "variance_shown")


def page_regions(spark, sf_dir):
    """Lines laid out from line items: ship mode letters repeat at the edges of an order's pages."""
    li = tables.dealt(spark, sf_dir, "lineitem", ["l_suppkey", "l_orderkey", "l_returnflag", "l_linestatus"], "l_suppkey", "l_orderkey")
    li = li.groupBy("l_suppkey", "l_orderkey").agg(F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"))
    pages = li.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("page"), F.lit(100.0).alias("height"))
    line = lambda y, text: F.struct(F.lit(y).alias("y0"), F.lit(y + 5.0).alias("y1"), text.alias("text"))
    made = F.array(line(2.0, F.concat(F.lit("Report "), F.col("f"), F.lit(" page "), F.col("l_orderkey").cast("string"))), line(50.0, F.lit("body")), line(93.0, F.concat(F.lit("Foot "), F.col("s"), F.lit("-"), F.col("f"))))
    lines = li.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("page"), F.inline(made))
    return chunking.page_regions(lines, pages, parts=tables.parts_of(spark, sf_dir, "lineitem"))


def status_merge(spark, sf_dir):
    """A user's first event as a status map, merged with the last one's."""
    e = table(spark, sf_dir, "events")
    one = e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("a"), F.max_by("event_type", "event_id").alias("b"), F.max("event_id").alias("n"))
    old = F.create_map(F.lit("status"), F.col("a"), F.lit("first"), F.col("a"))
    new = F.create_map(F.lit("status"), F.col("b"), F.lit("last_id"), F.col("n").cast("string"))
    m = workflow.merged(old, new)
    return one.select("user_id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",").alias("state"))


def event_routing(spark, sf_dir):
    """Events to the wire and back, then to what follows them."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(t) for t in (*ingest.TOPICS, "audit.requested")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = e.select(F.col("event_id").cast("string").alias("event_id"), kind.alias("event_type"), F.col("user_id").cast("string").alias("document_id"), F.col("ts").alias("produced_at"), (F.col("event_id") % 5).cast("int").alias("retry_count"))
    back = ingest.decoded(ingest.encoded(rows))
    routed = ingest.next_events(back.withColumn("failed", F.col("event_id").cast("long") % 3 == 0))
    return routed.select("event_id", F.coalesce("problem", F.lit("none")).alias("problem"), "next", "next_retry")


def new_assignments(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    asked = li.select(F.col("l_orderkey").alias("record_id"), F.col("l_suppkey").alias("assigned_by"), (F.col("l_partkey") % 11).alias("assigned_to"))
    made = workflow.new_assignments(asked, F.lit("2024-01-01").cast("timestamp"))
    return made.select("record_id", "assigned_by", "assigned_to", "assignment_id", "action_type", "status")


def merge_sink_status(spark, sf_dir):
    """Each user's last event, from batches that reach the sink out of order, some of them twice."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), "event_id", F.col("event_type").alias("status"))
    path = shared.new_path(spark, "merged")
    sink = ingest.merge_sink(path)
    for number, part in enumerate((2, 0, 0, 1, 2)):
        sink(e.where(F.pmod("event_id", F.lit(3)) == part), number)
    sink(e, 4)  # a number that is committed already
    return ingest.merged_table(spark, path, e.schema)


def tolerant_props(spark, sf_dir):
    """A number inside the events' properties, as they are, nested, as a text, as another kind, cut off, or missing."""
    e = table(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k")
    kind = (F.col("event_id") % 7).cast("int")
    written = F.get(F.array(
        F.col("props"), F.concat(F.lit('{"a": {"b": [{"k": '), n, F.lit("}]}}")), F.concat(F.lit('{"k": "'), n, F.lit('"}')), F.lit('{"k": [1, 2]}'), F.expr("left(props, length(props) - 1)"), F.lit('{"k": null}'), F.lit(None).cast("string"),
    ), kind)
    rows = e.select("event_id", written.alias("p"))
    return rows.select("event_id", tables.tolerant_field(F.col("p"), "$.k", "bigint", -1).alias("k"), tables.tolerant_field(F.col("p"), "$.a.b[0].k", "bigint", -2).alias("nested"), tables.tolerant_field(F.col("p"), "$.k", "string", "none").alias("text"))


QUERIES = {f.__name__: f for f in (fact_cleanup, reconciliation, page_regions, status_merge, event_routing, new_assignments, merge_sink_status, tolerant_props)}
ORACLE_SQL = {
    "merge_sink_status": "select user_id as document_id, max(event_id) as event_id, arg_max(event_type, event_id) as status from events group by user_id",
    "tolerant_props": """with n as (select event_id, event_id % 7 as f, json_extract_string(props, '$.k') as n from events)
        select event_id, case when f in (0, 2) then n::bigint else -1 end as k, case when f = 1 then n::bigint else -2 end as nested, case when f in (0, 2) then n when f = 3 then '[1,2]' else 'none' end as text from n""",
    "fact_cleanup": f"with {requests._FACTS} select request_id, destination, currency from facts",
    "reconciliation": """with v as (select o_orderkey, case when o_orderpriority <> '5-LOW' then floor(o_totalprice) end as v from orders)
        select o_orderkey, case when v is null then 'ACTION_REQUIRED' else 'COMPLIANT' end as reported_status, coalesce('$' || format('{:,.2f}', v) || ' USD', 'UNRESOLVED USD') as value_shown, '$250,000.00 USD' as ceiling_shown, coalesce('$' || format('{:,.2f}', v - 250000) || ' USD', 'UNRESOLVED USD') as variance_shown from v""",
    "page_regions": """with p as (select l_suppkey as file, l_orderkey as page, max(l_returnflag) as f, max(l_linestatus) as s from lineitem group by 1, 2), t as (select file, greatest(3, round_even(count(distinct page) * 0.2, 0)) as least from p group by 1),
        h as (select file, f from p group by 1, 2 having count(distinct page) >= (select least from t where t.file = p.file)), g as (select file, f, s from p group by 1, 2, 3 having count(distinct page) >= (select least from t where t.file = p.file))
        select p.file, p.page, case when h.f is not null then 9.0 else 0.0 end::double as top, case when g.f is not null then 91.0 else 100.0 end::double as bottom from p left join h on h.file = p.file and h.f = p.f left join g on g.file = p.file and g.f = p.f and g.s = p.s""",
    "status_merge": "select user_id, 'first=' || arg_min(event_type, event_id) || ',last_id=' || max(event_id) || ',status=' || arg_max(event_type, event_id) as state from events group by user_id",
    "event_routing": """select cast(event_id as varchar) as event_id, case when event_id % 4 = 3 then 'unsupported' else 'none' end as problem,
        case when event_id % 3 = 0 and event_id % 5 < 3 then case cast(event_id % 4 as integer) when 0 then 'document.ingested' when 1 then 'document.parsed' when 2 then 'embedding.created' else 'audit.requested' end
        when event_id % 3 = 0 then 'dead_letter' else case cast(event_id % 4 as integer) when 0 then 'document.parsed' when 1 then 'embedding.created' else 'done' end end as next, cast(case when event_id % 3 = 0 then event_id % 5 + 1 else 0 end as integer) as next_retry from events""",
    "new_assignments": "select distinct l_orderkey as record_id, l_suppkey as assigned_by, l_partkey % 11 as assigned_to, sha256(l_orderkey || '|' || l_suppkey || '|' || (l_partkey % 11))[1:16] as assignment_id, 'REQUEST_EVIDENCE' as action_type, 'OPEN' as status from lineitem",
}
