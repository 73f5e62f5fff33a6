"""Queries over the review's records and people: accuracy, look-ups, tables, neighbours' chunks, status changes, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, graph, rules, workflow
from ..sources.tables import table
from ..streaming import ingest
from . import records, requests


def audit_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the requests as golden cases against the facts of those that do not divide by 4, some of them recorded twice."""
    f = requests.facts(spark, sf_dir).join(requests.audit_status(spark, sf_dir), "request_id")
    golden = f.where("request_id % 3 <> 0").select(
        F.col("request_id").alias("id"), F.concat(F.lit("  "), "query", F.lit(" ")).alias("query"), F.when(F.col("request_id") % 5 == 0, "COMPLIANT").otherwise(F.col("status")).alias("status"),
        F.when(F.col("request_id") % 7 == 0, 0.0).otherwise(F.col("transaction_value") + (F.col("request_id") % 2)).alias("value"), F.col("allowed_ceiling").alias("ceiling"), F.lit("Internal Policy").alias("source"),
    )
    once = f.where("request_id % 4 <> 0").select("query", "status", F.col("transaction_value").alias("value"), F.col("allowed_ceiling").alias("ceiling"), F.col("source_doc").alias("source"), F.col("request_id").alias("at"))
    twice = once.where("at % 2 = 1").withColumns({"at": -F.col("at"), "status": F.lit("NONE")})
    return rules.accuracy(golden, once.unionByName(twice))


def reported_status(spark, sf_dir):
    """Status of records from their checks; every third lost its checks and is told from source and amounts, every ninth its source too."""
    a = requests.audited(spark, sf_dir)
    checks = F.when(F.col("request_id") % 3 != 0, F.col("checks"))
    source = F.when(F.col("request_id") % 9 == 0, "N/A").otherwise(F.col("source_doc"))
    return a.select("request_id", rules.reported_status(checks, source, F.col("allowed_ceiling"), F.col("transaction_value")).alias("status"))


def synchronized_checks(spark, sf_dir):
    """The primary source of some requests changes after their checks were made, of some it is lost."""
    a = requests.audited(spark, sf_dir)
    source = F.when(F.col("request_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("request_id") % 5 == 1, "Promoted").otherwise(F.col("source_doc"))
    after = a.select("request_id", F.explode_outer(rules.synchronized(F.col("checks"), source)).alias("c"))
    return after.where("c.name in ('Primary Rule Source', 'Regulatory Overlay')").select("request_id", F.col("c.name").alias("check_name"), F.col("c.actual").alias("actual"), F.col("c.result").alias("result"))


def verdict_read_back(spark, sf_dir):
    """Verdicts as a reader finds them in reports."""
    said = rules.status_of(F.col("checks"))
    shown = F.when(F.col("request_id") % 4 == 0, F.replace(said, F.lit("_"), F.lit("-"))).when(F.col("request_id") % 4 == 1, F.lower(said)).when(F.col("request_id") % 4 == 2, "unclear").otherwise(said)
    return requests.audited(spark, sf_dir).select("request_id", T.verdict_in(F.concat(F.lit("## 1. VERDICT\n**"), shown, F.lit("**"))).alias("verdict"))


def finding_filter(spark, sf_dir):
    """Findings of line items with one that misses evidence, where a returned line stands for direct evidence."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"), F.count(F.lit(1)).alias("n"))
    said = F.array(F.concat(F.lit("There are "), F.col("n").cast("string"), F.lit(" lines.")), F.lit("Lack of evidence for the Primary Rule Source."), F.lit("Human review is needed for the primary rule source"), F.lit("Lack of evidence elsewhere."))
    return li.select("l_orderkey", F.array_join(rules.filtered_findings(said, F.col("flag") == "R"), "|").alias("findings"))


def assignment_records(spark, sf_dir):
    """Assignments with the open order that they are about, if it is open."""
    a = records.assignments(spark, sf_dir)
    r = records.records(spark, sf_dir).where("status = 'O'").select("record_id", "value", "priority")
    return workflow.with_record(a, r, "record_id").select("record_id", "l_linenumber", "assigned_to", F.col("record.value").alias("value"), F.col("record.priority").alias("priority"))


def assignment_resolution(spark, sf_dir):
    """Status and time of resolution after a request to change each assignment."""
    a = records.assignments(spark, sf_dir).withColumnRenamed("state", "status")
    actor = F.when(F.col("l_linenumber") % 3 == 0, F.col("assigned_to")).when(F.col("l_linenumber") % 3 == 1, F.col("assigned_by")).otherwise(-1)
    want = F.when(F.col("flag") == "R", "RESOLVED").otherwise("CLOSED")
    done = workflow.transitioned(a, actor == F.col("assigned_to"), actor == F.col("assigned_by"), want, F.col("created_at") + F.expr("interval 2 days"))
    return done.select("record_id", "l_linenumber", "status", "refused", F.date_format("resolved_at", "yyyy-MM-dd").alias("resolved"))


def user_lookup(spark, sf_dir):
    """Addresses as they were typed in, against those of the customers."""
    address = F.concat(F.lower(F.replace("full_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    users = records.users(spark, sf_dir).withColumn("email", address)
    typed = F.when(F.col("user_id") % 3 == 0, F.upper("email")).when(F.col("user_id") % 3 == 1, F.concat(F.lit(" "), "email")).otherwise(F.concat(F.lit("x"), "email"))
    return workflow.user_by_email(users.select(F.col("user_id").alias("asked"), typed.alias("email")), users).select("asked", "user_id", "role")


def record_page(spark, sf_dir):
    """The fifty records after the first hundred, in order of id."""
    return workflow.row_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 150)


def expired_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", workflow.expired(F.col("ts"), F.lit("2024-01-15").cast("timestamp"), 60 * 24).alias("expired"))


def table_records(spark, sf_dir):
    """Tables written from the lines of each order, as records of the order's supplier."""
    li = table(spark, sf_dir, "lineitem")
    cells = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit(" "), "l_returnflag"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")))
    rows = li.groupBy("l_suppkey", "l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity", "l_linestatus", cells.alias("c")))), lambda r: r["c"]).alias("rows"))
    return chunking.table_records(rows, "l_suppkey", "l_orderkey", "rows")


def uncovered_points(spark, sf_dir):
    """Line items as points on their order's page, without those inside a box of the order."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 30).cast("double").alias("x0"), (F.col("o_orderkey") % 30 + 15).cast("double").alias("x1"), F.lit(0.5).alias("y0"), F.lit(6.5).alias("y1"))
    return chunking.outside_boxes(li, o, "page").groupBy("page").agg(F.count(F.lit(1)).alias("n_points"), F.sum("p").alias("parts"))


def gated_neighbours(spark, sf_dir):
    """Documents of neighbouring nodes that speak of the gate's words and are not in the context yet."""
    nodes = F.concat(F.lit("NATION_"), (F.col("doc_id") % 25).cast("string"))
    chunks = table(spark, sf_dir, "documents").select(nodes.alias("node"), F.col("doc_id").alias("parent_id"), F.coalesce("text", F.lit("")).alias("text"))
    region = table(spark, sf_dir, "region")
    seeds = region.select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("node"))
    e = records.edges(spark, sf_dir).where("relation = 'HOLDS'")
    context = chunks.where("parent_id % 3 = 0").join(region, F.col("parent_id") % 5 == F.col("r_regionkey")).select(F.col("r_regionkey").alias("query_id"), "parent_id")
    return graph.expand_chunks(graph.expand(seeds, e), chunks, context, ("license", "token", "und die")).select("query_id", "parent_id", "node")


def status_update(spark, sf_dir):
    """States of documents after partial changes: each event sets its type and, for purchases, an amount."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    statuses = first.where("user_id % 2 = 0").select(F.col("user_id").alias("document_id"), F.create_map(F.lit("status"), F.lit("received"), F.lit("name"), F.concat(F.lit("d"), F.col("user_id").cast("string"))).alias("state"), F.lit(-1).cast("long").alias("updated_at"))
    change = F.when(F.col("event_type") == "purchase", F.create_map(F.lit("status"), F.lit("ready"), F.lit("by"), F.col("event_id").cast("string"))).otherwise(F.create_map(F.lit("status"), F.col("event_type")))
    after = ingest.updated(statuses, e.select(F.col("user_id").alias("document_id"), change.alias("change"), F.col("event_id").alias("at")))
    get = lambda k: F.try_element_at("state", F.lit(k)).alias(k)
    return after.select("document_id", get("status"), get("name"), get("by"), "updated_at")


def dead_letters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("user_id").alias("document_id"), (F.col("event_id") % 5).cast("int").alias("retry_count"), (F.col("event_type") == "error").alias("failed"), F.lit("ValueError").alias("error"), F.concat(F.lit("line "), F.col("event_id").cast("string")).alias("traceback"))
    sent = ingest.dead_letters(rows).withColumn("m", F.from_json("value", "event struct<event_id:long,document_id:long,retry_count:int>, error string, traceback string"))
    return sent.select("key", "m.event.event_id", "m.event.retry_count", "m.error", "m.traceback")


QUERIES = {f.__name__: f for f in (audit_accuracy, reported_status, synchronized_checks, verdict_read_back, finding_filter, assignment_records, assignment_resolution, user_lookup, record_page, expired_tokens, table_records, uncovered_points, gated_neighbours, status_update, dead_letters)}

_C, _A, _E, _U = requests._CHECKS, records._ASSIGN, records._EDGES, records._USERS
ORACLE_SQL = {
    "audit_accuracy": f"""with {_C}, f as (select facts.*, status from facts join status using (request_id)),
        g as (select request_id as id, trim(query) as q, case when request_id % 5 = 0 then 'COMPLIANT' else status end as status, case when request_id % 7 = 0 then 0 else transaction_value + request_id % 2 end as value, allowed_ceiling as ceiling from f where request_id % 3 <> 0),
        r as (select trim(query) as q, arg_max(status, request_id) as s, arg_max(transaction_value, request_id) as v, arg_max(allowed_ceiling, request_id) as c, arg_max(source_doc, request_id) as d from f where request_id % 4 <> 0 group by 1)
        select id, s is not null as matched, case when s is not null then status = s end as status_ok, case when s is not null then value = 0 or abs(value - v) <= 0.01 end as value_ok, case when s is not null then abs(ceiling - c) <= 0.01 end as ceiling_ok,
        case when s is not null then d = 'Internal Policy' end as source_ok from g left join r using (q)""",
    "reported_status": f"""with {_C} select request_id, case when request_id % 3 <> 0 then status when request_id % 9 = 0 then 'ACTION_REQUIRED' when transaction_value > allowed_ceiling then 'NON_COMPLIANT' else 'COMPLIANT' end as status from status join facts using (request_id)""",
    "synchronized_checks": f"""with {_C} select request_id, check_name, case when check_name = 'Regulatory Overlay' then actual when request_id % 5 = 0 then 'N/A' when request_id % 5 = 1 then 'Promoted' else actual end as actual,
        case when check_name = 'Regulatory Overlay' then result when request_id % 5 = 0 then 'FAIL' else 'PASS' end as result from checks where check_name in ('Primary Rule Source', 'Regulatory Overlay')""",
    "verdict_read_back": f"with {_C} select request_id, case when request_id % 4 = 2 or (request_id % 4 = 0 and status = 'ACTION_REQUIRED') then 'ACTION_REQUIRED' else status end as verdict from status",
    "finding_filter": """select l_orderkey, 'There are ' || count(*) || ' lines.' || case when max(l_returnflag) = 'R' then '' else '|Lack of evidence for the Primary Rule Source.|Human review is needed for the primary rule source' end || '|Lack of evidence elsewhere.' as findings from lineitem group by l_orderkey""",
    "assignment_records": f"with {_A} select record_id, l_linenumber, assigned_to, o_totalprice as value, o_orderpriority as priority from a left join orders on o_orderkey = record_id and o_orderstatus = 'O'",
    "assignment_resolution": f"""with {_A}, x as (select *, case l_linenumber % 3 when 0 then assigned_to when 1 then assigned_by else -1 end as actor, case when flag = 'R' then 'RESOLVED' else 'CLOSED' end as want from a),
        y as (select *, state <> 'CLOSED' and ((actor = assigned_to and want = 'RESOLVED') or (actor = assigned_by and want = 'CLOSED')) as ok from x)
        select record_id, l_linenumber, case when ok then want else state end as status, not ok as refused, case when ok then strftime(created_at + interval 2 days, '%Y-%m-%d') end as resolved from y""",
    "user_lookup": f"with {_U} select user_id as asked, user_id, role from u where is_active and user_id % 3 <> 2",
    "record_page": "select o_orderkey, o_totalprice from orders order by o_orderkey limit 50 offset 100",
    "expired_tokens": "select event_id, ts + interval 1440 minutes < timestamp '2024-01-15' as expired from events",
    "table_records": """with t as (select l_suppkey, l_orderkey, count(*) as n, sum(2 + cast(l_quantity > 25 as int)) as filled, string_agg(l_linenumber || chr(9) || l_returnflag || chr(9) || case when l_quantity > 25 then l_linestatus else '' end, chr(10) order by l_linenumber, l_returnflag, l_quantity, l_linestatus) as text from lineitem group by 1, 2),
        f as (select l_suppkey, text, min(l_orderkey) as l_orderkey from t where n >= 2 and filled >= 4 group by 1, 2)
        select l_suppkey, l_orderkey, cast(row_number() over (partition by l_suppkey order by l_orderkey, text) as integer) as table_index, 'table' as content_type, text from f""",
    "uncovered_points": """select l_orderkey as page, count(*) as n_points, cast(sum(l_partkey) as bigint) as parts from lineitem join orders on o_orderkey = l_orderkey where not (l_quantity between o_orderkey % 30 and o_orderkey % 30 + 15 and l_discount * 100 between 0.5 and 6.5) group by 1""",
    "gated_neighbours": f"""with {_E}, n as (select r_regionkey as query_id, dst as node from region join e on src = r_name where relation = 'HOLDS'), c as (select 'NATION_' || (doc_id % 25) as node, doc_id as parent_id, lower(text) as t from documents)
        select query_id, parent_id, node from n join c using (node) where (contains(t, 'license') or contains(t, 'token') or contains(t, 'und die')) and not (parent_id % 3 = 0 and parent_id % 5 = query_id)""",
    "status_update": """select user_id as document_id, case arg_max(event_type, event_id) when 'purchase' then 'ready' else arg_max(event_type, event_id) end as status, case when user_id % 2 = 0 then 'd' || user_id end as name, cast(max(event_id) filter (event_type = 'purchase') as varchar) as by, max(event_id) as updated_at from events group by user_id""",
    "dead_letters": "select cast(user_id as varchar) as key, event_id, cast(event_id % 5 as integer) as retry_count, 'ValueError' as error, 'line ' || event_id as traceback from events where event_type = 'error' and event_id % 5 >= 3",
}
