"""Queries over records, users, assignments, events and the relationship graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, workflow
from ..sources import tables
from ..sources.tables import table
from ..streaming import ingest


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users: segment stands for the role, a balance that is not negative for an active account."""
    role = F.when(F.col("c_mktsegment") == "BUILDING", "l2_analyst").when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("l1_analyst")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"), role.alias("role"), (F.col("c_acctbal") >= 0).alias("is_active"))


def records(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def assignments(spark, sf_dir) -> DataFrame:
    """Line items as assignments of an order from its customer to another user."""
    li, n = table(spark, sf_dir, "lineitem"), F.lit(97)
    state = F.when(F.col("l_linestatus") == "F", "CLOSED").otherwise("OPEN")
    out = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("created_at"), F.max("l_partkey").alias("p"), F.max(state).alias("state"), F.max("l_returnflag").alias("flag"))
    return out.join(records(spark, sf_dir).select("record_id", F.col("user_id").alias("assigned_by")), F.col("l_orderkey") == F.col("record_id")).select("record_id", "l_linenumber", "assigned_by", F.pmod(F.col("p"), n).alias("assigned_to"), "created_at", "state", "flag")


def history(spark, sf_dir):
    return workflow.history(records(spark, sf_dir), "user_id", "created_at", 5, "record_id").select("user_id", "record_id", "place")


def analysts(spark, sf_dir):
    """Active second-line users by name."""
    u = users(spark, sf_dir).where("role = 'l2_analyst' and is_active")
    return u.orderBy("full_name").select("user_id", "full_name")


def inbox(spark, sf_dir):
    """Open assignments of each active user with the record that they are about, latest first."""
    a = workflow.visible_to(assignments(spark, sf_dir), users(spark, sf_dir), "assigned_to", ("l2_analyst", "admin", "l1_analyst")).where("state = 'OPEN'")
    w = Window.partitionBy("assigned_to").orderBy(F.desc("created_at"), "record_id", "l_linenumber")
    return a.join(records(spark, sf_dir).select("record_id", "value"), "record_id").select("assigned_to", "record_id", "l_linenumber", "value", F.row_number().over(w).alias("place"))


def outbox(spark, sf_dir):
    """What second-line users assigned, latest first."""
    a = workflow.visible_to(assignments(spark, sf_dir), users(spark, sf_dir), "assigned_by", ("l2_analyst",))
    w = Window.partitionBy("assigned_by").orderBy(F.desc("created_at"), "record_id", "l_linenumber")
    return a.select("assigned_by", "record_id", "l_linenumber", F.row_number().over(w).alias("place"))


def assignment_transition(spark, sf_dir):
    """A request per assignment to resolve or close it, by its assignee, its assigner or a stranger."""
    a = assignments(spark, sf_dir)
    actor = F.when(F.col("l_linenumber") % 3 == 0, F.col("assigned_to")).when(F.col("l_linenumber") % 3 == 1, F.col("assigned_by")).otherwise(-1)
    want = F.when(F.col("flag") == "R", "RESOLVED").otherwise("CLOSED")
    new = workflow.transition(actor == F.col("assigned_to"), actor == F.col("assigned_by"), F.col("state"), want)
    return a.select("record_id", "l_linenumber", F.coalesce(new, F.lit("REFUSED")).alias("outcome"))


def _event_rows(spark, sf_dir):
    return table(spark, sf_dir, "events")


def upsert_latest(spark, sf_dir):
    e = _event_rows(spark, sf_dir)
    return workflow.latest(e, "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


def seed_merge(spark, sf_dir):
    """Purchases replace what views left per user; missing fields get defaults."""
    e = _event_rows(spark, sf_dir)
    one = lambda kind: workflow.latest(e.where(F.col("event_type") == kind), "user_id", F.desc("event_id"))
    seed = one("view").select("user_id", F.lit("").alias("state"), "event_id")
    new = one("purchase").select("user_id", F.when(F.col("event_id") % 2 == 0, "NON_COMPLIANT").alias("state"), "event_id", "value")
    merged = workflow.ensure_columns(workflow.upsert(seed, new, "user_id"), {"note": F.lit("none")})
    return merged.select("user_id", "event_id", workflow.resolved_status(F.col("state"), F.lit(None)).alias("status"), F.coalesce("value", F.lit(0.0)).alias("value"), "note")


def resume_antijoin(spark, sf_dir):
    """Events that no later success of their user covers."""
    e = _event_rows(spark, sf_dir)
    done = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("upto")).select("user_id", "upto", F.col("upto").isNotNull().alias("success"))
    left = e.join(done, "user_id", "left").where("upto is null or event_id > upto")
    return left.select("event_id", "user_id")


def golden_accuracy(spark, sf_dir):
    """Labels against what a document's length says, over all documents: matched counts and rates."""
    d, lb = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    both = d.join(lb, "doc_id", "left").withColumn("guess", (F.col("n_chars") > 300).cast("int"))
    hit = F.col("guess") == F.col("quality")
    near = F.abs(F.col("n_chars") - F.length("text")) <= 0.01
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n_cases"), F.count("quality").alias("n_matched"), F.coalesce(F.round(F.avg(hit.cast("int")), 6), F.lit(0.0)).alias("status_accuracy"), F.round(F.avg(near.cast("int")), 6).alias("length_accuracy"), T.percent(F.coalesce(F.avg(hit.cast("int")), F.lit(0.0))).alias("shown"))


def json_tolerant(spark, sf_dir):
    """Properties as maps; every seventh event's text is broken and falls back."""
    e = _event_rows(spark, sf_dir).withColumn("j", F.when(F.col("event_id") % 7 == 0, F.left("props", F.lit(4))).otherwise(F.col("props")))
    m = e.withColumn("m", tables.tolerant_map("j"))
    return m.select("event_id", F.size("m").alias("n_keys"), F.try_element_at("m", F.lit("k")).try_cast("int").alias("k"), F.to_json(F.map_filter("m", lambda k, v: v.isNotNull())).alias("json"))


def normalize_records(spark, sf_dir):
    r = records(spark, sf_dir)
    ceiling = F.when(F.col("priority") != "5-LOW", F.lit(250_000.0))
    status = F.when(F.col("status") == "F", "NON_COMPLIANT").when(F.col("status") == "P", "ACTION_REQUIRED").otherwise("COMPLIANT")
    return r.select("record_id", status.alias("status"), F.round(F.col("value") - ceiling, 2).alias("delta"), T.money(ceiling, F.lit("USD")).alias("ceiling"), F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("created_at"))


#: Least mean of a metric that passes.
LEAST_MEAN = {"quality": 0.80, "clean": 0.75}


def judge_summary(spark, sf_dir):
    """Scores and latency per metric over successes only, with a band by the metric's own least mean."""
    lb = table(spark, sf_dir, "labels")
    m = F.create_map(F.lit("quality"), F.col("quality"), F.lit("clean"), 1 - F.col("toxic"))
    rows = lb.select("doc_id", F.explode(m).alias("metric", "score")).withColumns({"ok": F.col("doc_id") % 5 != 0, "latency": F.col("doc_id") % 97})
    mean = F.round(F.avg(F.when(F.col("ok"), F.col("score"))), 6)
    least = F.create_map(*[F.lit(x) for kv in LEAST_MEAN.items() for x in kv])[F.col("metric")]
    latency = F.round(F.avg(F.when(F.col("ok"), F.col("latency"))), 6)
    return rows.groupBy("metric").agg(F.count_if("ok").alias("n_success"), mean.alias("mean"), latency.alias("mean_latency")).withColumn("band", F.when(F.col("mean") >= least, "PASS").otherwise("REVIEW"))


def latency_p95(spark, sf_dir):
    """Nearest-rank 95th percentile of event values per type."""
    return _event_rows(spark, sf_dir).groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.count(F.lit(1)).alias("n"))


def _ingest_events(spark, sf_dir):
    return _event_rows(spark, sf_dir).select("event_id", "ts", F.col("user_id").alias("document_id"), "event_type", (F.col("event_type") == "error").alias("failed"))


def ingest_status(spark, sf_dir):
    return ingest.latest_status(_ingest_events(spark, sf_dir))


def retry_dlq(spark, sf_dir):
    return ingest.retries(_ingest_events(spark, sf_dir))


def event_windows(spark, sf_dir):
    return ingest.windowed_counts(_ingest_events(spark, sf_dir)).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


# The relationship graph: regions hold nations, nations hold customers and suppliers.
def edges(spark, sf_dir) -> DataFrame:
    region, nation, customer, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    none = F.create_map().cast("map<string,string>")
    one = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"), F.lit("HOLDS").alias("relation"), F.create_map(F.lit("code"), F.col("n_nationkey").cast("string")).alias("attrs"))
    member = lambda t, key, name, rel: t.join(nation, F.col(key) == F.col("n_nationkey")).select(F.col("n_name").alias("src"), F.col(name).alias("dst"), F.lit(rel).alias("relation"), none.alias("attrs"))
    return one.unionByName(member(customer, "c_nationkey", "c_name", "SERVES")).unionByName(member(supplier, "s_nationkey", "s_name", "SOURCES_FROM"))


def _seeds(spark, sf_dir):
    """Each supplier asks about its nation."""
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("query_id"), F.col("n_name").alias("node"))


def graph_expand(spark, sf_dir):
    return graph.expand_counts(_seeds(spark, sf_dir), edges(spark, sf_dir), ("NATION_3",))


def lineage_text(spark, sf_dir):
    e = edges(spark, sf_dir).where("relation = 'HOLDS'")
    seeds = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("node"))
    x = graph.expand(seeds, e)
    return graph.lineage(x).join(graph.constraints(x, e), "query_id")


def shortest_paths(spark, sf_dir):
    roots = table(spark, sf_dir, "region").select(F.col("r_name").alias("root"))
    return graph.shortest_paths(edges(spark, sf_dir), roots)


def topology(spark, sf_dir):
    """Edges between focus nodes (regions and nations with suppliers), with the kinds of their ends."""
    e = edges(spark, sf_dir)
    focus = _seeds(spark, sf_dir).select("node").union(table(spark, sf_dir, "region").select("r_name"))
    kind = lambda c: graph.node_kind(c, "ASIA", ("EUROPE", "AFRICA"), ("NATION_0",))
    return graph.focus_edges(e, focus).select("src", "dst", "relation", kind("src").alias("src_kind"), kind("dst").alias("dst_kind"))


def uploaded_nodes(spark, sf_dir):
    """Sources of documents that no mapping names."""
    mapping = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), (F.col("n_nationkey") * 2).cast("string")).alias("source"))
    return graph.unmapped(table(spark, sf_dir, "documents"), mapping, "source")


QUERIES = {f.__name__: f for f in (history, analysts, inbox, outbox, assignment_transition, upsert_latest, seed_merge, resume_antijoin, golden_accuracy, json_tolerant, normalize_records, judge_summary, latency_p95, ingest_status, retry_dlq, event_windows, graph_expand, lineage_text, shortest_paths, topology, uploaded_nodes)}

_USERS = "u as (select c_custkey as user_id, c_name as full_name, case c_mktsegment when 'BUILDING' then 'l2_analyst' when 'MACHINERY' then 'admin' else 'l1_analyst' end as role, c_acctbal >= 0 as is_active from customer)"
_ASSIGN = """a as (select o_orderkey as record_id, l_linenumber, o_custkey as assigned_by, max(l_partkey) % 97 as assigned_to, max(l_shipdate) as created_at, max(case when l_linestatus = 'F' then 'CLOSED' else 'OPEN' end) as state, max(l_returnflag) as flag from lineitem join orders on l_orderkey = o_orderkey group by all)"""
_EDGES = """e as (select r_name as src, n_name as dst, 'HOLDS' as relation, cast(n_nationkey as varchar) as code from nation join region on n_regionkey = r_regionkey
    union all select n_name, c_name, 'SERVES', null from customer join nation on c_nationkey = n_nationkey union all select n_name, s_name, 'SOURCES_FROM', null from supplier join nation on s_nationkey = n_nationkey)"""
ORACLE_SQL = {
    "history": "select o_custkey as user_id, o_orderkey as record_id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as place from orders qualify place <= 5",
    "analysts": f"with {_USERS} select user_id, full_name from u where role = 'l2_analyst' and is_active",
    "inbox": f"with {_USERS}, {_ASSIGN} select assigned_to, record_id, l_linenumber, o_totalprice as value, row_number() over (partition by assigned_to order by created_at desc, record_id, l_linenumber) as place from a join orders on o_orderkey = record_id where state = 'OPEN' and assigned_to in (select user_id from u where is_active)",
    "outbox": f"with {_USERS}, {_ASSIGN} select assigned_by, record_id, l_linenumber, row_number() over (partition by assigned_by order by created_at desc, record_id, l_linenumber) as place from a where assigned_by in (select user_id from u where is_active and role = 'l2_analyst')",
    "assignment_transition": f"""with {_ASSIGN}, x as (select *, case l_linenumber % 3 when 0 then assigned_to when 1 then assigned_by else -1 end as actor, case when flag = 'R' then 'RESOLVED' else 'CLOSED' end as want from a)
        select record_id, l_linenumber, case when state <> 'CLOSED' and ((actor = assigned_to and want = 'RESOLVED') or (actor = assigned_by and want = 'CLOSED')) then want else 'REFUSED' end as outcome from x""",
    "upsert_latest": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "seed_merge": """with s as (select user_id, max(event_id) as event_id from events where event_type = 'view' group by 1), n as (select user_id, event_id, case when event_id % 2 = 0 then 'NON_COMPLIANT' end as state, value from events where event_type = 'purchase' qualify row_number() over (partition by user_id order by event_id desc) = 1)
        select user_id, event_id, coalesce(state, 'COMPLIANT') as status, value, 'none' as note from n union all select user_id, event_id, 'COMPLIANT', 0.0, 'none' from s where user_id not in (select user_id from n)""",
    "resume_antijoin": "with d as (select user_id, max(event_id) as upto from events where event_type = 'purchase' group by 1) select event_id, user_id from events left join d using (user_id) where upto is null or event_id > upto",
    "golden_accuracy": """select lang, count(*) as n_cases, count(quality) as n_matched, coalesce(round(avg(cast(cast(n_chars > 300 as int) = quality as int)), 6), 0) as status_accuracy, round(avg(cast(abs(n_chars - length(text)) <= 0.01 as int)), 6) as length_accuracy,
        format('{:.1f}%', coalesce(avg(cast(cast(n_chars > 300 as int) = quality as int)), 0) * 100) as shown from documents left join labels using (doc_id) group by lang""",
    "json_tolerant": """select event_id, case when event_id % 7 = 0 then 0 else cast(len(json_keys(props)) as integer) end as n_keys, case when event_id % 7 = 0 then null else cast(json_extract_string(props, '$.k') as integer) end as k,
        case when event_id % 7 = 0 then '{}' else '{"k":"' || json_extract_string(props, '$.k') || '"}' end as json from events""",
    "normalize_records": """select o_orderkey as record_id, case o_orderstatus when 'F' then 'NON_COMPLIANT' when 'P' then 'ACTION_REQUIRED' else 'COMPLIANT' end as status, case when o_orderpriority <> '5-LOW' then round(o_totalprice - 250000.0, 2) end as delta,
        case when o_orderpriority <> '5-LOW' then '$250,000.00 USD' else 'UNRESOLVED USD' end as ceiling, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as created_at from orders""",
    "judge_summary": """with m as (select doc_id, 'quality' as metric, quality as score from labels union all select doc_id, 'clean', 1 - toxic from labels)
        select metric, count(*) filter (doc_id % 5 <> 0) as n_success, round(avg(score) filter (doc_id % 5 <> 0), 6) as mean, round(avg(doc_id % 97) filter (doc_id % 5 <> 0), 6) as mean_latency,
        case when round(avg(score) filter (doc_id % 5 <> 0), 6) >= case metric when 'quality' then 0.80 else 0.75 end then 'PASS' else 'REVIEW' end as band from m group by metric""",
    "latency_p95": "select event_type, quantile_disc(value, 0.95) as p95, count(*) as n from events group by event_type",
    "ingest_status": """select user_id as document_id, arg_max(case event_type when 'signup' then 'received' when 'view' then 'parsing' when 'click' then 'indexing' when 'purchase' then 'ready' when 'error' then 'failed' else 'quarantined' end, event_id) as status, max(event_id) as event_id, count(*) as n_events from events group by user_id""",
    "retry_dlq": "select user_id as document_id, event_id, row_number() over (partition by user_id order by event_id) as attempt, case when row_number() over (partition by user_id order by event_id) <= 3 then 'retry' else 'dead_letter' end as outcome from events where event_type = 'error'",
    "event_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, count(*) as n, cast(sum(cast(event_type = 'error' as int)) as bigint) as n_failed from events group by all",
    "graph_expand": f"""with {_EDGES}, s as (select s_suppkey as query_id, n_name as node from supplier join nation on s_nationkey = n_nationkey), k as (select * from e where src <> 'NATION_3' and dst <> 'NATION_3'),
        x as (select query_id, 'out' as direction, relation, dst as neighbour from s join k on node = src union all select query_id, 'in', relation, src from s join k on node = dst) select query_id, direction, relation, count(*) as n, max(neighbour) as last_neighbour from x group by all""",
    "lineage_text": f"""with {_EDGES}, h as (select r_regionkey as query_id, e.*, row_number() over (partition by r_regionkey order by dst) as i from e join region on r_name = src where relation = 'HOLDS')
        select query_id, string_agg('- ' || src || ' --(' || relation || ')--> ' || dst, chr(10) order by dst) as lineage, string_agg(i || ') ' || src || '->' || dst || ' [code: ' || code || ']', chr(10) order by i) as constraints from h group by query_id""",
    "shortest_paths": f"""with recursive {_EDGES}, p as (select r_name as root, r_name as node, 0 as hops from region union select root, dst, hops + 1 from p join e on node = src where hops < 64) select root, node, min(hops) as hops from p group by root, node""",
    "topology": f"""with {_EDGES}, f as (select n_name as node from supplier join nation on s_nationkey = n_nationkey union select r_name from region), k as (select *, lambda_kind.* from e, (select 1) lambda_kind)
        select src, dst, relation, case when src = 'ASIA' then 'TRANSACTION' when src = 'NATION_0' then 'WARNING' when src in ('EUROPE', 'AFRICA') then 'POLICY' else 'CORPORATE_ENTITY' end as src_kind,
        case when dst = 'ASIA' then 'TRANSACTION' when dst = 'NATION_0' then 'WARNING' when dst in ('EUROPE', 'AFRICA') then 'POLICY' else 'CORPORATE_ENTITY' end as dst_kind from e where src in (select node from f) and dst in (select node from f)""",
    "uploaded_nodes": "select distinct source from documents where source is not null and source not in (select 'src' || (n_nationkey * 2) from nation)",
}
ORACLE_SQL["topology"] = ORACLE_SQL["topology"].replace(", k as (select *, lambda_kind.* from e, (select 1) lambda_kind)", "")
