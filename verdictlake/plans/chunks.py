"""Queries over documents as text: windows, parents, sections, edges, tables, contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, workflow
from ..sources import tables
from ..sources.tables import spread, table


def child_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.child_windows(spread(spark, sf_dir, "documents"))
    return c.select("doc_id", "window", "start", "n_tokens", F.md5("chunk").alias("chunk_md5"))


def parent_pack(spark, sf_dir):
    p = chunking.parent_pack(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role")
    return p.select("conv_id", "parent", F.col("section").alias("role"), "n_items", "n_tokens", F.md5("content").alias("content_md5"))


def edge_line_repeats(spark, sf_dir):
    return chunking.edge_line_repeats(table(spark, sf_dir, "documents"))


def _short(line):
    """Short lines without inner punctuation stand for headings in the invented prose."""
    return T.is_heading(line) | F.trim(line).rlike(r"^[^.,|]{1,40}\.?$")


def section_segments(spark, sf_dir):
    s = chunking.sections(spread(spark, sf_dir, "documents"), heading=_short)
    return s.select("doc_id", "line_no", F.md5("line").alias("line_md5"), "section")


def headings(spark, sf_dir):
    """Heading and preserved-line tests on titles written from parts, brands and numbers."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    forms = F.array(
        F.concat(F.lit("Section "), k.cast("string"), F.lit(". "), F.col("p_brand")), F.concat(F.lit("item "), k.cast("string"), F.lit("a - "), F.col("p_name")), F.concat(k.cast("string"), F.lit(". The "), F.initcap("p_type")),
        F.concat(F.lit("3.1 list of "), F.col("p_type")), F.concat(F.lit("Annexure "), F.col("p_size").cast("string")), F.concat(F.lit("Amended circular on "), F.col("p_type"), F.lit(" ...")), F.concat(F.lit("Part IV and V: "), F.col("p_brand")),
    )
    one = F.element_at(forms, (k % 7 + 1).cast("int"))
    return p.select("p_partkey", one.alias("line")).select("p_partkey", "line", T.is_heading(F.col("line")).alias("heading"), T.preserved_line(F.col("line")).alias("preserved"), T.line_signature(F.col("line")).alias("signature"))


def table_validity(spark, sf_dir):
    """Tables of cells written from the lines of each order."""
    li = table(spark, sf_dir, "lineitem")
    cells = F.array(F.lit(" ").cast("string"), F.col("l_returnflag"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")))
    rows = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", cells.alias("c")))), lambda r: r["c"]).alias("raw"))
    clean = rows.withColumn("rows", T.clean_cells(F.col("raw")))
    return clean.select("l_orderkey", F.size("rows").alias("n_rows"), T.valid_table(F.col("rows")).alias("valid"), T.table_text(F.col("rows")).alias("text"))


def content_id(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return tables.register_uploads(d.select(F.format_string("%012d", "doc_id").alias("path"), F.col("text").alias("content"), "doc_id")).select("doc_id", "document_id", "idempotent_replay")


def dedupe_first(spark, sf_dir):
    """The first document of each text, in order of id."""
    d = table(spark, sf_dir, "documents").withColumn("k", F.sha2("text", 256))
    return workflow.first_occurrence(d, "k", "doc_id").select("doc_id", F.col("k").alias("text_sha256"))


def source_mode_union(spark, sf_dir):
    """Seeded documents with the ready uploads; the source stands for the mode, the label for the status."""
    d, lb = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seeded = d.where("source in ('src0', 'src1', 'src2')").select("doc_id", "source", F.lit(1).alias("page"))
    status = lb.select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "ready").otherwise("parsing").alias("status"))
    up = d.where("source not in ('src0', 'src1', 'src2')").join(tables.ready(status), F.col("doc_id") == F.col("document_id"), "left_semi").select("doc_id", "source", "lang")
    both = tables.union_sources(seeded, up, True, True)
    return both.groupBy("source_type", "source").agg(F.count(F.lit(1)).alias("n"), F.count("page").alias("n_paged"), F.count("lang").alias("n_lang"))


def token_stats(spark, sf_dir):
    """Tokenisers side by side: Unicode words, terms, tokens that keep their blanks, query terms."""
    d = spread(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select("doc_id", F.size(T.words(t)).alias("n_words"), F.size(T.terms(t)).alias("n_terms"), F.size(T.space_tokens(t)).alias("n_tokens"), F.size(T.query_terms(t)).alias("n_query_terms"), F.length(F.array_join(T.space_tokens(t), "")).alias("n_chars"))


def line_groups(spark, sf_dir):
    """Words laid out on a page by order totals, grouped into lines by their height."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = li.select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") / 2).alias("top"), F.col("l_partkey").alias("x"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("word"))
    return chunking.group_lines(w, "page").select("page", "line", "n_words")


QUERIES = {f.__name__: f for f in (child_windows, parent_pack, edge_line_repeats, section_segments, headings, table_validity, content_id, dedupe_first, source_mode_union, token_stats, line_groups)}

_MINOR = "'a','an','and','as','at','by','for','in','of','on','or','the','to','with'"


def _heading(c: str) -> str:
    named = r"(?i)^(?:item\s+[0-9]+[a-z]?(?:\s*[.:-]\s*[^.]+)?|(?:part|chapter|section)\s*(?:[:-]\s*)?[ivxlcdm0-9]+(?:\s+(?:and|&)\s+[ivxlcdm0-9]+)?(?:\s*[.:-]\s*[^.]+)?|annex(?:ure)?\s*(?:[:-]\s*)?[a-z0-9]+(?:\s*[.:-]\s*[^.]+)?)$"
    numbered = r"^(?:[0-9]+(?:\.[0-9]+)+|[0-9]+[.)])\s+(.+)$"
    words = f"regexp_extract_all(regexp_extract(trim({c}), '{numbered}', 1), '[A-Za-z]+')"
    main = f"list_filter({words}, lambda w: lower(w) not in ({_MINOR}))"
    return f"""(trim({c}) <> '' and length(trim({c})) < 120 and not contains({c}, '...') and (regexp_matches(rtrim(trim({c}), '.'), '{named}')
        or (regexp_matches(trim({c}), '{numbered}') and len({main}) > 0 and len({words}) <= 10 and len(list_filter({main}, lambda w: not regexp_matches(w, '^[A-Z]'))) = 0)))"""


def _signature(c: str) -> str:
    return rf"regexp_replace(regexp_replace(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), 'https?://\S+', '<url>', 'g'), '\b[0-9]+\b', '#', 'g')"


def _preserved(c: str) -> str:
    return rf"(regexp_matches(trim({c}), '(?i)^(?:item|part|chapter|section|annex|annexure|amended|inserted|deleted)\b') or regexp_matches({c}, '(?i)\b(?:circular|with effect from)\b'))"


ORACLE_SQL = {
    "child_windows": r"""with t as (select doc_id, regexp_extract_all(text, '\S+\s*') as t from documents), w as (select doc_id, t, unnest(range(0, len(t), 96)) as start from t where len(t) > 0)
        select doc_id, cast(start // 96 as integer) as "window", cast(start as integer) as start, cast(least(128, len(t) - start) as integer) as n_tokens, md5(array_to_string(t[start + 1 : start + 128], '')) as chunk_md5 from w""",
    "parent_pack": r"""with recursive i as (select conv_id, role, text, len(regexp_extract_all(text, '\S+\s*')) as n, row_number() over (partition by conv_id order by turn) as pos from conversations where coalesce(text, '') <> ''),
        g as (select conv_id, pos, role, n as used, 1 as parent from i where pos = 1
            union all select i.conv_id, i.pos, i.role, case when i.role <> g.role or g.used + i.n > 512 then i.n else g.used + i.n end, g.parent + case when i.role <> g.role or g.used + i.n > 512 then 1 else 0 end from g join i on i.conv_id = g.conv_id and i.pos = g.pos + 1)
        select conv_id, parent, any_value(g.role) as role, count(*) as n_items, cast(sum(n) as bigint) as n_tokens, md5(string_agg(text, chr(10) order by pos)) as content_md5 from g join i using (conv_id, pos) group by conv_id, parent""",
    "edge_line_repeats": f"""with l as (select source, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), e as (select source, doc_id, 'header' as edge, l[1] as line from l union all select source, doc_id, 'footer', l[-1] from l),
        s as (select source, doc_id, edge, {_signature('line')} as signature from e where not {_preserved('line')}), t as (select source, count(distinct doc_id) as total_pages from documents group by 1)
        select s.source, edge, signature, count(distinct doc_id) as n_pages, total_pages from s join t using (source) where signature <> '' group by s.source, edge, signature, total_pages having count(distinct doc_id) >= greatest(3, round_even(total_pages * 0.2, 0))""",
    "section_segments": rf"""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), n as (select doc_id, unnest(range(0, len(l))) as line_no, unnest(l) as line from l),
        h as (select *, case when {_heading('line')} or regexp_matches(trim(line), '^[^.,|]{{1,40}}\.?$') then trim(line) end as head from n where trim(line) <> ''),
        f as (select *, last_value(head ignore nulls) over (partition by doc_id order by line_no) as section from h)
        select doc_id, cast(min(line_no) as integer) as line_no, md5(line) as line_md5, section from f where head is null group by doc_id, line, section""",
    "headings": f"""with p as (select p_partkey, case cast(p_partkey % 7 as integer) when 0 then 'Section ' || p_partkey || '. ' || p_brand when 1 then 'item ' || p_partkey || 'a - ' || p_name when 2 then p_partkey || '. The ' || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
            when 3 then '3.1 list of ' || p_type when 4 then 'Annexure ' || p_size when 5 then 'Amended circular on ' || p_type || ' ...' else 'Part IV and V: ' || p_brand end as line from part)
        select p_partkey, line, {_heading('line')} as heading, {_preserved('line')} as preserved, {_signature('line')} as signature from p""",
    "table_validity": """with r as (select l_orderkey, l_linenumber, l_partkey, ['', trim(l_returnflag), case when l_quantity > 25 then trim(l_linestatus) else '' end] as c from lineitem)
        select l_orderkey, cast(count(*) as integer) as n_rows, count(*) >= 2 and sum(len(list_filter(c, lambda x: x <> ''))) >= 4 as valid, string_agg(array_to_string(c, chr(9)), chr(10) order by l_linenumber, l_partkey, c) as text from r group by l_orderkey""",
    "content_id": "select doc_id, 'doc_' || sha256(text)[1:16] as document_id, row_number() over (partition by text order by doc_id) > 1 as idempotent_replay from documents",
    "dedupe_first": "select min(doc_id) as doc_id, sha256(text) as text_sha256 from documents group by text",
    "source_mode_union": """select 'seeded' as source_type, source, count(*) as n, count(*) as n_paged, 0::bigint as n_lang from documents where source in ('src0', 'src1', 'src2') group by source
        union all select 'uploaded_document', source, count(*), 0, count(lang) from documents where source not in ('src0', 'src1', 'src2') and doc_id in (select doc_id from labels where quality = 1) group by source""",
    "token_stats": r"""select doc_id, cast(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as integer) as n_words, cast(len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}'))) as integer) as n_terms,
        cast(len(regexp_extract_all(text, '\S+\s*')) as integer) as n_tokens, cast(len(list_filter(list_distinct(regexp_extract_all(lower(trim(text)), '[a-z][a-z0-9_-]{3,}')), lambda x: x not in ('with', 'where', 'from', 'into', 'that', 'this', 'than', 'under'))) as integer) as n_query_terms,
        cast(length(array_to_string(regexp_extract_all(text, '\S+\s*'), '')) as integer) as n_chars from documents""",
    "line_groups": """with recursive w as (select l_orderkey as page, l_quantity / 2 as top, row_number() over (partition by l_orderkey order by l_quantity, l_partkey, l_returnflag || l_linenumber) as pos from lineitem),
        g as (select page, pos, top, 1 as line from w where pos = 1 union all select w.page, w.pos, case when abs(w.top - g.top) > 3 then w.top else g.top end, g.line + case when abs(w.top - g.top) > 3 then 1 else 0 end from g join w on w.page = g.page and w.pos = g.pos + 1)
        select page, line, count(*) as n_words from g group by page, line""",
}
