"""The registered queries of the corpus operators: each applies its operator to whole tables.

They take (spark, sf_dir) and return the digest columns of their contracts, which they derive
from the operators' own output (texts, spans, files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_text, langid, merkle, minhash, negatives, packing, pii, quality, suffix, tokenfile, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("raw_hash")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_tokens")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_tokens(table(spark, sf_dir, "documents"))
    return tokenfile.read_tokens(spark, manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("row_.page_id", "row_.url", "text", "n_chars")


def quality_model(spark: SparkSession, sf_dir: str) -> dict:
    """Learnt from labelled documents whose crc32(doc_id as text) mod 5 is not 0."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null").where(~langid.in_fold("doc_id", 5, 0))
    return quality.fit(documents.withColumnRenamed("doc_id", "key"), labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("label")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(documents, quality_model(spark, sf_dir)).select("row_.doc_id", "score")
    return scored.select("doc_id", langid.in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains; documents that are clean have no row."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("base_spans", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    everything = F.array_sort(F.concat("base_spans", "added_spans"))
    return found.select("doc_id", *(number(k) for k in pii.KINDS), F.sha2(pii.spans_text(F.col("base_spans")), 256).alias("base_sha256"), pii.spans_text(everything).alias("spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def language_model(documents: DataFrame) -> tuple:
    """Learnt from documents whose crc32(doc_id as text) mod 3 is not 1."""
    learn = documents.where("doc_id is not null").where(~langid.in_fold("doc_id", 3, 1))
    return langid.fit_prototypes(learn.select(F.col("doc_id").alias("key"), "text", "lang"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.predict_language(documents.select("doc_id", "text"), language_model(documents))
    return found.select("row_.doc_id", langid.in_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; where 5 divides the id's checksum, the text is found in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": merkle.lower_ascii(F.col("text"))}, where=tampered)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_token_files, op4_html_text, op5_quality, op6_decontamination, op7_pii, op8_warc, op9_language, op10_minhash, op11_merkle, op12_hard_negatives, op13_suffix)}



def _merkle_oracle(levels: int = 5, tops: int = 3) -> str:
    """Every level of the trees as a common table: up to 16 ** levels rows of a source and 16 ** tops sources."""
    enc = lambda c: f"case when {c} is null then '-' else octet_length(encode({c}::varchar)) || ':' || {c} end"
    leaf = lambda text: "sha256(concat(" + ", ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + "))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(range(length(doc_id::varchar)), lambda i: ascii((doc_id::varchar)[i + 1])::bigint)), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda c, k: {bit})), 4294967295)"

    def climb(n: str, t: str, k: int) -> str:
        side = ("array_to_string(hs[1:t.pos % 16], '')", "array_to_string(hs[t.pos % 16 + 2:], '')")
        return f"""
        r{n}{k} as materialized (select g, pos // 16 as run, list(h order by pos) as hs, any_value(c) > 1 as many from (select *, count(*) over (partition by g) as c from {n}{k}) group by all),
        {n}{k + 1} as materialized (select g, run as pos, case when many then sha256(array_to_string(hs, '')) else hs[1] end as h from r{n}{k}),
        {t}{k + 1} as materialized (select t.* exclude (pos, acc, sib), t.pos // 16 as pos, case when many then sha256({side[0]} || acc || {side[1]}) else acc end as acc, case when many then sib || {side[0]} || {side[1]} else sib end as sib from {t}{k} t join r{n}{k} r on r.g = t.g and r.run = t.pos // 16)"""

    return f"""with d as materialized (select doc_id, coalesce('=' || source, '') as g, {leaf("text")} as h, case when {crc} % 5 = 0 then {leaf(low)} else {leaf("text")} end as found from documents),
    o as materialized (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as pos from d), n0 as (select g, pos, h from o), t0 as (select doc_id, h as leaf, g, pos, found as acc, '' as sib from o),
    {",".join(climb("n", "t", k) for k in range(levels))}, u as materialized (select g as name, h, row_number() over (order by g) - 1 as pos from n{levels}), m0 as (select '' as g, pos, h from u),
    v0 as (select t.doc_id, t.leaf, u.h as subroot, '' as g, u.pos, t.acc, t.sib from t{levels} t join u on u.name = t.g), {",".join(climb("m", "v", k) for k in range(tops))}
    select doc_id, leaf, subroot, m.h as root, sha256(sib) as proof_sha256, acc as folded_root, acc = m.h as verified from v{tops}, (select h from m{tops}) m"""


_TEXT_KEY = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
ORACLE_SQL = {
    "op1_exact_dedup": f"""
        with n as (select doc_id, length(coalesce(text, '')) as chars, {_TEXT_KEY} as t from documents),
        r as (select *, first_value(doc_id) over (partition by t order by chars desc, doc_id) as keep_id, count(*) over (partition by t) as group_size from n)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256, chars as n_chars from r""",
    # the other way round: what the tables' pages have besides an article is taken away by patterns, and what is left is the article
    "op4_html_text": r"""with a as (select page_id, url, regexp_replace(coalesce(html, ''), '(?s)<!DOCTYPE[^>]*>|<head>.*?</head>|<!--.*?-->|<nav>.*?</nav>|<aside>.*?</aside>|<form>.*?</form>|<div class="ad">.*?</div>|<footer>.*?</footer>|</?(?:html|body|article)[^>]*>', '', 'g') as h from pages),
    b as (select page_id, url, list_filter(list_transform(regexp_split_to_array(h, '</?(?:p|h1|br)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') as t from a)
    select page_id, url, array_to_string(t, chr(10)) as text, length(array_to_string(t, chr(10))) as n_chars from b""",
    "op11_merkle": _merkle_oracle(),
    "op12_hard_negatives": """with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
        where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as materialized (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
    p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
    select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::integer as rank, id as negative_id, positive_score, score as negative_score
    from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score qualify rank <= 3""",
    "op8_warc": """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
    d as (select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, cast(i // 8 * 10 + 1 as bigint), 10) as bigint) >> cast(35 - 5 * (i % 8) as integer)) & 31 as bigint) + 1, 1)), '') as payload_digest from p)
    select page_id, payload_bytes, payload_digest, case when page_id = max(page_id) over (partition by h) then 'response' else 'revisit' end as record_type, case when page_id <> max(page_id) over (partition by h) then max(page_id) over (partition by h) end as refers_to from d""",
    "op10_minhash": r"""with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    s as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from w),
    h as materialized (select doc_id, n, hash(x) as h from (select doc_id, len(s) as n, unnest(s) as x from s)),
    met as (select a.doc_id as a, b.doc_id as b, a.n as x, b.n as y, count(*) as common from h a join h b on a.h = b.h and a.doc_id < b.doc_id and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n group by all),
    half as materialized (select a, b from met where 100 * common >= 85 * (x + y - common)),
    links as materialized (select a, b from half union all select b, a from half),
    reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a)
    select doc_id, cast(len(s) as bigint) as n_shingles, c as component_id, doc_id = c as kept from s join (select a as doc_id, min(b) as c from reach group by 1) using (doc_id)""",
}
