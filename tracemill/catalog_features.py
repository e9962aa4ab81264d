"""Queries of request features and blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as X
from .operators import blocking as B
from .operators.components import components
from .operators.requests import REQUESTS_SQL, TEXT_SQL, canonical_requests, request_text
from .queries import query, table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    r = canonical_requests(table(spark, folder, "attack_view"), "messages")
    return r.select("request_id", "ms", "bucket", F.lower(request_text(F.col("messages"))).alias("text"))


_T = f"{REQUESTS_SQL}, t as (select request_id, ms, bucket, lower({TEXT_SQL}) as text from req)"


@query("q_request_text", f"with {_T} select request_id, length(text) as n_chars, md5(text) as digest from t")
def _text(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("request_id", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "q_bounded_text",
    f"with {_T} select request_id, length(b) as n_chars, md5(b) as digest from (select request_id, case when length(text) <= 2000 then text else left(text, 1000) || chr(10) || '[...middle omitted for feature budget...]' || chr(10) || right(text, 1000) end as b from t)",
)
def _bounded(spark: SparkSession, folder: str) -> DataFrame:
    b = X.bounded_text(F.col("text"), 2000)
    return _texts(spark, folder).select("request_id", F.char_length(b).cast("long").alias("n_chars"), F.md5(b).alias("digest"))


def _family(name: str, column, sql: str) -> None:
    @query(name, f"with {_T}, v as (select request_id, unnest(list_distinct({sql})) as value from t) select request_id, count(*) as n_values, min(value) as first_value, max(value) as last_value from v group by request_id")
    def _run(spark: SparkSession, folder: str) -> DataFrame:
        each = _texts(spark, folder).select("request_id", F.explode(column(F.col("text"))).alias("value"))
        return each.groupBy("request_id").agg(F.count("*").alias("n_values"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))


_family("q_paths", X.paths, r"regexp_extract_all(text, '/(?:home|srv|opt|workspace|tmp)/[A-Za-z0-9_./-]+')")
_family("q_domains", X.domains, r"regexp_extract_all(text, '\b(?:[a-z0-9-]+\.)+(?:internal|local|prod|corp)\b')")
_family("q_repositories", X.repositories, r"""list_distinct(flatten([list_transform(regexp_extract_all(text, 'repository=[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]*[A-Za-z0-9_]'), lambda m: 'repo_full:' || substring(m, 12)),
 list_transform(regexp_extract_all(text, 'repository=[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]*[A-Za-z0-9_]'), lambda m: 'repo_owner:' || split_part(substring(m, 12), '/', 1)),
 list_transform(regexp_extract_all(text, 'repository=[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]*[A-Za-z0-9_]'), lambda m: 'repo_name:' || split_part(substring(m, 12), '/', 2)),
 list_transform(list_filter(regexp_extract_all(text, '/workspace/([^/\s]+)', 1), lambda s: contains(regexp_replace(s, '[^A-Za-z0-9_.-].*', ''), '__')), lambda s: 'repo_full:' || split_part(regexp_replace(s, '[^A-Za-z0-9_.-].*', ''), '__', 1) || '/' || substring(regexp_replace(s, '[^A-Za-z0-9_.-].*', ''), length(split_part(regexp_replace(s, '[^A-Za-z0-9_.-].*', ''), '__', 1)) + 3)),
 list_transform(list_filter(regexp_extract_all(text, '/workspace/([^/\s]+)', 1), lambda s: contains(regexp_replace(s, '[^A-Za-z0-9_.-].*', ''), '__')), lambda s: 'repo_owner:' || split_part(regexp_replace(s, '[^A-Za-z0-9_.-].*', ''), '__', 1)),
 list_transform(list_filter(regexp_extract_all(text, '/workspace/([^/\s]+)', 1), lambda s: contains(regexp_replace(s, '[^A-Za-z0-9_.-].*', ''), '__')), lambda s: 'repo_name:' || substring(regexp_replace(s, '[^A-Za-z0-9_.-].*', ''), length(split_part(regexp_replace(s, '[^A-Za-z0-9_.-].*', ''), '__', 1)) + 3))]))""")
_family("q_business_keys", X.business_keys, r"""list_concat(list_transform(regexp_extract_all(text, '\b(?:order|reservation|product)[_-][a-z][a-z0-9]*\d{2}-(?:airline|retail)-[a-z]+(?:-[a-z]+)*-\d+\b'), lambda m: 'business_project:' || regexp_replace(m, '^(order|reservation|product)[_-]', '\1:')), flatten(list_transform(list_filter(list_transform(regexp_extract_all(text, '\b(?:tenant|customer_ref|account_cache|case_id|queue|service_line|internal_domain|loyalty_tier|region)=[A-Za-z0-9_.:/@-]+'), lambda m: {'k': split_part(m, '=', 1), 'v': trim(substring(m, length(split_part(m, '=', 1)) + 2), '._-/:@;,''"`()[]{}')}), lambda p: length(p.v) between 3 and 120),
 lambda p: list_filter([case when p.k in ('customer_ref','account_cache') then 'business_user:' || p.k || ':' || p.v end, case when p.k in ('queue','internal_domain') then 'business_project:' || p.k || ':' || p.v end, case when p.k in ('internal_domain','tenant') then 'business_org:' || p.k || ':' || p.v end], lambda x: x is not null))))""")
_family("q_words", lambda t: X.words(t, None), r"""(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_./:-]{2,}'), lambda w: trim(w, '._:-/')), lambda w: length(w) between 3 and 80), lambda w: case when contains(w, '/') and not (starts_with(w, '/workspace/') or starts_with(w, '/home/') or starts_with(w, '/tmp/')) then regexp_extract(w, '[^/]*$') else w end),
 lambda w: w <> '' and w not in ('about','after','also','assistant','because','before','content','could','error','from','have','help','into','message','need','please','request','result','should','system','that','there','this','tool','user','using','with','would')))""")


@query(
    "q_shingles",
    f"""with {_T}, k as (select request_id, regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_./:-]{{2,}}') as w from t), p as (select request_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from k where len(w) >= 1),
s as (select distinct request_id, array_to_string(w[i:i+4], ' ') as value from p where len(w) >= 5 union select distinct request_id, unnest(w) from k where len(w) < 5)
select request_id, count(*) as n_values, min(value) as first_value, max(value) as last_value from s group by request_id""",
)
def _shingles(spark: SparkSession, folder: str) -> DataFrame:
    each = _texts(spark, folder).select("request_id", F.explode(X.shingles(F.col("text"), most=None)).alias("value"))
    return each.groupBy("request_id").agg(F.count("*").alias("n_values"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))


@query(
    "q_signatures",
    f"""with {_T}, w as (select distinct request_id, unnest(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_./:-]{{2,}}'), lambda w: trim(w, '._:-/')), lambda w: length(w) between 3 and 80), lambda w: case when contains(w, '/') and not (starts_with(w, '/workspace/') or starts_with(w, '/home/') or starts_with(w, '/tmp/')) then regexp_extract(w, '[^/]*$') else w end), lambda w: w <> '' and w not in {X.STOP_WORDS})) as w from t),
b as (select unnest(range(0, 8)) as band), h as (select request_id, band, w, row_number() over (partition by request_id, band order by sha1(band || ':' || w)) as r from w, b),
s as (select request_id, band, count(*) as n, string_agg(w, '|' order by r) filter (where r <= 4) as head from h group by request_id, band)
select request_id, band, 'sem:' || band || ':' || substring(sha1(head), 1, 12) as signature from s where n >= 2""",
)
def _signatures(spark: SparkSession, folder: str) -> DataFrame:
    s = _texts(spark, folder).select("request_id", F.explode(X.signatures(X.words(F.col("text"), None))).alias("signature"))
    return s.select("request_id", F.split("signature", ":")[1].cast("long").alias("band"), "signature")


@query("q_token_count", f"with {REQUESTS_SQL} select request_id, coalesce(cast(list_sum(list_transform(messages, lambda m: len(list_filter(regexp_split_to_array(coalesce(m.content, ''), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '')))) as bigint), 0) as n_tokens from req")
def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_requests(table(spark, folder, "attack_view"), "messages").select("request_id", X.token_count(F.col("messages")).cast("long").alias("n_tokens"))


@query("q_role_counts", f"with {REQUESTS_SQL} select m.role as role, count(*) as n_messages, count(distinct request_id) as n_requests, coalesce(sum(length(m.content)), 0)::bigint as n_chars from (select request_id, unnest(messages) as m from req) group by m.role")
def _roles(spark: SparkSession, folder: str) -> DataFrame:
    each = canonical_requests(table(spark, folder, "attack_view"), "messages").select("request_id", F.explode("messages").alias("m"))
    return each.groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("n_messages"), F.countDistinct("request_id").alias("n_requests"), F.coalesce(F.sum(F.char_length("m.content")), F.lit(0)).alias("n_chars"))


@query("q_tool_fingerprint", f"with {REQUESTS_SQL}, f as (select request_id, array_to_string(list_sort(list_transform(tool_schemas, lambda s: coalesce(s.name, '') || '(' || array_to_string(coalesce(s.parameters, []), ',') || ')')), ';') as s from req) select substring(sha1(coalesce(s, '')), 1, 12) as fingerprint, count(*) as n_requests from f group by 1")
def _tools(spark: SparkSession, folder: str) -> DataFrame:
    r = canonical_requests(table(spark, folder, "attack_view"), "tool_schemas")
    text = F.array_join(F.array_sort(F.transform("tool_schemas", lambda s: F.concat(F.coalesce(s["name"], F.lit("")), F.lit("("), F.coalesce(F.array_join(s["parameters"], ","), F.lit("")), F.lit(")")))), ";")
    return r.select(X.fingerprint(F.coalesce(text, F.lit(""))).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n_requests"))


@query("q_audit_numbers", f"with {REQUESTS_SQL} select count(*) as n_requests, count(distinct bucket) as n_buckets, min(token_count) as least, max(token_count) as most, avg(token_count) as mean, quantile_disc(token_count, 0.5) as median, count(*) filter (where token_count is null) as n_missing from req")
def _audit(spark: SparkSession, folder: str) -> DataFrame:
    r = canonical_requests(table(spark, folder, "attack_view"), "token_count")
    return r.agg(F.count("*").alias("n_requests"), F.countDistinct("bucket").alias("n_buckets"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.avg("token_count").alias("mean"), F.expr("percentile_disc(0.5) within group (order by token_count)").cast("int").alias("median"), F.count_if(F.col("token_count").isNull()).alias("n_missing"))


# -- blocking over repositories, within cache buckets ---------------------------------
def _posted(spark: SparkSession, folder: str) -> DataFrame:
    return B.postings(_texts(spark, folder), X.domains(F.col("text")), F.col("bucket"))


_P = rf"with {_T}, p as (select distinct bucket as block, request_id as id, unnest(regexp_extract_all(text, '\b(?:[a-z0-9-]+\.)+(?:internal|local|prod|corp)\b')) as value from t), z as (select block, value, count(*) as size, min(id) as first from p group by block, value)"


@query("q_inverted_index", _P + " select block, value, size, first from z where size > 1")
def _index(spark: SparkSession, folder: str) -> DataFrame:
    return B.bucket_sizes(_posted(spark, folder)).where("size > 1")


@query("q_candidate_pairs", _P + """, k as (select p.* from p join z using (block, value) where size between 2 and 20), big as (select block, value, first, id from p join z using (block, value) where size > 20 and id <> first),
x as (select a.block, a.value, a.id as left, b.id as right from k a join k b on a.block = b.block and a.value = b.value and a.id < b.id union all select block, value, first, id from big) select x.block, x.left, x.right, count(*) as shared from x group by all""")
def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return B.candidate_pairs(_posted(spark, folder), 20, rest=True)


@query("q_star_edges", _P + " select distinct first as u, id as v from p join z using (block, value) where size > 1 and id <> first")
def _stars(spark: SparkSession, folder: str) -> DataFrame:
    return B.star_edges(_posted(spark, folder))


@query("q_anchor_pairs", _P + """, k as (select p.* from p join z using (block, value) where size between 2 and 12), x as (select a.value, a.id as left, b.id as right from k a join k b on a.block = b.block and a.value = b.value and a.id < b.id union all select value, first, id from p join z using (block, value) where size > 12 and id <> first)
select x.left, x.right, list_sort(list(distinct value)) as anchors from x group by all""")
def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    return B.anchor_pairs(_posted(spark, folder), 12, rest=True)


#: With this budget no request of the tables is over it, which the SQL's count confirms row by row: a request in more pairs would differ.
@query("q_bounded_pairs", _P + ", k as (select p.* from p join z using (block, value) where size between 2 and 400) select distinct a.block, a.id as left, b.id as right from k a join k b on a.block = b.block and a.value = b.value and a.id < b.id")
def _bounded_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return B.bounded_pairs(_posted(spark, folder), 400, 400)


_COMPONENTS = _P.replace("with ", "with recursive ", 1) + """, e0 as (select distinct first as u, id as v from p join z using (block, value) where size > 1 and id <> first),
e as (select u, v from e0 union select v, u from e0), r(id, label) as (select u, u from e union select e.v, r.label from r join e on r.id = e.u)
select id, min(label) as label from r group by id"""


@query("q_components", _COMPONENTS)
def _components(spark: SparkSession, folder: str) -> DataFrame:
    return components(B.star_edges(_posted(spark, folder)))
