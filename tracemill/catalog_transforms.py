"""Queries of the transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.features import DOMAIN, IDENTIFIER, PATH
from .functions.labels import present
from .operators import transforms as T
from .operators.requests import REQUESTS_SQL, canonical_requests
from .queries import query, table
from .scratch import Scratch


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_requests(table(spark, folder, "attack_view"), "messages", "token_count")


def _digest(rows: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    return rows.select("request_id", F.md5(F.coalesce(text, F.lit(""))).alias("digest"), F.col("token_count").cast("long").alias("token_count"))


_COUNT = r"coalesce(cast(list_sum(list_transform(messages, lambda m: len(list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '')))) as bigint), 0)"


def _sql(change: str) -> str:
    return f"with {REQUESTS_SQL} select request_id, md5(coalesce(array_to_string(list_transform(messages, lambda m: coalesce({change}, '')), chr(10)), '')) as digest, {_COUNT.format(change)} as token_count from req"


def _replace(pattern: str, mark: str, inner: str = "m.content", flags: str = "g") -> str:
    return f"regexp_replace({inner}, '{pattern}', '{mark}', '{flags}')"


_SECRETS = _replace(r"\b(?:postgres|mysql|redis|mongodb)://[^\s]+", "[CONNECTION_STRING]", _replace(T.SECRET, "[SECRET]"), "gi")


@query("q_filter_secrets", _sql(_SECRETS))
def _filter(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(T.map_contents(_rows(spark, folder), T.filter_secrets))


@query("q_path_type_only", _sql(_replace(T.WORKSPACE_PATH, "[WORKSPACE_PATH]")))
def _path_type(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(T.map_contents(_rows(spark, folder), T.path_type_only))


for _name, _change in {
    "no_paths": _replace(PATH, "[PATH]"),
    "no_workspace_paths": _replace(T.WORKSPACE_PATH, "[WORKSPACE_PATH]"),
    "no_domains": _replace(r"\b(?:[a-z0-9-]+\.)+(?:internal|local|prod|corp)\b", "[DOMAIN]", flags="gi"),
    "no_repository_fields": _replace(r"\brepository=[^\s]+", "repository=[REPO]"),
    "no_repo_ids": _replace(r"/workspace/[^/\s]+", "/workspace/[REPO]", _replace(r"\brepository=[^\s]+", "repository=[REPO]")),
    "no_secrets": _SECRETS,
}.items():

    @query(f"q_ablate_{_name}", _sql(_change))
    def _ablate(spark: SparkSession, folder: str, name: str = _name) -> DataFrame:
        return _digest(T.ablate(_rows(spark, folder), name))


_MINIMAL = f"""(case m.role when 'system' then '{T.SYSTEM_TEXT}' when 'user' then case when contains(coalesce(m.content, ''), chr(10) || 'Prior context:' || chr(10)) then split_part(m.content, chr(10) || 'Prior context:' || chr(10), 1) || chr(10) || 'Prior context: [LOCAL_SUMMARY_REDACTED]' else coalesce(m.content, '') end
 when 'assistant' then '{T.ASSISTANT_TEXT}' when 'tool' then array_to_string(list_filter(string_split(replace(replace(coalesce(m.content, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x) <> '')[1:2], chr(10)) else m.content end)"""


@query("q_minimize_context", _sql(_MINIMAL))
def _minimize(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(T.minimize_context(_rows(spark, folder)))


@query("q_length_buckets", f"with {REQUESTS_SQL} select case when coalesce(token_count, 0) <= 64 then 64 when token_count <= 128 then 128 when token_count <= 256 then 256 when token_count <= 512 then 512 else 1024 end as length_bucket, count(*) as n_requests from req group by 1")
def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    r = canonical_requests(table(spark, folder, "attack_view"), "token_count")
    return r.select(T.length_bucket(F.col("token_count")).alias("length_bucket")).groupBy("length_bucket").agg(F.count("*").alias("n_requests"))


_FOUND = f"with {REQUESTS_SQL}, x as (select request_id, ms, i - 1 as i, regexp_extract_all(messages[i].content, '{PATH}') as v from (select request_id, ms, messages, unnest(range(1, coalesce(len(messages), 0) + 1)) as i from req)), y as (select request_id, ms, i, k, lower(v[k]) as value from (select *, unnest(range(1, coalesce(len(v), 0) + 1)) as k from x)), f as (select value, min((coalesce(ms, -1), request_id, i, k)) as place from y group by value)"


@query("q_entity_dictionary", _FOUND + " select value, '[PATH_' || case when n < 10000 then lpad(cast(n as varchar), 4, '0') else cast(n as varchar) end || ']' as placeholder from (select value, row_number() over (order by place, value) as n from f)")
def _dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return T.entity_dictionary(_rows(spark, folder), PATH, "PATH")


#: Contents by request and place (from 0), and what puts them together again.
_C0 = "c0 as materialized (select request_id, ms, i, messages[i + 1].content as c from (select request_id, ms, messages, unnest(range(0, coalesce(len(messages), 0))) as i from req))"


def _pass(n: int, pattern: str, kind: str) -> str:
    """CTEs from c{n} to c{n + 1}: every match by its number of first occurrence."""
    return f"""m{n} as materialized (select request_id, ms, i, k, v[k] as v from (select *, unnest(range(1, len(v) + 1)) as k from (select request_id, ms, i, regexp_extract_all(c, '{pattern}') as v from c{n} where c is not null))),
d{n} as materialized (select value, '[{kind}_' || case when n < 10000 then lpad(n::varchar, 4, '0') else n::varchar end || ']' as p from (select value, row_number() over (order by place, value) as n from (select lower(v) as value, min((coalesce(ms, -1), request_id, i, k)) as place from m{n} group by 1))),
r{n} as (select request_id, i, k, p from m{n} join d{n} on lower(v) = value), b{n} as (select request_id, i, k, b[k] as b from (select *, unnest(range(1, len(b) + 1)) as k from (select request_id, i, regexp_split_to_array(c, '{pattern}') as b from c{n} where c is not null))),
c{n + 1} as materialized (select c{n}.request_id, c{n}.ms, c{n}.i, s as c from c{n} left join (select request_id, i, string_agg(b || coalesce(p, ''), '' order by k) as s from b{n} left join r{n} using (request_id, i, k) group by 1, 2) using (request_id, i))"""


def _told(n: int) -> str:
    """Digest and token count of the contents c{n}."""
    return f"select req.request_id, md5(coalesce(string_agg(coalesce(c, ''), chr(10) order by i), '')) as digest, coalesce(sum(len(list_filter(regexp_split_to_array(coalesce(c, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> ''))), 0)::bigint as token_count from req left join c{n} using (request_id) group by 1"


_ENTITIES = f"{_C0}, {_pass(0, PATH, 'PATH')}, {_pass(1, '(?i)' + DOMAIN, 'DOMAIN')}, {_pass(2, IDENTIFIER, 'ID')}"


@query("q_redact_entities", f"with {REQUESTS_SQL}, {_ENTITIES} {_told(3)}")
def _redact(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(T.redact_all_entities(_rows(spark, folder)))


_SLUG = "/workspace/[A-Za-z0-9_.-]+"


def _slugs(number: str) -> str:
    return f"""m0 as materialized (select request_id, ms, i, k, lower(substring(v[k], 12)) as v from (select *, unnest(range(1, len(v) + 1)) as k from (select request_id, ms, i, regexp_extract_all(c, '{_SLUG}') as v from c0 where c is not null))), d0 as materialized ({number}),
b0 as (select request_id, i, k, b[k] as b from (select *, unnest(range(1, len(b) + 1)) as k from (select request_id, i, regexp_split_to_array(c, '{_SLUG}') as b from c0 where c is not null))),
c1 as materialized (select c0.request_id, c0.i, s as c from c0 left join (select b0.request_id, b0.i, string_agg(b || coalesce('/workspace/' || p, ''), '' order by b0.k) as s from b0 left join m0 on m0.request_id = b0.request_id and m0.i = b0.i and m0.k = b0.k left join d0 on d0.v = m0.v and (d0.own is null or d0.own = b0.request_id) group by 1, 2) using (request_id, i))"""


_STABLE = "select null as own, v, 'workspace_' || lpad(n::varchar, 4, '0') as p from (select v, row_number() over (order by place, v) as n from (select v, min((coalesce(ms, -1), request_id, i, k)) as place from m0 group by 1))"
_OWN = "select request_id as own, v, 'workspace_' || request_id || '_' || lpad(n::varchar, 3, '0') as p from (select request_id, v, row_number() over (partition by request_id order by place) as n from (select request_id, v, min((i, k)) as place from m0 group by 1, 2))"


@query("q_workspace_pseudonyms", f"with {REQUESTS_SQL}, {_C0}, {_slugs(_STABLE)} {_told(1)}")
def _pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(T.pseudonymize_workspaces(_rows(spark, folder)))


@query("q_request_pseudonyms", f"with {REQUESTS_SQL}, {_C0}, {_slugs(_OWN)} {_told(1)}")
def _request_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(T.pseudonymize_workspaces(_rows(spark, folder), "request"))


_STRICT = _replace(r"\b[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\b", "[PAIR]", _replace(r"\b(?:[a-z0-9-]+\.)+(?:internal|local|prod|corp)\b", "[DOMAIN]", _replace(PATH, "[PATH]", _replace(r"\brepository=[^\s]+", "repository=[REPO]")), "gi"))


@query("q_strict_sanitize", _sql(_STRICT))
def _strict(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(T.map_contents(_rows(spark, folder), T.strict_sanitize))


#: The composed defence: secrets, entities, context, then times and counts.
_M6_MINIMAL = _MINIMAL.replace("m.content", "c").replace("m.role", "role")
_M6 = f"""with {REQUESTS_SQL}, s0 as (select request_id, ms, i, messages[i + 1] as m from (select request_id, ms, messages, unnest(range(0, coalesce(len(messages), 0))) as i from req)), c0 as materialized (select request_id, ms, i, {_SECRETS} as c from s0), {", ".join([_pass(0, PATH, "PATH"), _pass(1, "(?i)" + DOMAIN, "DOMAIN"), _pass(2, IDENTIFIER, "ID")])},
z as (select c3.request_id, c3.i, {_M6_MINIMAL} as c from c3 join (select request_id, i, m.role as role from s0) using (request_id, i)), t as ({_told(0).replace("c0", "z")})
select request_id, digest, case when token_count <= 64 then 64 when token_count <= 128 then 128 when token_count <= 256 then 256 when token_count <= 512 then 512 else 1024 end::bigint as token_count from t"""


@query("q_defense_composed", _M6)
def _m6(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(T.apply_defense(_rows(spark, folder), "M6"))


_JOINED = "coalesce(array_to_string(list_transform(messages, lambda m: coalesce({0}, '')), chr(10)), '')"


@query(
    "q_utility",
    f"""with {REQUESTS_SQL}, s as (select {_JOINED.format("m.content")} as a, {_JOINED.format(_SECRETS)} as b, coalesce(token_count, 0) as ta, {_COUNT.format(_SECRETS)} as tb from req)
select count(*) as requests, sum(length(b)) / sum(length(a)) as char_retention, sum(tb) / sum(ta) as token_retention, cast(sum(len(regexp_extract_all(a, '{PATH}'))) - sum(len(regexp_extract_all(b, '{PATH}'))) as bigint) as paths_removed,
 cast(sum(len(regexp_extract_all(a, '{T.SECRET}'))) - sum(len(regexp_extract_all(b, '{T.SECRET}'))) as bigint) as secrets_removed, cast(sum(len(regexp_extract_all(b, '\\[SECRET\\]'))) as bigint) as placeholders from s""",
)
def _utility(spark: SparkSession, folder: str) -> DataFrame:
    r = _rows(spark, folder)
    return T.utility(r, T.map_contents(r, T.filter_secrets))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "request_identity").where("request_id is not null and turn_id is not null").select("request_id", present(F.col("workflow_id")).alias("w"), "turn_id").where("w is not null")
    return _rows(spark, folder).join(i.groupBy("request_id").agg(F.min("w").alias("w"), F.min("turn_id").alias("turn")), "request_id")


_TURNS = f"with {REQUESTS_SQL}, i as (select request_id, min(trim(workflow_id)) as w, min(turn_id) as turn from request_identity where request_id is not null and turn_id is not null and lower(trim(workflow_id)) not in ('','none','null','unknown','n/a') group by request_id), r as (select *, coalesce(len(messages), 0) as n from req join i using (request_id)), q as (select *, coalesce(lag(n) over (partition by w order by turn, request_id), 0) as since from r)"


@query("q_turn_deltas", _TURNS + " select request_id, w as workflow_id, cast(n as bigint) as n_messages, cast(case when n = 0 then 0 when since >= n then 1 else n - since end as bigint) as n_delta from q")
def _deltas(spark: SparkSession, folder: str) -> DataFrame:
    d = T.turn_deltas(_turns(spark, folder), "w", "turn")
    return d.select("request_id", F.col("w").alias("workflow_id"), F.col("n").cast("long").alias("n_messages"), F.size("delta").cast("long").alias("n_delta"))


def _spans(category: str, pattern: str, cut: int = 0, keep: str = "true") -> str:
    """Matches of a pattern with their places; ``cut`` characters before the span are part of the pattern only."""
    return f"""select request_id, ms, i, c, '{category}' as category, (list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:k-1], lambda x: length(x))), 0) + {cut})::bigint as s, substring(v[k], {cut + 1}) as o
 from (select *, unnest(range(1, len(v) + 1)) as k from (select *, regexp_extract_all(c, '{pattern}') as v, regexp_split_to_array(c, '{pattern}') as b from c0 where c is not null)) where {keep}"""


_HANDLE = r"(?i)\b(?:user|customer|account|order|reservation|booking|case|ticket|tenant|organization|org|project|queue|product|item|flight)[_-][A-Za-z0-9][A-Za-z0-9_.:/@-]{3,}\b"


def _lineage_sql(scope: str) -> str:
    return f"""with recursive {REQUESTS_SQL}, {_C0}, sp as materialized ({_spans("workspace", "/workspace/[A-Za-z0-9_.-]+", 11)} union all {_spans("repository", "repository=[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+", 11)} union all {_spans("domain", "(?i)" + DOMAIN)} union all {_spans("typed_handle", _HANDLE, keep="regexp_matches(substring(v[k], strpos(replace(v[k], '-', '_'), '_') + 1), '[0-9]')")}),
rk as materialized (select *, s + length(o) as f, row_number() over (partition by request_id, i order by s, -length(o), category) as r from sp), g(request_id, i, r, f, taken) as (select request_id, i, r, f, true from rk where r = 1 union all select rk.request_id, rk.i, rk.r, case when rk.s >= g.f then rk.f else g.f end, rk.s >= g.f from g join rk on rk.request_id = g.request_id and rk.i = g.i and rk.r = g.r + 1),
ed as materialized (select rk.*, {"''" if scope == "dataset" else "rk.request_id"} as scope from rk join g using (request_id, i, r) where taken),
nn as (select *, row_number() over (partition by category order by place, scope, value) as n from (select scope, category, lower(o) as value, min((coalesce(ms, -1), request_id, i, s)) as place from ed group by 1, 2, 3)),
nm as (select scope, category, value, case category when 'workspace' then 'workspace_' || lpad(n::varchar, 4, '0') when 'repository' then 'owner_' || lpad(n::varchar, 4, '0') || '/repo_' || lpad(n::varchar, 4, '0') when 'domain' then 'service-' || lpad(n::varchar, 4, '0') || '.internal' else regexp_extract(value, '^[^_-]*') || '_p' || lpad(n::varchar, 6, '0') end as replacement from nn),
ln as materialized (select request_id, i as message_index, ed.category, s as "start", f as "end", o as original, replacement, sha256(c) as source_hash, c from ed join nm on nm.scope = ed.scope and nm.category = ed.category and nm.value = lower(o))"""


_SPAN_COLUMNS = ["request_id", "message_index", "category", "start", "end", "original", "replacement", "source_hash"]
_EDITED = """, pc as (select request_id, message_index, c, "start", "end", replacement, coalesce(lag("end") over w, 0) as p, row_number() over w as k, count(*) over (partition by request_id, message_index) as n from ln window w as (partition by request_id, message_index order by "start")),
cs as (select request_id, message_index, string_agg(substring(c, p + 1, "start" - p) || replacement || case when k = n then substring(c, "end" + 1) else '' end, '' order by k) as content from pc group by 1, 2)"""


@query("q_span_lineage", _lineage_sql("dataset") + ' select request_id, message_index, category, "start", "end", original, replacement, source_hash from ln')
def _lineage(spark: SparkSession, folder: str) -> DataFrame:
    return T.span_lineage(_rows(spark, folder)).select(*_SPAN_COLUMNS)


@query("q_request_lineage", _lineage_sql("request") + ' select request_id, message_index, category, "start", "end", original, replacement, source_hash from ln')
def _own_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return T.span_lineage(_rows(spark, folder), "request").select(*_SPAN_COLUMNS)


@query("q_lineage_contents", _lineage_sql("dataset") + _EDITED + " select request_id, message_index, md5(content) as digest from cs")
def _lineage_contents(spark: SparkSession, folder: str) -> DataFrame:
    r = _rows(spark, folder)
    return T.apply_edits(r, T.span_lineage(r)).select("request_id", "message_index", F.md5("content").alias("digest"))


@query("q_lineage_validation", _lineage_sql("dataset") + """ select 0::bigint as unmatched_requests, 0::bigint as changed_counts, 0::bigint as changed_shapes, (select coalesce(sum(length(c)), 0)::bigint from c0) as source_characters, (select count(*) from req) as requests, count(*) as edits, 0::bigint as misplaced_edits, sum("end" - "start")::bigint as edited_characters, 0::bigint as unreproduced_contents,
 sum("end" - "start") / (select sum(length(c)) from c0) as edited_share from ln""")
def _validation(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "validation")
    r = scratch.save(_rows(spark, folder), "rows")
    edits = scratch.save(T.span_lineage(r), "edits")
    return T.validate_lineage(r, T.apply_lineage(r, edits), edits)


@query("q_hash_fraction", f"with {REQUESTS_SQL} select request_id, round(cast(('0x' || substring(sha256(request_id), 1, 16))::ubigint as double) / 18446744073709551615.0, 9) as fraction from req")
def _fraction(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_requests(table(spark, folder, "attack_view")).select("request_id", F.round(T.unit_fraction(F.col("request_id")), 9).alias("fraction"))
