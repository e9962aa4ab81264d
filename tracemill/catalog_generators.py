"""Queries of time models, overlays, repairs and replays over the log's own workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.labels import present
from .operators.requests import REQUESTS_SQL, canonical_requests
from .queries import query, table
from .sources import adapters as A
from .sources import generators as G
from .sources.io import removed_fields


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "request_identity").where("request_id is not null")
    return i.groupBy("request_id").agg(F.min(present(F.col("workflow_id"))).alias("workflow"), F.min("turn_id").alias("turn")).where("workflow is not null and turn is not null")


_TURNS = "tn as (select * from (select request_id, min(case when lower(trim(workflow_id)) not in ('', 'none', 'null', 'unknown', 'n/a') then trim(workflow_id) end) as workflow, min(turn_id) as turn from request_identity where request_id is not null group by 1) where workflow is not null and turn is not null)"
_M = G.TimeModel()


def _int(*parts: str) -> str:
    return f"('0x' || substring(sha256('7:' || {' || chr(58) || '.join(parts)}), 1, 12))::bigint"


def _drawn(k: int, *parts: str) -> str:
    return f"({_int(*parts)} % {k})"


def _fraction(*parts: str) -> str:
    return f"({_int(*parts)} / 281474976710656.0)"


_HOUR = f"greatest(0, least(23, floor({float(_M.center)} + sqrt(-2 * ln(1 - {_fraction('workflow', chr(39) + 'u' + chr(39))})) * cos(2 * 3.141592653589793 * {_fraction('workflow', chr(39) + 'v' + chr(39))}) * {_M.spread / 2})::bigint))"
_WAIT = f"case when row_number() over (partition by workflow order by turn, request_id) = 1 then 0 when {_fraction('workflow', 'turn', chr(39) + 'burst' + chr(39))} < {_M.burst} then {_M.low} + {_drawn(_M.p50 - _M.low + 1, 'workflow', 'turn', chr(39) + 'short' + chr(39))} else {_M.p50} + {_drawn(_M.p90 - _M.p50 + 1, 'workflow', 'turn', chr(39) + 'long' + chr(39))} end"
_BEGIN = f"{_M.start} + {_drawn(_M.days, 'workflow', chr(39) + 'day' + chr(39))} * 86400 + {_HOUR} * 3600 + {_drawn(_M.jitter_minutes + 1, 'workflow', chr(39) + 'jitter' + chr(39))} * 60"


@query("q_time_model", f"with {_TURNS}, w as (select *, {_WAIT} as wait from tn) select request_id, workflow, turn, cast({_BEGIN} + sum(wait) over (partition by workflow order by turn, request_id rows unbounded preceding) as bigint) as second from w")
def _times(spark: SparkSession, folder: str) -> DataFrame:
    return G.timed_turns(_turns(spark, folder)).select("request_id", "workflow", "turn", "second")


_USER = _drawn(24, "workflow", "'user'")
_ENTITIES = f"en as (select request_id, workflow, turn, u, p, p % 3 as o, (['pytest', 'npm test', 'cargo test', 'go test'])[{_int('p::varchar', chr(39) + 'tool' + chr(39))} % 4 + 1] as tool from (select *, {_int('u::varchar', chr(39) + 'project' + chr(39))} % 9 as p from (select *, {_USER} as u from tn)))"
_NAMES = "nm as (select request_id, workflow, 'user' || lpad(u::varchar, 3, '0') as user_id, 'project' || lpad(p::varchar, 3, '0') as project_id, 'org' || lpad(o::varchar, 3, '0') as org_id, tool from en)"


@query(
    "q_overlay",
    f"""with {REQUESTS_SQL}, {_TURNS}, {_ENTITIES}, {_NAMES}, x as (select nm.*, messages from nm join req using (request_id)), k as (select request_id, user_id, project_id, org_id, messages, list_concat(
 case when {_fraction("request_id", "'environment'")} < 0.7 then ['cwd=/workspace/' || org_id || '__' || project_id || '; runner_home=/home/' || user_id || '; preferred_check=' || tool] else [] end, case when {_fraction("workflow", "'profile'")} < 0.3 then ['account_cache=' || org_id || ':acct:' || user_id] else [] end) as put from x),
c as (select request_id, user_id, project_id, org_id, list_concat(put, coalesce(list_transform(messages, lambda m: coalesce(regexp_replace(regexp_replace(m.content, '\\brepository=[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+', 'repository=' || org_id || '/' || project_id, 'g'), '/workspace/[A-Za-z0-9_.-]+', '/workspace/' || org_id || '__' || project_id, 'g'), '')), [])) as cs from k)
select request_id, user_id, project_id, org_id, len(cs) as n_messages, md5(array_to_string(cs, chr(10))) as digest from c""",
)
def _overlay(spark: SparkSession, folder: str) -> DataFrame:
    rows = canonical_requests(table(spark, folder, "attack_view"), "messages").join(_turns(spark, folder), "request_id")
    o = G.overlay(rows)
    text = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    return o.select("request_id", "user_id", "project_id", "org_id", F.size("messages").cast("long").alias("n_messages"), F.md5(text).alias("digest"))


@query("q_monotone_times", f"with {REQUESTS_SQL}, {_TURNS}, r as (select workflow, turn, request_id, coalesce(ms // 1000, 0) as s, row_number() over (partition by workflow order by turn, request_id) as k from tn join req using (request_id)) select request_id, workflow, turn, cast(max(s - k) over (partition by workflow order by k rows unbounded preceding) + k as bigint) as second from r")
def _monotone(spark: SparkSession, folder: str) -> DataFrame:
    rows = canonical_requests(table(spark, folder, "attack_view")).join(_turns(spark, folder), "request_id").withColumn("second", F.coalesce(F.floor(F.col("ms") / 1000), F.lit(0)))
    return A.monotone_times(rows, "workflow", "turn", "second").select("request_id", "workflow", "turn", "second")


@query("q_replayed", f"with {REQUESTS_SQL} select request_id || '#' || n as request_id, ms + n * 86400000 as ms, bucket from req, (select unnest(range(0, 3)) as n)")
def _replayed(spark: SparkSession, folder: str) -> DataFrame:
    return A.replay(canonical_requests(table(spark, folder, "attack_view")), 3, 86_400_000).select("request_id", "ms", "bucket")


_ASSISTANT = "list_filter(range(1, len(messages)), lambda i: messages[i + 1].role in ('assistant', 'tool'))"


@query("q_spread_turns", f"with {REQUESTS_SQL}, p as (select request_id, {_ASSISTANT} as p from req where messages is not null), s as (select request_id, case when len(p) <= 12 then p else list_sort(list_distinct(list_transform(range(0, 12), lambda i: p[(i * len(p)) // 12 + 1]))) end as p from p) select request_id, len(p) as n_turns, coalesce(list_sum(p), 0)::bigint as total from s")
def _spread(spark: SparkSession, folder: str) -> DataFrame:
    """At most twelve turns of an assistant or a tool of each request, evenly spread."""
    r = canonical_requests(table(spark, folder, "attack_view"), "messages").where("messages is not null")
    places = F.filter(F.transform("messages", lambda m, i: F.when((i > 0) & m["role"].isin("assistant", "tool"), i)), lambda i: i.isNotNull())
    p = A.spread_turns(F.col("p"))
    return r.select("request_id", places.alias("p")).select("request_id", p.alias("p")).select("request_id", F.size("p").cast("long").alias("n_turns"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("q_repair_workflows", "with d as (select doc_id, text, repo_full from documents where kind = 'issue' and text is not null and repo_full is not null) select cast(doc_id as varchar) as workflow, turn, 2 * turn - 1 as n_messages, md5('repository=' || repo_full || chr(10) || text) as task from d, (select unnest(range(1, 5)) as turn)")
def _repairs(spark: SparkSession, folder: str) -> DataFrame:
    """Issues as repairs in four turns, each with all messages before it."""
    d = table(spark, folder, "documents").where("kind = 'issue' and text is not null and repo_full is not null")
    m = d.select(F.col("doc_id").cast("string").alias("workflow"), A.repair_workflow(F.col("text"), F.lit("patch"), F.col("repo_full")).alias("m"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("turn"))
    seen = F.slice("m", F.lit(1), (2 * F.col("turn") - 1).cast("int"))
    return m.select("workflow", "turn", F.size(seen).cast("long").alias("n_messages"), F.md5(F.get("m", F.lit(0))["content"]).alias("task"))


@query("q_removed_fields", "select 'user_id' as field, count(user_id) as n_rows from request_identity join attack_view using (request_id) union all select 'workflow_id', count(workflow_id) from request_identity join attack_view using (request_id)")
def _removed(spark: SparkSession, folder: str) -> DataFrame:
    """Labels joined to the log come out of the provider's view again, and are counted."""
    labels = table(spark, folder, "request_identity").select("request_id", "user_id", "workflow_id")
    return removed_fields(table(spark, folder, "attack_view").join(labels, "request_id"))
