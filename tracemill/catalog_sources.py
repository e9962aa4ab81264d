"""Queries of adapters, snapshots and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.labels import present
from .operators import evaluation as E
from .operators import linkage as L
from .operators.requests import REQUESTS_SQL, canonical_requests
from .queries import query, table
from .sources import adapters as A
from .sources.io import provider_view


@query("q_column_allowlist", "select request_id, timestamp, model, len(messages) as n_messages, len(tool_schemas) as n_tools, token_count, cache_bucket, provider_metadata.api_surface as api_surface from attack_view where request_id is not null")
def _allow(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "attack_view").withColumns({"user_id": F.lit("never seen"), "label": F.lit(1)})
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    v = provider_view(log).where("request_id is not null")
    return v.select("request_id", "timestamp", "model", size("messages").alias("n_messages"), size("tool_schemas").alias("n_tools"), "token_count", "cache_bucket", F.col("provider_metadata.api_surface").alias("api_surface"))


@query("q_snapshot_first", f"with {REQUESTS_SQL} select request_id, ms, bucket from req order by ms nulls last, request_id limit 500")
def _first(spark: SparkSession, folder: str) -> DataFrame:
    return A.snapshot(canonical_requests(table(spark, folder, "attack_view")), first=500).select("request_id", "ms", "bucket")


@query("q_snapshot_cutoff", f"with {REQUESTS_SQL}, c as (select (min(ms) + max(ms)) // 2 as cut from req) select bucket, count(*) as n_requests, min(ms) as first_ms, max(ms) as last_ms from req, c where ms <= cut group by bucket")
def _cutoff(spark: SparkSession, folder: str) -> DataFrame:
    r = canonical_requests(table(spark, folder, "attack_view"))
    cut = r.agg(F.floor((F.min("ms") + F.max("ms")) / 2).alias("cut")).head()["cut"]
    return A.snapshot(r, until_ms=cut if cut is not None else 0).groupBy("bucket").agg(F.count("*").alias("n_requests"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


@query("q_first_per_workflow", f"with {REQUESTS_SQL}, i as (select request_id, min(trim(workflow_id)) as w from request_identity where request_id is not null and lower(trim(workflow_id)) not in ('','none','null','unknown','n/a') group by request_id), r as (select request_id, w, row_number() over (partition by w order by ms nulls first, request_id) as k from req join i using (request_id)) select request_id, w as workflow_id from r where k <= 2")
def _per_workflow(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "request_identity").where("request_id is not null").select("request_id", present(F.col("workflow_id")).alias("w")).where("w is not null").groupBy("request_id").agg(F.min("w").alias("w"))
    rows = canonical_requests(table(spark, folder, "attack_view")).join(i, "request_id")
    return A.first_per_group(rows, "w", ["ms", "request_id"], 2).select("request_id", F.col("w").alias("workflow_id"))


@query("q_provenance_coverage", f"with {REQUESTS_SQL}, p as (select distinct request_id, lower(trim(source)) as source from request_provenance where request_id is not null) select coalesce(source, 'missing') as source, count(*) as n_requests from req left join p using (request_id) group by 1")
def _provenance(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "request_provenance").where("request_id is not null").select("request_id", F.lower(F.trim("source")).alias("source")).distinct()
    return canonical_requests(table(spark, folder, "attack_view")).join(p, "request_id", "left").groupBy(F.coalesce("source", F.lit("missing")).alias("source")).agg(F.count("*").alias("n_requests"))


_ROLES = "case when lower(trim(coalesce(m.role, ''))) in ('system', 'user', 'assistant', 'tool') then lower(trim(m.role)) " + " ".join(f"when lower(trim(m.role)) = '{a}' then '{b}'" for a, b in A.ROLE_NAMES.items()) + " else 'user' end"
_TRAJECTORIES = f"""with {REQUESTS_SQL}, i as (select request_id, min(trim(workflow_id)) as w from request_identity where request_id is not null and lower(trim(workflow_id)) not in ('','none','null','unknown','n/a') group by request_id), r as (select * from req join i using (request_id) where messages is not null),
g as (select w, arg_max(messages, (len(messages), request_id)) as messages, min(ms) as ms from r group by w), e as (select w, ms, p, messages[p] as m from (select *, unnest(range(1, len(messages) + 1)) as p from g)),
t as (select w, coalesce(ms // 1000, 0) as start, p, row_number() over (partition by w order by p) as turn from e where p > 1 and {_ROLES} = 'assistant')
select w || '_' || lpad(turn::varchar, 3, '0') as request_id, w as workflow_id, turn::int as turn_id, strftime(epoch_ms((start + 45 * (turn - 1) + (('0x' || substring(sha256('7:' || w || ':' || turn), 1, 12))::bigint % 16)) * 1000), '%Y-%m-%dT%H:%M:%SZ') as timestamp, p::int as n_messages from t"""


@query("q_trajectory_turns", _TRAJECTORIES)
def _trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """The longest request of each workflow, taken as a trajectory, back to one request a turn."""
    i = table(spark, folder, "request_identity").where("request_id is not null").select("request_id", present(F.col("workflow_id")).alias("w")).where("w is not null").groupBy("request_id").agg(F.min("w").alias("w"))
    r = canonical_requests(table(spark, folder, "attack_view"), "messages").join(i, "request_id").where("messages is not null")
    longest = r.groupBy("w").agg(F.max_by("messages", F.struct(F.size("messages"), F.col("request_id"))).alias("messages"), F.min("ms").alias("ms"))
    out = A.turns_from_trajectories(longest, "w", "messages", F.lit("Use tools with care."), F.coalesce(F.floor(F.col("ms") / 1000), F.lit(0)))
    return out.select("request_id", "workflow_id", "turn_id", "timestamp", F.size("messages").alias("n_messages"))


@query("q_synthetic_linkage")
def _synthetic(spark: SparkSession, folder: str) -> DataFrame:
    """Pair metrics of the low-cost method on 100,000 invented requests, where sessions are known; it reads no table."""
    f = A.synthetic_features(spark, 500, 200)
    labels = L.low_cost(f.drop("truth_session", "truth_user")).where("level = 'session'").select("request_id", "label")
    return E.clustering_metrics(labels, f.select("request_id", F.col("truth_session").alias("label")))


@query("q_event_users", "select user_id, event_type, count(*) as n, round(sum(value), 4) as total, min(event_id) as first_id, max(event_id) as last_id from events group by all")
def _event_users(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
