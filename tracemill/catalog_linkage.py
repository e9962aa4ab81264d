"""Queries of the linkage methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linkage_sql as Q
from .functions.features import FeatureOptions
from .operators import evaluation as E
from .operators import linkage as L
from .operators.requests import REQUESTS_SQL, all_truth, truth_sql
from .queries import query, table


def _features(spark: SparkSession, folder: str, **off: bool | None) -> DataFrame:
    return L.feature_table(table(spark, folder, "attack_view"), FeatureOptions(**off))


#: Families that methods by key alone don't need.
_KEYS_ONLY = dict.fromkeys(("words", "shingles", "identifiers", "paths", "domains", "traces", "signatures", "repositories", "business"), False)


@query("q_temporal_labels", f"with {REQUESTS_SQL}, m as (select request_id, floor(ms / 60000.0) as minute from req), s as (select request_id, 'session' as level, floor(minute/10) as label from m union all select request_id, 'user', floor(minute/60) from m union all select request_id, 'project', floor(minute/1440) from m union all select request_id, 'org', floor(minute/1440) from m) select 'temporal' as method, level, request_id, cast(cast(label as bigint) as varchar) as label from s")
def _temporal(spark: SparkSession, folder: str) -> DataFrame:
    return L.temporal(_features(spark, folder, **_KEYS_ONLY))


_TOOL = """f as (select request_id, substring(sha1(coalesce(array_to_string(list_sort(list_transform(tool_schemas, lambda s: concat_ws('|', s.name, array_to_string(s.parameters, ',')))), ';'), '')), 1, 12) || '|' ||
 substring(sha1(coalesce(array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'system'), lambda m: coalesce(m.content, '')), chr(10)), '')), 1, 12) as label from req)"""


@query("q_tool_labels", f"with {REQUESTS_SQL}, {_TOOL} select 'tool' as method, unnest(['session','user','project','org']) as level, request_id, label from f")
def _tool(spark: SparkSession, folder: str) -> DataFrame:
    return L.tool(_features(spark, folder, **_KEYS_ONLY))


@query("q_rare_labels", Q.RARE_SQL)
def _rare(spark: SparkSession, folder: str) -> DataFrame:
    return L.rare(_features(spark, folder, shingles=False, signatures=False))


@query("q_low_cost", Q.LOW_COST_SQL)
def _low_cost(spark: SparkSession, folder: str) -> DataFrame:
    return L.low_cost(_features(spark, folder))


@query("q_hybrid", Q.HYBRID_SQL)
def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return L.hybrid(_features(spark, folder, signatures=False))


@query("q_prefix", Q.PREFIX_SQL)
def _prefix(spark: SparkSession, folder: str) -> DataFrame:
    return L.prefix(_features(spark, folder, signatures=False, handles=False, window_chars=None, max_shingles=None))


@query("q_context_only", Q.CONTEXT_SQL + " where level = 'session' union all select 'context_only', level, id, id from vx where level <> 'session'")
def _context(spark: SparkSession, folder: str) -> DataFrame:
    return L.context_only(_features(spark, folder))


_METRICS = f"""{Q.LOW_COST_SQL.split(" select 'low_cost' as method")[0]}, tt as ({" union all ".join(f"select '{level}' as level, request_id, label from {truth_sql(level)}" for level in L.LEVELS)}), xx as (select lb.level, lb.label as p, tt.label as t, count(*) as n from lb join tt on tt.level = lb.level and tt.request_id = lb.id group by 1, 2, 3),
h_ as (select level, sum(n * (n - 1) / 2) as h, sum(n)::bigint as items from xx group by 1), p_ as (select level, sum(n * (n - 1) / 2) as a, count(*) as clusters from (select level, p, sum(n) as n from xx group by 1, 2) group by 1), t_ as (select level, sum(n * (n - 1) / 2) as b from (select level, t, sum(n) as n from xx group by 1, 2) group by 1),
m_ as (select level, items, clusters, case when a > 0 then h / a else 0 end as p, case when b > 0 then h / b else 0 end as r from h_ join p_ using (level) join t_ using (level)) select 'low_cost' as method, level, items, clusters, p as precision, r as recall, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from m_"""


@query("q_low_cost_metrics", _METRICS)
def _low_cost_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Pair metrics of the low-cost method at every level."""
    labels = L.low_cost(_features(spark, folder))
    return E.evaluate_all(labels, all_truth(table(spark, folder, "request_identity")), ["method", "level"])


@query("q_stable_handles", f"with {REQUESTS_SQL}, {Q.HANDLES_SQL} select request_id, handle from hd")
def _handles(spark: SparkSession, folder: str) -> DataFrame:
    from .functions.handles import stable_handles
    from .operators.requests import canonical_requests

    r = canonical_requests(table(spark, folder, "attack_view"), "messages")
    return r.select("request_id", F.explode(stable_handles(F.col("messages"))).alias("handle"))
