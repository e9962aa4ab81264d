"""Core queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog_audits, catalog_documents, catalog_features, catalog_generators, catalog_linkage, catalog_metrics, catalog_sources, catalog_stream, catalog_transforms, catalog_watch  # noqa: F401
from .operators.sessions import request_sessions
from .queries import query, table

#: SQL fragments that several queries share.
INSTANT = "epoch_ms(try_cast(timestamp as timestamptz))"
MISSING = "('', 'none', 'null', 'unknown', 'n/a')"


@query(
    "p5_found",
    f"""
with r as (select request_id, min({INSTANT}) as ms, min(case when trim(cache_bucket) <> '' then cache_bucket end) as b from attack_view where request_id is not null group by request_id),
u as (select request_id, min(lower(trim(user_id))) as u from request_identity where lower(trim(user_id)) not in {MISSING} group by request_id),
e as (select u, coalesce(b, 'cache_unavailable') as b, ms from r join u using (request_id) where ms is not null),
f as (select *, case when ms - lag(ms) over (partition by u, b order by ms) <= 1800000 then 0 else 1 end as o from e),
s as (select *, sum(o) over (partition by u, b order by ms rows unbounded preceding) as run from f)
select u as user_id, b as cache_bucket, min(ms) as start_ms, max(ms) as end_ms, count(*) as n_requests from s group by u, b, run
""",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return request_sessions(table(spark, folder, "attack_view"), table(spark, folder, "request_identity"))
