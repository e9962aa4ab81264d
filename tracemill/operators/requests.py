"""The canonical request table and truth labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant_millis
from ..functions.labels import bucket_or_unavailable, present

#: Levels of truth and the column that holds each.
LEVELS = {"session": "workflow_id", "user": "user_id", "project": "project_id", "org": "org_id"}


def canonical_requests(attack_view: DataFrame, *columns: str) -> DataFrame:
    """One row per request: its earliest delivery (unreadable instants last, then by spelling).

    ``columns``: the columns of the log to carry besides ``request_id``, ``ms``
    (the instant) and ``bucket``; a plan that needs no messages reads none.
    Rows without an id are left out.  Extra columns of the log are ignored.
    """
    ms = instant_millis(F.col("timestamp"))
    rank = F.struct(F.coalesce(ms, F.lit(9223372036854775807)).alias("ms"), F.coalesce("timestamp", F.lit("~")).alias("spelt"))
    kept = F.struct(ms.alias("ms"), bucket_or_unavailable(F.col("cache_bucket")).alias("bucket"), *[F.col(c) for c in columns])
    one = attack_view.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.min_by(kept, rank).alias("r"))
    return one.select("request_id", "r.*")


#: The same as SQL, as a CTE named req.
REQUESTS_SQL = """
req as (
  select *, coalesce(case when trim(cache_bucket) <> '' then cache_bucket end, 'cache_unavailable') as bucket
  from (select *, epoch_ms(try_cast(timestamp as timestamptz)) as ms from attack_view where request_id is not null)
  qualify row_number() over (partition by request_id order by coalesce(ms, 9223372036854775807), coalesce(timestamp, '~')) = 1
)"""


def request_text(messages: Column) -> Column:
    """``role:name:content`` of each message, by lines; null parts are empty, a null array gives ''."""
    part = lambda m, k: F.coalesce(m[k], F.lit(""))
    lines = F.transform(messages, lambda m: F.concat(part(m, "role"), F.lit(":"), part(m, "name"), F.lit(":"), part(m, "content")))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


TEXT_SQL = "coalesce(array_to_string(list_transform(messages, lambda m: coalesce(m.role, '') || ':' || coalesce(m.name, '') || ':' || coalesce(m.content, '')), chr(10)), '')"


def truth_labels(request_identity: DataFrame, level: str) -> DataFrame:
    """``request_id``, ``label`` at a level; missing labels are left out, the smallest of two is taken."""
    label = present(F.col(LEVELS[level]))
    if level == "user":
        label = F.lower(label)
    return request_identity.where(F.col("request_id").isNotNull()).select("request_id", label.alias("label")).where(F.col("label").isNotNull()).groupBy("request_id").agg(F.min("label").alias("label"))


def truth_sql(level: str) -> str:
    column = LEVELS[level]
    label = f"lower(trim({column}))" if level == "user" else f"trim({column})"
    return f"(select request_id, min({label}) as label from request_identity where request_id is not null and lower(trim({column})) not in ('', 'none', 'null', 'unknown', 'n/a') group by request_id)"


def all_truth(request_identity: DataFrame) -> DataFrame:
    """``level``, ``request_id``, ``label`` of all levels, in one pass."""
    spread = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), (F.lower(present(F.col(c))) if level == "user" else present(F.col(c))).alias("label")) for level, c in LEVELS.items()]))
    each = request_identity.where(F.col("request_id").isNotNull()).select("request_id", spread.alias("t")).where(F.col("t.label").isNotNull())
    return each.groupBy(F.col("t.level").alias("level"), "request_id").agg(F.min("t.label").alias("label"))
