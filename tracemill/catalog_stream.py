"""Queries of the linker and of sessions over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linkage_sql as Q
from .operators import evaluation as E
from .operators import states as S
from .operators.components import components
from .operators.requests import REQUESTS_SQL, truth_labels, truth_sql
from .operators.sessions import sessionize
from .queries import query, table
from .scratch import Scratch
from .streaming import linker as K


def _states(spark: SparkSession, folder: str) -> DataFrame:
    return S.agent_states(table(spark, folder, "attack_view"))


_STATES = f"with {REQUESTS_SQL}, {Q.STATES_SQL}"
_COMPARED = ", ".join(f"coalesce(max(c) filter (where fam = '{f}'), 0) as n_{f}" for f in S.COMPARED)


@query("q_agent_states", _STATES + f", y as (select request_id, sum(v::hugeint)::varchar as total from st where fam in ('replay', 'initial', 'tool', 'resources') group by 1) select sq.request_id, second, n as message_count, {_COMPARED}, coalesce(any_value(y.total), '0') as total from sq left join sn using (request_id) left join y using (request_id) group by 1, 2, 3")
def _agent_states(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the compared lists, and the sum of the hashed values."""
    s = _states(spark, folder)
    total = sum((F.aggregate(c, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(30,0)")).cast("decimal(38,0)")) for c in ("initial", "tool", "resources")), F.aggregate("replay", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(30,0)")).cast("decimal(38,0)")))
    return s.select("request_id", "second", F.col("message_count").cast("long").alias("message_count"), *[F.size(c).cast("long").alias(f"n_{c}") for c in S.COMPARED], total.cast("decimal(38,0)").cast("string").alias("total"))


@query("q_state_counts", f"with {REQUESTS_SQL} select request_id, cast(floor(ms / 1000.0) as bigint) as second, coalesce(len(messages), 0)::bigint as message_count, cast(coalesce(list_sum(list_transform(messages, lambda m: length(coalesce(m.content, '')))), 0) as bigint) as content_chars from req")
def _state_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _states(spark, folder).select("request_id", "second", F.col("message_count").cast("long").alias("message_count"), F.col("content_chars").cast("long").alias("content_chars"))


@query("q_link_decisions", f"{_STATES}, {Q.decisions_sql()} select * from dc")
def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "states")
    return K.link_states(scratch.save(_states(spark, folder), "states"))


_LINKED = f"{_STATES.replace('with ', 'with recursive ', 1)}, {Q.decisions_sql()}, de as (select request_id as u, predecessor_id as v from dc where disposition = 'accept' union select predecessor_id, request_id from dc where disposition = 'accept'), dl(id, label) as (select request_id, request_id from sq union select de.v, dl.label from dl join de on dl.id = de.u), ds as materialized (select id as request_id, min(label) as label from dl group by id)"
_SCORED = f"""cells as (select p.label as p, t.label as t, count(*) as n from ds p join {truth_sql("session")} t using (request_id) group by 1, 2), x as (select (select sum(n*(n-1)/2) from cells) as hits, (select sum(n*(n-1)/2) from (select sum(n) as n from cells group by p)) as predicted, (select sum(n*(n-1)/2) from (select sum(n) as n from cells group by t)) as positive, (select sum(n) from cells) as items, (select count(distinct p) from cells) as clusters, (select count(distinct t) from cells) as truths,
 (select sum(m) from (select max(n) as m from cells group by p)) as most, (select count(*) from (select p from cells group by p having count(*) > 1)) as merged, (select count(*) from (select t from cells group by t having count(*) > 1)) as split)
select cast(items as bigint) as items, clusters, hits/predicted as precision, hits/positive as recall, 2*(hits/predicted)*(hits/positive)/((hits/predicted)+(hits/positive)) as f1, most/items as purity, split/truths as split_rate, merged/clusters as merge_rate from x"""


@query("q_link_metrics", f"{_LINKED}, {_SCORED}")
def _link_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Pair metrics of the sessions that accepted links make."""
    pred, _ = _linked(spark, folder)
    return E.clustering_metrics(pred, truth_labels(table(spark, folder, "request_identity"), "session"))


def _linked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Sessions of accepted links, and the states."""
    scratch = Scratch(spark, "states")
    states = scratch.save(_states(spark, folder), "states")
    links = K.link_states(states).where("disposition = 'accept'").select(F.col("request_id").alias("u"), F.col("predecessor_id").alias("v"))
    pred = components(links, states.select(F.col("request_id").alias("id"))).withColumnRenamed("id", "request_id")
    return scratch.save(pred, "sessions"), states


_HIGHER = """hs as (select request_id, split_part(fam, '_', 1) as level, v as h from st where fam in ('user_handles', 'org_handles') or (fam = 'project_handles' and split_part(v, ':', 2) in ('repository', 'workspace', 'order', 'reservation', 'booking', 'ticket'))),
he as (select distinct level, min(request_id) over (partition by level, h) as u, request_id as v from hs union select level, label, request_id from ds, (select unnest(['user', 'project', 'org']) as level)), hb as materialized (select level, u, v from he where u <> v union select level, v, u from he where u <> v),
hc(level, id, label) as (select level, request_id, request_id from sq, (select unnest(['user', 'project', 'org']) as level) union select hb.level, hb.v, hc.label from hc join hb on hc.level = hb.level and hc.id = hb.u)"""


@query("q_higher_levels", f"{_LINKED}, {_HIGHER} select level, id as request_id, min(label) as label from hc group by 1, 2")
def _higher(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of accepted links, merged above the session by the handles they share."""
    return S.higher_levels(*_linked(spark, folder))


for _variant in [v for v in S.VARIANTS if v != "full"]:

    @query(f"q_link_{_variant}", f"{_STATES}, {Q.decisions_sql(_variant)} select disposition, reason, count(*) as n_requests, round(sum(score), 6) as total_score from dc group by all")
    def _ablated(spark: SparkSession, folder: str, variant: str = _variant) -> DataFrame:
        """Decisions under a variant of the rules, by what they are."""
        scratch = Scratch(spark, "states")
        d = K.link_states(scratch.save(_states(spark, folder), "states"), S.VARIANTS[variant])
        return d.groupBy("disposition", "reason").agg(F.count("*").alias("n_requests"), F.round(F.sum("score"), 6).alias("total_score"))


@query("q_link_stream", f"{_STATES}, {Q.decisions_sql()} select request_id, predecessor_id, disposition, score, reason from dc join sq using (request_id) where second is not null")
def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """The stream linker over the whole log, played as files in order of event time; the batch's decisions on all requests with an instant."""
    scratch = Scratch(spark, "stream")
    states = scratch.save(_states(spark, folder), "states")
    states.where("second is not null").repartitionByRange("second").sortWithinPartitions("second", "request_id").write.parquet(scratch.path("source"))
    read = spark.readStream.schema(states.schema).parquet(scratch.path("source"))
    K.link_stream(read).writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("marks")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(K.DECISIONS).parquet(scratch.path("out")).drop("active")


@query(
    "q_event_sessions",
    "with e as (select user_id, epoch_us(ts) // 1000 as ms from events where user_id is not null and ts is not null), f as (select *, case when ms - lag(ms) over (partition by user_id order by ms) <= 1800000 then 0 else 1 end as o from e), s as (select *, sum(o) over (partition by user_id order by ms rows unbounded preceding) as run from f) select cast(user_id as varchar) as user_id, min(ms) as start_ms, max(ms) as end_ms, count(*) as n_events from s group by user_id, run",
)
def _event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return sessionize(e, ["user_id"], "ms", 1_800_000)


@query(
    "q_peak_concurrency",
    "with e as (select user_id, epoch_us(ts) // 1000 as ms from events where user_id is not null and ts is not null), s as (select ms as t, 1 as d from e union all select ms + 600000, -1 from e), g as (select t, d, sum(d) as s from s group by t, d), r as (select sum(s) over (order by t, d rows unbounded preceding) as open from g) select cast(max(open) as bigint) as peak from r",
)
def _peak(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("user_id is not null").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("a")).withColumn("b", F.col("a") + 600_000)
    return K.peak_concurrency(e, "a", "b")


@query("q_tumbling_counts", "select epoch_ms(time_bucket(interval '10 minutes', ts)) as start_ms, event_type, count(*) as n_events, round(sum(value), 4) as total from events where ts is not null group by all")
def _tumbling(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").where("ts is not null")
    g = e.groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n_events", "total")
