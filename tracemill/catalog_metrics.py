"""Queries of cluster and selection metrics.

The prediction is the cache bucket, a label every request has; truth is only
joined here, for evaluation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation as E
from .operators.requests import LEVELS, REQUESTS_SQL, all_truth, canonical_requests, truth_labels, truth_sql
from .queries import query, table


def _pred(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_requests(table(spark, folder, "attack_view")).select("request_id", F.col("bucket").alias("label"))


def _truth(spark: SparkSession, folder: str, level: str) -> DataFrame:
    return truth_labels(table(spark, folder, "request_identity"), level)


def _cells(level: str) -> str:
    return f"with {REQUESTS_SQL}, b as (select bucket as p, label as t, request_id from req join {truth_sql(level)} using (request_id)), cells as (select p, t, count(*) as n from b group by p, t)"


_PAIRS = "coalesce(sum(n * (n - 1) / 2), 0)"
_METRICS = """
x as (select (select coalesce(sum(n*(n-1)/2),0) from cells) as hits,
  (select coalesce(sum(n*(n-1)/2),0) from (select sum(n) as n from cells group by p)) as predicted,
  (select coalesce(sum(n*(n-1)/2),0) from (select sum(n) as n from cells group by t)) as positive,
  (select sum(n) from cells) as items, (select count(distinct p) from cells) as clusters, (select count(distinct t) from cells) as truths,
  (select sum(m) from (select max(n) as m from cells group by p)) as most,
  (select count(*) from (select p from cells group by p having count(*) > 1)) as merged,
  (select count(*) from (select t from cells group by t having count(*) > 1)) as split)"""


for _level in LEVELS:

    @query(
        f"q_clustering_{_level}",
        _cells(_level)
        + ","
        + _METRICS
        + " select cast(items as bigint) as items, clusters, hits/predicted as precision, hits/positive as recall, 2*(hits/predicted)*(hits/positive)/((hits/predicted)+(hits/positive)) as f1, most/items as purity, split/truths as split_rate, merged/clusters as merge_rate from x",
    )
    def _clustering(spark: SparkSession, folder: str, level: str = _level) -> DataFrame:
        return E.clustering_metrics(_pred(spark, folder), _truth(spark, folder, level))


@query("q_pair_confusion", _cells("user") + "," + _METRICS + " select cast(items as bigint) as items, cast(items*(items-1)/2 as bigint) as total_pairs, cast(hits as bigint) as tp, cast(predicted-hits as bigint) as fp, cast(positive-hits as bigint) as fn, cast(items*(items-1)/2-predicted-positive+hits as bigint) as tn from x")
def _confusion(spark: SparkSession, folder: str) -> DataFrame:
    return E.pair_confusion(_pred(spark, folder), _truth(spark, folder, "user"))


@query(
    "q_cross_workflow",
    f"""with {REQUESTS_SQL}, b as (select bucket as p, t.label as t, w.label as w from req join {truth_sql("project")} t using (request_id) join {truth_sql("session")} w using (request_id)),
x as (select (select {_PAIRS} from (select count(*) as n from b group by p, t)) - (select {_PAIRS} from (select count(*) as n from b group by p, t, w)) as hits,
 (select {_PAIRS} from (select count(*) as n from b group by p)) - (select {_PAIRS} from (select count(*) as n from b group by p, w)) as predicted,
 (select {_PAIRS} from (select count(*) as n from b group by t)) - (select {_PAIRS} from (select count(*) as n from b group by t, w)) as positive)
select cast(hits as bigint) as tp, cast(predicted as bigint) as predicted_pairs, cast(positive as bigint) as truth_pairs, coalesce(hits/nullif(predicted,0),0) as precision, coalesce(hits/nullif(positive,0),0) as recall,
 coalesce(2*(hits/nullif(predicted,0))*(hits/nullif(positive,0))/nullif((hits/nullif(predicted,0))+(hits/nullif(positive,0)),0),0) as f1 from x""",
)
def _cross(spark: SparkSession, folder: str) -> DataFrame:
    return E.cross_workflow_metrics(_pred(spark, folder), _truth(spark, folder, "project"), _truth(spark, folder, "session"))


_ALL_TRUTH = " union all ".join(f"select '{k}' as level, request_id, label from {truth_sql(k)}" for k in LEVELS)


@query(
    "q_evaluate_all_levels",
    f"""with {REQUESTS_SQL}, tr as ({_ALL_TRUTH}), b as (select level, bucket as p, label as t from req join tr using (request_id)), cells as (select level, p, t, count(*) as n from b group by all),
a as (select level, sum(n*(n-1)/2) as hits, cast(sum(n) as bigint) as items from cells group by level),
c as (select level, sum(n*(n-1)/2) as predicted, count(*) as clusters from (select level, p, sum(n) as n from cells group by all) group by level),
d as (select level, sum(n*(n-1)/2) as positive from (select level, t, sum(n) as n from cells group by all) group by level)
select level, items, clusters, coalesce(hits/nullif(predicted,0),0) as precision, coalesce(hits/nullif(positive,0),0) as recall, coalesce(2*(hits/nullif(predicted,0))*(hits/nullif(positive,0))/nullif((hits/nullif(predicted,0))+(hits/nullif(positive,0)),0),0) as f1 from a join c using (level) join d using (level)""",
)
def _all(spark: SparkSession, folder: str) -> DataFrame:
    truth = all_truth(table(spark, folder, "request_identity"))
    pred = _pred(spark, folder).select(F.explode(F.array(*map(F.lit, LEVELS))).alias("level"), "request_id", "label")
    return E.evaluate_all(pred, truth, ["level"])


@query("q_false_merges", _cells("project") + ", e as (select p, sum(n) as n, count(*) as k, sum(n*(n-1)/2) as good from cells group by p having count(*) > 1) select count(*) as mixed_clusters, cast(sum(n) as bigint) as contaminated, cast(sum(n*(n-1)/2 - good) as bigint) as false_pairs, cast(sum(k-1) as bigint) as bridges, sum(n*(n-1)/2 - good)/sum(k-1) as amplification from e")
def _false(spark: SparkSession, folder: str) -> DataFrame:
    return E.false_merges(_pred(spark, folder), _truth(spark, folder, "project"))


@query("q_cost_ratios", _cells("session") + "," + _METRICS + ", y as (select predicted-hits as fp, positive-hits as fn, items*(items-1)/2-positive as neg from x), w as (select unnest([0.1,1.0,10.0,100.0])::double as weight) select weight, cast(fp as bigint) as fp, cast(fn as bigint) as fn, weight*fp+fn as cost, fp*1e6/neg as false_per_million from y, w")
def _cost(spark: SparkSession, folder: str) -> DataFrame:
    return E.cost_ratios(_pred(spark, folder), _truth(spark, folder, "session"))


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "link_decision").where(F.trim("request_id") != "")
    return d.select(F.trim("request_id").alias("request_id"), F.when(F.trim("predecessor_id") != "", F.trim("predecessor_id")).alias("predecessor_id"), "disposition", "score")


_DECISIONS = "d as (select trim(request_id) as request_id, case when trim(predecessor_id) <> '' then trim(predecessor_id) end as predecessor_id, disposition, score from link_decision where trim(request_id) <> '')"


@query(
    "q_selective",
    f"""with {_DECISIONS}, t as {truth_sql("session")}, r as (select d.*, a.label as own, b.label as theirs from d join t a on d.request_id = a.request_id left join t b on d.predecessor_id = b.request_id)
select count(*) as decisions, count(*) filter (where disposition='accept' and predecessor_id is not null) as accepted,
 count(*) filter (where disposition='accept' and predecessor_id is not null and own = theirs) / count(*) filter (where disposition='accept' and predecessor_id is not null) as precision,
 count(*) filter (where disposition='accept' and predecessor_id is not null) / count(*) as coverage, count(*) filter (where disposition='reject') / count(*) as rejected_share, count(*) filter (where disposition='abstain') / count(*) as abstained_share from r""",
)
def _selective(spark: SparkSession, folder: str) -> DataFrame:
    return E.selective_metrics(_decisions(spark, folder), _truth(spark, folder, "session"))


_THRESHOLDS = [2.0, 3.0, 4.0, 4.2, 5.0, 6.0, 7.0]


@query(
    "q_risk_coverage",
    f"""with {_DECISIONS}, t as {truth_sql("session")}, r as (select d.*, a.label as own, b.label as theirs from d join t a on d.request_id = a.request_id left join t b on d.predecessor_id = b.request_id), w as (select unnest({_THRESHOLDS})::double as threshold),
x as (select threshold, count(*) filter (where disposition='accept' and predecessor_id is not null and score >= threshold) as accepted, count(*) filter (where disposition='accept' and predecessor_id is not null and score >= threshold and own = theirs) as good, count(*) as n from r, w group by threshold)
select threshold, accepted, coalesce(good/nullif(accepted,0),0) as precision, accepted/n as coverage from x""",
)
def _risk(spark: SparkSession, folder: str) -> DataFrame:
    return E.risk_coverage(_decisions(spark, folder), _truth(spark, folder, "session"), _THRESHOLDS)


@query(
    "q_order_accuracy",
    f"""with {REQUESTS_SQL}, i as (select request_id, min(trim(workflow_id)) as w, min(turn_id) as turn from request_identity where request_id is not null and lower(trim(workflow_id)) not in ('','none','null','unknown','n/a') and turn_id is not null group by request_id),
r as (select w, turn, row_number() over (partition by w order by ms nulls first, request_id) as rk from req join i using (request_id)),
a as (select turn, lead(turn) over (partition by w order by rk) as nx from r)
select (select count(*) from a where nx is not null) as adjacent_pairs, (select count(*) from r x join r y on x.w = y.w and x.turn < y.turn) as ordered_pairs,
 (select count(*) filter (where nx >= turn) / count(*) from a where nx is not null) as adjacent_accuracy, (select count(*) filter (where x.rk < y.rk) / count(*) from r x join r y on x.w = y.w and x.turn < y.turn) as pairwise_accuracy""",
)
def _order(spark: SparkSession, folder: str) -> DataFrame:
    identity = table(spark, folder, "request_identity")
    from .functions.labels import present

    i = identity.where("request_id is not null and turn_id is not null").select("request_id", present(F.col("workflow_id")).alias("w"), "turn_id").where("w is not null").groupBy("request_id").agg(F.min("w").alias("w"), F.min("turn_id").alias("turn_id"))
    rows = canonical_requests(table(spark, folder, "attack_view")).join(i, "request_id")
    return E.ordering_accuracy(rows, "w", "turn_id", ["ms", "request_id"])


@query("q_equivalence_bound", "with k as (select unnest([1,2,4,9]) as k), m as (select unnest([2,4,8]) as m) select k, m, (m-1)/(k*m-1) as precision, 2*((m-1)/(k*m-1))/(1+(m-1)/(k*m-1)) as f1 from k, m")
def _bound(spark: SparkSession, folder: str) -> DataFrame:
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, [1, 2, 4, 9]))).alias("k")).select("k", F.explode(F.array(*map(F.lit, [2, 4, 8]))).alias("m"))
    p, f = E.equivalence_bound(F.col("k"), F.col("m"))
    return one.select("k", "m", p.alias("precision"), f.alias("f1"))


@query(
    "q_js_divergence",
    f"""with {REQUESTS_SQL}, a as (select model, count(*) as n from req where ms % 2 = 0 group by model), b as (select model, count(*) as m from req where ms % 2 = 1 group by model),
j as (select coalesce(n,0)/(select sum(n) from a) as p, coalesce(m,0)/(select sum(m) from b) as q from a full join b on a.model is not distinct from b.model)
select round(sum((case when p>0 then p*log2(p/((p+q)/2)) else 0 end + case when q>0 then q*log2(q/((p+q)/2)) else 0 end)/2), 9) as js_divergence from j""",
)
def _js(spark: SparkSession, folder: str) -> DataFrame:
    r = canonical_requests(table(spark, folder, "attack_view"), "model")
    return E.js_divergence(r.where("ms % 2 = 0"), r.where("ms % 2 = 1"), "model").select(F.round("js_divergence", 9).alias("js_divergence"))


@query(
    "q_ks_statistic",
    f"""with {REQUESTS_SQL}, e as (select token_count as v, count(*) filter (where ms % 2 = 0) as x, count(*) filter (where ms % 2 = 1) as y from req where token_count is not null and ms is not null group by token_count),
c as (select sum(x) over (order by v rows unbounded preceding) as cx, sum(y) over (order by v rows unbounded preceding) as cy from e)
select max(abs(cx/(select sum(x) from e) - cy/(select sum(y) from e))) as ks_statistic from c""",
)
def _ks(spark: SparkSession, folder: str) -> DataFrame:
    r = canonical_requests(table(spark, folder, "attack_view"), "token_count")
    return E.ks_statistic(r.where("ms % 2 = 0"), r.where("ms % 2 = 1"), "token_count")


def _resampled(labels: str, name: str) -> str:
    """CTE of F1 by iteration of ``labels`` (request_id, p) against users, over resamples of organisations."""
    w = " + ".join(f"(d > {x!r})::int" for x in E.POISSON)
    pair = "n * (n - 1) / 2"

    def pairs(alias: str, *keys: str) -> str:
        k = ", ".join(keys)
        return f"""{name}_{alias} as (select iteration, (select sum(s * (s - 1) / 2) from (select iteration, {k}, sum(n * w) as s from {name}_e group by all) q where q.iteration = o.iteration) - (select sum(n * w * (w - 1) / 2) from {name}_e q where q.iteration = o.iteration) - (select sum((w * w - w) * {pair}) from (select iteration, {k}, u, sum(n) as n, max(w) as w from {name}_e group by all) q where q.iteration = o.iteration) as {alias} from (select distinct iteration from {name}_e) o)"""

    return f"""{name}_x as (select l.p, t.label as t, u.label as u, count(*) as n from {labels} l join {truth_sql("user")} t using (request_id) join {truth_sql("org")} u using (request_id) group by all), {name}_d as (select u, iteration, ('0x' || substring(sha256('7:' || u || ':' || iteration), 1, 12))::ubigint / 281474976710656.0 as d from (select distinct u from {name}_x), (select unnest(range(0, 100)) as iteration)),
{name}_w as (select u, iteration, {w} as w from {name}_d), {name}_e as materialized (select * from {name}_x join {name}_w using (u) where w > 0), {pairs("pt", "p", "t")}, {pairs("pp", "p")}, {pairs("tt", "t")},
{name} as (select iteration, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from (select iteration, case when pp <> 0 then pt / pp else 0 end as p, case when tt <> 0 then pt / tt else 0 end as r from {name}_pt join {name}_pp using (iteration) join {name}_tt using (iteration)))"""


_BUCKETS = "(select request_id, bucket as p from req)"
_HOURS = "(select request_id, coalesce(ms // 3600000, -1)::varchar as p from req)"


@query("q_bootstrap_interval", f"with {REQUESTS_SQL}, {_resampled(_BUCKETS, 'b')} select avg(f1) as mean, quantile_cont(f1, 0.025) as low, quantile_cont(f1, 0.975) as high, count(*) as iterations from b")
def _bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of the user-level F1 over 100 resamples of users' organisations."""
    samples = E.bootstrap_f1(_pred(spark, folder), _truth(spark, folder, "user"), _truth(spark, folder, "org"), 100, 7)
    return E.confidence_interval(samples)


@query("q_paired_bootstrap", f"with {REQUESTS_SQL}, {_resampled(_BUCKETS, 'b')}, {_resampled(_HOURS, 'h')}, d as (select b.f1 as a, h.f1 as c, b.f1 - h.f1 as d from b join h using (iteration)) select avg(a) as left_f1, avg(c) as right_f1, avg(d) as difference, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high, avg((d > 0)::int) as left_ahead from d")
def _paired(spark: SparkSession, folder: str) -> DataFrame:
    """Cache buckets against hours as labels of users, over the same resamples of organisations."""
    hours = canonical_requests(table(spark, folder, "attack_view")).select("request_id", F.coalesce(F.floor(F.col("ms") / 3_600_000), F.lit(-1)).cast("string").alias("label"))
    return E.paired_bootstrap(_pred(spark, folder), hours, _truth(spark, folder, "user"), _truth(spark, folder, "org"), 100, 7)


def _weighted(*keys: str) -> str:
    return f"(select coalesce(sum((s * s - q) / 2), 0) from (select sum(w) as s, sum(w * w) as q from x group by {', '.join(keys)}))"


@query(
    "q_weighted_cross_workflow",
    f"""with {REQUESTS_SQL}, x as (select bucket as p, t.label as t, f.label as f, 1 + coalesce(token_count, 0) % 3 as w from req join {truth_sql("project")} t using (request_id) join {truth_sql("session")} f using (request_id)),
y as (select {_weighted("p", "t")} - {_weighted("p", "t", "f")} as h, {_weighted("p")} - {_weighted("p", "f")} as a, {_weighted("t")} - {_weighted("t", "f")} as b), z as (select case when a <> 0 then h / a else 0 end as precision, case when b <> 0 then h / b else 0 end as recall from y)
select precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from z""",
)
def _weighted_cross(spark: SparkSession, folder: str) -> DataFrame:
    weights = canonical_requests(table(spark, folder, "attack_view"), "token_count").select("request_id", (F.lit(1) + F.coalesce("token_count", F.lit(0)) % 3).cast("long").alias("weight"))
    return E.weighted_cross_f1(_pred(spark, folder), _truth(spark, folder, "project"), _truth(spark, folder, "session"), weights)
