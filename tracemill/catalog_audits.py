"""Queries of audits, reconstruction, candidate stages, set operations and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as X
from .functions.instants import instant_millis
from .functions.labels import present
from .operators import audits as A
from .operators import blocking as B
from .operators import evaluation as E
from .operators import linkage as L
from .operators import transforms as T
from .operators import workflows as W
from .operators.components import components
from .operators.requests import REQUESTS_SQL, TEXT_SQL, all_truth, canonical_requests, request_text, truth_labels, truth_sql
from .queries import query, table
from .scratch import Scratch

_DOMAIN = r"'\b(?:[a-z0-9-]+\.)+(?:internal|local|prod|corp)\b'"
#: Requests, their domains as anchors, and truth of a level with its workflow.
_A = f"{REQUESTS_SQL}, anc as (select distinct request_id, unnest(regexp_extract_all(lower({TEXT_SQL}), {_DOMAIN})) as anchor from req)"


def _tr(level: str) -> str:
    return f"tr as (select l.request_id, l.label, w.label as workflow from {truth_sql(level)} l left join {truth_sql('session')} w using (request_id))"


def _requests(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return canonical_requests(table(spark, folder, "attack_view"), *columns)


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    r = _requests(spark, folder, "messages")
    return r.select("request_id", F.explode(X.domains(F.lower(request_text(F.col("messages"))))).alias("anchor"))


def _truth(spark: SparkSession, folder: str, level: str) -> DataFrame:
    i = table(spark, folder, "request_identity")
    return truth_labels(i, level).join(truth_labels(i, "session").withColumnRenamed("label", "workflow"), "request_id", "left")


@query(
    "q_exposure",
    f"""with {_A}, {_tr("org")}, s as (select request_id, count(*) as n, max((anchor = label)::int) as r from anc join tr using (request_id) group by 1), x as (select tr.*, coalesce(n, 0) as n, coalesce(r, 0) as r from tr left join s using (request_id)),
w as (select max(r) as a, min(r) as e from x where workflow is not null group by workflow), e as (select max(r) as m from x group by label)
select count(*) as requests, (select count(*) from w) as workflows, (select count(*) from e) as entities, avg((n > 0)::int) as coverage, avg(r) as exact_share, avg((n > 1)::int) as ambiguous_share, avg((n > 0 and r = 0)::int) as incorrect_share,
 (select avg(a) from w) as workflow_any, (select avg(e) from w) as workflow_all, (select avg(m) from e) as entity_any from x""",
)
def _exposure(spark: SparkSession, folder: str) -> DataFrame:
    return A.exposure(_truth(spark, folder, "org"), _anchors(spark, folder))


@query(
    "q_handle_audit",
    f"""with {_A}, {_tr("user")}, e as (select anchor, count(distinct request_id) as n, count(distinct workflow) as w, count(distinct label) as l from anc join tr using (request_id) group by 1)
select (select count(*) from tr) as requests, (select avg((request_id in (select request_id from anc))::int) from tr) as coverage, count(*) as handles, avg((n > 1)::int) as recurrent, avg((w > 1)::int) as cross_workflow, avg((l > 1)::int) as ambiguous, median(n)::double as median_requests from e""",
)
def _handles(spark: SparkSession, folder: str) -> DataFrame:
    return A.handle_audit(_truth(spark, folder, "user"), _anchors(spark, folder))


@query(
    "q_anchor_statistics",
    f"""with {_A}, {_tr("user")}, e as (select regexp_extract(anchor, '[^.]*$') as kind, anchor, count(*) as n, count(distinct label) as l, count(distinct workflow) as w, coalesce((max(ms) - min(ms)) / 86400000.0, 0) as d from anc join req using (request_id) left join tr using (request_id) group by 1, 2)
select kind, count(*) as anchors, median(n)::double as median_occurrences, max(n) as max_occurrences, avg((l > 1)::int) as ambiguous_share, avg((w > 1)::int) as cross_workflow_share, round(median(d), 9) as median_days, round(max(d), 9) as max_days from e group by kind""",
)
def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    a = _anchors(spark, folder).withColumn("kind", F.substring_index("anchor", ".", -1))
    return A.anchor_statistics(_requests(spark, folder), _truth(spark, folder, "user"), a)


_P = "p as (select distinct bucket as block, request_id as id, anchor as value from anc join req using (request_id)), z as (select block, value, count(*) as size, min(id) as first from p group by block, value), k as (select p.* from p join z using (block, value) where size between 2 and 20), pr as (select distinct a.id as l, b.id as r from k a join k b on a.block = b.block and a.value = b.value and a.id < b.id)"


def _posted(spark: SparkSession, folder: str) -> DataFrame:
    r = _requests(spark, folder, "messages")
    return B.postings(r.select("request_id", "bucket", F.lower(request_text(F.col("messages"))).alias("text")), X.domains(F.col("text")), F.col("bucket"))


@query("q_cost_model", f"with {_A}, {_P} select (select count(*) from req) as requests, (select count(*) * (count(*) - 1) // 2 from req) as all_pairs, count(*) as candidate_pairs, round(count(*) / (select count(*) from req), 3) as pairs_per_request, round((select count(*) * (count(*) - 1) / 2 from req) / count(*), 3) as reduction from pr")
def _cost(spark: SparkSession, folder: str) -> DataFrame:
    return A.cost_model(_requests(spark, folder), B.candidate_pairs(_posted(spark, folder), 20))


# -- splits -------------------------------------------------------------------------
@query("q_stratified_split", f"with {REQUESTS_SQL}, d as (select request_id, bucket, row_number() over (partition by bucket order by sha256('7:' || request_id), request_id) as n, count(*) over (partition by bucket) as size from req) select request_id, bucket, n <= round_even(size * 0.25, 0) as held_out from d")
def _split(spark: SparkSession, folder: str) -> DataFrame:
    return A.stratified_split(_requests(spark, folder).select("request_id", "bucket"), "request_id", "bucket", 0.25)


@query("q_interval_split", f"with {REQUESTS_SQL}, s as (select org, ('0x' || substring(sha1('7:' || org), 1, 12))::ubigint / 281474976710656.0 < 0.5 as held_out from (select distinct label as org from {truth_sql('org')})) select org, held_out from s")
def _interval(spark: SparkSession, folder: str) -> DataFrame:
    orgs = truth_labels(table(spark, folder, "request_identity"), "org").select(F.col("label").alias("org")).distinct()
    return A.interval_split(orgs, "org", 0.5)


@query("q_base_tasks", "with p as (select source_workflow_id as workflow, regexp_replace(source_task_id, ':trial_[^:]+$', '') as b from request_provenance where source_task_id is not null) select workflow, min(b) as base_task from p group by workflow having min(b) = max(b)")
def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    return A.consistent_tasks(table(spark, folder, "request_provenance").withColumnRenamed("source_workflow_id", "workflow"), "workflow", "source_task_id")


# -- semi, anti and set operations -----------------------------------------------------
_LINKED = "(select trim(request_id) as request_id from link_decision where disposition = 'accept' and predecessor_id is not null and request_id is not null)"


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "link_decision").where("disposition = 'accept' and predecessor_id is not null and request_id is not null").select(F.trim("request_id").alias("request_id"))


@query("q_semi_linked", f"with {REQUESTS_SQL} select request_id, bucket from req where request_id in {_LINKED}")
def _semi(spark: SparkSession, folder: str) -> DataFrame:
    return _requests(spark, folder).join(_linked(spark, folder), "request_id", "left_semi").select("request_id", "bucket")


@query("q_anti_linked", f"with {REQUESTS_SQL} select request_id, bucket from req where request_id not in {_LINKED}")
def _anti(spark: SparkSession, folder: str) -> DataFrame:
    return _requests(spark, folder).join(_linked(spark, folder), "request_id", "left_anti").select("request_id", "bucket")


_E = "ev as (select distinct least(trim(earlier_id), trim(later_id)) as l, greatest(trim(earlier_id), trim(later_id)) as r from pair_evidence where trim(earlier_id) <> trim(later_id) and trim(earlier_id) <> '' and trim(later_id) <> ''), ld as (select distinct least(trim(request_id), trim(predecessor_id)) as l, greatest(trim(request_id), trim(predecessor_id)) as r from link_decision where trim(request_id) <> trim(predecessor_id) and trim(request_id) <> '' and trim(predecessor_id) <> '')"


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.trim(a), F.trim(b)
    return df.where((x != y) & (x != "") & (y != "")).select(F.least(x, y).alias("left"), F.greatest(x, y).alias("right")).distinct()


def _two_stages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return _pairs(table(spark, folder, "pair_evidence"), "earlier_id", "later_id"), _pairs(table(spark, folder, "link_decision"), "request_id", "predecessor_id")


for _name, _op, _word in (("q_stage_union", lambda a, b: a.union(b).distinct(), "union"), ("q_stage_intersection", lambda a, b: a.intersect(b), "intersect"), ("q_stage_difference", lambda a, b: a.subtract(b), "except")):

    @query(_name, f'with {_E} select l as "left", r as "right" from ev {_word} select l, r from ld')
    def _sets(spark: SparkSession, folder: str, op=_op) -> DataFrame:
        return op(*_two_stages(spark, folder))


@query("q_truth_pairs", f'with t as (select request_id, label from {truth_sql("session")}) select a.request_id as "left", b.request_id as "right" from t a join t b on a.label = b.label and a.request_id < b.request_id')
def _truth_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of requests of one workflow; a workflow is bounded by its turns."""
    t = truth_labels(table(spark, folder, "request_identity"), "session")
    a, b = t.select("label", F.col("request_id").alias("left")), t.select("label", F.col("request_id").alias("right"))
    return a.join(b, "label").where(F.col("left") < F.col("right")).select("left", "right")


# -- candidate stages, sweep ----------------------------------------------------------
@query(
    "q_candidate_stages",
    f"""with {_A}, {_P}, {_E}, t as (select request_id, label from {truth_sql("session")}), s as (select 'domains' as stage, l, r from pr union all select 'evidence', l, r from ev union all select 'decisions', l, r from ld), u as (select * from s union all select distinct 'union', l, r from s),
m as (select stage, count(*) as c, count(*) filter (where a.label = b.label) as h from u join t a on a.request_id = u.l join t b on b.request_id = u.r group by stage), n as (select coalesce(sum(n * (n - 1) / 2), 0)::bigint as total from (select count(*) as n from t group by label))
select stage, c as candidate_pairs, h as true_pairs, total as truth_pairs, h / total as recall, h / c as precision from m, n""",
)
def _stages(spark: SparkSession, folder: str) -> DataFrame:
    ev, ld = _two_stages(spark, folder)
    return W.candidate_stages({"domains": B.candidate_pairs(_posted(spark, folder), 20), "evidence": ev, "decisions": ld}, truth_labels(table(spark, folder, "request_identity"), "session"))


_GRID = [(a, b) for a in (3.0, 4.2, 5.0) for b in (0.5, 0.75)]
_SWEEP = f"""with recursive {REQUESTS_SQL}, ev as (select least(trim(earlier_id), trim(later_id)) as l, greatest(trim(earlier_id), trim(later_id)) as r, max(score) as score, max(replay_containment) as replay from pair_evidence where trim(earlier_id) <> trim(later_id) and trim(earlier_id) <> '' and trim(later_id) <> '' group by 1, 2),
g as (select * from (values {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_GRID))}) as v(i, a, b)), k as (select i, l, r from ev, g where score >= a and replay >= b), e as (select i, l as u, r as v from k union select i, r, l from k),
c(i, id, label) as (select i, request_id, request_id from req, g union select e.i, e.v, c.label from c join e on c.i = e.i and c.id = e.u), lab as (select i, id as request_id, min(label) as p from c group by 1, 2),
x as (select i, p, t.label as t, count(*) as n from lab join {truth_sql("session")} t using (request_id) group by 1, 2, 3), h as (select i, sum(n * (n - 1) / 2) as hits from x group by i), pp as (select i, sum(n * (n - 1) / 2) as predicted, count(*) as clusters from (select i, p, sum(n) as n from x group by 1, 2) group by i), tt as (select i, sum(n * (n - 1) / 2) as positive from (select i, t, sum(n) as n from x group by 1, 2) group by i),
y as (select g.a as first_least, g.b as second_least, coalesce((select count(*) from k where k.i = g.i), 0) as linked_pairs, clusters, case when predicted > 0 then hits / predicted else 0 end as precision, case when positive > 0 then hits / positive else 0 end as recall from g join h using (i) join pp using (i) join tt using (i)),
f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from y) select first_least::double as first_least, second_least::double as second_least, linked_pairs, clusters, precision, recall, f1 from f"""


def _sweep_frame(spark: SparkSession, folder: str) -> DataFrame:
    x, y = F.trim("earlier_id"), F.trim("later_id")
    scored = table(spark, folder, "pair_evidence").where((x != y) & (x != "") & (y != "")).groupBy(F.least(x, y).alias("left"), F.greatest(x, y).alias("right")).agg(F.max("score").alias("score"), F.max("replay_containment").alias("replay"))
    requests = _requests(spark, folder).select("request_id")
    known = scored.join(requests.withColumnRenamed("request_id", "left"), "left", "left_semi").join(requests.withColumnRenamed("request_id", "right"), "right", "left_semi")
    return W.threshold_sweep(known, "score", "replay", _GRID, requests, truth_labels(table(spark, folder, "request_identity"), "session"))


_KNOWN_SWEEP = _SWEEP.replace("group by 1, 2),\ng as", "group by 1, 2 having l in (select request_id from req) and r in (select request_id from req)),\ng as", 1)


@query("q_threshold_sweep", _KNOWN_SWEEP)
def _sweep(spark: SparkSession, folder: str) -> DataFrame:
    return _sweep_frame(spark, folder)


@query("q_best_threshold", _KNOWN_SWEEP + " order by (precision >= 0.8) desc, f1 desc, precision desc, recall desc, first_least desc, second_least desc limit 1")
def _best(spark: SparkSession, folder: str) -> DataFrame:
    return W.best_point(_sweep_frame(spark, folder))


# -- nesting and workflows ------------------------------------------------------------
_NEST = f"""mm as (select request_id, case when coalesce(len(messages), 0) = 0 then [''] else list_transform(messages, lambda m: sha256(coalesce(length(m.role)::varchar || ':' || m.role, '-') || coalesce(length(m.name)::varchar || ':' || m.name, '-') || coalesce(length(m.content)::varchar || ':' || m.content, '-'))) end as h from req),
pf as (select request_id, array_to_string(h[1:i], ',') as d, i = len(h) as whole from (select *, unnest(range(1, len(h) + 1)) as i from mm)), ff as (select d, min(request_id) as first from pf where whole group by d),
e0 as (select distinct first as u, request_id as v from pf join ff using (d) where first <> request_id)"""


@query("q_nesting_links", f"with {REQUESTS_SQL}, {_NEST} select u, v from e0")
def _nest(spark: SparkSession, folder: str) -> DataFrame:
    return W.nesting_links(_requests(spark, folder, "messages"))


@query("q_nesting_labels", f"with recursive {REQUESTS_SQL}, {_NEST}, e as (select u, v from e0 union select v, u from e0), c(id, label) as (select request_id, request_id from req union select e.v, c.label from c join e on c.id = e.u) select id as request_id, min(label) as label from c group by id")
def _nest_labels(spark: SparkSession, folder: str) -> DataFrame:
    return W.nesting_labels(_requests(spark, folder, "messages"))


#: Sessions: the components of accepted decisions among known requests.
_SESSIONS = f"""ac as (select distinct trim(request_id) as u, trim(predecessor_id) as v from link_decision where disposition = 'accept' and trim(request_id) in (select request_id from req) and trim(predecessor_id) in (select request_id from req)),
ae as (select u, v from ac where u <> v union select v, u from ac where u <> v), ar(id, label) as (select request_id, request_id from req union select ae.v, ar.label from ar join ae on ar.id = ae.u), lab as (select id as request_id, min(label) as label from ar group by id)"""


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    r = _requests(spark, folder).select("request_id")
    links = table(spark, folder, "link_decision").where("disposition = 'accept'").select(F.trim("request_id").alias("u"), F.trim("predecessor_id").alias("v"))
    known = links.join(r.withColumnRenamed("request_id", "u"), "u", "left_semi").join(r.withColumnRenamed("request_id", "v"), "v", "left_semi")
    found = components(known, r.select(F.col("request_id").alias("id")))
    return Scratch(spark, "sessions").save(found.select(F.col("id").alias("request_id"), "label"), "sessions")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "request_identity").where("request_id is not null")
    return i.groupBy("request_id").agg(F.min(present(F.col("workflow_id"))).alias("workflow"), F.min("turn_id").alias("turn"))


_RECON = f"""{_NEST.split("ff as")[0].rstrip().rstrip(",")}, own as (select lab.label, r.request_id, r.ms, length({TEXT_SQL}) as size from req r join lab using (request_id)),
wd as (select label, d, count(*) as n from pf join own using (request_id) where whole group by 1, 2), pc as (select pf.request_id, sum(wd.n) - 1 as predecessors from pf join own using (request_id) join wd on wd.label = own.label and wd.d = pf.d group by 1),
tn as (select request_id, min(case when lower(trim(workflow_id)) not in ('', 'none', 'null', 'unknown', 'n/a') then trim(workflow_id) end) as workflow, min(turn_id) as turn from request_identity where request_id is not null group by 1),
o as (select own.label, request_id, ms, workflow, turn, row_number() over (partition by own.label order by predecessors, coalesce(floor(ms / 60000.0), -1), size, request_id) as position from own join pc using (request_id) left join tn using (request_id)),
w as (select label, count(*) as requests, arg_min(coalesce(ms, -1), position) as s, arg_max(coalesce(ms, -1), position) as f from o group by label), mj as (select * from (select label, workflow, count(*) as n, row_number() over (partition by label order by count(*) desc, workflow) as r from o where workflow is not null group by 1, 2) where r = 1),
b as (select o.label, request_id, position, row_number() over (partition by o.label order by turn nulls first, request_id) as t, lead(position) over (partition by o.label order by turn nulls first, request_id) as nx from o join mj on o.label = mj.label and o.workflow = mj.workflow),
ad as (select label, avg((position < nx)::int) as adjacent from b where nx is not null group by 1), pw as (select a.label, avg((a.position < c.position)::int) as pairwise from b a join b c on a.label = c.label and a.t < c.t group by 1),
rec as (select w.label, requests, nullif(s, -1) as start_ms, nullif(f, -1) as end_ms, mj.workflow as majority_workflow, coalesce(mj.n, 0) as majority_requests, coalesce(mj.n / requests, 0) as purity, coalesce(pairwise, 0) as pairwise_order, coalesce(adjacent, 0) as adjacent_order from w left join mj using (label) left join ad using (label) left join pw using (label))"""


def _reconstructed(spark: SparkSession, folder: str) -> DataFrame:
    return W.reconstruct(_requests(spark, folder, "messages"), _sessions(spark, folder), _turns(spark, folder))


@query("q_workflows", f"with recursive {REQUESTS_SQL}, {_SESSIONS}, {_RECON} select * from rec")
def _workflows(spark: SparkSession, folder: str) -> DataFrame:
    return _reconstructed(spark, folder)


@query("q_workflow_summary", f"with recursive {REQUESTS_SQL}, {_SESSIONS}, {_RECON} select count(*) as workflows, sum(requests)::bigint as requests, avg(purity) as mean_purity, avg(pairwise_order) as mean_pairwise_order, avg(adjacent_order) as mean_adjacent_order from rec")
def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return W.reconstruction_summary(_reconstructed(spark, folder))


# -- controls, pivots, samples --------------------------------------------------------
def _plain(spark: SparkSession, folder: str) -> DataFrame:
    return _requests(spark, folder).select("request_id")


@query("q_random_control", f"with {REQUESTS_SQL}, d as (select request_id, row_number() over (order by sha256('7:' || request_id), request_id) - 1 as n, greatest(1, round_even(sqrt((select count(*) from req)), 0)::bigint) as k from req) select 'random' as method, unnest(['session', 'user', 'project', 'org']) as level, request_id, cast(n % k as varchar) as label from d")
def _random(spark: SparkSession, folder: str) -> DataFrame:
    return L.random_control(_plain(spark, folder))


_EVERY_TRUTH = " union all ".join(f"select '{level}' as level, request_id, label from {truth_sql(level)}" for level in ("session", "user", "project", "org"))


@query(
    "q_oracle_size_control",
    f"""with {REQUESTS_SQL}, t as ({_EVERY_TRUTH}), c as (select level, label, count(*) as size from t join req using (request_id) group by 1, 2), z as (select level, row_number() over (partition by level order by size desc, label) as cluster, sum(size) over (partition by level order by size desc, label rows unbounded preceding) as stop, size from c),
d as (select l.level, request_id, row_number() over (partition by l.level order by sha256('7:' || l.level || ':' || request_id), request_id) - 1 as at from req, (select unnest(['session', 'user', 'project', 'org']) as level) l)
select 'oracle_size_random' as method, d.level, request_id, coalesce(cluster::varchar, 'alone ' || request_id) as label from d left join z on d.level = z.level and d.at >= z.stop - z.size and d.at < z.stop""",
)
def _oracle_size(spark: SparkSession, folder: str) -> DataFrame:
    return L.oracle_size_control(_plain(spark, folder), all_truth(table(spark, folder, "request_identity")))


@query("q_hash_sample", f"with {REQUESTS_SQL} select request_id, ms, bucket from req order by sha256('7:' || request_id), request_id limit 200")
def _sample(spark: SparkSession, folder: str) -> DataFrame:
    return T.hash_sample(_requests(spark, folder), "request_id", 200)


@query("q_broker_mix", f"with {REQUESTS_SQL} select request_id, ms + cast(floor(cast(('0x' || substring(sha256('7:' || request_id), 1, 16))::ubigint as double) / 18446744073709551615.0 * 181) as bigint) * 60000 as ms, bucket, case when coalesce(token_count, 0) <= 64 then 64 when token_count <= 128 then 128 when token_count <= 256 then 256 when token_count <= 512 then 512 else 1024 end as token_count from req")
def _mix(spark: SparkSession, folder: str) -> DataFrame:
    return T.broker_mix(_requests(spark, folder, "token_count"))


_F1 = "case when p + r > 0 then 2 * p * r / (p + r) else 0 end"
_BY_LEVEL = f"""with {REQUESTS_SQL}, t as ({_EVERY_TRUTH}), x as (select level, bucket as p, label as t, count(*) as n from req join t using (request_id) group by 1, 2, 3), h as (select level, sum(n * (n - 1) / 2) as h from x group by 1), a as (select level, sum(n * (n - 1) / 2) as a from (select level, p, sum(n) as n from x group by 1, 2) group by 1), b as (select level, sum(n * (n - 1) / 2) as b from (select level, t, sum(n) as n from x group by 1, 2) group by 1), m as (select level, h / a as p, h / b as r from h join a using (level) join b using (level))"""


@query("q_summary_pivot", _BY_LEVEL + f""" select 'bucket' as method, max(case when level = 'session' then {_F1} end) as session, max(case when level = 'user' then {_F1} end) as "user", max(case when level = 'project' then {_F1} end) as project, max(case when level = 'org' then {_F1} end) as org from m""")
def _pivot(spark: SparkSession, folder: str) -> DataFrame:
    pred = _requests(spark, folder).select(F.lit("bucket").alias("method"), F.explode(F.array(*map(F.lit, L.LEVELS))).alias("level"), "request_id", F.col("bucket").alias("label"))
    metrics = E.evaluate_all(pred, all_truth(table(spark, folder, "request_identity")), ["method", "level"])
    return A.summary_pivot(metrics, "method", "level", list(L.LEVELS), "f1")


@query("q_leading_roles", f"with {REQUESTS_SQL}, r as (select bucket, coalesce(m.name, '') as name, count(*) as n from (select bucket, unnest(messages) as m from req) group by 1, 2) select bucket, name, n, rank from (select *, row_number() over (partition by bucket order by n desc, name) as rank from r) where rank <= 3")
def _leading(spark: SparkSession, folder: str) -> DataFrame:
    each = _requests(spark, folder, "messages").select("bucket", F.explode("messages").alias("m")).groupBy("bucket", F.coalesce("m.name", F.lit("")).alias("name")).agg(F.count("*").alias("n"))
    return A.leading(each, ["bucket", "name"], "n", 3).withColumn("rank", F.col("rank").cast("long"))


@query("q_late_rows", "with a as (select row_number() over () as pos, request_id, epoch_ms(try_cast(timestamp as timestamptz)) as ms from attack_view where request_id is not null) select count(*) as n_rows, count(ms) as n_timed, count(distinct request_id) as n_requests from a")
def _late(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "attack_view").where("request_id is not null").select("request_id", instant_millis(F.col("timestamp")).alias("ms"))
    return a.agg(F.count("*").alias("n_rows"), F.count("ms").alias("n_timed"), F.count_distinct("request_id").alias("n_requests"))


@query(
    "q_scale_gate",
    f"with {REQUESTS_SQL}, x as (select (select count(*) from req) as requests, (select count(*) from (select distinct bucket from req)) as buckets, (select max(n) from (select count(*) as n from req group by bucket)) as largest) select requests >= 1 as requests, buckets between 1 and 1000000 as buckets, largest <= 1000 as largest, requests >= 1 and buckets between 1 and 1000000 and largest <= 1000 as passed from x",
)
def _gate(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _requests(spark, folder).groupBy("bucket").agg(F.count("*").alias("n"))
    numbers = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.count("*").alias("buckets"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return A.scale_gate(numbers, {"requests": (1, None), "buckets": (1, 1_000_000), "largest": (None, 1000)})
