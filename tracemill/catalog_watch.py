"""Queries of similarity, watchlists and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as X
from .operators import audits as A
from .operators import encoders as C
from .operators import similarity as S
from .operators import watchlists as W
from .operators.components import components
from .operators.requests import REQUESTS_SQL, TEXT_SQL, canonical_requests, request_text, truth_labels, truth_sql
from .queries import query, table

_V = "v as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null)"
_TOP = f"with {_V}, s as (select a.vec_id as query_id, b.vec_id as id, list_cosine_similarity(a.e, b.e) as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id), t as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s)"


def _queries(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 50 = 0")


@query("q_topk_cosine", _TOP + " select query_id, id, round(score, 6) as score, rank from t where rank <= 10")
def _topk(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return S.top_k_cosine(v, _queries(v), 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("q_neighbour_labels", _TOP + ", n as (select query_id, id from t where rank <= 5) select a.label as query_label, b.label as found_label, count(*) as n from n join v a on n.query_id = a.vec_id join v b on n.id = b.vec_id group by all")
def _purity(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    n = S.top_k_cosine(v, _queries(v), 5)
    a = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    b = v.select(F.col("vec_id").alias("id"), F.col("label").alias("found_label"))
    return n.join(a, "query_id").join(b, "id").groupBy("query_label", "found_label").agg(F.count("*").alias("n"))


@query("q_threshold_components", f"with recursive {_V}, s as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.3), e as (select cast(u as varchar) as u, cast(v as varchar) as v from s), r(id, label) as (select cast(vec_id as varchar), cast(vec_id as varchar) from v union select e.v, r.label from r join e on r.id = e.u) select id, min(label) as label from r group by id")
def _classes(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").where("embedding is not null")
    return components(S.threshold_links(v, 0.3), v.select(F.col("vec_id").cast("string").alias("id")))


@query("q_mutual_neighbours", f"with {_V}, s as (select a.vec_id as x, b.vec_id as y, list_cosine_similarity(a.e, b.e) as score from v a join v b on a.vec_id <> b.vec_id), t as (select *, row_number() over (partition by x order by round(score, 9) desc, y) as r, lead(score) over (partition by x order by round(score, 9) desc, y) as second from s), b as (select x, y, score from t where r = 1 and score - coalesce(second, -1) >= 0.01) select a.x as left, a.y as right, round(a.score, 6) as score from b a join b c on a.x = c.y and a.y = c.x and a.x < a.y where a.x % 50 = 0 or a.y % 50 = 0")
def _mutual_all(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return S.mutual_among_all(v, _queries(v), 0.01).select("left", "right", F.round("score", 6).alias("score"))


@query("q_index_recall")
def _index(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the index of cells against the exact neighbours, and the share of rows it compares."""
    v = table(spark, folder, "embeddings")
    return C.index_report(v, _queries(v), S.top_k_cosine(v, _queries(v), 10))


# -- watchlists: clusters are cache buckets, tokens are domains and repositories -----------
def _tokens(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = canonical_requests(table(spark, folder, "attack_view"), "messages")
    text = F.lower(request_text(F.col("messages")))
    each = r.select("request_id", "ms", "bucket", text.alias("text"))
    tokens = each.select("request_id", F.explode(F.array_distinct(F.concat(X.domains(F.col("text")), X.paths(F.col("text"))))).alias("token"))
    early = F.pmod(F.floor(F.col("ms") / 3_600_000), F.lit(2)) == 0
    return tokens, each.where(early).select("request_id", F.col("bucket").alias("label")), each.where(~F.coalesce(early, F.lit(False))).select("request_id")


_TOK = rf"with {REQUESTS_SQL}, x as (select request_id, ms, bucket, lower({TEXT_SQL}) as text from req), tok as (select distinct request_id, unnest(list_concat(regexp_extract_all(text, '\b(?:[a-z0-9-]+\.)+(?:internal|local|prod|corp)\b'), regexp_extract_all(text, '{X.PATH}'))) as token from x), lab as (select request_id, bucket as label from x where floor(ms / 3600000.0) % 2 = 0), late as (select request_id from x where not coalesce(floor(ms / 3600000.0) % 2 = 0, false))"
_LIST = _TOK + ", sz as (select label, count(*) as size from lab group by label), j as (select * from tok join lab using (request_id)), cnt as (select label, token, count(*) as n from j group by all), dfs as (select token, count(*) as df from j group by token), sc as (select label, token, round((n / size) * ((select count(*) from lab) / df), 6) as score, n, df from cnt join dfs using (token) join sz using (label) where df <= greatest(2, floor((select count(*) from lab) * 0.35)) and n >= case when size <= 2 then 1 else 2 end), wl as (select * from (select *, row_number() over (partition by label order by score desc, n desc, df, token) as rank from sc) where rank <= 24)"


@query("q_token_watchlist", _LIST + " select label, token, score, n as count, df, rank from wl")
def _watchlist(spark: SparkSession, folder: str) -> DataFrame:
    tokens, labels, _ = _tokens(spark, folder)
    return W.token_watchlist(tokens, labels).withColumn("rank", F.col("rank").cast("long"))


@query("q_watchlist_assign", _LIST + ", a as (select request_id, label, sum(score) as score, count(*) as hits from tok join late using (request_id) join wl using (token) group by all), b as (select *, row_number() over (partition by request_id order by round(score, 6) desc, label) as r, lead(score) over (partition by request_id order by round(score, 6) desc, label) as second from a) select request_id, label, round(score, 4) as score, hits from b where r = 1 and score >= 35 and hits >= 2 and (second is null or score >= 1.35 * second)")
def _assign(spark: SparkSession, folder: str) -> DataFrame:
    tokens, labels, late = _tokens(spark, folder)
    return W.assign(tokens.join(late, "request_id", "left_semi"), W.token_watchlist(tokens, labels))


@query("q_retrieval", _LIST + ", a as (select label, request_id, round(sum(score), 4) as score from tok join late using (request_id) join wl using (token) group by all) select label, request_id, score, rank from (select *, row_number() over (partition by label order by score desc, request_id) as rank from a) where rank <= 50")
def _retrieval(spark: SparkSession, folder: str) -> DataFrame:
    tokens, labels, late = _tokens(spark, folder)
    return W.retrieve(tokens.join(late, "request_id", "left_semi"), W.token_watchlist(tokens, labels)).withColumn("rank", F.col("rank").cast("long"))


@query("q_entity_votes", _TOK + ", own as (select token, min(label) as label from tok join lab using (request_id) group by token having min(label) = max(label)), v as (select request_id, own.label, count(*) as votes from tok join late using (request_id) join own using (token) group by all), w as (select *, row_number() over (partition by request_id order by votes desc, label) as r, lead(votes) over (partition by request_id order by votes desc, label) as second from v) select request_id, label, votes from w where r = 1 and (second is null or second < votes)")
def _votes(spark: SparkSession, folder: str) -> DataFrame:
    tokens, labels, late = _tokens(spark, folder)
    anchors = tokens.withColumnRenamed("token", "anchor")
    return W.vote(anchors.join(late, "request_id", "left_semi"), W.unique_anchors(anchors, labels))


@query("q_majority_truth", f"with {REQUESTS_SQL}, c as (select bucket as label, t.label as truth, count(*) as n from req join {truth_sql('project')} t using (request_id) group by all) select label, truth, n from (select *, row_number() over (partition by label order by n desc, truth) as r from c) where r = 1")
def _majority(spark: SparkSession, folder: str) -> DataFrame:
    pred = canonical_requests(table(spark, folder, "attack_view")).select("request_id", F.col("bucket").alias("label"))
    return W.majority(pred, truth_labels(table(spark, folder, "request_identity"), "project"))


_FIELDS = " union all ".join(f"select bucket as label, request_id, '{field}' as field, '{w}' as value from x where regexp_matches(text, '\\b{w}\\b')" for field, words in W.FIELD_WORDS.items() for w in words)
_NAMED = rf"""select distinct bucket, request_id, 'repo_names', unnest(list_concat(regexp_extract_all(raw, '{X.REPOSITORY}', 2), regexp_extract_all(raw, '{W.REPO_SERVICE}', 1), list_filter(list_transform(regexp_extract_all(raw, '/workspace/([^/\s]+)', 1), lambda s: string_split(s, '__')[2]), lambda r: r <> '' and not regexp_full_match(replace(r, '.', ''), '[0-9]+')))) from x
 union all select distinct bucket, request_id, 'service_names', unnest(list_concat(regexp_extract_all(raw, '{W.REPO_SERVICE}', 2), regexp_extract_all(raw, '{W.SERVICE_FIELD}', 1), regexp_extract_all(raw, '{W.TARGET_SERVICE}', 1))) from x union all select distinct bucket, request_id, 'internal_domains', unnest(regexp_extract_all(raw, '{X.DOMAIN}')) from x"""
_FOUND = f"{REQUESTS_SQL}, x as (select request_id, bucket, lower({TEXT_SQL}) as raw, replace(lower({TEXT_SQL}), '-', '_') as text from req), big as (select bucket as label from req group by bucket having count(*) >= 2), h as ({_FIELDS} union all {_NAMED}), k as (select *, row_number() over (partition by label, field, value order by request_id) as r from h join big using (label))"


def _rule(spark: SparkSession, folder: str) -> DataFrame:
    r = canonical_requests(table(spark, folder, "attack_view"), "messages")
    return W.rule_profiles(r.select("request_id", F.lower(request_text(F.col("messages"))).alias("text")), r.select("request_id", F.col("bucket").alias("label")))


@query("q_rule_profiles", f"with {_FOUND} select label, field, value, count(*) as n_requests, list_sort(list(request_id) filter (where r <= 5)) as evidence from k group by all")
def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    return _rule(spark, folder)


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rule profiles of cache buckets against the truth of their requests."""
    found = _rule(spark, folder).select(F.col("label").alias("entity"), "field", "value")
    r = canonical_requests(table(spark, folder, "attack_view")).select("request_id", F.col("bucket").alias("entity"))
    big = r.groupBy("entity").count().where("count >= 2").select("entity")
    values = table(spark, folder, "request_identity").select("request_id", F.explode("profile_truth").alias("field", "vals")).select("request_id", "field", F.explode("vals").alias("value")).where("value is not null")
    truth = values.join(r.join(big, "entity"), "request_id").select("entity", "field", F.lower("value").alias("value"))
    return W.profile_scores(found, truth)


_SCORED = f"""with {_FOUND}, f as (select distinct label, field, value from k), t as (select distinct q.bucket as label, field, lower(value) as value from (select request_id, field, unnest(vals) as value from (select request_id, unnest(map_keys(profile_truth)) as field, unnest(map_values(profile_truth)) as vals from request_identity)) v join req q using (request_id) join big on big.label = q.bucket where value is not null),
j as (select coalesce(f.field, t.field) as field, (f.label is not null)::int as p, (t.label is not null)::int as q from f full join t on f.label = t.label and f.field = t.field and f.value = t.value), c as (select field, sum(p * q)::bigint as tp, sum(p * (1 - q))::bigint as fp, sum((1 - p) * q)::bigint as fn from j group by field),
w as (select * from c union all select '__micro__', sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from c)"""
_PRF = "case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1"


@query("q_profile_scores", _SCORED + f" select field, tp, fp, fn, {_PRF} from w")
def _profile_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder)


_RISK = ", ".join(f"('{level}', '{field}')" for level, fields in W.RISK_LEVELS.items() for field in fields)


@query("q_risk_levels", _SCORED + f", l as (select * from (values {_RISK}) as v(level, field)), g as (select level, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from c join l using (field) group by level) select level, tp, fp, fn, {_PRF} from g")
def _risk(spark: SparkSession, folder: str) -> DataFrame:
    return A.risk_rollup(_scores(spark, folder), W.RISK_LEVELS)


@query("q_profile_truth", "select field, count(*) as n_values, count(distinct value) as n_distinct from (select unnest(map_keys(profile_truth)) as field, unnest(map_values(profile_truth)) as vals from request_identity), (select unnest(vals) as value) group by field")
def _truth_fields(spark: SparkSession, folder: str) -> DataFrame:
    each = table(spark, folder, "request_identity").select(F.explode("profile_truth").alias("field", "vals")).select("field", F.explode("vals").alias("value"))
    return each.groupBy("field").agg(F.count("*").alias("n_values"), F.count_distinct("value").alias("n_distinct"))
