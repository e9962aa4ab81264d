"""Profiles, watchlists and retrieval over labelled requests and their tokens.

``tokens``: ``request_id``, ``token`` (distinct).  ``labels``: ``request_id``,
``label``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import DOMAIN, REPOSITORY, WORKSPACE
from .evaluation import f1, ratio

# Words of each profile field.
FIELD_WORDS = {
    "industries": ("finance", "healthcare", "ecommerce", "saas", "security", "logistics"),
    "languages": ("python", "typescript", "javascript", "java", "go", "rust", "ruby"),
    "frameworks": ("fastapi", "django", "flask", "pytest", "jest", "nestjs", "nextjs", "react", "spring", "gin", "rails"),
    "databases": ("postgresql", "mysql", "clickhouse", "redis"),
    "cloud_providers": ("aws", "gcp", "azure", "self_hosted"),
    "ci_cd_systems": ("github_actions", "gitlab_ci", "jenkins", "circleci"),
    "auth_systems": ("oauth2", "oidc", "saml", "jwt", "ldap"),
    "package_managers": ("pip", "poetry", "npm", "pnpm", "yarn", "maven", "gradle", "go mod", "cargo"),
    "build_tools": ("pytest", "tox", "make", "cmake", "bazel", "maven", "gradle", "go test", "cargo"),
    "security_clues": ("permission bypass", "ssrf", "xss", "audit log", "rbac", "token rotation"),
}
# Where services and repositories are named.
SERVICE_FIELD = r"\bservice=([a-z][a-z0-9_.-]{2,})\b"
TARGET_SERVICE = r"\btarget service ([a-z][a-z0-9_.-]{2,})\b"
REPO_SERVICE = r"\bfor ([a-z][a-z0-9_.-]{2,})/([a-z][a-z0-9_.-]{2,})\b"
#: Fields by how telling they are.
RISK_LEVELS = {"technical": ["languages", "frameworks", "databases"], "operations": ["cloud_providers", "ci_cd_systems"], "identity": ["industries", "internal_domains"]}


def named_things(text: Column) -> Column:
    """Repositories, services and internal domains that a text (small letters) names: an array of ``field``, ``value``."""
    struct = lambda field: lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))
    every = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), group)
    slugs = F.filter(F.transform(every(WORKSPACE, 1), lambda s: F.get(F.split(s, "__"), F.lit(1))), lambda r: r.isNotNull() & (r != "") & ~F.regexp_replace(r, r"\.", "").rlike(r"^\d+$"))
    repos = F.concat(every(REPOSITORY, 2), slugs, every(REPO_SERVICE, 1))
    services = F.concat(every(REPO_SERVICE, 2), every(SERVICE_FIELD, 1), every(TARGET_SERVICE, 1))
    return F.array_distinct(F.concat(F.transform(repos, struct("repo_names")), F.transform(services, struct("service_names")), F.transform(every(DOMAIN, 0), struct("internal_domains"))))


def rule_profiles(texts: DataFrame, labels: DataFrame, least_size: int = 2, evidence: int = 5) -> DataFrame:
    """``label``, ``field``, ``value``, ``n_requests`` and up to five request ids, of clusters of at least ``least_size``.

    ``texts``: ``request_id``, ``text`` (small letters).  Words are matched
    whole, with ``-`` read as ``_``; repositories, services and internal domains
    are those that the text names.
    """
    t = F.regexp_replace("text", "-", "_")
    words = F.array_compact(F.array(*[F.when(t.rlike(rf"\b{w.replace('-', '_')}\b"), F.struct(F.lit(field).alias("field"), F.lit(w).alias("value"))) for field, ws in FIELD_WORDS.items() for w in ws]))
    hits = F.concat(words, named_things(F.col("text")))
    big = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least_size).select("label")
    each = texts.select("request_id", F.explode(hits).alias("h")).join(labels.join(big, "label"), "request_id")
    w = Window.partitionBy("label", "h").orderBy("request_id")
    ranked = each.select("label", "h", "request_id", F.row_number().over(w).alias("r"))
    grouped = ranked.groupBy("label", "h").agg(F.count("*").alias("n_requests"), F.array_sort(F.collect_list(F.when(F.col("r") <= evidence, F.col("request_id")))).alias("evidence"))
    return grouped.select("label", "h.field", "h.value", "n_requests", "evidence")


def token_watchlist(tokens: DataFrame, labels: DataFrame, top: int = 24, most_df: float = 0.35) -> DataFrame:
    """Tokens of each cluster by ``(count / size) * (N / df)``: frequent in the cluster, rare elsewhere.

    ``df`` is at most max(2, share * N).  Order: score, count, rarity, token.
    """
    sized = labels.groupBy("label").agg(F.count("*").alias("size"))
    whole = labels.agg(F.count("*").alias("total"))
    joined = tokens.join(labels, "request_id")
    counts = joined.groupBy("label", "token").agg(F.count("*").alias("count"))
    dfs = joined.groupBy("token").agg(F.count("*").alias("df"))
    least = F.when(F.col("size") <= 2, 1).otherwise(2)
    scored = counts.join(dfs, "token").join(sized, "label").crossJoin(whole).where(F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("total") * most_df))).where(F.col("count") >= least)
    scored = scored.withColumn("score", F.round((F.col("count") / F.col("size")) * (F.col("total") / F.col("df")), 6))
    w = Window.partitionBy("label").orderBy(F.desc("score"), F.desc("count"), "df", "token")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("label", "token", "score", "count", "df", "rank")


def assign(tokens: DataFrame, watchlist: DataFrame, least_score: float = 35.0, least_hits: int = 2, least_ratio: float = 1.35) -> DataFrame:
    """The cluster of each request whose watched tokens sum up best, if clear enough: ``request_id``, ``label``, ``score``, ``hits``."""
    scored = tokens.join(watchlist.select("label", "token", "score"), "token").groupBy("request_id", "label").agg(F.sum("score").alias("score"), F.count("*").alias("hits"))
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 6)), "label")
    ranked = scored.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("r = 1")
    clear = F.col("second").isNull() | (F.col("score") >= least_ratio * F.col("second"))
    return ranked.where((F.col("score") >= least_score) & (F.col("hits") >= least_hits) & clear).select("request_id", "label", F.round("score", 4).alias("score"), "hits")


def retrieve(tokens: DataFrame, watchlist: DataFrame, top: int = 50) -> DataFrame:
    """The requests that match each cluster's list best: ``label``, ``request_id``, ``score``, ``rank``."""
    scored = tokens.join(watchlist.select("label", "token", "score"), "token").groupBy("label", "request_id").agg(F.round(F.sum("score"), 4).alias("score"))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "request_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def retrieval_metrics(retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """Per cluster: retrieved, right, precision, recall among the truth of that label."""
    t = truth.select("request_id", F.col("label").alias("truth"))
    positive = truth.groupBy("label").agg(F.count("*").alias("positive"))
    each = retrieved.join(t, "request_id", "left").groupBy("label").agg(F.count("*").alias("retrieved"), F.sum(F.coalesce((F.col("truth") == F.col("label")).cast("int"), F.lit(0))).alias("right"))
    r = each.join(positive, "label", "left").select("label", "retrieved", "right", F.coalesce("positive", F.lit(0)).alias("positive"))
    return r.select("label", "retrieved", "right", ratio(F.col("right").cast("double"), F.col("retrieved").cast("double")).alias("precision"), ratio(F.col("right").cast("double"), F.col("positive").cast("double")).alias("recall"))


def unique_anchors(anchors: DataFrame, labels: DataFrame) -> DataFrame:
    """Anchors that only one cluster has: ``anchor``, ``label``."""
    return anchors.join(labels, "request_id").groupBy("anchor").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("anchor", "label")


def vote(anchors: DataFrame, owners: DataFrame) -> DataFrame:
    """The cluster that most of a request's anchors belong to; ties give none: ``request_id``, ``label``, ``votes``."""
    votes = anchors.join(owners, "anchor").groupBy("request_id", "label").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("request_id").orderBy(F.desc("votes"), "label")
    ranked = votes.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("votes").over(w))
    return ranked.where("r = 1 and (second is null or second < votes)").select("request_id", "label", "votes")


def majority(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """The most frequent truth of each label, ties by the smaller value: ``label``, ``truth``, ``n``."""
    counted = pred.join(truth.select("request_id", F.col("label").alias("truth")), "request_id").groupBy("label", "truth").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("n"), "truth")
    return counted.withColumn("r", F.row_number().over(w)).where("r = 1").select("label", "truth", "n")


def profile_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of (``entity``, ``field``, ``value``) sets per field, and over all as ``__micro__``."""
    keys = ["entity", "field", "value"]
    both = found.select(*keys).distinct().withColumn("p", F.lit(1)).join(truth.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full")
    p, t = F.coalesce("p", F.lit(0)), F.coalesce("t", F.lit(0))
    counted = both.rollup("field").agg(F.sum(p * t).alias("tp"), F.sum(p * (1 - t)).alias("fp"), F.sum((1 - p) * t).alias("fn"), F.grouping("field").alias("g"))
    tp = F.col("tp").cast("double")
    precision, recall = ratio(tp, tp + F.col("fp")), ratio(tp, tp + F.col("fn"))
    return counted.select(F.when(F.col("g") == 1, "__micro__").otherwise(F.col("field")).alias("field"), "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"))
