"""Linkage methods: features to labels at four levels.

Every method gives ``method``, ``level``, ``request_id``, ``label``; labels are
the smallest request id of a component, or a key.  No method reads truth.
Requests without a readable instant pass no time gate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions.handles import stable_handles
from ..scratch import Scratch
from . import alike as A
from . import blocking as B
from .components import components
from .ordered import numbered, running_max, running_sum
from .requests import canonical_requests, request_text

LEVELS = ("session", "user", "project", "org")

# Limits of the low-cost method.
PAIRS_PER_REQUEST = 400
SEMANTIC_BUCKET, CONTEXT_BUCKET, REFINE_BUCKET = 20, 35, 20
RARE_BUCKETS = {"session": 20, "user": 80, "project": 400, "org": 400}
STOP_VALUES = ("github_actions", "gitlab_ci", "self_hosted", "read_file", "generic-agent-model")
STOP_STARTS = ("generic-", "synthetic-", "maxfail", "dry-run")
KEPT_STARTS = ("/home/", "/workspace/", "trace-", "repo_owner:", "repo_name:", "repo_full:", "business_")
MARKERS = ("service", "api", "core", "engine", "portal", "worker")


def _starting(values: Column, *starts: str) -> Column:
    return F.filter(values, lambda v: reduce(lambda a, b: a | b, [F.startswith(v, F.lit(s)) for s in starts]))


def not_stable(values: Column) -> Column:
    return F.filter(values, lambda v: ~F.startswith(v, F.lit("stable_")))


def informative(values: Column) -> Column:
    """Identifiers that tell apart: no stop value or stop beginning, and a telling form."""

    def keep(v: Column) -> Column:
        stopped = v.isin(*STOP_VALUES) | reduce(lambda a, b: a | b, [F.startswith(v, F.lit(s)) for s in STOP_STARTS])
        telling = reduce(lambda a, b: a | b, [F.startswith(v, F.lit(s)) for s in KEPT_STARTS] + [F.contains(v, F.lit(m)) for m in (".", *MARKERS)])
        return ~stopped & telling

    return F.filter(values, keep)


def workspace_owners(paths: Column) -> Column:
    slugs = F.transform(F.filter(paths, lambda p: F.contains(p, F.lit("/workspace/"))), lambda p: F.coalesce(F.get(F.filter(F.split(p, "/"), lambda x: x != ""), F.lit(1)), F.lit("")))
    return F.array_distinct(F.transform(F.filter(slugs, lambda s: F.contains(s, F.lit("__"))), lambda s: F.concat(F.lit("workspace_owner:"), F.substring_index(s, "__", 1))))


def feature_table(attack_view: DataFrame, options: X.FeatureOptions | None = None) -> DataFrame:
    """One row of features per request; families that are off are empty arrays."""
    o = options or X.FeatureOptions()
    r = canonical_requests(attack_view, "messages", "tool_schemas", "token_count")
    r = r.withColumn("text", F.lower(request_text(F.col("messages")))).withColumn("handles", stable_handles(F.col("messages")) if o.business and o.handles else F.array().cast("array<string>"))
    t = F.col("text")
    window = X.bounded_text(t, o.window_chars)
    none, numbers = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    ids = [X.plain_identifiers(window)] if o.identifiers else []
    ids += [X.repositories(t)] if o.repositories else []
    ids += [X.business_keys(t)] if o.business else []
    ids += [F.col("handles")] if o.business and o.handles else []
    systems = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "system"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    tools = F.array_join(F.array_sort(F.transform("tool_schemas", lambda s: F.concat_ws("|", s["name"], F.array_join(s["parameters"], ",")))), ";")
    return r.select(
        "request_id",
        (F.floor(F.col("ms") / 60000) if o.time else F.lit(0).cast("long")).alias("minute"),
        (F.col("bucket") if o.cache else F.lit("cache_unavailable")).alias("bucket"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        (F.array_distinct(F.flatten(F.array(*ids))) if ids else none).alias("identifiers"),
        (X.paths(t) if o.paths else none).alias("paths"),
        (X.domains(t) if o.domains else none).alias("domains"),
        (X.traces(t) if o.traces else none).alias("traces"),
        (X.usernames(X.paths(t)) if o.paths else none).alias("usernames"),
        (X.shingles(window, most=o.max_shingles, hashed=True) if o.shingles else numbers).alias("shingles"),
        (X.signatures(X.words(window, o.max_words)) if o.signatures else none).alias("signatures"),
        X.fingerprint(F.coalesce(tools, F.lit(""))).alias("tool_fp"),
        X.fingerprint(F.coalesce(systems, F.lit(""))).alias("system_fp"),
    )


def _labels(method: str, features: DataFrame, **columns: Column) -> DataFrame:
    spread = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), columns[level].cast("string").alias("label")) for level in LEVELS]))
    return features.select(F.lit(method).alias("method"), "request_id", spread.alias("s")).select("method", "s.level", "request_id", "s.label")


def _components(method: str, links: dict[str, DataFrame], features: DataFrame) -> DataFrame:
    """Labels of every request at the levels of ``links``; all levels are contracted together, the level being part of the vertex."""
    key = lambda level, c: F.concat(F.lit(f"{level}\t"), F.col(c))
    edges = reduce(DataFrame.unionByName, [d.select(key(level, "u").alias("u"), key(level, "v").alias("v")) for level, d in links.items()])
    spread = features.select(F.explode(F.array(*[key(level, "request_id") for level in links])).alias("id"))
    found = components(edges, spread)
    part = lambda c, n: F.split(c, "\t", 2)[n]
    return found.select(F.lit(method).alias("method"), part("id", 0).alias("level"), part("id", 1).alias("request_id"), part("label", 1).alias("label"))


def temporal(features: DataFrame) -> DataFrame:
    m = F.col("minute")
    return _labels("temporal", features, session=F.floor(m / 10), user=F.floor(m / 60), project=F.floor(m / 1440), org=F.floor(m / 1440))


def tool(features: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "tool_fp", "system_fp")
    return _labels("tool", features, session=key, user=key, project=key, org=key)


def _rare_values(level: str) -> Column:
    ids = F.col("identifiers")
    return {
        "session": F.col("traces"),
        "user": F.concat(F.col("usernames"), F.col("traces"), _starting(ids, "business_user:")),
        "project": _starting(ids, "repo_full:", "business_project:"),
        "org": F.concat(F.col("domains"), _starting(ids, "repo_owner:", "business_org:"), workspace_owners(F.col("paths"))),
    }[level]


def rare(features: DataFrame) -> DataFrame:
    """Links by rare values alone: traces, user names, repositories, and what names an organisation."""
    orgish = F.filter("identifiers", lambda v: F.contains(v, F.lit("-")) & ~F.startswith(v, F.lit("trace-")))
    values = {"session": (F.col("traces"), 12), "user": (F.col("usernames"), 500), "project": (_starting(F.col("identifiers"), "repo_full:"), 2000), "org": (F.concat(F.col("domains"), _starting(F.col("identifiers"), "repo_owner:"), orgish), 2000)}
    return _components("rare", {level: B.star_edges(B.postings(features, v), cap) for level, (v, cap) in values.items()}, features)


#: Columns of a feature row that each score of a pair needs.
_SCORES = {
    "gap": ("minute",), "jaccard": ("shingles",), "containment": ("shingles",), "ids": ("identifiers",), "trace": ("traces",), "domain": ("domains",), "user": ("usernames",), "sem": ("signatures",),
    "repo": ("identifiers",), "owner": ("identifiers",), "biz_user": ("identifiers",), "biz_project": ("identifiers",), "biz_org": ("identifiers",),
    "same_tool": ("tool_fp",), "same_system": ("system_fp",), "same_cache": ("bucket",), "length_ratio": ("token_count",),
}


def pair_scores(pairs: DataFrame, features: DataFrame, scores: tuple[str, ...] = tuple(_SCORES), least: Column | None = None) -> DataFrame:
    """Candidate pairs with the asked ones of their overlaps, similarities and time gap.

    Only the features that the scores need move.  ``least``: a condition on the
    light scores (all but the similarities of shingles); pairs that fail it are
    out before the shingles, the bulk of a feature row, are joined at all.
    """
    light = tuple(x for x in scores if x not in ("jaccard", "containment"))
    heavy = tuple(x for x in scores if x in ("jaccard", "containment"))
    if least is not None and heavy:
        kept = _scored(pairs, features, light, ()).where(least)
        return _scored(kept, features, heavy, light)
    return _scored(pairs, features, scores, ())


def _scored(pairs: DataFrame, features: DataFrame, scores: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    needs = sorted({c for x in scores for c in _SCORES[x]})
    a = features.select(F.col("request_id").alias("left"), *[F.col(c).alias(f"a_{c}") for c in needs])
    b = features.select(F.col("request_id").alias("right"), *[F.col(c).alias(f"b_{c}") for c in needs])
    both = pairs.select("left", "right", *carry).join(a, "left").join(b, "right")
    col = lambda side, name: F.col(f"{side}_{name}")
    over = lambda f: X.overlap(f("a"), f("b"))
    starts = lambda *p: over(lambda s: _starting(col(s, "identifiers"), *p))
    small = F.least(F.size("a_shingles"), F.size("b_shingles"))
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    union = F.size("a_shingles") + F.size("b_shingles") - shared  # the arrays are distinct
    found = {
        "gap": lambda: F.abs(F.col("a_minute") - F.col("b_minute")),
        "jaccard": lambda: F.when(small > 0, shared / union).otherwise(0.0), "containment": lambda: F.when(small > 0, shared / small).otherwise(0.0),
        "ids": lambda: over(lambda s: not_stable(col(s, "identifiers"))), "trace": lambda: over(lambda s: col(s, "traces")), "domain": lambda: over(lambda s: col(s, "domains")), "user": lambda: over(lambda s: col(s, "usernames")), "sem": lambda: over(lambda s: col(s, "signatures")),
        "repo": lambda: starts("repo_full:"), "owner": lambda: starts("repo_owner:"), "biz_user": lambda: starts("business_user:"), "biz_project": lambda: starts("business_project:"), "biz_org": lambda: starts("business_org:"),
        "same_tool": lambda: F.col("a_tool_fp") == F.col("b_tool_fp"), "same_system": lambda: F.col("a_system_fp") == F.col("b_system_fp"), "same_cache": lambda: F.col("a_bucket") == F.col("b_bucket"),
        "length_ratio": lambda: F.least("a_token_count", "b_token_count") / F.greatest(F.lit(1), F.col("a_token_count"), F.col("b_token_count")),
    }
    return both.select("left", "right", *carry, *[found[x]().alias(x) for x in scores])


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def lowcost_scores(scored: DataFrame) -> DataFrame:
    """Adds the scores of the low-cost method and whether each level links."""
    c = F.col
    user = 2 * F.least(c("user"), F.lit(1)) + 0.8 * F.least(c("ids"), F.lit(6)) / 6 + 0.5 * F.least(c("sem"), F.lit(2)) / 2 + 2 * F.least(c("biz_user"), F.lit(1)) + 0.3 * _flag(c("gap") <= 1440)
    a = (c("jaccard") >= 0.22) & (c("ids") >= 2) & (c("gap") <= 180)
    b = (c("jaccard") >= 0.24) & (c("sem") >= 2) & (c("ids") >= 3) & (c("gap") <= 90)
    out = scored.withColumns({"user_score": user, "project_score": (c("repo") + c("biz_project")).cast("double"), "org_score": (c("domain") + c("owner") + c("biz_org")).cast("double")})
    return out.withColumns({"link_session": F.coalesce(a | b, F.lit(False)), "link_user": (c("user_score") >= 1.8) | (c("biz_user") >= 1), "link_project": c("project_score") >= 1, "link_org": c("org_score") >= 1})


def context_links(scored: DataFrame) -> DataFrame:
    c = F.col
    return scored.where((c("containment") >= 0.78) & (c("jaccard") >= 0.20) & (c("ids") >= 2) & (c("repo") >= 1) & (c("gap") <= 180))


def semantic_links(scored: DataFrame) -> DataFrame:
    c = F.col
    return scored.where((c("sem") >= 2) & (c("jaccard") >= 0.32) & (c("ids") >= 3) & (c("gap") <= 90))


def ambiguous_accounts(anchors: DataFrame) -> DataFrame:
    """Account anchors that were seen with any number but one of customer references."""
    accounts = anchors.where(F.startswith("anchor", F.lit("business_user:account_cache:")))
    customers = anchors.where(F.startswith("anchor", F.lit("business_user:customer_ref:"))).select("request_id", F.col("anchor").alias("customer"))
    seen = accounts.join(customers, "request_id", "left").groupBy("anchor").agg(F.count_distinct("customer").alias("n"))
    return seen.where("n <> 1").select("anchor")


def percolation_links(features: DataFrame, levels: tuple[str, ...] = LEVELS[1:]) -> dict[str, DataFrame]:
    """Request-anchor links of each level over all buckets, ambiguous anchors left out.

    A stable handle that joins several components of business anchors is
    ambiguous too.  Anchors are vertices, so a hot one costs as many links as
    it has requests.  The components of all levels are found together.
    """
    spread = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.array_distinct(_starting(F.col("identifiers"), f"business_{level}:", f"stable_{level}:")).alias("anchors")) for level in levels]))
    anchors = Scratch(features.sparkSession, "anchors").save(features.select("request_id", spread.alias("s")).select("request_id", "s.level", F.explode("s.anchors").alias("anchor")), "anchors")
    anchors = anchors.join(ambiguous_accounts(anchors.where("level = 'user'")), "anchor", "left_anti")
    business = anchors.where(F.startswith("anchor", F.lit("business_")))
    stable = anchors.where(F.startswith("anchor", F.lit("stable_")))
    request = F.concat_ws("\t", "level", F.lit("r"), "request_id")
    parts = components(business.select(request.alias("u"), F.concat_ws("\t", "level", F.lit("a"), "anchor").alias("v"))).select(F.col("id"), "label")
    met = stable.join(parts, request == F.col("id")).groupBy("level", "anchor").agg(F.count_distinct("label").alias("n"))
    stable = stable.join(met.where("n > 1").select("level", "anchor"), ["level", "anchor"], "left_anti")
    links = business.unionByName(stable).select("level", F.concat(F.lit("r\t"), "request_id").alias("u"), F.concat(F.lit("a\t"), "anchor").alias("v"))
    return {level: links.where(F.col("level") == level).select("u", "v") for level in levels}


_CONTEXT_SCORES = ("gap", "ids", "repo", "jaccard", "containment")
_REFINE_SCORES = ("gap", "ids", "sem", "user", "repo", "biz_project", "domain", "owner", "biz_org", "biz_user", "jaccard")


def _telling(c: str = "identifiers") -> Column:
    return F.concat(informative(F.col(c)), _starting(F.col(c), "business_"), F.col("traces"), F.col("domains"))


def semantic_stage(f: DataFrame, budget: int = PAIRS_PER_REQUEST) -> DataFrame:
    """Links of pairs that share a signature within a cache bucket."""
    pairs = B.bounded_pairs(B.postings(f, F.col("signatures"), F.col("bucket")), SEMANTIC_BUCKET, budget)
    return semantic_links(pair_scores(pairs, f, ("gap", "ids", "sem", "jaccard"), (F.col("sem") >= 2) & (F.col("ids") >= 3) & (F.col("gap") <= 90)))


def context_stage(f: DataFrame, budget: int = PAIRS_PER_REQUEST) -> DataFrame:
    """Links of pairs that share a shingle within a cache bucket."""
    pairs = B.bounded_pairs(B.postings(f, F.col("shingles"), F.col("bucket")), CONTEXT_BUCKET, budget)
    return context_links(pair_scores(pairs, f, _CONTEXT_SCORES, (F.col("ids") >= 2) & (F.col("repo") >= 1) & (F.col("gap") <= 180)))


def refine_stage(f: DataFrame, budget: int = PAIRS_PER_REQUEST) -> DataFrame:
    """Scored pairs that share a telling value within a cache bucket."""
    return lowcost_scores(pair_scores(B.bounded_pairs(B.postings(f, _telling(), F.col("bucket")), REFINE_BUCKET, budget), f, _REFINE_SCORES))


def _uv(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("left").alias("u"), F.col("right").alias("v"))


def low_cost(features: DataFrame, budget: int = PAIRS_PER_REQUEST) -> DataFrame:
    """The low-cost method: rare, semantic, context and refine links within cache buckets, then percolation over all.

    Candidate pairs are bounded by bucket caps and a budget a request, and
    scored once for all levels; all levels are contracted together.
    """
    scratch = Scratch(features.sparkSession, "lowcost")
    f = scratch.save(features, "features")
    links = {level: [B.star_edges(B.postings(f, _rare_values(level), F.col("bucket")), cap)] for level, cap in RARE_BUCKETS.items()}
    links["session"] += [_uv(semantic_stage(f, budget)), _uv(context_stage(f, budget))]
    refine = scratch.save(refine_stage(f, budget).where(" or ".join(f"link_{level}" for level in LEVELS)), "refine")
    anchored = percolation_links(f)
    tag = lambda c: F.concat(F.lit("r\t"), F.col(c)).alias(c)
    edges = {}
    for level in LEVELS:
        local = reduce(DataFrame.unionByName, [*links[level], _uv(refine.where(f"link_{level}"))]).select(tag("u"), tag("v"))
        edges[level] = local.unionByName(anchored[level]) if level in anchored else local
    tagged = f.select(F.concat(F.lit("r\t"), "request_id").alias("request_id"))
    found = _components("low_cost", edges, tagged)
    # the label is the smallest request of the component; anchors sort before requests, so it is taken among requests
    found = scratch.save(found, "found")
    kind = lambda c: F.substring_index(c, "\t", 1)
    bare = lambda c: F.substr(c, F.instr(c, "\t") + 1)
    named = found.where(kind("request_id") == "r").select("method", "level", bare("request_id").alias("request_id"), F.col("label").alias("part"))
    least = named.groupBy("level", "part").agg(F.min("request_id").alias("label"))
    return named.join(least, ["level", "part"]).select("method", "level", "request_id", "label")


def _held_sets(f: DataFrame, scratch: Scratch) -> DataFrame:
    """``block``, ``value``, ``n``, ``weight``, ``id``: one value of each set of values that the same requests hold.

    Requests repeat earlier ones, so most values have the same holders as many
    others.  Their sets are told apart by number and two 64-bit hashes;
    ``weight`` is how many values the set has, ``n`` how many holders.  Values
    of one request count for no pair and are left out.
    """
    ids, coded = not_stable(F.col("identifiers")), lambda c: F.transform(c, lambda v: F.xxhash64(v))
    families = {"shingles": F.col("shingles"), "ids": coded(ids), "repo": coded(_starting(F.col("identifiers"), "repo_full:")), "domain": coded(F.col("domains"))}
    posted = reduce(DataFrame.unionByName, [B.postings(f, v, F.lit(name)) for name, v in families.items()])
    holders = posted.groupBy("block", "value").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y")).where("n > 1")
    sets = scratch.save(holders.groupBy("block", "n", "x", "y").agg(F.min("value").alias("value"), F.count("*").alias("weight")).select("block", "value", "n", "weight"), "sets")
    return scratch.save(posted.join(sets, ["block", "value"]), "held")


def prefix_pairs(f: DataFrame, cap: int, scratch: Scratch, least: float = 0.08, slices: int | None = None) -> DataFrame:
    """Pairs that share a shingle of at most ``cap`` requests and have a similarity of ``least``: ``left``, ``right``, ``jaccard``, ``ids``, ``repo``, ``domain``.

    No features move with the pairs.  Shared shingles up to the cap are counted
    where the pairs come from; of the others, and of identifiers and domains,
    one value of each set goes along.  Pairs are made in slices of about four a
    request, each written before the next one, so disk grows as the requests do.
    """
    held = _held_sets(f, scratch)
    few = (F.col("block") == "shingles") & (F.col("n") <= cap)
    lists = scratch.save(held.where(few).groupBy("value").agg(F.array_sort(F.collect_list("id")).alias("members"), F.first("weight").alias("values")).select(F.lit("").alias("block"), "members", "values"), "lists")
    each = lambda name: F.collect_list(F.when(F.col("block") == name, F.struct("value", "weight"))).alias(name)
    names = ("shingles", "ids", "repo", "domain")
    profiles = held.where(~few).groupBy("id").agg(*[each(name) for name in names])
    profiles = scratch.save(f.select(F.col("request_id").alias("id"), F.size("shingles").alias("size")).join(profiles, "id", "left"), "profiles")
    scratch.drop("held", "sets")
    if slices is None:
        made = lists.agg(F.sum(F.size("members") * (F.size("members") - 1) / 2)).first()[0] or 0
        slices = max(1, -int(-made // max(1, 4 * profiles.count())))
    a = profiles.select(F.col("id").alias("left"), *[F.col(c).alias(f"a_{c}") for c in ("size", *names)])
    b = profiles.select(F.col("id").alias("right"), *[F.col(c).alias(f"b_{c}") for c in ("size", *names)])

    def over(name: str) -> Column:
        theirs = F.transform(f"b_{name}", lambda x: x["value"])
        return F.coalesce(F.aggregate(F.filter(f"a_{name}", lambda x: F.array_contains(theirs, x["value"])), F.lit(0).cast("long"), lambda n, x: n + x["weight"]), F.lit(0).cast("long"))

    out = []
    for k in range(slices):
        pairs = B._expanded(lists, "values").where(F.pmod(F.xxhash64("left"), F.lit(slices)) == k).groupBy("left", "right").agg(F.sum("values").alias("few"))
        both = pairs.join(a, "left").join(b, "right").withColumn("shared", F.col("few") + over("shingles"))
        alike = both.withColumn("jaccard", F.col("shared") / (F.col("a_size") + F.col("b_size") - F.col("shared"))).where(F.col("jaccard") >= least)
        out.append(scratch.save(alike.select("left", "right", "jaccard", *[over(name).alias(name) for name in names[1:]]), f"pairs{k}"))
    return reduce(DataFrame.unionByName, out)


#: Links of ``prefix`` by similarity and shared identifiers, repositories and domains.
PREFIX_RULES = {
    "session": lambda alike, ids, repo, domain: alike >= 0.22,
    "user": lambda alike, ids, repo, domain: (alike >= 0.12) & (ids >= 3),
    "project": lambda alike, ids, repo, domain: (alike >= 0.08) & (repo >= 1),
    "org": lambda alike, ids, repo, domain: (alike >= 0.08) & (domain + ids >= 3),
}


def prefix(features: DataFrame, block: int | None = None) -> DataFrame:
    """Links of all pairs that share a shingle, however many requests hold it, by similarity and what else they share."""
    scratch = Scratch(features.sparkSession, "prefix", lean=True)
    values = A.coded(shingles=F.col("shingles"), ids=not_stable(F.col("identifiers")), repo=_starting(F.col("identifiers"), "repo_full:"), domain=F.col("domains"))
    f = scratch.save(features.select("request_id", F.xxhash64("request_id").alias("key"), F.size("shingles").alias("size"), values.alias("values")), "features")
    held = A.held_sets(f, scratch)
    requests = scratch.save(f.drop("values"), "requests")
    scratch.drop("features", "sets")
    found = A.links(requests, held, PREFIX_RULES, 0.08, scratch, block)
    scratch.drop("heldTrue", "heldFalse", "blocks")
    return _components("prefix", {level: found.where(F.col("level") == level).select("u", "v") for level in PREFIX_RULES}, requests)


def hybrid_scores(scored: DataFrame) -> DataFrame:
    c = F.col
    one = lambda n: F.least(c(n), F.lit(1))
    out = scored.withColumns(
        {
            "session_score": 3 * one("trace") + one("user") + F.least(c("ids"), F.lit(5)) / 5 + 1.2 * c("jaccard") + 0.8 * _flag(c("gap") <= 180) + 0.2 * c("length_ratio"),
            "user_score": 2.5 * one("user") + F.least(c("ids"), F.lit(6)) / 6 + 0.5 * c("jaccard") + 0.3 * _flag(c("gap") <= 1440),
            "org_score": 2.8 * one("domain") + 0.9 * F.least(c("ids"), F.lit(8)) / 8 + 0.2 * _flag(c("same_tool")) + 0.2 * _flag(c("same_system")) + 0.3 * c("jaccard"),
        }
    )
    strong = (c("session_score") >= 2.55) & (c("user") > 0) & (c("ids") >= 4) & (c("jaccard") >= 0.18) & (c("gap") <= 90)
    alike = (c("jaccard") >= 0.22) & (c("ids") >= 2) & (c("gap") <= 180)
    return out.withColumns({"link_session": F.coalesce((c("trace") > 0) | strong | alike, F.lit(False)), "link_user": c("user_score") >= 1.8, "link_project": c("repo") > 0, "link_org": (c("domain") > 0) & (c("org_score") >= 2.0)})


def hybrid_pairs(features: DataFrame) -> DataFrame:
    """Scored pairs that share a telling value, with the link of each level."""
    telling = F.concat(informative(F.col("identifiers")), F.col("traces"), F.col("domains"), F.col("usernames"))
    return hybrid_scores(pair_scores(B.candidate_pairs(B.postings(features, telling), 15), features, ("gap", "jaccard", "ids", "trace", "domain", "user", "repo", "same_tool", "same_system", "length_ratio")))


def hybrid(features: DataFrame) -> DataFrame:
    """Stars of rare values and scored pairs of informative ones."""
    scratch = Scratch(features.sparkSession, "hybrid")
    f = scratch.save(features, "features")
    s = scratch.save(hybrid_pairs(f), "scored")
    stars = {"session": [(F.col("traces"), 20)], "user": [(F.col("usernames"), 400)], "project": [(_starting(F.col("identifiers"), "repo_full:"), 1200)], "org": [(F.col("domains"), 1200), (_starting(F.col("identifiers"), "repo_owner:"), 1200)]}
    links = {level: reduce(DataFrame.unionByName, [B.star_edges(B.postings(f, v), cap) for v, cap in stars[level]] + [_uv(s.where(f"link_{level}"))]) for level in LEVELS}
    return _components("hybrid", links, f)


def hybrid_edges(features: DataFrame, most: int = 200, samples: int = 10) -> DataFrame:
    """A report of hybrid pairs that link at some level: scores and up to ``samples`` shared values, the first ``most`` by ids (the limit is the feature)."""
    f = Scratch(features.sparkSession, "edges").save(features, "features")
    s = hybrid_pairs(f).where(" or ".join(f"link_{level}" for level in LEVELS)).orderBy("left", "right").limit(most)
    every = lambda tag: f.select(F.col("request_id").alias(tag), F.array_distinct(F.concat(informative(F.col("identifiers")), F.col("traces"), F.col("domains"), F.col("usernames"))).alias(f"{tag}_values"))
    both = s.join(every("left"), "left").join(every("right"), "right")
    shared = F.slice(F.array_sort(F.array_intersect("left_values", "right_values")), 1, samples)
    return both.select("left", "right", "session_score", "user_score", "org_score", *[f"link_{level}" for level in LEVELS], shared.alias("shared"))


def context_only(features: DataFrame, budget: int = PAIRS_PER_REQUEST) -> DataFrame:
    """Sessions by context and refine links alone; every request is its own user, project and organisation."""
    scratch = Scratch(features.sparkSession, "context")
    f = scratch.save(features, "features")
    links = _uv(context_stage(f, budget)).unionByName(_uv(refine_stage(f, budget).where("link_session")))
    own = F.col("request_id")
    singles = _labels("context_only", f, session=own, user=own, project=own, org=own).where("level <> 'session'")
    return _components("context_only", {"session": links}, f).unionByName(singles)


def _drawn(*parts: Column) -> Column:
    """A random but fixed order: SHA-256 of the parts."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def random_control(features: DataFrame, seed: int = 7) -> DataFrame:
    """Requests in random order, dealt to as many clusters as the square root of their number (one count)."""
    order = features.select("request_id", _drawn(F.lit(str(seed)), F.col("request_id")).alias("draw"))
    k = max(1, round(features.count() ** 0.5))
    label = (F.col("n") - 1) % k
    return _labels("random", numbered(order, ["draw", "request_id"]), session=label, user=label, project=label, org=label)


def oracle_size_control(features: DataFrame, truth: DataFrame, seed: int = 7) -> DataFrame:
    """Requests in random order, dealt to clusters of the sizes that the truth has (largest first), at each level.

    ``truth``: ``level``, ``request_id``, ``label``.  Requests without truth are
    left over and are clusters of their own.
    """
    scratch = Scratch(features.sparkSession, "oracle")
    ids = features.select("request_id").join(truth, "request_id")
    sizes = scratch.save(numbered(ids.groupBy("level", "label").agg(F.count("*").alias("size")).withColumn("down", -F.col("size")), ["down", "label"], ["level"]), "sizes")
    ends = running_sum(sizes, ["n"], ["level"], "size", "end").select("level", F.col("n").alias("cluster"), (F.col("end") - F.col("size")).alias("begin"))
    spread = features.select("request_id", F.explode(F.array(*map(F.lit, LEVELS))).alias("level")).withColumn("draw", _drawn(F.lit(str(seed)), F.col("level"), F.col("request_id")))
    dealt = numbered(spread, ["draw", "request_id"], ["level"]).select("level", "request_id", (F.col("n") - 1).alias("at"))
    # a position belongs to the last cluster that begins at or before it; both sides are merged by position
    both = dealt.select("level", "at", "request_id", F.lit(None).cast("long").alias("cluster"), F.lit(1).alias("k")).unionByName(ends.select("level", F.col("begin").alias("at"), F.lit(None).cast("string").alias("request_id"), "cluster", F.lit(0).alias("k")))
    total = sizes.groupBy("level").agg(F.sum("size").alias("total"))
    filled = running_max(both, ["at", "k", "request_id"], ["level"], "cluster", "own").where("k = 1").join(total, "level", "left")
    label = F.when(F.col("at") < F.coalesce("total", F.lit(0)), F.col("own").cast("string")).otherwise(F.concat(F.lit("alone "), "request_id"))
    return filled.select(F.lit("oracle_size_random").alias("method"), "level", "request_id", label.alias("label"))


METHODS = {"temporal": temporal, "tool": tool, "rare": rare, "prefix": prefix, "hybrid": hybrid, "context_only": context_only, "low_cost": low_cost, "random": random_control}


def run_methods(features: DataFrame, names: list[str]) -> DataFrame:
    unknown = [n for n in names if n not in METHODS]
    if unknown:
        raise ValueError(f"unknown methods: {unknown}")
    return reduce(DataFrame.unionByName, [METHODS[n](features) for n in names])
