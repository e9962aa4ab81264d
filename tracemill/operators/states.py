"""Bounded states of requests and the evidence of pairs of them.

A state keeps no text: bottom-k sketches of hashed events, fingerprints of
errors and resources, roots and typed handles, each with a cap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import let
from ..functions.handles import stable_handles
from .components import components
from .requests import canonical_requests

# Caps of the sketches and lists.
REPLAY, INITIAL, RECENT, TOOL = 64, 24, 32, 24
TOOL_NAMES, ARGUMENTS, ACTIONS, ERRORS, RESOURCES, HANDLES = 24, 48, 12, 12, 32, 32
RECENT_MESSAGES = 4
TOKEN = r"[A-Za-z][A-Za-z0-9_./:@-]{2,}"
ERROR = r"(?i)\b(error|exception|failed|failure|traceback|timeout|denied)\b"
RESOURCE = r"(?i)(?:/[^\s'\"]+|\b(?:https?://|s3://|gs://)[^\s'\"]+|\b(?:order|reservation|booking|case|ticket|product|flight|repo(?:sitory)?)[_:=/-][A-Za-z0-9_.:/@-]+)"
ROOT = r"(?i)/workspace/([A-Za-z0-9_.-]+)"
REPOSITORY = r"(?i)\brepository=([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)\b"
ACTION_MARKS = {"read": ("get", "read", "list", "show", "inspect", "check", "search", "find"), "write": ("create", "update", "set", "issue", "cancel", "delete", "write", "patch"), "execute": ("run", "exec", "test", "build", "deploy")}


def bottom(values: Column, k: int) -> Column:
    """The k smallest distinct values."""
    return F.slice(F.array_sort(F.array_distinct(values)), 1, k)


def hashed(text: Column) -> Column:
    """A number of 60 bits from MD5, so that other engines give the same sketches."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def event_hash(m: Column) -> Column:
    content = F.array_join(F.filter(F.split(F.coalesce(m["content"], F.lit("")), r"\s+"), lambda t: t != ""), " ")
    return hashed(F.concat(F.coalesce(m["role"], F.lit("")), F.lit("\n"), F.coalesce(m["name"], F.lit("")), F.lit("\n"), content))


def text_sketch(text: Column, k: int) -> Column:
    """Bottom-k of hashed runs of three tokens; of the tokens where there are fewer."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - 2)), lambda i: hashed(F.array_join(F.slice(t, i, 3), " ")))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda t: F.lower(t))
    return bottom(let(tokens, lambda t: F.when(F.size(t) < 3, F.transform(t, hashed)).otherwise(runs(t))), k)


def action_type(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(low == "", "")
    for action, marks in ACTION_MARKS.items():
        for mark in marks:
            out = out.when(F.contains(low, F.lit(mark)), action)
    return out.otherwise("other")


def agent_states(attack_view: DataFrame) -> DataFrame:
    """One bounded state per request; null messages and tools give empty sketches."""
    r = canonical_requests(attack_view, "messages", "tool_schemas", "token_count")
    m = F.coalesce(F.col("messages"), F.array().cast(attack_view.schema["messages"].dataType))
    r = r.withColumn("m", m).withColumn("handles", stable_handles(F.col("m")))
    role = lambda name: F.filter("m", lambda x: x["role"] == name)
    contents = F.transform("m", lambda x: F.coalesce(x["content"], F.lit("")))
    found = lambda pattern, group: F.flatten(F.transform(contents, lambda c: F.regexp_extract_all(c, F.lit(pattern), group)))
    names = F.array_distinct(F.filter(F.concat(F.transform(role("tool"), lambda x: x["name"]), F.coalesce(F.transform("tool_schemas", lambda s: s["name"]), F.array().cast("array<string>"))), lambda n: n.isNotNull() & (n != "")))
    arguments = F.coalesce(F.flatten(F.transform("tool_schemas", lambda s: F.coalesce(s["parameters"], F.array().cast("array<string>")))), F.array().cast("array<string>"))
    errors = F.flatten(F.transform(contents, lambda c: F.transform(F.regexp_extract_all(c, F.lit(ERROR), 1), lambda e: hashed(F.concat(F.lower(e), F.lit("\n"), F.right(c, F.lit(160)))))))
    roots = F.concat(F.transform(found(ROOT, 1), lambda v: F.concat(F.lit("workspace:"), F.lower(v))), F.transform(found(REPOSITORY, 1), lambda v: F.concat(F.lit("repository:"), F.lower(v))))
    level = lambda name: F.slice(F.array_sort(F.filter("handles", lambda h: F.startswith(h, F.lit(f"stable_{name}:")))), 1, HANDLES)
    events = lambda part: F.transform(part, event_hash)
    n = F.size("m")
    return r.select(
        "request_id", "bucket", F.floor(F.col("ms") / 1000).alias("second"), n.alias("message_count"), F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.aggregate(contents, F.lit(0), lambda a, c: a + F.char_length(c)).alias("content_chars"),
        bottom(events(F.col("m")), REPLAY).alias("replay"), text_sketch(F.coalesce(F.get(role("user"), F.lit(0))["content"], F.lit("")), INITIAL).alias("initial"),
        bottom(events(F.slice("m", F.greatest(F.lit(1), n - RECENT_MESSAGES + 1), F.lit(RECENT_MESSAGES))), RECENT).alias("recent"), bottom(events(role("tool")), TOOL).alias("tool"),
        bottom(names, TOOL_NAMES).alias("tool_names"), bottom(arguments, ARGUMENTS).alias("arguments"), bottom(F.filter(F.transform(names, action_type), lambda a: a != ""), ACTIONS).alias("actions"),
        bottom(errors, ERRORS).alias("errors"), bottom(F.transform(F.array_distinct(found(RESOURCE, 0)), lambda v: hashed(F.lower(v))), RESOURCES).alias("resources"), bottom(roots, RESOURCES).alias("roots"),
        level("user").alias("user_handles"), level("project").alias("project_handles"), level("org").alias("org_handles"), level("context").alias("context_handles"),
    )


_SKETCHES = ("replay", "initial", "recent", "tool", "errors", "resources", "roots", "user_handles", "project_handles", "org_handles", "context_handles")


def state_size() -> Column:
    """Number of kept values of a state."""
    return sum((F.size(c) for c in _SKETCHES[1:]), F.size(_SKETCHES[0]))


def state_bytes() -> Column:
    """Estimated bytes of a state: a fixed part, and for every kept value a fixed part and its characters."""
    kept = F.concat(*[F.transform(c, lambda v: v.cast("string")) for c in (*_SKETCHES, "tool_names", "arguments", "actions")])
    return F.aggregate(kept, F.lit(160).cast("long") + 49 + F.char_length("bucket"), lambda n, v: n + 49 + F.char_length(v))


#: Families of postings by which candidates are found, and the lists that evidence compares.
POSTINGS = ("replay", "initial", "user_handles", "project_handles", "org_handles", "tool", "resources", "roots")
COMPARED = (*POSTINGS, "context_handles")
# The linker's window, caps and gates.
WINDOW_SECONDS, POSTING_CAP, CANDIDATES = 5_400, 64, 96
# Families of evidence.
FAMILIES = ("state_replay", "initial_task", "typed_handle", "tool_resource", "resource_root", "ordered_progression")


@dataclass(frozen=True)
class LinkRules:
    """Which evidence counts, and the gate of acceptance."""

    families: tuple[str, ...] = FAMILIES
    accept_score: float = 4.2
    least_families: int = 3
    least_margin: float = 0.35
    conflicts: bool = True
    window: int = WINDOW_SECONDS


# Variants of the rules that leave out evidence.
VARIANTS = {
    "full": LinkRules(),
    "replay_only": LinkRules(families=("state_replay", "initial_task", "ordered_progression"), accept_score=3.0, least_families=2),
    "tool_resource_only": LinkRules(families=("tool_resource", "resource_root", "ordered_progression"), accept_score=4.3, least_families=3),
    "typed_handle_only": LinkRules(families=("typed_handle", "ordered_progression"), accept_score=1.3, least_families=2),
    "without_conflicts": LinkRules(conflicts=False),
}


def judge(v, rules: LinkRules, least, number):
    """Families and conflicts (name to condition) and score of a pair: the one place of these rules.

    ``v`` names the pair's overlaps, shares and differences; they are columns,
    with ``least`` and ``number`` (of a condition) as column functions, or plain
    numbers, with those of Python, so batch and stream say the same.
    """
    typed = v["user_handles"] + v["project_handles"] + v["org_handles"]
    progress = (v["delta"] >= 0) & (v["delta"] <= 21_600) & ((v["growth"] > 0) | (v["resources"] > 0))
    families = {
        "state_replay": v["replay"] >= 0.75, "initial_task": v["initial"] >= 0.6, "typed_handle": typed > 0, "tool_resource": (v["tool"] > 0) | (v["resources"] > 0), "resource_root": v["roots"] > 0, "ordered_progression": progress,
    }
    conflicts = {
        "time_reversal": v["delta"] < 0, "context_shrink": (v["growth"] < 0) & (v["replay"] >= 0.5), "incompatible_user_handles": v["apart_user_handles"], "incompatible_org_handles": v["apart_org_handles"],
        "competing_initial_roots": (v["initial"] < 0.2) & v["both_initial"],
    }
    parts = {
        "state_replay": 3.0 * v["replay"], "initial_task": 1.5 * v["initial"], "typed_handle": 0.8 * least(typed + v["context_handles"], 2) * number(families["typed_handle"]), "tool_resource": 0.5 * least(v["tool"] + v["resources"], 2),
        "resource_root": 3.0 * number(families["resource_root"]), "ordered_progression": 0.8 * number(progress),
    }
    on = [f for f in FAMILIES if f in rules.families]
    return {f: families[f] for f in on}, conflicts if rules.conflicts else {}, sum(parts[f] for f in on)


def gate(v, rules: LinkRules):
    """The steps of the decision, in order: condition, disposition, reason.  ``v`` has the best pair's evidence and the margin."""
    rooted = v["resource_root"] & ~v["state_replay"]
    return [
        (v["n_conflicts"] > 0, "reject", "hard_conflict"), (v["delta"] > rules.window, "abstain", "session_gap_exceeded"), (rooted & ~(v["ordered_progression"] & v["tool_resource"]), "abstain", "resource_root_without_progression"),
        (rooted & (v["resources"] < 2), "abstain", "weak_resource_continuity"), (v["score"] < rules.accept_score, "abstain", "insufficient_score"), (v["n_families"] < rules.least_families, "abstain", "insufficient_independent_evidence"),
        (v["margin"] < rules.least_margin, "abstain", "ambiguous_runner_up"),
    ]


def evidence(pairs: DataFrame, rules: LinkRules = VARIANTS["full"]) -> DataFrame:
    """Evidence columns of pairs with ``e_`` (earlier) and ``l_`` (later) state columns."""
    e, l = (lambda c: F.col(f"e_{c}")), (lambda c: F.col(f"l_{c}"))  # noqa: E741
    over = lambda c: F.size(F.array_intersect(e(c), l(c)))
    some = lambda c: (F.size(e(c)) > 0) & (F.size(l(c)) > 0)
    part = lambda c: F.when(F.size(e(c)) > 0, over(c) / F.size(e(c))).otherwise(0.0)
    shared = pairs.select(
        F.col("e_request_id").alias("earlier_id"), F.col("l_request_id").alias("later_id"), *[part(c).alias(c) for c in ("replay", "initial")], *[over(c).alias(c) for c in COMPARED if c not in ("replay", "initial")],
        (l("second") - e("second")).alias("delta"), (l("message_count") - e("message_count")).cast("long").alias("growth"), *[some(c).alias(f"some_{c}") for c in ("user_handles", "org_handles", "initial")],
    )
    c = F.col
    v = {n: c(n) for n in (*COMPARED, "delta", "growth")} | {f"apart_{n}": c(f"some_{n}") & (c(n) == 0) for n in ("user_handles", "org_handles")} | {"both_initial": c("some_initial")}
    families, conflicts, score = judge(v, rules, lambda a, b: F.least(a, F.lit(b)), lambda cond: F.coalesce(cond.cast("int"), F.lit(0)))
    listed = lambda d: F.array_compact(F.array(*[F.when(cond, name) for name, cond in d.items()])) if d else F.array().cast("array<string>")
    return shared.select(
        "earlier_id", "later_id", c("replay").alias("replay_containment"), c("initial").alias("initial_task_containment"), (c("user_handles") + c("project_handles") + c("org_handles") + c("context_handles")).alias("handle_overlap"),
        c("tool").alias("tool_observation_overlap"), c("resources").alias("resource_overlap"), c("delta").alias("time_delta_seconds"), c("growth").alias("length_growth"), listed(families).alias("evidence_families"), listed(conflicts).alias("conflicts"), score.alias("score"),
    )


def decide(ranked: DataFrame, rules: LinkRules = VARIANTS["full"]) -> DataFrame:
    """Decision columns from the best evidence of each request and the runner-up's score.

    ``ranked``: ``request_id``, the evidence of the best candidate (null
    ``earlier_id`` where there is none) and ``runner_up_score``.
    """
    c = F.col
    has = lambda f: F.array_contains("evidence_families", f)
    v = {f: has(f) for f in FAMILIES} | {"n_conflicts": F.size("conflicts"), "delta": c("time_delta_seconds"), "resources": c("resource_overlap"), "score": c("score"), "n_families": F.size("evidence_families"), "margin": c("score") - c("runner_up_score")}
    steps = [(c("earlier_id").isNull(), "abstain", "no_candidate"), *gate(v, rules)]

    def ladder(k: int, last: str) -> Column:
        out = F.when(steps[0][0], steps[0][k])
        for step in steps[1:]:
            out = out.when(step[0], step[k])
        return out.otherwise(last)

    empty = F.array().cast("array<string>")
    return ranked.select(
        "request_id", c("earlier_id").alias("predecessor_id"), ladder(1, "accept").alias("disposition"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("runner_up_score", F.lit(0.0)).alias("runner_up_score"),
        F.coalesce(c("score") - c("runner_up_score"), F.lit(0.0)).alias("margin"), F.coalesce("evidence_families", empty).alias("evidence_families"), F.coalesce("conflicts", empty).alias("conflicts"), ladder(2, "risk_gate_passed").alias("reason"),
    )


# Kinds of project handles that merge sessions.
MERGING_KINDS = ("repository", "workspace", "order", "reservation", "booking", "ticket")


def higher_level_links(sessions: DataFrame, states: DataFrame) -> DataFrame:
    """Links ``level``, ``u``, ``v`` of requests: those of a session, and those of sessions that share a handle of the level.

    ``sessions``: ``request_id``, ``label``.  Handles make stars with their
    first request, so a hot handle costs as many links as it has requests.
    """
    own = sessions.where(F.col("request_id") != F.col("label")).select(F.explode(F.array(*map(F.lit, ("user", "project", "org")))).alias("level"), F.col("label").alias("u"), F.col("request_id").alias("v"))
    kind = F.split("h", ":")[1]
    every = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"{level}_handles").alias("hs")) for level in ("user", "project", "org")]))
    held = states.select("request_id", every.alias("s")).select("request_id", "s.level", F.explode("s.hs").alias("h")).where((F.col("level") != "project") | kind.isin(*MERGING_KINDS))
    first = held.groupBy("level", "h").agg(F.min("request_id").alias("first"))
    return own.unionByName(held.join(first, ["level", "h"]).where("request_id <> first").select("level", F.col("first").alias("u"), F.col("request_id").alias("v")))


def higher_levels(sessions: DataFrame, states: DataFrame) -> DataFrame:
    """``level``, ``request_id``, ``label`` at the levels above the session, contracted together."""
    key = lambda name: F.concat_ws("\t", "level", F.col(name))
    links = higher_level_links(sessions, states)
    every = sessions.select(F.explode(F.array(*[F.concat_ws("\t", F.lit(level), "request_id") for level in ("user", "project", "org")])).alias("id"))
    found = components(links.select(key("u").alias("u"), key("v").alias("v")), every)
    part = lambda name, n: F.split(name, "\t", 2)[n]
    return found.select(part("id", 0).alias("level"), part("id", 1).alias("request_id"), part("label", 1).alias("label"))
