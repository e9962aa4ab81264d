"""Redaction and ablation transforms over messages, their utility and lineage.

Transforms map the nested messages in place with native expressions; the log
stays one row per request.  Dictionaries of placeholders are numbered by first
occurrence in an explicit order (instant, request, message, match), with
counts per range piece, so no task numbers the whole corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import DOMAIN, IDENTIFIER, PATH, token_count
from ..functions.instants import instant_millis
from ..scratch import Scratch
from .ordered import numbered

# Patterns and texts of the transforms.
SECRET = r"\b(?:sk|pk|ghp|xoxb|AKIA|ASIA)[-_A-Za-z0-9]{12,}\b"
CONNECTION = r"(?i)\b(?:postgres|mysql|redis|mongodb)://[^\s]+"
WORKSPACE_PATH = r"/workspace/[A-Za-z0-9_.-]+(?:__[A-Za-z0-9_.-]+)?[A-Za-z0-9_./-]*"
WORKSPACE_SLUG = r"(?<=/workspace/)[A-Za-z0-9_.-]+(?:__[A-Za-z0-9_.-]+)?"
SYSTEM_TEXT = "You are an LLM coding agent. Keep context minimal."
ASSISTANT_TEXT = "I will inspect only the relevant failure and patch the minimal scope."
PRIOR_MARK = "\nPrior context:\n"
PRIOR_TEXT = "\nPrior context: [LOCAL_SUMMARY_REDACTED]"
LENGTHS = (64, 128, 256, 512, 1024)


def map_contents(rows: DataFrame, change: Callable[[Column], Column], recount: bool = True) -> DataFrame:
    """Every content through ``change``; null contents stay null."""
    out = rows.withColumn("messages", F.transform("messages", lambda m: m.withField("content", change(m["content"]))))
    return out.withColumn("token_count", token_count(F.col("messages"))) if recount else out


def filter_secrets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SECRET, "[SECRET]"), CONNECTION, "[CONNECTION_STRING]")


def path_type_only(text: Column) -> Column:
    return F.regexp_replace(text, WORKSPACE_PATH, "[WORKSPACE_PATH]")


def minimize_context(rows: DataFrame) -> DataFrame:
    """Fixed system and assistant texts, users without prior context, tools by their first two lines."""

    def one(m: Column) -> Column:
        c = F.coalesce(m["content"], F.lit(""))
        user = F.when(F.contains(c, F.lit(PRIOR_MARK)), F.concat(F.substring_index(c, PRIOR_MARK, 1), F.lit(PRIOR_TEXT))).otherwise(c)
        lines = F.filter(F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n"), lambda x: F.trim(x) != "")
        tool = F.array_join(F.slice(lines, 1, 2), "\n")
        role = m["role"]
        return m.withField("content", F.when(role == "system", SYSTEM_TEXT).when(role == "user", user).when(role == "assistant", ASSISTANT_TEXT).when(role == "tool", tool).otherwise(m["content"]))

    out = rows.withColumn("messages", F.transform("messages", one))
    return out.withColumn("token_count", token_count(F.col("messages")))


def length_bucket(count: Column) -> Column:
    c = F.coalesce(count, F.lit(0))
    return F.when(c <= 64, 64).when(c <= 128, 128).when(c <= 256, 256).when(c <= 512, 512).otherwise(1024)


def broker_mix(rows: DataFrame, seed: int = 7) -> DataFrame:
    """Instants moved by 0 to 180 minutes, drawn from a hash of request and seed; token counts by bucket."""
    delay = F.floor(unit_fraction(F.concat_ws(":", F.lit(str(seed)), "request_id")) * 181).cast("long") * 60_000
    ms = F.col("ms") if "ms" in rows.columns else instant_millis(F.col("timestamp"))
    return rows.withColumn("ms", ms + delay).withColumn("token_count", length_bucket(F.col("token_count")))


def ablate(rows: DataFrame, name: str) -> DataFrame:
    """One of the content ablations, with the token count taken anew."""
    removers = {
        "no_paths": lambda c: F.regexp_replace(c, PATH, "[PATH]"),
        "no_workspace_paths": lambda c: F.regexp_replace(c, WORKSPACE_PATH, "[WORKSPACE_PATH]"),
        "no_domains": lambda c: F.regexp_replace(c, f"(?i){DOMAIN}", "[DOMAIN]"),
        "no_repo_ids": lambda c: F.regexp_replace(F.regexp_replace(c, r"\brepository=[^\s]+", "repository=[REPO]"), r"/workspace/[^/\s]+", "/workspace/[REPO]"),
        "no_repository_fields": lambda c: F.regexp_replace(c, r"\brepository=[^\s]+", "repository=[REPO]"),
        "no_secrets": filter_secrets,
    }
    if name not in removers:
        raise ValueError(f"unknown ablation: {name}")
    return map_contents(rows, removers[name])


def strict_sanitize(text: Column) -> Column:
    """Repositories, paths, internal domains and ``a/b`` pairs, in this order."""
    t = F.regexp_replace(text, r"\brepository=[^\s]+", "repository=[REPO]")
    t = F.regexp_replace(t, PATH, "[PATH]")
    t = F.regexp_replace(t, f"(?i){DOMAIN}", "[DOMAIN]")
    return F.regexp_replace(t, r"\b[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\b", "[PAIR]")


def _padded(n: Column, width: int) -> Column:
    """The number with zeros to the width, never cut."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


# -- dictionaries by first occurrence --------------------------------------------------
def entity_dictionary(rows: DataFrame, pattern: str, kind: str, width: int = 4) -> DataFrame:
    """Placeholders ``[KIND_0001]`` of all distinct matches (in small letters), by first occurrence.

    ``rows``: ``request_id``, ``ms``, ``messages``.
    """
    each = rows.select("request_id", "ms", F.posexplode("messages").alias("i", "m")).select("request_id", "ms", "i", F.posexplode(F.regexp_extract_all("m.content", F.lit(pattern), 0)).alias("k", "value"))
    firsts = each.groupBy(F.lower("value").alias("value")).agg(F.min(F.struct("ms", "request_id", "i", "k")).alias("at"))
    return numbered(firsts, ["at", "value"]).select("value", F.concat(F.lit(f"[{kind}_"), _padded(F.col("n"), width), F.lit("]")).alias("placeholder"))


def replace_each(text: Column, pattern: str, name: Callable[[Column], Column]) -> Column:
    """Every match of a pattern by ``name(match)``; the text between matches stays, whatever it holds."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.array_join(F.zip_with(between, found, lambda t, v: F.concat(t, F.coalesce(name(v), v, F.lit("")))), "")


def redact_entities(rows: DataFrame, pattern: str, kind: str) -> DataFrame:
    """Replaces all matches of a pattern by the corpus-wide placeholders.

    Only distinct matches of a request are joined with the dictionary, so texts
    move once.  Null contents stay null.
    """
    words = entity_dictionary(rows, pattern, kind)
    used = rows.select("request_id", F.explode(F.array_distinct(F.flatten(F.transform("messages", lambda m: F.coalesce(F.regexp_extract_all(m["content"], F.lit(pattern), 0), F.array().cast("array<string>")))))).alias("match"))
    named = used.join(words, F.lower("match") == F.col("value")).groupBy("request_id").agg(F.map_from_entries(F.collect_set(F.struct("match", "placeholder"))).alias("names"))
    out = rows.join(named, "request_id", "left")
    changed = map_contents(out.where(F.col("names").isNotNull()), lambda c: replace_each(c, pattern, lambda v: F.element_at("names", v)))
    return changed.drop("names").unionByName(out.where(F.col("names").isNull()).drop("names"))


def redact_all_entities(rows: DataFrame) -> DataFrame:
    """Paths, then domains, then identifiers; each pass sees the text after the one before, from a table."""
    scratch = Scratch(rows.sparkSession, "entities")
    rows = scratch.save(rows, "pass0")
    for n, (pattern, kind) in enumerate(((PATH, "PATH"), (f"(?i){DOMAIN}", "DOMAIN"), (IDENTIFIER, "ID"))):
        rows = scratch.save(redact_entities(rows, pattern, kind), f"pass{n + 1}")
        scratch.drop(f"pass{n}")
    return rows


def pseudonymize_workspaces(rows: DataFrame, scope: str = "stable") -> DataFrame:
    """Workspace slugs by pseudonyms: of the corpus (``stable``) or of the request alone (``request``)."""
    if scope == "request":
        slugs = F.array_distinct(F.flatten(F.transform("messages", lambda m: F.coalesce(F.transform(F.regexp_extract_all(m["content"], F.lit(WORKSPACE_SLUG), 0), lambda s: F.lower(s)), F.array().cast("array<string>")))))
        name = lambda v: F.concat(F.lit("workspace_"), F.col("request_id"), F.lit("_"), _padded(F.array_position("slugs", F.lower(v)), 3))
        return map_contents(rows.withColumn("slugs", slugs), lambda c: replace_each(c, WORKSPACE_SLUG, name)).drop("slugs")
    renamed = redact_entities(rows, WORKSPACE_SLUG, "WORKSPACE")
    return map_contents(renamed, lambda c: F.regexp_replace(c, r"/workspace/\[WORKSPACE_(\d+)\]", "/workspace/workspace_$1"))


def utility(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: requests, and how much of characters, tokens and marks a transform keeps."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        text = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
        t = df.select("request_id", text.alias("t"), "token_count")
        count = lambda p: F.coalesce(F.regexp_count("t", F.lit(p)), F.lit(0))
        return t.select("request_id", F.coalesce(F.char_length("t"), F.lit(0)).alias(f"chars_{tag}"), F.coalesce("token_count", F.lit(0)).alias(f"tokens_{tag}"), count(PATH).alias(f"paths_{tag}"), count(SECRET).alias(f"secrets_{tag}"), count(r"\[SECRET\]").alias(f"marks_{tag}"))

    both = side(before, "a").join(side(after, "b"), "request_id")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    kept = lambda c: F.when(total(f"{c}_a") > 0, total(f"{c}_b") / total(f"{c}_a")).otherwise(F.lit(0.0))
    return both.agg(F.count("*").alias("requests"), kept("chars").alias("char_retention"), kept("tokens").alias("token_retention"), (total("paths_a") - total("paths_b")).alias("paths_removed"), (total("secrets_a") - total("secrets_b")).alias("secrets_removed"), total("marks_b").alias("placeholders"))


# -- turn deltas, snapshots, samples ------------------------------------------------------
def turn_deltas(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Messages since the previous turn of the group; the last message where there are none."""
    w = Window.partitionBy(group).orderBy(order, "request_id")
    n = F.coalesce(F.size("messages"), F.lit(0))
    out = rows.withColumn("n", F.when(n < 0, 0).otherwise(n)).withColumn("since", F.coalesce(F.lag("n").over(w), F.lit(0)))
    start = F.when(F.col("since") >= F.col("n"), F.greatest(F.lit(1), F.col("n"))).otherwise(F.col("since") + 1)
    return out.withColumn("delta", F.when(F.col("n") > 0, F.slice("messages", start, F.col("n"))).otherwise(F.array().cast(rows.schema["messages"].dataType)))


def hash_sample(rows: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """k rows of smallest hash (SHA-256 of seed and key): uniform, the same in every run, no shuffle of whole rows before the cut."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(k)


# -- anchors under stress ----------------------------------------------------------------
def unit_fraction(key: Column) -> Column:
    """A number in [0, 1] from the first 64 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 18446744073709551615.0


def retain_anchors(anchors: DataFrame, share: float, seed: int = 7) -> DataFrame:
    """Rows whose (request, anchor) draw is below the share."""
    return anchors.where(unit_fraction(F.concat_ws(":", F.lit(str(seed)), "request_id", "anchor")) < share)


def rotate_anchors(anchors: DataFrame, share: float, seed: int = 7) -> DataFrame:
    drawn = unit_fraction(F.concat_ws(":", F.lit(f"rotate{seed}"), "anchor")) < share
    return anchors.withColumn("anchor", F.when(drawn, F.concat("anchor", F.lit(":rotated"))).otherwise(F.col("anchor")))


def collide_anchors(anchors: DataFrame, share: float, buckets: int = 16, seed: int = 7) -> DataFrame:
    drawn = unit_fraction(F.concat_ws(":", F.lit(f"collide{seed}"), "anchor")) < share
    return anchors.withColumn("anchor", F.when(drawn, F.concat(F.lit("collided:"), F.pmod(F.xxhash64("anchor", F.lit(seed)), F.lit(buckets)).cast("string"))).otherwise(F.col("anchor")))


# -- spans with lineage ------------------------------------------------------------------
# The categories of spans and their patterns.
CATEGORIES = {
    "workspace": r"(?<=/workspace/)[A-Za-z0-9_.-]+",
    "repository": r"(?<=repository=)[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+",
    "domain": r"(?i)\b(?:[a-z0-9-]+\.)+(?:internal|local|prod|corp)\b",
    "typed_handle": r"(?i)\b(?:user|customer|account|order|reservation|booking|case|ticket|tenant|organization|org|project|queue|product|item|flight)[_-](?=[A-Za-z0-9_.:/@-]*\d)[A-Za-z0-9][A-Za-z0-9_.:/@-]{3,}\b",
}


def span_edits(rows: DataFrame, categories: tuple[str, ...] = tuple(CATEGORIES)) -> DataFrame:
    """Non-overlapping spans of the categories: request, message, category, start, end, original, source hash.

    Native functions give no positions, so this is an Arrow function over the
    contents that can hold a span at all.  Candidates are taken by start, then
    the longest, then category.  Null contents and messages give none.
    """
    unknown = [c for c in categories if c not in CATEGORIES]
    if unknown:
        raise ValueError(f"unknown categories: {unknown}")
    compiled = [(name, re.compile(CATEGORIES[name])) for name in categories]

    @F.pandas_udf("array<struct<category:string,start:int,end:int,original:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            if not text:
                return []
            found = sorted((m.start(), -len(m.group()), name, m.group()) for name, p in compiled for m in p.finditer(text))
            out, end = [], 0
            for start, size, name, original in found:
                if start >= end:
                    end = start - size
                    out.append({"category": name, "start": start, "end": end, "original": original})
            return out

        return texts.map(one)

    any_of = "|".join(f"(?:{CATEGORIES[c]})" for c in categories)
    each = rows.select("request_id", "ms", F.posexplode("messages").alias("message_index", "m")).where(F.col("m.content").rlike(any_of))
    each = each.select("request_id", "ms", "message_index", F.sha2("m.content", 256).alias("source_hash"), F.explode(spans(F.col("m.content"))).alias("s"))
    return each.select("request_id", "ms", "message_index", "source_hash", "s.*")


def span_lineage(rows: DataFrame, scope: str = "dataset", categories: tuple[str, ...] = tuple(CATEGORIES)) -> DataFrame:
    """Edits with replacements, numbered within each category by first occurrence.

    ``scope``: equal originals (in any case) get one replacement in the whole
    log (``dataset``) or in each request (``request``).
    """
    if scope not in ("dataset", "request"):
        raise ValueError(f"unknown scope: {scope}")
    own = F.col("request_id") if scope == "request" else F.lit("")
    edits = Scratch(rows.sparkSession, "edits").save(span_edits(rows, categories).withColumns({"scope": own, "value": F.lower("original")}), "edits")
    firsts = edits.groupBy("scope", "category", "value").agg(F.min(F.struct("ms", "request_id", "message_index", "start")).alias("at"))
    names = numbered(firsts, ["at", "scope", "value"], ["category"])
    four, six = _padded(F.col("n"), 4), _padded(F.col("n"), 6)
    replacement = (
        F.when(F.col("category") == "workspace", F.concat(F.lit("workspace_"), four))
        .when(F.col("category") == "repository", F.concat(F.lit("owner_"), four, F.lit("/repo_"), four))
        .when(F.col("category") == "domain", F.concat(F.lit("service-"), four, F.lit(".internal")))
        .otherwise(F.concat(F.regexp_extract("value", "^[^_-]*", 0), F.lit("_p"), six))
    )
    return edits.join(names.select("scope", "category", "value", replacement.alias("replacement")), ["scope", "category", "value"]).drop("scope", "value")


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Contents with the edits applied, from the last to the first: ``request_id``, ``message_index``, ``content``."""
    listed = edits.groupBy("request_id", "message_index").agg(F.reverse(F.array_sort(F.collect_set(F.struct("start", "end", "replacement")))).alias("edits"))
    each = rows.select("request_id", F.posexplode("messages").alias("message_index", "m")).select("request_id", "message_index", F.col("m.content").alias("content"))
    change = F.aggregate("edits", F.col("content"), lambda c, e: F.concat(F.substr(c, F.lit(1), e["start"]), e["replacement"], F.substr(c, e["end"] + 1)))
    return each.join(listed, ["request_id", "message_index"]).select("request_id", "message_index", change.alias("content"))


def apply_lineage(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows with the edited contents in their messages."""
    changed = apply_edits(rows, edits).groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("message_index", "content"))).alias("changed"))
    out = rows.join(changed, "request_id", "left")
    edit = lambda m, i: m.withField("content", F.coalesce(F.element_at("changed", i), m["content"]))
    return out.withColumn("messages", F.when(F.col("changed").isNull(), F.col("messages")).otherwise(F.transform("messages", edit))).drop("changed")


def validate_lineage(source: DataFrame, transformed: DataFrame, edits: DataFrame) -> DataFrame:
    """One row: requests, edits, characters, edited characters and their share, and how many requests break a rule each.

    Rules: the same requests on both sides; as many messages, with the same
    roles and names; each edit's original at its place, with its source's hash;
    the edits applied to the source give the transformed contents.
    """
    side = lambda df, tag: df.select("request_id", F.col("messages").alias(f"{tag}_messages"))
    both = side(source, "a").join(side(transformed, "b"), "request_id", "full")
    shape = lambda c: F.transform(c, lambda m: F.struct(m["role"].alias("role"), m["name"].alias("name")))
    a, b = F.coalesce(F.size("a_messages"), F.lit(-1)), F.coalesce(F.size("b_messages"), F.lit(-1))
    rules = both.agg(
        F.count("a_messages").alias("_"), F.count_if(F.col("a_messages").isNull() != F.col("b_messages").isNull()).alias("unmatched_requests"),
        F.count_if(a != b).alias("changed_counts"), F.count_if((a == b) & ~shape("a_messages").eqNullSafe(shape("b_messages"))).alias("changed_shapes"),
        F.coalesce(F.sum(F.aggregate("a_messages", F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.char_length(m["content"]), F.lit(0)))), F.lit(0)).alias("source_characters"), F.count("*").alias("requests"),
    )
    each = lambda df: df.select("request_id", F.posexplode("messages").alias("message_index", "m")).select("request_id", "message_index", F.col("m.content").alias("content"))
    places = edits.join(each(source), ["request_id", "message_index"], "left")
    fits = F.coalesce((F.substring(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("original")) & (F.sha2("content", 256) == F.col("source_hash")), F.lit(False))
    declared = places.agg(F.count("*").alias("edits"), F.count_if(~fits).alias("misplaced_edits"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("edited_characters"))
    expected = each(source).join(apply_edits(source, edits).withColumnRenamed("content", "edited"), ["request_id", "message_index"], "left").select("request_id", "message_index", F.coalesce("edited", "content").alias("expected"))
    wrong = expected.join(each(transformed), ["request_id", "message_index"]).agg(F.count_if(~F.col("expected").eqNullSafe(F.col("content"))).alias("unreproduced_contents"))
    share = F.when(F.col("source_characters") > 0, F.col("edited_characters") / F.col("source_characters")).otherwise(F.lit(0.0))
    one = rules.drop("_").crossJoin(declared).crossJoin(wrong)  # three single rows
    return one.withColumn("edited_share", share)


# -- the registry of defences ------------------------------------------------------------
def _canonical(rows: DataFrame) -> DataFrame:
    return rows if "ms" in rows.columns else rows.withColumn("ms", instant_millis(F.col("timestamp")))


DEFENSES: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "M0": lambda rows, seed: rows,
    "M1": lambda rows, seed: map_contents(rows, filter_secrets),
    "M2": lambda rows, seed: redact_all_entities(rows),
    "M3": lambda rows, seed: minimize_context(rows),
    "M4": lambda rows, seed: broker_mix(rows, seed),
    "M7_WORKSPACE_STABLE": lambda rows, seed: pseudonymize_workspaces(rows),
    "M8_WORKSPACE_SESSION": lambda rows, seed: pseudonymize_workspaces(rows, "request"),
    "M9_PATH_TYPE_ONLY": lambda rows, seed: map_contents(rows, path_type_only),
}
#: Defences made of others, in order.
COMPOSED = {"M6": ("M1", "M2", "M3", "M4")}


def apply_defense(rows: DataFrame, name: str, seed: int = 7) -> DataFrame:
    """A defence by its name, over canonical requests; adds the column ``defense``."""
    steps = COMPOSED.get(name, (name,))
    if any(s not in DEFENSES for s in steps):
        raise ValueError(f"unknown defense: {name}")
    out = _canonical(rows)
    for s in steps:
        out = DEFENSES[s](out, seed)
    return out.withColumn("defense", F.lit(name))
