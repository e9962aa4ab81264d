"""Features of request texts as native expressions.

Every family is its own expression, so a plan computes only the families that
it selects.  Arrays are distinct and keep the order of first occurrence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the feature families (on lower-case text).
PATH = r"/(?:home|srv|opt|workspace|tmp)/[A-Za-z0-9_./-]+"
DOMAIN = r"\b(?:[a-z0-9-]+\.)+(?:internal|local|prod|corp)\b"
TRACE = r"\btrace-[a-z0-9-]+(?:-[a-z0-9-]+)+\b"
IDENTIFIER = r"\b[a-z][a-z0-9]+(?:[-_][a-z0-9]+)+\b"
REPOSITORY = r"\brepository=([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)\b"
WORKSPACE = r"/workspace/([^/\s]+)"
KEY_VALUE = r"\b(tenant|customer_ref|account_cache|case_id|queue|service_line|internal_domain|loyalty_tier|region)=([A-Za-z0-9_.:/@-]+)"
BUSINESS_OBJECT = r"(?i)\b(order|reservation|product)[_-]([a-z][a-z0-9]*\d{2}-(?:airline|retail)-[a-z]+(?:-[a-z]+)*-\d+)\b"
WORD = r"[a-zA-Z][a-zA-Z0-9_./:-]{2,}"
SECRET = r"\bsk-test-[A-Za-z0-9]{16,}\b"

# Budgets.
WINDOW_CHARS = 80_000
MAX_SHINGLES = 8_000
MAX_WORDS = 5_000
OMITTED = "\n[...middle omitted for feature budget...]\n"

# Words that carry no signal.
STOP_WORDS = (
    "about", "after", "also", "assistant", "because", "before", "content", "could", "error", "from", "have", "help", "into", "message", "need",
    "please", "request", "result", "should", "system", "that", "there", "this", "tool", "user", "using", "with", "would",
)


@dataclass(frozen=True)
class FeatureOptions:
    """Which families to compute and their budgets (None: no budget); a family that is off is an empty array."""

    words: bool = True
    shingles: bool = True
    identifiers: bool = True
    paths: bool = True
    domains: bool = True
    traces: bool = True
    signatures: bool = True
    repositories: bool = True
    business: bool = True
    handles: bool = True
    time: bool = True
    cache: bool = True
    window_chars: int | None = WINDOW_CHARS
    max_shingles: int | None = MAX_SHINGLES
    max_words: int = MAX_WORDS
    hashed: bool = True


def ablation(name: str) -> FeatureOptions:
    """Options with one family off: ``no_<family>``; ``all`` keeps all."""
    if name == "all":
        return FeatureOptions()
    family = name.removeprefix("no_")
    if family not in FeatureOptions.__dataclass_fields__:
        raise ValueError(f"unknown family: {family}")
    return FeatureOptions(**{family: False})


def bounded_text(text: Column, most: int | None = WINDOW_CHARS) -> Column:
    """The text, or its first and last half-budget around a mark where it is longer than ``most``."""
    if most is None:
        return text
    half = most // 2
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(OMITTED), F.right(text, F.lit(half))))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), group))


def matches(text: Column, pattern: str, group: int, *marks: str) -> Column:
    """All matches in lower-case text of a pattern of which every match has one of the marks; texts without a mark are not searched."""
    return F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks]), F.regexp_extract_all(text, F.lit(pattern), group)).otherwise(F.array().cast("array<string>"))


def paths(text: Column) -> Column:
    return found(text, PATH)


def domains(text: Column) -> Column:
    return F.array_distinct(matches(text, DOMAIN, 0, ".internal", ".local", ".prod", ".corp"))


def traces(text: Column) -> Column:
    return found(text, TRACE)


def plain_identifiers(text: Column) -> Column:
    return found(text, IDENTIFIER)


def usernames(path_list: Column) -> Column:
    """Users of ``/home/<user>/`` paths."""
    names = F.transform(path_list, lambda p: F.regexp_extract(p, r"^/home/([^/]+)/", 1))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def repositories(text: Column) -> Column:
    """Three typed ids (owner, name, full) of each repository field and workspace path."""
    fields = F.transform(matches(text, REPOSITORY, 0, "repository="), lambda m: F.array(F.regexp_extract(m, REPOSITORY, 1), F.regexp_extract(m, REPOSITORY, 2)))
    slugs = F.filter(F.transform(F.array_distinct(matches(text, PATH, 0, "/workspace/")), lambda p: F.regexp_extract(p, WORKSPACE, 1)), lambda s: F.contains(s, F.lit("__")))
    parts = F.transform(slugs, lambda s: F.array(F.substring_index(s, "__", 1), F.substr(s, F.instr(s, "__") + 2)))
    typed = lambda p: F.array(F.concat(F.lit("repo_owner:"), F.lower(p[0])), F.concat(F.lit("repo_name:"), F.lower(p[1])), F.concat(F.lit("repo_full:"), F.lower(p[0]), F.lit("/"), F.lower(p[1])))
    return F.array_distinct(F.flatten(F.transform(F.concat(fields, parts), typed)))


_KEYS = ("tenant", "customer_ref", "account_cache", "case_id", "queue", "service_line", "internal_domain", "loyalty_tier", "region")
_TRIM = "._-/:@;,'\"`()[]{}"


def business_keys(text: Column) -> Column:
    """Typed ids of ``key=value`` fields and of named objects: of users, projects and organisations."""
    pairs = F.transform(matches(text, KEY_VALUE, 0, *[f"{k}=" for k in _KEYS]), lambda m: F.struct(F.substring_index(m, "=", 1).alias("k"), F.btrim(F.lower(F.substr(m, F.instr(m, "=") + 1)), F.lit(_TRIM)).alias("v")))
    pairs = F.filter(pairs, lambda p: (F.char_length(p["v"]) >= 3) & (F.char_length(p["v"]) <= 120))

    def typed(p: Column) -> Column:
        k, v = p["k"], p["v"]
        label = lambda kind: F.concat(F.lit(f"business_{kind}:"), k, F.lit(":"), v)
        tenant = F.element_at(F.split(F.substring_index(v, ":acct:", 1), ":"), -1)
        return F.array_compact(
            F.array(
                F.when(k.isin("customer_ref", "account_cache"), label("user")),
                F.when(k.isin("queue", "internal_domain"), label("project")),
                F.when(k.isin("internal_domain", "tenant"), label("org")),
                F.when((k == "account_cache") & F.contains(v, F.lit(":acct:")) & (tenant != ""), F.concat(F.lit("business_org:tenant:"), tenant)),
            )
        )

    lower = F.lower(text)  # the pattern takes capitals too
    named = lambda group: F.when(F.contains(lower, F.lit("-airline-")) | F.contains(lower, F.lit("-retail-")), F.regexp_extract_all(text, F.lit(BUSINESS_OBJECT), group)).otherwise(F.array().cast("array<string>"))
    objects = F.zip_with(named(1), named(2), lambda k, v: F.struct(F.lower(k).alias("k"), F.btrim(F.lower(v), F.lit(_TRIM)).alias("v")))
    objects = F.filter(objects, lambda p: (F.char_length(p["v"]) >= 3) & (F.char_length(p["v"]) <= 120))
    projects = F.transform(objects, lambda p: F.concat(F.lit("business_project:"), p["k"], F.lit(":"), p["v"]))
    return F.array_distinct(F.concat(F.flatten(F.transform(pairs, typed)), projects))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often (and in whatever lambda) the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.lower(w))


def words(text: Column, most: int | None = MAX_WORDS) -> Column:
    """Normalised distinct words (all of them with ``most=None``): trimmed, 3 to 80 characters, the last part of paths, no stop words."""
    trimmed = F.transform(word_list(text), lambda w: F.btrim(w, F.lit("._:-/")))
    sized = F.filter(trimmed, lambda w: (F.char_length(w) >= 3) & (F.char_length(w) <= 80))
    rooted = lambda w: F.startswith(w, F.lit("/workspace/")) | F.startswith(w, F.lit("/home/")) | F.startswith(w, F.lit("/tmp/"))
    tails = F.transform(sized, lambda w: F.when(F.contains(w, F.lit("/")) & ~rooted(w), F.substring_index(w, "/", -1)).otherwise(w))
    kept = F.filter(tails, lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_distinct(kept) if most is None else F.slice(F.array_distinct(kept), 1, most)


def shingles(text: Column, size: int = 5, most: int | None = MAX_SHINGLES, hashed: bool = False) -> Column:
    """Distinct runs of ``size`` words in order, at most ``most`` (all with None); fewer words than that are their own shingles."""
    starts = lambda t: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - (size - 1)))
    if hashed:  # of the words' hashes: no text is put together
        runs = lambda t: F.transform(starts(t), lambda i: F.xxhash64(*[F.get(t, i + (k - 1)) for k in range(size)]))
        out = let(F.transform(word_list(text), lambda w: F.xxhash64(w)), lambda t: F.when(F.size(t) < size, t).otherwise(runs(t)))
    else:
        runs = lambda t: F.transform(starts(t), lambda i: F.array_join(F.slice(t, i, size), " "))
        out = let(word_list(text), lambda t: F.when(F.size(t) < size, t).otherwise(runs(t)))
    return F.array_distinct(out) if most is None else F.slice(F.array_distinct(out), 1, most)


def signatures(word_array: Column, bands: int = 8) -> Column:
    """For each band the four words of smallest hash, as one short hash; bands with fewer than two words give none."""

    def band(b: int, word_array: Column) -> Column:
        ranked = F.array_sort(F.transform(word_array, lambda w: F.struct(F.sha1(F.concat(F.lit(f"{b}:"), w)).alias("h"), w.alias("w"))))
        head = F.transform(F.slice(ranked, 1, 4), lambda s: s["w"])
        return F.when(F.size(word_array) >= 2, F.concat(F.lit(f"sem:{b}:"), F.substring(F.sha1(F.array_join(head, "|")), 1, 12)))

    return let(word_array, lambda words_: F.array_compact(F.array(*[band(b, words_) for b in range(bands)])))


def fingerprint(value: Column) -> Column:
    """Twelve hex digits; equal for equal texts."""
    return F.substring(F.sha1(value), 1, 12)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the union; 0 where either side is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of ``a`` that is in ``b``; 0 where ``a`` is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def token_count(messages: Column) -> Column:
    """Blank-separated tokens of all contents."""
    n = lambda m: F.size(F.filter(F.split(F.coalesce(m["content"], F.lit("")), r"\s+"), lambda t: t != ""))
    return F.coalesce(F.aggregate(messages, F.lit(0), lambda acc, m: acc + n(m)), F.lit(0))
