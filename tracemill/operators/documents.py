"""Documents, spans, tokens and labels taken from requests' texts, as native expressions.

All parts are whole texts; what is cut is cut by the operator's rule (stated
budgets of a document or a list of evidence), which is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as X
from .blocking import postings, star_edges
from .components import components

# What a semantic document masks.
ENTITY = r"\b(user|customer|account|order|reservation|booking|flight|product|item|ticket)[_-]?([a-z0-9-]{3,})\b"
NUMBER = r"\b\d{3,}\b"
# Signs of a technical line of a document.
TECHNICAL_LINE = r"(?i)(?:error|exception|failed|test|assert|import|class |def |function|module|package|build|compile|dependency|config|\.py\b|\.js\b|\.ts\b|\.go\b|\.rs\b|\.java\b|pytest|npm|cargo|gradle|maven|makefile|traceback)"
# Words that a rephrased task has for others.
REPHRASED = {"cancel": "terminate", "change": "modify", "check": "verify", "find": "locate", "need": "require", "order": "purchase", "please": "kindly", "refund": "reimburse", "reservation": "booking", "return": "send back", "want": "would like"}
# Signs of a technical line.
TECHNICAL_CUE = (
    r"(?i)(?:\.py\b|\.js\b|\.ts\b|\.tsx\b|\.java\b|\.go\b|\.rs\b|\.rb\b|\.php\b|pyproject|requirements|package\.json|tsconfig|pom\.xml|build\.gradle|go\.mod|cargo\.toml|"
    r"pytest|django|flask|react|next\.js|spring|rails|pip\s|poetry|npm\s|pnpm|yarn|mvn\s|gradle|go test|cargo|makefile|jenkins|circleci|github/workflows|gitlab-ci|"
    r"import\s|dependency|dependencies|build|compile|runtime|framework|test|error|exception)"
)
NEGATION = r"\b(?:not|never|without|remove|removed|removing|replace|replaced|migrate|migrating|deprecated|deprecate|avoid|unused|unrelated)\b"
MANIFESTS = ("pyproject.toml", "package.json", "go.mod", "cargo.toml")
ERRORS = ("traceback", "exception", "error:")
SPAN_CHARS, LEAST_LINE, MOST_SPANS, NEAR = 480, 12, 8, 48
# Keys of anchor lines.
ANCHOR_KEYS = ("cwd", "cache_root", "runner_home", "shell_history", "preferred_check", "package_manager", "service", "domain", "build")
TRIM = "._-/:@;,'\"`()[]{}"


def first_user(messages: Column) -> Column:
    """The content of the first message of a user, '' where there is none."""
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"], F.lit(""))


def semantic_document(messages: Column, tools: Column, most_user: int = 2400, most: int = 3600) -> Column:
    """The first task and the tools' names in small letters, entities and numbers masked by their kind."""
    names = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.transform(tools, lambda s: s["name"]), F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != ""))))
    text = F.lower(F.concat(F.lit("task intent: "), F.substring(first_user(messages), 1, most_user), F.lit("\ntool vocabulary: "), F.array_join(names, " ")))
    return F.substring(F.regexp_replace(F.regexp_replace(text, ENTITY, " $1_id "), NUMBER, " number "), 1, most)


def intent_labels(rows: DataFrame) -> DataFrame:
    """``request_id``, ``label``: requests of equal semantic documents are alike."""
    return rows.select("request_id", F.concat(F.lit("intent_hash:"), F.substring(F.sha2(semantic_document(F.col("messages"), F.col("tool_schemas")), 256), 1, 20)).alias("label"))


def rephrased_task(task: Column, request_id: Column) -> Column:
    """A task said in other words: entities and numbers masked, words replaced, clauses turned by the id's hash, and in two of three cases some words left out or one put before."""
    t = F.regexp_replace(F.regexp_replace(F.lower(task), ENTITY, " $1_id "), NUMBER, " number ")
    for word, other in REPHRASED.items():
        t = F.regexp_replace(t, rf"\b{word}\b", other)
    clauses = F.filter(F.transform(F.split(t, r"(?<=[.!?;])\s+"), lambda c: F.trim(c)), lambda c: c != "")
    number = lambda x: F.conv(F.substring(F.sha2(x, 256), 1, 4), 16, 10).cast("int")
    n = F.greatest(F.lit(1), F.size(clauses))
    by = number(request_id) % n
    turned = F.concat(F.slice(clauses, by + 1, n), F.slice(clauses, F.lit(1), by))
    words = F.filter(F.split(F.array_join(turned, " "), r"\s+"), lambda w: w != "")
    variant = number(F.concat(F.lit("variant:"), request_id)) % 3
    out = F.when(variant == 1, F.filter(words, lambda w, i: i % 11 != 3)).when(variant == 2, F.concat(F.array(F.lit("request:")), words)).otherwise(words)
    return F.array_join(out, " ")


def masked_document(document: Column, names: Column) -> Column:
    """A document with the given names (an array, of any case) masked, whole words only."""
    literal = lambda n: F.concat(F.lit(r"(?i)\b\Q"), n, F.lit(r"\E\b"))
    return F.aggregate(F.filter(names, lambda n: n != ""), document, lambda d, n: F.regexp_replace(d, literal(n), "[IDENTITY]"))


def dense_document(messages: Column, most_lines: int = 24, line_chars: int = 320, most: int = 7000) -> Column:
    """The first task and the first technical lines."""
    said = F.filter(messages, lambda m: F.coalesce(m["role"], F.lit("")) != "system")
    lines = F.flatten(F.transform(said, lambda m: F.split(F.coalesce(m["content"], F.lit("")), r"\r\n|\r|\n")))
    kept = F.slice(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & x.rlike(TECHNICAL_LINE)), 1, most_lines)
    return F.substring(F.concat(F.lit("task: "), F.substring(first_user(said), 1, 1800), F.lit("\ntechnical evidence:\n"), F.array_join(F.transform(kept, lambda x: F.substring(x, 1, line_chars)), "\n")), 1, most)


def source_type(content: Column, role: Column) -> Column:
    low = F.lower(content)
    some = lambda words: F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in words]), True)
    return F.when(some(MANIFESTS), "manifest").when(role == "tool", "tool_output").when(some(ERRORS), "error").otherwise("message")


def evidence_spans(rows: DataFrame, most: int | None = MOST_SPANS) -> DataFrame:
    """``request_id``, ``rank``, ``role``, ``source_type``, ``span``: technical lines in order, in chunks, each text once a request; the first ``most`` (all with None)."""
    m = rows.select("request_id", F.posexplode("messages").alias("i", "m")).where(F.col("m.content").rlike(TECHNICAL_CUE))
    lines = m.select("request_id", "i", F.coalesce("m.role", F.lit("")).alias("role"), source_type(F.col("m.content"), F.col("m.role")).alias("source_type"), F.posexplode(F.split("m.content", r"\r\n|\r|\n")).alias("j", "line"))
    clean = lines.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).where((F.char_length("line") >= LEAST_LINE) & F.col("line").rlike(TECHNICAL_CUE))
    starts = F.sequence(F.lit(1), F.char_length("line"), F.lit(SPAN_CHARS))
    chunks = clean.select("request_id", "i", "role", "source_type", "j", F.posexplode(F.transform(starts, lambda s: F.substr(F.col("line"), s, F.lit(SPAN_CHARS)))).alias("k", "span"))
    once = chunks.groupBy("request_id", F.lower("span").alias("norm")).agg(F.min_by(F.struct("role", "source_type", "span"), F.struct("i", "j", "k")).alias("s"), F.min(F.struct("i", "j", "k")).alias("at"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("at")))
    kept = ranked if most is None else ranked.where(F.col("rank") <= most)
    return kept.select("request_id", F.col("rank").cast("long").alias("rank"), "s.role", "s.source_type", "s.span")


def contradicted(span: Column, value: Column) -> Column:
    """Whether a span names a value with a negation within ``NEAR`` characters of it."""
    low, v = F.lower(F.regexp_replace(span, "_", " ")), F.lower(F.regexp_replace(value, "_", " "))
    at = F.instr(low, v)
    begin = F.greatest(F.lit(1), at - NEAR)
    around = F.substr(low, begin, at - begin + F.char_length(v) + NEAR)
    return (at > 0) & around.rlike(NEGATION)


def normal_token(value: Column) -> Column:
    t = F.btrim(F.lower(F.trim(value)), F.lit(TRIM))
    return F.when((F.char_length(t) >= 3) & (F.char_length(t) <= 180) & ~t.rlike(r"^\d+$"), t)


def expand_token(value: Column) -> Column:
    """A token, and the tails and heads by which parts of it are known elsewhere."""
    whole = normal_token(value)
    more = F.array(
        whole, F.when(F.contains(whole, F.lit("/")), F.substring_index(whole, "/", -1)), F.when(F.contains(whole, F.lit("__")), F.substring_index(whole, "__", -1)), F.when(F.contains(whole, F.lit(".")), F.substring_index(whole, ".", 1)),
    )
    return F.array_distinct(F.array_compact(F.transform(F.array_compact(more), normal_token)))


def retrieval_tokens(rows: DataFrame) -> DataFrame:
    """``request_id``, ``token``: expanded paths, domains and ``key=value`` anchors, tool words, and the cache bucket.

    ``rows``: ``request_id``, ``bucket``, ``text`` (small letters), ``tool_schemas``.
    """
    t = F.col("text")
    values = F.regexp_extract_all(t, F.lit(rf"\b(?:{'|'.join(ANCHOR_KEYS)})=([^;\n]+)"), 1)
    plain = F.flatten(F.transform(F.concat(X.paths(t), X.domains(t), F.transform(values, lambda v: F.substring(F.trim(v), 1, 180))), expand_token))
    tools = F.flatten(F.coalesce(F.transform("tool_schemas", lambda s: F.array_compact(F.concat(F.array(s["name"]), F.coalesce(s["parameters"], F.array().cast("array<string>"))))), F.array().cast("array<array<string>>")))
    schema = F.transform(F.flatten(F.transform(tools, expand_token)), lambda x: F.concat(F.lit("schema:"), x))
    cache = F.transform(F.array_compact(F.array(normal_token(F.col("bucket")))), lambda x: F.concat(F.lit("cache:"), x))
    return rows.select("request_id", F.explode(F.array_distinct(F.concat(plain, schema, cache))).alias("token"))


def alias_anchors(rows: DataFrame) -> DataFrame:
    """``request_id``, ``anchor``: user ids, emails, and names with postcodes that a text states.  ``rows``: ``request_id``, ``text`` (small letters)."""
    t = F.col("text")
    tag = lambda kind, xs: F.transform(xs, lambda v: F.concat(F.lit(f"{kind}:"), v))
    uids = F.regexp_extract_all(t, F.lit(r"\"user_id\"\s*:\s*\"([a-z0-9_.-]+)\""), 1)
    emails = F.regexp_extract_all(t, F.lit(r"\b([a-z0-9_.+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]+)"), 1)
    return rows.select("request_id", F.explode(F.array_distinct(F.concat(tag("uid", uids), tag("email", emails)))).alias("anchor"))


def kind_labels(rows: DataFrame, values: Column, level: str) -> DataFrame:
    """``request_id``, ``label``: components of requests that share one of the values (a column of arrays); a hot value is a star."""
    found = components(star_edges(postings(rows, values)), rows.select(F.col("request_id").alias("id")))
    return found.select(F.lit(level).alias("level"), F.col("id").alias("request_id"), "label")


def enrich(rows: DataFrame, needles: dict[str, dict[str, tuple[str, ...]]]) -> DataFrame:
    """``request_id``, ``field``, ``value``: values of which a text (small letters) holds one of the needles.  The needles are a fixed list."""
    each = [F.when(F.array_contains(F.array(*[F.contains("text", F.lit(n)) for n in ns]), True), F.struct(F.lit(field).alias("field"), F.lit(value).alias("value"))) for field, values in needles.items() for value, ns in values.items()]
    return rows.select("request_id", F.explode(F.array_compact(F.array(*each))).alias("h")).select("request_id", "h.field", "h.value")


# What in a text tells of a value.
CLUES = {
    "languages": {
        "python": (".py", "pyproject.toml", "requirements.txt", "python "), "javascript": (".js", "package.json", "npm "), "typescript": (".ts", ".tsx", "tsconfig.json", "pnpm "), "java": (".java", "pom.xml", "mvn ", "gradle "),
        "go": (".go", "go.mod", "go test"), "rust": (".rs", "cargo.toml", "cargo "), "ruby": (".rb", "gemfile", "bundle exec"),
    },
    "package_managers": {
        "pip": ("requirements.txt", "pip install"), "poetry": ("poetry.lock", "pyproject.toml", "poetry "), "npm": ("package.json", "package-lock.json", "npm "), "pnpm": ("pnpm-lock.yaml", "pnpm "), "yarn": ("yarn.lock", "yarn "),
        "maven": ("pom.xml", "mvn "), "gradle": ("build.gradle", "gradle "), "go mod": ("go.mod", "go mod"), "cargo": ("cargo.toml", "cargo "),
    },
    "frameworks": {"pytest": ("pytest.ini", "pytest ", "pytest-"), "django": ("django", "manage.py"), "flask": ("flask",), "react": ("react", "react-dom"), "nextjs": ("next.js", "nextjs", "next.config"), "spring": ("spring",), "rails": ("rails",)},
    "build_tools": {"pytest": ("pytest.ini", "pytest ", "pytest-"), "tox": ("tox.ini", "tox "), "make": ("makefile", "make "), "maven": ("pom.xml", "mvn "), "gradle": ("build.gradle", "gradle "), "go test": ("go test",), "cargo": ("cargo test", "cargo build")},
    "ci_cd_systems": {"github_actions": (".github/workflows", "github actions"), "gitlab_ci": (".gitlab-ci.yml", "gitlab ci"), "jenkins": ("jenkinsfile", "jenkins"), "circleci": (".circleci", "circleci")},
}


def structured_profiles(observations: DataFrame, labels: DataFrame, least_size: int = 2, least_score: float = 2.0) -> DataFrame:
    """``label``, ``field``, ``value``, ``score``, ``n_requests``, ``sources``: values of clusters with enough evidence.

    ``observations``: ``request_id``, ``field``, ``value``, ``source``,
    ``weight``, ``turn`` (order of detectors).  A weight counts where the source
    or the request is new for the value, in order of request, turn and source;
    a value is kept with ``least_score`` or two requests.
    """
    big = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least_size).select("label")
    each = observations.join(labels.join(big, "label"), "request_id")
    key = ["label", "field", "value"]
    order = ["request_id", "turn", "source"]
    first = lambda c: F.row_number().over(Window.partitionBy(*key, c).orderBy(*order)) == 1
    flagged = each.withColumn("new", first("source") | first("request_id"))
    g = flagged.groupBy(*key).agg(F.round(F.sum(F.when(F.col("new"), F.col("weight")).otherwise(0.0)), 3).alias("score"), F.count_distinct("request_id").alias("n_requests"), F.array_sort(F.collect_set("source")).alias("sources"))
    return g.where((F.col("score") >= least_score) | (F.col("n_requests") >= 2))
