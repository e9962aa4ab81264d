"""Queries of documents, spans, tokens, kind labels and structured profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linkage_sql as Q
from .functions import features as X
from .functions.handles import stable_handles
from .operators import blocking as B
from .operators import documents as D
from .operators import encoders as C
from .operators import linkage as L
from .operators import states as S
from .operators import watchlists as W
from .operators.requests import REQUESTS_SQL, TEXT_SQL, canonical_requests, request_text
from .queries import query, table
from .scratch import Scratch


def _rows(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return canonical_requests(table(spark, folder, "attack_view"), *columns)


def _texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    r = _rows(spark, folder, "messages", *columns)
    return r.select("request_id", "ms", "bucket", F.lower(request_text(F.col("messages"))).alias("text"), *columns)


def _list(pattern: str) -> str:
    return pattern.replace("'", "''")


_USER = "coalesce(list_filter(messages, lambda m: m.role = 'user')[1].content, '')"
_TOOLS = "array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(tool_schemas, []), lambda s: s.name), lambda n: n is not null and n <> ''))), ' ')"
#: Letters beyond ASCII between marks, so that engines that know no others take them for letters at a word's edge; small letters have no Q.
_WIDE = r"'([^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}])', 'Q\1Q', 'g'"


def _masked(low: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({low}, {_WIDE}), '{D.ENTITY}', ' \1_id ', 'g'), '{D.NUMBER}', ' number ', 'g')"


_DOC = f"substring(replace({_masked('lower(' + chr(39) + 'task intent: ' + chr(39) + ' || substring(' + _USER + ', 1, 2400) || chr(10) || ' + chr(39) + 'tool vocabulary: ' + chr(39) + ' || ' + _TOOLS + ')')}, 'Q', ''), 1, 3600)"


@query("q_semantic_documents", f"with {REQUESTS_SQL} select request_id, length({_DOC}) as n_chars, md5({_DOC}) as digest from req")
def _semantic(spark: SparkSession, folder: str) -> DataFrame:
    doc = D.semantic_document(F.col("messages"), F.col("tool_schemas"))
    return _rows(spark, folder, "messages", "tool_schemas").select("request_id", F.char_length(doc).cast("long").alias("n_chars"), F.md5(doc).alias("digest"))


@query("q_intent_labels", f"with {REQUESTS_SQL} select request_id, 'intent_hash:' || substring(sha256({_DOC}), 1, 20) as label from req")
def _intents(spark: SparkSession, folder: str) -> DataFrame:
    return D.intent_labels(_rows(spark, folder, "messages", "tool_schemas"))


_LINES = r"'\r\n|\r|\n'"
_DENSE = f"substring('task: ' || substring(coalesce(list_filter(list_filter(messages, lambda m: coalesce(m.role, '') <> 'system'), lambda m: m.role = 'user')[1].content, ''), 1, 1800) || chr(10) || 'technical evidence:' || chr(10) || coalesce(array_to_string(list_transform(list_filter(list_transform(flatten(list_transform(list_filter(messages, lambda m: coalesce(m.role, '') <> 'system'), lambda m: regexp_split_to_array(coalesce(m.content, ''), {_LINES}))), lambda x: trim(x)), lambda x: x <> '' and regexp_matches(x, '{D.TECHNICAL_LINE}'))[1:24], lambda x: substring(x, 1, 320)), chr(10)), ''), 1, 7000)"


@query("q_dense_documents", f"with {REQUESTS_SQL} select request_id, length({_DENSE}) as n_chars, md5({_DENSE}) as digest from req where messages is not null")
def _dense(spark: SparkSession, folder: str) -> DataFrame:
    doc = D.dense_document(F.col("messages"))
    return _rows(spark, folder, "messages").where("messages is not null").select("request_id", F.char_length(doc).cast("long").alias("n_chars"), F.md5(doc).alias("digest"))


_SPANS = f"""m as (select request_id, i, messages[i].role as role, messages[i].content as c from (select request_id, messages, unnest(range(1, coalesce(len(messages), 0) + 1)) as i from req)),
l as (select request_id, i, coalesce(role, '') as role, case when {" or ".join(f"contains(lower(c), '{w}')" for w in D.MANIFESTS)} then 'manifest' when role = 'tool' then 'tool_output' when {" or ".join(f"contains(lower(c), '{w}')" for w in D.ERRORS)} then 'error' else 'message' end as source_type, unnest(regexp_split_to_array(c, {_LINES})) as line, unnest(range(1, len(regexp_split_to_array(c, {_LINES})) + 1)) as j from m where regexp_matches(c, '{D.TECHNICAL_CUE}')),
n as (select request_id, i, j, role, source_type, trim(regexp_replace(line, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as line from l), s as (select *, substring(line, k, {D.SPAN_CHARS}) as span from (select *, unnest(range(1, length(line) + 1, {D.SPAN_CHARS})) as k from n where length(line) >= {D.LEAST_LINE} and regexp_matches(line, '{D.TECHNICAL_CUE}'))),
o as (select * from (select *, row_number() over (partition by request_id, lower(span) order by i, j, k) as f from s) where f = 1), r as (select *, row_number() over (partition by request_id order by i, j, k) as rank from o)"""


@query("q_evidence_spans", f"with {REQUESTS_SQL}, {_SPANS} select request_id, rank, role, source_type, span from r where rank <= {D.MOST_SPANS}")
def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    return D.evidence_spans(_rows(spark, folder, "messages"))


_VALUES = [(f, v) for f in ("languages", "frameworks", "package_managers", "build_tools") for v in W.FIELD_WORDS[f]]


@query(
    "q_contradicted",
    f"""with {REQUESTS_SQL}, {_SPANS}, v as (select * from (values {", ".join(f"('{f}', '{v}')" for f, v in _VALUES)}) as v(field, value)), p as (select request_id, rank, field, value, lower(replace(span, '_', ' ')) as low, lower(replace(value, '_', ' ')) as w from r, v where rank <= {D.MOST_SPANS}),
a as (select *, instr(low, w) as pos from p), b as (select *, substring(low, greatest(1, pos - {D.NEAR}), pos - greatest(1, pos - {D.NEAR}) + length(w) + {D.NEAR}) as around from a where pos > 0) select field, value, count(*) as n_spans, count(*) filter (where regexp_matches(around, '{D.NEGATION}')) as n_contradicted from b group by 1, 2""",
)
def _contradicted(spark: SparkSession, folder: str) -> DataFrame:
    """Of the spans that name a value, how many negate it; the values are a fixed list."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in _VALUES])).alias("v")
    s = D.evidence_spans(_rows(spark, folder, "messages")).select("span", each).select("span", "v.*").where(F.contains(F.lower(F.regexp_replace("span", "_", " ")), F.lower(F.regexp_replace("value", "_", " "))))
    return s.groupBy("field", "value").agg(F.count("*").alias("n_spans"), F.count_if(D.contradicted(F.col("span"), F.col("value"))).alias("n_contradicted"))


_TRIM = _list(D.TRIM)


def _norm(x: str) -> str:
    return f"case when length(trim(lower(trim({x})), '{_TRIM}')) between 3 and 180 and not regexp_full_match(trim(lower(trim({x})), '{_TRIM}'), '[0-9]+') then trim(lower(trim({x})), '{_TRIM}') end"


_TOKENS = f"""tx as (select request_id, bucket, tool_schemas, lower({TEXT_SQL}) as text from req), w as (select request_id, '' as tag, unnest(list_concat(regexp_extract_all(text, '{X.PATH}'), regexp_extract_all(text, '{X.DOMAIN}'), list_transform(regexp_extract_all(text, '\\b(?:{"|".join(D.ANCHOR_KEYS)})=([^;\\n]+)', 1), lambda v: substring(trim(v), 1, 180)))) as v from tx
 union all select request_id, 'schema:', unnest(flatten(list_transform(coalesce(tool_schemas, []), lambda s: list_concat([s.name], coalesce(s.parameters, []))))) from tx),
e as (select request_id, tag, {_norm("v")} as t from w where v is not null), x as (select request_id, tag, unnest([t, case when contains(t, '/') then regexp_extract(t, '[^/]*$') end, case when contains(t, '__') then string_split(t, '__')[-1] end, case when contains(t, '.') then split_part(t, '.', 1) end]) as t from e where t is not null),
tk as (select distinct request_id, tag || {_norm("t")} as token from x where {_norm("t")} is not null union select request_id, 'cache:' || {_norm("bucket")} from tx where {_norm("bucket")} is not null)"""


@query("q_retrieval_tokens", f"with {REQUESTS_SQL}, {_TOKENS} select request_id, token from tk")
def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return D.retrieval_tokens(_texts(spark, folder, "tool_schemas"))


_ALIASES = rf"""tx as (select request_id, lower({TEXT_SQL}) as text from req), al as (select distinct request_id, 'uid:' || unnest(regexp_extract_all(text, '"user_id"\s*:\s*"([a-z0-9_.-]+)"', 1)) as anchor from tx union select request_id, 'email:' || unnest(regexp_extract_all(text, '\b([a-z0-9_.+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]+)', 1)) from tx)"""


@query("q_alias_anchors", f"with {REQUESTS_SQL}, {_ALIASES} select request_id, anchor from al")
def _aliases(spark: SparkSession, folder: str) -> DataFrame:
    return D.alias_anchors(_texts(spark, folder))


def _closure(rows: str, level: str) -> str:
    """Components of requests that share a value of a query (request_id, v)."""
    return f"se as (select distinct min(request_id) over (partition by v) as u, request_id as v from ({rows})), sb as (select u, v from se where u <> v union select v, u from se where u <> v), sc(id, label) as (select request_id, request_id from req union select sb.v, sc.label from sc join sb on sc.id = sb.u) select '{level}' as level, id as request_id, min(label) as label from sc group by id"


@query("q_email_labels", f"with recursive {REQUESTS_SQL}, {_ALIASES}, {_closure('select request_id, anchor as v from al', 'user')}")
def _email_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by aliases alone."""
    listed = D.alias_anchors(_texts(spark, folder)).groupBy("request_id").agg(F.collect_set("anchor").alias("vs"))
    rows = _rows(spark, folder).select("request_id").join(listed, "request_id", "left").withColumn("vs", F.coalesce("vs", F.array().cast("array<string>")))
    return D.kind_labels(rows, F.col("vs"), "user")


@query("q_order_labels", f"with recursive {REQUESTS_SQL}, {Q.HANDLES_SQL}, {_closure('select request_id, handle as v from hd where starts_with(handle, ' + chr(39) + 'stable_project:order:' + chr(39) + ')', 'project')}")
def _order_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by handles of one kind alone."""
    rows = _rows(spark, folder, "messages").select("request_id", F.filter(stable_handles(F.col("messages")), lambda h: F.startswith(h, F.lit("stable_project:order:"))).alias("vs"))
    return D.kind_labels(rows, F.col("vs"), "project")


@query("q_repository_labels", f"with recursive {Q.FEATURES_SQL}, {_closure('select * from ide where starts_with(v, ' + chr(39) + 'repo_full:' + chr(39) + ')', 'project')}")
def _repository_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by repositories alone, whatever their number of requests."""
    t = _texts(spark, folder)
    return D.kind_labels(t.select("request_id", X.repositories(F.col("text")).alias("r")).select("request_id", F.filter("r", lambda v: F.startswith(v, F.lit("repo_full:"))).alias("vs")), F.col("vs"), "project")


@query("q_feature_sizes", f"with {Q.FEATURES_SQL} select tx.request_id, {', '.join(f'(select count(*) from {t} where {t}.request_id = tx.request_id) as {n}' for n, t in (('n_paths', 'pth'), ('n_domains', 'dom'), ('n_traces', 'trc'), ('n_users', 'usr'), ('n_shingles', 'sh')))} from tx")
def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    f = L.feature_table(table(spark, folder, "attack_view"), X.FeatureOptions(signatures=False))
    names = {"paths": "n_paths", "domains": "n_domains", "traces": "n_traces", "usernames": "n_users", "shingles": "n_shingles"}
    return f.select("request_id", *[F.size(c).cast("long").alias(n) for c, n in names.items()])


_EDGE = [f"({r}) as link_{k}" for k, r in Q._HYBRID_RULES.items()]


@query("q_hybrid_edges", f"with {Q.FEATURES_SQL}, pr as materialized ({Q.pairs(Q._HYBRID, 15)}), sc as materialized ({Q.scored('pr', 'shared', 'ids', 'repo', 'domain', 'trace', 'usern')}), ed as (select l, r, {', '.join(_EDGE)} from sc), tp as (select * from ed where link_session or link_user or link_project or link_org order by l, r limit 200), tv as ({Q._HYBRID}), sv as (select l, r, list_sort(list(a.v))[1:10] as shared from tp join tv a on a.request_id = l join tv b on b.request_id = r and a.v = b.v group by 1, 2) select l as \"left\", r as \"right\", coalesce(link_session, false) as link_session, link_user, link_project, link_org, coalesce(shared, []) as shared from tp left join sv using (l, r)")
def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """The first linking pairs with samples of what they share."""
    f = L.feature_table(table(spark, folder, "attack_view"), X.FeatureOptions(signatures=False))
    return L.hybrid_edges(f).select("left", "right", *[F.coalesce(F.col(f"link_{k}"), F.lit(False)).alias(f"link_{k}") for k in L.LEVELS], "shared")


_CLUES = [(f, v, n) for f, vs in D.CLUES.items() for v, ns in vs.items() for n in ns]


@query("q_enriched_truth", f"with {REQUESTS_SQL}, tx as (select request_id, lower({TEXT_SQL}) as text from req), c as (select * from (values {', '.join(f'({chr(39)}{f}{chr(39)}, {chr(39)}{v}{chr(39)}, {chr(39)}{n}{chr(39)})' for f, v, n in _CLUES)}) as v(field, value, needle)) select distinct request_id, field, value from tx join c on contains(text, needle)")
def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    return D.enrich(_texts(spark, folder), D.CLUES)


_OBSERVED = rf"""tx as (select request_id, bucket, lower({TEXT_SQL}) as text from req), c as (select * from (values {", ".join(f"('{f}', '{v}', '{n}', {i})" for f, vs in D.CLUES.items() for v, ns in vs.items() for i, n in enumerate(ns))}) as v(field, value, needle, i)),
st as (select request_id, field, value, case when contains(needle, '.') and not contains(needle, ' ') then 'manifest' else 'command' end as source, 2.0 as weight, 2 as turn from (select *, row_number() over (partition by request_id, field, value order by i) as k from tx join c on contains(text, needle)) where k = 1),
wd as (select * from (values {", ".join(f"('{f}', '{w}')" for f in D.CLUES for w in W.FIELD_WORDS[f])}) as v(field, value)), tk as (select request_id, replace(text, '-', '_') as norm, regexp_extract_all(replace(text, '-', '_'), '[a-z][a-z0-9_]+') as t from tx),
lx as (select request_id, field, value, 'lexical' as source, 1.0 as weight, 1 as turn from tk, wd where case when contains(value, ' ') then contains(norm, value) else list_contains(t, value) end), ob as (select * from lx union all select * from st),
big as (select bucket from req group by 1 having count(*) >= 2), j as (select ob.*, req.bucket as label from ob join req using (request_id) join big using (bucket)),
f as (select *, row_number() over (partition by label, field, value, source order by request_id, turn, source) = 1 or row_number() over (partition by label, field, value, request_id order by request_id, turn, source) = 1 as fresh from j)"""


@query("q_structured_profiles", f"with {REQUESTS_SQL}, {_OBSERVED} select label, field, value, round(sum(case when fresh then weight else 0 end), 3)::double as score, count(distinct request_id) as n_requests, list_sort(list(distinct source)) as sources from f group by 1, 2, 3 having round(sum(case when fresh then weight else 0 end), 3) >= 2 or count(distinct request_id) >= 2")
def _structured(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of cache buckets by words and by what their texts tell (files and commands)."""
    t = _texts(spark, folder)
    n = F.regexp_replace("text", "-", "_")
    own = F.regexp_extract_all(n, F.lit(r"[a-z][a-z0-9_]+"), 0)
    lexical = [F.when(F.contains(n, F.lit(w)) if " " in w else F.array_contains("words", w), F.struct(F.lit(f).alias("field"), F.lit(w).alias("value"), F.lit("lexical").alias("source"), F.lit(1.0).alias("weight"), F.lit(1).alias("turn"))) for f in D.CLUES for w in W.FIELD_WORDS[f]]

    def clue(field: str, value: str, needles: tuple[str, ...]):
        kind = lambda x: "manifest" if "." in x and " " not in x else "command"
        source = None
        for x in needles:
            hit = F.contains("text", F.lit(x))
            source = F.when(hit, kind(x)) if source is None else source.when(hit, kind(x))
        return F.when(source.isNotNull(), F.struct(F.lit(field).alias("field"), F.lit(value).alias("value"), source.alias("source"), F.lit(2.0).alias("weight"), F.lit(2).alias("turn")))

    told = [clue(f, v, ns) for f, vs in D.CLUES.items() for v, ns in vs.items()]
    seen = t.withColumn("words", F.array_distinct(own)).select("request_id", F.explode(F.array_compact(F.array(*lexical, *told))).alias("o")).select("request_id", "o.*")
    return D.structured_profiles(seen, t.select("request_id", F.col("bucket").alias("label")))


_SKETCH = f"""with {REQUESTS_SQL}, wl as (select request_id, bucket, regexp_extract_all(lower({TEXT_SQL}), '[a-zA-Z][a-zA-Z0-9_./:-]{{2,}}') as w from req), sh as (select distinct request_id, bucket, {Q._h("array_to_string(w[i:i+4], ' ')")} as h from (select *, unnest(range(1, len(w) - 3)) as i from wl where len(w) >= 5)),
k as (select *, row_number() over (partition by request_id order by h) - 1 as r from sh), b as (select request_id, bucket, r // 4 as band, string_agg(h::varchar, ',' order by h) as key, count(*) as n from k where r < 32 group by 1, 2, 3), p as (select request_id, bucket, band || ':' || key as v from b where n = 4)"""


@query("q_sketch_pairs", _SKETCH + ', z as (select *, count(*) over (partition by bucket, v) as c from p) select a.bucket as block, a.request_id as "left", c.request_id as "right", count(*) as shared from z a join z c on a.bucket = c.bucket and a.v = c.v and a.request_id < c.request_id where a.c between 2 and 80 group by 1, 2, 3')
def _sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that share a band of their 32 smallest shingles, in buckets of at most 80."""
    t = _texts(spark, folder).withColumn("w", X.word_list(F.col("text"))).where("size(w) >= 5")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: S.hashed(F.array_join(F.slice("w", i, 5), " ")))
    return B.candidate_pairs(B.postings(t.withColumn("h", runs), B.sketch_bands(F.col("h")), F.col("bucket")), 80)


_TFIDF = f"""with c as (select doc_id as id, t as term, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '{C.WORD}')) as t from documents where text is not null) where t not in ({", ".join(f"'{w}'" for w in C.STOP)}) group by 1, 2), d as (select term, count(*) as df from c group by 1),
w as (select id, term, (1 + ln(n)) * (1 + ln((1 + (select count(*) from documents where text is not null)) / (1 + df))) as w from c join d using (term)), x as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from w)"""


@query("q_tfidf_terms", _TFIDF + " select id, term, round(weight, 6) as weight, rank from (select *, row_number() over (partition by id order by round(weight, 9) desc, term) as rank from x) where rank <= 3")
def _tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """The three weightiest terms of each document."""
    t = C.tfidf(table(spark, folder, "documents").where("text is not null"), "doc_id")
    return B.top_k(t, ["id"], [F.desc(F.round("weight", 9)), F.col("term")], 3).select("id", "term", F.round("weight", 6).alias("weight"), F.col("rank").cast("long").alias("rank"))


@query("q_text_decisions")
def _text_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest earlier text of each request within the window."""
    r = _rows(spark, folder, "messages")
    return C.nearest_earlier(r.select("request_id", F.floor(F.col("ms") / 1000).alias("second"), request_text(F.col("messages")).alias("text")))


@query("q_semantic_profiles")
def _semantic_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of cache buckets by spans near to descriptions, with the hashing encoder."""
    r = _rows(spark, folder, "messages")
    ontology = {f: {v: " ".join([v, *ns]) for v, ns in vs.items()} for f, vs in D.CLUES.items()}
    return C.semantic_profiles(D.evidence_spans(r).select("request_id", "span"), ontology, r.select("request_id", F.col("bucket").alias("label")))


@query("q_combined_scores")
def _combined(spark: SparkSession, folder: str) -> DataFrame:
    """Dense and sparse scores of requests that share a band of shingles, over their dense documents."""
    pairs = Scratch(spark, "combined").save(_sketched(spark, folder).select("left", "right").distinct(), "pairs")
    used = pairs.select(F.explode(F.array("left", "right")).alias("request_id")).distinct()
    docs = Scratch(spark, "combined").save(_rows(spark, folder, "messages").where("messages is not null").join(used, "request_id").select(F.col("request_id").alias("id"), D.dense_document(F.col("messages")).alias("text")), "documents")
    return C.combined_scores(pairs, C.encode_documents(docs, C.hashing_encoder()).select("id", "vector"), C.tfidf(docs), 0.5, 0.2)
