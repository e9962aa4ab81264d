"""SQL of the linkage features and methods, for engines with lists and recursion.

Fragments are CTEs over ``req`` (one row a request).  They say what the plans
compute, by other means: closures are recursive, payloads are walked by paths.
"""

from __future__ import annotations

from .functions import handles as H
from .operators import linkage as L
from .operators import states as A
from .operators.requests import REQUESTS_SQL, TEXT_SQL


def _words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_EDGES = H.EDGES.replace("'", "''")
_KINDS = ", ".join(f"('{k}', '{level}')" for level, kinds in H.KINDS.items() for k in kinds)
_KEYS = ", ".join(f"('{key}', '{named}')" for key, named in sorted(H.KEYS.items()))
_FOLD = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
_VALUE = f"length(v) between 4 and 120 and regexp_full_match(v, '[A-Za-z0-9][A-Za-z0-9_.:/@-]*') and (regexp_matches(v, '[0-9_.:/@-]') or regexp_full_match(v, '[A-Z]{{5,}}')) and lower(v) not in {_words(H.NO_VALUES)}"

#: hd: request_id, handle.  All but system messages; phrases, and payloads walked with the nearest named key above.
HANDLES_SQL = f"""
keys as materialized (select * from (values {_KEYS}) as v(k, named)), kinds as materialized (select * from (values {_KINDS}) as v(kind, level)),
ct as materialized (select row_number() over () as cid, c from (select distinct m.content as c from (select unnest(messages) as m from req) where m.content is not null and coalesce(m.role, '') <> 'system')),
rc as materialized (select distinct request_id, cid from (select request_id, unnest(messages) as m from req) join ct on m.content = c where coalesce(m.role, '') <> 'system'),
ph as (select cid, unnest(list_zip(regexp_extract_all(c, '{H.NATURAL}', 1), regexp_extract_all(c, '{H.NATURAL}', 2))) as z from ct union all select cid, unnest(list_zip(regexp_extract_all(c, '{H.PREFIXED}', 1), regexp_extract_all(c, '{H.PREFIXED}', 2))) from ct),
pv as (select cid, level || ':' || kind as named, trim(z[2], '{_EDGES}') as v from ph join kinds on lower(z[1]) = kind),
js as materialized (select cid, c from ct where regexp_matches(c, '^\\s*[\\[{{]') and json_valid(c)),
tr as (select cid, t.key, t.atom, t.type, t.path from js, json_tree(js.c) t),
lf as (select cid, {_FOLD.format("key")} as k, case when type in ('VARCHAR') then json_extract_string(atom, '$') else atom::varchar end as raw, path, type from tr where key is not null and type in ('VARCHAR', 'UBIGINT', 'BIGINT', 'HUGEINT') and not regexp_matches(path || '', '^$') and try_cast(key as bigint) is null),
up as (select lf.*, list_transform(regexp_extract_all(path, '\\.("[^"]*"|[^.\\[]+)', 1), lambda p: {_FOLD.format("p")}) as parents from lf),
nm as (select u.cid, u.raw, coalesce(o.named, case when u.k in {_words(sorted(H.BARE_KEYS))} then a.named end) as named from up u left join keys o on o.k = u.k
  left join lateral (select named from (select unnest(u.parents) as p, unnest(range(len(u.parents))) as i) q join keys on keys.k = q.p order by i desc limit 1) a on true),
vs as (select cid, named, v from pv union all select cid, named, trim(trim(raw, ' ' || chr(9) || chr(10) || chr(13)), '{_EDGES}') from nm where named is not null),
hv as materialized (select distinct cid, 'stable_' || named || ':' || lower(v) as handle from vs where {_VALUE}),
hd as materialized (select distinct request_id, handle from rc join hv using (cid))"""


_SHAPES = {"pth": r"/(?:home|srv|opt|workspace|tmp)/[A-Za-z0-9_./-]+", "dom": r"\b(?:[a-z0-9-]+\.)+(?:internal|local|prod|corp)\b", "trc": r"\btrace-[a-z0-9-]+(?:-[a-z0-9-]+)+\b", "pid": r"\b[a-z][a-z0-9]+(?:[-_][a-z0-9]+)+\b"}
_KV = r"\b(tenant|customer_ref|account_cache|case_id|queue|service_line|internal_domain|loyalty_tier|region)=([A-Za-z0-9_.:/@-]+)"
_OBJECT = r"\b(order|reservation|product)[_-]([a-z][a-z0-9]*\d{2}-(?:airline|retail)-[a-z]+(?:-[a-z]+)*-\d+)\b"


def _zipped(pattern: str) -> str:
    return f"unnest(list_zip(regexp_extract_all(text, '{pattern}', 1), regexp_extract_all(text, '{pattern}', 2)))"


def _starts(*prefixes: str) -> str:
    return "(" + " or ".join(f"starts_with(v, '{p}')" for p in prefixes) + ")"


_TELLING = " or ".join([f"starts_with(v, '{p}')" for p in L.KEPT_STARTS] + [f"contains(v, '{m}')" for m in (".", *L.MARKERS)])
_STOPPED = f"v in {_words(L.STOP_VALUES)} or " + " or ".join(f"starts_with(v, '{p}')" for p in L.STOP_STARTS)

#: Families of features as (request_id, v): pth, dom, trc, usr, ide (all identifiers), inf (telling ones), biz, sh (shingles).
FEATURES_SQL = f"""{REQUESTS_SQL}, {HANDLES_SQL},
tx as materialized (select request_id, bucket, cast(floor(ms / 60000.0) as bigint) as minute, coalesce(token_count, 0) as token_count, lower({TEXT_SQL}) as text, messages, tool_schemas from req),
{", ".join(f"{name} as materialized (select distinct request_id, unnest(regexp_extract_all(text, '{pattern}')) as v from tx)" for name, pattern in _SHAPES.items())},
usr as materialized (select distinct request_id, regexp_extract(v, '^/home/([^/]+)/', 1) as v from pth where regexp_extract(v, '^/home/([^/]+)/', 1) <> ''),
own as (select request_id, z[1] as o, z[2] as n from (select request_id, {_zipped(r"\brepository=([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)\b")} as z from tx)
  union select request_id, split_part(s, '__', 1), substring(s, instr(s, '__') + 2) from (select request_id, regexp_extract(v, '/workspace/([^/\\s]+)', 1) as s from pth) where contains(s, '__')),
kv as (select request_id, z[1] as k, trim(z[2], '{_EDGES}') as w from (select request_id, {_zipped(_KV)} as z from tx) where length(trim(z[2], '{_EDGES}')) between 3 and 120),
biz as materialized (select request_id, 'business_user:' || k || ':' || w as v from kv where k in ('customer_ref', 'account_cache') union select request_id, 'business_project:' || k || ':' || w from kv where k in ('queue', 'internal_domain') union select request_id, 'business_org:' || k || ':' || w from kv where k in ('internal_domain', 'tenant')
  union select request_id, 'business_org:tenant:' || regexp_extract(split_part(w, ':acct:', 1), '[^:]*$') from kv where k = 'account_cache' and contains(w, ':acct:') and regexp_extract(split_part(w, ':acct:', 1), '[^:]*$') <> ''
  union select request_id, 'business_project:' || z[1] || ':' || trim(z[2], '{_EDGES}') from (select request_id, {_zipped(_OBJECT)} as z from tx)),
ide as materialized (select * from pid union select request_id, 'repo_owner:' || o from own union select request_id, 'repo_name:' || n from own union select request_id, 'repo_full:' || o || '/' || n from own union select * from biz union select request_id, handle from hd),
inf as materialized (select * from ide where not ({_STOPPED}) and ({_TELLING})),
wo as (select distinct request_id, 'workspace_owner:' || split_part(s, '__', 1) as v from (select request_id, coalesce(list_filter(string_split(v, '/'), lambda x: x <> '')[2], '') as s from pth where contains(v, '/workspace/')) where contains(s, '__')),
wl as (select request_id, regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_./:-]{{2,}}') as w from tx),
sh as materialized (select distinct request_id, hash(array_to_string(w[i:i+4], ' ')) as v from (select request_id, w, unnest(range(1, len(w) - 3)) as i from wl where len(w) >= 5) union select distinct request_id, hash(unnest(w)) from wl where len(w) between 1 and 4),
shn as materialized (select request_id, count(*) as n from sh group by 1),
bk as materialized (select request_id, bucket from tx)"""

#: Closure of the edges ed(level, u, v) over vx(level, id): lb(level, id, label).
CLOSURE_SQL = "es as materialized (select level, u, v from ed union select level, v, u from ed), cl(level, id, label) as (select level, id, id from vx union select es.level, es.v, cl.label from cl join es on cl.level = es.level and cl.id = es.u), lb as (select level, id, min(label) as label from cl group by 1, 2)"
LEVELS_SQL = "vx as (select unnest(['session', 'user', 'project', 'org']) as level, request_id as id from req)"


def star(level: str, values: str, cap: int, block: bool = False) -> str:
    """Edges of a level: members of the buckets of ``values`` (a query of request_id, v) with the smallest one."""
    rows = f"(select request_id, v, {'bucket' if block else chr(39) * 2} as b from ({values}) join bk using (request_id))"
    return f"select '{level}' as level, f as u, request_id as v from (select request_id, min(request_id) over (partition by b, v) as f, count(*) over (partition by b, v) as n from {rows}) where n between 2 and {cap} and request_id <> f"


def pairs(values: str, cap: int | None, block: bool = False) -> str:
    """Distinct pairs l < r of members of the buckets of at most ``cap`` (of all buckets with None)."""
    if cap is None:
        return f"select distinct a.request_id as l, c.request_id as r from ({values}) a join ({values}) c on a.v = c.v and a.request_id < c.request_id"
    rows = f"(select *, count(*) over (partition by b, v) as n from (select request_id, v, {'bucket' if block else chr(39) * 2} as b from ({values}) join bk using (request_id)))"
    return f"select distinct a.request_id as l, c.request_id as r from {rows} a join {rows} c on a.b = c.b and a.v = c.v and a.request_id < c.request_id where a.n between 2 and {cap} and c.n between 2 and {cap}"


def overlap(pairs_: str, name: str, values: str) -> str:
    """For each pair of a table with some, the number of values of a query (request_id, v) that both have."""
    return f"(select l, r, count(*) as {name} from {pairs_} join ({values}) a on a.request_id = l join ({values}) c on c.request_id = r and a.v = c.v group by 1, 2)"


def scored(pairs_: str, *families: str) -> str:
    """Pairs with time gap, shared shingles and overlaps."""
    every = {
        "ids": "select * from ide where not starts_with(v, 'stable_')", "trace": "select * from trc", "domain": "select * from dom", "usern": "select * from usr", "repo": "select * from ide where starts_with(v, 'repo_full:')", "owner": "select * from ide where starts_with(v, 'repo_owner:')",
        "biz_user": "select * from ide where starts_with(v, 'business_user:')", "biz_project": "select * from ide where starts_with(v, 'business_project:')", "biz_org": "select * from ide where starts_with(v, 'business_org:')", "sem": "select * from sg", "shared": "select * from sh",
    }
    joins = " ".join(f"left join {overlap(pairs_, f, every[f])} {f}_ using (l, r)" for f in families)
    cols = ", ".join(f"coalesce({f}, 0) as {f}" for f in families)
    ratio = ", case when least(coalesce(sa.n, 0), coalesce(sc.n, 0)) > 0 then coalesce(shared, 0) / (sa.n + sc.n - coalesce(shared, 0)) else 0 end as jaccard, case when least(coalesce(sa.n, 0), coalesce(sc.n, 0)) > 0 then coalesce(shared, 0) / least(sa.n, sc.n) else 0 end as containment" if "shared" in families else ""
    return f"select l, r, abs(ta.minute - tc.minute) as gap, ta.token_count as na, tc.token_count as nc, {cols}{ratio} from {pairs_} {joins} join tx ta on ta.request_id = l join tx tc on tc.request_id = r left join shn sa on sa.request_id = l left join shn sc on sc.request_id = r"


_ORG = "select request_id, v from dom union select * from ide where starts_with(v, 'repo_owner:')"
RARE_SQL = f"with recursive {FEATURES_SQL}, ed as ({star('session', 'select * from trc', 12)} union {star('user', 'select * from usr', 500)} union {star('project', 'select * from ide where ' + _starts('repo_full:'), 2000)} union {star('org', _ORG + ' union select * from ide where contains(v, ' + chr(39) + '-' + chr(39) + ') and not ' + _starts('trace-'), 2000)}), {LEVELS_SQL}, {CLOSURE_SQL} select 'rare' as method, level, id as request_id, label from lb"

_PREFIX_RULES = {"session": "jaccard >= 0.22", "user": "jaccard >= 0.12 and ids >= 3", "project": "jaccard >= 0.08 and repo >= 1", "org": "jaccard >= 0.08 and domain + ids >= 3"}
PREFIX_SQL = f"with recursive {FEATURES_SQL}, pr as materialized ({pairs('select * from sh', None)}), sc as materialized ({scored('pr', 'shared', 'ids', 'repo', 'domain')}), ed as ({' union '.join(f'select {chr(39)}{k}{chr(39)} as level, l as u, r as v from sc where {rule}' for k, rule in _PREFIX_RULES.items())}), {LEVELS_SQL}, {CLOSURE_SQL} select 'prefix' as method, level, id as request_id, label from lb"

_HYBRID = "select * from inf union select * from trc union select * from dom union select * from usr"
_SCORES = "3 * least(trace, 1) + least(usern, 1) + least(ids, 5) / 5 + 1.2 * jaccard + case when gap <= 180 then 0.8 else 0 end + 0.2 * least(na, nc) / greatest(1, na, nc)"
_HYBRID_RULES = {
    "session": f"trace > 0 or ({_SCORES} >= 2.55 and usern > 0 and ids >= 4 and jaccard >= 0.18 and gap <= 90) or (jaccard >= 0.22 and ids >= 2 and gap <= 180)",
    "user": "2.5 * least(usern, 1) + least(ids, 6) / 6 + 0.5 * jaccard + case when gap <= 1440 then 0.3 else 0 end >= 1.8",
    "project": "repo > 0",
    "org": "domain > 0 and 2.8 * least(domain, 1) + 0.9 * least(ids, 8) / 8 + 0.3 * jaccard >= 2.0",  # the rest of the score only adds
}
HYBRID_SQL = f"with recursive {FEATURES_SQL}, pr as materialized ({pairs(_HYBRID, 15)}), sc as materialized ({scored('pr', 'shared', 'ids', 'repo', 'domain', 'trace', 'usern')}), ed as ({' union '.join(f'select {chr(39)}{k}{chr(39)} as level, l as u, r as v from sc where {rule}' for k, rule in _HYBRID_RULES.items())} union {star('session', 'select * from trc', 20)} union {star('user', 'select * from usr', 400)} union {star('project', 'select * from ide where ' + _starts('repo_full:'), 1200)} union {star('org', 'select * from dom', 1200)} union {star('org', 'select * from ide where ' + _starts('repo_owner:'), 1200)}), {LEVELS_SQL}, {CLOSURE_SQL} select 'hybrid' as method, level, id as request_id, label from lb"

#: Signatures sg(request_id, v): of each band the four words of smallest hash.
SIGNATURES_SQL = f"""sw as (select distinct request_id, unnest(list_filter(list_transform(list_filter(list_transform(w, lambda x: trim(x, '._:-/')), lambda x: length(x) between 3 and 80), lambda x: case when contains(x, '/') and not (starts_with(x, '/workspace/') or starts_with(x, '/home/') or starts_with(x, '/tmp/')) then regexp_extract(x, '[^/]*$') else x end), lambda x: x <> '' and x not in {_words(L.X.STOP_WORDS)})) as w from wl),
sr as (select request_id, band, w, row_number() over (partition by request_id, band order by sha1(band || ':' || w)) as k from sw, (select unnest(range(0, 8)) as band)),
sg as materialized (select request_id, 'sem:' || band || ':' || substring(sha1(string_agg(w, '|' order by k) filter (where k <= 4)), 1, 12) as v from sr group by request_id, band having count(*) >= 2)"""

_REFINE = "select * from inf union select * from biz union select * from trc union select * from dom"
_SESSION_A = "(jaccard >= 0.22 and ids >= 2 and gap <= 180) or (jaccard >= 0.24 and sem >= 2 and ids >= 3 and gap <= 90)"
_STAGES = f"""{SIGNATURES_SQL}, cx as materialized ({pairs('select * from sh', L.CONTEXT_BUCKET, True)}), cs as ({scored('cx', 'shared', 'ids', 'repo')}), cl_ as materialized (select l, r from cs where containment >= 0.78 and jaccard >= 0.20 and ids >= 2 and repo >= 1 and gap <= 180),
rx as materialized ({pairs(_REFINE, L.REFINE_BUCKET, True)}), rs as materialized ({scored('rx', 'shared', 'ids', 'sem', 'usern', 'repo', 'owner', 'domain', 'biz_user', 'biz_project', 'biz_org')})"""
CONTEXT_SQL = f"with recursive {FEATURES_SQL}, {_STAGES}, ed as (select 'session' as level, l as u, r as v from cl_ union select 'session', l, r from rs where {_SESSION_A}), {LEVELS_SQL}, {CLOSURE_SQL} select 'context_only' as method, level, id as request_id, label from lb"

_RARE_LEVELS = {"session": "select * from trc", "user": "select * from usr union select * from trc union select * from ide where " + _starts("business_user:"), "project": "select * from ide where " + _starts("repo_full:", "business_project:"), "org": "select * from dom union select * from wo union select * from ide where " + _starts("repo_owner:", "business_org:")}
_REFINE_RULES = {"session": _SESSION_A, "user": "2 * least(usern, 1) + 0.8 * least(ids, 6) / 6 + 0.5 * least(sem, 2) / 2 + 2 * least(biz_user, 1) + case when gap <= 1440 then 0.3 else 0 end >= 1.8 or biz_user >= 1", "project": "repo + biz_project >= 1", "org": "domain + owner + biz_org >= 1"}
_ANCHORED = """an as (select distinct request_id, split_part(split_part(v, ':', 1), '_', 2) as level, v as a from ide where regexp_matches(v, '^(business|stable)_(user|project|org):')),
am as (select a from (select a, c.v from an left join (select request_id, v from ide where starts_with(v, 'business_user:customer_ref:')) c using (request_id) where starts_with(a, 'business_user:account_cache:')) group by a having count(distinct v) <> 1), ao as materialized (select * from an where a not in (select a from am)),
be as materialized (select distinct x.level, x.request_id as u, y.request_id as v from (select level, a, request_id, min(request_id) over (partition by level, a) as f from ao where starts_with(a, 'business_')) x join (select distinct level, a, min(request_id) over (partition by level, a) as request_id from ao where starts_with(a, 'business_')) y on x.level = y.level and x.a = y.a),
bs as materialized (select level, u, v from be union select level, v, u from be), bc(level, id, label) as (select distinct level, request_id, request_id from ao where starts_with(a, 'business_') union select bs.level, bs.v, bc.label from bc join bs on bc.level = bs.level and bc.id = bs.u), bl as materialized (select level, id, min(label) as label from bc group by 1, 2),
sa_ as (select ao.level, a from ao join bl on bl.level = ao.level and bl.id = ao.request_id where starts_with(a, 'stable_') group by 1, 2 having count(distinct label) > 1), ag as materialized (select * from ao where (level, a) not in (select level, a from sa_)),
ga as (select level, min(request_id) over (partition by level, a) as u, request_id as v from ag)"""
LOW_COST_SQL = f"with recursive {FEATURES_SQL}, {_STAGES}, sx as materialized ({pairs('select * from sg', L.SEMANTIC_BUCKET, True)}), ss as ({scored('sx', 'shared', 'ids', 'sem')}), {_ANCHORED}, ed as materialized (select 'session' as level, l as u, r as v from cl_ union select 'session', l, r from ss where sem >= 2 and jaccard >= 0.32 and ids >= 3 and gap <= 90 union {' union '.join(f'select {chr(39)}{k}{chr(39)}, l, r from rs where {rule}' for k, rule in _REFINE_RULES.items())} union {' union '.join(star(k, v, L.RARE_BUCKETS[k], True) for k, v in _RARE_LEVELS.items())} union select level, u, v from ga where u <> v), {LEVELS_SQL}, {CLOSURE_SQL} select 'low_cost' as method, level, id as request_id, label from lb"


# -- bounded states and the look-back linker ------------------------------------------
def _h(text: str) -> str:
    return f"('0x' || substring(md5({text}), 1, 15))::bigint"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _bottom(name: str, rows: str, k: int, order: str = "v") -> str:
    """The k smallest distinct values of each request."""
    return f"select request_id, '{name}' as fam, v::varchar as v from (select *, row_number() over (partition by request_id order by {order}) as k from (select distinct request_id, v from ({rows}))) where k <= {k}"


#: st(request_id, fam, v): the values of the states' compared lists; sq(request_id, bucket, second, n): what else is compared.
STATES_SQL = f"""{HANDLES_SQL},
sq as materialized (select request_id, bucket, cast(floor(ms / 1000.0) as bigint) as second, coalesce(len(messages), 0) as n from req),
mg as materialized (select request_id, i, coalesce(m.role, '') as role, coalesce(m.name, '') as name, coalesce(m.content, '') as content from (select request_id, i, messages[i] as m from (select request_id, messages, unnest(range(1, coalesce(len(messages), 0) + 1)) as i from req))),
eh as materialized (select request_id, role, {_h("role || chr(10) || name || chr(10) || array_to_string(list_filter(regexp_split_to_array(content, '[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']+'), lambda x: x <> ''), ' ')")} as v from mg),
fu as (select request_id, list_transform(regexp_extract_all(content, '{A.TOKEN}'), lambda x: lower(x)) as t from (select *, row_number() over (partition by request_id order by i) as k from mg where role = 'user') where k = 1),
ig as (select request_id, {_h("array_to_string(t[i:i+2], ' ')")} as v from (select *, unnest(range(1, len(t) - 1)) as i from fu where len(t) >= 3) union all select request_id, {_h("x")} from (select request_id, unnest(t) as x from fu where len(t) < 3)),
rs_ as (select distinct request_id, lower(unnest(regexp_extract_all(content, '{_quoted(A.RESOURCE)}'))) as x from mg),
rt as (select request_id, 'workspace:' || lower(unnest(regexp_extract_all(content, '{A.ROOT}', 1))) as v from mg union select request_id, 'repository:' || lower(unnest(regexp_extract_all(content, '{A.REPOSITORY}', 1))) from mg),
st as materialized ({_bottom("replay", "select request_id, v from eh", A.REPLAY)} union all {_bottom("initial", "select * from ig", A.INITIAL)} union all {_bottom("tool", "select request_id, v from eh where role = ''tool''".replace("''", "'"), A.TOOL)}
 union all {_bottom("resources", "select request_id, " + _h("x") + " as v from rs_", A.RESOURCES)} union all {_bottom("roots", "select * from rt", A.RESOURCES)}
 {" ".join(f"union all {_bottom(f'{level}_handles', f'select request_id, handle as v from hd where starts_with(handle, {chr(39)}stable_{level}:{chr(39)})', A.HANDLES)}" for level in ("user", "project", "org", "context"))}),
sn as materialized (select request_id, fam, count(*) as c from st group by 1, 2)"""

_FAMS = ("replay", "initial", "tool", "resources", "roots", "user_handles", "project_handles", "org_handles", "context_handles")


def decisions_sql(variant: str = "full") -> str:
    """CTEs up to dc: the decision on every request under a variant of the rules."""
    r = A.VARIANTS[variant]
    conditions = {"state_replay": "replay >= 0.75", "initial_task": "initial >= 0.6", "typed_handle": "typed > 0", "tool_resource": "tool > 0 or resources > 0", "resource_root": "roots > 0", "ordered_progression": "(delta between 0 and 21600 and (growth > 0 or resources > 0))"}
    parts = {"state_replay": "3 * replay", "initial_task": "1.5 * initial", "typed_handle": "case when typed > 0 then 0.8 * least(typed + context_handles, 2) else 0 end", "tool_resource": "0.5 * least(tool + resources, 2)", "resource_root": "case when roots > 0 then 3 else 0 end", "ordered_progression": f"case when {conditions['ordered_progression']} then 0.8 else 0 end"}
    conflicts = {"time_reversal": "delta < 0", "context_shrink": "growth < 0 and replay >= 0.5", "incompatible_user_handles": "su and user_handles = 0", "incompatible_org_handles": "so and org_handles = 0", "competing_initial_roots": "initial < 0.2 and si"}
    listed = lambda d: "list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in d.items()) + "], lambda x: x is not null)" if d else "[]::varchar[]"
    on = [f for f in A.FAMILIES if f in r.families]
    has = lambda f: f"list_contains(fams, '{f}')"
    rooted = f"({has('resource_root')} and not {has('state_replay')})"
    steps = [("e is null", "abstain", "no_candidate"), ("len(cons) > 0", "reject", "hard_conflict"), (f"delta > {r.window}", "abstain", "session_gap_exceeded"), (f"{rooted} and not ({has('ordered_progression')} and {has('tool_resource')})", "abstain", "resource_root_without_progression"), (f"{rooted} and resources < 2", "abstain", "weak_resource_continuity"), (f"score < {r.accept_score}", "abstain", "insufficient_score"), (f"len(fams) < {r.least_families}", "abstain", "insufficient_independent_evidence"), (f"score - second_score < {r.least_margin}", "abstain", "ambiguous_runner_up")]
    ladder = lambda k, last: "case " + " ".join(f"when {s[0]} then '{s[k]}'" for s in steps) + f" else '{last}' end"
    return f"""po as materialized (select bucket, second // {A.WINDOW_SECONDS} as slot, fam || ':' || v as posting, request_id as id, second from st join sq using (request_id) where second is not null and fam <> 'context_handles'),
pk as materialized (select * from (select *, count(*) over (partition by bucket, slot, posting) as c from po) where c <= {A.POSTING_CAP}),
ca as materialized (select distinct e.id as e, l.id as l from pk l join pk e on e.bucket = l.bucket and e.posting = l.posting and e.slot in (l.slot, l.slot - 1) and (e.second < l.second or (e.second = l.second and e.id < l.id)) and l.second - e.second <= {r.window}),
cc as materialized (select e, l from (select *, row_number() over (partition by l order by e) as k from ca) where k <= {A.CANDIDATES}),
ov as (select e, l, {", ".join(f"count(*) filter (where a.fam = '{f}') as {f}" for f in _FAMS)} from cc join st a on a.request_id = e join st b on b.request_id = l and b.fam = a.fam and b.v = a.v group by 1, 2),
sp as (select request_id, {", ".join(f"coalesce(max(c) filter (where fam = '{f}'), 0) as {f}_n" for f in _FAMS)} from sq left join sn using (request_id) group by 1),
ne as (select cc.e, cc.l, {", ".join(f"coalesce(ov.{f}, 0) as {f}" for f in _FAMS if f not in ("replay", "initial"))}, case when x.replay_n > 0 then coalesce(ov.replay, 0) / x.replay_n else 0 end as replay, case when x.initial_n > 0 then coalesce(ov.initial, 0) / x.initial_n else 0 end as initial, y.second - w.second as delta, y.n - w.n as growth,
 x.user_handles_n > 0 and z.user_handles_n > 0 as su, x.org_handles_n > 0 and z.org_handles_n > 0 as so, x.initial_n > 0 and z.initial_n > 0 as si from cc left join ov using (e, l) join sp x on x.request_id = e join sp z on z.request_id = l join sq w on w.request_id = e join sq y on y.request_id = l),
nt as (select *, user_handles + project_handles + org_handles as typed from ne), nv as (select *, {listed({f: conditions[f] for f in on})} as fams, {listed(conflicts if r.conflicts else {})} as cons, {" + ".join(parts[f] for f in on)} as score from nt),
rk as (select *, row_number() over (partition by l order by score desc, e) as k, coalesce(lead(score) over (partition by l order by score desc, e), 0) as second_score from nv),
dc as materialized (select request_id, e as predecessor_id, {ladder(1, "accept")} as disposition, coalesce(score, 0)::double as score, coalesce(second_score, 0)::double as runner_up_score, coalesce(score - second_score, 0)::double as margin, coalesce(fams, []) as evidence_families, coalesce(cons, []) as conflicts, {ladder(2, "risk_gate_passed")} as reason from sq left join (select * from rk where k = 1) b on b.l = request_id)"""
