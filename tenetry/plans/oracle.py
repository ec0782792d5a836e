"""The queries in SQL, for a checker that runs them beside the DataFrame plans."""

from __future__ import annotations

from tenetry.schema import COVERAGE_AT, GROUNDING_AT, NEGATIONS, SOURCE_PRIOR, STOPWORDS, SUPPORTED_AT, VERBS

NOW = "timestamp '2026-01-01 00:00:00'"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: len(w) > 1 and not list_contains({_list(STOPWORDS)}, w))"


def _stem(w: str) -> str:
    return f"case when len({w}) > 3 and {w} like '%s' and not regexp_matches({w}, '(ss|us|is)$') then left({w}, len({w}) - 1) else {w} end"


_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


_KIND = f"case when list_contains({_list(SOURCE_PRIOR)}, lower(trim(source))) then lower(trim(source)) else 'unknown' end"
_PRIOR = "(case source " + " ".join(f"when '{k}' then {v}" for k, v in SOURCE_PRIOR.items()) + " else 0.5 end)::double"
B = f"""b as (select id, {_strip("statement")} as statement, case when confidence between 0 and 1 then confidence else 0.5 end as confidence,
 coalesce(evidence, []) as evidence, list_distinct(list_filter(coalesce(connections, []), lambda c: c is not null and c <> '')) as connections,
 {_KIND} as source, coalesce(tier, 'general') as tier, scope, created_at, updated_at, coalesce(confidence_at, updated_at) as confidence_at,
 coalesce(history, []) as history, superseded_by from beliefs where {_strip("statement")} <> '')"""
_TEXT = "concat_ws(' ', statement, list_aggregate(list_transform(evidence, lambda e: coalesce(e.snippet, '')), 'string_agg', ' '))"
_DOCS = f"{B}, docs as (select *, {_tokens(_TEXT)} as tokens from b where superseded_by is null), post as (select id, term, count(*) as tf from (select id, unnest(tokens) as term from docs) group by 1, 2)"
_IDF = f"{_DOCS}, idf as (select term, count(*) as df, ln(((select count(*) from docs) + 1.0) / (count(*) + 1)) + 1 as idf from post group by 1)"


def _retrieve(queries: str, limit: int, within: bool = False) -> str:
    where = "where (q.q_tier is null or q.q_tier = d.tier) and (q.q_scope is null or q.q_scope = d.scope)" if within else ""
    return f"""{_IDF}, qs as ({queries}), qt as (select query_id, q_tier, q_scope, term, count(*) as qtf from (select query_id, q_tier, q_scope, unnest({_tokens("query")}) as term from qs) group by all),
scored as (select q.query_id, d.id, round(sum(qtf * tf * idf) / sqrt(greatest(len(any_value(d.tokens)), 1)) * any_value(d.confidence), 6) as score
 from qt q join post p on p.term = q.term join idf i on i.term = q.term join docs d on d.id = p.id {where} group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored),
hits as (select * from ranked where rank <= {limit})"""


_ASKED = "select query_id, query, tier as q_tier, scope as q_scope from query_requests where query is not null"
_SETS = f"list_distinct(list_transform({_tokens('statement')}, lambda w: {_stem('w')}))"
_CONTENT = f"list_distinct(list_transform(list_filter({_tokens('statement')}, lambda w: not list_contains({_list(NEGATIONS)}, w)), lambda w: {_stem('w')}))"
_POLARITY = f"len(list_filter(regexp_extract_all(lower(statement), '[a-z'']+'), lambda w: list_contains({_list(NEGATIONS)}, w))) % 2"
_SHIFT = (
    "round(1 / (1 + exp(-(ln(least(greatest(c, 0.001), 0.999) / (1 - least(greatest(c, 0.001), 0.999))) + case when e.supports then -ln(1 - least(e.strength, 0.95)) else ln(1 - least(e.strength, 0.95)) end))), 6)"
)


def _clashes(rows: str, threshold: float) -> str:
    return f"""sets as (select id, {_POLARITY} as neg, {_CONTENT} as words from ({rows}) where superseded_by is null),
w as (select id, neg, words, unnest(words) as word from sets),
pairs as (select distinct a.id as affirmed, n.id as negated, a.words as wa, n.words as wn from w a join w n on a.word = n.word and a.neg = 0 and n.neg = 1
 where least(len(a.words), len(n.words)) >= {threshold} * greatest(len(a.words), len(n.words))),
over as (select affirmed, negated, len(list_intersect(wa, wn)) * 1.0 / (len(wa) + len(wn) - len(list_intersect(wa, wn))) as o from pairs),
clashes as (select affirmed, negated, round(o, 6) as overlap from over where o >= {threshold})"""


_WEIGHT = "list_sum(list_transform(list_filter(evidence, lambda e: e.supports = {}), lambda e: e.strength))"
_LIVE_EDGES = f"""{B}, raw as (select id as belief_id, label, {_norm("label")} as concept from (select id, unnest(connections) as label from b where superseded_by is null)),
edges as (select belief_id, concept, min(label) as label from raw where concept <> '' group by 1, 2)"""
_WALK1 = f"""{_LIVE_EDGES}, starts as (select distinct superseded_by as start from b where superseded_by is not null),
own as (select distinct s.start from starts s join edges e on e.belief_id = s.start),
hop1 as (select o.start, e.concept from own o join edges e on e.belief_id = o.start),
hop2 as (select h.start, e.belief_id, min('c:' || h.concept) as via from hop1 h join edges e on e.concept = h.concept where e.belief_id <> h.start group by 1, 2)"""


def _far(max_hops: int) -> str:
    """Level by level, as ``_WALK1`` for one step: the least shortest path to each node, its strength in order of the path."""
    levels = [f"""{_WALK1}, n as materialized (select 'b:' || belief_id as src, 'c:' || concept as dst, 1.0::double as c from edges
 union all select 'c:' || concept, 'b:' || belief_id, confidence from edges join b on b.id = belief_id),
l0 as materialized (select start, 'b:' || start as node, ['b:' || start] as path, confidence as c from own join b on b.id = start)"""]
    for k in range(1, max_hops + 1):
        old = " and ".join(f"not exists (select 1 from l{j} o where o.start = l.start and o.node = n.dst)" for j in range(k % 2, k, 2)) or "true"
        levels.append(f"""p{k} as (select l.start, n.dst as node, list_append(l.path, n.dst) as path, l.c * n.c as c from l{k - 1} l join n on n.src = l.node where {old}),
l{k} as materialized (select start, node, path, c from (select *, row_number() over (partition by start, node order by path) as r from p{k}) where r = 1)""")
    return ", ".join(levels) + ", far as (" + " union all ".join(f"select *, {k} as hops from l{k}" for k in range(max_hops + 1)) + ")"


_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]')"
_VERB = f"list_contains({_list(VERBS)}, lower({{}}))"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


_MARK = r"^\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s+)"
_BLOCKS = rf"""l as (select request_id, {_LINES} as ls from ingest_requests where text is not null),
f as (select request_id, ls, list_filter(list_transform(ls, lambda x, i: case when regexp_matches(x, '^\s*(?:```|~~~)') then i end), lambda i: i is not null) as fences from l),
j as (select request_id, list_aggregate(list_transform(ls, lambda x, i: case
 when regexp_matches(x, '^\s*(?:```|~~~)') or len(list_filter(fences, lambda k: k <= i)) % 2 = 1 or regexp_matches(x, '^\s*\|') or regexp_matches(x, '^\s*#{{1,6}}\s+') or {_strip("x")} = '' then chr(1)
 when regexp_matches(x, '{_MARK}') then chr(1) || {_strip(f"regexp_replace(x, '{_MARK}', '')")} else ' ' || {_strip("x")} end), 'string_agg', '') as t from f),
blocks as (select request_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') as bs from j)"""
_ABBR = r"(?i)(\b(?:e\.g|i\.e|etc|vs|approx|fig|no|al|dr|mr|ms|st)\.)"
# cut behind . ! ? and white space, unless an abbreviation stands there: those are marked first and unmarked after
_SENT = rf"""{_BLOCKS}, sents as (select request_id, list_filter(flatten(list_transform(bs, lambda x: list_transform(string_split(
 regexp_replace(regexp_replace(x, '{_ABBR}{_WS}+', '\1' || chr(2), 'g'), '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda y: {_strip("replace(y, chr(2), ' ')")}))), lambda y: y <> '') as ss from blocks)"""
_PLAIN = _squeeze(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '\*([^*]+)\*', '\1', 'g')"
)
_AW = "regexp_extract_all({}, '[a-zA-Z0-9'']+')"
_CLAIMS = rf"""{_SENT}, claims as (select request_id, list_filter(list_transform(ss, lambda x: {_PLAIN}), lambda s: s <> '' and not regexp_matches(s, '[?:]$') and not regexp_matches(s, '^\s*(?:[-*#>\d.)\s]+)$')
 and case when regexp_matches(s, '[.!]$') then len({_AW.format("s")}) >= 4 or (len({_AW.format("s")}) >= 3 and len(list_filter({_AW.format("s")}, lambda w: {_VERB.format("w")})) > 0) else len(string_split({_squeeze("s")}, ' ')) >= 4 end) as cs from sents)"""


def _explode(cte: str, source: str, col: str, name: str) -> str:
    return f"with {cte} select request_id, unnest(range(len({col}))) as pos, unnest({col}) as {name} from {source}"


def _embed(rows: str) -> str:
    """Unit vectors of signed feature hashes of rows (key, text): the low bits of FNV-1a depend on low bits only."""
    slot = "list_reduce(list_prepend(805, list_transform(string_split({}, ''), lambda c: ord(c))), lambda h, c: (xor(h, c) * 435) % 1024)"
    return f"""rws as ({rows}), tk as (select key, unnest({_tokens("text")}) as w from rws),
feat as (select key, w as f, 1.0 as weight from tk union all select key, {_stem("w")}, 0.8 from tk where {_stem("w")} <> w
 union all select key, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])), 0.35 from tk where len(w) > 4),
hashed as (select f, {slot.format("f")} as dim, case when {slot.format("(f || '#')")} % 2 = 1 then 1.0 else -1.0 end as s from (select distinct f from feat)),
acc as (select key, dim, round(sum(weight * s)::double, 9) as v from feat join hashed using (f) group by 1, 2 having round(sum(weight * s)::double, 9) <> 0),
unit as (select key, dim, v / sqrt(sum(v * v) over (partition by key)) as weight from acc)"""




def _words_of(x: str) -> str:
    return f"string_split({_squeeze(x)}, ' ')"


_IS_VERB = f"list_contains({_list(VERBS)}, lower(regexp_replace(w, '^,+|,+$', '', 'g')))"
_PARTS = f"""pc as (select *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(statement, '[.!?]+$', ''), '(?i)({_WS}*;{_WS}+|,?{_WS}+and{_WS}+|,?{_WS}+but{_WS}+)', chr(1), 'g'), chr(1)), lambda p: {_strip("p")}), lambda p: p <> '') as ps from b),
sj as (select *, list_position(list_transform({_words_of("ps[1]")}, lambda w: {_IS_VERB}), true) as v from pc),
su as (select *, case when v > 0 then array_to_string({_words_of("ps[1]")}[1:v - 1], ' ') else '' end as subj from sj),
fu as (select *, list_transform(ps, lambda p: case when list_contains({_list(VERBS)}, lower({_words_of("p")}[1])) and subj <> '' then subj || ' ' || p else p end) as fs from su),
parts as (select *, len(ps) >= 2 and len(list_filter(ps, lambda p: len(list_filter({_words_of("p")}, lambda w: {_IS_VERB})) = 0)) = 0 and len(list_filter(fs, lambda f: len({_words_of("f")}) < 3)) = 0 as fine from fu)"""


def _selected(within: bool = False) -> str:
    """``win``: of every set of a query's pool that fits its budget the one of lowest energy, as bits; ``lin``: the pool."""
    return f"""{_retrieve(_ASKED, 12, within)}, m as (select query_id, rank - 1 as pos, id, score, greatest(len({_tokens("statement")}), 1) as cost, {_SETS} as s from hits join b using (id)),
top as (select query_id, max(score) as peak, count(*) as n from m group by 1), lin as (select query_id, pos, id, cost, score / case when peak = 0 then 1 else peak end as r, s, n from m join top using (query_id)),
sim as (select x.query_id, x.pos as i, y.pos as j, (x.r + y.r) / 2 * len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) as w
 from lin x join lin y on x.query_id = y.query_id and x.pos < y.pos where len(x.s) > 0 and len(y.s) > 0),
sub as (select query_id, unnest(range(0, (1 << n)::bigint)) as bits from top),
e1 as (select s.query_id, s.bits, sum(case when (bits >> pos) & 1 = 1 then -r else 0 end) as e, sum(case when (bits >> pos) & 1 = 1 then cost else 0 end) as cost from sub s join lin l using (query_id) group by 1, 2),
ok as (select e1.* from e1 join query_requests q using (query_id) where cost <= coalesce(q.budget, 60)),
e2 as (select o.query_id, o.bits, any_value(o.e) + coalesce(sum(case when (bits >> i) & 1 = 1 and (bits >> j) & 1 = 1 then w else 0 end), 0) as e from ok o left join sim using (query_id) group by 1, 2),
win as (select query_id, arg_min(bits, {{'e': round(e, 9), 'n': bit_count(bits), 'b': -list_sum(list_transform(range(12), lambda k: ((bits >> k) & 1) << (11 - k)))}}) as bits, min(round(e, 9)) as e from (select *, bits as bb from e2) group by 1)"""


def _fold(key: str, rows: str, first: str) -> str:
    """``fold``: the rows of each key, numbered by r, taken one by one into the first: evidence ids, labels, confidence."""
    return f"""fold({key}, id, statement, r, c, ev, labels) as (select {key}, id, statement, r, confidence, ev, connections from {rows} where {first}
 union all select {key}, id, statement, r, (c * greatest(len(e2), 1) + gc * greatest(len(gev), 1)) / (greatest(len(e2), 1) + greatest(len(gev), 1)), e2, list_distinct(list_concat(labels, gl))
 from (select f.{key}, f.id, f.statement, g.r, f.c, f.labels, g.confidence as gc, g.ev as gev, g.connections as gl, list_concat(f.ev, list_filter(g.ev, lambda x: not list_contains(f.ev, x))) as e2
  from fold f join {rows} g on g.{key} = f.{key} and g.r = f.r + 1))"""


def sql() -> dict[str, str]:
    out = {
        "p4_found": """with s as (select run_id, started_at, lag(started_at) over (order by started_at, run_id) as prev from index_runs where status = 'succeeded'),
a as (select s.run_id, r.id, max(r.updated_at) as now_at, max(case when r.arrived_at <= s.prev then r.updated_at end) as then_at
 from s join registry_saves r on r.arrived_at <= s.started_at group by 1, 2)
select run_id, id from a where then_at is null or now_at > then_at""",
        "tokenise_stem": f"with {B}, t as (select id, {_tokens('statement')} as ts from b), u as (select id, unnest(range(len(ts))) as pos, unnest(ts) as token from t) select id, pos, token, {_stem('token')} as stem from u",
        "token_cost": f"with {B} select id, greatest(len({_tokens('statement')}), 1) as cost from b",
        "normalise_dedupe": f"with {B} select {_norm('statement')} as norm_key, count(*) as copies, min(id) as first_id from b group by 1",
        "polarity_content": f"with {B} select id, {_POLARITY} as polarity, coalesce(list_aggregate(list_sort({_CONTENT}), 'string_agg', ' '), '') as content from b",
        "split_blocks": _explode(_BLOCKS, "blocks", "bs", "block"),
        "split_sentences": _explode(_SENT, "sents", "ss", "sentence"),
        "extract_claims": _explode(_CLAIMS, "claims", "cs", "claim"),
        "vocabulary_grounding": f"""with {B}, p as (select id, statement, e.id as evidence_id, e.snippet from (select id, statement, unnest(evidence) as e from b)),
s as (select id, evidence_id, list_transform({_AW.format("statement")}, lambda w: lower(w)) as c, list_transform({_AW.format("snippet")}, lambda w: lower(w)) as s from p where snippet is not null),
r as (select id, evidence_id, case when len(c) > 0 then len(list_filter(c, lambda w: list_contains(s, w))) * 1.0 / len(c) else 0.0 end as share from s)
select id, evidence_id, round(share, 6) as share, share >= {GROUNDING_AT} as grounded from r""",
        "registry_scan": f"with {B} select id, confidence from b where confidence >= 0.5 and superseded_by is null",
        "registry_top": f"with {B} select id, confidence from b where tier = 'project' and superseded_by is null order by confidence desc, id limit 50",
        "registry_search": f"with {B} select id, confidence from b where statement ilike '%LEDGER%' order by confidence desc, id limit 50",
        "registry_counts": f"with {B} select tier, count(*) filter (where superseded_by is null) as live, count(superseded_by) as retired, count(*) as stored from b group by 1",
        "fingerprint_diff": """with s as (select id, updated_at, superseded_by, arrived_at, save_id from registry_saves),
a as (select id, max(updated_at) as was, arg_max(coalesce(superseded_by, ''), {'u': updated_at, 's': save_id}) as r from s where arrived_at <= timestamp '2024-07-01' group by 1),
n as (select id, max(updated_at) as now, arg_max(coalesce(superseded_by, ''), {'u': updated_at, 's': save_id}) as r from s where arrived_at <= timestamp '2025-07-01' group by 1),
j as (select id, was, now from (select * from a where r = '') x full join (select * from n where r = '') y using (id))
select id, case when now is null then 'gone' when was is null then 'new' else 'changed' end as change from j where was is distinct from now""",
        "prune_dead": f"with {B} select id, confidence from b where not (confidence <= 0.1 and superseded_by is null)",
        "forget_tier": f"with {B} select id from b where not coalesce(tier = 'project' and scope is not distinct from 'proj-halyard', false)",
        "recall_scope": f"with {B} select id, tier, confidence from b where scope = 'proj-halyard' and superseded_by is null",
        "evidence_shift": f"""with recursive {B}, ev as (select id, {_PRIOR} as p, list_filter(evidence, lambda e: e.strength is not null and e.supports is not null) as es from b),
fold(id, k, c, es) as (select id, 0, p::double, es from ev union all select id, k + 1, (select {_SHIFT} from (select c, es[k + 1] as e)), es from fold where k < len(es))
select id, c as confidence from fold where k = len(es)""",
        "timeline": f"with {B}, h as (select id, unnest(range(len(history))) as pos, unnest(history) as h from b) select id, pos, h.at as at, h.cause as cause, h.confidence as confidence, h.note as note from h",
        "last_verified": f"with {B} select id, coalesce(list_max(list_transform(list_filter(history, lambda h: h.cause in ('evidence', 'merged')), lambda h: h.at)), created_at) as last_verified from b",
        "supersede": f"""with {B}, p as (select min(id) as old_id, max(id) as new_id from b group by {_norm("statement")})
select b.id, coalesce(p.new_id, b.superseded_by) as superseded_by, case when p.new_id is null then len(history) else least(len(history) + 1, 100) end as n_history from b left join p on p.old_id = b.id and p.old_id <> p.new_id""",
        "decay": f"""with {B}, d as (select *, (epoch_us({NOW}) - epoch_us(confidence_at)) / 86400000000.0 as days from b),
f as (select *, greatest(round(confidence * power(0.5, days / 180), 6), 0.05) as faded from d), g as (select *, coalesce(superseded_by is null and days > 0 and faded < confidence, false) as decayed from f)
select id, case when decayed then faded else confidence end as confidence, decayed from g""",
        "decay_curve": f"""with d as (select o_orderkey, (epoch_us({NOW}) - epoch_us(o_orderdate)) / 86400000000.0 as days from orders)
select o_orderkey, case when days > 0 and greatest(round(0.8 * power(0.5, days / 180), 6), 0.05) < 0.8 then greatest(round(0.8 * power(0.5, days / 180), 6), 0.05) else 0.8 end as confidence from d""",
        "extract_beliefs": f"""with {_CLAIMS}, c as (select request_id, unnest(range(len(cs))) as pos, unnest(cs) as statement from claims),
r as (select request_id, {_KIND} as source, tier, scope, connections from ingest_requests)
select md5(request_id || ':' || pos || ':' || statement) as id, statement, {_PRIOR} as confidence, source, coalesce(tier, 'general') as tier, scope,
 len(list_distinct(list_filter(coalesce(connections, []), lambda x: x is not null and x <> ''))) as n_connections from c join r using (request_id)""",
        "idf": f"with {_IDF} select term, df, round(idf, 6) as idf from idf",
        "postings": f"with {_DOCS} select id, term, tf from post",
        "index_refresh": f"with {_DOCS} select id, term, tf from post",
        "tfidf_topk": f"with {_retrieve(_ASKED, 5)} select query_id, id, score, rank from hits",
        "scoped_topk": f"with {_retrieve(_ASKED, 5, True)} select query_id, id, score, rank from hits",
        "check_claims": f"""with {_retrieve(_ASKED, 1)}, c as (select query_id, list_distinct({_tokens("query")}) as wanted from qs),
k as (select c.query_id, h.id, coalesce(h.score, 0.0) as relevance, case when h.id is null or len(wanted) = 0 then 0.0 else round(len(list_intersect(wanted, list_distinct(d.tokens))) * 1.0 / len(wanted), 6) end as coverage
 from c left join hits h using (query_id) left join docs d on d.id = h.id)
select query_id as claim_id, id is not null and relevance >= {SUPPORTED_AT} and coverage >= {COVERAGE_AT} as supported, relevance, coverage,
 case when id is not null and relevance >= {SUPPORTED_AT} and coverage >= {COVERAGE_AT} then id end as belief_id from k""",
        "justify": f"""with {B}, j as (select id, confidence, len(list_filter(evidence, lambda e: e.supports)) as n_for, len(list_filter(evidence, lambda e: not e.supports)) as n_against,
 round(coalesce({_WEIGHT.format("true")}, 0), 6) as support, round(coalesce({_WEIGHT.format("false")}, 0), 6) as against,
 coalesce(list_aggregate(list_transform(list_filter(evidence, lambda e: e.supports), lambda e: coalesce(e.locator, e.source)), 'string_agg', ', '), '') as w from b),
v as (select *, case when n_for = 0 and n_against = 0 then 'unsupported' when n_for > 0 and n_against > 0 then 'disputed' when n_for > 0 then 'grounded' else 'refuted' end as verdict from j)
select id, confidence, n_for, n_against, support, against, verdict, round(confidence * (1 + support - against), 6) as weight,
 verdict || ' at ' || cast(round(confidence * 100, 0) as int) || '%' || case when w <> '' then ', from ' || w else '' end as explanation from v""",
        "pair_jaccard": f"""with {_retrieve(_ASKED, 12)}, m as (select query_id, rank - 1 as pos, {_SETS} as s from hits join b using (id))
select x.query_id, x.pos as i, y.pos as j, round(case when len(x.s) > 0 and len(y.s) > 0 then len(list_intersect(x.s, y.s)) * 1.0 / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) else 0 end, 6) as similarity
 from m x join m y on x.query_id = y.query_id and x.pos < y.pos""",
        "dense_cosine_topk": """with v as (select vec_id, embedding::double[64] as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id as id, round(array_cosine_similarity(q.e, v.e), 6) as similarity from v q, v where q.vec_id % 20 = 0)
select query_id, id, round(similarity, 4) as similarity from (select *, row_number() over (partition by query_id order by similarity desc, id) as r from s) where r <= 5""",
        "graph_edges": f"with {_LIVE_EDGES} select belief_id, concept, label from edges",
        "graph_concepts": f"with {_LIVE_EDGES} select concept, min(label) as label, count(*) as beliefs from edges group by 1",
        "beliefs_about": f"with {_LIVE_EDGES} select belief_id, confidence from edges join b on b.id = belief_id where concept = 'evidence search'",
        "related": f"with {_WALK1} select h.start, h.belief_id as id, 2 as hops, b.confidence, row_number() over (partition by start order by b.confidence desc, b.id) as rank from hop2 h join b on b.id = h.belief_id",
        "graph_walk": f"with {_far(3)} select start, node, hops from far",
        "shortest_paths": f"with {_far(6)} select start, node, array_to_string(path, ' > ') as path from far",
        "graph_size": f"with {_LIVE_EDGES} select count(distinct belief_id) as beliefs, count(distinct concept) as concepts, count(*) as edges from edges",
        "graph_neighbours": f"with {_LIVE_EDGES} select 'b:' || belief_id as node, 'c:' || concept as neighbour from edges union all select 'c:' || concept, 'b:' || belief_id from edges",
        "connect": f"""with {_far(6)}, pairs as (select start, (select min(start) from starts) as goal from starts)
select p.start, p.goal, array_to_string(path, ' > ') as path from pairs p join far on far.start = p.start and node = 'b:' || p.goal""",
        "infer": f"""with {_far(4)}, s as (select far.start, b.id, hops, round(far.c, 6) as strength, array_to_string(path, ' > ') as chain, b.confidence from far join b on node = 'b:' || b.id where hops > 0),
r as (select *, row_number() over (partition by start order by strength desc, hops, confidence desc, id) as rank from s)
select start, id, hops, strength, chain, rank from r where rank <= 5""",
        # a quarter of 0.3 ends on a half at the seventh place, which round() of a double takes either way; of the digits it is half-up
        "propagate": f"""with {_far(4)}, s as (select id, confidence, {_SETS} as s from b),
m as (select far.start, y.id, hops // 2 as hops, y.confidence, -0.3 * power(0.5, hops // 2) * case when len(x.s) > 0 and len(y.s) > 0 then len(list_intersect(x.s, y.s)) * 1.0 / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) else 0 end as d
 from far join s x on x.id = far.start join s y on node = 'b:' || y.id where hops > 0)
select start, start as id, 0 as hops, round(least(greatest(confidence - 0.3, 0), 1), 6) as confidence from starts join b on b.id = start
 union all select start, id, hops, round(least(greatest(confidence + d, 0), 1)::varchar::decimal(38, 20), 6)::double from m where abs(d) >= 1e-9""",
        "split_claims": f"""with {B}, {_PARTS} select id, unnest(range(len(fs))) as pos, unnest(list_transform(fs, lambda f: upper(f[1]) || f[2:] || '.')) as part from parts where fine""",
        "split_registry": f"""with {B}, {_PARTS}, c as (select id, confidence, history, unnest(range(len(fs))) as pos, unnest(list_transform(fs, lambda f: upper(f[1]) || f[2:] || '.')) as statement from parts where fine)
select md5(id || ':' || pos) as id, statement, confidence, least(len(history) + 1, 100) as n_history from c union all select id, statement, confidence, len(history) from parts where not fine""",
        "ground_report": f"""with recursive {_SENT},
tok as (select request_id, list_filter(ss, lambda x: not ends_with(x, '?') and len({_tokens("x")}) > 0) as cs, {_strip("text")} as whole from sents join ingest_requests using (request_id)),
cl as (select request_id, unnest(case when len(cs) > 0 then cs when whole <> '' then [whole] else [] end) as claim from tok),
{_retrieve("select claim as query_id, claim as query, null::varchar as q_tier, null::varchar as q_scope from (select distinct claim from cl)", 1)},
k as (select qs.query_id as claim, h.score, list_distinct({_tokens("query")}) as wanted, d.tokens from qs left join hits h using (query_id) left join docs d on d.id = h.id),
v as (select claim, coalesce(score >= {SUPPORTED_AT} and len(wanted) > 0 and round(len(list_intersect(wanted, list_distinct(tokens))) * 1.0 / len(wanted), 6) >= {COVERAGE_AT}, false) as ok from k),
g as (select request_id, count(*) as claims, count(*) filter (where ok) as supported from cl join v using (claim) group by 1)
select r.request_id as answer_id, coalesce(claims, 0) as claims, coalesce(supported, 0) as supported, case when claims > 0 then round(supported * 1.0 / claims, 4) else 0.0 end as score from ingest_requests r left join g using (request_id)""",
        "hash_embed": f"with {_embed('select query_id as key, query as text from query_requests where query is not null')} select key as query_id, dim, round(weight, 6) as weight from unit",
        "vector_topk": f"""with {B}, {_embed(f"select 'b' || id as key, {_TEXT} as text from b where superseded_by is null union all select distinct 'q' || query, query from query_requests where query is not null")},
sims as (select q.key as qkey, d.key[2:] as id, round(sum(q.weight * d.weight), 9) as similarity from unit q join unit d on q.dim = d.dim and q.key like 'q%' and d.key like 'b%' group by 1, 2),
near as (select *, row_number() over (partition by qkey order by similarity desc, id) as r from sims),
sc as (select qkey, b.id, similarity, round(similarity * confidence, 6) as score from near join b using (id) where r <= 15 and similarity >= 0.12),
best as (select *, row_number() over (partition by qkey order by score desc, id) as r from sc)
select query_id, id, similarity, score from query_requests q join best on best.qkey = 'q' || q.query where r <= 5""",
        "select_exact": f"with {_selected()} select l.query_id, l.pos, l.id, l.cost, round(e, 5) as energy from win join lin l using (query_id) where (bits >> pos) & 1 = 1",
        "context": f"""with {_selected(True)}, picked as (select l.query_id, l.pos, l.id, l.cost from win join lin l using (query_id) where (bits >> pos) & 1 = 1),
said as (select p.*, '- ' || statement || ' (' || cast(round(confidence * 100, 0) as int) || '%, ' || case when f = 0 and a = 0 then 'unsupported' when f > 0 and a > 0 then 'disputed' when f > 0 then 'grounded' else 'refuted' end || ')' as line
 from picked p join (select *, len(list_filter(evidence, lambda e: e.supports)) as f, len(list_filter(evidence, lambda e: not e.supports)) as a from b) b using (id))
select query_id, count(*) as picked, sum(cost)::bigint as tokens, string_agg(line, chr(10) order by pos) as prompt from said group by 1""",
        "scoped_vector_topk": f"""with {B}, {_embed(f"select 'b' || id as key, {_TEXT} as text from b where superseded_by is null union all select distinct 'q' || query, query from query_requests where query is not null")},
sims as (select q.key as qkey, d.key[2:] as id, round(sum(q.weight * d.weight), 9) as similarity from unit q join unit d on q.dim = d.dim and q.key like 'q%' and d.key like 'b%' group by 1, 2),
near as (select query_id, b.id, similarity, round(similarity * b.confidence, 6) as score, row_number() over (partition by query_id order by similarity desc, b.id) as r
 from query_requests q join sims s on s.qkey = 'q' || q.query join b on b.id = s.id where (q.tier is null or q.tier = b.tier) and (q.scope is null or q.scope = b.scope)),
best as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from near where r <= 15 and similarity >= 0.12)
select query_id, id, score, rank from best where rank <= 5""",
        "knn_pairs": f"""with {B}, {_embed(f"select id as key, {_TEXT} as text from b where superseded_by is null")},
sims as (select q.key as q, d.key as d, round(sum(q.weight * d.weight), 9) as similarity from unit q join unit d on q.dim = d.dim and q.key <> d.key where ('0x' || right(q.key, 8))::bigint % 20 = 0 group by 1, 2),
near as (select *, row_number() over (partition by q order by similarity desc, d) as r from sims)
select distinct least(q, d) as a, greatest(q, d) as b from near where r <= 10""",
        "passage_window": f"""with {_CLAIMS}, c as (select request_id, unnest(range(len(cs))) as pos, unnest(cs) as claim from claims),
w as (select c.request_id, pos, ss, text, list_transform(ss, lambda x: len(list_intersect(list_distinct({_tokens("x")}), list_distinct({_tokens("claim")})))) as shared
 from c join sents using (request_id) join ingest_requests using (request_id)),
p as (select *, list_position(shared, list_max(shared)) as best from w)
select request_id, pos, case when len(ss) <= 2 then text else array_to_string(ss[greatest(best - 1, 1):best], ' ') end as passage from p""",
        "add_evidence": f"""with recursive {B}, n as (select id as src, superseded_by as id, unnest(range(len(evidence))) as pos, unnest(evidence) as e from b where superseded_by is not null),
ev as (select id, list(e order by src, pos) as es from n group by 1),
fold(id, k, c, es) as (select id, 0, confidence, es from b join ev using (id) union all select id, k + 1, (select {_SHIFT} from (select c, es[k + 1] as e)), es from fold where k < len(es)),
done as (select id, c, len(es) as n from fold where k = len(es))
select b.id, coalesce(c, confidence) as confidence, len(evidence) + coalesce(n, 0) as n_evidence, least(len(history) + coalesce(n, 0), 100) as n_history from b left join done using (id)""",
        "merge_fold": f"""with recursive {B}, g as (select *, list_transform(evidence, lambda e: e.id) as ev, {_norm("statement")} as k, row_number() over (partition by {_norm("statement")} order by created_at nulls first, id) as r from b),
{_fold("k", "g", "r = 1")}
select k as norm_key, id, r as merged, round(c, 6) as confidence, len(ev) as n_evidence, coalesce(array_to_string(list_sort(labels), '|'), '') as labels from fold f where not exists (select 1 from g where g.k = f.k and g.r = f.r + 1)""",
        "ingest": f"""with recursive {B}, {_CLAIMS}, c as (select request_id, unnest(range(len(cs))) as pos, unnest(cs) as statement from claims),
q as (select request_id, {_KIND} as source, tier, scope, list_distinct(list_filter(coalesce(connections, []), lambda x: x is not null and x <> '')) as connections from ingest_requests),
fresh as (select md5(request_id || ':' || pos || ':' || statement) as id, statement, {_PRIOR} as confidence, [md5('e:' || request_id || ':' || pos || ':' || statement)] as ev, connections, coalesce(tier, 'general') as tier, scope, request_id as doc, pos from c join q using (request_id)),
every as (select id, statement, confidence, list_transform(evidence, lambda e: e.id) as ev, connections, tier, scope, -1 as doc, -1 as pos from b union all select * from fresh),
keyed as (select *, {_norm("statement")} || chr(1) || tier || chr(1) || coalesce(scope, '') as k from every),
g as (select *, row_number() over (partition by k order by doc, pos, id) as r, count(*) over (partition by k) as n, max(doc) over (partition by k) as newest from keyed),
{_fold("k", "g", "r = 1 and newest >= 0 and n > 1")}
select id, statement, round(c, 6) as confidence, len(ev) as n_evidence, len(labels) as n_connections from fold f where not exists (select 1 from g where g.k = f.k and g.r = f.r + 1)
 union all select id, statement, round(confidence, 6), len(ev), len(connections) from g where newest < 0 or n = 1""",
        "contradictions": f"with {B}, {_clashes('select * from b', 0.6)} select affirmed, negated, overlap from clashes",
        "contradiction_winners": f"""with {B}, {_clashes("select * from b", 0.6)},
ws as (select id, confidence * (1 + coalesce({_WEIGHT.format("true")}, 0) - coalesce({_WEIGHT.format("false")}, 0)) as w from b),
j as (select c.*, x.w as wa, y.w as wn from clashes c join ws x on x.id = affirmed join ws y on y.id = negated)
select affirmed, negated, overlap, case when wa >= wn then affirmed else negated end as winner, case when wa >= wn then negated else affirmed end as loser, round(abs(wa - wn), 6) as margin from j""",
        "order_contradictions": f"""with li as (select l_orderkey, avg(case when l_linestatus = 'F' then 1.0 else 0.0 end) >= 0.5 as done from lineitem group by 1),
o as (select 'o' || o_orderkey as id, 'Order ' || o_orderkey || case when o_orderstatus = 'F' then ' is finished.' else ' is not finished.' end as statement, null as superseded_by from orders
 union all select 'l' || l_orderkey, 'Order ' || l_orderkey || case when done then ' is finished.' else ' is not finished.' end, null from li),
s as (select id, {_POLARITY} as neg, list_sort({_CONTENT}) as words from o)
select a.id as affirmed, n.id as negated, 1.0::double as overlap from s a join s n on a.words = n.words and a.neg = 0 and n.neg = 1 where len(a.words) > 0""",
    }
    return out
