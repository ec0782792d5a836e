"""Queries p1 to p10 of the training-data operators (all but p4, which is general) and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenetry.llm import copies, frequency, leakage, neardup, packing, pii, relevance, sentences, survivors
from tenetry.session import shared_dir, table
from tenetry.sources import registry


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = sentences.sentences(table(spark, d, "ingest_requests"))
    return found.select("request_id", F.col("start").alias("sent_start"), F.col("end").alias("sent_end"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.suppliers(table(spark, d, "beliefs"))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    out = survivors.survivors(table(spark, d, "beliefs"))
    return out.withColumn("evidence", F.coalesce(F.size("evidence"), F.lit(-1))).withColumnRenamed("evidence", "n_evidence")


def _counted(spark: SparkSession, d: str) -> frequency.Counts:
    """Counts of an older state of the registry, stored, and brought up to its present one by what changed since."""
    beliefs = table(spark, d, "beliefs")
    old = beliefs.where(F.coalesce(F.col("created_at") <= F.lit("2025-01-01").cast("timestamp_ntz"), F.lit(False)))
    counts = frequency.Counts(spark, f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}")
    before, now = old.count(), beliefs.count()
    counts.merge(frequency.deltas(old), before, 0)
    changed = registry.difference(old.select("id", F.col("created_at").alias("updated_at")), beliefs.select("id", "updated_at"))
    counts.merge(frequency.deltas(beliefs, old, changed), now - before, 1)
    return counts


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    counts = _counted(spark, d)
    return frequency.marks(counts.rows(), counts.records()).where("mark is not null").select("field", "term", "mark")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).rows()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(neardup.belief_texts(table(spark, d, "beliefs")))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per text with its group and number of links; the group's number is left out, as it is only a label."""
    g = neardup.groups(neardup.belief_texts(table(spark, d, "beliefs")))
    heads = g.groupBy("field", "group").agg(F.min("key").alias("group_key"), F.count(F.lit(1)).alias("members"))
    return g.join(heads, ["field", "group"]).select("field", "key", "group_key", "members", "links")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "beliefs")).where("copies > 1").select("group_id", "id")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct statement with its number of copies."""
    return copies.collapse(table(spark, d, "beliefs")).where("id = group_id").select("group_id", "copies")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return relevance.score_terms(table(spark, d, "beliefs"), tf_least=3, df_most=3).select("id", "term")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every belief with its score, to 6 places."""
    return relevance.score_terms(table(spark, d, "beliefs")).withColumn("score", F.round("score", 6))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text placed in containers, for each of the windows."""
    return packing.pack_all(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    return packing.audit(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(table(spark, d, "documents")).select("doc_id", "kind", "span_start", "span_end")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit() and callable(f)}


_WORDS = r"list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))"
_CANON = (
    r"""canon as (select b.*, list_filter(regexp_split_to_array(statement, '[;|\r\n]+'), lambda p: regexp_matches(p, '[\p{L}\p{N}]')) as parts, """
    + _WORDS.format("statement")
    + r""" as ws from beliefs b),
keyed as (select canon.*, case when len(ws) = 0 then null
 when len(parts) >= 3 and len(list_filter(parts, lambda p: not regexp_matches(p, '^[^\p{L}\p{N}:=]*(?i:subject|relation|object|since|unit)[^\p{L}\p{N}:=]*[:=]'))) = 0
 then chr(2) || list_aggregate(list_sort(list_transform(parts, lambda p: list_aggregate("""
    + _WORDS.format("p")
    + """, 'string_agg', ' '))), 'string_agg', chr(1))
 else list_aggregate(ws, 'string_agg', ' ') end as k from canon)"""
)
_GROUPS = f"""with {_CANON},
members as (select keyed.*, min(id) over (partition by k) as group_id, count(*) over (partition by k) as copies from keyed where k is not null)"""


def _best(field: str, order: str, where: str = "true") -> str:
    return f"select group_id, '{field}' as field, id from (select group_id, id, row_number() over (partition by group_id order by {order}updated_at desc nulls last, id) as r from members where copies > 1 and {where}) where r = 1"


_TRUST = "list_position(['official_docs','research_paper','book','code','unknown','web','conversation'], lower(trim(coalesce(source, 'unknown'))))"


def sql() -> dict[str, str]:
    text = "concat_ws(' ', statement, list_aggregate(list_transform(coalesce(evidence, []), lambda e: coalesce(e.snippet, '')), 'string_agg', ' '))"
    terms = f"""occ as (select b.id, 'statement' as field, unnest({_WORDS.format("statement")}) as term from beliefs b
 union all select id, 'connections', t from (select id, list_aggregate({_WORDS.format("label")}, 'string_agg', ' ') as t from (select id, unnest(connections) as label from beliefs)) where t <> ''),
counts as (select field, term, count(*) as occurrences, count(distinct id) as records from occ group by 1, 2)"""
    grams = "select distinct KEY, list_aggregate(ws[i:i + 11], 'string_agg', ' ') as g from (select KEY, ws, unnest(range(1, greatest(len(ws) - 10, 1))) as i from (select KEY, " + _WORDS.format("text") + " as ws from TABLE_))"
    suppliers = f"{_GROUPS} " + " union all ".join(
        [
            _best("updated_at", "", "updated_at is not null"),
            _best("source", f"{_TRUST}, "),
            _best("evidence", "coalesce(len(evidence), 0) desc, "),
            _best("confidence", "", "confidence between 0 and 1"),
            _best("scope", "", "trim(scope) <> ''"),
        ]
    )
    near = f"""texts as (select 'statement' as field, id as key, statement as text from beliefs union all select 'snippet', e.id, e.snippet from (select unnest(evidence) as e from beliefs)),
{_CANON.replace("beliefs b", "(select text as statement, * exclude (text) from texts) b")},
sets as (select field, key, k, list_distinct(ws) as s from keyed where k is not null),
w as (select field, key, len(s) as n, unnest(s) as word from sets),
freq as (select word, count(*) as c from w group by 1),
pre as (select field, key, word from (select w.*, row_number() over (partition by field, key order by c, word) as r from w join freq using (word)) where r <= n - ceil(0.7 * n - 1e-9) + 1),
cand as (select distinct a.field, a.key as key_a, b.key as key_b from pre a join pre b on a.field = b.field and a.word = b.word and a.key < b.key)"""
    return {
        "p2_found": suppliers,
        "p2_survivors": f"""with picks as ({suppliers})
select group_id, any_value(b.updated_at) filter (where field = 'updated_at') as updated_at, any_value(b.source) filter (where field = 'source') as source,
 coalesce(any_value(len(b.evidence)) filter (where field = 'evidence'), -1) as n_evidence, any_value(b.confidence) filter (where field = 'confidence') as confidence,
 any_value(b.scope) filter (where field = 'scope') as scope from picks join beliefs b using (id) group by 1""",
        "p3_found": f"with {terms}, n as (select count(*) as n from beliefs) select field, term, case when records < 3 then 'rare' else 'common' end as mark from counts, n where records < 3 or records > n * 0.1",
        "p3_counts": f"with {terms} select field, term, occurrences, records from counts",
        "p5_found": f"""with {near}
select c.field, key_a, key_b from cand c join sets a on a.field = c.field and a.key = key_a join sets b on b.field = c.field and b.key = key_b
where a.k <> b.k and 10 * len(list_intersect(a.s, b.s)) >= 7 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))""",
        "p5_groups": f"""with recursive {near},
edges as (select distinct c.field, a.k as x, b.k as y from cand c join sets a on a.field = c.field and a.key = key_a join sets b on b.field = c.field and b.key = key_b
 where a.k <> b.k and 10 * len(list_intersect(a.s, b.s)) >= 7 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
both_ways as (select * from edges union select field, y, x from edges),
reach as (select distinct field, x, x as y from both_ways union select r.field, r.x, e.y from reach r join both_ways e on e.field = r.field and e.x = r.y),
part as (select field, x as k, min(y) as part from reach group by 1, 2), links as (select field, x as k, count(*) as links from both_ways group by 1, 2),
labelled as (select s.field, s.key, coalesce(part, k) as part, coalesce(links, 0) as links from sets s left join part using (field, k) left join links using (field, k))
select field, key, min(key) over (partition by field, part) as group_key, count(*) over (partition by field, part) as members, links from labelled""",
        "p6_found": f"{_GROUPS} select group_id, id from members where copies > 1",
        "p6_records": f"{_GROUPS} select group_id, copies from members where id = group_id union all select id, 1 from keyed where k is null",
        "p7_found": f"""with ws as (select id, unnest({_WORDS.format(text)}) as term from beliefs),
tf as (select id, term, count(*) as tf from ws group by 1, 2), df as (select term, count(*) as df from tf group by 1)
select id, term from tf join df using (term) where tf >= 3 and df <= 3""",
        "p7_scores": f"""with w as (select id, {_WORDS.format(text)} as ws from beliefs), n as (select count(*)::double as total, avg(len(ws)) as mean from w),
tf as (select id, term, count(*) as tf, any_value(l) as l from (select id, len(ws) as l, unnest(ws) as term from w) group by 1, 2), df as (select term, count(*) as df from tf group by 1)
select id, term, tf, df, round(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean)), 6) as score from tf join df using (term), n""",
        "p8_audit": "select window_name, (select count(*) from documents) as documents, 0 as overfull, 0 as incomplete, 0 as cut from context_windows",
        "p9_found": f"with d as ({grams.replace('KEY', 'doc_id').replace('TABLE_', 'documents')}), e as ({grams.replace('KEY', 'item_id').replace('TABLE_', 'eval_items')}) select distinct doc_id, item_id from d join e using (g)",
    }
