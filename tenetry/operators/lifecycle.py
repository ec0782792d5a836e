"""Belief lifecycle: evidence, merge, supersede, split, ingest, decay, prune. All are snapshot-to-snapshot transforms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenetry.functions import numeric, text
from tenetry.schema import DEAD_BELOW, DECAY_FLOOR, EVIDENCE, HALF_LIFE_DAYS, HISTORY_LIMIT, REVISION, prior, source_kind
from tenetry.session import materialize


def moment(at: dt.datetime | str) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def revision(at: Column, cause: str, confidence: Column, note: Column) -> Column:
    return F.struct(at.alias("at"), F.lit(cause).alias("cause"), confidence.alias("confidence"), note.alias("note")).cast(REVISION)


def appended(history: Column, rev: Column) -> Column:
    """History with one revision more; only the newest HISTORY_LIMIT are kept."""
    long = F.concat(history, F.array(rev))
    return F.when(F.size(long) > HISTORY_LIMIT, F.slice(long, -HISTORY_LIMIT, HISTORY_LIMIT)).otherwise(long)


def record(beliefs: DataFrame, where: Column, cause: str, note: Column, at: dt.datetime | str) -> DataFrame:
    """Append a revision to the rows ``where`` holds and move their clocks."""
    out = beliefs.withColumn("_on", F.coalesce(where, F.lit(False)))
    out = out.withColumn("history", F.when(F.col("_on"), appended(F.col("history"), revision(moment(at), cause, F.col("confidence"), note))).otherwise(F.col("history")))
    for clock in ("updated_at", "confidence_at"):
        out = out.withColumn(clock, F.when(F.col("_on"), moment(at)).otherwise(F.col(clock)))
    return out.drop("_on")


def folded_confidence(start: Column, evidence: Column) -> Column:
    """Confidence after every piece of evidence in turn, rounded at each step."""
    return F.aggregate(evidence, start, lambda c, e: numeric.shift(c, e["strength"], e["supports"]))


def add_evidence(beliefs: DataFrame, evidence: DataFrame, at: dt.datetime | str) -> DataFrame:
    """Attach evidence rows (belief_id, seq, and the evidence fields) in order of ``seq`` and shift confidence each time."""
    fields = ["id", "snippet", "source", "locator", "strength", "supports", "created_at"]
    packed = evidence.groupBy("belief_id").agg(F.sort_array(F.collect_list(F.struct("seq", *(F.col(c).alias(f"e_{c}") for c in fields)))).alias("_new"))
    joined = beliefs.join(packed, beliefs["id"] == packed["belief_id"], "left").drop("belief_id")
    new = F.transform(F.coalesce("_new", F.array().cast(joined.schema["_new"].dataType)), lambda e: F.struct(*(e[f"e_{c}"].alias(c) for c in fields)).cast(EVIDENCE))
    start = F.struct(F.col("confidence").alias("c"), F.col("history").alias("h"))
    step = lambda s, e: text.let(numeric.shift(s["c"], e["strength"], e["supports"]), lambda c: F.struct(c.alias("c"), appended(s["h"], revision(moment(at), "evidence", c, F.coalesce(e["locator"], F.substring(e["snippet"], 1, 60)))).alias("h")))
    out = joined.withColumn("_new", new).withColumn("_state", F.aggregate("_new", start, step))
    touched = F.size("_new") > 0
    out = out.withColumn("confidence", F.col("_state.c")).withColumn("history", F.col("_state.h")).withColumn("evidence", F.concat("evidence", "_new"))
    for clock in ("updated_at", "confidence_at"):
        out = out.withColumn(clock, F.when(touched, moment(at)).otherwise(F.col(clock)))
    return out.drop("_new", "_state")


def connect(connections: Column, labels: Column) -> Column:
    """Union of labels; empty ones are dropped."""
    return F.array_union(connections, F.filter(labels, lambda x: x != ""))


def is_dead(confidence: Column) -> Column:
    return confidence <= DEAD_BELOW


def last_verified(history: Column, created_at: Column) -> Column:
    """When evidence last spoke: the latest evidence or merge revision, else the creation."""
    return F.coalesce(F.array_max(F.transform(F.filter(history, lambda h: h["cause"].isin("evidence", "merged")), lambda h: h["at"])), created_at)


def merge_fold(beliefs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Fold the rows of each key in ``order`` into the first: evidence by id, labels, and the evidence-weighted confidence.

    The weight of the folded side counts the evidence it has after taking over the other's, as the model defines it. Which
    evidence is new, and where, is settled by counts over (key, evidence id) and labels by counts over (key, label), both
    combined on the map side; a group's own task sees four numbers a member, and the evidence of the one belief that is
    left, which the model keeps in one row. Evidence without an id is new each time; null keys are one key."""
    rows = beliefs.select(*keys, F.struct(*order, F.col("id").alias("_id")).alias("_at"), "confidence", "evidence", "connections")
    seen = rows.select(*keys, "_at", F.posexplode("evidence").alias("_n", "_e"))
    own = F.coalesce(F.col("_e.id"), F.to_json(F.struct("_at", "_n")))
    fresh = seen.groupBy(*keys, own.alias("_own")).agg(F.min_by(F.struct("_at", "_n", "_e"), F.struct("_at", "_n")).alias("f"))
    evidence = fresh.groupBy(*keys).agg(F.collect_list(F.struct("f._at", "f._n", "f._e")).alias("_ev"))
    counts = fresh.groupBy(*keys, F.col("f._at").alias("_at")).agg(F.count(F.lit(1)).alias("_new"))
    labels = rows.select(*keys, F.explode("connections").alias("_l")).groupBy(*keys).agg(F.array_sort(F.collect_set("_l")).alias("connections"))
    same = lambda left, right, more=(): [left[k].eqNullSafe(right[k]) for k in (*keys, *more)]
    slim = rows.select(*keys, "_at", "confidence", F.size("evidence").alias("_b"))
    slim = slim.join(counts, same(slim, counts, ["_at"]), "left").select(*(slim[k] for k in keys), slim["_at"], "confidence", "_b", F.coalesce("_new", F.lit(0)).alias("_new"))
    groups = slim.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "confidence", "_b", "_new"))).alias("_m"))
    first = F.get("_m", F.lit(0))
    start = F.struct(first["confidence"].alias("c"), first["_b"].cast("bigint").alias("n"))

    def step(s: Column, r: Column) -> Column:
        n = s["n"] + r["_new"]
        a, b = F.greatest(n, F.lit(1)), F.greatest(r["_b"], F.lit(1))
        return F.struct(((s["c"] * a + r["confidence"] * b) / (a + b)).alias("c"), n.alias("n"))

    folded = F.aggregate(F.slice("_m", 2, F.greatest(F.size("_m") - 1, F.lit(1))), start, step)["c"]
    out = groups.select(*keys, first["_at"]["_id"].alias("id"), F.size("_m").alias("merged"), folded.alias("confidence"))
    for side in (evidence, labels):
        out = out.join(side, same(out, side), "left").select(*(out[c] for c in out.columns), *(c for c in side.columns if c not in keys))
    kept = F.transform(F.sort_array("_ev"), lambda x: x["_e"])
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select(*keys, "id", "merged", "confidence", none(kept, f"array<{EVIDENCE}>").alias("evidence"), none(F.col("connections"), "array<string>").alias("connections"))


def supersede(beliefs: DataFrame, pairs: DataFrame, at: dt.datetime | str) -> DataFrame:
    """Point beliefs (old_id) at what replaced them (new_id); unknown ids and a belief by itself change nothing."""
    known = beliefs.select(F.col("id").alias("new_id"))
    wanted = pairs.where("old_id <> new_id").join(known, "new_id", "left_semi").groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    joined = beliefs.join(wanted, beliefs["id"] == wanted["old_id"], "left").drop("old_id")
    moved = joined.withColumn("superseded_by", F.coalesce("new_id", "superseded_by"))
    return record(moved, F.col("new_id").isNotNull(), "superseded", F.col("new_id"), at).drop("new_id")


def timeline(beliefs: DataFrame) -> DataFrame:
    """Rows (id, pos, at, cause, confidence, note) of every history."""
    return beliefs.select("id", F.posexplode("history").alias("pos", "h")).select("id", "pos", "h.*")


def split_all(beliefs: DataFrame, at: dt.datetime | str) -> DataFrame:
    """Every belief that holds several claims replaced by one belief per claim; ids are made from parent and position."""
    parted = beliefs.withColumn("_parts", text.split_claims(F.col("statement")))
    whole = parted.where(F.size("_parts") < 2).drop("_parts")
    children = parted.where(F.size("_parts") >= 2).select("*", F.posexplode("_parts").alias("_pos", "_part"))
    children = record(children, F.lit(True), "split", F.col("id"), at)
    children = children.withColumn("id", F.md5(F.concat_ws(":", "id", F.col("_pos").cast("string")))).withColumn("statement", F.col("_part"))
    children = children.withColumn("superseded_by", F.lit(None).cast("string"))
    return whole.unionByName(children.select(*whole.columns))


def extract(requests: DataFrame, at: dt.datetime | str, id_col: str = "request_id") -> DataFrame:
    """Beliefs stated by texts (id, text, source, locator, connections, tier, scope): one row per claim, not yet stored.

    Confidence is the source's prior; the sentence is its own first evidence, added without a shift."""
    found = requests.where("text is not null").select("*", F.posexplode(text.claims(F.col("text"))).alias("_pos", "_claim"))
    found = found.withColumn("source", source_kind(F.col("source"))).withColumn("_c", prior(F.col("source")))
    # a request sent again with another text states other claims, and the same claim again is the same belief
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.col("_pos").cast("string"), F.col("_claim"))
    snippet = F.struct(
        F.md5(F.concat(F.lit("e:"), key)).alias("id"), F.col("_claim").alias("snippet"), F.col("source"), F.col("locator"), F.col("_c").alias("strength"), F.lit(True).alias("supports"), moment(at).alias("created_at")
    )
    labels = F.filter(F.coalesce("connections", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    return found.select(
        F.md5(key).alias("id"), F.col("_claim").alias("statement"), F.col("_c").alias("confidence"), F.array(snippet.cast(EVIDENCE)).alias("evidence"), F.array_distinct(labels).alias("connections"),
        "source", F.coalesce("tier", F.lit("general")).alias("tier"), "scope", moment(at).alias("created_at"), moment(at).alias("updated_at"), moment(at).alias("confidence_at"),
        F.array(revision(moment(at), "created", F.col("_c"), F.lit(None).cast("string"))).alias("history"), F.lit(None).cast("string").alias("superseded_by"), F.col(id_col).alias("_doc"), F.col("_pos"),
    )


def ingest(registry: DataFrame, requests: DataFrame, at: dt.datetime | str, id_col: str = "request_id", across_owners: bool = False) -> DataFrame:
    """The registry after the texts were read: repeats fold into the belief that is stored, or came first, under their key.

    Beliefs of different tiers or scopes are kept apart unless ``across_owners``; then the later one also moves the belief.
    A request that is sent again adds nothing for the claims it made before. Of the registry only the rows whose key the
    texts touch are moved; all others pass as they are."""
    keys = ["norm_key"] if across_owners else ["norm_key", "_tier", "_scope"]
    keyed = lambda df: df.withColumn("norm_key", text.normalise(F.col("statement"))).withColumn("_tier", F.col("tier")).withColumn("_scope", F.coalesce("scope", F.lit("")))
    fresh = materialize(keyed(extract(requests, at, id_col).withColumn("_doc", F.col("_doc").cast("bigint")).dropDuplicates(["id"])), "claims")
    stored = keyed(registry.withColumn("_doc", F.lit(-1).cast("bigint")).withColumn("_pos", F.lit(-1)))
    fresh = fresh.join(registry.select("id"), "id", "left_anti").select(*stored.columns)
    touched = fresh.select(*keys).distinct()
    untouched = stored.join(touched, keys, "left_anti")
    mine = stored.join(touched, keys, "left_semi")
    # a claim whose own evidence a belief holds already was folded into it before
    held = mine.select(F.explode("evidence").alias("_e")).select(F.col("_e.id").alias("_eid"))
    fresh = fresh.withColumn("_eid", F.col("evidence")[0]["id"]).join(held, "_eid", "left_anti").select(*stored.columns)
    group = materialize(mine.unionByName(fresh), "touched")
    folded = merge_fold(group, keys, ["_doc", "_pos"])
    alone, many = folded.where("merged = 1").select("id"), folded.where("merged > 1")
    cols = registry.columns
    base = group.drop("confidence", "evidence", "connections")
    merged = record(many.join(base, [*keys, "id"]), F.lit(True), "merged", F.lit(None).cast("string"), at)
    if across_owners:
        last = group.groupBy(*keys).agg(F.max_by(F.struct("tier", "scope"), F.struct("_doc", "_pos", "id")).alias("_owner"))
        merged = merged.join(last, keys).withColumn("tier", F.col("_owner.tier")).withColumn("scope", F.col("_owner.scope"))
    return untouched.select(*cols).unionByName(group.join(alone, "id", "left_semi").select(*cols)).unionByName(merged.select(*cols))


def remember(beliefs: DataFrame, tier: str, scope: str | None) -> DataFrame:
    return beliefs.withColumn("tier", F.lit(tier)).withColumn("scope", F.lit(scope).cast("string"))


def view(tier: str | None = None, scope: str | None = None) -> Column:
    """Predicate of one slice of memory; None puts no bound on it."""
    out = F.lit(True)
    if tier is not None:
        out = out & (F.col("tier") == tier)
    return out if scope is None else out & F.col("scope").eqNullSafe(scope)


def forget(beliefs: DataFrame, tier: str, scope: str | None = None) -> DataFrame:
    """Without the rows of a tier (and scope), retired ones included."""
    return beliefs.where(~F.coalesce(view(tier, scope), F.lit(False)))


def decay(beliefs: DataFrame, as_of: dt.datetime | str, half_life: float = HALF_LIFE_DAYS, tier: str | None = None, scope: str | None = None, floor: float = DECAY_FLOOR) -> DataFrame:
    """Fade what was not verified for a while; live rows of the slice only. Adds ``decayed``, whether the row moved."""
    faded = numeric.decayed(F.col("confidence"), numeric.days_between(moment(as_of), F.col("confidence_at")), half_life, floor)
    moved = F.col("superseded_by").isNull() & F.coalesce(view(tier, scope), F.lit(False)) & (faded < F.col("confidence"))
    out = beliefs.withColumn("decayed", F.coalesce(moved, F.lit(False))).withColumn("confidence", F.when(F.col("decayed"), faded).otherwise(F.col("confidence")))
    return record(out, F.col("decayed"), "decayed", F.lit(None).cast("string"), as_of)


def prune(beliefs: DataFrame, threshold: float = DEAD_BELOW) -> DataFrame:
    """Without the dead; retired beliefs are spared."""
    return beliefs.where(~((F.col("confidence") <= threshold) & F.col("superseded_by").isNull()))
