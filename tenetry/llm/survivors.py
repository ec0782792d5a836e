"""Best representative of each duplicate group: a skyline over completeness, recency and trust.

Completeness is how many of the fields a member can supply, trust the rank of its source, recency its time (then its id).
The members of a group that no other dominates in all three are its first layer; what is left has a first layer of its
own, and so on. The layers are peeled off one by one. Each gives every field its best member by the field's lexicographic
policy, which fills a field that the layers before could not supply, or betters what they gave.

Before members meet, those that can supply the same fields and have the same trust are reduced to the most recent one and
the one with most evidence, which is a map-side aggregation and leaves at most 256 candidates (8 ranks of trust, 4 yes-or-no fields, 2 each), however large the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenetry.llm.copies import MAX_BITS, split_repeats
from tenetry.llm.words import canonical_hashes, let
from tenetry.session import materialize

#: Sources from the most to the least trusted; null and blank count as unknown, others come last.
TRUST = ("official_docs", "research_paper", "book", "code", "unknown", "web", "conversation")
FIELDS = ("updated_at", "source", "evidence", "confidence", "scope")


def trust_rank(source: Column) -> Column:
    """0 for the most trusted source; case and outer blanks do not count."""
    s = F.lower(F.regexp_replace(F.coalesce(source, F.lit("unknown")), r"(?U)^\s+|\s+$", ""))
    rank = F.lit(len(TRUST))
    for i, name in enumerate(TRUST):
        rank = F.when(s.isin(name, "") if name == "unknown" else s == name, i).otherwise(rank)
    return rank


def _recency() -> Column:
    """Orders later rows first, then smaller ids; rows without a time come last."""
    return F.struct(F.col("updated_at").isNull().alias("untimed"), (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("neg"), F.col("id").alias("id"))


def _dominates(q: Column, r: Column) -> Column:
    """As complete, as trusted and as recent, and not the same; recency, which ends in the id, has no other ties."""
    return (q["filled"] >= r["filled"]) & (q["trust"] <= r["trust"]) & (q["rec"] <= r["rec"]) & (q != r)


def _front(items: Column) -> Column:
    return F.filter(items, lambda r: ~F.exists(items, lambda q: _dominates(q, r)))


#: For each field, which members can supply it and what the smallest of makes the best one, before recency.
_POLICY = {
    "updated_at": (lambda r: ~r["rec"]["untimed"], lambda r: F.lit(0)),
    "source": (lambda r: r["n"] >= 0, lambda r: r["trust"]),
    "evidence": (lambda r: r["n"] >= 0, lambda r: -r["n"]),
    "confidence": (lambda r: r["conf"] == 1, lambda r: F.lit(0)),
    "scope": (lambda r: r["scope"] == 1, lambda r: F.lit(0)),
}


def _best(field: str, layer: Column) -> Column:
    """The best supplier of a field within a layer as (merit, rec, depth); null where none can supply it."""
    fits, merit = _POLICY[field]
    return F.array_min(F.transform(F.filter(layer, fits), lambda r: F.struct(merit(r).cast("int").alias("merit"), r["rec"].alias("rec"))))


def _peeled(members: Column) -> Column:
    """Each field's supplier (merit, rec, depth) after all layers were peeled off an array of members."""
    none = F.lit(None).cast("struct<merit:int,rec:struct<untimed:boolean,neg:bigint,id:string>,depth:int>")
    start = F.struct(members.alias("rest"), F.lit(0).alias("depth"), *(none.alias(f) for f in FIELDS))

    def peel(state: Column, _: Column) -> Column:
        def fill(front: Column) -> Column:
            picks = []
            for f in FIELDS:
                deeper = lambda best, f=f: F.when(best.isNotNull(), F.struct(best["merit"].alias("merit"), best["rec"].alias("rec"), state["depth"].alias("depth")))
                # least passes over nulls: a field without a supplier takes the layer's, one with a supplier keeps the better
                picks.append(F.least(state[f], let(_best(f, front), deeper)).alias(f))
            return F.struct(F.array_except(state["rest"], front).alias("rest"), (state["depth"] + 1).alias("depth"), *picks)

        # a layer has a member at least, so there are no more of them than members; mostly there are few
        return F.when(F.size(state["rest"]) > 0, let(_front(state["rest"]), fill)).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.size(members)), start, peel)


def settled(beliefs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (group_id, to): for each field of ``to`` its supplier, as (merit, rec, depth) with the depth of its layer."""
    h1, h2 = canonical_hashes(F.col("statement"))
    rows = beliefs.select(
        F.col("id"), F.col("updated_at"), h1.alias("_h1"), h2.alias("_h2"),
        F.coalesce(F.when(F.col("evidence").isNotNull(), F.size("evidence")), F.lit(0)).alias("n"),
        trust_rank(F.col("source")).alias("trust"),
        F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False)).cast("int").alias("conf"),
        F.coalesce(F.col("scope").rlike(r"(?U)\S"), F.lit(False)).cast("int").alias("scope"),
    )
    filled = (F.col("n") > 0).cast("int") + F.col("conf") + F.col("scope") + F.col("updated_at").isNotNull().cast("int")
    rows = rows.withColumn("filled", filled)
    _, maybe = split_repeats(rows, beliefs.count(), max_bits)
    member = F.struct("filled", "n", "trust", "conf", "scope", _recency().alias("rec"))
    kinds = maybe.withColumn("timed", F.col("updated_at").isNotNull()).withColumn("some", F.col("n") > 0)
    kinds = kinds.groupBy("_h1", "_h2", "trust", "conf", "scope", "some", "timed").agg(
        F.min_by(member, _recency()).alias("latest"), F.min_by(member, F.struct(-F.col("n"), _recency())).alias("richest"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    groups = (
        kinds.groupBy("_h1", "_h2")
        .agg(F.min("least").alias("group_id"), F.sum("copies").alias("copies"), F.array_distinct(F.flatten(F.collect_list(F.array("latest", "richest")))).alias("members"))
        .where("copies > 1")
    )
    return groups.select("group_id", _peeled(F.col("members")).alias("to"))


def suppliers(beliefs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (group_id, field, id): which member of each group of two or more supplies each field.

    Groups are those of :func:`tenetry.llm.copies.collapse`. Ties go to the later ``updated_at``, then the smaller id;
    a null ``updated_at`` is earlier than any. A field no member can supply gives no row: ``confidence`` needs one from
    0 to 1, ``scope`` one that is not blank, ``updated_at`` one that is not null. Null evidence is no evidence. Rows with
    null or wordless statements are in no group. Extra columns are not read; an empty table gives no rows."""
    picks = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"to.{f}.rec.id").alias("id")) for f in FIELDS))
    return settled(beliefs, max_bits).select("group_id", F.inline(picks)).where("id is not null")


def survivors(beliefs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One surviving record per group: ``group_id`` and the five fields, each with the value of its supplier."""
    chosen = materialize(suppliers(beliefs, max_bits), "suppliers")
    # only rows that supply something are moved; of rows that repeat an id one is taken
    values = beliefs.join(chosen.select("id").distinct(), "id", "left_semi").select("id", *FIELDS).dropDuplicates(["id"])
    joined = chosen.join(values, "id")
    return joined.groupBy("group_id").agg(*(F.max_by(f, F.when(F.col("field") == f, 1)).alias(f) for f in FIELDS))
