"""Table schemas, fixed values and the cleaned view of a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = "struct<id:string,snippet:string,source:string,locator:string,strength:double,supports:boolean,created_at:timestamp_ntz>"
REVISION = "struct<at:timestamp_ntz,cause:string,confidence:double,note:string>"
BELIEF = (
    f"id string, statement string, confidence double, evidence array<{EVIDENCE}>, connections array<string>, source string, tier string, scope string, "
    f"created_at timestamp_ntz, updated_at timestamp_ntz, confidence_at timestamp_ntz, history array<{REVISION}>, superseded_by string"
)

# Fixed values that results depend on.
HISTORY_LIMIT = 100
DEAD_BELOW = 0.02
CLAMP = 0.001
STRENGTH_CAP = 0.95
SOURCE_PRIOR = {"official_docs": 0.75, "research_paper": 0.7, "book": 0.65, "code": 0.6, "web": 0.45, "conversation": 0.4, "unknown": 0.5}
MIN_WORDS = 4
MIN_CLAIM_WORDS = 3
GROUNDING_AT = 0.75
SUPPORTED_AT = 0.15
COVERAGE_AT = 0.5
DIMENSIONS = 1024
NGRAM = 4
MIN_SIMILARITY = 0.12
CONTRADICTION_AT = 0.75
DAMPING = 0.5
DECISIVE_AT = 0.35
HALF_LIFE_DAYS = 180
DECAY_FLOOR = 0.05
EXHAUSTIVE_LIMIT = 18
NLI_GATE = 0.25
NLI_NEIGHBOURS = 10
STOPWORDS = (
    "a an the is are was were be been being of in on at to for from by with and or but if then than that this these those it its as "
    "can could will would do does did not no nor so such"
).split()
VERBS = (
    "is are was were be been has have had can could will would may might must should does do did gives give provides provide uses use "
    "requires require supports support allows allow needs need holds hold runs run"
).split()
NEGATIONS = (
    "no not never none cannot can't without nor lacks lack lacking isn't doesn't don't didn't won't wasn't aren't hasn't haven't unable fails fail false absent neither"
).split()


def source_kind(source: Column) -> Column:
    """One of the seven source kinds; anything else is unknown."""
    s = F.lower(F.trim(source))
    return F.when(s.isin(*SOURCE_PRIOR), s).otherwise("unknown")


def prior(source: Column) -> Column:
    """How much a claim is trusted for its source alone."""
    out = F.lit(SOURCE_PRIOR["unknown"])
    for name, p in SOURCE_PRIOR.items():
        out = F.when(source == name, F.lit(p)).otherwise(out)
    return out


def conform(beliefs: DataFrame) -> DataFrame:
    """The registry as the model would have it: confidence in [0, 1], defaults for what is missing.

    Rows without a statement are no beliefs and are left out. A missing or impossible confidence is the default 0.5."""
    ok = F.col("confidence").between(0, 1) & ~F.isnan("confidence")
    bare = F.regexp_replace("statement", r"(?U)^\s+|\s+$", "")
    return beliefs.where(bare != "").select(
        "id",
        bare.alias("statement"),
        F.when(ok, F.col("confidence")).otherwise(0.5).alias("confidence"),
        F.coalesce("evidence", F.array().cast(f"array<{EVIDENCE}>")).alias("evidence"),
        F.array_distinct(F.filter(F.coalesce("connections", F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))).alias("connections"),
        source_kind(F.col("source")).alias("source"),
        F.coalesce("tier", F.lit("general")).alias("tier"),
        "scope",
        "created_at",
        "updated_at",
        F.coalesce("confidence_at", "updated_at").alias("confidence_at"),
        F.coalesce("history", F.array().cast(f"array<{REVISION}>")).alias("history"),
        "superseded_by",
    )
