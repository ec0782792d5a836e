"""Numbers: confidence shifts and decay, set overlap, feature hashing, dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenetry.schema import CLAMP, CONTRADICTION_AT, DECAY_FLOOR, DIMENSIONS, HALF_LIFE_DAYS, STRENGTH_CAP


def shift(confidence: Column, strength: Column, supports: Column) -> Column:
    """Confidence after one piece of evidence, moved in log-odds and rounded to 6 places."""
    p = F.least(F.greatest(confidence, F.lit(CLAMP)), F.lit(1 - CLAMP))
    nudge = -F.log(1 - F.least(strength, F.lit(STRENGTH_CAP)))
    logit = F.log(p / (1 - p)) + F.when(supports, nudge).otherwise(-nudge)
    return F.round(1 / (1 + F.exp(-logit)), 6)


def clamp(value: Column) -> Column:
    return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 6)


def days_between(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def decayed(confidence: Column, days: Column, half_life: float = HALF_LIFE_DAYS, floor: float = DECAY_FLOOR) -> Column:
    """Confidence after ``days`` without verification; never below the floor, never above what it was."""
    if half_life <= 0:
        raise ValueError("the half-life must be positive")
    faded = F.greatest(F.round(confidence * F.pow(F.lit(0.5), days / half_life), 6), F.lit(floor))
    return F.when((days > 0) & (faded < confidence), faded).otherwise(confidence)


def jaccard(a: Column, b: Column) -> Column:
    """Common elements over all elements of two arrays without repeats; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


def clash_score(a: Column, b: Column, threshold: float = CONTRADICTION_AT) -> Column:
    """Overlap of two content sets rounded to 6 places where it reaches the threshold, else 0."""
    near = F.least(F.size(a), F.size(b)) >= threshold * F.greatest(F.size(a), F.size(b))
    return F.when(near & (jaccard(a, b) >= threshold), F.round(jaccard(a, b), 6)).otherwise(0.0)


def slot(feature: Column, dimensions: int = DIMENSIONS) -> Column:
    """FNV-1a of an ASCII feature modulo a power of two, which only the low bits of every step decide."""
    codes = F.transform(F.split(feature, ""), F.ascii)
    start, prime = 0xCBF29CE484222325 % dimensions, 0x100000001B3 % dimensions
    return F.aggregate(codes, F.lit(start), lambda h, c: (h.bitwiseXOR(c) * prime) % dimensions)


def sign(feature: Column) -> Column:
    return F.when(slot(F.concat(feature, F.lit("#"))) % 2 == 1, 1.0).otherwise(-1.0)


def dashed_uuid(hex32: Column) -> Column:
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *(F.substring(hex32, a, n) for a, n in cut))
