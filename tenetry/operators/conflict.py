"""Contradictions between beliefs: detection by polarity and shared content, and their resolution."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenetry.functions import numeric, text
from tenetry.operators import retrieval
from tenetry.schema import CONTRADICTION_AT, DECISIVE_AT, NLI_GATE, NLI_NEIGHBOURS
from tenetry.session import materialize


#: Bits of the sketch of a set of words.
_BITS = 64


def _sets(beliefs: DataFrame) -> DataFrame:
    """Live beliefs (id, negated, words, sketch): their content, and its words' parities by hash, in which two sets differ
    in no more bits than they do in words."""
    live = beliefs.where("superseded_by is null").select("id", text.polarity(F.col("statement")).alias("negated"), text.content(F.col("statement")).alias("words"))
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(w), F.lit(_BITS)).cast("int"))
    sketch = F.aggregate("words", F.lit(0).cast("bigint"), lambda s, w: s.bitwiseXOR(bit(w)))
    return live.where("size(words) > 0").withColumn("sketch", sketch)


def contradictions(beliefs: DataFrame, threshold: float = CONTRADICTION_AT) -> DataFrame:
    """Rows (affirmed, negated, overlap): live beliefs of opposite polarity whose content overlaps by the threshold or more.

    Two sets that near share one of each one's n - ceil(threshold * n) + 1 rarest words, so only those are joined on:
    template words that every row holds never meet. Pairs that meet are held against each other's sketch within the join,
    and the few that are left are compared word by word. For the strongest first, sort by :func:`strongest`."""
    sets = materialize(_sets(beliefs), "content")
    df = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = sets.select("id", "negated", "sketch", F.size("words").alias("n"), F.explode("words").alias("w")).join(df, "w")
    packed = ranked.groupBy("id", "negated", "n", "sketch").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("ws"))
    prefix = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    keyed = packed.select("id", "negated", "n", "sketch", F.explode(F.transform(F.slice("ws", F.lit(1), prefix), lambda x: F.xxhash64(x["w"]))).alias("w"))
    side = lambda p, name: keyed.where(F.col("negated") == p).select(F.col("id").alias(name), "w", F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    size = F.least("n_affirmed", "n_negated") >= threshold * F.greatest("n_affirmed", "n_negated")
    # words that only one of them has are at most (1 - threshold) / (1 + threshold) of all they have, counted apart
    differ = F.bit_count(F.col("s_affirmed").bitwiseXOR(F.col("s_negated"))) * (1 + threshold) <= (F.col("n_affirmed") + F.col("n_negated")) * (1 - threshold) + 1e-9
    pairs = side(0, "affirmed").join(side(1, "negated"), "w").where(size & differ).select("affirmed", "negated").distinct()
    words = lambda name: sets.select(F.col("id").alias(name), F.col("words").alias(f"w_{name}"))
    scored = pairs.join(words("affirmed"), "affirmed").join(words("negated"), "negated")
    return scored.withColumn("overlap", numeric.clash_score(F.col("w_affirmed"), F.col("w_negated"), threshold)).where("overlap > 0").select("affirmed", "negated", "overlap")


def strongest(clashes: DataFrame) -> list[Column]:
    """The order in which clashes are listed and settled: largest overlap first, then by ids."""
    return [F.desc("overlap"), F.asc("affirmed"), F.asc("negated")]


def weights(beliefs: DataFrame) -> DataFrame:
    """Rows (id, confidence, support, weight) by which a clash is judged."""
    total = lambda on: F.aggregate(F.filter("evidence", lambda e: e["supports"] == on), F.lit(0.0), lambda s, e: s + e["strength"])
    return beliefs.select("id", "confidence", total(True).alias("support"), total(False).alias("against")).withColumn("weight", F.col("confidence") * (1 + F.col("support") - F.col("against")))


def judged(clashes: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Clashes with winner and loser by weight (a tie goes to the affirmed side) and the margin."""
    w = weights(beliefs).select("id", "weight")
    side = lambda name: w.select(F.col("id").alias(name), F.col("weight").alias(f"w_{name}"))
    both = clashes.join(side("affirmed"), "affirmed").join(side("negated"), "negated")
    first = F.col("w_affirmed") >= F.col("w_negated")
    margin = F.round(F.abs(F.col("w_affirmed") - F.col("w_negated")), 6)
    return both.select("affirmed", "negated", "overlap", F.when(first, F.col("affirmed")).otherwise(F.col("negated")).alias("winner"), F.when(first, F.col("negated")).otherwise(F.col("affirmed")).alias("loser"), margin.alias("margin"))


def _components(clashes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Rows (id, part): the connected parts of the clash graph, by least labels that follow their own label."""
    links = materialize(clashes.select(F.col("affirmed").alias("a"), F.col("negated").alias("b")).unionByName(clashes.select(F.col("negated").alias("a"), F.col("affirmed").alias("b"))), "clash-links")
    label = links.select(F.col("a").alias("id")).distinct().withColumn("part", F.col("id"))
    for _ in range(max_rounds):
        near = links.join(label.select(F.col("id").alias("b"), "part"), "b").groupBy(F.col("a").alias("id")).agg(F.min("part").alias("near"))
        via = label.join(near, "id").select("id", F.col("part").alias("old"), F.least("part", "near").alias("via"))
        jump = via.join(label.select(F.col("id").alias("via"), F.col("part").alias("next")), "via", "left")
        new = materialize(jump.select("id", "old", F.least("via", F.coalesce("next", "via")).alias("part")), "clash-parts")
        label = new.select("id", "part")
        if new.where("old <> part").isEmpty():
            return label
    raise RuntimeError(f"the clash graph has not settled in {max_rounds} rounds")


def _settle(threshold_decisive: float, force: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Work through the clashes of one part, strongest overlap first; each sees the confidences the earlier ones left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["overlap", "affirmed", "negated"], ascending=[False, True, True])
        conf: dict[str, float] = {}
        facts: dict[str, tuple[float, float]] = {}
        for side in ("affirmed", "negated"):
            for i, c, s, a in zip(pdf[side], pdf[f"c_{side}"], pdf[f"s_{side}"], pdf[f"a_{side}"]):
                conf[i], facts[i] = c, (s, a)
        retired: set[str] = set()
        out = []
        weigh = lambda i: conf[i] * (1 + facts[i][0] - facts[i][1])
        for a, b, overlap in zip(pdf["affirmed"], pdf["negated"], pdf["overlap"]):
            if a in retired or b in retired:
                continue
            win, lose = (a, b) if weigh(a) >= weigh(b) else (b, a)
            margin = weigh(win) - weigh(lose)
            if margin <= 0:
                continue
            if margin >= threshold_decisive and facts[win][0] > facts[lose][0]:
                retired.add(lose)
            else:
                conf[lose] = round(min(max(conf[lose] * (1 - force * overlap), 0.0), 1.0), 6)
            out.append((win, lose, lose in retired, round(margin, 6), conf[lose]))
        return pd.DataFrame(out, columns=["winner", "loser", "retired", "margin", "confidence"])

    return run


def reconcile(beliefs: DataFrame, threshold: float = CONTRADICTION_AT, force: float = 0.5, decisive: float = DECISIVE_AT, detector: str | Detector = "lexical") -> DataFrame:
    """Rows (winner, loser, retired, margin, confidence): what is done about each clash.

    A clear margin with more supporting evidence retires the loser; a smaller one weakens it; a dead heat is left alone.
    Parts of the clash graph do not touch each other and are settled side by side. Within a part each clash sees what the
    one before it left, so a part is one task's work by definition; it holds a row of ten values per clash."""
    clashes = materialize(get_detector(detector)(beliefs, threshold), "clashes")
    part = _components(clashes)
    # the registry is joined once, for the beliefs that clash
    w = weights(beliefs).join(clashes.select(F.explode(F.array("affirmed", "negated")).alias("id")).distinct(), "id", "left_semi")
    w = materialize(w, "clash-weights")
    side = lambda n: w.select(F.col("id").alias(n), F.col("confidence").alias(f"c_{n}"), F.col("support").alias(f"s_{n}"), F.col("against").alias(f"a_{n}"))
    full = clashes.join(side("affirmed"), "affirmed").join(side("negated"), "negated").join(part.withColumnRenamed("id", "affirmed"), "affirmed")
    return full.groupBy("part").applyInPandas(_settle(decisive, force), "winner string, loser string, retired boolean, margin double, confidence double")


def apply_resolutions(beliefs: DataFrame, done: DataFrame) -> DataFrame:
    """The registry after :func:`reconcile`: last confidence of each loser, and who replaced the retired ones."""
    last = done.groupBy("loser").agg(F.min("confidence").alias("_c"), F.max(F.when(F.col("retired"), F.col("winner"))).alias("_by"))
    out = beliefs.join(last, beliefs["id"] == last["loser"], "left")
    return out.withColumn("confidence", F.coalesce("_c", "confidence")).withColumn("superseded_by", F.coalesce("_by", "superseded_by")).drop("loser", "_c", "_by")


def scored_contradictions(beliefs: DataFrame, candidates: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, gate: float = NLI_GATE) -> DataFrame:
    """Clashes found by a pluggable pair scorer: candidate pairs (a, b) whose content overlaps by ``gate`` are scored, both ways.

    ``score`` maps rows (a, b, premise, hypothesis) to the same with ``p``; the larger of both directions counts."""
    about = lambda n: beliefs.select(F.col("id").alias(n), F.col("statement").alias(f"t_{n}"), text.content(F.col("statement")).alias(f"w_{n}"))
    pairs = candidates.where("a < b").join(about("a"), "a").join(about("b"), "b").where(numeric.jaccard(F.col("w_a"), F.col("w_b")) >= gate)
    ways = pairs.select("a", "b", F.col("t_a").alias("premise"), F.col("t_b").alias("hypothesis")).unionByName(pairs.select("a", "b", F.col("t_b").alias("premise"), F.col("t_a").alias("hypothesis")))
    return score(ways).groupBy("a", "b").agg(F.max("p").alias("p")).where(F.col("p") >= threshold)


#: (beliefs, threshold) -> rows (affirmed, negated, overlap).
Detector = Callable[[DataFrame, float], DataFrame]
DETECTORS: dict[str, Detector] = {"lexical": contradictions}


def by_scores(score: Callable[[DataFrame], DataFrame], neighbours: int = NLI_NEIGHBOURS, gate: float = NLI_GATE, embedder: retrieval.Embedder = retrieval.embed) -> Detector:
    """A detector from a pair scorer: candidates are each belief's nearest neighbours, gated by shared content, scored both ways.

    Of a clash the belief of smaller id counts as the affirmed side, unless the polarity of just one of them says otherwise."""

    def run(beliefs: DataFrame, threshold: float = CONTRADICTION_AT) -> DataFrame:
        live = beliefs.where("superseded_by is null")
        found = scored_contradictions(live, retrieval.neighbour_pairs(live, neighbours, embedder=embedder), score, threshold, gate)
        sign = live.select("id", text.polarity(F.col("statement")).alias("neg"))
        both = found.join(sign.withColumnsRenamed({"id": "a", "neg": "na"}), "a").join(sign.withColumnsRenamed({"id": "b", "neg": "nb"}), "b")
        turned = (F.col("na") == 1) & (F.col("nb") == 0)
        return both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("affirmed"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("negated"), F.round("p", 6).alias("overlap"))

    return run


def get_detector(detector: str | Detector) -> Detector:
    """A detector by name, or any function of that form as it is."""
    if callable(detector):
        return detector
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector!r}; choose from {sorted(DETECTORS)}, or pass a function, such as by_scores makes")
    return DETECTORS[detector]
