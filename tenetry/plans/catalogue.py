"""Every query by name, with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenetry.functions import numeric, text
from tenetry.operators import conflict, graph, lifecycle, retrieval, selection
from tenetry.plans import oracle
from tenetry.schema import conform
from tenetry.session import scalar, shared_dir, table
from tenetry.sources import registry
from tenetry.streaming import change_capture

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
NOW = "2026-01-01 00:00:00"


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def beliefs(spark: SparkSession, d: str) -> DataFrame:
    return conform(table(spark, d, "beliefs"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_requests").select("query_id", "query", "budget", "tier", "scope")


@query
def p4_found(spark, d):
    """The runs of index_runs played one after another over a capture in the shared folder."""
    kept = f"{shared_dir(spark)}/capture-{uuid.uuid4().hex}"
    return change_capture.changed(table(spark, d, "registry_saves"), table(spark, d, "index_runs"), kept).select("run_id", "id")


# text


@query
def tokenise_stem(spark, d):
    toks = beliefs(spark, d).select("id", F.posexplode(text.tokens(F.col("statement"))).alias("pos", "token"))
    return toks.select("id", "pos", "token", text.stem(F.col("token")).alias("stem"))


@query
def token_cost(spark, d):
    return beliefs(spark, d).select("id", text.token_cost(F.col("statement")).alias("cost"))


@query
def normalise_dedupe(spark, d):
    keyed = beliefs(spark, d).select("id", text.normalise(F.col("statement")).alias("norm_key"))
    return keyed.groupBy("norm_key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))


@query
def polarity_content(spark, d):
    c = text.content(F.col("statement"))
    return beliefs(spark, d).select("id", text.polarity(F.col("statement")).alias("polarity"), F.array_join(F.array_sort(c), " ").alias("content"))


@query
def split_blocks(spark, d):
    return table(spark, d, "ingest_requests").where("text is not null").select("request_id", F.posexplode(text.blocks(F.col("text"))).alias("pos", "block"))


@query
def split_sentences(spark, d):
    return table(spark, d, "ingest_requests").where("text is not null").select("request_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


@query
def extract_claims(spark, d):
    return table(spark, d, "ingest_requests").where("text is not null").select("request_id", F.posexplode(text.claims(F.col("text"))).alias("pos", "claim"))


@query
def split_claims(spark, d):
    return beliefs(spark, d).select("id", F.posexplode(text.split_claims(F.col("statement"))).alias("pos", "part"))


@query
def vocabulary_grounding(spark, d):
    """Each statement against each of its snippets."""
    pairs = beliefs(spark, d).select("id", "statement", F.explode("evidence").alias("e")).where("e.snippet is not null")
    share = text.grounded_share(F.col("statement"), F.col("e.snippet"))
    return pairs.select("id", F.col("e.id").alias("evidence_id"), F.round(share, 6).alias("share"), (share >= 0.75).alias("grounded"))


@query
def passage_window(spark, d):
    """For every claim of a text the passage of the text that bears on it."""
    found = table(spark, d, "ingest_requests").where("text is not null").select("request_id", "text", F.posexplode(text.claims(F.col("text"))).alias("pos", "claim"))
    return found.select("request_id", "pos", text.passage_for(F.col("claim"), F.col("text")).alias("passage"))


# registry


@query
def registry_scan(spark, d):
    return registry.scan(beliefs(spark, d), min_confidence=0.5).select("id", "confidence")


@query
def registry_top(spark, d):
    return registry.scan(beliefs(spark, d), tier="project", limit=50).select("id", "confidence")


@query
def registry_search(spark, d):
    return registry.search(beliefs(spark, d), "LEDGER", 50).select("id", "confidence")


@query
def registry_counts(spark, d):
    return registry.counts(beliefs(spark, d))


@query
def fingerprint_diff(spark, d):
    """What an index built on what had arrived by one day must do about what had arrived a year later."""
    saves = table(spark, d, "registry_saves")
    at = lambda day: saves.where(F.col("arrived_at") <= F.lit(day).cast("timestamp_ntz")).groupBy("id").agg(F.max("updated_at").alias("updated_at"), F.max_by("superseded_by", F.struct("updated_at", "save_id")).alias("superseded_by"))
    return registry.difference(registry.fingerprints(at("2024-07-01")), registry.fingerprints(at("2025-07-01")))


@query
def prune_dead(spark, d):
    return lifecycle.prune(beliefs(spark, d), 0.1).select("id", "confidence")


@query
def forget_tier(spark, d):
    return lifecycle.forget(beliefs(spark, d), "project", "proj-halyard").select("id")


@query
def recall_scope(spark, d):
    return registry.scan(beliefs(spark, d), scope="proj-halyard").select("id", "tier", "confidence")


# lifecycle


@query
def evidence_shift(spark, d):
    """Confidence each belief would have from its source's prior and its evidence alone, in order."""
    from tenetry.schema import prior

    b = beliefs(spark, d)
    ev = F.filter("evidence", lambda e: e["strength"].isNotNull() & e["supports"].isNotNull())
    return b.select("id", lifecycle.folded_confidence(prior(F.col("source")), ev).alias("confidence"))


@query
def add_evidence(spark, d):
    b = beliefs(spark, d)
    ev = b.where("superseded_by is not null").select(F.col("superseded_by").alias("belief_id"), F.posexplode("evidence").alias("pos", "e"), F.col("id").alias("src"))
    rows = ev.select("belief_id", F.struct("src", "pos").alias("seq"), "e.*")
    out = lifecycle.add_evidence(b, rows, NOW)
    return out.select("id", "confidence", F.size("evidence").alias("n_evidence"), F.size("history").alias("n_history"))


@query
def merge_fold(spark, d):
    b = beliefs(spark, d).withColumn("norm_key", text.normalise(F.col("statement")))
    out = lifecycle.merge_fold(b, ["norm_key"], ["created_at"])
    return out.select("norm_key", "id", "merged", F.round("confidence", 6).alias("confidence"), F.size("evidence").alias("n_evidence"), F.array_join("connections", "|").alias("labels"))


@query
def supersede(spark, d):
    b = beliefs(spark, d)
    pairs = b.groupBy(text.normalise(F.col("statement")).alias("k")).agg(F.min("id").alias("old_id"), F.max("id").alias("new_id")).select("old_id", "new_id")
    return lifecycle.supersede(b, pairs, NOW).select("id", "superseded_by", F.size("history").alias("n_history"))


@query
def timeline(spark, d):
    return lifecycle.timeline(beliefs(spark, d))


@query
def last_verified(spark, d):
    return beliefs(spark, d).select("id", lifecycle.last_verified(F.col("history"), F.col("created_at")).alias("last_verified"))


@query
def split_registry(spark, d):
    return lifecycle.split_all(beliefs(spark, d), NOW).select("id", "statement", "confidence", F.size("history").alias("n_history"))


@query
def decay(spark, d):
    return lifecycle.decay(beliefs(spark, d), NOW).select("id", "confidence", "decayed")


@query
def extract_beliefs(spark, d):
    out = lifecycle.extract(table(spark, d, "ingest_requests"), NOW)
    return out.select("id", "statement", "confidence", "source", "tier", "scope", F.size("connections").alias("n_connections"))


@query
def ingest(spark, d):
    out = lifecycle.ingest(beliefs(spark, d), table(spark, d, "ingest_requests"), NOW)
    return out.select("id", "statement", F.round("confidence", 6).alias("confidence"), F.size("evidence").alias("n_evidence"), F.size("connections").alias("n_connections"))


@query
def maintain(spark, d):
    """Decay, reconcile, prune: the registry that is left."""
    from tenetry.plans.engine import maintained

    return maintained(beliefs(spark, d), NOW).select("id", "confidence", "superseded_by")


# retrieval


@query
def idf(spark, d):
    return retrieval.idf(retrieval.documents(beliefs(spark, d))).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def postings(spark, d):
    return retrieval.postings(retrieval.documents(beliefs(spark, d)))


@query
def tfidf_topk(spark, d):
    return retrieval.retrieve(beliefs(spark, d), asked(spark, d))


@query
def scoped_topk(spark, d):
    return retrieval.retrieve(beliefs(spark, d), asked(spark, d), within=True)


@query
def check_claims(spark, d):
    """Every query checked as a claim."""
    claims = asked(spark, d).where("query is not null").select(F.col("query_id").alias("claim_id"), F.col("query").alias("claim"))
    return retrieval.check(beliefs(spark, d), claims).drop("claim")


@query
def ground_report(spark, d):
    """Every text that was sent in, grounded sentence by sentence."""
    answers = table(spark, d, "ingest_requests").select(F.col("request_id").alias("answer_id"), "text")
    return retrieval.ground(beliefs(spark, d), answers)


@query
def justify(spark, d):
    return retrieval.justify(beliefs(spark, d)).drop("where")


@query
def hash_embed(spark, d):
    return retrieval.embed(asked(spark, d).where("query is not null"), "query_id", F.col("query")).select("query_id", "dim", F.round("weight", 6).alias("weight"))


@query
def vector_topk(spark, d):
    return retrieval.vector_retrieve(beliefs(spark, d), asked(spark, d)).select("query_id", "id", "similarity", "score")


@query
def scoped_vector_topk(spark, d):
    return retrieval.by_vectors()(beliefs(spark, d), asked(spark, d), 5, True)


@query
def knn_pairs(spark, d):
    """Candidate pairs by ten nearest neighbours: each belief whose number is divisible by 20 against all."""
    return retrieval.neighbour_pairs(beliefs(spark, d), asked=F.conv(F.right("id", F.lit(8)), 16, 10).cast("bigint") % 20 == 0)


@query
def dense_cosine_topk(spark, d):
    """Each twentieth vector against all."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense_search(v, v.where("id % 20 = 0")).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


@query
def index_refresh(spark, d):
    """Postings of an older state of the registry brought up to date; the same as built anew."""
    b = beliefs(spark, d)
    old = b.where(F.col("created_at") <= F.lit("2025-01-01").cast("timestamp_ntz")).withColumn("updated_at", F.col("created_at"))
    change = registry.difference(registry.fingerprints(old), registry.fingerprints(b))
    return retrieval.refreshed(retrieval.postings(retrieval.documents(old)), change, b)


# selection


@query
def pair_jaccard(spark, d):
    return selection.pair_similarities(selection.pools(beliefs(spark, d), asked(spark, d)))


@query
def select_exact(spark, d):
    return selection.select(beliefs(spark, d), asked(spark, d)).select("query_id", "pos", "id", "cost", F.round("energy", 5).alias("energy"))


@query
def select_greedy(spark, d):
    return selection.select(beliefs(spark, d), asked(spark, d), solver="greedy")


@query
def select_annealing(spark, d):
    return selection.select(beliefs(spark, d), asked(spark, d), solver="annealing")


@query
def context(spark, d):
    return selection.context(beliefs(spark, d), asked(spark, d))


# graph


def _starts(spark, d) -> DataFrame:
    """Beliefs that replaced another: the points of interest of the graph queries."""
    return beliefs(spark, d).where("superseded_by is not null").select(F.col("superseded_by").alias("start")).distinct()


@query
def graph_edges(spark, d):
    return graph.edges(beliefs(spark, d))


@query
def graph_concepts(spark, d):
    return graph.concepts(graph.edges(beliefs(spark, d)))


@query
def beliefs_about(spark, d):
    b = beliefs(spark, d)
    return graph.beliefs_about(graph.edges(b), b, "Evidence  Search")


@query
def graph_walk(spark, d):
    return graph.walk(graph.edges(beliefs(spark, d)), _starts(spark, d))


@query
def related(spark, d):
    b = beliefs(spark, d)
    return graph.related(graph.edges(b), b, _starts(spark, d))


@query
def shortest_paths(spark, d):
    return graph.paths(graph.edges(beliefs(spark, d)), _starts(spark, d), sep=" > ")


@query
def graph_size(spark, d):
    return graph.size(graph.edges(beliefs(spark, d)))


@query
def graph_neighbours(spark, d):
    return graph.neighbours(graph.edges(beliefs(spark, d)))


@query
def connect(spark, d):
    """How each belief that replaced others hangs together with the first of them."""
    ends = _starts(spark, d)
    pairs = ends.withColumn("goal", scalar(ends.agg(F.min("start"))))
    return graph.connect(graph.edges(beliefs(spark, d)), pairs).select("start", "goal", F.array_join("path", " > ").alias("path"))


@query
def infer(spark, d):
    b = beliefs(spark, d)
    return graph.infer(graph.edges(b), b, _starts(spark, d))


@query
def propagate(spark, d):
    b = beliefs(spark, d)
    return graph.propagate(graph.edges(b), b, _starts(spark, d).withColumn("delta", F.lit(-0.3)))


# conflict


@query
def contradictions(spark, d):
    return conflict.contradictions(beliefs(spark, d), 0.6)


@query
def contradiction_winners(spark, d):
    b = beliefs(spark, d)
    return conflict.judged(conflict.contradictions(b, 0.6), b)


@query
def order_contradictions(spark, d):
    """Orders said to be finished by one table and not by another: clashes with many near misses."""
    return conflict.contradictions(order_beliefs(spark, d))


def order_beliefs(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.avg((F.col("l_linestatus") == "F").cast("double")) >= 0.5).alias("done"))
    say = lambda done: F.when(done, "is finished.").otherwise("is not finished.")
    a = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat_ws(" ", F.lit("Order"), F.col("o_orderkey").cast("string"), say(F.col("done"))).alias("statement"))
    b = li.select(F.concat(F.lit("l"), "l_orderkey").alias("id"), F.concat_ws(" ", F.lit("Order"), F.col("l_orderkey").cast("string"), say(F.col("done"))).alias("statement"))
    return a.unionByName(b).withColumn("superseded_by", F.lit(None).cast("string"))


@query
def reconcile(spark, d):
    return conflict.reconcile(beliefs(spark, d), 0.6)


# numbers


@query
def decay_curve(spark, d):
    """Orders' ages as ages of a belief of 0.8."""
    days = numeric.days_between(lifecycle.moment(NOW), F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", numeric.decayed(F.lit(0.8), days).alias("confidence"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return tfidf_topk(spark, d)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def sql() -> dict[str, str]:
    return oracle.sql()
