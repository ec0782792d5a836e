"""Lifecycle, registry, graph, conflict and the facade on small registries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tenetry.operators import conflict, graph, lifecycle, retrieval
from tenetry.plans.engine import EchoClient, Engine, Settings, build_client
from tenetry.schema import BELIEF
from tenetry.sources.registry import Registry, open_registry, scan, search, to_database

T = dt.datetime(2025, 1, 1)
LATER = dt.datetime(2025, 7, 1)


def ev(i, strength=0.5, supports=True, snippet="s"):
    return (i, snippet, "web", None, strength, supports, T)


def belief(i, statement, confidence=0.5, evidence=(), labels=(), tier="general", scope=None, retired=None, at=T, history=()):
    return (i, statement, confidence, list(evidence), list(labels), "web", tier, scope, at, at, at, list(history), retired)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), BELIEF)


def test_evidence_is_order_independent(spark):
    up, down = ev("a", 0.9, True), ev("b", 0.3, False)
    df = table(spark, belief("x", "s", evidence=[up, down]), belief("y", "s", evidence=[down, up]))
    x, y = (r[0] for r in df.orderBy("id").select(lifecycle.folded_confidence(F.col("confidence"), F.col("evidence"))).collect())
    assert x == pytest.approx(y, abs=2e-6) and x > 0.5


def test_merge_weights(spark):
    df = table(spark, belief("a", "s", 0.4, [ev("1")], ["x"]), belief("b", "s", 0.7, [ev("2")], ["y"], at=LATER))
    r = lifecycle.merge_fold(df, ["statement"], ["created_at"]).first()
    assert (r["id"], round(r["confidence"], 9), len(r["evidence"]), r["connections"]) == ("a", 0.5, 2, ["x", "y"])


def test_history_is_capped(spark):
    old = [(T, "created", 0.5, None)] * 100
    r = lifecycle.record(table(spark, belief("a", "s", history=old)), F.lit(True), "evidence", F.lit("n"), LATER).first()
    assert len(r["history"]) == 100 and r["history"][-1]["cause"] == "evidence"


def test_decay_in_stages(spark):
    df = table(spark, belief("a", "s", 0.8), belief("r", "s", 0.8, retired="a"))
    once = {r["id"]: r["confidence"] for r in lifecycle.decay(df, T + dt.timedelta(days=360)).collect()}
    for k in range(1, 5):
        df = lifecycle.decay(df, T + dt.timedelta(days=90 * k)).drop("decayed")
    steps = {r["id"]: r["confidence"] for r in df.collect()}
    assert once["a"] == pytest.approx(0.2, abs=1e-6) and steps["a"] == pytest.approx(once["a"], abs=1e-5) and once["r"] == 0.8


def test_registry_round_trip(spark, tmp_path):
    reg = open_registry(spark, str(tmp_path / "reg"))
    assert isinstance(reg, Registry) and reg.rows().count() == 0
    reg.save_all(table(spark, belief("a", "Rust is 100% fast", 0.9), belief("b", "bread_rises", 0.4), belief("c", "dead", 0.01), belief("d", "gone", 0.01, retired="a")), LATER)
    reg.save_all(table(spark, belief("b", "bread rises well", 0.6)), LATER)
    assert [r["id"] for r in scan(reg.rows()).collect()] == ["a", "b", "c"]
    assert reg.get("b").first()["statement"] == "bread rises well"
    assert [r["id"] for r in search(reg.rows(), "100% FAST").collect()] == ["a"] and search(reg.rows(), "_").count() == 0
    reg.prune()
    assert {r["id"] for r in reg.rows().collect()} == {"a", "b", "d"}
    reg.delete(F.col("id") == "b")
    assert reg.rows().count() == 2


def test_registry_in_a_database(spark, tmp_path):
    rows = table(spark, *(belief(f"{i:02x}", f"claim {i}", 0.5, [ev("e", 0.25)] if i % 2 else [], ["x"], retired="00" if i == 3 else None) for i in range(0, 256, 5)))
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    to_database(rows, url, driver="org.apache.derby.jdbc.EmbeddedDriver")
    for parts in (1, 4, 64):
        back = open_registry(spark, url, parts=parts, driver="org.apache.derby.jdbc.EmbeddedDriver")
        assert back.rdd.getNumPartitions() == parts
        assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_ranking(spark):
    df = table(
        spark,
        belief("q", "Qubits hold superpositions.", 0.9, [ev("1", snippet="Bell inequality")]),
        belief("r", "Rust gives memory safety without a garbage collector.", 0.95),
        belief("lo", "same words here", 0.2),
        belief("hi", "same words here", 0.9),
    )
    qs = spark.createDataFrame([(1, "garbage collector memory safety"), (2, "Bell inequality"), (3, "cricket scores in 1998"), (4, "the of and"), (5, "same words"), (6, None)], "query_id long, query string")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.retrieve(df, qs).collect()}
    assert got == {(1, 1): "r", (2, 1): "q", (5, 1): "hi", (5, 2): "lo"}
    vec = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.vector_retrieve(df, qs, limit=1).collect()}
    assert vec[(1, 1)] == "r" and vec[(5, 1)] == "hi" and (4, 1) not in vec


def test_scope_before_limit(spark):
    rows = [belief(f"b{i}", f"coffee note {i}", 0.9, tier="user", scope="bob") for i in range(20)] + [belief("alice", "coffee with milk and sugar and cream", 0.1, tier="user", scope="alice")]
    qs = spark.createDataFrame([(1, "coffee", "user", "alice")], "query_id long, query string, tier string, scope string")
    assert [r["id"] for r in retrieval.retrieve(table(spark, *rows), qs, 3, within=True).collect()] == ["alice"]


def test_graph(spark):
    df = table(spark, belief("q", "qubits", 0.9, labels=["Quantum Computing", "Qubits"]), belief("s", "superposition", 0.8, labels=["qubits!", "Superposition"]), belief("i", "island", 0.95, labels=["Rust"]))
    links = graph.edges(df)
    start = spark.createDataFrame([("q",), ("nobody",)], "start string")
    assert {(r["node"], r["hops"]) for r in graph.walk(links, start, 1).collect()} == {("b:q", 0), ("c:quantum computing", 1), ("c:qubits", 1)}
    best = graph.infer(links, df, start).collect()
    assert [(r["id"], r["hops"], r["strength"], r["chain"]) for r in best] == [("s", 2, 0.72, "b:q > c:qubits > b:s")]
    moved = {r["id"]: r["confidence"] for r in graph.propagate(links, df, spark.createDataFrame([("q", -0.3)], "start string, delta double")).collect()}
    assert moved == {"q": 0.6}  # no shared words with s


def test_reconcile(spark):
    yes, no = "Rust has a garbage collector", "Rust has no garbage collector"
    df = table(spark, belief("y", yes, 0.6), belief("n", no, 0.7, [ev("1", 0.9)]))
    assert [(r["affirmed"], r["negated"]) for r in conflict.contradictions(df).collect()] == [("y", "n")]
    done = conflict.reconcile(df).first()
    assert (done["winner"], done["loser"], done["retired"]) == ("n", "y", True)
    after = {r["id"]: r["superseded_by"] for r in conflict.apply_resolutions(df, conflict.reconcile(df)).collect()}
    assert after == {"y": "n", "n": None}
    assert conflict.reconcile(table(spark, belief("y", yes, 0.7), belief("n", no, 0.7))).count() == 0
    weak = conflict.reconcile(table(spark, belief("y", yes, 0.60), belief("n", no, 0.64))).first()
    assert weak["retired"] is False and weak["confidence"] == 0.3
    with pytest.raises(ValueError):
        conflict.get_detector("none")


def test_pluggable_scorer(spark):
    df = table(spark, belief("a", "the launch was in 1998"), belief("b", "the launch was in 2004"))
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert conflict.scored_contradictions(df, pairs, lambda ways: ways.withColumn("p", F.lit(0.9)), 0.5).count() == 1


def test_facade(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "reg"), client=EchoClient())
    doc = "Qubits can hold a superposition of states. Rust guarantees memory safety without garbage. Bread rises because yeast makes gas."
    reqs = spark.createDataFrame([(1, doc, "research_paper", "doi:10/x", ["Notes"], None, None)], "request_id long, text string, source string, locator string, connections array<string>, tier string, scope string")
    e.ingest(reqs, T)
    assert e.health() == {"beliefs": 3}
    e.ingest(reqs.withColumn("request_id", F.lit(2).cast("long")), LATER)
    rows = e.registry.rows().collect()
    assert len(rows) == 3 and all(len(r["evidence"]) == 2 and abs(r["confidence"] - 0.7) < 1e-9 for r in rows)
    report = e.verify(spark.createDataFrame([(1, "Rust guarantees memory safety. Cheese orbits Jupiter.")], "answer_id long, text string")).first()
    assert (report["claims"], report["supported"], report["score"]) == (2, 1, 0.5)
    answer = e.ask("What guarantees memory safety?")
    assert "Rust" in answer["answer"] and answer["supported"] >= 1
    assert e.maintain(LATER + dt.timedelta(days=400))["decayed"] == 3
    assert e.memory().first()["live"] == 3
    e.forget("general")
    assert e.health() == {"beliefs": 0}
    with pytest.raises(RuntimeError):
        Engine(spark, str(tmp_path / "x")).ask("why?")


REQUESTS = "request_id long, text string, source string, locator string, connections array<string>, tier string, scope string"


def test_requests_sent_again(spark):
    """The same claims add nothing; other claims under the same number are beliefs of their own, and no id occurs twice."""
    send = lambda *texts: spark.createDataFrame([(1, t, "web", None, ["x"], None, None) for t in texts], REQUESTS)
    empty = spark.createDataFrame([], BELIEF)
    first = lifecycle.ingest(empty, send("The keel is new. The mast is old."), T)
    assert first.count() == 2
    both = lifecycle.ingest(empty, send("The keel is new.", "The mast is old."), T).collect()
    assert len({r["id"] for r in both}) == 2 == len(both)
    again = lifecycle.ingest(first, send("The keel is new. The mast is old."), LATER).collect()
    assert sorted(map(str, again)) == sorted(map(str, first.collect()))
    more = lifecycle.ingest(first, send("The keel is dry. The mast is old."), LATER).collect()
    assert len({r["id"] for r in more}) == 3 == len(more)
    # folded into another belief's evidence, and sent again
    stored = table(spark, belief("k", "the keel is new", 0.5, [ev("1")]))
    once = lifecycle.ingest(stored, send("The keel is new."), LATER)
    assert [len(r["evidence"]) for r in once.collect()] == [2]
    assert sorted(map(str, lifecycle.ingest(once, send("The keel is new."), LATER).collect())) == sorted(map(str, once.collect()))


def test_fold_against_a_loop(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(60):
        own = [ev(rng.choice("abcdefgh"), rng.random()) for _ in range(rng.randint(0, 4))]
        own = list({e[0]: e for e in own}.values()) + ([(None, "s", "web", None, 0.5, True, T)] if rng.random() < 0.2 else [])
        rows.append(belief(f"{i:02}", rng.choice(["hot", "hot", "x", "y"]), rng.randrange(101) / 100, own, rng.sample("pqrs", rng.randint(0, 3)), scope=rng.choice([None, "s"]), at=T + dt.timedelta(days=rng.randrange(9))))
    want = {}
    for r in sorted(rows, key=lambda r: (r[8], r[0])):
        key = (r[1], r[7])
        if key not in want:
            want[key] = [r[0], 1, r[2], list(r[3]), set(r[4])]
            continue
        w = want[key]
        w[3] += [e for e in r[3] if e[0] is None or e[0] not in {x[0] for x in w[3]}]
        a, b = max(len(w[3]), 1), max(len(r[3]), 1)
        w[1], w[2], w[4] = w[1] + 1, (w[2] * a + r[2] * b) / (a + b), w[4] | set(r[4])
    got = lifecycle.merge_fold(table(spark, *rows).repartition(5), ["statement", "scope"], ["created_at"]).collect()
    assert {(r["statement"], r["scope"]): (r["id"], r["merged"], round(r["confidence"], 9), [e["id"] for e in r["evidence"]], r["connections"]) for r in got} == {
        k: (w[0], w[1], round(w[2], 9), [e[0] for e in w[3]], sorted(w[4])) for k, w in want.items()
    }


def test_detectors(spark):
    """A scorer of pairs as a detector, from nearest neighbours to what is done about the clashes."""
    df = table(spark, belief("a", "the launch was in 1998", 0.9), belief("b", "the launch was in 2004", 0.5), belief("c", "bread rises because of yeast", 0.5))
    clash = conflict.by_scores(lambda ways: ways.withColumn("p", F.when(F.col("premise").contains("1998"), 0.9).otherwise(0.2)))
    assert [tuple(r) for r in conflict.get_detector(clash)(df, 0.5).collect()] == [("a", "b", 0.9)]
    done = conflict.reconcile(df, 0.5, detector=clash).collect()
    assert [(r["winner"], r["loser"]) for r in done] == [("a", "b")]
    assert conflict.get_detector("lexical") is conflict.contradictions


def test_retrievers_and_kept_vectors(spark, tmp_path):
    from tenetry.operators import selection
    from tenetry.operators.vectors import VectorIndex

    rows = [belief("q", "Qubits hold superpositions.", 0.9, tier="user", scope="s"), belief("r", "Rust gives memory safety.", 0.8), belief("g", "Gardens need rain.", 0.7)]
    index = VectorIndex(spark, str(tmp_path / "v"))
    assert index.rows().count() == 0
    assert index.refresh(table(spark, *rows)) == {"embedded": 3, "gone": 0} and index.refresh(table(spark, *rows)) == {"embedded": 0, "gone": 0}
    changed = [rows[0], belief("r", "Rust is compiled.", 0.8, at=LATER), belief("n", "Night follows day.", 0.6)]
    assert index.refresh(table(spark, *changed)) == {"embedded": 2, "gone": 1}
    as_set = lambda df: {(r["id"], r["dim"], round(r["weight"], 9)) for r in df.collect()}
    fresh = as_set(retrieval.embed(table(spark, *changed), "id", retrieval.indexed_text()))
    assert as_set(index.rows()) == fresh
    index.compact()
    assert as_set(index.rows()) == fresh and as_set(VectorIndex(spark, str(tmp_path / "v")).rows()) == fresh
    qs = spark.createDataFrame([(1, "qubit superposition", None, None, 20), (2, "compiled rust", "user", "s", 20)], "query_id long, query string, tier string, scope string, budget int")
    by = retrieval.by_vectors(vectors=index.rows())
    assert [(r["query_id"], r["id"]) for r in by(table(spark, *changed), qs, 1, False).orderBy("query_id").collect()] == [(1, "q"), (2, "r")]
    assert [(r["query_id"], r["id"]) for r in by(table(spark, *changed), qs, 1, True).collect()] == [(1, "q")]
    assert {r["id"] for r in selection.select(table(spark, *changed), qs, retriever=by).collect()} == {"q", "r"}
    with pytest.raises(ValueError):
        retrieval.get_retriever("none")


def test_owners_stay_apart(spark):
    reqs = [(1, "Coffee is best with milk.", "web", None, [], "user", "alice"), (2, "Coffee is best with milk.", "web", None, [], "user", "bob")]
    df = spark.createDataFrame(reqs, "request_id long, text string, source string, locator string, connections array<string>, tier string, scope string")
    empty = spark.createDataFrame([], BELIEF)
    assert lifecycle.ingest(empty, df, T).count() == 2
    moved = lifecycle.ingest(empty, df, T, across_owners=True).collect()
    assert len(moved) == 1 and moved[0]["scope"] == "bob"


def test_settings_and_requests_are_checked(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TENETRY_BUDGET", "7")
    monkeypatch.setenv("TENETRY_RETRIEVER", "vector")
    assert (Settings().budget, Settings().retriever, Settings(budget=9).budget) == (7, "vector", 9)
    for wrong in ({"budget": 0}, {"floor": 2.0}, {"solver": "none"}, {"retriever": "none"}, {"detector": "none"}):
        with pytest.raises(ValueError):
            Settings(**wrong)
    e = Engine(spark, str(tmp_path / "r"), client=EchoClient())
    with pytest.raises(ValueError, match="text string"):
        e.ingest(spark.createDataFrame([(1,)], "request_id long"), T)
    with pytest.raises(ValueError):
        e.ask("  ")
    assert build_client("") is None and isinstance(build_client("echo"), EchoClient) and isinstance(build_client("tenetry.plans.engine:EchoClient"), EchoClient)
    with pytest.raises(ValueError):
        build_client("nobody")


def test_facade_of_the_graph(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "reg"))
    e.registry.replace(table(spark, belief("q", "Qubits hold states.", 0.9, labels=["A"]), belief("s", "Qubits hold light.", 0.8, labels=["a!", "B"]), belief("t", "Tides turn and ships run aground.", 0.7, labels=["b"])))
    assert [r["path"] for r in e.connect("q", "t").collect()] == [["b:q", "c:a", "b:s", "c:b", "b:t"]] and e.connect("q", "none").count() == 0
    assert [(r["id"], r["strength"]) for r in e.infer("q").collect()] == [("s", 0.72), ("t", 0.504)]
    assert {r["id"] for r in e.propagate("q", -0.3).collect()} == {"q", "s"}
    e.add_evidence(spark.createDataFrame([("q", 1, "e1", "s", "web", None, 0.9, True, T)], "belief_id string, seq int, id string, snippet string, source string, locator string, strength double, supports boolean, created_at timestamp_ntz"), LATER)
    assert e.registry.get("q").first()["confidence"] > 0.9
    e.remember(e.registry.get("s"), LATER, "user", "me")
    assert e.registry.get("s").first()["scope"] == "me" and e.health() == {"beliefs": 3}
