"""What the graph queries move: disk follows the graph, not starts times what they reach."""

import os

import pytest
from pyspark.sql import functions as F

from tenetry.operators import graph
from tenetry.session import shared_dir
from tests.test_graph_hops import registry, search

N = 400


def stored(spark):
    """Bytes shuffled so far, and those in the shared folder."""
    done = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    folder = shared_dir(spark).removeprefix("file://")
    return sum(done.apply(i).totalShuffleWrite() for i in range(done.size())) + sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


@pytest.fixture(scope="module")
def hub(spark):
    """Beliefs that all share one label, each with one of its own: every belief reaches every other."""
    rows = [(f"b{i:04}", "queue of ledgers", 0.5 + i / 1000, ["hub", f"own {i}"], None) for i in range(N)]
    df = spark.createDataFrame(rows, "id string, statement string, confidence double, connections array<string>, superseded_by string").cache()
    return df, graph.edges(df), df.select(F.col("id").alias("start"))


def moved(spark, query):
    before = stored(spark)
    n = len(query().collect())
    return n, stored(spark) - before


def test_connect(spark, hub):
    _, links, starts = hub
    n, size = moved(spark, lambda: graph.connect(links, starts.withColumn("goal", F.lit("b0007"))))
    assert n == N and size < 200_000


def test_connect_from_either_side(spark):
    rows = registry(1)
    df = spark.createDataFrame(rows, "id string, statement string, confidence double, connections array<string>, superseded_by string")
    ids = [r[0] for r in rows if r[4] is None]
    far = {s: search(rows, s, 6) if any(r[0] == s and r[3] for r in rows) else {} for s in ids}
    for pairs in ([(s, "b03") for s in ids], [("b03", t) for t in ids], [(s, t) for s in ids for t in ids], [("b03", "nobody"), ("nobody", "b03")]):
        got = {(r["start"], r["goal"], tuple(r["path"])) for r in graph.connect(graph.edges(df), spark.createDataFrame(pairs, "start string, goal string")).collect()}
        assert got == {(s, t, tuple(far[s][f"b:{t}"])) for s, t in pairs if f"b:{t}" in far.get(s, {})}


def test_paths(spark, hub):
    _, links, starts = hub
    n, size = moved(spark, lambda: graph.paths(links, starts))
    assert n == N * (2 * N + 1) and size < 200_000
    joined, spelled = (graph.paths(links, starts.limit(1), sep=sep).orderBy("node").collect() for sep in (" > ", None))
    assert [r["path"] for r in joined] == [" > ".join(r["path"]) for r in spelled]


def test_infer(spark, hub):
    df, links, starts = hub
    n, size = moved(spark, lambda: graph.infer(links, df, starts))
    assert n == 5 * N and size < 200_000


def test_infer_rounds_halves_up(spark):
    rows = [("a", "s", 0.15, ["x"], None), ("b", "s", 0.00003, ["x"], None), ("c", "s", 0.00001, ["x"], None)]
    df = spark.createDataFrame(rows, "id string, statement string, confidence double, connections array<string>, superseded_by string")
    got = graph.infer(graph.edges(df), df, spark.createDataFrame([("a",)], "start string")).orderBy("rank").collect()
    assert [(r["id"], r["strength"]) for r in got] == [("b", 0.000005), ("c", 0.000002)]


def test_propagate(spark, hub):
    df, links, starts = hub
    n, size = moved(spark, lambda: graph.propagate(links, df, starts.withColumn("delta", F.lit(-0.3))))
    assert n == N * N and size < 200_000


def test_walk(spark, hub):
    _, links, starts = hub
    n, size = moved(spark, lambda: graph.walk(links, starts))
    assert n == N * (2 * N + 1) and size < 200_000


def test_related(spark, hub):
    df, links, starts = hub
    n, size = moved(spark, lambda: graph.related(links, df, starts))
    assert n == N * (N - 1) and size < 200_000
