"""Vectors are made where they are compared, a range at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tenetry.functions import text
from tenetry.operators import retrieval
from tests.test_graph_disk import stored

WORDS = ["queues", "ledger", "caches", "index", "token", "bus", "shard", "retrieval", "of", "class", "a1", "decomposition"]


def texts(n):
    rng = np.random.default_rng(1)
    return [(f"b{i:05}", " ".join(rng.choice(WORDS, 5)) + f" item{i % 97}") for i in range(n)]


def test_words_and_rows_agree(spark):
    df = spark.createDataFrame([*texts(60), ("empty", "the of"), ("none", "")], "id string, t string")
    rows = spark.createDataFrame(retrieval.embed(df, "id", F.col("t")).collect())
    words = df.select("id", text.tokens(F.col("t")).alias("words"))
    for skip in (True, False):
        got, want = ({(r["qkey"], r["rank"]): (r["id"], r["similarity"]) for r in retrieval.nearest(v, spark.createDataFrame(v.collect(), v.schema).withColumnRenamed("id", "qkey"), 7, skip).collect()} for v in (words, rows))
        assert got == want and len(got) == 60 * 7


def test_ranges_give_the_same(monkeypatch):
    rows = texts(50)
    table = pa.table({"id": [i for i, _ in rows], "words": [t.split() for _, t in rows]})
    whole = retrieval._best_by_product(4, 9, retrieval._of_words, True)(table.rename_columns(["qkey", "words"]), table)
    for name, n in (("QUERIES_AT_ONCE", 7), ("DOCUMENTS_AT_ONCE", 9), ("SLICE", 3)):
        monkeypatch.setattr(retrieval, name, n)
    assert retrieval._best_by_product(4, 9, retrieval._of_words, True)(table.rename_columns(["qkey", "words"]), table).equals(whole)


def test_memory_of_a_block():
    n = 20_000
    table = pa.table({"id": [f"b{i:05}" for i in range(n)], "dim": np.arange(n) % 1024, "weight": np.ones(n)})
    tracemalloc.start()
    retrieval._best_by_product(3, 9, retrieval._dense(1024))(pa.table({"qkey": ["q"], "dim": [5], "weight": [1.0]}), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_disk(spark):
    df = spark.createDataFrame([(i, t, 0.5, [], None) for i, t in texts(2000)], "id string, statement string, confidence double, evidence array<struct<snippet:string>>, superseded_by string").cache()
    df.count()
    queries = df.select(F.col("id").alias("query_id"), F.concat(F.col("statement"), F.lit(" "), F.col("id")).alias("query")).limit(100)
    before = stored(spark)
    assert len(retrieval.vector_retrieve(df, queries).collect()) == 500
    size = stored(spark) - before
    assert size < 1_000_000


def test_disk_of_slices(spark):
    rows = [(i, t, 0.5, [], None, "user", f"s{k % 4}") for k, (i, t) in enumerate(texts(2000))]
    df = spark.createDataFrame(rows, "id string, statement string, confidence double, evidence array<struct<snippet:string>>, superseded_by string, tier string, scope string").cache()
    df.count()
    queries = df.select(F.col("id").alias("query_id"), F.concat(F.col("statement"), F.lit(" "), F.col("id")).alias("query"), "tier", "scope").limit(100)
    before = stored(spark)
    found = retrieval.vector_retrieve(df, queries, within=True).collect()
    assert len(found) == 500 and all(int(r["id"][1:]) % 4 == int(r["query_id"][1:]) % 4 for r in found)
    size = stored(spark) - before
    assert size < 1_000_000
