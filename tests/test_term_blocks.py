"""Postings are packed once; what a search moves follows the tables, not their blocks."""

import pytest
from pyspark.sql import functions as F

from tenetry.operators import retrieval
from tests.test_vector_blocks import texts


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, t, 0.3 + k % 7 / 10, [], None, ("user", "team")[k % 2], f"s{k % 3}") for k, (i, t) in enumerate(texts(2000))]
    df = spark.createDataFrame(rows, "id string, statement string, confidence double, evidence array<struct<snippet:string>>, superseded_by string, tier string, scope string").cache()
    df.count()
    own = F.conv(F.substring("id", 2, 5), 10, 10).cast("int")
    queries = df.select(F.col("id").alias("query_id"), F.concat(F.col("statement"), F.lit(" "), F.col("id")).alias("query"), F.when(own % 5 > 0, F.col("tier")).alias("tier"), F.when(own % 4 > 0, F.col("scope")).alias("scope"))
    return df, queries


def rows_shuffled(spark):
    """Rows that all stages so far have shuffled."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def brute(df, queries, k, within):
    """The same by joins."""
    docs = retrieval.documents(df)
    held = retrieval.postings(docs).join(docs.select("id", "norm", "confidence", "tier", "scope"), "id").join(retrieval.idf(docs), "term")
    asked = queries.select("query_id", F.col("tier").alias("q_tier"), F.col("scope").alias("q_scope"), F.inline(retrieval.text.runs(retrieval.text.tokens(F.col("query"))))).withColumnRenamed("tf", "qtf")
    met = asked.join(held, "term").where((F.col("q_tier").isNull() | (F.col("q_tier") == F.col("tier"))) & (F.col("q_scope").isNull() | (F.col("q_scope") == F.col("scope")))) if within else asked.join(held, "term")
    scores = met.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * F.col("tf") / F.col("norm") * F.col("confidence")), 6).alias("score"))
    return {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 5)) for r in retrieval._top(scores, "query_id", k).collect()}


@pytest.mark.parametrize("k, within", [(1, False), (5, True)])
def test_blocks_give_the_same(spark, tables, monkeypatch, k, within):
    df, queries = tables
    few = queries.limit(300)
    want = brute(df, few, k, within)
    for n in (10**6, 97):
        for name in ("PACKED_QUERIES", "PACKED_DOCUMENTS", "DOCUMENTS_HELD"):
            monkeypatch.setattr(retrieval, name, n)
        got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 5)) for r in retrieval.retrieve(df, few, k, within).collect()}
        assert got == want


def test_rows_of_many_claims(spark, tables, monkeypatch):
    df, queries = tables
    for name in ("QUERIES_PER_BLOCK", "PACKED_QUERIES"):
        monkeypatch.setattr(retrieval, name, 20, raising=False)
    answers = queries.select(F.col("query_id").alias("answer_id"), F.concat("query", F.lit(".")).alias("text"))
    before = rows_shuffled(spark)
    assert len(retrieval.ground(df, answers).collect()) == 2000
    n = rows_shuffled(spark) - before
    assert n < 100_000, n
