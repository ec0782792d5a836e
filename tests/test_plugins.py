"""Plug-ins with stub models, the vector cache and the streams."""

from pyspark.sql import functions as F

from tenetry.operators import plugins, retrieval
from tenetry.schema import BELIEF
from tenetry.sources.registry import Registry
from tenetry.streaming.ingest import changes_per_window, ingest_stream

TEXT = "Rust guarantees memory safety without a garbage collector. It is compiled."


class Stub:
    def complete(self, prompt, system=None):
        if "broken" in prompt:
            raise OSError("no network")
        return "- Rust guarantees memory safety.\n2. Cheese orbits the moon daily.\n---\n"


class Strict:
    def supports(self, source, claim):
        return "safety" in claim


def test_model_claims(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, "A broken model is no reason to lose this."), (3, None)], "request_id long, text string")
    got = {(r["request_id"], r["claim"]) for r in plugins.model_claims(rows, "request_id", Stub).collect()}
    assert got == {(1, "Rust guarantees memory safety."), (2, "A broken model is no reason to lose this.")}
    assert [r["request_id"] for r in plugins.model_claims(rows, "request_id", Stub, Strict).collect()] == [1]


def test_word_forms_are_near(spark):
    rows = spark.createDataFrame([("a", "request"), ("b", "requests")], "id string, t string")
    v = retrieval.embed(rows, "id", F.col("t"))
    dot = v.alias("x").join(v.alias("y"), "dim").where("x.id = 'a' and y.id = 'b'").agg(F.sum(F.col("x.weight") * F.col("y.weight"))).first()[0]
    assert dot > 0.5


def test_dense_search_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    one = sorted(map(tuple, retrieval.dense_search(df, df.where("id % 5 = 0"), 3).collect()))
    monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", 2)
    monkeypatch.setattr(retrieval, "DOCUMENTS_PER_BLOCK", 7)
    many = sorted(map(tuple, retrieval.dense_search(df, df.where("id % 5 = 0"), 3).collect()))
    assert one == many and len(one) == 24 and all(r[2] == 1.0 for r in one if r[3] == 1)
    assert retrieval.dense_search(df, df.where("id < 0"), 3).count() == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "request_id long, text string, source string, locator string, connections array<string>, tier string, scope string"
    for k in (1, 2):
        spark.createDataFrame([(k, TEXT, "web", None, [], None, None)], schema).coalesce(1).write.mode("append").parquet(src)
    reg = Registry(spark, str(tmp_path / "reg"))
    for _ in range(2):  # the second start finds nothing new
        q = ingest_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), reg, str(tmp_path / "cp"), "2025-01-01 00:00:00")
        q.awaitTermination(120)
    rows = reg.rows().collect()
    assert spark.createDataFrame([], BELIEF).columns == reg.rows().columns
    assert len(rows) == 2 and all(len(r["evidence"]) == 2 for r in rows)
    saves = spark.createDataFrame([("general", "2025-01-01 10:00:00"), ("general", "2025-01-01 11:00:00"), ("user", "2025-01-02 00:00:00")], "tier string, arrived_at string")
    assert {(r["tier"], r["saves"]) for r in changes_per_window(saves.withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))).collect()} == {("general", 2), ("user", 1)}
