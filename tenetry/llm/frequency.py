"""Frequency of every distinct value or term, kept up to date by signed deltas.

A run looks only at the records that were added, changed or deleted, as change capture names them. Each gives -1 for what it
held before and +1 for what it holds now; the sums per term are merged into the stored counts. These lie in parquet in
buckets by hash of the term: a merge reads and rewrites the buckets its terms fall into and leaves the others where they
are, and a manifest names the files of each version, so that readers see one version whole and a repeated merge is none."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenetry.llm.words import let, norm, split_words
from tenetry.session import Folder, materialize

COUNTS = "field string, term string, occurrences bigint, records bigint"
#: Records of the first load for which a bucket more is laid out.
RECORDS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 200_000, 8, 4_096


def _tagged(terms: Column, field: str) -> Column:
    """Terms of one record as (field, term, first); ``first`` is 1 for one of the places of each term."""
    tag = lambda s: F.transform(s, lambda t, i: F.struct(F.lit(field).alias("field"), t.alias("term"), F.when((i > 0) & (t == F.get(s, i - 1)), 0).otherwise(1).alias("first")))
    return let(F.array_sort(terms), tag)


def record_terms(statement: Column, connections: Column) -> Column:
    labels = F.filter(F.transform(F.coalesce(connections, F.array().cast("array<string>")), norm), lambda t: t.isNotNull() & (t != ""))
    return F.concat(_tagged(split_words(norm(statement)), "statement"), _tagged(labels, "connections"))


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    terms = rows.select(F.inline(record_terms(F.col("statement"), F.col("connections"))))
    return terms.select("field", "term", F.lit(sign).alias("sign"), "first")


def deltas(new: DataFrame | None, old: DataFrame | None = None, changed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Signed changes (field, term, occurrences, records) from the snapshot ``old`` to ``new``.

    ``changed`` has the keys of the records that were added, changed or deleted; only those are cut into terms, and without
    it every record of both sides is. A record that is the same on both sides adds up to nothing. Null and empty texts and
    labels give no terms; repeated rows count each."""
    if changed is not None:
        keys = changed.select(key).distinct()
        new, old = (None if df is None else df.join(keys, key, "left_semi") for df in (new, old))
    sides = [_signed(df, sign) for df, sign in ((new, 1), (old, -1)) if df is not None]
    terms = sides[0].unionByName(sides[1]) if len(sides) > 1 else sides[0]
    summed = terms.groupBy("field", "term").agg(F.sum(F.col("sign").cast("bigint")).alias("occurrences"), F.sum(F.col("sign") * F.col("first").cast("bigint")).alias("records"))
    return summed.where("occurrences <> 0 or records <> 0")


@dataclass
class Counts:
    """The counts of a collection under ``path``, a folder that all executors share. One writer at a time."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self._folder = Folder(self.spark, self.path)

    def _manifest(self) -> dict | None:
        versions = [n for n in self._folder.names("versions") if n.isdigit()]
        return json.loads(self._folder.text(f"versions/{max(versions)}")) if versions else None

    def records(self) -> int:
        """How many records the collection has."""
        held = self._manifest()
        return held["records"] if held else 0

    def rows(self) -> DataFrame:
        """The counts (field, term, occurrences, records) of the current version."""
        held = self._manifest()
        return self._read([] if held is None else held["files"].values())

    def _read(self, files) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in sorted(files)]
        return self.spark.read.schema(COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], COUNTS)

    def merge(self, change: DataFrame, records: int, batch: int) -> None:
        """Merge the signed ``change`` of batch number ``batch``, by which the collection grew by ``records`` records.

        A batch that was merged before changes nothing, so a run may be repeated after a failure. Terms that no record
        holds any more are gone. The first merge lays out the buckets, as many as its records ask for."""
        held = self._manifest() or {"batch": -1, "records": 0, "files": {}, "buckets": min(MOST_BUCKETS, max(LEAST_BUCKETS, records // RECORDS_PER_BUCKET))}
        if batch <= held["batch"]:
            return
        bucket = F.pmod(F.xxhash64("field", "term"), F.lit(held["buckets"])).cast("int")
        moved = change.withColumn("bucket", bucket)
        if held["files"]:
            moved = materialize(moved, "term-deltas")
            touched = {str(r["bucket"]) for r in moved.select("bucket").distinct().collect()}  # one row per bucket at most
            stored = self._read(f for b, f in held["files"].items() if b in touched)
            both = stored.withColumn("bucket", bucket).unionByName(moved)
            moved = both.groupBy("bucket", "field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        else:
            touched = set()
        # buckets are in proportion to the data, so one is a task's work
        version = batch
        moved.where("records > 0").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        written = {n.partition("=")[2]: f"{version}/{n}" for n in self._folder.names(f"data/{version}") if n.startswith("bucket=")}
        files = {b: f for b, f in held["files"].items() if b not in touched} | written
        done = {"batch": batch, "records": held["records"] + records, "buckets": held["buckets"], "files": files}
        self._folder.mark(f"versions/{version:012d}", json.dumps(done))


def marks(counts: DataFrame, records: int, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """Counts with ``mark``: rare (in fewer than ``rare_below`` records), common (in more than that share of all), or null."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(records) * F.lit(common_above), "common")
    return counts.withColumn("mark", mark)
