"""The registry as snapshots in a folder: every write is a new snapshot, and a small pointer names the current one.

A batch write is all or nothing: readers follow the pointer, which moves only when the new snapshot is complete. The same
class opens a plain parquet folder or a JDBC table for reading."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenetry.operators import lifecycle
from tenetry.schema import BELIEF, DEAD_BELOW
from tenetry.session import Folder


#: Columns that a database table keeps as JSON text.
_NESTED = ("evidence", "connections", "history")


def open_registry(spark: SparkSession, target: str, table: str = "beliefs", parts: int = 16, **options: str) -> "Registry | DataFrame":
    """A registry folder, or the rows of a database table for a jdbc: address.

    A table is read in ``parts`` parts side by side, by ranges of the first sign of the id, which must be hexadecimal."""
    if not target.startswith("jdbc:"):
        return Registry(spark, target)
    starts = [f"{16 * i // parts:x}" for i in range(parts)] if parts <= 16 else [f"{256 * i // parts:02x}" for i in range(parts)]
    cut = [(a, b) for a, b in zip([None, *starts[1:]], [*starts[1:], None])]
    where = [" and ".join([*([f"\"id\" >= '{a}'"] if a else []), *([f"\"id\" < '{b}'"] if b else [])]) or "1 = 1" for a, b in cut]
    rows = spark.read.jdbc(target, table, predicates=where, properties=options)
    rows = rows.select(*(F.col(c).alias(c.lower()) for c in rows.columns))
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], BELIEF).schema}
    return rows.select(*((F.from_json(c, kinds[c]) if c in _NESTED else F.col(c).cast(kinds[c])).alias(c) for c in kinds))


def to_database(beliefs: DataFrame, target: str, table: str = "beliefs", mode: str = "overwrite", **options: str) -> None:
    """Write beliefs to a database table; nested columns become JSON text. All or nothing per part, not over all of them."""
    plain = beliefs.select(*((F.to_json(c) if c in _NESTED else F.col(c)).alias(c) for c in beliefs.columns))
    # an id is a key, so it must be of a type that compares
    plain.write.option("createTableColumnTypes", "id VARCHAR(255)").jdbc(target, table, mode=mode, properties=options)


def scan(beliefs: DataFrame, min_confidence: float = 0.0, tier: str | None = None, scope: str | None = None, limit: int | None = None, include_retired: bool = False) -> DataFrame:
    """Strongest first, ties by id; retired beliefs are hidden unless asked for."""
    out = beliefs.where((F.col("confidence") >= min_confidence) & lifecycle.view(tier, scope))
    out = out if include_retired else out.where("superseded_by is null")
    out = out.orderBy(F.desc("confidence"), "id")
    return out if limit is None else out.limit(limit)


def search(beliefs: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Statements that hold the text, in any case, strongest first; retired ones included. % and _ stand for themselves."""
    plain = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return beliefs.where(F.col("statement").ilike(f"%{plain}%")).orderBy(F.desc("confidence"), "id").limit(limit)


def fingerprints(beliefs: DataFrame) -> DataFrame:
    return beliefs.where("superseded_by is null").select("id", "updated_at")


def difference(seen: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (id, change): what an index that has seen ``seen`` must remove (gone) or take in again (changed, new)."""
    a, b = seen.select("id", F.col("updated_at").alias("was")), current.select("id", F.col("updated_at").alias("now"))
    both = a.join(b, "id", "full_outer")
    change = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed")
    return both.select("id", change.alias("change")).where("change is not null")


def counts(beliefs: DataFrame) -> DataFrame:
    """Rows (tier, live, retired, stored)."""
    live = F.col("superseded_by").isNull().cast("int")
    return beliefs.groupBy("tier").agg(F.sum(live).alias("live"), F.sum(1 - live).alias("retired"), F.count(F.lit(1)).alias("stored"))


class Registry:
    """Snapshots are laid out by tier, so that scans of one tier read its files only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = Folder(spark, self.path)

    def _pointer(self) -> dict | None:
        names = self._folder.names("pointer")
        return json.loads(self._folder.text(f"pointer/{names[-1]}")) if names else None

    def last_batch(self) -> int:
        """The number of the last stream batch that is in the current snapshot; -1 for none."""
        held = self._pointer()
        return -1 if held is None else held["batch"]

    def rows(self) -> DataFrame:
        """The current snapshot; columns added to the model since it was written are null."""
        held = self._pointer()
        none = self.spark.createDataFrame([], BELIEF)
        # the folders' own column is left out; a file holds one tier, so its statistics let a scan of another pass it by
        return none if held is None else self.spark.read.schema(BELIEF).parquet(f"{self.path}/{held['snapshot']}").select(*none.columns)

    def replace(self, beliefs: DataFrame, batch: int | None = None) -> None:
        """Write a whole new snapshot and move the pointer to it; the number of a stream batch moves with it, in one step."""
        name = f"snapshot-{uuid.uuid4().hex}"
        cols = self.spark.createDataFrame([], BELIEF).columns
        beliefs.select(*cols).withColumn("tier_", F.coalesce("tier", F.lit("general"))).write.partitionBy("tier_").parquet(f"{self.path}/{name}")
        held = self._pointer() or {"seq": 0, "batch": -1}
        new = {"seq": held["seq"] + 1, "snapshot": name, "batch": held["batch"] if batch is None else batch}
        self._folder.mark(f"pointer/{new['seq']:012d}", json.dumps(new))

    def save_all(self, beliefs: DataFrame, at: dt.datetime | str) -> None:
        """Upsert by id; of rows with one id the last stamped is kept. The write stamps updated_at."""
        newest = Window.partitionBy("id").orderBy(F.desc("updated_at"))
        cols = self.rows().columns
        fresh = beliefs.select(*cols).withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r").withColumn("updated_at", lifecycle.moment(at))
        self.replace(self.rows().join(fresh.select("id"), "id", "left_anti").select(*cols).unionByName(fresh))

    def get(self, belief_id: str) -> DataFrame:
        return self.rows().where(F.col("id") == belief_id)

    def delete(self, where: Column) -> None:
        self.replace(self.rows().where(~F.coalesce(where, F.lit(False))))

    def prune(self, threshold: float = DEAD_BELOW) -> None:
        self.replace(lifecycle.prune(self.rows(), threshold))
