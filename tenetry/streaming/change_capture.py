"""Processing only new or changed records: change capture over a partitioned log.

Saves join a log when they land. Each gets a log partition (by hash of its own number, so hot keys spread) and the next
offset in it; both are stored then and never worked out again, so a save that lands late, with whatever stamp or number,
stands behind all that is there and no offset ever moves. A run first writes its batch plan, the offset range of each
partition, and only then works. A run that fails leaves its plan behind; the next run replays that plan as it stands, then
plans what has joined the log since. The sink keeps one row per key and batch, with the offset it came from; a replayed
batch overwrites itself, and keys whose latest stamp was handed out before are not handed out again."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenetry.session import Folder

#: Saves that one log partition takes of one append; more saves make more partitions.
ROWS_PER_PARTITION = 1_000_000
LEAST_PARTITIONS = 8

_LOG = "save string, id string, updated_at timestamp_ntz, arrived_at timestamp_ntz, part int, pos bigint"
_ENDS = "part int, end bigint"
_PLAN = "part int, from_pos bigint, to_pos bigint"
_SINK = "id string, updated_at timestamp_ntz, part int, pos bigint, batch int"
#: Small row groups, so that a range of offsets reads little of a log that is sorted by them.
_ROW_GROUP = 4 << 20


class Interrupted(RuntimeError):
    """Raised by :class:`ChangeCapture` where it is asked to break off."""


@dataclass
class ChangeCapture:
    """Capture run by run; log, plans, sink and marks are kept under ``path``, a folder that all executors share.

    Batch n is planned when its plan is marked, done when its commit is; a run is over when it has handed out its batches.
    Saves without id, ``updated_at`` or ``arrived_at`` never become visible; a save delivered twice under one ``save_id``
    joins once, and one without a ``save_id`` goes by its contents. Other columns are not read. One run at a time."""

    spark: SparkSession
    path: str
    rows_per_partition: int = ROWS_PER_PARTITION

    def __post_init__(self) -> None:
        self._folder = Folder(self.spark, self.path)

    def _read(self, what: str, numbers: list[int], schema: str) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{what}/{n}" for n in numbers))

    def _write(self, df: DataFrame, what: str, number: int, schema: str) -> None:
        cols = (F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", "))
        df.select(*cols).write.option("parquet.block.size", _ROW_GROUP).mode("overwrite").parquet(f"{self.path}/{what}/{number}")

    def _numbers(self, what: str) -> list[int]:
        """Numbers marked in a folder, in order."""
        return sorted(int(n) for n in self._folder.names(what) if n.isdigit())

    def _next(self, what: str) -> int:
        return max(self._numbers(what), default=-1) + 1

    def log(self) -> DataFrame:
        """All saves of finished appends, with partition and offset."""
        return self._read("log", self._numbers("appended"), _LOG)

    def _ends(self) -> DataFrame:
        """Rows (part, end): the last offset of each partition, one row per partition and append at most."""
        return self._read("ends", self._numbers("appended"), _ENDS).groupBy("part").agg(F.max("end").alias("end"))

    def append(self, saves: DataFrame) -> None:
        """Let the saves that are not yet in the log join it, in order of arrival. An append that broke off is made anew."""
        number = F.coalesce(F.col("save_id").cast("string"), F.concat(F.lit("#"), F.xxhash64("id", "updated_at", "arrived_at").cast("string")))
        rows = saves.where("id is not null and updated_at is not null and arrived_at is not null")
        rows = rows.select(number.alias("save"), "id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("updated_at", "arrived_at")))
        last = self._next("appended")
        if last:
            rows = rows.join(self.log().select("save"), "save", "left_anti")
        # as many partitions as the table is large; a partition may grow in later appends, and new ones may begin
        parts = max(LEAST_PARTITIONS, math.ceil(saves.count() / self.rows_per_partition))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("save"), F.lit(parts)).cast("int")).repartition("part")
        # a delivery repeated under its number keeps its first place
        first = Window.partitionBy("part", "save").orderBy("arrived_at", "updated_at", "id")
        rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("part").orderBy("arrived_at", "save")).cast("bigint"))
        if last:
            rows = rows.join(F.broadcast(self._ends()), "part", "left").withColumn("pos", F.col("pos") + F.coalesce("end", F.lit(0)))
        self._write(rows, "log", last, _LOG)
        self._write(self._read("log", [last], _LOG).groupBy("part").agg(F.max("pos").alias("end")), "ends", last, _ENDS)
        self._folder.mark(f"appended/{last}")

    def run(self, saves: DataFrame | None, as_of: dt.datetime, fail_after: str | None = None) -> DataFrame:
        """Process what had arrived by ``as_of``: rows (id, updated_at) new or changed since the last run that succeeded.

        ``saves`` joins the log first, unless it is None. ``fail_after`` ('plan' or 'sink') breaks off there, as a lost
        driver would."""
        first, last = self.advance(saves, as_of, fail_after)
        return self.sink(first, last).groupBy("id").agg(F.max("updated_at").alias("updated_at"))

    def advance(self, saves: DataFrame | None, as_of: dt.datetime, fail_after: str | None = None) -> tuple[int, int]:
        """As :meth:`run`, but gives the numbers of the first and last batch that the run hands out."""
        if saves is not None:
            self.append(saves)
        # what runs that broke off had committed was never handed out
        first = max((int(self._folder.text(f"runs/{n}")) for n in self._numbers("runs")), default=-1) + 1
        open_batch = self._next("commits")
        if open_batch in self._numbers("planned"):
            self._process(open_batch, None)
        batch = self._next("commits")
        self._plan(batch, as_of)
        if fail_after == "plan":
            raise Interrupted("after the plan")
        self._process(batch, fail_after)
        self._folder.mark(f"runs/{self._next('runs')}", str(batch))
        return first, batch

    def _plan(self, batch: int, as_of: dt.datetime) -> None:
        """Write ahead which offsets the batch covers: behind the last batch's, up to the first not visible at ``as_of``.

        A save that joined late, behind ones still to come, waits until these are visible, and is not passed over."""
        begun = self._read("plans", [batch - 1] if batch else [], _PLAN).select("part", F.col("to_pos").alias("begun"))
        hidden = self.log().where(F.col("arrived_at") > F.lit(as_of).cast("timestamp_ntz")).groupBy("part").agg((F.min("pos") - 1).alias("seen"))
        plan = self._ends().join(begun, "part", "left").join(hidden, "part", "left")
        from_pos = F.coalesce("begun", F.lit(0))
        self._write(plan.select("part", from_pos.alias("from_pos"), F.greatest(from_pos, F.coalesce("seen", "end")).alias("to_pos")).coalesce(1), "plans", batch, _PLAN)
        self._folder.mark(f"planned/{batch}")

    def sink(self, first: int = 0, last: int | None = None) -> DataFrame:
        """What the committed batches from ``first`` to ``last`` wrote."""
        return self._read("sink", [n for n in self._numbers("commits") if n >= first and (last is None or n <= last)], _SINK)

    def _process(self, batch: int, fail_after: str | None) -> None:
        plan = self._read("plans", [batch], _PLAN)
        low, high = plan.agg(F.min("from_pos"), F.max("to_pos")).first()
        # the outer bounds reach the scan, the range of its partition holds for each row; a plan has a row per partition
        rows = self.log().where((F.col("pos") > F.lit(low)) & (F.col("pos") <= F.lit(high)))
        rows = rows.join(plan, "part").where("pos > from_pos and pos <= to_pos")
        new = rows.groupBy("id").agg(F.max(F.struct("updated_at", "part", "pos")).alias("top")).select("id", "top.*")
        if batch:
            known = self.sink(0, batch - 1).groupBy("id").agg(F.max("updated_at").alias("known"))
            new = new.join(known, "id", "left").where("known is null or updated_at > known")
        self._write(new.withColumn("batch", F.lit(batch)), "sink", batch, _SINK)
        if fail_after == "sink":
            raise Interrupted("after the sink")
        self._folder.mark(f"commits/{batch}")


def changed(saves: DataFrame, runs: DataFrame, path: str, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Rows (run_id, id, updated_at): for each succeeded run, the keys new or changed since the succeeded run before it.

    Plays the control table ``runs`` (run_id, started_at, status; read to the driver, one row per run) over a capture kept
    under ``path``: the saves join the log, then each run plans, works and commits in order of its start. A killed run
    breaks off behind its plan, a failed one behind its sink, and the next run replays what they left. Runs without a start
    never ran. Empty tables give no rows."""
    capture = ChangeCapture(saves.sparkSession, path, rows_per_partition)
    capture.append(saves)
    handed: list[tuple[int, int]] = []
    for r in sorted(runs.where("started_at is not null").select("run_id", "started_at", "status").collect(), key=lambda r: (r["started_at"], r["run_id"])):
        stop = {"succeeded": None, "killed": "plan"}.get(r["status"], "sink")
        try:
            first, last = capture.advance(None, r["started_at"], stop)
            handed += [(r["run_id"], n) for n in range(first, last + 1)]
        except Interrupted:
            pass
    by = capture.spark.createDataFrame(handed, "run_id bigint, batch int")
    return capture.sink().join(F.broadcast(by), "batch").groupBy("run_id", "id").agg(F.max("updated_at").alias("updated_at"))
