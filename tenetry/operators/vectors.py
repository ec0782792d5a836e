"""A kept index of belief vectors: only what changed is embedded again, and only that is written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenetry.operators import retrieval
from tenetry.session import Folder

_VECTORS = "id string, dim int, weight double"
_SEEN = "id string, updated_at timestamp_ntz, generation int"


@dataclass
class VectorIndex:
    """Vectors of the live beliefs under ``path``, a folder that all executors share, made by ``embedder``.

    Every refresh that finds a change writes one generation: the vectors of new and changed beliefs, and which generation
    each belief's vectors are in. Vectors of gone and changed beliefs stay on disk, unread, until :meth:`compact`.
    ``signature`` names what made the vectors; an index under another signature is empty."""

    spark: SparkSession
    path: str
    embedder: retrieval.Embedder = retrieval.embed
    signature: str = "hash-1024"
    _folder: Folder = field(init=False)

    def __post_init__(self) -> None:
        self.path = f"{self.path.rstrip('/')}/{self.signature}"
        self._folder = Folder(self.spark, self.path)

    def _read(self, what: str, schema: str, numbers: list[int]) -> DataFrame:
        paths = [f"{self.path}/{what}/{n}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _done(self) -> list[int]:
        return sorted(int(n) for n in self._folder.names("done") if n.isdigit())

    def seen(self) -> DataFrame:
        """Rows (id, updated_at, generation) of the beliefs in the index."""
        return self._read("seen", _SEEN, self._done()[-1:])

    def rows(self) -> DataFrame:
        """Rows (id, dim, weight) of the beliefs in the index."""
        found = None
        for n in [int(x) for x in self._folder.text(f"done/{self._done()[-1]}").split()] if self._done() else []:
            part = self._read("vectors", _VECTORS, [n]).withColumn("generation", F.lit(n))
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], _VECTORS)
        return found.join(self.seen().select("id", "generation"), ["id", "generation"], "left_semi").select("id", "dim", "weight")

    def refresh(self, beliefs: DataFrame) -> dict[str, int]:
        """Bring the index up to ``beliefs``; says how many vectors were taken in and how many beliefs left. Nothing changed, nothing written."""
        live = beliefs.where("superseded_by is null")
        was, now = self.seen(), live.select("id", F.col("updated_at").alias("now"))
        # ids and stamps only; a missing stamp is one of its own
        both = was.join(now.withColumn("_here", F.lit(True)), "id", "full_outer")
        same = F.col("generation").isNotNull() & F.col("_here").isNotNull() & F.col("updated_at").eqNullSafe(F.col("now"))
        moved = both.select("id", F.when(F.col("_here").isNull(), "gone").when(~same, "fresh").alias("change")).where("change is not null")
        counts = {r["change"]: r["count"] for r in moved.groupBy("change").count().collect()}
        if not counts:
            return {"embedded": 0, "gone": 0}
        done = self._done()
        number = done[-1] + 1 if done else 0
        fresh = live.join(moved.where("change = 'fresh'").select("id"), "id", "left_semi")
        self._write(self.embedder(fresh, "id", retrieval.indexed_text()), "vectors", _VECTORS, number)
        kept = was.join(moved.select("id"), "id", "left_anti")
        self._write(kept.unionByName(fresh.select("id", "updated_at", F.lit(number).alias("generation"))), "seen", _SEEN, number)
        held = self._folder.text(f"done/{done[-1]}").split() if done else []
        self._folder.mark(f"done/{number}", " ".join([*held, str(number)]))
        return {"embedded": counts.get("fresh", 0), "gone": counts.get("gone", 0)}

    def compact(self) -> None:
        """Write the vectors in use as one generation."""
        done = self._done()
        if done:
            number = done[-1] + 1
            self._write(self.rows(), "vectors", _VECTORS, number)
            self._write(self.seen().withColumn("generation", F.lit(number)), "seen", _SEEN, number)
            self._folder.mark(f"done/{number}", str(number))

    def _write(self, df: DataFrame, what: str, schema: str, number: int) -> None:
        cols = (F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", "))
        df.select(*cols).write.mode("overwrite").parquet(f"{self.path}/{what}/{number}")
