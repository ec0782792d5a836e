"""Session helpers: table access, the shared folder, lineage cuts and grouping that stands skew."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of one group that may share a salt.
ROWS_PER_SALT, LEAST_SALTS = 500_000, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session whose executors run on this machine may go without the setting: it gets a local folder, which is
    removed when the process ends. On a cluster the setting is demanded, as a local folder would not be shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = getattr(shared_dir, "_made", None)
        if made is None:
            local = tempfile.mkdtemp(prefix="tenetry-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            made = shared_dir._made = "file://" + local
        path = made
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Folder:
    """Names and small marks in a folder of the shared file system, without a job for each of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        path = self._hadoop.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        path, fs = self._at(name)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def mark(self, name: str, text: str = "") -> None:
        """Put a small file there in one step: it is written aside and then renamed."""
        aside, fs = self._at(f".{uuid.uuid4().hex}")
        path, _ = self._at(name)
        out = fs.create(aside)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(path.getParent())
        if not fs.rename(aside, path):
            fs.delete(aside, False)
            if not fs.exists(path):
                raise OSError(f"cannot write {path}")

    def text(self, name: str) -> str:
        path, fs = self._at(name)
        found = fs.open(path)
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scalar(df: DataFrame) -> Column:
    """The single value of a one-row, one-column DataFrame as a lazy column."""
    return df.scalar()


def salt_of(col: Column | str, buckets: int) -> Column:
    """A repeatable salt from a row's own id, never from a random source."""
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def assign_groups(rows: DataFrame, keys: list[str], id_col: str, count: int) -> DataFrame:
    """Add ``group_id`` (smallest id) and ``copies`` of each key group to every row; there are ``count`` rows at most.

    Skew-safe: rows are shuffled on (keys, salt), counted per salt, the small salt totals are merged
    per key, and the totals travel back over the salts, so no task ever holds a whole hot group."""
    # even if all rows are one group, a salt of it holds no more than ROWS_PER_SALT on average
    salts = max(LEAST_SALTS, math.ceil(count / ROWS_PER_SALT))
    # one shuffle, reused by the totals and by the rows
    salted = rows.withColumn("_salt", salt_of(id_col, salts)).repartition(*keys, "_salt")
    part = salted.groupBy(*keys, "_salt").agg(F.min(id_col).alias("_min"), F.count(F.lit(1)).alias("_n"))
    total = part.groupBy(*keys).agg(F.min("_min").alias("group_id"), F.sum("_n").alias("copies"))
    back = part.select(*keys, "_salt").join(total, keys)
    return salted.join(back, [*keys, "_salt"]).drop("_salt")
