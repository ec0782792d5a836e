"""Duplicates hidden by formatting differences.

Bloom filters of once- and repeatedly-seen canonical hashes are built per partition and merged by
segment; only rows whose hash may repeat are shuffled for exact grouping, all others are singletons.

A filter is a run of segments; a hash picks one segment and sets two bits in it. A merged bit is
"repeated" when one partition saw it twice or two partitions saw it at all. A filter is broadcast and has ``max_bits``
bits at most. More rows than it serves are hashed into a table that is parted by ranges of the hash, and each range is
gone through with a filter of its own, so the share of rows that may repeat stays the same at any size."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenetry.llm.words import canonical_hashes
from tenetry.session import Folder, assign_groups, materialize, shared_dir

SEGMENT_BITS = 1 << 14
MAX_BITS = 1 << 28
BITS_PER_ROW = 24
_SHIFTS = (20, 42)
_SCHEMA = "segment int, once binary, twice binary"


def _or_into(once: np.ndarray, twice: np.ndarray, at: np.ndarray) -> None:
    """Set the bits ``at`` (sorted, with repeats) in ``once``; those set before or repeated here also in ``twice``."""
    if not len(at):
        return
    first = np.r_[True, at[1:] != at[:-1]]
    uniq, again = at[first], np.diff(np.r_[np.flatnonzero(first), len(at)]) > 1
    word, bit = uniq >> 6, np.uint64(1) << (uniq & 63).astype(np.uint64)
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    new, dup = np.bitwise_or.reduceat(bit, start), np.bitwise_or.reduceat(np.where(again, bit, np.uint64(0)), start)
    w = word[start]
    twice[w] |= (once[w] & new) | dup
    once[w] |= new


def _local_filters(segments: int):
    """Per partition: the once- and twice-seen bits of each touched segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(segments * SEGMENT_BITS // 64, dtype=np.uint64) for _ in range(2))
        for b in batches:
            h = b.column(0).drop_null().to_numpy().view(np.uint64)
            base = (h % np.uint64(segments)).astype(np.int64) * SEGMENT_BITS
            for shift in _SHIFTS:  # a half of the segment for each hash, so that the two never meet
                half = (h >> np.uint64(shift)) % np.uint64(SEGMENT_BITS // 2)
                _or_into(once, twice, np.sort(base + half.astype(np.int64) + (shift == _SHIFTS[1]) * (SEGMENT_BITS // 2)))
        grid = once.reshape(segments, -1)
        hit = np.flatnonzero(grid.any(axis=1))
        for part in np.array_split(hit, max(1, len(hit) // 256)):
            if len(part):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), *(pa.array([m.tobytes() for m in x.reshape(segments, -1)[part]], pa.binary()) for x in (once, twice))],
                    names=["segment", "once", "twice"],
                )

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once = twice = np.zeros(SEGMENT_BITS // 64, dtype=np.uint64)
    for o, t in zip(pdf["once"], pdf["twice"]):
        o, t = (np.frombuffer(x, dtype=np.uint64) for x in (o, t))
        once, twice = once | o, twice | t | (once & o)
    return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "bits": [twice.view(np.int64).tolist()]})


def repeat_filter(hashes: DataFrame, segments: int) -> DataFrame:
    """Rows (segment, bits): the bits seen more than once, as 64-bit words. ``hashes`` has one bigint column."""
    return hashes.mapInArrow(_local_filters(segments), _SCHEMA).groupBy("segment").applyInPandas(_merge, "segment int, bits array<bigint>")


def _bit(shift: int) -> Column:
    """The bit of ``_h1`` for one of the two shifts; null where the segment has no row."""
    at = f"(pmod(shiftrightunsigned(_h1, {shift}), {SEGMENT_BITS // 2}) + {(shift == _SHIFTS[1]) * (SEGMENT_BITS // 2)})"
    return F.expr(f"shiftrightunsigned(get(bits, cast(shiftright({at}, 6) as int)), cast({at} & 63 as int)) & 1")


def _asked(rows: DataFrame, segments: int) -> DataFrame:
    """``rows`` with ``_maybe``: whether the hash was seen more than once, as far as the filter tells."""
    found = repeat_filter(rows.select("_h1"), segments)
    # at most max_bits / 8 bytes, whatever the input
    # the modulus is taken on the unsigned value, as when the filter was built
    seg = F.expr(f"cast(pmod(pmod(shiftrightunsigned(_h1, 1), {segments}) * 2 + (_h1 & 1), {segments}) as int)")
    asked = rows.withColumn("segment", seg).join(F.broadcast(found), "segment", "left")
    return asked.withColumn("_maybe", F.coalesce((_bit(_SHIFTS[0]) + _bit(_SHIFTS[1])) == 2, F.lit(False))).drop("segment", "bits")


def split_repeats(rows: DataFrame, count: int, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_h1``, parted into those that surely occur once and those that may repeat.

    The rows are hashed once, into a table in the shared folder."""
    spark = rows.sparkSession
    ranges = max(1, math.ceil(count * BITS_PER_ROW / max_bits))
    bits = min(max_bits, 1 << max(14, (math.ceil(count / ranges) * BITS_PER_ROW - 1).bit_length()))
    segments = max(1, bits // SEGMENT_BITS)
    if ranges == 1:
        flagged = _asked(materialize(rows, "hashed"), segments)
        return flagged.where("not _maybe").drop("_maybe"), flagged.where("_maybe").drop("_maybe")
    # the range is taken from bits that neither segments nor places in them use much of; rows without a hash join the first
    path = f"{shared_dir(spark)}/hashed-{uuid.uuid4().hex}"
    part = F.coalesce(F.pmod(F.xxhash64("_h1"), F.lit(ranges)), F.lit(0)).cast("int")
    rows.withColumn("_range", part).write.partitionBy("_range").parquet(f"{path}/rows")
    for i in range(ranges):
        there = Folder(spark, f"{path}/rows").names(f"_range={i}")
        if there:  # one range after another, so that one filter is held at a time
            one = spark.read.schema(rows.schema).parquet(f"{path}/rows/_range={i}")
            _asked(one, segments).write.partitionBy("_maybe").parquet(f"{path}/asked/{i}")
    sides = []
    for kind in ("false", "true"):
        names = [n for n in Folder(spark, f"{path}/asked").names() if Folder(spark, f"{path}/asked/{n}").names(f"_maybe={kind}")]
        paths = [f"{path}/asked/{n}/_maybe={kind}" for n in names]
        sides.append(spark.read.schema(rows.schema).parquet(*paths) if paths else spark.createDataFrame([], rows.schema))
    return sides[0], sides[1]


def collapse(df: DataFrame, statement: str = "statement", id_col: str = "id", max_bits: int = MAX_BITS, keep: list[str] | None = None) -> DataFrame:
    """Every row with its ``group_id`` (smallest id among the rows that say the same) and number of ``copies``.

    Output: ``id_col``, the columns of ``keep``, ``group_id``, ``copies``. Rows with a null statement, or one without a
    single word, are copies of nothing: they come out alone. Rows repeated whole count as copies of each other.
    Other columns of ``df`` are never read, whatever their names. An empty table gives an empty result."""
    h1, h2 = canonical_hashes(F.col(statement))
    rows = df.select(F.col(id_col), *(F.col(c) for c in keep or []), h1.alias("_h1"), h2.alias("_h2"))
    count = df.count()
    sure, maybe = split_repeats(rows, count, max_bits)
    grouped = assign_groups(maybe, ["_h1", "_h2"], id_col, count)
    cols = [id_col, *(keep or [])]
    return grouped.select(*cols, "group_id", "copies").unionByName(sure.select(*cols, F.col(id_col).alias("group_id"), F.lit(1).cast("bigint").alias("copies")))
