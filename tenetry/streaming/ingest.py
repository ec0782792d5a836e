"""Structured Streaming around the batch operators (an extension): texts and saves as streams.

``ingest_stream`` folds each micro-batch into the registry; Spark's checkpoint gives every batch an id, and batches that
were stored are passed over, so a replay after a failure adds nothing twice. ``changes_per_window`` counts saves per tier in
event-time windows and lets late rows in until the watermark has passed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenetry.operators import lifecycle
from tenetry.sources.registry import Registry


def ingest_stream(requests: DataFrame, registry: Registry, checkpoint: str, at: str) -> StreamingQuery:
    """Start folding a stream of ingest requests into ``registry``; stops by itself when the source is read through."""

    def fold(batch: DataFrame, number: int) -> None:
        # batches come in order, and the number is stored with the snapshot it is in
        if number > registry.last_batch():
            registry.replace(lifecycle.ingest(registry.rows(), batch, at), number)

    return requests.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_per_window(saves: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows (start, tier, saves) over a batch or a stream of registry saves."""
    timed = saves.withColumn("arrived_at", F.col("arrived_at").cast("timestamp")).withWatermark("arrived_at", late)
    return timed.groupBy(F.window("arrived_at", window).alias("w"), "tier").agg(F.count(F.lit(1)).alias("saves")).select(F.col("w.start").alias("start"), "tier", "saves")
