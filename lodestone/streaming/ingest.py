"""Ingest as a stream of parsed documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.chunking import child_chunks
from lodestone.operators.sections import PARSED, logical_parents
from lodestone.sources.adapters import Embedder, Settings, embed_children


def ingest(parsed: DataFrame, embedder: Callable[[], Embedder] | None = None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(parents, children[, with embeddings]) of parsed documents."""
    parents = logical_parents(parsed)
    children = child_chunks(parents)
    return parents, embed_children(children, embedder, settings) if embedder else children


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, embedder: Callable[[], Embedder] | None = None, settings: Settings = Settings(), files_per_batch: int = 1000) -> StreamingQuery:
    """Parsed JSON files that arrive in ``source`` become parents and children below ``target``.

    A batch overwrites a folder of its own number, so one that is run again after a failure leaves the same rows.
    """
    arriving = spark.readStream.schema(PARSED).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch: DataFrame, number: int) -> None:
        parents, children = ingest(batch, embedder, settings)
        parents.write.mode("overwrite").parquet(f"{target}/parents/batch={number}")
        children.write.mode("overwrite").parquet(f"{target}/children/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window, with a watermark; works on a stream and on a table.

    Times without a zone are cast, as watermarks need instants.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), by, "events", "total")
