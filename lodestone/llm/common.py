"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.sources.layout import spread
from lodestone.sources.shared import discard, shared_folder, stored

__all__ = ["arrow_map", "bounded_batches", "cut", "discard", "remainder", "shared_folder", "small", "stored", "table", "wide_table"]

#: The white space that separates words: space, and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: One word, for regular expressions of Spark and of DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, over all cores where it is small and in few files."""
    return spread(table(spark, sf_dir, name))


#: The same rows, written to the shared folder and read back.
cut = stored

#: Bytes of an Arrow batch: what a task holds at once on either side of Python follows it, whatever rows weigh.
BATCH_BYTES = 8 << 20


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of BATCH_BYTES; a session that has set its own bytes for a batch keeps them."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def bounded_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, str(BATCH_BYTES))


def remainder(key: Column, n: int) -> Column:
    """crc32 of a key's text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def small(df: DataFrame, rows: int, limit: int = 50_000) -> DataFrame:
    """A broadcast hint where the counted rows are within the limit, else the frame as it is."""
    return F.broadcast(df) if rows <= limit else df
