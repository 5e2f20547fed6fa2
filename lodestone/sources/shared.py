"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a Parquet row group: what a writing task holds, and what a reading one can be split at.
ROW_GROUP_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session on ``local[...]`` without one, such as a test, gets a folder of its own.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as a Parquet table in the shared folder: a short lineage that outlives lost executors.

    ``discard`` removes the table.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_path = path
    return found


def discard(*frames: DataFrame) -> None:
    """Removes what ``stored`` wrote for frames that nothing reads any more."""
    for df in frames:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(conf).delete(path, True)
