"""How rows lie over partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Inputs beyond this many bytes a core have enough splits of their own.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where a small input lies in fewer files than there are cores.

    A file with one row group is one task however the scan is cut, so work in Python would run on one core.  Large
    inputs stay as they are and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES * cores:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
