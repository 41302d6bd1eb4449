"""Reading tables whose files have too few row groups for the cores there are."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a table that may be dealt out anew.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores, if its scan has fewer tasks than that and reads ``SPREAD_BYTES`` at most.

    So a large table is never shuffled for this, and the few rows of a small one do not wait for one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores)
