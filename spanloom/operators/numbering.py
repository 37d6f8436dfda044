"""Row numbers in a global order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch

_ROWS = 33  # bits of monotonically_increasing_id below the partition


def with_number(df: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """Adds ``name``: the row's place (long, from 0) in this order.

    Rows are partitioned by range, sorted inside their partition and written with their place there. What comes before a partition is the sum of
    the counts of those before it: one number for each partition reaches the driver. The order should be total; rows that tie
    in it get places of their own in an arbitrary order, which no later reading changes.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    keys = list(order)
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", _ROWS))
    before, offsets = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("__part").count().collect())):
        offsets.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "__part long, __before long"))  # a row for each partition
    return rows.join(starts, "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << _ROWS) - 1)).select(*df.columns, name)
