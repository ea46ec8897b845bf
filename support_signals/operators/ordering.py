"""Global ordinal of a sorted DataFrame without a single-partition window.

``row_number()`` over an unpartitioned window pulls every row into one task.
Here the sort is range-partitioned across tasks, each row gets
``monotonically_increasing_id`` (partition id in the upper bits), the sorted
rows are checkpointed (so ids stay stable if a task is re-run), and the
per-partition row counts -- one small row per partition, broadcast -- turn
the ids into 1-based global ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from support_signals.session import cut_lineage


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    s = (df.orderBy(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    starts = (s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
              .withColumn("_off", F.coalesce(F.sum("_n").over(
                  Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # one row per partition of the sort: bounded by the partition count
    return (s.join(F.broadcast(starts.select("_pid", "_off", "_m0")), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_off", "_m0"))
