"""Order-dependent per-key computations without a per-key task.

`keyed_cumsum` gives a running sum inside each key ordered by `order`.  A
key holding a third of all rows is split by the sample-based range
partitioner over many partitions; each partition sums locally and the
per-(partition, key) totals -- a table of at most #partitions + #keys rows
-- supply the offsets.  The range-partitioned rows are checkpointed so
partition ids stay stable under retries and executor loss.

Used by the repost detector (rank = cumsum of 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed_cumsum(df: DataFrame, key: str, order: list[str], value, out: str = "_cum",
                 inclusive: bool = True, partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.lit(1) if value is None else (F.col(value) if isinstance(value, str) else value)
    cols = [key] + list(order)
    ranged = (df.withColumn("_v", v).repartitionByRange(n, *cols)
                .withColumn("_pid", F.spark_partition_id())
                .checkpoint(eager=True))
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w = Window.partitionBy("_pid", key).orderBy(*cols).rowsBetween(*frame)
    local = ranged.withColumn("_loc", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    stats = ranged.groupBy("_pid", key).agg(F.sum("_v").alias("_t"))
    wo = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_off", F.coalesce(F.sum("_t").over(wo), F.lit(0))).drop("_t")
    res = local.join(offsets, ["_pid", key])
    return res.withColumn(out, F.col("_loc") + F.col("_off")).drop("_loc", "_off", "_pid", "_v")


def global_position(df: DataFrame, order: list[str], out: str = "_gpos",
                    partitions: int | None = None) -> DataFrame:
    """0-based position of every row in the total order `order` (unique).

    Range-partition, sort inside partitions, take each row's index inside
    its partition (`monotonically_increasing_id` low bits) and add the row
    count of all earlier partitions -- a table of one row per partition,
    broadcast (a proven bound).  The numbered rows are checkpointed, so
    positions are stable under retries; the wide rows are shuffled once.
    With the key first in `order`, every key's rows are contiguous, so "the
    k rows before me in my key" are the rows at positions [p-k, p-1] that
    carry my key.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    pid = F.shiftright(F.col("_mid"), 33)
    sizes = ranged.groupBy(pid.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    res = ranged.withColumn("_p", pid).join(F.broadcast(offsets), "_p")
    idx = F.col("_mid") - F.shiftleft(F.col("_p"), 33)
    return res.withColumn(out, idx + F.col("_off")).drop("_mid", "_p", "_off")
