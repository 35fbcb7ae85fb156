"""Per-group top-k (WIN2, WIN3).

`first_k` is a plain `row_number() <= k`: Spark keeps the first k rows of
every group in each map task before the shuffle (WindowGroupLimit), so a
hot group sends at most k rows per task.  Beyond the k up to which Spark
does so, groups are salted by a hash of the row id first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_k(df: DataFrame, keys: list[str] | str, order: list, k: int, salts: int = 64,
            id_col: str = "id", rank_col: str | None = None, descending_id: bool = False) -> DataFrame:
    """The first k rows of every group by `order`, ties by id (ascending, or descending on demand)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    last = F.col(id_col).desc() if descending_id else F.col(id_col)
    order = [F.col(o) if isinstance(o, str) else o for o in order] + [last]
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)))
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    out = df.withColumn("_r2", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r2") <= k)
    if rank_col:
        return out.withColumnRenamed("_r2", rank_col)
    return out.drop("_r2")


def rank_labels(df: DataFrame, label: str, score: str = "final_score", key: str = "job_posting_id",
                descending: bool = True) -> DataFrame:
    """WIN3: '<label> #<rank>' over an already-limited frame (top-k rows)."""
    o = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.orderBy(o, F.col(key))
    return df.withColumn("rank_label", F.concat(F.lit(label + " #"), F.row_number().over(w).cast("string")))
