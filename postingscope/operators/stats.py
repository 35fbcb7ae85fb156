"""Statistics (AGG10-18, FLT6).

All statistics are aggregates with map-side partials and one tiny final
merge.  Ranks and percentiles work on the distinct values of a column, however
many: these are dealt out by ranges, the counts of the ranges (one row each)
tell where a wanted rank lies, and only there values are ordered.  p-values
come from the JVM's incomplete beta function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postingscope.functions.features import pyround


# ----------------------------------------------------------------- FLT6
def valid_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.dropna(subset=[x, y])


# ---------------------------------------------------------------- AGG10
def value_ranges(df: DataFrame, col: str) -> DataFrame:
    """(_v, _c, _part): distinct non-null values with their counts, dealt out by ranges of the value."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    freq = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return freq.repartitionByRange(n, "_v").withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)


def quantiles(ranges: DataFrame, probs: list[float]) -> DataFrame:
    """One row (q0, q1, ...): exact quantiles with linear interpolation (as numpy) of a table from `value_ranges`; null without rows.

    Running counts are taken over the ranges, one row each; values are ordered only in the ranges that hold a wanted rank."""
    sizes = ranges.groupBy("_part").agg(F.sum("_c").alias("_n"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))       # one row per range
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    ranks = (sizes.agg(F.sum("_n").alias("_all")).where("_all > 0").select("_all", F.explode(places).alias("x"))
             .select("x.i", (F.col("x.p") * (F.col("_all") - 1)).alias("at"))
             .select("i", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct())   # two for each probability
    wanted = starts.join(F.broadcast(ranks), F.expr("rank >= _before and rank < _before + _n"))
    inside = ranges.join(F.broadcast(wanted.select("_part", "_before").distinct()), "_part")
    upto = F.sum("_c").over(Window.partitionBy("_part").orderBy("_v"))
    inside = inside.withColumn("_upto", F.col("_before") + upto).select(F.col("_part").alias("_in"), "_v", (F.col("_upto") - F.col("_c")).alias("_from"), "_upto")
    found = inside.join(F.broadcast(wanted.select("_part", "i", "at", "rank")), F.expr("_in = _part and rank >= _from and rank < _upto"))

    def q(i: int) -> Column:
        low, high = (F.max(F.when((F.col("i") == i) & (F.col("rank") == f("at")), F.col("_v").cast("double"))) for f in (F.floor, F.ceil))
        part = F.max(F.when(F.col("i") == i, F.col("at") - F.floor("at")))
        return (low + (high - low) * part).alias(f"q{i}")

    return found.agg(*[q(i) for i in range(len(probs))])


def score_summary(df: DataFrame, col: str = "final_score", high: float = 60.0) -> DataFrame:
    """mean, population std, min, P25, median, P75, max (linear
    interpolation, as numpy) and the high-risk count; one pass over `df`,
    everything from its distinct values and their counts."""
    values = value_ranges(df, col)
    v, c = F.col("_v"), F.col("_c")
    one = values.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n"), (F.sum(v * c) / F.sum(c)).alias("mean"), F.min(v).alias("min"),
                     F.max(v).alias("max"), F.coalesce(F.sum(F.when(v >= high, c)), F.lit(0)).alias("high_risk"))
    off = v - F.col("_mean")
    spread = values.crossJoin(F.broadcast(one.select(F.col("mean").alias("_mean")))).agg(       # one row
        F.sqrt(F.sum(c * off * off) / F.sum(c)).alias("std"))
    out = one.crossJoin(spread).crossJoin(quantiles(values, [0.25, 0.5, 0.75]))                 # one row each
    return out.select("n", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"), "max", "high_risk")


# ------------------------------------------------------------- AGG13
def two_sided_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r on n pairs (Student t, n - 2 degrees of freedom): I_x(df / 2, 1 / 2) at x = 1 - r * r."""
    beta = F.call_function("java_method", F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta"),
                           F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - r * r)), (F.greatest(n - 2, F.lit(1)) / 2.0).cast("double"), F.lit(0.5))
    return F.when(r.isNull() | n.isNull() | (n < 3), 1.0).when(F.abs(r) >= 1.0, 0.0).otherwise(beta.cast("double"))


def pearson(df: DataFrame, x: str, y: str, with_p: bool = True,
            degenerate_r: float | None = 0.0) -> DataFrame:
    """AGG13: r, p, N over non-null pairs; N<2 or a constant side gives r=0, p=1.

    Single-pass moments: r = covar_pop / (std_x * std_y) via try_divide
    (ANSI mode would raise on a zero denominator)."""
    v = valid_pairs(df, x, y)
    agg = v.agg(F.count(F.lit(1)).alias("n"),
                F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("_r"),
                F.min(x).alias("_xmin"), F.max(x).alias("_xmax"),
                F.min(y).alias("_ymin"), F.max(y).alias("_ymax"))
    degenerate = ((F.col("n") < 2) | (F.col("_xmin") == F.col("_xmax")) | (F.col("_ymin") == F.col("_ymax"))
                  | F.col("_r").isNull())
    r = F.when(degenerate, F.lit(degenerate_r).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("_r"))))
    out = agg.select(r.alias("r"), F.col("n"), degenerate.alias("_deg"))
    if with_p:
        out = out.withColumn("p", F.when(F.col("_deg"), F.lit(1.0)).otherwise(two_sided_p(F.col("r"), F.col("n"))))
    return out.drop("_deg")


# ------------------------------------------------------------- AGG14
def weighted_pearson(df: DataFrame, x: str, y: str, w: str, with_p: bool = True,
                     degenerate_r: float | None = 0.0) -> DataFrame:
    """Pearson r over rows carrying a multiplicity `w` (two passes: means,
    then centred moments -- no cancellation on large ranks).  Always one
    row; empty input gives the degenerate result."""
    m = df.agg(F.coalesce(F.sum(w), F.lit(0)).alias("n"),
               (F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("_mx"),
               (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("_my"),
               F.min(x).alias("_xmin"), F.max(x).alias("_xmax"), F.min(y).alias("_ymin"), F.max(y).alias("_ymax"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    mom = df.crossJoin(F.broadcast(m.select("_mx", "_my"))).agg(  # m is one row
        F.sum(F.col(w) * dx * dy).alias("_sxy"), F.sum(F.col(w) * dx * dx).alias("_sxx"),
        F.sum(F.col(w) * dy * dy).alias("_syy"))
    agg = m.crossJoin(mom)  # one row x one row
    r0 = F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx")) * F.sqrt(F.col("_syy")))
    degenerate = ((F.col("n") < 2) | (F.col("_xmin") == F.col("_xmax")) | (F.col("_ymin") == F.col("_ymax"))
                  | r0.isNull())
    r = F.when(degenerate, F.lit(degenerate_r).cast("double")).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r0)))
    out = agg.select(r.alias("r"), F.col("n").cast("long").alias("n"), degenerate.alias("_deg"))
    if with_p:
        out = out.withColumn("p", F.when(F.col("_deg"), F.lit(1.0)).otherwise(two_sided_p(F.col("r"), F.col("n"))))
    return out.drop("_deg")


def spearman(df: DataFrame, x: str, y: str, with_p: bool = True) -> DataFrame:
    """AGG14: Pearson on average ranks of the valid pairs.

    Works on the (x, y) frequency table: one partial aggregation over the
    rows (checkpointed, so the input plan runs once).  The per-value counts
    of x and of y are stacked into one table and ranked together with a
    keyed, range-partitioned prefix sum; the averaged ranks are joined to the
    pairs once, and three numbers per pair are kept for the two passes of
    the weighted Pearson."""
    from postingscope.operators.sequence import keyed_cumsum
    pairs = (valid_pairs(df, x, y).groupBy(F.col(x).alias("_x"), F.col(y).alias("_y"))
             .agg(F.count(F.lit(1)).alias("_c")).checkpoint(eager=True))
    both = pairs.select(F.explode(F.array(F.struct(F.lit("x").alias("_var"), F.col("_x").cast("double").alias("_val"), "_c"),
                                          F.struct(F.lit("y").alias("_var"), F.col("_y").cast("double").alias("_val"), "_c"))).alias("_s")).select("_s.*")
    counts = both.groupBy("_var", "_val").agg(F.sum("_c").alias("_cnt"))
    cum = keyed_cumsum(counts, "_var", ["_val"], "_cnt", "_before", inclusive=False)
    ranks = cum.select("_var", "_val", ((F.col("_before") * 2 + F.col("_cnt") + 1) / F.lit(2.0)).alias("_rank")).checkpoint(eager=True)
    rx = ranks.filter("_var = 'x'").select(F.col("_val").alias("_vx"), F.col("_rank").alias("_rx"))
    ry = ranks.filter("_var = 'y'").select(F.col("_val").alias("_vy"), F.col("_rank").alias("_ry"))
    j = pairs.join(rx, F.col("_x").cast("double") == F.col("_vx")).join(ry, F.col("_y").cast("double") == F.col("_vy"))
    return weighted_pearson(j.select("_rx", "_ry", "_c").checkpoint(eager=True), "_rx", "_ry", "_c", with_p)


# ------------------------------------------------------------- AGG12
def histogram(df: DataFrame, col: str = "final_score", width: float = 5.0, bins: int = 20) -> DataFrame:
    """Fixed-width bins over [0, width*bins]; empty bins appear with 0."""
    spark = df.sparkSession
    b = F.least(F.greatest(F.floor(F.col(col) / F.lit(width)).cast("int"), F.lit(0)), F.lit(bins - 1))
    counts = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    allb = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (allb.join(counts, "bin", "left")
                .select("bin", (F.col("bin") * F.lit(width)).alias("lo"),
                        ((F.col("bin") + 1) * F.lit(width)).alias("hi"),
                        F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# ------------------------------------------------------------- AGG16
def trend_line(df: DataFrame, x: str, y: str, points: int = 50) -> DataFrame:
    """Least-squares line and `points` evenly spaced (x, y_hat) pairs."""
    v = valid_pairs(df, x, y)
    fit = v.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))
    pts = fit.select("slope", "intercept", "_lo", "_hi",
                     F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    xv = F.when(F.col("i") == points - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("i") * step)
    return pts.select("i", "slope", "intercept", xv.alias("x"),
                      (F.col("slope") * xv + F.col("intercept")).alias("y_hat"))


# ------------------------------------------------------------- AGG17/18
def classifier_metrics(df: DataFrame, y: str = "y_true", pred: str = "y_pred", with_n: bool = False) -> DataFrame:
    """precision, recall, F1 (0 on zero division), accuracy, each round 4; `with_n` adds the number of rows."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col(y) == 1) & (F.col(pred) == 1)).alias("tp"),
               F.count_if((F.col(y) == 0) & (F.col(pred) == 1)).alias("fp"),
               F.count_if((F.col(y) == 1) & (F.col(pred) == 0)).alias("fn"),
               F.count_if((F.col(y) == 0) & (F.col(pred) == 0)).alias("tn"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    c = c.withColumn("_p", prec.cast("double")).withColumn("_r", rec.cast("double"))
    f1 = F.when(F.col("_p") + F.col("_r") == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
    acc = F.coalesce(F.try_divide(F.col("tp") + F.col("tn"),
                                  F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return c.select("tp", "fp", "fn", "tn",
                    pyround(F.col("_p"), 4).alias("precision"), pyround(F.col("_r"), 4).alias("recall"),
                    pyround(f1, 4).alias("f1"), pyround(acc.cast("double"), 4).alias("accuracy"), *(["n"] if with_n else []))


def confusion(df: DataFrame, y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """2x2 confusion matrix; all four cells present."""
    spark = df.sparkSession
    cells = df.groupBy(F.col(y).cast("int").alias("y_true")).pivot(pred, [0, 1]).agg(F.count(F.lit(1)))
    ys = spark.range(2).select(F.col("id").cast("int").alias("y_true"))
    out = ys.join(cells, "y_true", "left")
    return out.select("y_true", F.coalesce(F.col("0"), F.lit(0)).cast("long").alias("pred_0"),
                      F.coalesce(F.col("1"), F.lit(0)).cast("long").alias("pred_1"))
