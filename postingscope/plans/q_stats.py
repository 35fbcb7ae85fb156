"""Queries: statistics and classifier quality (AGG10, AGG12-14, AGG16-18,
FLT6, JOB6, ML4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingscope.functions.features import pyround
from postingscope.operators import scoring as SC
from postingscope.operators import stats as ST
from postingscope.plans import sqlgen as S
from postingscope.plans.catalog import register, with_
from postingscope.plans.marks import MARKED_CTES, marked_postings
from postingscope.plans.q_scoring import SCORES_CTES, noun_table, scores
from postingscope.sources import driver as D


def r6(c):
    return pyround(c, 9)


@register("agg10_score_summary", SCORES_CTES + f"""
SELECT count(final_score) AS n, {S.rnd('avg(final_score)', 9)} AS mean, {S.rnd('stddev_pop(final_score)', 9)} AS std,
       min(final_score) AS min, {S.rnd('quantile_cont(final_score, 0.25)', 9)} AS p25,
       {S.rnd('quantile_cont(final_score, 0.5)', 9)} AS median, {S.rnd('quantile_cont(final_score, 0.75)', 9)} AS p75,
       max(final_score) AS max, count(*) FILTER (WHERE final_score >= 10.0) AS high_risk
FROM scores""")
def agg10_score_summary(spark, sf):
    s = ST.score_summary(scores(spark, sf), "final_score", high=10.0)
    return s.select("n", r6("mean").alias("mean"), r6("std").alias("std"), "min", r6("p25").alias("p25"),
                    r6("median").alias("median"), r6("p75").alias("p75"), "max", "high_risk")


@register("agg12_histogram", SCORES_CTES + """
SELECT b.bin, b.bin * 5.0 AS lo, (b.bin + 1) * 5.0 AS hi, coalesce(c.count, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b
LEFT JOIN (SELECT CAST(least(greatest(floor(final_score / 5.0), 0), 19) AS INTEGER) AS bin, count(*) AS count
           FROM scores GROUP BY 1) c USING (bin)""")
def agg12_histogram(spark, sf):
    return ST.histogram(scores(spark, sf), "final_score")


@register("agg13_pearson", SCORES_CTES + f"""
SELECT CASE WHEN count(*) < 2 OR min(bert_score) = max(bert_score) OR min(sentiment_score) = max(sentiment_score)
            THEN 0.0 ELSE {S.rnd('covar_pop(bert_score, sentiment_score) / (stddev_pop(bert_score) * stddev_pop(sentiment_score))', 9)} END AS r,
       count(*) AS n
FROM scores WHERE bert_score IS NOT NULL AND sentiment_score IS NOT NULL""")
def agg13_pearson(spark, sf):
    """AGG13 + FLT6: probability vs company sentiment per posting."""
    p = ST.pearson(scores(spark, sf), "bert_score", "sentiment_score", with_p=False)
    return p.select(r6("r").alias("r"), "n")


SPEARMAN_SQL = SCORES_CTES + f""",
v AS (SELECT bert_score AS x, sentiment_score AS y FROM scores WHERE bert_score IS NOT NULL AND sentiment_score IS NOT NULL),
rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
              rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v)
SELECT {S.rnd('covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry))', 9)} AS rho, count(*) AS n FROM rk"""


@register("agg14_spearman", SPEARMAN_SQL)
def agg14_spearman(spark, sf):
    p = ST.spearman(scores(spark, sf), "bert_score", "sentiment_score", with_p=False)
    return p.select(r6("r").alias("rho"), "n")


def p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation: with t = sqrt(n - 2) tan(a) its tail is an integral of cos(a) ** (n - 3), taken by Simpson's rule."""
    return f"""(SELECT CASE WHEN {n} < 3 THEN 1.0 WHEN abs({r}) >= 1 THEN 0.0 ELSE
      2 * exp(lgamma(({n} - 1) / 2.0) - lgamma(({n} - 2) / 2.0)) / sqrt(pi()) * (pi() / 2 - asin(abs({r}))) / 4000 / 3 *
      sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
          * pow(greatest(0.0, cos(asin(abs({r})) + i * (pi() / 2 - asin(abs({r}))) / 4000)), {n} - 3)) END FROM range(4001) t(i))"""


@register("job6_validate_scores", SCORES_CTES + f""",
v AS (SELECT bert_score AS x, sentiment_score AS y FROM scores WHERE bert_score IS NOT NULL AND sentiment_score IS NOT NULL),
rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
              rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v),
r AS (SELECT (SELECT covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) FROM v) AS pr, (SELECT covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) FROM rk) AS sr,
             (SELECT count(*) FROM v) AS n)
SELECT {S.rnd('pr', 9)} AS pearson_r, {S.rnd(p_sql('pr', 'n'), 6)} AS pearson_p, n, {S.rnd('sr', 9)} AS spearman_r,
       {S.rnd(p_sql('sr', 'n'), 6)} AS spearman_p FROM r""")
def job6_validate_scores(spark, sf):
    """JOB6: Pearson and Spearman with two-sided p-values (Student t)."""
    s = scores(spark, sf).select("bert_score", "sentiment_score").checkpoint(eager=True)
    p = ST.pearson(s, "bert_score", "sentiment_score")
    q = ST.spearman(s, "bert_score", "sentiment_score")
    return p.select(r6("r").alias("pearson_r"), pyround(F.col("p"), 6).alias("pearson_p"), "n").crossJoin(
        q.select(r6("r").alias("spearman_r"), pyround(F.col("p"), 6).alias("spearman_p")))


@register("agg16_trend_line", SCORES_CTES + f""",
fit AS (SELECT regr_slope(final_score, bert_score) AS m, regr_intercept(final_score, bert_score) AS b,
               min(bert_score) AS lo, max(bert_score) AS hi FROM scores
        WHERE bert_score IS NOT NULL AND final_score IS NOT NULL),
pts AS (SELECT range AS i, m, b, CASE WHEN range = 49 THEN hi ELSE lo + range * ((hi - lo) / 49.0) END AS x
        FROM fit, range(50))
SELECT i, {S.rnd('m', 9)} AS slope, {S.rnd('b', 9)} AS intercept, {S.rnd('x', 9)} AS x,
       {S.rnd('m * x + b', 9)} AS y_hat FROM pts""")
def agg16_trend_line(spark, sf):
    t = ST.trend_line(scores(spark, sf), "bert_score", "final_score")
    return t.select(F.col("i").cast("long").alias("i"), r6("slope").alias("slope"),
                    r6("intercept").alias("intercept"), r6("x").alias("x"), r6("y_hat").alias("y_hat"))


PRED_CUT = 0.02


def _labelled(spark, sf):
    """labels joined to postings features: y_true = 1 - quality, prediction =
    rule probability above a cut."""
    lab = D.table(spark, sf, "labels")
    f = SC.posting_features(marked_postings(spark, sf), D.DATA_GENERIC, D.DATA_URGENT, noun_table(spark, sf), D.DATA_VAGUE)
    j = lab.join(f, lab["doc_id"] == f["id"])
    return j.select("doc_id", (F.lit(1) - F.col("quality")).alias("y_true"),
                    F.when(F.col("bert_score") > PRED_CUT, 1).otherwise(0).alias("y_pred"))


LAB = f"""
lab AS (SELECT l.doc_id, 1 - l.quality AS y_true, CASE WHEN f.bert_score > {PRED_CUT} THEN 1 ELSE 0 END AS y_pred
        FROM labels l JOIN features f ON l.doc_id = f.id),
cnt AS (SELECT count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
               count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
               count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn,
               count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn FROM lab),
met AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM cnt)"""
LAB_CTES = with_(*MARKED_CTES, S.vague_sql(D.DATA_VAGUE), S.features_sql("scored_postings", D.DATA_GENERIC, D.DATA_URGENT, vague=True), LAB)

METRICS_SELECT = f"""tp, fp, fn, tn, {S.rnd('p', 4)} AS precision, {S.rnd('r', 4)} AS recall,
       {S.rnd('CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END', 4)} AS f1,
       {S.rnd('coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0)', 4)} AS accuracy"""


@register("agg17_classifier_metrics", LAB_CTES + f"SELECT {METRICS_SELECT} FROM met")
def agg17_classifier_metrics(spark, sf):
    return ST.classifier_metrics(_labelled(spark, sf))


@register("agg18_confusion", LAB_CTES + """
SELECT y.y_true, count(l.doc_id) FILTER (WHERE l.y_pred = 0) AS pred_0, count(l.doc_id) FILTER (WHERE l.y_pred = 1) AS pred_1
FROM (SELECT CAST(range AS INTEGER) AS y_true FROM range(2)) y LEFT JOIN lab l ON l.y_true = y.y_true
GROUP BY y.y_true""")
def agg18_confusion(spark, sf):
    return ST.confusion(_labelled(spark, sf))


@register("ml4_evaluate", LAB_CTES + f"""
SELECT {METRICS_SELECT}, (SELECT count(*) FROM lab) AS n FROM met""")
def ml4_evaluate(spark, sf):
    """ML4: metrics and matrix of one labelled set (matrix cells as tp..tn)."""
    return ST.classifier_metrics(_labelled(spark, sf), with_n=True)
