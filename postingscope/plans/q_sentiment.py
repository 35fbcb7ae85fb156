"""Queries: review sentiment (SENT1-4, AGG3, AGG4, SET2, UPS2, JOB4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingscope.functions import features as FX
from postingscope.operators import sentiment as SE
from postingscope.plans import sqlgen as S
from postingscope.plans.catalog import as_of, register, with_
from postingscope.sources import driver as D

SENT_CTES = with_(S.REVIEWS, S.review_scores_sql(D.DATA_FRUSTRATION), S.sentiment_sql(D.DATA_FRUSTRATION))


@register("sent3_frustration", SENT_CTES +
          f"SELECT id, frustration, {S.rnd('weight', 9)} AS weight FROM review_scores")
def sent3_frustration(spark, sf):
    """SENT1 (no valence table -> baseline 0), SENT3 and SENT4 per review."""
    r = SE.review_scores(D.reviews(spark, sf), as_of(), D.DATA_FRUSTRATION)
    return r.select("id", "frustration", FX.pyround(F.col("weight"), 9).alias("weight"))


@register("sent1_baseline_negativity", with_(S.REVIEWS) + f"""
SELECT id, CASE WHEN {S.blank('text')} THEN 0.0 ELSE
  {S.clamp01r4("0.7 * ((1.0 - c) / 2.0) + 0.3 * n")} END AS baseline
FROM (SELECT *, (length(text) % 200) / 100.0 - 1.0 AS c, (length(text) % 37) / 36.0 AS n FROM reviews)""")
def sent1_baseline_negativity(spark, sf):
    """SENT1 blend over stand-in polarity columns derived from text length."""
    r = D.reviews(spark, sf)
    r = r.withColumn("c", (F.length("text") % 200) / F.lit(100.0) - F.lit(1.0)) \
         .withColumn("n", (F.length("text") % 37) / F.lit(36.0))
    return r.select("id", FX.baseline_negativity("c", "n", "text").alias("baseline"))


@register("sent4_recency_weight", with_(S.REVIEWS) +
          f"SELECT id, {S.rnd(f'exp(-0.03 * {S.elapsed_days('coalesce(posted_at, scraped_at)', S.AS_OF)})', 9)} "
          "AS weight FROM reviews")
def sent4_recency_weight(spark, sf):
    r = D.reviews(spark, sf)
    return r.select("id", FX.pyround(FX.recency_weight("posted_at", "scraped_at", as_of()), 9).alias("weight"))


@register("agg3_sentiment_by_company", SENT_CTES + "SELECT company, score, review_count FROM sentiment")
def agg3_sentiment_by_company(spark, sf):
    return SE.sentiment_by_company(D.reviews(spark, sf), as_of(), D.DATA_FRUSTRATION)


@register("set2_company_universe", with_(S.POSTINGS, S.INCOMING, S.REVIEWS) +
          "SELECT company FROM reviews UNION SELECT company FROM incoming")
def set2_company_universe(spark, sf):
    return SE.company_universe(D.reviews(spark, sf), D.incoming_postings(spark, sf))


@register("job4_company_sentiment", with_(S.POSTINGS, S.INCOMING, S.REVIEWS,
                                          S.review_scores_sql(D.DATA_FRUSTRATION),
                                          S.sentiment_sql(D.DATA_FRUSTRATION)) + """
SELECT u.company, coalesce(s.score, 0.0) AS score, CAST(coalesce(s.review_count, 0) AS INTEGER) AS review_count
FROM (SELECT company FROM reviews UNION SELECT company FROM incoming) u LEFT JOIN sentiment s USING (company)""")
def job4_company_sentiment(spark, sf):
    """JOB4 = AGG4: every company of reviews or postings (0 if unreviewed)."""
    out = SE.sentiment_all(D.reviews(spark, sf), D.incoming_postings(spark, sf), as_of(), D.DATA_FRUSTRATION)
    return out.drop("computed_at")


VALENCE_SQL = with_(S.REVIEWS) + f""",
lex AS (SELECT * FROM (VALUES ('the', 1.5), ('and', -0.8), ('of', 0.4), ('is', -1.2)) t(token, valence)),
tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM reviews),
agg AS (SELECT id, sum(valence) AS s, sum(CASE WHEN valence < 0 THEN -valence ELSE 0.0 END) AS neg,
               sum(abs(valence)) AS tot
        FROM tok JOIN lex USING (token) GROUP BY id)
SELECT r.id, {S.rnd('coalesce(a.s / sqrt(a.s * a.s + 15.0), 0.0)', 9)} AS compound,
       {S.rnd('coalesce(a.neg / nullif(a.tot, 0), 0.0)', 9)} AS neg
FROM reviews r LEFT JOIN agg a ON r.id = a.id"""


@register("sent2_polarity_valence", VALENCE_SQL)
def sent2_polarity_valence(spark, sf):
    """SENT2 with a small valence table (token, valence)."""
    lex = spark.createDataFrame([("the", 1.5), ("and", -0.8), ("of", 0.4), ("is", -1.2)],
                                "token string, valence double")
    p = SE.polarity(D.reviews(spark, sf), lex)
    return p.select("id", FX.pyround(F.col("compound"), 9).alias("compound"),
                    FX.pyround(F.col("neg"), 9).alias("neg"))
