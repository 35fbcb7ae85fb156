"""Review sentiment: per-review frustration and per-company recency-weighted
aggregates (SENT2, AGG3, AGG4, SET2, UPS2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope import lexicons as L
from postingscope.functions.features import (baseline_negativity, clamp01r4,
                                             frustration, recency_weight)
from postingscope.functions.text import WORD


def polarity(reviews: DataFrame, valence: DataFrame | None = None,
             text: str = "text", key: str = "id", alpha: float = 15.0) -> DataFrame:
    """SENT2: add `compound` and `neg` per review.

    Without a valence table the analyzer is absent and both are null (the
    baseline then contributes 0).  With a `(token, valence)` table: tokens are
    exploded, joined to the lexicon (a shuffle join; AQE broadcasts the
    lexicon at runtime when it is small), and summed per review:
    compound = s / sqrt(s^2 + alpha), neg = |negative sum| / sum of |valences|
    (the published normalisation, without negation/booster heuristics).
    """
    if valence is None:
        return reviews.withColumn("compound", F.lit(None).cast("double")) \
                      .withColumn("neg", F.lit(None).cast("double"))
    toks = reviews.select(F.col(key).alias("_k"),
                          F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 0))
                          .alias("token"))
    lex = valence.select(F.lower("token").alias("token"), F.col("valence").cast("double"))
    scored = (toks.join(lex, "token")
              .groupBy("_k")
              .agg(F.sum("valence").alias("_s"),
                   F.sum(F.when(F.col("valence") < 0, -F.col("valence")).otherwise(0.0)).alias("_neg"),
                   F.sum(F.abs("valence")).alias("_tot")))
    scored = scored.select(
        "_k",
        (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(alpha))).alias("compound"),
        F.try_divide(F.col("_neg"), F.col("_tot")).alias("neg"))
    out = reviews.join(scored, reviews[key] == scored["_k"], "left").drop("_k")
    return out.withColumn("compound", F.coalesce("compound", F.lit(0.0))) \
              .withColumn("neg", F.coalesce("neg", F.lit(0.0)))


def review_scores(reviews: DataFrame, as_of, weighted_phrases=None,
                  valence: DataFrame | None = None, lam: float = L.DECAY_LAMBDA) -> DataFrame:
    """Per review: baseline negativity, frustration and recency weight."""
    from postingscope.functions.features import frustration_of, frustration_parts
    df = polarity(reviews, valence)
    m, s = frustration_parts(F.lower(F.col("text")), weighted_phrases, lowered=True)
    df = (df.withColumn("baseline", baseline_negativity("compound", "neg", "text"))
            .withColumn("_fm", m).withColumn("_fs", s))
    return (df.withColumn("frustration", frustration_of("_fm", "_fs", "baseline", "text"))
              .withColumn("weight", recency_weight("posted_at", "scraped_at", as_of, lam))
              .drop("_fm", "_fs"))


def sentiment_by_company(reviews: DataFrame, as_of, weighted_phrases=None,
                         valence: DataFrame | None = None,
                         lam: float = L.DECAY_LAMBDA) -> DataFrame:
    """AGG3: clamp01r4(sum(w*f)/sum(w)) and review count per company.

    A hash aggregate with map-side partial sums: a company holding a third
    of all reviews is pre-aggregated in every map task before the shuffle.
    """
    scored = review_scores(reviews, as_of, weighted_phrases, valence, lam)
    agg = scored.groupBy("company").agg(
        F.sum(F.col("weight") * F.col("frustration")).alias("_ws"),
        F.sum("weight").alias("_w"),
        F.count(F.lit(1)).alias("review_count"))
    agg = agg.withColumn("_ratio", F.try_divide(F.col("_ws"), F.col("_w")))
    score = F.coalesce(clamp01r4("_ratio"), F.lit(0.0))
    return agg.select("company", score.alias("score"), F.col("review_count").cast("int"))


def company_universe(reviews: DataFrame, postings: DataFrame) -> DataFrame:
    """SET2: distinct company names over reviews and postings."""
    return reviews.select("company").union(postings.select("company")).distinct()


def sentiment_all(reviews: DataFrame, postings: DataFrame, as_of, weighted_phrases=None,
                  valence: DataFrame | None = None, lam: float = L.DECAY_LAMBDA) -> DataFrame:
    """AGG4: every company seen anywhere; unreviewed companies score 0 with 0 reviews."""
    sent = sentiment_by_company(reviews, as_of, weighted_phrases, valence, lam)
    uni = company_universe(reviews, postings)
    return (uni.join(sent, "company", "left")
               .select("company",
                       F.coalesce("score", F.lit(0.0)).alias("score"),
                       F.coalesce("review_count", F.lit(0)).cast("int").alias("review_count"))
               .withColumn("computed_at", as_of))


def refresh_affected(new_reviews: DataFrame, reviews: DataFrame, as_of, weighted_phrases=None,
                     valence: DataFrame | None = None, lam: float = L.DECAY_LAMBDA) -> DataFrame:
    """UPS2: recompute sentiment only for companies touched by a load."""
    affected = new_reviews.select("company").distinct()
    touched = reviews.join(affected, "company", "left_semi")
    return (sentiment_by_company(touched, as_of, weighted_phrases, valence, lam)
            .withColumn("computed_at", as_of))
