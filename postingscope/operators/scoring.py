"""Posting features and the 0-100 score (FEAT1-6, FEAT3, ML3 fallback,
JOIN4, SCORE1, ML1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postingscope import lexicons as L
from postingscope.functions.features import (bootstrap_label, clamp01r4, final_score,
                                             genericness, repost_score, rule_probability,
                                             urgency)
from postingscope.functions.text import WORD, best_text


BROADCAST_NOUNS = 1_000_000     # a noun table of at most so many rows is sent to every executor


def noun_share(df: DataFrame, nouns: DataFrame, text: str = "_text", key: str = "id", vague=None) -> DataFrame:
    """(_k, _n, _v): nouns and vague nouns of every text that has a noun.

    With a noun table `(token, lemma, is_proper)`: each text's tokens are paired with their
    predecessor inside the array (no shuffle), exploded, and joined to the noun table, which is counted first:
    up to BROADCAST_NOUNS rows it is broadcast, so that tokens are never shuffled; beyond, equal tokens of a
    text are counted before they are.  A token directly preceded by a number counts as numerically modified.
    """
    vague = [v.lower() for v in (L.VAGUE_NOUNS if vague is None else vague)]
    toks = df.select(F.col(key).alias("_k"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), 0).alias("_toks"))
    # each token beside its predecessor: zip the array with itself shifted by
    # one (built-in array functions, no lambda), then explode
    prev = F.when(F.size("_toks") > 0, F.concat(F.array(F.lit(None).cast("string")), F.slice("_toks", F.lit(1), F.size("_toks") - 1)))
    ex = toks.withColumn("_prev", prev).select("_k", F.explode(F.arrays_zip("_toks", "_prev")).alias("_t"))
    ex = ex.select("_k", F.col("_t._toks").alias("token"), F.coalesce(F.col("_t._prev").rlike("^[0-9]+$"), F.lit(False)).alias("_num"))
    is_vague = (F.lower("lemma").isin(vague) & ~F.col("is_proper").cast("boolean")).alias("_vague")
    nn = nouns.select(F.lower("token").alias("token"), is_vague).groupBy("token").agg(F.first("_vague").alias("_vague")).checkpoint(eager=True)
    if nn.count() <= BROADCAST_NOUNS:
        j = ex.join(F.broadcast(nn), "token").withColumn("_times", F.lit(1))
    else:
        j = ex.groupBy("_k", "token", "_num").agg(F.count(F.lit(1)).alias("_times")).join(nn, "token")
    return j.groupBy("_k").agg(F.sum("_times").alias("_n"), F.sum(F.when(F.col("_vague") & ~F.col("_num"), F.col("_times")).otherwise(0)).alias("_v"))


def vagueness(df: DataFrame, nouns: DataFrame | None = None, text: str = "_text",
              key: str = "id", vague=None) -> DataFrame:
    """FEAT3: share of nouns that are vague common nouns without a numeric modifier.

    `nouns=None` is the tagger-less path: no token is tagged as a noun, so the score is 0.0.
    """
    if nouns is None:
        return df.withColumn("vagueness_score", F.lit(0.0))
    share = noun_share(df, nouns, text, key, vague)
    out = df.join(share, df[key] == share["_k"], "left").drop("_k")
    score = F.when(F.coalesce("_n", F.lit(0)) == 0, F.lit(0.0)).otherwise(
        clamp01r4(F.col("_v") / F.col("_n")))
    return out.withColumn("vagueness_score", score).drop("_n", "_v")


def posting_features(postings: DataFrame, generic=None, urgent=None,
                     nouns: DataFrame | None = None, vague=None, marks: DataFrame | None = None) -> DataFrame:
    """FEAT1-5 on best text: genericness, vagueness, repost, urgency and the
    rule probability used when no trained model is supplied.

    The lowered text, its word count and the phrase hit counts are staged as
    columns: each is consumed more than once, so the optimizer keeps each in
    its own projection and every text is lowered and scanned once, all in
    whole-stage codegen.  The nouns, which need a join, come last: where the
    result needs no text, only numbers go through it.  So do repost marks
    that are given apart (`marks`: id, repost_of_id).
    """
    from postingscope.functions.features import density_of, phrase_hits
    from postingscope.functions.text import is_blank
    g_lex = L.GENERIC_BUZZWORDS if generic is None else generic
    u_lex = L.URGENCY_PHRASES if urgent is None else urgent
    df = postings.withColumn("_text", best_text("cleaned_text", "description"))
    df = df.withColumn("_lt", F.lower(F.col("_text")))
    df = (df.withColumn("_words", F.coalesce(F.regexp_count(F.col("_lt"), F.lit(WORD)), F.lit(0)))
            .withColumn("_gh", phrase_hits("_lt", g_lex, lowered=True))
            .withColumn("_uh", phrase_hits("_lt", u_lex, lowered=True))
            .withColumn("_some", F.when(~is_blank("_text"), F.lit("x"))))
    cnt = "repost_count" if "repost_count" in postings.columns else None
    df = (df.withColumn("genericness_score", density_of("_gh", "_words", L.GENERICNESS_SCALE))
            .withColumn("urgency_score", density_of("_uh", "_words", L.URGENCY_SCALE))
            .drop("_lt", "_gh", "_uh", "_words"))
    df = vagueness(df, nouns, vague=vague)
    if marks is not None:
        df = df.drop("repost_of_id").join(marks.select("id", "repost_of_id"), "id", "left")
    df = df.withColumn("repost_score", repost_score("repost_of_id", cnt))
    return df.withColumn("bert_score", rule_probability(
        "genericness_score", "vagueness_score", "repost_score", "urgency_score", "_some")).drop("_some")


def with_sentiment(postings: DataFrame, sentiment: DataFrame) -> DataFrame:
    """JOIN4: attach the company score (0.0 when the company has none).

    A plain left join: AQE turns it into a broadcast join when the
    per-company table is small at runtime, and splits a hot company's
    partition (skew join) otherwise.
    """
    s = sentiment.select("company", F.col("score").alias("sentiment_score"))
    return (postings.join(s, "company", "left")
                    .withColumn("sentiment_score", F.coalesce("sentiment_score", F.lit(0.0))))


SCORE_COLUMNS = ["genericness_score", "vagueness_score", "repost_score", "urgency_score",
                 "bert_score", "sentiment_score", "final_score"]


def score_postings(postings: DataFrame, sentiment: DataFrame, as_of, weights=None,
                   generic=None, urgent=None, nouns: DataFrame | None = None,
                   model=None, vague=None, marks: DataFrame | None = None) -> DataFrame:
    """JOB5 core: one score row per posting (keyed by job_posting_id)."""
    feats = posting_features(postings, generic, urgent, nouns, vague, marks)
    if model is not None:
        from postingscope.operators.ml import predict
        feats = predict(feats, model, text="_text", out="bert_score")
    df = with_sentiment(feats, sentiment)
    df = df.withColumn("final_score", final_score(
        "genericness_score", "vagueness_score", "repost_score", "urgency_score",
        "bert_score", "sentiment_score", weights))
    return df.select(F.col("id").alias("job_posting_id"), *SCORE_COLUMNS,
                     as_of.alias("computed_at"))


def training_set(postings: DataFrame, generic=None, urgent=None,
                 nouns: DataFrame | None = None, vague=None, **label) -> DataFrame:
    """ML1: features plus bootstrap label (`cut` in `label`); the verified label starts equal."""
    f = posting_features(postings, generic, urgent, nouns, vague)
    lab = bootstrap_label("genericness_score", "vagueness_score", "urgency_score", **label)
    return f.select("id", "company", "title", F.col("_text").alias("description"),
                    "genericness_score", "vagueness_score", "repost_score", "urgency_score",
                    lab.alias("bootstrap_ghost_label"), lab.alias("manually_verified_label"))


def extremes(scored: DataFrame, n: int = 5, score: str = "final_score",
             key: str = "job_posting_id") -> tuple[DataFrame, DataFrame]:
    """TOP1: n highest and n lowest (ascending) by score, id as tie-break.

    `orderBy(...).limit(n)` plans as TakeOrderedAndProject: a per-partition
    top-n heap and a final merge of n x partitions rows, no full sort.
    """
    top = scored.orderBy(F.col(score).desc(), F.col(key).asc()).limit(n)
    bottom = scored.orderBy(F.col(score).asc(), F.col(key).asc()).limit(n)
    return top, bottom


def extremes_report(scored: DataFrame, n: int = 5, weights=None) -> DataFrame:
    """TOP1 with WIN3: (side, rank, id, final_score, sub-scores and the weight of each) of the n highest and n lowest scores."""
    w = {**L.DEFAULT_WEIGHTS, **(weights or {})}
    top, bottom = extremes(scored, n)
    sides = []
    for side, rows, order in (("top", top, F.col("final_score").desc()), ("bottom", bottom, F.col("final_score").asc())):
        place = F.row_number().over(Window.orderBy(order, F.col("job_posting_id"))).cast("long")      # over n rows
        sides.append(rows.select(F.lit(side).alias("side"), place.alias("rank"), "job_posting_id", *SCORE_COLUMNS,
                                 *[F.lit(float(v)).alias(f"weight_{k}") for k, v in w.items()]))
    return sides[0].unionByName(sides[1])
