"""Queries: posting features, score, top-k (FEAT*, SCORE1, JOIN4, JOB5, TOP1, ML1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingscope import lexicons as L
from postingscope.functions import features as FX
from postingscope.operators import scoring as SC
from postingscope.operators.sentiment import sentiment_by_company
from postingscope.plans import sqlgen as S
from postingscope.plans.catalog import as_of, register, with_
from postingscope.plans.marks import INGEST_CTES, MARKED_CTES, marked_postings, repost_marks
from postingscope.sources import driver as D


def noun_table(spark, sf):
    """A noun dictionary derived from the benchmark passages: every distinct
    token of three or more characters, lemma without a plural -s, and a
    rule-based proper-noun flag."""
    from postingscope.functions.text import WORD
    b = D.table(spark, sf, "benchmark")
    t = b.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)).alias("token")).distinct()
    t = t.filter(F.length("token") >= 3)
    lemma = F.when(F.length("token") > 3, F.regexp_replace("token", "s$", "")).otherwise(F.col("token"))
    return t.select("token", lemma.alias("lemma"), (F.length("token") % 7 == 0).alias("is_proper"))


def scores(spark, sf, weights=None):
    """Scores of all postings with the noun table and the detector's repost marks."""
    sent = sentiment_by_company(D.reviews(spark, sf), as_of(), D.DATA_FRUSTRATION)
    return SC.score_postings(D.postings(spark, sf), sent, as_of(), weights=weights, generic=D.DATA_GENERIC, urgent=D.DATA_URGENT,
                             nouns=noun_table(spark, sf), vague=D.DATA_VAGUE, marks=repost_marks(spark, sf)).drop("computed_at")


SCORES_CTES = with_(*MARKED_CTES, S.REVIEWS, S.review_scores_sql(D.DATA_FRUSTRATION),
                    S.sentiment_sql(D.DATA_FRUSTRATION), S.vague_sql(D.DATA_VAGUE),
                    S.features_sql("scored_postings", D.DATA_GENERIC, D.DATA_URGENT, vague=True), S.scores_sql())

SCORE_COLS = ("job_posting_id, genericness_score, vagueness_score, repost_score, urgency_score, "
              "bert_score, sentiment_score, final_score")


@register("feat1_genericness", with_(S.POSTINGS) +
          f"SELECT id, {S.genericness('description', D.DATA_GENERIC)} AS genericness_score, "
          f"{S.words('description')} AS n_words, {S.hits('description', D.DATA_GENERIC)} AS hits "
          "FROM postings")
def feat1_genericness(spark, sf):
    from postingscope.functions.text import word_count
    p = D.postings(spark, sf)
    return p.select("id", FX.genericness("description", D.DATA_GENERIC).alias("genericness_score"),
                    word_count("description").cast("long").alias("n_words"),
                    FX.phrase_hits("description", D.DATA_GENERIC).cast("long").alias("hits"))


@register("feat2_urgency", with_(S.POSTINGS) +
          f"SELECT id, {S.urgency('description', D.DATA_URGENT)} AS urgency_score FROM postings")
def feat2_urgency(spark, sf):
    return D.postings(spark, sf).select(
        "id", FX.urgency("description", D.DATA_URGENT).alias("urgency_score"))


# FEAT4 needs reposts: the repost ids come from the repost detector's output
# (WIN1) over all postings, with and without a repost count (JOIN10).
def _reposts(spark, sf):
    from postingscope.operators.reposts import long_enough, mark_reposts
    inc = D.incoming_postings(spark, sf, _eligible=long_enough())
    return mark_reposts(inc, None, threshold=D.DATA_THRESHOLD)


FEAT4_SQL = with_(S.POSTINGS, S.INCOMING, "inc AS (SELECT * FROM incoming), kept AS (SELECT * FROM incoming), st AS (SELECT * FROM incoming WHERE false),"
                  + INGEST_CTES[-1][INGEST_CTES[-1].index("\nallrows AS ("):]) + f""",
counted AS (SELECT repost_of_id AS original_id, count(*) AS n FROM marked WHERE repost_of_id IS NOT NULL GROUP BY repost_of_id)
SELECT m.id, {S.repost('m.repost_of_id')} AS repost_score,
       CASE WHEN m.repost_of_id IS NULL OR m.repost_of_id = 0 THEN 0.0 ELSE {S.clamp01r4('least(1.0, 0.4 + coalesce(c.n, 1) * 0.15)')} END AS repost_score_counted
FROM marked m LEFT JOIN counted c ON m.repost_of_id = c.original_id"""


@register("feat4_repost_score", FEAT4_SQL)
def feat4_repost_score(spark, sf):
    from postingscope.operators.dedupe import repost_counts
    m = _reposts(spark, sf)
    cnt = repost_counts(m)
    j = m.join(cnt, m["repost_of_id"] == cnt["original_id"], "left")
    return j.select("id", FX.repost_score("repost_of_id").alias("repost_score"),
                    FX.repost_score("repost_of_id", "repost_count").alias("repost_score_counted"))


@register("feat5_rule_probability", with_(*MARKED_CTES, S.features_sql("scored_postings", D.DATA_GENERIC,
                                                                        D.DATA_URGENT)) +
          "SELECT id, bert_score, CASE WHEN (genericness_score + vagueness_score + urgency_score) / 3.0 "
          "> 0.7 THEN 1 ELSE 0 END AS bootstrap_label FROM features")
def feat5_rule_probability(spark, sf):
    f = SC.posting_features(marked_postings(spark, sf), D.DATA_GENERIC, D.DATA_URGENT)
    return f.select("id", "bert_score",
                    FX.bootstrap_label("genericness_score", "vagueness_score", "urgency_score")
                    .alias("bootstrap_label"))


@register("feat6_bootstrap_label", with_(S.POSTINGS, S.features_sql("postings", D.DATA_GENERIC,
                                                                    D.DATA_URGENT)) +
          "SELECT id, CASE WHEN (genericness_score + vagueness_score + urgency_score) / 3.0 > 0.2 "
          "THEN 1 ELSE 0 END AS label_at_020 FROM features")
def feat6_bootstrap_label(spark, sf):
    f = SC.posting_features(D.postings(spark, sf), D.DATA_GENERIC, D.DATA_URGENT)
    return f.select("id", FX.bootstrap_label("genericness_score", "vagueness_score",
                                             "urgency_score", cut=0.2).alias("label_at_020"))


PARTIAL = {"genericness": 0.5, "urgency": 0.25}


@register("score1_final_score_weights", SCORES_CTES.replace(S.scores_sql(), S.scores_sql(PARTIAL)) +
          "SELECT job_posting_id, final_score FROM scores")
def score1_final_score_weights(spark, sf):
    """SCORE1 with a partial weight dict (defaults fill the numerator only)."""
    return scores(spark, sf, PARTIAL).select("job_posting_id", "final_score")


@register("join4_with_sentiment", SCORES_CTES + "SELECT job_posting_id, sentiment_score FROM scores")
def join4_with_sentiment(spark, sf):
    return scores(spark, sf).select("job_posting_id", "sentiment_score")


@register("top1_extremes", SCORES_CTES + f"""
SELECT * FROM (SELECT 'top' AS side, row_number() OVER (ORDER BY final_score DESC, job_posting_id) AS rank,
                      job_posting_id, final_score FROM scores) WHERE rank <= 5
UNION ALL
SELECT * FROM (SELECT 'bottom' AS side, row_number() OVER (ORDER BY final_score, job_posting_id) AS rank,
                      job_posting_id, final_score FROM scores) WHERE rank <= 5""")
def top1_extremes(spark, sf):
    """TOP1 + WIN3: labelled HIGH/LOW ranks 1..5 (top-k is the feature)."""
    from pyspark.sql import Window
    # two columns of every score, written once: top and bottom read it
    s = scores(spark, sf).select("job_posting_id", "final_score").checkpoint(eager=True)
    top, bottom = SC.extremes(s, 5)
    wt = Window.orderBy(F.col("final_score").desc(), "job_posting_id")
    wb = Window.orderBy(F.col("final_score").asc(), "job_posting_id")
    t = top.select(F.lit("top").alias("side"), F.row_number().over(wt).cast("long").alias("rank"),
                   "job_posting_id", "final_score")
    b = bottom.select(F.lit("bottom").alias("side"), F.row_number().over(wb).cast("long").alias("rank"),
                      "job_posting_id", "final_score")
    return t.unionByName(b)


@register("top1_breakdown", SCORES_CTES + f"""
SELECT side, rank, job_posting_id, genericness_score, vagueness_score, repost_score, urgency_score, bert_score, sentiment_score, final_score,
       {', '.join(f'{S.dbl(v)} AS weight_{k}' for k, v in L.DEFAULT_WEIGHTS.items())}
FROM (SELECT 'top' AS side, row_number() OVER (ORDER BY final_score DESC, job_posting_id) AS rank, * FROM scores
      UNION ALL SELECT 'bottom', row_number() OVER (ORDER BY final_score, job_posting_id), * FROM scores) WHERE rank <= 5""")
def top1_breakdown(spark, sf):
    """TOP1 with the sub-scores and weights that make each score."""
    return SC.extremes_report(scores(spark, sf).checkpoint(eager=True), 5)


@register("ml1_training_set", with_(*MARKED_CTES, S.vague_sql(D.DATA_VAGUE),
                                   S.features_sql("scored_postings", D.DATA_GENERIC, D.DATA_URGENT, vague=True)) + f"""
SELECT id, company, genericness_score, vagueness_score, repost_score, urgency_score,
       label AS bootstrap_ghost_label, label AS manually_verified_label
FROM (SELECT *, CASE WHEN (genericness_score + vagueness_score + urgency_score) / 3.0 > {D.DATA_LABEL_CUT} THEN 1 ELSE 0 END
                AS label FROM features)""")
def ml1_training_set(spark, sf):
    """ML1 with a cut that postings of the benchmark tables reach."""
    t = SC.training_set(marked_postings(spark, sf), D.DATA_GENERIC, D.DATA_URGENT, noun_table(spark, sf), D.DATA_VAGUE,
                        cut=D.DATA_LABEL_CUT)
    return t.drop("title", "description")


def _train_set(spark, sf):
    """Verified labels: y = 1 - quality for the labelled documents."""
    lab = D.table(spark, sf, "labels").select(F.col("doc_id").alias("id"),
                                             (F.lit(1) - F.col("quality")).alias("manually_verified_label"))
    t = SC.training_set(D.postings(spark, sf), D.DATA_GENERIC, D.DATA_URGENT).drop("manually_verified_label")
    return t.join(lab, "id")


@register("ml2_train_predict", None)
def ml2_train_predict(spark, sf):
    """ML2 + ML3: fit TF-IDF + logistic regression on the labelled postings,
    score every posting (probability in [0, 1], 4 decimals)."""
    from postingscope.operators.ml import predict, train
    model = train(_train_set(spark, sf), "description", "manually_verified_label", num_features=1 << 14)
    f = SC.posting_features(D.postings(spark, sf), D.DATA_GENERIC, D.DATA_URGENT)
    return predict(f, model, text="_text", out="bert_score").select("id", "bert_score")


@register("ml5_embed", None)
def ml5_embed(spark, sf):
    """ML5: hashed TF-IDF embeddings of every posting (norm reported)."""
    from postingscope.operators.ml import embed
    e = embed(D.postings(spark, sf).select("id", "description"), dims=1 << 10)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return e.select("id", F.size("embedding").alias("dims"), FX.pyround(norm, 6).alias("norm"))


@register("job5_score_with_model", None)
def job5_score_with_model(spark, sf):
    """JOB5 with a trained model (ML3) instead of the rule probability."""
    from postingscope.operators.ml import train
    model = train(_train_set(spark, sf), "description", "manually_verified_label", num_features=1 << 14)
    p = D.postings(spark, sf)
    sent = sentiment_by_company(D.reviews(spark, sf), as_of(), D.DATA_FRUSTRATION)
    return SC.score_postings(p, sent, as_of(), generic=D.DATA_GENERIC, urgent=D.DATA_URGENT,
                             model=model).drop("computed_at")


VAGUE_SQL = with_(S.POSTINGS, S.vague_sql(D.DATA_VAGUE)) + """
SELECT id, coalesce(vagueness_score, 0.0) AS vagueness_score FROM postings LEFT JOIN vg USING (id)"""


@register("feat3_vagueness_nouns", VAGUE_SQL)
def feat3_vagueness_nouns(spark, sf):
    """FEAT3 with a noun table (the tagger-less default is 0.0 everywhere)."""
    p = D.postings(spark, sf).withColumn("_text", F.col("description"))
    return SC.vagueness(p, noun_table(spark, sf), vague=D.DATA_VAGUE).select("id", "vagueness_score")


@register("join8_match_phrases", with_(S.POSTINGS) + "SELECT p.id, l.phrase FROM postings p, (VALUES " +
          ", ".join(f"('{x}')" for x in D.DATA_GENERIC + D.DATA_URGENT) +
          ") l(phrase) WHERE contains(lower(p.description), l.phrase)")
def join8_match_phrases(spark, sf):
    """JOIN8: postings x a literal list of phrases, as an expression."""
    from postingscope.operators.lexicon import match_phrase_list
    return match_phrase_list(D.postings(spark, sf), D.DATA_GENERIC + D.DATA_URGENT, text="description")


@register("join8_match_phrases_trigram", with_(S.POSTINGS) + "SELECT p.id, l.phrase FROM postings p, (VALUES " +
          ", ".join(f"('{x}')" for x in D.DATA_GENERIC + D.DATA_URGENT) +
          ") l(phrase) WHERE contains(lower(p.description), l.phrase)")
def join8_match_phrases_trigram(spark, sf):
    """JOIN8 through the trigram equi-join path used for large lexicons."""
    from postingscope.operators.lexicon import match_phrases
    lex = spark.createDataFrame([(x,) for x in D.DATA_GENERIC + D.DATA_URGENT], "phrase string")
    return match_phrases(D.postings(spark, sf), lex, text="description")


@register("win3_rank_labels", SCORES_CTES + """
SELECT job_posting_id, 'HIGH #' || CAST(row_number() OVER (ORDER BY final_score DESC, job_posting_id) AS VARCHAR) AS rank_label
FROM scores ORDER BY final_score DESC, job_posting_id LIMIT 5""")
def win3_rank_labels(spark, sf):
    """WIN3: 'HIGH #1'..'HIGH #5' over the top-5 postings."""
    from postingscope.operators.windows import rank_labels
    top, _ = SC.extremes(scores(spark, sf), 5)
    return rank_labels(top, "HIGH").select("job_posting_id", "rank_label")
