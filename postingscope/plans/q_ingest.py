"""Queries: ingest, de-duplication, reposts, unions (JOIN6, JOIN7, WIN1,
WIN2, WIN4, JOIN10, AGG1, AGG2, SET1, SET3, META4, HASH1, JOB1, JOB2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postingscope.functions.features import pyround
from postingscope.operators import dedupe as DD
from postingscope.operators.sets import fallback_union, union_sources, with_defaults
from postingscope.operators.windows import first_k
from postingscope.plans import sqlgen as S
from postingscope.plans.catalog import as_of, register, with_
from postingscope.plans.marks import INGEST_CTES, arriving, ingest, split_at
from postingscope.plans.q_scoring import SCORE_COLS, SCORES_CTES, scores
from postingscope.sources import driver as D

REVIEW_CUT = "2024-01-20 00:00:00"


@register("join6_new_by_url", with_(*INGEST_CTES) +
          "SELECT id, 'kept' AS state FROM kept UNION ALL "
          "SELECT id, 'skipped' FROM inc WHERE id NOT IN (SELECT id FROM kept)")
def join6_new_by_url(spark, sf):
    inc, st = arriving(spark, sf)
    return DD.tag_by_url(inc.select("id", "url", "scraped_at"), st).select("id", "state")


@register("win1_mark_reposts", with_(*INGEST_CTES) +
          f"SELECT id, repost_of_id, {S.rnd('max_similarity', 4)} AS max_similarity, status FROM marked")
def win1_mark_reposts(spark, sf):
    marked, _ = ingest(spark, sf)
    return marked.select("id", "repost_of_id", pyround(F.col("max_similarity"), 4).alias("max_similarity"),
                         "status")


@register("join10_repost_counts", with_(*INGEST_CTES) +
          "SELECT repost_of_id AS original_id, count(*) AS repost_count FROM marked "
          "WHERE repost_of_id IS NOT NULL GROUP BY repost_of_id")
def join10_repost_counts(spark, sf):
    marked, _ = ingest(spark, sf)
    return DD.repost_counts(marked)


@register("job1_ingest_postings", with_(*INGEST_CTES) + """
SELECT company, count(*) AS total, count(*) FILTER (WHERE status = 'new') AS new,
       count(*) FILTER (WHERE status = 'repost') AS reposts,
       count(*) FILTER (WHERE status = 'skipped') AS skipped
FROM tagged GROUP BY ROLLUP (company)""")
def job1_ingest_postings(spark, sf):
    """JOB1 = META4 -> SET1 -> JOIN6 -> WIN1 -> AGG1 (stats per company + total); `job1_saved_postings` has the rows."""
    marked, tagged = ingest(spark, sf)
    skipped = tagged.filter("state = 'skipped'").select("company", F.lit("skipped").alias("status"))
    return DD.ingest_stats(marked.select("company", "status").unionByName(skipped))


@register("job1_saved_postings", with_(*INGEST_CTES) + f"""
SELECT k.id, k.company, k.title, k.source, strftime(k.posted_date, '%Y-%m-%d %H:%M:%S') AS posted_date,
       sha256(lower({S.strip("k.company")}) || ':' || lower({S.strip("k.title")}) || ':' ||
              {S.strip("substr(k.description, 1, 250)")}) AS content_hash, m.repost_of_id, m.status
FROM kept k JOIN marked m USING (id)""")
def job1_saved_postings(spark, sf):
    """JOB1's stored rows: META4 -> SET1 -> HASH1 -> JOIN6 -> WIN1."""
    from postingscope.functions.text import content_hash
    extra = ["title", "source", "posted_date", content_hash("company", "title", "description").alias("content_hash")]
    marked, tagged = ingest(spark, sf, extra=extra)
    rows = tagged.filter("state = 'kept'").join(marked.drop("company"), "id")
    return rows.select("id", "company", "title", "source", F.date_format("posted_date", "yyyy-MM-dd HH:mm:ss").alias("posted_date"),
                       "content_hash", "repost_of_id", "status")


@register("job5_score_postings", SCORES_CTES + f"SELECT {SCORE_COLS} FROM scores")
def job5_score_postings(spark, sf):
    """JOB5: all sub-scores; repost marks from the detector (WIN1), vagueness from the noun table."""
    return scores(spark, sf)


REVIEW_CTES = [S.REVIEWS, f"""
rinc AS (SELECT * FROM reviews WHERE posted_at >= TIMESTAMP '{REVIEW_CUT}'),
rst AS (SELECT * FROM reviews WHERE posted_at < TIMESTAMP '{REVIEW_CUT}'),
rreal AS (SELECT * FROM rinc WHERE NOT {S.blank('text')}),
rsaved AS (
  SELECT r.* FROM rreal r
  WHERE r.id = (SELECT arg_min(j.id, (j.posted_at, j.id)) FROM rreal j WHERE j.company = r.company AND j.text = r.text)
    AND NOT EXISTS (SELECT 1 FROM rst WHERE rst.company = r.company AND rst.text = r.text)
),
rtagged AS (
  SELECT company, 'saved' AS status FROM rsaved
  UNION ALL SELECT company, 'skipped' FROM rreal WHERE id NOT IN (SELECT id FROM rsaved)
  UNION ALL SELECT company, 'blank' FROM rinc WHERE {S.blank('text')}
)"""]


def _review_load(spark, sf):
    inc, st = split_at(D.reviews(spark, sf), "posted_at", REVIEW_CUT)
    return inc, st, DD.new_reviews(inc, st)


@register("join7_new_reviews", with_(*REVIEW_CTES) +
          "SELECT id, 'saved' AS state FROM rsaved UNION ALL "
          "SELECT id, 'skipped' FROM rreal WHERE id NOT IN (SELECT id FROM rsaved)")
def join7_new_reviews(spark, sf):
    _, _, (saved, skipped, _blank) = _review_load(spark, sf)
    return (saved.select("id", F.lit("saved").alias("state"))
            .unionByName(skipped.select("id", F.lit("skipped").alias("state"))))


@register("agg2_review_stats", with_(*REVIEW_CTES) + """
SELECT company, count(*) AS total, count(*) FILTER (WHERE status = 'saved') AS saved,
       count(*) FILTER (WHERE status = 'skipped') AS skipped
FROM rtagged GROUP BY ROLLUP (company)""")
def agg2_review_stats(spark, sf):
    _, _, (saved, skipped, blank) = _review_load(spark, sf)
    tagged = (saved.select("company", F.lit("saved").alias("status"))
              .unionByName(skipped.select("company", F.lit("skipped").alias("status")))
              .unionByName(blank.select("company", F.lit("blank").alias("status"))))
    return DD.review_stats(tagged)


@register("job2_ingest_reviews", with_(*REVIEW_CTES, S.review_scores_sql(D.DATA_FRUSTRATION).replace(
    "FROM reviews", "FROM (SELECT * FROM rst UNION ALL SELECT * FROM rsaved) r "
                    "WHERE company IN (SELECT company FROM rsaved)"), S.sentiment_sql(D.DATA_FRUSTRATION)) +
          "SELECT company, score, review_count FROM sentiment")
def job2_ingest_reviews(spark, sf):
    """JOB2 = JOIN7 -> store -> UPS2 (sentiment of affected companies only)."""
    from postingscope.operators.sentiment import refresh_affected
    _, st, (saved, _s, _b) = _review_load(spark, sf)
    allr = st.unionByName(saved)
    return refresh_affected(saved, allr, as_of(), D.DATA_FRUSTRATION).drop("computed_at")


LOAD_SQL = with_("""
conv AS (
  SELECT conv_id * """ + str(D.TURNS) + """ + turn AS id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS company, role, turn, coalesce(text, '') AS text,
         TIMESTAMP '2024-01-30 00:00:00' - (conv_id % 120) * INTERVAL 1 DAY + turn * INTERVAL 1 MINUTE AS posted_at, CAST(NULL AS TIMESTAMP) AS scraped_at
  FROM conversations
),
comp AS (SELECT DISTINCT source AS company FROM documents),""" + f"""
lst AS (SELECT * FROM conv WHERE role = 'user' AND posted_at < TIMESTAMP '{REVIEW_CUT}'),
lprim AS (SELECT * FROM conv WHERE role = 'user' AND turn = 0 AND posted_at >= TIMESTAMP '{REVIEW_CUT}'),
lsec AS (SELECT * FROM conv WHERE role = 'assistant' AND posted_at >= TIMESTAMP '{REVIEW_CUT}'),
lstat AS (SELECT c.company, (SELECT count(*) FROM lprim p WHERE p.company = c.company) AS n FROM comp c),
linc AS (
  SELECT * FROM lprim WHERE company IN (SELECT company FROM comp)
  UNION ALL SELECT * FROM lsec WHERE company IN (SELECT company FROM lstat WHERE n = 0)
  UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT s.*, row_number() OVER (PARTITION BY company ORDER BY posted_at, id) AS rn FROM lsec s
                                        WHERE company IN (SELECT company FROM lstat WHERE n > 0 AND n < 5)) WHERE rn <= 10
),
lreal AS (SELECT * FROM linc WHERE NOT {S.blank('text')}),
lsaved AS (
  SELECT r.* FROM lreal r
  WHERE r.id = (SELECT arg_min(j.id, (j.posted_at, j.id)) FROM lreal j WHERE j.company = r.company AND j.text = r.text)
    AND NOT EXISTS (SELECT 1 FROM lst WHERE lst.company = r.company AND lst.text = r.text)
),
ltagged AS (
  SELECT company, 'saved' AS status FROM lsaved
  UNION ALL SELECT company, 'skipped' FROM lreal WHERE id NOT IN (SELECT id FROM lsaved)
  UNION ALL SELECT company, 'blank' FROM linc WHERE {S.blank('text')}
)""", S.review_scores_sql(D.DATA_FRUSTRATION).replace(
    "FROM reviews", "FROM (SELECT * FROM lst UNION ALL SELECT * FROM lsaved) r WHERE company IN (SELECT company FROM lsaved)"),
    S.sentiment_sql(D.DATA_FRUSTRATION)) + """
SELECT 'sentiment' AS part, company, score, CAST(review_count AS BIGINT) AS total, CAST(NULL AS BIGINT) AS saved, CAST(NULL AS BIGINT) AS skipped FROM sentiment
UNION ALL
SELECT 'load', company, NULL, count(*), count(*) FILTER (WHERE status = 'saved'), count(*) FILTER (WHERE status = 'skipped')
FROM ltagged GROUP BY ROLLUP (company)"""


@register("job2_reviews_commit", LOAD_SQL)
def job2_reviews_commit(spark, sf):
    """JOB2 with defaults (META4) and fallback reviews (SET3), written as one commit and read back: the refreshed sentiment and the
    load's statistics."""
    from postingscope.operators.ingest import ingest_reviews
    from postingscope.operators.store import Store
    from postingscope.session import checkpoint_dir
    c = D.table(spark, sf, "conversations")
    posted = F.timestamp_micros(F.unix_micros(F.lit("2024-01-30 00:00:00").cast("timestamp"))
                                - (F.col("conv_id") % 120) * F.lit(86_400_000_000) + F.col("turn") * F.lit(60_000_000))
    conv = c.select((F.col("conv_id") * D.TURNS + F.col("turn")).alias("id"),
                    F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("company"), F.lit(None).cast("string").alias("source"),
                    "text", posted.alias("posted_at"), F.lit(None).cast("timestamp").alias("scraped_at"), "role", "turn")
    arriving, before = split_at(conv, "posted_at", REVIEW_CUT)
    store = Store(spark, f"{checkpoint_dir(spark)}/reviews-{uuid.uuid4().hex}", buckets=16)
    stored = with_defaults(before.filter("role = 'user'").drop("role", "turn"), "review", as_of())
    store.transact(lambda tx: tx.append("reviews", stored, "company"))
    ingest_reviews(store, arriving.filter("role = 'user' and turn = 0").drop("role", "turn"), arriving.filter("role = 'assistant'").drop("role", "turn"),
                   D.postings(spark, sf).select("company"), as_of(), D.DATA_FRUSTRATION)
    now = store.manifest()["version"]       # both tables of one commit
    none = F.lit(None).cast("bigint")
    return store.read("company_sentiment", now).select(F.lit("sentiment").alias("part"), "company", "score", F.col("review_count").cast("bigint").alias("total"),
                                                       none.alias("saved"), none.alias("skipped")).unionByName(
        store.read("review_loads", now).select(F.lit("load").alias("part"), "company", F.lit(None).cast("double").alias("score"), "total", "saved", "skipped"))


@register("set1_union_sources", with_(S.POSTINGS) +
          "SELECT id, source FROM postings WHERE source = 'cards_a'")
def set1_union_sources(spark, sf):
    return union_sources(D.postings(spark, sf), "cards_a").select("id", "source")


@register("set1_union_all_sources", with_(S.POSTINGS) +
          "SELECT source, count(*) AS n FROM postings GROUP BY source")
def set1_union_all_sources(spark, sf):
    return union_sources(D.postings(spark, sf), "all").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


FALLBACK_SQL = with_(S.POSTINGS, """
conv AS (
  SELECT conv_id * """ + str(D.TURNS) + """ + turn AS id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS company, role, turn, text,
         TIMESTAMP '2024-01-30 00:00:00' - (conv_id % 120) * INTERVAL 1 DAY + turn * INTERVAL 1 MINUTE AS posted_at
  FROM conversations
),
prim AS (SELECT * FROM conv WHERE role = 'user' AND turn = 0),
sec AS (SELECT * FROM conv WHERE role = 'assistant'),
comp AS (SELECT DISTINCT company FROM postings),
status AS (SELECT c.company, (SELECT count(*) FROM prim p WHERE p.company = c.company) AS n FROM comp c)
""") + """
SELECT id, 'primary' AS origin FROM prim WHERE company IN (SELECT company FROM comp)
UNION ALL SELECT id, 'secondary' FROM sec WHERE company IN (SELECT company FROM status WHERE n = 0)
UNION ALL SELECT id, 'secondary' FROM (
  SELECT s.*, row_number() OVER (PARTITION BY company ORDER BY posted_at, id) AS rn FROM sec s
  WHERE company IN (SELECT company FROM status WHERE n > 0 AND n < 5)) WHERE rn <= 10"""


@register("set3_fallback_union", FALLBACK_SQL)
def set3_fallback_union(spark, sf):
    """SET3: opening posts are the primary reviews; assistant turns stand in
    for the secondary source."""
    c = D.table(spark, sf, "conversations")
    posted = F.timestamp_micros(F.unix_micros(F.lit("2024-01-30 00:00:00").cast("timestamp"))
                                - (F.col("conv_id") % 120) * F.lit(86_400_000_000)
                                + F.col("turn") * F.lit(60_000_000))
    conv = c.select((F.col("conv_id") * D.TURNS + F.col("turn")).alias("id"),
                    F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("company"),
                    "role", "turn", "text", posted.alias("posted_at"))
    prim = conv.filter((F.col("role") == "user") & (F.col("turn") == 0)).withColumn("origin", F.lit("primary"))
    sec = conv.filter(F.col("role") == "assistant").withColumn("origin", F.lit("secondary"))
    comps = D.postings(spark, sf).select("company")
    return fallback_union(prim, sec, comps).select("id", "origin")


@register("win2_first_k", """
SELECT conv_id, turn, rn FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
  FROM conversations WHERE role = 'user') WHERE rn <= 3""")
def win2_first_k(spark, sf):
    """WIN2: first 3 user turns per conversation (salted two-round top-k)."""
    c = D.table(spark, sf, "conversations").filter(F.col("role") == "user")
    c = c.withColumn("id", F.col("conv_id") * D.TURNS + F.col("turn"))
    return first_k(c, "conv_id", ["turn"], 3, rank_col="rn").select("conv_id", "turn", F.col("rn").cast("long"))


@register("win4_first_wins", with_(S.POSTINGS) +
          "SELECT url, arg_min(id, (scraped_at, id)) AS id FROM postings GROUP BY url")
def win4_first_wins(spark, sf):
    p = D.postings(spark, sf)
    return DD.first_wins(p, ["url"], ["scraped_at", "id"]).select("url", "id")


@register("meta4_with_defaults", with_(S.PAGE_POSTINGS) + f"""
SELECT id, coalesce(nullif(company, ''), 'Unknown') AS company,
       coalesce(nullif(title, ''), 'Untitled Position') AS title,
       strftime({S.AS_OF}, '%Y-%m-%d %H:%M:%S') AS posted_date
FROM page_postings""")
def meta4_with_defaults(spark, sf):
    """META4 on captured pages: empty extracted fields count as absent."""
    p = D.page_postings(spark, sf)
    p = (p.withColumn("company", F.nullif("company", F.lit(""))).withColumn("title", F.nullif("title", F.lit("")))
          .withColumn("posted_date", F.lit(None).cast("timestamp")))
    d = with_defaults(p, "posting", as_of())
    return d.select("id", "company", "title", F.date_format("posted_date", "yyyy-MM-dd HH:mm:ss").alias("posted_date"))


@register("ups1_merge_rows", with_(S.POSTINGS) + """
SELECT id, CASE WHEN location = 'en' THEN upper(title) ELSE title END AS title,
       CASE WHEN location = 'en' THEN NULL ELSE company END AS company,
       CASE WHEN location = 'en' THEN url END AS note
FROM postings""")
def ups1_merge_rows(spark, sf):
    """UPS1: rows that replace others by key; each side lacks a column of the other."""
    from postingscope.operators.maintenance import merge_rows
    p = D.postings(spark, sf)
    rows = p.filter("location = 'en'").select("id", F.upper("title").alias("title"), F.col("url").alias("note"))
    return merge_rows(p.select("id", "title", "company"), rows, "id")
