"""Queries: forum captures (SRC8-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingscope.plans import sqlgen as S
from postingscope.plans.catalog import as_of, register
from postingscope.sources import driver as D
from postingscope.sources.forum import extract_forum_comments, extract_forum_posts, flatten_submissions
from postingscope.operators.windows import first_k

EPOCH_S = 1704067200  # 2024-01-01 00:00:00 UTC


def _turns(spark, sf):
    c = D.table(spark, sf, "conversations")
    created = F.when(F.col("turn") == 0, F.lit(0.0)).otherwise(
        (F.lit(EPOCH_S) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("double"))
    return c.select("conv_id", "turn", "role", "text", created.alias("created_utc"),
                    F.concat(F.lit("src"), (F.col("conv_id") % D.N_COMPANIES).cast("string")).alias("company"))


PAGE_SIZE = 50      # results per captured search page


def forum_pages(spark, sf):
    """Captured search pages (JSON): a conversation's user turns are the
    results, PAGE_SIZE turn numbers per page, so no page (group) grows with
    the data however long a conversation is."""
    u = _turns(spark, sf).filter(F.col("role") == "user")
    u = u.withColumn("conv_id", F.col("conv_id") * 1000 + F.floor(F.col("turn") / PAGE_SIZE))
    child = F.struct(F.col("turn"), F.struct(F.substring("text", 1, 30).alias("title"),
                                             F.substring("text", 31, 1 << 30).alias("selftext"),
                                             F.col("created_utc"),
                                             F.concat(F.lit("/t/"), F.col("conv_id").cast("string")).alias("permalink"))
                     .alias("data"))
    g = u.groupBy("conv_id", "company").agg(F.array_sort(F.collect_list(child)).alias("_c"))
    body = F.to_json(F.struct(F.struct(F.transform("_c", lambda x: F.struct(x["data"].alias("data")))
                                       .alias("children")).alias("data")))
    return g.select(F.col("conv_id").alias("page_id"), "company", body.alias("body"))


@register("src8_forum_posts", f"""
WITH u AS (
  SELECT conv_id * 1000 + turn // {PAGE_SIZE} AS page_id, turn, text, 'src' || CAST(conv_id % 20 AS VARCHAR) AS company,
         CASE WHEN turn = 0 THEN 0.0 ELSE {EPOCH_S} + conv_id * 3600 + turn * 60 END AS created_utc,
         row_number() OVER (PARTITION BY conv_id, turn // {PAGE_SIZE} ORDER BY turn) - 1 AS pos
  FROM conversations WHERE role = 'user'
), t AS (
  SELECT page_id * 10000 + pos AS id, company, page_id AS conv_id, pos,
         {S.strip("substr(text, 1, 30) || chr(10) || chr(10) || substr(text, 31)")} AS text, created_utc
  FROM u
), k AS (SELECT * FROM t WHERE length(text) >= 20)
SELECT id, company, text,
       strftime(CASE WHEN created_utc = 0 THEN {S.AS_OF} ELSE make_timestamp(CAST(created_utc * 1000000 AS BIGINT)) END,
                '%Y-%m-%d %H:%M:%S') AS posted_at
FROM k WHERE id = (SELECT arg_min(j.id, (j.conv_id, j.pos)) FROM k j WHERE j.company = k.company AND j.text = k.text)""")
def src8_forum_posts(spark, sf):
    r = extract_forum_posts(forum_pages(spark, sf), as_of())
    return r.select("id", "company", "text", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))


def forum_threads(spark, sf, k):
    """One thread JSON per conversation: the opening post, then the first k
    assistant turns as comments (the k of the operator that reads them)."""
    t = _turns(spark, sf)
    first = t.filter((F.col("role") == "user")).groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("title"))
    # exact top-k per conversation, so a huge thread is never one group
    com = first_k(t.filter(F.col("role") == "assistant").withColumn("id", F.col("conv_id") * 100 + F.col("turn")),
                  "conv_id", ["turn"], k)
    item = F.struct(F.col("turn"), F.struct(F.col("text").alias("body"), F.col("created_utc")).alias("data"))
    g = com.groupBy("conv_id", "company").agg(F.array_sort(F.collect_list(item)).alias("_c"))
    g = g.join(first, "conv_id")
    post = F.struct(F.struct(F.array(F.struct(F.struct(F.col("title").alias("title")).alias("data")))
                             .alias("children")).alias("data"))
    comments = F.struct(F.struct(F.transform("_c", lambda x: F.struct(x["data"].alias("data"))).alias("children"))
                        .alias("data"))
    body = F.concat(F.lit("["), F.to_json(post), F.lit(","), F.to_json(comments), F.lit("]"))
    return g.select(F.col("conv_id").alias("thread_id"), "company", "title", body.alias("body"))


@register("src9_forum_comments", f"""
WITH c AS (
  SELECT conv_id, turn, text, 'src' || CAST(conv_id % 20 AS VARCHAR) AS company,
         {EPOCH_S} + conv_id * 3600 + turn * 60 AS created_utc,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM conversations WHERE role = 'assistant'
), f AS (SELECT conv_id, arg_min(text, turn) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id),
k AS (SELECT c.conv_id * 100 + c.pos AS id, c.company, c.text AS body, c.conv_id, c.pos,
             'Comment on ''' || f.title || ''': ' || c.text AS text, c.created_utc
      FROM c JOIN f USING (conv_id) WHERE c.pos < 3 AND length(c.text) > 25)
SELECT id, company, text, strftime(make_timestamp(CAST(created_utc * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS posted_at
FROM k WHERE id = (SELECT arg_min(j.id, (j.conv_id, j.pos)) FROM k j WHERE j.company = k.company AND j.body = k.body)""")
def src9_forum_comments(spark, sf):
    r = extract_forum_comments(forum_threads(spark, sf, 3), as_of())
    return r.select("id", "company", "text", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))


def submissions(spark, sf, k):
    t = _turns(spark, sf)
    first = t.filter(F.col("role") == "user").groupBy("conv_id", "company").agg(
        F.min_by(F.struct("text", "created_utc"), F.col("turn")).alias("_f"))
    com = first_k(t.filter(F.col("role") == "assistant").withColumn("id", F.col("conv_id") * 100 + F.col("turn")),
                  "conv_id", ["turn"], k)
    com = com.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text", "created_utc"))).alias("_c"))
    j = first.join(com, "conv_id", "left")
    return j.select(F.col("conv_id").alias("sub_id"), "company",
                    F.substring("_f.text", 1, 30).alias("title"), F.substring("_f.text", 31, 1 << 30).alias("selftext"),
                    F.col("_f.created_utc").alias("created_utc"),
                    F.transform(F.coalesce("_c", F.array()), lambda x: F.struct(x["text"].alias("body"),
                                                                                x["created_utc"].alias("created_utc")))
                    .alias("comments"))


@register("src10_flatten_submissions", f"""
WITH u AS (
  SELECT conv_id, arg_min(text, turn) AS text, arg_min(CASE WHEN turn = 0 THEN 0.0 ELSE {EPOCH_S} + conv_id * 3600 + turn * 60 END, turn) AS created_utc
  FROM conversations WHERE role = 'user' GROUP BY conv_id
), c AS (
  SELECT conv_id, text, {EPOCH_S} + conv_id * 3600 + turn * 60 AS created_utc,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM conversations WHERE role = 'assistant'
), posts AS (
  SELECT conv_id * 100 AS id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS company,
         {S.strip("substr(text, 1, 30) || chr(10) || chr(10) || substr(text, 31)")} AS text, created_utc
  FROM u
)
SELECT id, company, text, strftime(CASE WHEN created_utc = 0 THEN {S.AS_OF} ELSE make_timestamp(CAST(created_utc * 1000000 AS BIGINT)) END, '%Y-%m-%d %H:%M:%S') AS posted_at
FROM posts WHERE length(text) > 15
UNION ALL
SELECT c.conv_id * 100 + c.pos + 1, 'src' || CAST(c.conv_id % 20 AS VARCHAR),
       'Comment on ''' || substr(u.text, 1, 30) || ''': ' || c.text,
       strftime(make_timestamp(CAST(c.created_utc * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S')
FROM c JOIN u USING (conv_id) WHERE c.pos < 5 AND length(c.text) > 15""")
def src10_flatten_submissions(spark, sf):
    r = flatten_submissions(submissions(spark, sf, 5), as_of())
    return r.select("id", "company", "text", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))
