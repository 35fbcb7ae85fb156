"""Forum captures -> review rows (SRC8, SRC9, SRC10).

JSON bodies are parsed JVM-side with `from_json` against an explicit schema
and flattened with `posexplode`; no Python per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postingscope.functions.text import strip_ws
from postingscope.operators.dedupe import first_wins

POST = T.StructType([T.StructField("title", T.StringType()), T.StructField("selftext", T.StringType()),
                     T.StructField("created_utc", T.DoubleType()), T.StructField("permalink", T.StringType())])
LISTING = T.StructType([T.StructField("data", T.StructType([T.StructField("children", T.ArrayType(
    T.StructType([T.StructField("data", POST)])))]))])
COMMENT = T.StructType([T.StructField("body", T.StringType()), T.StructField("created_utc", T.DoubleType())])
THREAD = T.ArrayType(T.StructType([T.StructField("data", T.StructType([T.StructField("children", T.ArrayType(
    T.StructType([T.StructField("data", COMMENT)])))]))]))


def epoch_or(ts_col, as_of):
    """Epoch seconds -> timestamp (UTC); null or 0 -> as_of."""
    c = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    return F.when(c.isNull() | (c == 0), as_of).otherwise(F.timestamp_micros((c * 1_000_000).cast("long")))


def extract_forum_posts(raw: DataFrame, as_of, min_len: int = 20, source: str = "forum_json") -> DataFrame:
    """SRC8: raw (page_id, company, body) search-result JSON -> reviews.

    text = strip(title + "\\n\\n" + selftext), kept when at least `min_len`
    characters and first of its (company, text) across all pages."""
    p = raw.select("page_id", "company", F.from_json("body", LISTING).alias("_j"))
    e = p.select("page_id", "company", F.posexplode("_j.data.children").alias("pos", "_c"))
    text = strip_ws(F.concat(F.coalesce(F.col("_c.data.title"), F.lit("")), F.lit("\n\n"),
                             F.coalesce(F.col("_c.data.selftext"), F.lit(""))))
    rows = e.select((F.col("page_id") * 10_000 + F.col("pos")).alias("id"), "company",
                    F.lit(source).alias("source"), text.alias("text"),
                    epoch_or(F.col("_c.data.created_utc"), as_of).alias("posted_at"),
                    F.col("_c.data.permalink").alias("permalink"),
                    F.col("page_id"), F.col("pos"))
    rows = rows.filter(F.length("text") >= min_len)
    return first_wins(rows, ["company", "text"], ["page_id", "pos"]).drop("page_id", "pos")


def extract_forum_comments(threads: DataFrame, as_of, k: int = 3, min_len: int = 25,
                           source: str = "forum_json") -> DataFrame:
    """SRC9: thread JSON (thread_id, company, title, body) -> first k comments
    with body longer than `min_len`, first occurrence of a body per company."""
    t = threads.select("thread_id", "company", "title", F.from_json("body", THREAD).alias("_j"))
    e = t.select("thread_id", "company", "title",
                 F.posexplode(F.element_at("_j", 2)["data"]["children"]).alias("pos", "_c"))
    e = e.filter(F.col("pos") < k)
    body = F.col("_c.data.body")
    rows = e.filter(body.isNotNull() & (F.length(body) > min_len)).select(
        (F.col("thread_id") * 100 + F.col("pos")).alias("id"), "company", F.lit(source).alias("source"),
        F.concat(F.lit("Comment on '"), F.coalesce("title", F.lit("")), F.lit("': "), body).alias("text"),
        body.alias("_body"), epoch_or(F.col("_c.data.created_utc"), as_of).alias("posted_at"),
        "thread_id", "pos")
    return first_wins(rows, ["company", "_body"], ["thread_id", "pos"]).drop("_body", "thread_id", "pos")


def flatten_submissions(subs: DataFrame, as_of, k: int = 5, min_len: int = 15,
                        source: str = "forum_api") -> DataFrame:
    """SRC10: submission records (sub_id, company, title, selftext,
    created_utc, comments array<struct<body, created_utc>>) -> reviews:
    the post when longer than `min_len`, plus its first k comments longer
    than `min_len`.  No de-duplication."""
    text = strip_ws(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("selftext", F.lit(""))))
    posts = subs.select((F.col("sub_id") * 100).alias("id"), "company", F.lit(source).alias("source"),
                        text.alias("text"), epoch_or("created_utc", as_of).alias("posted_at"))
    posts = posts.filter(F.length("text") > min_len)
    c = subs.select("sub_id", "company", "title", F.posexplode("comments").alias("pos", "_c")).filter(F.col("pos") < k)
    body = F.col("_c.body")
    comments = c.filter(body.isNotNull() & (F.length(body) > min_len)).select(
        (F.col("sub_id") * 100 + F.col("pos") + 1).alias("id"), "company", F.lit(source).alias("source"),
        F.concat(F.lit("Comment on '"), F.coalesce("title", F.lit("")), F.lit("': "), body).alias("text"),
        epoch_or(F.col("_c.created_utc"), as_of).alias("posted_at"))
    return posts.unionByName(comments)
