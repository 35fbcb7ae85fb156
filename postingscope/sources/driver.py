"""Domain tables derived from the benchmark tables.

The benchmark data has no job postings or reviews, so each domain table is a
projection of a benchmark table (all rows, no sampling):

* postings   <- documents (id, company=source, title=first line, text)
* reviews    <- conversations, user turns
* embeddings <- embeddings (company = label), joined to documents for text
* page events<- events (page = /company/<company>.html)
* verified labels <- labels

Every derivation is a narrow projection of one scan, so Catalyst prunes
columns at the parquet reader and pushes filters into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingscope.functions.text import WS

# Reference time of every driver query (the data spans January 2024).
AS_OF = "2024-02-01 00:00:00"
EPOCH = "2024-01-01 00:00:00"
N_COMPANIES = 20
TURNS = 1 << 20     # ids of turns: conv_id * TURNS + turn

# Lexicons tuned to the benchmark text (the domain lexicons never occur in
# it, which would make every feature 0); the domain defaults stay the
# library defaults.
DATA_GENERIC = ["and the", "of the", "license", "all rights reserved"]
DATA_URGENT = ["is the", "ing the", "round"]
DATA_FRUSTRATION = [("and the", 0.85), ("of the", 0.90), ("is the", 0.60), ("ing the", 1.00)]
DATA_THRESHOLD = 0.30
DATA_VAGUE = ["the", "that", "with", "from", "der", "des", "que", "and"]
DATA_LABEL_CUT = 0.20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table, listed anew on every call."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored postings, one per document."""
    d = table(spark, sf_dir, "documents")
    first_line = F.substring_index(F.col("text"), "\n", 1)
    title = F.regexp_replace(first_line, f"^{WS}+|{WS}+$", "")
    scraped = F.timestamp_micros(F.unix_micros(F.lit(EPOCH).cast("timestamp"))
                                 + F.col("doc_id") * F.lit(60_000_000))
    posted = F.timestamp_micros(F.unix_micros(scraped)
                                - (F.col("n_chars") % 30) * F.lit(86_400_000_000))
    layout = (F.when(F.col("lang") == "en", "career")
               .when(F.col("lang") == "fr", "cards_a").otherwise("cards_b"))
    url = F.concat(F.lit("https://jobs.example.com/"), F.col("source"), F.lit("/"),
                   F.sha2("text", 256))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("company"),
        title.alias("title"),
        F.col("text").alias("description"),
        url.alias("url"),
        layout.alias("source"),
        posted.alias("posted_date"),
        scraped.alias("scraped_at"),
        F.nullif(F.regexp_extract("text", r"[$€£] ?[0-9][0-9,.]*", 0), F.lit("")).alias("salary_listed"),
        F.col("lang").alias("location"),
        F.lit(None).cast("string").alias("cleaned_text"),
        F.lit(None).cast("long").alias("repost_of_id"),     # the detector's marks come with plans/marks.py
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate reviews: the user turns of conversations."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    posted = F.timestamp_micros(F.unix_micros(F.lit("2024-01-30 00:00:00").cast("timestamp"))
                                - (F.col("conv_id") % 120) * F.lit(86_400_000_000))
    return c.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("id"),
        F.concat(F.lit("src"), (F.col("conv_id") % N_COMPANIES).cast("string")).alias("company"),
        F.lit("forum").alias("source"),
        F.col("text"),
        posted.alias("posted_at"),
        F.lit("2024-01-31 00:00:00").cast("timestamp").alias("scraped_at"),
    )


def incoming_postings(spark: SparkSession, sf_dir: str, **of_posting) -> DataFrame:
    """All incoming postings; embedding is null where there is none.

    company = the embedding's label, or the posting's own company without one.
    `of_posting` columns are computed from a posting's own columns before the
    join with the vectors (one named as a posting's column replaces it), so a
    caller that needs only these of the text joins and shuffles no text.
    """
    e = table(spark, sf_dir, "embeddings")
    p = postings(spark, sf_dir).withColumns(of_posting)
    label = F.concat(F.lit("c"), F.col("label").cast("string"))
    j = p.join(e, e["vec_id"] == p["id"], "left")
    return j.select(
        "id", F.coalesce(label, F.col("company")).alias("company"),
        "title", "description", "url", "source", "posted_date", "scraped_at",
        "salary_listed", "location", F.col("embedding"),
        *[c for c in of_posting if c != "description"])


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page events of the report site: one page per company."""
    ev = table(spark, sf_dir, "events")
    company = F.concat(F.lit("src"), (F.col("user_id") % N_COMPANIES).cast("string"))
    return ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        "event_type", F.col("value").alias("engagement"),
        F.concat(F.lit("/company/"), company, F.lit(".html")).alias("page_path"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company dimension: one company per source, industry from region names."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    r = table(spark, sf_dir, "region")
    n_regions = 5
    num = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    d = d.withColumn("_rk", num % n_regions).withColumn("_num", num)
    out = d.join(r, d["_rk"] == r["r_regionkey"], "left")
    industry = F.when(F.col("_num") % 7 == 6, F.lit(None).cast("string")).otherwise(F.lower("r_name"))
    return out.select("name", industry.alias("industry"),
                      F.concat(F.lit("https://careers.example.com/"), F.col("name")).alias("career_url"),
                      F.lit("software engineer").alias("query"), F.lit("Remote").alias("location"))


def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings captured as raw career pages: one per page.

    Pages whose url carries a fragment were cleaned by an earlier run (their
    cleaned_text is set), the rest are pending.
    """
    from postingscope.functions.text import canonical_url, company_from_url
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"(?s)<title>([^<]*)</title>", 1)
    return p.select(
        F.col("page_id").alias("id"),
        company_from_url(F.col("url")).alias("company"),
        title.alias("title"),
        F.col("html").alias("description"),
        canonical_url(F.col("url")).alias("url"),
        F.lit("career").alias("source"),
        F.when(F.col("url").contains("#"), title).alias("cleaned_text"),
    )
