"""Queries: text cleaning, metadata, hashing, urls, time (TXT1-10, META1-3,
HASH1, URL1, TIME1, RPT5, FLT1, UPS4, JOB3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingscope.functions import text as TX
from postingscope.operators.maintenance import clean_pending, pending
from postingscope.plans import sqlgen as S
from postingscope.plans.catalog import as_of, register, with_
from postingscope.sources import driver as D


def _pages(spark, sf):
    return D.table(spark, sf, "pages")


@register("txt1_strip_markup",
          f"SELECT page_id, {S.strip_markup('html')} AS stripped FROM pages")
def txt1_strip_markup(spark, sf):
    return _pages(spark, sf).select("page_id", TX.strip_markup("html").alias("stripped"))


@register("txt2_unescape",
          f"SELECT page_id, {S.unescape(S.strip_markup('html'))} AS decoded FROM pages")
def txt2_unescape(spark, sf):
    """TXT2+TXT3 (Arrow UDF: full entity table and NFKC) after TXT1."""
    return _pages(spark, sf).select("page_id", TX.unescape_nfkc(TX.strip_markup("html")).alias("decoded"))


@register("txt2_unescape_jvm",
          f"SELECT page_id, {S.unescape('html')} AS decoded FROM pages")
def txt2_unescape_jvm(spark, sf):
    """JVM-only decoding of the common named entities (no Python worker)."""
    return _pages(spark, sf).select("page_id", TX.unescape_basic("html").alias("decoded"))


@register("txt4_strip_boilerplate",
          f"SELECT doc_id, {S.boilerplate('text')} AS body FROM documents")
def txt4_strip_boilerplate(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", TX.strip_boilerplate("text").alias("body"))


@register("txt5_squash_ws",
          f"SELECT doc_id, {S.squash('text')} AS body FROM documents")
def txt5_squash_ws(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", TX.squash_ws("text").alias("body"))


@register("txt6_fix_sentence_gap",
          f"SELECT page_id, {S.gap(S.unescape(S.strip_markup('html')))} AS body FROM pages")
def txt6_fix_sentence_gap(spark, sf):
    return _pages(spark, sf).select(
        "page_id", TX.fix_sentence_gap(TX.unescape_basic(TX.strip_markup("html"))).alias("body"))


@register("txt7_trim_lines",
          f"SELECT doc_id, {S.trim_lines('text')} AS body FROM documents")
def txt7_trim_lines(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", TX.trim_lines("text").alias("body"))


@register("txt8_clean_text",
          f"SELECT page_id, {S.clean('html')} AS cleaned FROM pages")
def txt8_clean_text(spark, sf):
    return _pages(spark, sf).select("page_id", TX.clean_text("html").alias("cleaned"))


@register("txt8_clean_documents",
          f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents")
def txt8_clean_documents(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", TX.clean_text("text").alias("cleaned"))


@register("txt10_slugify", with_(S.POSTINGS) +
          f"SELECT id, {S.slugify('title')} AS slug, {S.slugify('company')} AS company_slug FROM postings")
def txt10_slugify(spark, sf):
    p = D.postings(spark, sf)
    return p.select("id", TX.slugify("title").alias("slug"), TX.slugify("company").alias("company_slug"))


@register("meta1_has_salary", with_(S.POSTINGS) +
          f"SELECT id, coalesce(NOT lower({S.strip('salary_listed')}) IN ('none', 'null', ''), false) "
          "AS salary_listed FROM postings")
def meta1_has_salary(spark, sf):
    return D.postings(spark, sf).select("id", TX.has_salary("salary_listed").alias("salary_listed"))


META3_SQL = with_(S.POSTINGS) + f"""
SELECT id, coalesce(company, 'Unknown') AS company, coalesce(title, 'Untitled') AS title,
       coalesce(NOT lower({S.strip('salary_listed')}) IN ('none', 'null', ''), false) AS salary_listed,
       strftime(posted_date, '%Y-%m-%d %H:%M:%S') AS posting_date,
       {S.elapsed_days('coalesce(posted_date, scraped_at)', S.AS_OF)} AS days_since_posted
FROM postings"""


@register("meta3_extract_metadata", META3_SQL)
def meta3_extract_metadata(spark, sf):
    """META1-3: metadata projection (META2 = elapsed days since as_of)."""
    m = TX.extract_metadata(D.postings(spark, sf), as_of())
    return m.withColumn("posting_date", F.date_format("posting_date", "yyyy-MM-dd HH:mm:ss"))


@register("meta2_days_since_reviews", with_(S.REVIEWS) +
          f"SELECT id, {S.elapsed_days('posted_at', S.AS_OF)} AS days FROM reviews")
def meta2_days_since_reviews(spark, sf):
    r = D.reviews(spark, sf)
    return r.select("id", TX.elapsed_days("posted_at", as_of()).alias("days"))


HASH_SQL = with_(S.POSTINGS) + f"""
SELECT id, sha256(lower({S.strip('company')}) || ':' || lower({S.strip('title')}) || ':' ||
                  {S.strip("substr(coalesce(description, ''), 1, 250)")}) AS content_hash
FROM postings"""


@register("hash1_content_hash", HASH_SQL)
def hash1_content_hash(spark, sf):
    return D.postings(spark, sf).select("id", TX.content_hash().alias("content_hash"))


@register("url1_canonical_company", with_(S.PAGE_POSTINGS) +
          "SELECT id, url, company FROM page_postings")
def url1_canonical_company(spark, sf):
    return D.page_postings(spark, sf).select("id", "url", "company")


def _relative_labels(spark, sf):
    ev = D.table(spark, sf, "events")
    unit = (F.when(F.col("event_type") == "view", F.lit("days ago"))
             .when(F.col("event_type") == "click", F.lit("weeks ago"))
             .when(F.col("event_type") == "signup", F.lit("months ago"))
             .when(F.col("event_type") == "error", F.lit("hours ago"))
             .otherwise(F.lit("just posted")))
    label = (F.when(F.col("event_id") % 11 == 0, F.date_format("ts", "yyyy-MM-dd"))
              .otherwise(F.concat((F.col("user_id") % 12).cast("string"), F.lit(" "), unit)))
    return ev.select("event_id", label.alias("label"))


TIME_SQL = f"""
WITH lab AS (
  SELECT event_id,
         CASE WHEN event_id % 11 = 0 THEN strftime(ts, '%Y-%m-%d')
              ELSE CAST(user_id % 12 AS VARCHAR) || ' ' ||
                   CASE event_type WHEN 'view' THEN 'days ago' WHEN 'click' THEN 'weeks ago'
                        WHEN 'signup' THEN 'months ago' WHEN 'error' THEN 'hours ago'
                        ELSE 'just posted' END END AS label
  FROM events
), s AS (SELECT event_id, label, lower({S.strip('label')}) AS s FROM lab)
SELECT event_id, label, strftime(CASE
  WHEN s IS NULL THEN {S.AS_OF}
  WHEN regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN coalesce(try_strptime(substr(s, 1, 10), '%Y-%m-%d'), {S.AS_OF})
  WHEN contains(s, 'just') OR contains(s, 'today') OR contains(s, 'hour') OR contains(s, 'minute') THEN {S.AS_OF}
  WHEN regexp_matches(s, '[0-9]+{S.WS}+day') THEN {S.AS_OF} - CAST(regexp_extract(s, '([0-9]+){S.WS}+day', 1) AS BIGINT) * INTERVAL 1 DAY
  WHEN regexp_matches(s, '[0-9]+{S.WS}+week') THEN {S.AS_OF} - CAST(regexp_extract(s, '([0-9]+){S.WS}+week', 1) AS BIGINT) * 7 * INTERVAL 1 DAY
  WHEN regexp_matches(s, '[0-9]+{S.WS}+month') THEN {S.AS_OF} - CAST(regexp_extract(s, '([0-9]+){S.WS}+month', 1) AS BIGINT) * 30 * INTERVAL 1 DAY
  ELSE {S.AS_OF} END, '%Y-%m-%d %H:%M:%S') AS posted_date
FROM s"""


@register("time1_relative_time", TIME_SQL)
def time1_relative_time(spark, sf):
    lab = _relative_labels(spark, sf)
    return lab.select("event_id", "label",
                      F.date_format(TX.parse_relative_time("label", as_of()), "yyyy-MM-dd HH:mm:ss")
                      .alias("posted_date"))


@register("rpt5_fmt_duration",
          "SELECT event_id, format('{:d}m {:02d}s', CAST(floor(value / 60) AS INTEGER), "
          "CAST(floor(value - 60 * floor(value / 60)) AS INTEGER)) AS duration FROM events")
def rpt5_fmt_duration(spark, sf):
    ev = D.table(spark, sf, "events")
    return ev.select("event_id", TX.fmt_duration("value").alias("duration"))


@register("flt1_pending", with_(S.PAGE_POSTINGS) +
          "SELECT id FROM page_postings WHERE cleaned_text IS NULL")
def flt1_pending(spark, sf):
    return pending(D.page_postings(spark, sf)).select("id")


@register("job3_clean_postings", with_(S.PAGE_POSTINGS) +
          f"SELECT id, CASE WHEN cleaned_text IS NULL THEN {S.clean('description')} ELSE cleaned_text END "
          "AS cleaned_text FROM page_postings")
def job3_clean_postings(spark, sf):
    """JOB3 = UPS4: clean pending postings, keep the others."""
    return clean_pending(D.page_postings(spark, sf)).select("id", "cleaned_text")


@register("txt9_best_text", with_(S.PAGE_POSTINGS) +
          "SELECT id, coalesce(nullif(cleaned_text, ''), nullif(description, ''), '') AS best FROM page_postings")
def txt9_best_text(spark, sf):
    return D.page_postings(spark, sf).select("id", TX.best_text().alias("best"))
