"""The ingest that the queries share (JOB1's body), and the postings with the repost marks it gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingscope import lexicons as L
from postingscope.functions.text import HASHED
from postingscope.operators import dedupe as DD
from postingscope.operators.reposts import last_k_postings, long_enough, mark_reposts
from postingscope.operators.sets import union_sources, with_defaults
from postingscope.plans import sqlgen as S
from postingscope.plans.catalog import as_of
from postingscope.sources import driver as D

# Postings scraped before CUT are the stored table; the rest arrive as a batch.
CUT = "2024-01-01 02:30:00"


def split_at(df, col, cut):
    c = F.lit(cut).cast("timestamp")
    return df.filter(F.col(col) >= c), df.filter(F.col(col) < c)


def arriving(spark, sf):
    """The batch that arrives, from all sources (SET1) and with defaults (META4), and the stored postings.

    The text is read where it lies: `_eligible` judges the whole text, and `description` holds the characters that the
    content hash reads (HASH1), so the joins with vectors and urls carry no text."""
    rows = D.incoming_postings(spark, sf, _eligible=long_enough(), description=F.substring("description", 1, HASHED))
    inc, st = split_at(rows, "scraped_at", CUT)
    return with_defaults(union_sources(inc, "all"), "posting", as_of()), st


def ingest(spark, sf, threshold=D.DATA_THRESHOLD, extra=()):
    """JOB1 body: META4, SET1, url de-dup (JOIN6), then repost marking (WIN1).

    The incoming batch is narrowed (ids, url, order, embedding, the
    eligibility flag instead of the text, and `extra` columns) and
    checkpointed once with its url state, so the text scan and the embeddings
    join run a single time however many branches read the batch.  Of the
    stored postings, urls and the last 20 per company are read.
    Returns (marks of the kept rows, the tagged batch)."""
    inc, st = arriving(spark, sf)
    inc = inc.select("id", "company", "url", "scraped_at", "embedding", "_eligible", *extra)
    tagged = DD.tag_by_url(inc, st).checkpoint(eager=True)
    marked = mark_reposts(tagged.filter("state = 'kept'"), last_k_postings(st.select("id", "company", "scraped_at", "embedding")),
                          threshold=threshold)
    return marked, tagged


INGEST_CTES = [S.POSTINGS, S.INCOMING, f"""
inc AS (SELECT * REPLACE (coalesce(company, {S.q(L.DEFAULT_COMPANY)}) AS company, coalesce(title, {S.q(L.DEFAULT_TITLE)}) AS title,
                          coalesce(description, '') AS description, coalesce(source, {S.q(L.DEFAULT_POSTING_SOURCE)}) AS source,
                          coalesce(posted_date, {S.AS_OF}) AS posted_date)
        FROM incoming WHERE scraped_at >= TIMESTAMP '{CUT}'),
st AS (SELECT * FROM incoming WHERE scraped_at < TIMESTAMP '{CUT}'),
kept AS (
  SELECT i.* FROM inc i
  WHERE i.url IS NULL OR i.url = ''
     OR (i.id = (SELECT arg_min(j.id, (j.scraped_at, j.id)) FROM inc j WHERE j.url = i.url)
         AND NOT EXISTS (SELECT 1 FROM st WHERE st.url = i.url))
),
allrows AS (
  SELECT id, company, scraped_at, embedding, description, false AS is_inc FROM st
  UNION ALL SELECT id, company, scraped_at, embedding, description, true FROM kept
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY company ORDER BY is_inc, scraped_at, id) AS rn,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm
  FROM allrows
),
pairs AS (
  SELECT p.id AS pid, c.id AS cid, c.rn AS crn,
         CASE WHEN p.nrm > 0 AND c.nrm > 0
              THEN list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / (p.nrm * c.nrm)
              ELSE 0.0 END AS sim
  FROM ranked p JOIN ranked c ON p.company = c.company AND c.rn < p.rn AND c.rn >= p.rn - 20
  WHERE p.is_inc AND p.description IS NOT NULL AND length({S.strip('p.description')}) > 10
),
best_match AS (
  SELECT pid, cid, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, crn DESC) AS r FROM pairs) WHERE r = 1
),
marked AS (
  SELECT k.id, k.company, CASE WHEN b.sim >= {D.DATA_THRESHOLD} THEN b.cid END AS repost_of_id,
         b.sim AS max_similarity,
         CASE WHEN b.sim >= {D.DATA_THRESHOLD} THEN 'repost' ELSE 'new' END AS status
  FROM kept k LEFT JOIN best_match b ON k.id = b.pid
),
tagged AS (
  SELECT company, status FROM marked
  UNION ALL SELECT company, 'skipped' FROM inc WHERE id NOT IN (SELECT id FROM kept)
)"""]


def repost_marks(spark, sf):
    """(id, repost_of_id) of the repost detector."""
    return ingest(spark, sf)[0].select("id", "repost_of_id")


def marked_postings(spark, sf):
    """Stored postings with the marks of the repost detector."""
    return D.postings(spark, sf).drop("repost_of_id").join(repost_marks(spark, sf), "id", "left")


MARKED = "scored_postings AS (SELECT p.* EXCLUDE (repost_of_id), m.repost_of_id FROM postings p LEFT JOIN marked m ON p.id = m.id)"
MARKED_CTES = [*INGEST_CTES, MARKED]
