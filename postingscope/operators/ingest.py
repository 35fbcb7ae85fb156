"""JOB2: a load of reviews as one commit over the reviews, the load statistics and the refreshed sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.operators.dedupe import new_reviews, review_stats
from postingscope.operators.sentiment import refresh_affected
from postingscope.operators.sets import fallback_union, with_defaults
from postingscope.operators.store import Store, Transaction


def stage_reviews(tx: Transaction, primary: DataFrame, secondary: DataFrame, companies: DataFrame, as_of, weighted_phrases=None,
                  reviews: str = "reviews", sentiment: str = "company_sentiment", loads: str = "review_loads") -> None:
    """META4 -> SET3 -> JOIN7 -> AGG2 -> UPS2, staged together.

    Reviews lie in buckets by company: only those of the companies that arrive are read, first for what is stored already, then
    for the sentiment of the companies that got a new review.  A load's statistics are kept under its version.
    """
    batch = fallback_union(with_defaults(primary, "review", as_of), with_defaults(secondary, "review", as_of), companies).checkpoint(eager=True)
    saved, skipped, blank = new_reviews(batch, tx.read_hit(reviews, batch, "company"))
    saved = saved.checkpoint(eager=True)
    tagged = [df.select("company", F.lit(status).alias("status")) for df, status in ((saved, "saved"), (skipped, "skipped"), (blank, "blank"))]
    stats = review_stats(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]))
    tx.append(reviews, saved, "company")
    touched = refresh_affected(saved, tx.read_hit(reviews, saved, "company"), as_of, weighted_phrases)
    tx.upsert(sentiment, touched, "company")
    tx.append(loads, stats.withColumn("load", F.lit(tx.base["version"] + 1).cast("bigint")), "load")


def ingest_reviews(store: Store, primary: DataFrame, secondary: DataFrame, companies: DataFrame, as_of, weighted_phrases=None,
                   epoch: tuple[str, int] | None = None) -> int:
    """JOB2; returns the version.  Either all three tables change or none."""
    return store.transact(lambda tx: stage_reviews(tx, primary, secondary, companies, as_of, weighted_phrases), epoch)
