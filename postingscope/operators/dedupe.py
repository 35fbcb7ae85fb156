"""Arrival-order de-duplication (WIN4, JOIN6, JOIN7, JOIN10, AGG1, AGG2).

"First wins per key" is expressed as a hash aggregate of
min(struct(order..., id)) per key followed by a semi join on the winning
id.  Unlike row_number() over a key window, the aggregate combines
map-side, so a key holding a third of all rows never lands whole in one
task, and the semi join is on unique ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.functions.text import is_blank


def first_wins(df: DataFrame, keys: list[str], order: list[str], id_col: str = "id") -> DataFrame:
    """WIN4: keep the earliest row (by `order`, then id) of every key."""
    winner = F.min(F.struct(*[F.col(c) for c in order], F.col(id_col).alias("_wid")))["_wid"]
    firsts = df.groupBy(*keys).agg(winner.alias("_wid"))
    return df.join(firsts.select(F.col("_wid").alias(id_col)), id_col, "left_semi")


def tag_by_url(incoming: DataFrame, stored: DataFrame | None, order: tuple[str, ...] = ("scraped_at", "id")) -> DataFrame:
    """JOIN6 in one pass: `incoming` with a column `state`, 'kept' or 'skipped'.

    A posting with a non-empty url is skipped when the url is already stored
    or an earlier posting of the same batch has it; postings without url are
    always kept.  Urls of both sides go through one aggregate with map-side
    partials, min(struct(stored first, order, id)), so a url that a third of all
    rows carry stays small; the winners come back by their unique ids.
    """
    has_url = F.col("url").isNotNull() & (F.col("url") != "")
    cols = [c for c in order if c != "id"] + ["id"]
    narrow = incoming.filter(has_url).select("url", F.lit(1).alias("_late"), *cols)
    if stored is not None:
        kinds = dict(incoming.dtypes)
        narrow = narrow.unionByName(stored.filter(has_url).select("url", F.lit(0).alias("_late"), *[F.lit(None).cast(kinds[c]).alias(c) for c in cols]))
    first = narrow.groupBy("url").agg(F.min(F.struct("_late", *cols)).alias("_w"))
    winners = first.filter("_w._late = 1").select(F.col("_w.id").alias("_winner"))
    tagged = incoming.join(winners, F.col("id") == F.col("_winner"), "left")
    return tagged.withColumn("state", F.when(has_url & F.col("_winner").isNull(), "skipped").otherwise("kept")).drop("_winner")


def new_by_url(incoming: DataFrame, stored: DataFrame | None,
               order: tuple[str, ...] = ("scraped_at", "id")) -> tuple[DataFrame, DataFrame]:
    """JOIN6 as two frames: (kept, skipped)."""
    tagged = tag_by_url(incoming, stored, order)
    return tagged.filter("state = 'kept'").drop("state"), tagged.filter("state = 'skipped'").drop("state")


def review_key(company: str = "company", text: str = "text"):
    """256-bit digest of (company, text), so that no text is a group or join key."""
    c = F.col(company)
    return F.sha2(F.concat(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-:")), F.coalesce(F.col(text), F.lit(""))), 256)


def new_reviews(incoming: DataFrame, stored: DataFrame | None,
                order: tuple[str, ...] = ("posted_at", "id")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JOIN7: (saved, skipped, blank).

    Reviews are keyed by (company, text); only a digest of the key is
    grouped, shuffled and joined.  Blank texts are neither saved nor skipped.
    """
    blank = incoming.filter(is_blank("text"))
    real = incoming.filter(~is_blank("text")).withColumn("_h", review_key())
    first = first_wins(real, ["_h"], list(order))
    if stored is not None:
        first = first.join(stored.select(review_key().alias("_h")).distinct(), "_h", "left_anti")
    saved = first.drop("_h")
    skipped = real.join(first.select("id"), "id", "left_anti").drop("_h")
    return saved, skipped, blank


def repost_counts(postings: DataFrame) -> DataFrame:
    """JOIN10: number of reposts pointing at each original posting."""
    return (postings.filter(F.col("repost_of_id").isNotNull())
            .groupBy(F.col("repost_of_id").alias("original_id"))
            .agg(F.count(F.lit(1)).alias("repost_count")))


def ingest_stats(tagged: DataFrame) -> DataFrame:
    """AGG1: total/new/reposts/skipped per company plus a grand-total row
    (company null) via rollup."""
    return (tagged.rollup("company").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "new").alias("new"),
        F.count_if(F.col("status") == "repost").alias("reposts"),
        F.count_if(F.col("status") == "skipped").alias("skipped")))


def review_stats(tagged: DataFrame) -> DataFrame:
    """AGG2: total/saved/skipped per company (blank rows count in total only)."""
    return (tagged.rollup("company").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "saved").alias("saved"),
        F.count_if(F.col("status") == "skipped").alias("skipped")))
