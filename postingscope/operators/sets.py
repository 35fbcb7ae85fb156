"""Unions and ingest defaults (SET1, SET3, META4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope import lexicons as L

LAYOUTS = ("career", "cards_a", "cards_b")


def union_sources(frames, source: str = "all") -> DataFrame:
    """SET1: bag union of postings extracted from the selected layouts.

    `frames` is one DataFrame (with a `source` column) or a list of them."""
    if isinstance(frames, DataFrame):
        frames = [frames]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if source != "all":
        df = df.filter(F.col("source") == source)
    return df


def with_defaults(df: DataFrame, kind: str, as_of) -> DataFrame:
    """META4: defaults for absent ingest fields."""
    if kind == "posting":
        return (df.withColumn("company", F.coalesce("company", F.lit(L.DEFAULT_COMPANY)))
                  .withColumn("title", F.coalesce("title", F.lit(L.DEFAULT_TITLE)))
                  .withColumn("description", F.coalesce("description", F.lit("")))
                  .withColumn("source", F.coalesce("source", F.lit(L.DEFAULT_POSTING_SOURCE)))
                  .withColumn("posted_date", F.coalesce("posted_date", as_of)))
    if kind == "review":
        return (df.withColumn("company", F.coalesce("company", F.lit(L.DEFAULT_COMPANY)))
                  .withColumn("source", F.coalesce("source", F.lit(L.DEFAULT_REVIEW_SOURCE)))
                  .withColumn("text", F.coalesce("text", F.lit("")))
                  .withColumn("posted_at", F.coalesce("posted_at", as_of)))
    raise ValueError(kind)


def fallback_union(primary: DataFrame, secondary: DataFrame, companies: DataFrame,
                   k: int = 5, extra: int = 10, order: tuple[str, ...] = ("posted_at", "id")) -> DataFrame:
    """SET3: primary reviews per company; a company with none takes all of
    its secondary reviews, a company with fewer than k primary reviews also
    takes its first `extra` secondary ones.

    The per-company counts are a partial aggregate; the first-`extra`
    selection is a salted two-round top-k (`windows.first_k`) over the
    secondary rows of deficient companies only.
    """
    from postingscope.operators.windows import first_k
    comp = companies.select("company").distinct()
    cnt = primary.groupBy("company").agg(F.count(F.lit(1)).alias("_n"))
    status = comp.join(cnt, "company", "left").select("company", F.coalesce("_n", F.lit(0)).alias("_n"))
    none = status.filter(F.col("_n") == 0).select("company")
    few = status.filter((F.col("_n") > 0) & (F.col("_n") < k)).select("company")
    sec_none = secondary.join(none, "company", "left_semi")
    sec_few = first_k(secondary.join(few, "company", "left_semi"), "company",
                      [c for c in order if c != "id"], extra)
    prim = primary.join(comp, "company", "left_semi")
    return prim.unionByName(sec_none).unionByName(sec_few)
