"""Table maintenance and sinks (FLT1, UPS1, UPS3, UPS4, SNK1-3).

Upserts go into the bucketed, versioned tables of `operators/store.py`.
"""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postingscope.functions.text import clean_text
from postingscope.operators.store import BUCKETS, Store
from postingscope.session import path_exists, spread


def pending(postings: DataFrame, force: bool = False) -> DataFrame:
    """FLT1: postings not cleaned yet (all when `force`)."""
    return postings if force else postings.filter(F.col("cleaned_text").isNull())


def clean_pending(postings: DataFrame, force: bool = False, **kw) -> DataFrame:
    """UPS4: cleaned_text for pending postings; already-clean rows unchanged."""
    todo = spread(pending(postings, force))
    cleaned = todo.withColumn("cleaned_text", clean_text(F.col("description"), **kw))
    if force:
        return cleaned
    done = postings.filter(F.col("cleaned_text").isNotNull())
    return done.unionByName(cleaned)


# ------------------------------------------------------------------ UPS1
ROWS = "rows"       # the one table of a store that `upsert` writes


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    return Store(spark, path).read(ROWS)


def merge_rows(old: DataFrame | None, rows: DataFrame, key: list[str] | str) -> DataFrame:
    """Old rows whose key is absent from `rows`, plus `rows` (anti join + union).

    Columns that one side lacks are null there; of several `rows` with one key one stays."""
    key = [key] if isinstance(key, str) else list(key)
    rows = rows.dropDuplicates(key)
    if old is None:
        return rows
    kept = old.join(rows.select(*key), key, "left_anti").select(*old.columns)
    return kept.unionByName(rows, allowMissingColumns=True)


def upsert(path: str, rows: DataFrame, key: list[str] | str, epoch: tuple[str, int] | None = None, buckets: int = BUCKETS) -> int:
    """UPS1: insert-or-replace `rows` by `key`; rewrites the buckets that the rows hit.  Returns the version."""
    return Store(rows.sparkSession, path, buckets).upsert(ROWS, rows, key, epoch=epoch)


# ------------------------------------------------------------------ UPS3
def refresh_if_stale(cached: DataFrame, fetched: DataFrame, as_of, ttl: timedelta = timedelta(hours=24), force: bool = False,
                     stamp: str = "fetched_at") -> DataFrame:
    """UPS3: the cache while its newest fetch is younger than `ttl`, else the fetched rows; a fetch without rows keeps the cache.

    Decided inside the plan: two one-row aggregates (the newest stamp, whether anything was fetched) are broadcast and
    filter both sides, so that one of them is empty; nothing is read on the driver.  An empty cache is stale."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    age = F.unix_micros(now) - F.unix_micros(F.max(F.col(stamp)).cast("timestamp"))
    limit = F.lit(int(ttl.total_seconds() * 1_000_000))
    stale = cached.agg((F.lit(force) | F.coalesce(age >= limit, F.lit(True))).alias("_stale"))
    some = fetched.agg((F.count(F.lit(1)) > 0).alias("_some"))
    use = stale.crossJoin(some).select((F.col("_stale") & F.col("_some")).alias("_use"))        # one row
    kept = cached.crossJoin(F.broadcast(use)).filter(~F.col("_use")).drop("_use")
    taken = fetched.crossJoin(F.broadcast(use)).filter(F.col("_use")).drop("_use")
    return kept.unionByName(taken, allowMissingColumns=True)


# ------------------------------------------------------------------ SNK1-3
def export_snapshot(tables: dict[str, DataFrame | None], path: str, fmt: str = "parquet", schemas: dict | None = None) -> dict:
    """SNK1: one directory per table; a missing table is written empty where
    its schema is given, else left out (a snapshot without it restores empty)."""
    written = {}
    spark = next(df for df in tables.values() if df is not None).sparkSession if any(df is not None for df in tables.values()) else None
    for name, df in tables.items():
        if df is None and spark is not None and name in (schemas or {}):
            df = spark.createDataFrame([], schemas[name])
        if df is None:
            continue
        df.write.mode("overwrite").format(fmt).save(os.path.join(path, name))
        written[name] = os.path.join(path, name)
    return written


def restore_snapshot(spark: SparkSession, path: str, schemas: dict, current: DataFrame | None = None,
                     fmt: str = "parquet") -> dict[str, DataFrame] | None:
    """SNK2: load a snapshot only when the postings table is empty."""
    if current is not None and not current.isEmpty():
        return None
    out = {}
    for name, schema in schemas.items():
        p = os.path.join(path, name)
        out[name] = (spark.read.schema(schema).format(fmt).load(p) if path_exists(spark, p)
                     else spark.createDataFrame([], schema))
    return out


def pin_snapshot(store: Store, label: str, version: int | None = None) -> int:
    """SNK1 of a store: its tables as of one commit, kept under a name; what is written meanwhile is in it wholly or not at all."""
    return store.pin(label, version)


def restore_pinned(store: Store, label: str, schemas: dict, current: DataFrame | None = None) -> dict[str, DataFrame] | None:
    """SNK2 of a store: all columns of the pinned tables, only when the postings table is empty; a table without rows is empty."""
    if current is not None and not current.isEmpty():
        return None
    out = {name: store.read(name, pin=label) for name in schemas}
    return {name: df if df is not None else store.spark.createDataFrame([], schemas[name]) for name, df in out.items()}


def write_csv(df: DataFrame, path: str) -> str:
    """SNK3: CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
