"""STR3: web-traffic roll-up from raw page events.

Streaming: `withWatermark` + `session_window` per (page, user), append
mode; rows later than the watermark are dropped (counted in the query's
progress metrics).  Batch twin: the same `session_window` on the static
table, keyed by page and user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_rollup(sess: DataFrame) -> DataFrame:
    """Sessions (page_path, user_id, n_events, engagement, views) -> per page."""
    return sess.groupBy("page_path").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("n_events") == 1).alias("bounced"),
        F.sum("n_events").alias("events"),
        F.sum("views").alias("views"),
        F.sum("engagement").alias("engagement"))


def traffic_sessions_batch(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """One exchange; for users with very many events set
    spark.sql.sessionWindow.merge.sessions.in.local.partition=true."""
    s = events.groupBy("page_path", "user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("session"))
    return s.agg(F.count(F.lit(1)).alias("n_events"), F.sum("engagement").alias("engagement"),
                 F.count_if(F.col("event_type") == "view").alias("views"),
                 F.min("ts").alias("start"), F.max("ts").alias("last"))


def traffic_sessions_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Streaming sessions; works on a streaming or a static DataFrame."""
    return (events.withWatermark("ts", delay)
            .groupBy("page_path", "user_id", F.session_window("ts", gap).alias("session"))
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum("engagement").alias("engagement"),
                 F.count_if(F.col("event_type") == "view").alias("views")))


def daily_views_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Daily tumbling partials of page views (a rolling 30-day figure is
    the sum of 30 daily rows: 30x less state than a sliding window)."""
    return (events.withWatermark("ts", delay)
            .groupBy("page_path", F.window("ts", "1 day").alias("day"))
            .agg(F.count_if(F.col("event_type") == "view").alias("views"),
                 F.sum("engagement").alias("engagement")))


def rolling_30d(daily: DataFrame, as_of) -> DataFrame:
    """Sum the daily partials of the 30 days before `as_of` per page."""
    lo = F.timestamp_micros(F.unix_micros(as_of) - F.lit(30 * 86_400_000_000))
    d = daily.filter((F.col("day.start") >= lo) & (F.col("day.start") < as_of))
    return d.groupBy("page_path").agg(F.sum("views").alias("views_30d"),
                                      F.sum("engagement").alias("engagement_30d"))
