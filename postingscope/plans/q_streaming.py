"""Queries: batch twins of the streaming jobs (STR3) and the traffic cache (UPS3)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from postingscope.functions.features import pyround
from postingscope.plans import sqlgen as S
from postingscope.operators.maintenance import refresh_if_stale
from postingscope.plans.catalog import as_of, register, with_
from postingscope.sources import driver as D
from postingscope.streaming.traffic import (daily_views_stream, page_rollup, rolling_30d,
                                            traffic_sessions_batch)

SESSIONS_SQL = with_(S.PAGE_EVENTS, """
g AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s
  FROM page_events WINDOW w AS (PARTITION BY page_path, user_id ORDER BY ts, event_id)
),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY page_path, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
sess AS (SELECT page_path, user_id, sid, count(*) AS n_events, sum(engagement) AS engagement,
                count(*) FILTER (WHERE event_type = 'view') AS views FROM s GROUP BY page_path, user_id, sid)""")


@register("str3_traffic_sessions", SESSIONS_SQL + f"""
SELECT page_path, count(*) AS sessions, count(*) FILTER (WHERE n_events = 1) AS bounced,
       CAST(sum(n_events) AS BIGINT) AS events, CAST(sum(views) AS BIGINT) AS views,
       {S.rnd('sum(engagement)', 6)} AS engagement,
       {S.rnd('count(*) FILTER (WHERE n_events = 1) / count(*)', 9)} AS bounce_rate
FROM sess GROUP BY page_path""")
def str3_traffic_sessions(spark, sf):
    """STR3 batch twin: 30-minute sessions per (page, user) -> page roll-up."""
    s = traffic_sessions_batch(D.page_events(spark, sf))
    p = page_rollup(s)
    return p.select("page_path", "sessions", "bounced", F.col("events").cast("long"), F.col("views").cast("long"),
                    pyround(F.col("engagement"), 6).alias("engagement"),
                    pyround(F.col("bounced") / F.col("sessions"), 9).alias("bounce_rate"))


@register("str3_session_count", SESSIONS_SQL + "SELECT count(*) AS sessions FROM sess")
def str3_session_count(spark, sf):
    s = traffic_sessions_batch(D.page_events(spark, sf))
    return s.agg(F.count(F.lit(1)).alias("sessions"))


@register("str3_rolling_30d_views", with_(S.PAGE_EVENTS) + f"""
SELECT page_path, count(*) FILTER (WHERE event_type = 'view') AS views_30d, {S.rnd('sum(engagement)', 6)} AS engagement_30d
FROM page_events
WHERE date_trunc('day', ts) >= {S.AS_OF} - INTERVAL 30 DAY AND date_trunc('day', ts) < {S.AS_OF}
GROUP BY page_path""")
def str3_rolling_30d_views(spark, sf):
    """Daily tumbling partials (the streaming state) summed over 30 days."""
    daily = daily_views_stream(D.page_events(spark, sf))
    r = rolling_30d(daily, as_of())
    return r.select("page_path", F.col("views_30d").cast("long"), pyround(F.col("engagement_30d"), 6).alias("engagement_30d"))


# name -> (as_of, forced, whether anything is fetched)
REFRESHES = {"fresh": ("2024-01-16 12:00:00", False, True), "stale": ("2024-01-18 00:00:00", False, True),
             "forced": ("2024-01-16 12:00:00", True, True), "nothing": ("2024-01-18 00:00:00", False, False)}
CACHE_CUT = "2024-01-16 00:00:00"


def _refresh_sql(name: str) -> str:
    at, force, some = REFRESHES[name]
    use = f"(({force} OR coalesce(TIMESTAMP '{at}' - (SELECT max(fetched_at) FROM cached) >= INTERVAL 24 HOUR, true)) AND (SELECT count(*) FROM fetched WHERE {some}) > 0)"
    return (f"SELECT '{name}' AS variant, page_path, views FROM cached WHERE NOT {use} "
            f"UNION ALL SELECT '{name}', page_path, views FROM fetched WHERE {some} AND {use}")


@register("ups3_refresh", with_(S.PAGE_EVENTS, f"""
cached AS (SELECT page_path, count(*) AS views, max(ts) AS fetched_at FROM page_events WHERE ts < TIMESTAMP '{CACHE_CUT}' GROUP BY page_path),
fetched AS (SELECT page_path, count(*) AS views, max(ts) AS fetched_at FROM page_events GROUP BY page_path)""")
          + " UNION ALL ".join(_refresh_sql(n) for n in REFRESHES))
def ups3_refresh(spark, sf):
    """UPS3: page views cached in mid January, refreshed by those of the whole month when stale, forced, or with nothing fetched."""
    ev = D.page_events(spark, sf)

    def report(df):
        return df.groupBy("page_path").agg(F.count(F.lit(1)).alias("views"), F.max("ts").alias("fetched_at"))
    cached, fetched = report(ev.filter(F.col("ts") < F.lit(CACHE_CUT).cast("timestamp"))).checkpoint(eager=True), report(ev).checkpoint(eager=True)
    out = None
    for name, (at, force, some) in REFRESHES.items():
        got = refresh_if_stale(cached, fetched if some else fetched.limit(0), F.lit(at).cast("timestamp"), timedelta(hours=24), force)
        got = got.select(F.lit(name).alias("variant"), "page_path", "views")
        out = got if out is None else out.unionByName(got)
    return out
