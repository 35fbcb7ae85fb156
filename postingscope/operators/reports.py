"""Reporting tables (JOIN1-3, JOIN5, AGG5-9, AGG11, AGG15, AGG19-22,
FLT2-5, TOP2-3, RPT1-4, SRC12).

Group-bys are hash aggregates with map-side partials, so a company holding
a third of all postings costs one partial row per map task.  Joins to small
per-company tables are plain joins; AQE broadcasts them at runtime when
their measured size is under the threshold and splits skewed partitions
otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope import lexicons as L
from postingscope.functions.features import pyround, risk_band, signals, spotlight_band
from postingscope.functions.text import fmt_duration, slugify
from postingscope.operators.stats import pearson

SUB_SCORES = ["genericness_score", "vagueness_score", "repost_score", "urgency_score",
              "bert_score", "sentiment_score"]


# ------------------------------------------------------------- joins
def scored(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """JOIN1: postings with a score row."""
    return postings.join(scores, postings["id"] == scores["job_posting_id"], "inner")


def scored_or_default(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """JOIN2 + RPT4: every posting; missing scores 0.0, location 'Not Specified'."""
    s = scores.select("job_posting_id", *SUB_SCORES, F.col("final_score").alias("final_ghost_score"))
    j = postings.join(s, postings["id"] == s["job_posting_id"], "left")
    cols = [F.col("id").alias("posting_id"), "company", "title", "source", "url",
            F.coalesce(F.col("location"), F.lit("Not Specified")).alias("location"),
            "posted_date", "scraped_at"]
    cols += [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in SUB_SCORES + ["final_ghost_score"]]
    return j.select(*cols)


def industry_dim(companies: DataFrame, default: str = L.DEFAULT_INDUSTRY) -> DataFrame:
    """SRC2: company -> industry, missing industry -> default."""
    return companies.select(F.col("name").alias("company"),
                            F.coalesce(F.col("industry"), F.lit(default)).alias("industry"))


def with_industry(df: DataFrame, dim: DataFrame, default: str = L.DEFAULT_INDUSTRY) -> DataFrame:
    """JOIN3: unmapped companies get `default`."""
    return (df.join(dim, "company", "left")
              .withColumn("industry", F.coalesce(F.col("industry"), F.lit(default))))


def traffic_vs_score(traffic: DataFrame, company_scores: DataFrame) -> DataFrame:
    """JOIN5: page traffic joined to the company's mean score."""
    return traffic.join(company_scores, "company", "inner")


# ------------------------------------------------------------- aggregates
def best_per_company(scored_df: DataFrame, postings: DataFrame, reviews: DataFrame) -> DataFrame:
    """AGG5: highest-scoring posting per company (ties -> smallest id) with
    the company's posting and review counts."""
    best = scored_df.groupBy("company").agg(
        F.max_by(F.struct("id", "url", *SUB_SCORES, "final_score"),
                 F.struct(F.col("final_score"), -F.col("id"))).alias("_b"))
    pc = postings.groupBy("company").agg(F.count(F.lit(1)).alias("posting_count"))
    rc = reviews.groupBy("company").agg(F.count(F.lit(1)).alias("review_count"))
    out = best.join(pc, "company", "left").join(rc, "company", "left")
    return out.select(
        "company", slugify(F.col("company")).alias("slug"),
        F.col("_b.id").alias("best_posting_id"), F.col("_b.url").alias("career_url"),
        pyround(F.col("_b.final_score"), 1).alias("ghost_score"),
        *[F.col(f"_b.{c}").alias(c) for c in SUB_SCORES],
        F.coalesce("posting_count", F.lit(0)).alias("posting_count"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"))


def by_industry(df: DataFrame) -> DataFrame:
    """AGG6: per industry count and means."""
    return df.groupBy("industry").agg(
        F.count(F.lit(1)).alias("postings"),
        F.avg("final_ghost_score").alias("avg_score"),
        F.avg("vagueness_score").alias("avg_vagueness"),
        F.avg("genericness_score").alias("avg_genericness"),
        F.avg("repost_score").alias("avg_repost"))


def by_company(df: DataFrame, score: str = "final_ghost_score", prob: str = "bert_score",
               sentiment: str = "sentiment_score", key: str = "posting_id") -> DataFrame:
    """AGG7: mean score, mean probability, first non-null sentiment by
    posting id (deterministic 'first'), count."""
    return df.groupBy("company").agg(
        F.avg(score).alias("avg_score"), F.avg(prob).alias("avg_probability"),
        F.min_by(F.col(sentiment), F.when(F.col(sentiment).isNotNull(), F.col(key))).alias("sentiment"),
        F.count(F.lit(1)).alias("postings"))


def views(df: DataFrame, high: float = L.HIGH_RISK, score: str = "final_ghost_score") -> DataFrame:
    """AGG6, AGG7 and AGG9 together: rows per industry, per company and over all, from one pass.

    (view, name, postings, means, first sentiment by posting id, high risk, companies); `df` is narrowed and
    materialised once, so scores are computed once.  Three grouping sets share one scan and one exchange."""
    d = df.select("industry", "company", "posting_id", F.col(score).alias("_s"), "bert_score", "vagueness_score", "genericness_score",
                  "repost_score", "sentiment_score").checkpoint(eager=True)
    first = F.min_by("sentiment_score", F.when(F.col("sentiment_score").isNotNull(), F.col("posting_id")))
    g = d.withColumn("_c", F.col("company")).groupingSets([[F.col("industry")], [F.col("company")], []], F.col("industry"), F.col("company")).agg(
        F.grouping("industry").alias("_gi"), F.grouping("company").alias("_gc"), F.count(F.lit(1)).alias("postings"), F.avg("_s").alias("avg_score"),
        F.avg("bert_score").alias("avg_probability"), F.avg("vagueness_score").alias("avg_vagueness"),
        F.avg("genericness_score").alias("avg_genericness"), F.avg("repost_score").alias("avg_repost"), first.alias("sentiment"),
        F.count_if(F.col("_s") >= high).alias("high_risk"), F.count_distinct("_c").alias("companies"))
    view = F.when(F.col("_gi") == 0, "industry").when(F.col("_gc") == 0, "company").otherwise("all")
    return g.select(view.alias("view"), F.coalesce("industry", "company").alias("name"), "postings", "avg_score", "avg_probability",
                    "avg_vagueness", "avg_genericness", "avg_repost", "sentiment", "high_risk", "companies")


def traffic_view(metrics: DataFrame, company_scores: DataFrame) -> DataFrame:
    """JOB8 traffic: page metrics with the company's mean score and postings (by slug; null without a score), a duration
    label, the estimated active readers of all pages and the correlation of views and scores."""
    by_slug = company_scores.select(slugify(F.col("company")).alias("_slug"), "avg_score", "postings")
    rows = metrics.withColumn("_slug", slugify(F.col("company"))).join(by_slug, "_slug", "left").drop("_slug")
    total = metrics.agg(F.floor(F.coalesce(F.sum("pageviews"), F.lit(0)) * F.lit(0.4)).cast("long").alias("all_active"))
    corr = company_correlation(rows, "pageviews", "avg_score").select(F.col("r").alias("traffic_r"))
    return (rows.withColumn("time_label", fmt_duration("avg_time_on_page"))
            .crossJoin(F.broadcast(total)).crossJoin(F.broadcast(corr)))        # one row each


def score_by_company(df: DataFrame, score: str = "final_ghost_score") -> DataFrame:
    """AGG8."""
    return df.groupBy("company").agg(F.avg(score).alias("avg_score"), F.count(F.lit(1)).alias("postings"))


def kpis(df: DataFrame, sentiments: DataFrame, high: float = L.HIGH_RISK,
         score: str = "final_ghost_score") -> DataFrame:
    """AGG9: rows, mean score, high-risk count, distinct companies, reviews."""
    a = df.agg(F.count(F.lit(1)).alias("postings"), F.avg(score).alias("avg_score"),
               F.count_if(F.col(score) >= high).alias("high_risk"),
               F.count_distinct("company").alias("companies"))
    b = sentiments.agg(F.coalesce(F.sum("review_count"), F.lit(0)).cast("long").alias("reviews"))
    return a.crossJoin(b)  # one row x one row


def coverage(postings: DataFrame, reviews: DataFrame) -> DataFrame:
    """AGG11: postings, reviews, distinct companies over both."""
    a = postings.agg(F.count(F.lit(1)).alias("postings"))
    b = reviews.agg(F.count(F.lit(1)).alias("reviews"))
    c = (postings.select("company").union(reviews.select("company"))
         .agg(F.count_distinct("company").alias("companies")))
    return a.crossJoin(b).crossJoin(c)


def company_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """AGG15: Pearson r between two company-level columns; degenerate
    inputs give null r (no invented fallback)."""
    return pearson(df, x, y, degenerate_r=None)


def traffic_kpis(metrics: DataFrame) -> DataFrame:
    """AGG19: total views, mean time, mean bounce (%), estimated users/sessions."""
    a = metrics.agg(F.coalesce(F.sum("pageviews"), F.lit(0)).cast("long").alias("total_views"),
                    F.avg("avg_time_on_page").alias("avg_time"),
                    (F.avg("bounce_rate") * F.lit(100.0)).alias("avg_bounce_pct"))
    return a.select("*", F.floor(F.col("total_views") * F.lit(0.4)).cast("long").alias("active_users"),
                    F.floor(F.col("total_views") * F.lit(0.6)).cast("long").alias("sessions"))


def complaint_themes(reviews: DataFrame, companies: DataFrame, groups=None) -> DataFrame:
    """AGG20: three ordered themes per company from keyword groups over its
    reviews, padded with a filler; companies without reviews get defaults.

    Per-review flags are OR-ed per company (a map-side partial aggregate)
    instead of concatenating all review text of a company into one string.
    """
    groups = L.THEME_KEYWORDS if groups is None else groups
    lt = F.lower(F.col("text"))
    flags = [F.bool_or(F.lit(False) if not g else
                       F.greatest(*[lt.contains(k) for k in g]) if len(g) > 1 else lt.contains(g[0]))
             .alias(f"_g{i}") for i, g in enumerate(groups)]
    hit = reviews.groupBy("company").agg(*flags)
    comp = companies.select("company").distinct()
    j = comp.join(hit, "company", "left")
    found = F.array_compact(F.array(*[F.when(F.col(f"_g{i}"), F.lit(L.THEME_TEXT[i]))
                                      for i in range(len(groups))]))
    padded = F.slice(F.concat(found, F.array(*[F.lit(L.THEME_FILLER)] * 3)), 1, 3)
    themes = F.when(F.col("_g0").isNull(), F.array(*[F.lit(t) for t in L.THEME_DEFAULTS])).otherwise(padded)
    return j.select("company", themes.alias("themes"))


def spotlight(df: DataFrame, company: str, score: str = "final_ghost_score") -> DataFrame:
    """AGG21: one company's count, means and band."""
    a = df.filter(F.col("company") == company).agg(
        F.count(F.lit(1)).alias("postings"), F.avg(score).alias("avg_score"),
        F.avg("repost_score").alias("avg_repost"), F.avg("vagueness_score").alias("avg_vagueness"))
    return a.withColumn("band", spotlight_band(F.coalesce(F.col("avg_score"), F.lit(0.0))))


def companies_of(df: DataFrame) -> DataFrame:
    """AGG22: sorted distinct companies."""
    return df.select("company").distinct().orderBy("company")


# ------------------------------------------------------------- filters
def by_company_and_score(df: DataFrame, companies, lo: float = 0.0, hi: float = 100.0,
                         score: str = "final_ghost_score") -> DataFrame:
    """FLT2: company in list and lo <= score <= hi."""
    return df.filter(F.col("company").isin(list(companies)) & F.col(score).between(lo, hi))


def search(df: DataFrame, query: str, literal: bool = False) -> DataFrame:
    """FLT3: title or company matches (case-insensitive regex; literal opt-in)."""
    if not query:
        return df
    if literal:
        q = query.lower()
        cond = F.lower("title").contains(q) | F.lower("company").contains(q)
    else:
        cond = F.col("title").rlike("(?i)" + query) | F.col("company").rlike("(?i)" + query)
    return df.filter(F.coalesce(cond, F.lit(False)))


def high_risk(df: DataFrame, cut: float = L.HIGH_RISK, score: str = "final_ghost_score") -> DataFrame:
    """FLT4."""
    return df.filter(F.col(score) >= cut)


def at_least_or_all(df: DataFrame, col: str, threshold: float, materialize: bool = False) -> DataFrame:
    """FLT5: rows with col >= threshold, or all rows if none qualifies.

    A global bool_or (one row, broadcast) joined to every row; no
    driver-side count.  The input is read twice (flag and rows);
    `materialize=True` checkpoints it first so an expensive lineage is not
    computed twice."""
    if materialize:
        df = df.checkpoint(eager=True)
    flag = df.agg(F.coalesce(F.bool_or(F.col(col) >= threshold), F.lit(False)).alias("_any"))
    j = df.crossJoin(F.broadcast(flag))
    return j.filter(~F.col("_any") | (F.col(col) >= threshold)).drop("_any")


# ------------------------------------------------------------- ordering
def ranked(df: DataFrame, col: str, tie: str = "company") -> DataFrame:
    """TOP2: descending by `col`, ties ascending by `tie`, with the `rank` (1 ..) of every row.

    Ranks are positions in a range-partitioned sort, so no task sees all rows."""
    from postingscope.operators.sequence import global_position
    rows = global_position(df.withColumn("_falling", -F.col(col)), ["_falling", tie], "rank").drop("_falling")
    return rows.withColumn("rank", (F.col("rank") + 1).cast("long"))


def recent_events(events: DataFrame, n: int = 50, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """TOP3: newest n events (top-k is the feature)."""
    return events.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


# ------------------------------------------------------------- page report
def title_case(c) -> F.Column:
    """Python str.title(): upper after a non-letter, lower after a letter."""
    chars = F.split(c, "")
    return F.array_join(F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.element_at(chars, i).rlike(r"^\p{L}$"), F.upper(ch)).otherwise(F.lower(ch))), "")


def page_metrics(report: DataFrame) -> DataFrame:
    """SRC12: report rows for /company/ pages -> company metrics."""
    r = report.filter(F.col("pagePath").contains("/company/"))
    slug = F.element_at(F.split(F.col("pagePath"), "/company/"), -1)
    name = title_case(F.replace(F.replace(slug, F.lit(".html"), F.lit("")), F.lit("-"), F.lit(" ")))
    views = F.col("screenPageViews").cast("long")
    avg_t = F.when(views > 0, F.col("userEngagementDuration") / views).otherwise(F.lit(0.0))
    return r.select(name.alias("company"), F.col("pagePath").alias("page"), views.alias("pageviews"),
                    pyround(avg_t, 1).alias("avg_time_on_page"),
                    pyround(F.col("bounceRate").cast("double"), 3).alias("bounce_rate"))


# ------------------------------------------------------------- report rows
def report_rows(best: DataFrame, themes: DataFrame, threshold: float = L.REPORT_THRESHOLD,
                signal_cuts=None) -> DataFrame:
    """JOB7 body: threshold-or-all, signals, band, themes, ordered by score."""
    kept = at_least_or_all(best, "ghost_score", threshold, materialize=True)
    j = kept.join(themes, "company", "left")
    sig = signals("repost_score", "genericness_score", "vagueness_score", "urgency_score",
                  "sentiment_score", signal_cuts)
    return (j.withColumn("signals", sig)
             .withColumn("band", risk_band("ghost_score"))
             .withColumn("json_ld", json_ld(F.col("company"), F.col("career_url"), F.col("ghost_score"),
                                            F.col("slug"))))


def json_ld(name, url, score, slug, published=None) -> F.Column:
    """RPT2: schema.org Organization + Report block as a JSON string."""
    org = F.struct(F.lit("Organization").alias("@type"), name.alias("name"),
                   F.coalesce(url, F.concat(F.lit("https://example.com/careers/"), slug)).alias("url"))
    rep = F.struct(F.lit("Report").alias("@type"),
                   F.concat(F.lit("Hiring transparency report: "), name).alias("headline"),
                   F.format_string("Posting-viability risk for %s: %s/100.", name,
                                   score.cast("string")).alias("description"))
    if published is not None:
        rep = F.struct(*[rep[f] for f in ["@type", "headline", "description"]],
                       published.alias("datePublished"))
    return F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.to_json(org), F.lit(","),
                    F.to_json(rep), F.lit("]}"))
