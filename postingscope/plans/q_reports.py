"""Queries: report and dashboard tables (JOIN1-3, JOIN5, SRC2, SRC12,
AGG5-9, AGG15, AGG19-22, FLT2-5, TOP2-3, RPT1, RPT3, JOB7, JOB8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postingscope.functions.features import pyround, risk_band, signals
from postingscope.functions.text import slugify
from postingscope.operators import reports as RP
from postingscope.operators import scoring as SC
from postingscope.operators import stats as ST
from postingscope.operators.sentiment import sentiment_all, sentiment_by_company
from postingscope.plans import sqlgen as S
from postingscope.plans.catalog import as_of, register, with_
from postingscope.plans.marks import INGEST_CTES, MARKED, repost_marks
from postingscope.plans.q_scoring import noun_table
from postingscope.plans.q_stats import LAB, METRICS_SELECT, PRED_CUT
from postingscope.sources import driver as D


BROADCAST_IDS = 1_000_000       # so many ids at most are sent to every executor


def r6(c):
    return pyround(c, 9)


def _scores(spark, sf, embedded_only=False):
    """Scores of all postings; `embedded_only` (JOIN2, where missing scores
    are the feature) leaves those without an embedding unscored.

    No text is shuffled for that: the ids with an embedding are counted first;
    up to BROADCAST_IDS they are sent to the texts, beyond, all postings are
    scored and the scores joined to the ids."""
    sp = D.postings(spark, sf)
    few = False
    if embedded_only:
        ids = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
        few = ids.count() <= BROADCAST_IDS
        if few:
            sp = sp.join(F.broadcast(ids), "id", "left_semi")
    sent = sentiment_by_company(D.reviews(spark, sf), as_of(), D.DATA_FRUSTRATION)
    s = SC.score_postings(sp, sent, as_of(), generic=D.DATA_GENERIC, urgent=D.DATA_URGENT,
                          nouns=noun_table(spark, sf), vague=D.DATA_VAGUE, marks=repost_marks(spark, sf))
    if embedded_only and not few:
        s = s.join(ids.withColumnRenamed("id", "job_posting_id"), "job_posting_id", "left_semi")
    return s


def _dash(spark, sf):
    """Dashboard frame: every posting with scores or defaults, and industry."""
    d = RP.scored_or_default(D.postings(spark, sf), _scores(spark, sf))
    return RP.with_industry(d, RP.industry_dim(D.companies(spark, sf)))


DASH = with_(*INGEST_CTES, S.REVIEWS, S.review_scores_sql(D.DATA_FRUSTRATION), S.sentiment_sql(D.DATA_FRUSTRATION),
             MARKED,
             S.vague_sql(D.DATA_VAGUE),
             S.features_sql("scored_postings", D.DATA_GENERIC, D.DATA_URGENT, vague=True), S.scores_sql(), S.COMPANIES, """
dash AS (
  SELECT p.id AS posting_id, p.company, p.title, p.url, coalesce(p.location, 'Not Specified') AS location,
         coalesce(s.genericness_score, 0.0) AS genericness_score, coalesce(s.vagueness_score, 0.0) AS vagueness_score,
         coalesce(s.repost_score, 0.0) AS repost_score, coalesce(s.urgency_score, 0.0) AS urgency_score,
         coalesce(s.bert_score, 0.0) AS bert_score, coalesce(s.sentiment_score, 0.0) AS sentiment_score,
         coalesce(s.final_score, 0.0) AS final_ghost_score,
         coalesce(c.industry, 'General Tech') AS industry
  FROM postings p LEFT JOIN scores s ON p.id = s.job_posting_id
  LEFT JOIN (SELECT name AS company, coalesce(industry, 'General Tech') AS industry FROM companies) c
    ON p.company = c.company
),
joined AS (SELECT p.*, s.final_score, s.genericness_score, s.vagueness_score, s.repost_score, s.urgency_score,
                  s.bert_score, s.sentiment_score
           FROM postings p JOIN scores s ON p.id = s.job_posting_id),
best AS (
  SELECT b.company, b.id AS best_posting_id, b.url AS career_url, b.final_score, b.genericness_score,
         b.vagueness_score, b.repost_score, b.urgency_score, b.bert_score, b.sentiment_score,
         coalesce(pc.n, 0) AS posting_count, coalesce(rc.n, 0) AS review_count
  FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY final_score DESC, id) AS r FROM joined) b
  LEFT JOIN (SELECT company, count(*) AS n FROM postings GROUP BY company) pc ON b.company = pc.company
  LEFT JOIN (SELECT company, count(*) AS n FROM reviews GROUP BY company) rc ON b.company = rc.company
  WHERE b.r = 1
)""")


@register("join1_scored", DASH + "SELECT id, company, final_score FROM joined")
def join1_scored(spark, sf):
    return RP.scored(D.postings(spark, sf), _scores(spark, sf)).select("id", "company", "final_score")


DASH_DEFAULTS = DASH.replace(MARKED, MARKED[:-1] + " WHERE p.id IN (SELECT vec_id FROM embeddings))")


@register("join2_scored_or_default", DASH_DEFAULTS + "SELECT posting_id, location, bert_score, final_ghost_score FROM dash")
def join2_scored_or_default(spark, sf):
    d = RP.scored_or_default(D.postings(spark, sf), _scores(spark, sf, embedded_only=True))
    return d.select("posting_id", "location", "bert_score", "final_ghost_score")


@register("join3_with_industry", DASH + "SELECT posting_id, company, industry FROM dash")
def join3_with_industry(spark, sf):
    return _dash(spark, sf).select("posting_id", "company", "industry")


@register("src2_industry_dim", with_(S.COMPANIES) +
          "SELECT name AS company, coalesce(industry, 'General Tech') AS industry FROM companies")
def src2_industry_dim(spark, sf):
    return RP.industry_dim(D.companies(spark, sf))


BEST_COLS = "company, best_posting_id, career_url, ghost_score, posting_count, review_count"


@register("agg5_best_per_company", DASH + f"""
SELECT company, best_posting_id, career_url, {S.rnd('final_score', 1)} AS ghost_score,
       posting_count, review_count FROM best""")
def agg5_best_per_company(spark, sf):
    p, r = D.postings(spark, sf), D.reviews(spark, sf)
    b = RP.best_per_company(RP.scored(p, _scores(spark, sf)), p, r)
    return b.select(*[c.strip() for c in BEST_COLS.split(",")])


@register("agg6_by_industry", DASH + f"""
SELECT industry, count(*) AS postings, {S.rnd('avg(final_ghost_score)', 9)} AS avg_score,
       {S.rnd('avg(vagueness_score)', 9)} AS avg_vagueness, {S.rnd('avg(genericness_score)', 9)} AS avg_genericness,
       {S.rnd('avg(repost_score)', 9)} AS avg_repost
FROM dash GROUP BY industry""")
def agg6_by_industry(spark, sf):
    a = RP.by_industry(_dash(spark, sf))
    return a.select("industry", "postings", *[r6(c).alias(c) for c in
                                              ["avg_score", "avg_vagueness", "avg_genericness", "avg_repost"]])


@register("agg7_by_company", DASH + f"""
SELECT company, {S.rnd('avg(final_ghost_score)', 9)} AS avg_score, {S.rnd('avg(bert_score)', 9)} AS avg_probability,
       arg_min(sentiment_score, posting_id) FILTER (WHERE sentiment_score IS NOT NULL) AS sentiment,
       count(*) AS postings
FROM dash GROUP BY company""")
def agg7_by_company(spark, sf):
    a = RP.by_company(_dash(spark, sf))
    return a.select("company", r6("avg_score").alias("avg_score"), r6("avg_probability").alias("avg_probability"),
                    "sentiment", "postings")


@register("agg8_score_by_company", DASH + f"""
SELECT company, {S.rnd('avg(final_ghost_score)', 9)} AS avg_score, count(*) AS postings FROM dash GROUP BY company""")
def agg8_score_by_company(spark, sf):
    a = RP.score_by_company(_dash(spark, sf))
    return a.select("company", r6("avg_score").alias("avg_score"), "postings")


@register("job8_overview_kpis", DASH + f""",
sall AS (SELECT u.company, coalesce(s.review_count, 0) AS review_count
         FROM (SELECT company FROM reviews UNION SELECT company FROM postings) u LEFT JOIN sentiment s USING (company))
SELECT count(*) AS postings, {S.rnd('avg(final_ghost_score)', 9)} AS avg_score,
       count(*) FILTER (WHERE final_ghost_score >= 10.0) AS high_risk, count(DISTINCT company) AS companies,
       (SELECT CAST(sum(review_count) AS BIGINT) FROM sall) AS reviews
FROM dash""")
def job8_overview_kpis(spark, sf):
    """JOB8 overview = AGG9 KPIs over the dashboard frame and AGG4 sentiments."""
    sents = sentiment_all(D.reviews(spark, sf), D.postings(spark, sf), as_of(), D.DATA_FRUSTRATION)
    k = RP.kpis(_dash(spark, sf), sents, high=10.0)
    return k.select("postings", r6("avg_score").alias("avg_score"), "high_risk", "companies", "reviews")


@register("job8_views", DASH + f"""
SELECT CASE WHEN grouping(industry) = 0 THEN 'industry' WHEN grouping(company) = 0 THEN 'company' ELSE 'all' END AS view,
       coalesce(industry, company) AS name, count(*) AS postings, {S.rnd('avg(final_ghost_score)', 9)} AS avg_score,
       {S.rnd('avg(bert_score)', 9)} AS avg_probability, {S.rnd('avg(vagueness_score)', 9)} AS avg_vagueness,
       {S.rnd('avg(genericness_score)', 9)} AS avg_genericness, {S.rnd('avg(repost_score)', 9)} AS avg_repost,
       arg_min(sentiment_score, posting_id) FILTER (WHERE sentiment_score IS NOT NULL) AS sentiment,
       count(*) FILTER (WHERE final_ghost_score >= 10.0) AS high_risk,
       count(DISTINCT company) AS companies
FROM dash GROUP BY GROUPING SETS ((industry), (company), ())""")
def job8_views(spark, sf):
    """JOB8 overview, industry and sentiment views (AGG6, AGG7, AGG9) from one pass over one score materialisation."""
    v = RP.views(_dash(spark, sf), high=10.0)
    means = ("avg_score", "avg_probability", "avg_vagueness", "avg_genericness", "avg_repost")
    return v.select("view", "name", "postings", *[r6(c).alias(c) for c in means], "sentiment", "high_risk", "companies")


@register("agg15_company_correlation", DASH + f""",
bc AS (SELECT company, avg(final_ghost_score) AS avg_score,
              arg_min(sentiment_score, posting_id) FILTER (WHERE sentiment_score IS NOT NULL) AS sentiment
       FROM dash GROUP BY company)
SELECT CASE WHEN count(*) < 2 OR min(avg_score) = max(avg_score) OR min(sentiment) = max(sentiment) THEN NULL
            ELSE {S.rnd('covar_pop(avg_score, sentiment) / (stddev_pop(avg_score) * stddev_pop(sentiment))', 9)} END AS r,
       count(*) AS n
FROM bc WHERE avg_score IS NOT NULL AND sentiment IS NOT NULL""")
def agg15_company_correlation(spark, sf):
    """AGG15: company sentiment vs company mean score (no invented fallback)."""
    bc = RP.by_company(_dash(spark, sf))
    c = RP.company_correlation(bc, "avg_score", "sentiment")
    return c.select(r6("r").alias("r"), "n")


DATA_THEMES = [["tion", "ment"], ["sch", "ß"], ["ing the", "zz"]]


def _theme_sql():
    from postingscope import lexicons as L
    found = []
    for i, g in enumerate(DATA_THEMES):
        cond = " OR ".join(f"contains(lower(text), {S.q(k)})" for k in g)
        found.append(f"bool_or({cond}) AS g{i}")
    texts = [S.q(t) for t in L.THEME_TEXT]
    fill = S.q(L.THEME_FILLER)
    arr = (f"list_filter([CASE WHEN g0 THEN {texts[0]} END, CASE WHEN g1 THEN {texts[1]} END, "
           f"CASE WHEN g2 THEN {texts[2]} END], lambda x: x IS NOT NULL)")
    padded = f"list_slice(list_concat({arr}, [{fill}, {fill}, {fill}]), 1, 3)"
    defaults = "[" + ", ".join(S.q(t) for t in L.THEME_DEFAULTS) + "]"
    return f"""
hit AS (SELECT company, {', '.join(found)} FROM reviews GROUP BY company),
themes AS (
  SELECT c.company, array_to_string(CASE WHEN h.g0 IS NULL THEN {defaults} ELSE {padded} END, ' | ') AS themes
  FROM (SELECT DISTINCT company FROM postings) c LEFT JOIN hit h USING (company))"""


@register("agg20_complaint_themes", DASH + "," + _theme_sql() + "SELECT company, themes FROM themes")
def agg20_complaint_themes(spark, sf):
    t = RP.complaint_themes(D.reviews(spark, sf), D.postings(spark, sf), DATA_THEMES)
    return t.select("company", F.array_join("themes", " | ").alias("themes"))


@register("agg21_spotlight", DASH + f"""
SELECT count(*) AS postings, {S.rnd('avg(final_ghost_score)', 9)} AS avg_score,
       {S.rnd('avg(repost_score)', 9)} AS avg_repost, {S.rnd('avg(vagueness_score)', 9)} AS avg_vagueness,
       CASE WHEN coalesce(avg(final_ghost_score), 0) >= 15 THEN 'elevated'
            WHEN coalesce(avg(final_ghost_score), 0) >= 8 THEN 'moderate' ELSE 'low' END AS band
FROM dash WHERE company = 'src3'""")
def agg21_spotlight(spark, sf):
    s = RP.spotlight(_dash(spark, sf), "src3")
    return s.select("postings", r6("avg_score").alias("avg_score"), r6("avg_repost").alias("avg_repost"),
                    r6("avg_vagueness").alias("avg_vagueness"), "band")


@register("agg22_companies_of", DASH + "SELECT DISTINCT company FROM dash")
def agg22_companies_of(spark, sf):
    return RP.companies_of(_dash(spark, sf))


@register("flt2_by_company_and_score", DASH +
          "SELECT posting_id FROM dash WHERE company IN ('src1', 'src2', 'src5') "
          "AND final_ghost_score BETWEEN 1.0 AND 20.0")
def flt2_by_company_and_score(spark, sf):
    return RP.by_company_and_score(_dash(spark, sf), ["src1", "src2", "src5"], 1.0, 20.0).select("posting_id")


@register("flt3_search", DASH +
          "SELECT posting_id FROM dash WHERE coalesce(regexp_matches(title, '(?i)ou|EI') "
          "OR regexp_matches(company, '(?i)ou|EI'), false)")
def flt3_search(spark, sf):
    return RP.search(_dash(spark, sf), "ou|EI").select("posting_id")


@register("flt4_high_risk", DASH + "SELECT posting_id FROM dash WHERE final_ghost_score >= 10.0")
def flt4_high_risk(spark, sf):
    return RP.high_risk(_dash(spark, sf), 10.0).select("posting_id")


@register("flt5_at_least_or_all", DASH + f"""
SELECT 't60' AS variant, company FROM best
WHERE {S.rnd('final_score', 1)} >= 60.0 OR NOT (SELECT coalesce(bool_or({S.rnd('final_score', 1)} >= 60.0), false) FROM best)
UNION ALL
SELECT 't12' AS variant, company FROM best
WHERE {S.rnd('final_score', 1)} >= 12.0 OR NOT (SELECT coalesce(bool_or({S.rnd('final_score', 1)} >= 12.0), false) FROM best)""")
def flt5_at_least_or_all(spark, sf):
    """FLT5 at a threshold nothing reaches (keeps all) and one some reach."""
    p, r = D.postings(spark, sf), D.reviews(spark, sf)
    b = RP.best_per_company(RP.scored(p, _scores(spark, sf)), p, r)
    b = b.select("company", "ghost_score").checkpoint(eager=True)       # two numbers per company, read by flags and rows
    a = RP.at_least_or_all(b, "ghost_score", 60.0).select(F.lit("t60").alias("variant"), "company")
    c = RP.at_least_or_all(b, "ghost_score", 12.0).select(F.lit("t12").alias("variant"), "company")
    return a.unionByName(c)


@register("top2_ranked", DASH + f"""
SELECT row_number() OVER (ORDER BY {S.rnd('final_score', 1)} DESC, company) AS rank, company,
       {S.rnd('final_score', 1)} AS ghost_score FROM best""")
def top2_ranked(spark, sf):
    p, r = D.postings(spark, sf), D.reviews(spark, sf)
    b = RP.best_per_company(RP.scored(p, _scores(spark, sf)), p, r)
    return RP.ranked(b.select("company", "ghost_score"), "ghost_score").select("rank", "company", "ghost_score")


@register("top3_recent_events", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type FROM events
ORDER BY ts DESC, event_id DESC LIMIT 50""")
def top3_recent_events(spark, sf):
    ev = D.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    top = RP.recent_events(ev, 50)
    return top.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_type")


def _signals_sql():
    from postingscope import lexicons as L
    T = L.SIGNAL_TEXT
    c = L.SIGNAL_CUTS
    parts = [f"CASE WHEN coalesce(repost_score, 0) > {c['repost']} THEN {S.q(T['repost'][0])} END",
             f"CASE WHEN coalesce(genericness_score, 0) > {c['genericness']} THEN {S.q(T['genericness'][0])} END",
             f"CASE WHEN coalesce(vagueness_score, 0) > {c['vagueness']} THEN {S.q(T['vagueness'][0])} END",
             f"CASE WHEN coalesce(urgency_score, 0) > {c['urgency']} THEN {S.q(T['urgency'][0])} END",
             f"CASE WHEN coalesce(sentiment_score, 0) > {c['sentiment']} THEN {S.q(T['sentiment'][0])} END"]
    arr = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({arr}) = 0 THEN {S.q(T['standard'][0])} ELSE array_to_string({arr}, ' | ') END"


@register("rpt1_signals", DASH + f"SELECT job_posting_id, {_signals_sql()} AS signals FROM scores")
def rpt1_signals(spark, sf):
    s = _scores(spark, sf)
    sig = signals("repost_score", "genericness_score", "vagueness_score", "urgency_score", "sentiment_score")
    return s.select("job_posting_id", F.array_join(F.transform(sig, lambda x: x["title"]), " | ").alias("signals"))


@register("rpt3_risk_band", DASH + """
SELECT posting_id, CASE WHEN final_ghost_score < 5 THEN 'low' WHEN final_ghost_score < 10 THEN 'medium'
                        ELSE 'high' END AS band FROM dash""")
def rpt3_risk_band(spark, sf):
    return _dash(spark, sf).select("posting_id", risk_band("final_ghost_score", (5.0, 10.0)).alias("band"))


JSON_LD_SQL = """'{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"' || company || '","url":"'
       || coalesce(career_url, 'https://example.com/careers/' || company) || '"},{"@type":"Report","headline":"'
       || 'Hiring transparency report: ' || company || '","description":"Posting-viability risk for ' || company
       || ': ' || CAST(ghost_score AS VARCHAR) || '/100."}]}'"""


@register("job7_company_reports", DASH + "," + _theme_sql() + f""",
shown AS (SELECT *, {S.rnd('final_score', 1)} AS ghost_score FROM best)
SELECT row_number() OVER (ORDER BY ghost_score DESC, company) AS rank, company, {S.slugify('company')} AS slug, ghost_score,
       CASE WHEN ghost_score < 30 THEN 'low' WHEN ghost_score < 60 THEN 'medium' ELSE 'high' END AS band,
       {_signals_sql()} AS signals, themes, {JSON_LD_SQL} AS json_ld, posting_count, review_count
FROM shown LEFT JOIN themes USING (company)
WHERE ghost_score >= 60.0 OR NOT (SELECT coalesce(bool_or(ghost_score >= 60.0), false) FROM shown)""")
def job7_company_reports(spark, sf):
    """JOB7: JOIN1 -> AGG5 -> FLT5 -> TOP2 -> RPT1-3 and AGG20 themes, ranked by score."""
    p, r = D.postings(spark, sf), D.reviews(spark, sf)
    # one row per company; materialised once (report_rows), read by flag and rows
    b = RP.best_per_company(RP.scored(p, _scores(spark, sf)), p, r)
    themes = RP.complaint_themes(r, D.companies(spark, sf).select(F.col("name").alias("company")), DATA_THEMES)
    rows = RP.ranked(RP.report_rows(b, themes, 60.0), "ghost_score")
    return rows.select("rank", "company", "slug", "ghost_score", "band",
                       F.array_join(F.transform("signals", lambda x: x["title"]), " | ").alias("signals"),
                       F.array_join("themes", " | ").alias("themes"), "json_ld", "posting_count", "review_count")


PAGE_REPORT = with_(S.PAGE_EVENTS, """
report AS (
  SELECT page_path AS pagePath, count(*) FILTER (WHERE event_type = 'view') AS screenPageViews,
         sum(engagement) AS userEngagementDuration,
         count(*) FILTER (WHERE event_type = 'error') / count(*) AS bounceRate
  FROM page_events GROUP BY page_path
)""")


def page_report(spark, sf):
    ev = D.page_events(spark, sf)
    return ev.groupBy(F.col("page_path").alias("pagePath")).agg(
        F.count_if(F.col("event_type") == "view").alias("screenPageViews"),
        F.sum("engagement").alias("userEngagementDuration"),
        (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("bounceRate"))


@register("src12_page_metrics", PAGE_REPORT + f"""
SELECT {S.title_case("replace(replace(split_part(pagePath, '/company/', -1), '.html', ''), '-', ' ')")} AS company,
       pagePath AS page, screenPageViews AS pageviews,
       {S.rnd('CASE WHEN screenPageViews > 0 THEN userEngagementDuration / screenPageViews ELSE 0.0 END', 1)} AS avg_time_on_page,
       {S.rnd('bounceRate', 3)} AS bounce_rate
FROM report WHERE contains(pagePath, '/company/')""")
def src12_page_metrics(spark, sf):
    return RP.page_metrics(page_report(spark, sf))


@register("agg19_traffic_kpis", PAGE_REPORT + f""",
m AS (SELECT screenPageViews AS pageviews,
             {S.rnd('CASE WHEN screenPageViews > 0 THEN userEngagementDuration / screenPageViews ELSE 0.0 END', 1)} AS t,
             {S.rnd('bounceRate', 3)} AS b FROM report WHERE contains(pagePath, '/company/'))
SELECT CAST(sum(pageviews) AS BIGINT) AS total_views, {S.rnd('avg(t)', 9)} AS avg_time,
       {S.rnd('avg(b) * 100.0', 9)} AS avg_bounce_pct,
       CAST(floor(sum(pageviews) * 0.4) AS BIGINT) AS active_users, CAST(floor(sum(pageviews) * 0.6) AS BIGINT) AS sessions
FROM m""")
def agg19_traffic_kpis(spark, sf):
    k = RP.traffic_kpis(RP.page_metrics(page_report(spark, sf)))
    return k.select("total_views", r6("avg_time").alias("avg_time"), r6("avg_bounce_pct").alias("avg_bounce_pct"),
                    "active_users", "sessions")


TRAFFIC = DASH + "," + PAGE_REPORT[len("WITH "):] + f""",
m AS (SELECT {S.title_case("replace(replace(split_part(pagePath, '/company/', -1), '.html', ''), '-', ' ')")} AS company,
             screenPageViews AS pageviews FROM report WHERE contains(pagePath, '/company/')),
bc AS (SELECT company, avg(final_ghost_score) AS avg_score,
              arg_min(sentiment_score, posting_id) FILTER (WHERE sentiment_score IS NOT NULL) AS sentiment
       FROM dash GROUP BY company),
tc AS (SELECT m.company, m.pageviews, bc.avg_score FROM m JOIN bc ON {S.slugify('m.company')} = {S.slugify('bc.company')})"""


def _corr_sql(x, y, rel):
    return f"""SELECT CASE WHEN count(*) < 2 OR min({x}) = max({x}) OR min({y}) = max({y}) THEN NULL
            ELSE {S.rnd(f'covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y}))', 9)} END AS r, count(*) AS n
       FROM {rel} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""


@register("join5_traffic_vs_score", TRAFFIC + f"SELECT company, pageviews, {S.rnd('avg_score', 9)} AS avg_score FROM tc")
def join5_traffic_vs_score(spark, sf):
    """JOIN5: page traffic joined to the company mean score on the company
    slug (page names are title-cased slugs of the company name)."""
    return _traffic(spark, sf, _dash(spark, sf)).select("company", "pageviews", r6("avg_score").alias("avg_score"))


def _traffic(spark, sf, dash):
    m = RP.page_metrics(page_report(spark, sf)).withColumn("_slug", slugify(F.col("company")))
    cs = RP.score_by_company(dash).select(slugify(F.col("company")).alias("_slug"), "avg_score")
    j = RP.traffic_vs_score(m.drop("company").withColumnRenamed("_slug", "company"),
                            cs.withColumnRenamed("_slug", "company"))
    out = j.join(m.select(F.col("_slug").alias("company"), F.col("company").alias("name")), "company")
    return out.select(F.col("name").alias("company"), "pageviews", "avg_score")


@register("job8_traffic_view", TRAFFIC + f""",
tv AS (SELECT {S.title_case("replace(replace(split_part(pagePath, '/company/', -1), '.html', ''), '-', ' ')")} AS company, pagePath AS page,
              screenPageViews AS pageviews,
              {S.rnd('CASE WHEN screenPageViews > 0 THEN userEngagementDuration / screenPageViews ELSE 0.0 END', 1)} AS t,
              {S.rnd('bounceRate', 3)} AS bounce_rate FROM report WHERE contains(pagePath, '/company/'))
SELECT tv.page, tv.company, tv.pageviews, tv.t AS avg_time_on_page,
       printf('%dm %02ds', CAST(floor(tv.t / 60) AS BIGINT), CAST(floor(tv.t % 60) AS BIGINT)) AS time_label, tv.bounce_rate,
       {S.rnd('b.avg_score', 9)} AS avg_score, b.postings, CAST(floor(sum(tv.pageviews) OVER () * 0.4) AS BIGINT) AS all_active,
       (SELECT c.r FROM ({_corr_sql("pageviews", "avg_score", "tc")}) c) AS traffic_r
FROM tv LEFT JOIN (SELECT company, avg(final_ghost_score) AS avg_score, count(*) AS postings FROM dash GROUP BY company) b
  ON {S.slugify('tv.company')} = {S.slugify('b.company')}""")
def job8_traffic_view(spark, sf):
    """JOB8 traffic view: every report page with its score (JOIN5), the estimate of active readers (AGG19) and the
    correlation of views and scores (AGG15)."""
    dash = _dash(spark, sf).select("company", "final_ghost_score").checkpoint(eager=True)
    m = RP.page_metrics(page_report(spark, sf)).checkpoint(eager=True)          # one row per page, read three times
    v = RP.traffic_view(m, RP.score_by_company(dash))
    return v.select("page", "company", "pageviews", "avg_time_on_page", "time_label", "bounce_rate", r6("avg_score").alias("avg_score"),
                    "postings", "all_active", r6("traffic_r").alias("traffic_r"))


@register("agg15_traffic_correlation", TRAFFIC + _corr_sql("pageviews", "avg_score", "tc"))
def agg15_traffic_correlation(spark, sf):
    """AGG15: page views vs company mean score."""
    c = RP.company_correlation(_traffic(spark, sf, _dash(spark, sf)), "pageviews", "avg_score")
    return c.select(r6("r").alias("r"), "n")


@register("job9_summary_stats", TRAFFIC + "," + LAB + f""",
cs AS ({_corr_sql("avg_score", "sentiment", "bc")}),
ct AS ({_corr_sql("pageviews", "avg_score", "tc")}),
quality AS (SELECT {METRICS_SELECT} FROM met)
SELECT (SELECT count(*) FROM postings) AS postings, (SELECT count(*) FROM reviews) AS reviews,
       (SELECT count(DISTINCT company) FROM (SELECT company FROM postings UNION ALL SELECT company FROM reviews)) AS companies,
       s.*, quality.*, cs.r AS sentiment_r, cs.n AS sentiment_n, ct.r AS traffic_r, ct.n AS traffic_n
FROM (SELECT count(final_score) AS n, {S.rnd('avg(final_score)', 9)} AS mean, {S.rnd('stddev_pop(final_score)', 9)} AS std,
             min(final_score) AS min, {S.rnd('quantile_cont(final_score, 0.25)', 9)} AS p25,
             {S.rnd('quantile_cont(final_score, 0.5)', 9)} AS median, {S.rnd('quantile_cont(final_score, 0.75)', 9)} AS p75,
             max(final_score) AS max, count(*) FILTER (WHERE final_score >= 10.0) AS high_risk FROM scores) s,
     quality, cs, ct""")
def job9_summary_stats(spark, sf):
    """JOB9: coverage (AGG11), score summary (AGG10), classifier quality (AGG17) and both company
    correlations (AGG15); the scores are computed once, all joins are between one-row tables."""
    dash = _dash(spark, sf).select("posting_id", "company", "bert_score", "sentiment_score", "final_ghost_score").checkpoint(eager=True)
    s = ST.score_summary(dash, "final_ghost_score", high=10.0)
    lab = D.table(spark, sf, "labels").join(dash, F.expr("doc_id = posting_id")).select(
        (F.lit(1) - F.col("quality")).alias("y_true"), (F.col("bert_score") > PRED_CUT).cast("int").alias("y_pred"))
    cs = RP.company_correlation(RP.by_company(dash), "avg_score", "sentiment")
    ct = RP.company_correlation(_traffic(spark, sf, dash), "pageviews", "avg_score")
    summary = s.select("n", *[r6(c).alias(c) if c in ("mean", "std", "p25", "median", "p75") else F.col(c)
                              for c in ("mean", "std", "min", "p25", "median", "p75", "max")], "high_risk")
    return (RP.coverage(D.postings(spark, sf), D.reviews(spark, sf)).crossJoin(summary).crossJoin(ST.classifier_metrics(lab))
            .crossJoin(cs.select(r6("r").alias("sentiment_r"), F.col("n").alias("sentiment_n")))
            .crossJoin(ct.select(r6("r").alias("traffic_r"), F.col("n").alias("traffic_n"))))


@register("top2_traffic_ranked", PAGE_REPORT + f"""
SELECT row_number() OVER (ORDER BY screenPageViews DESC, pagePath) AS rank, pagePath AS page,
       screenPageViews AS pageviews
FROM report WHERE contains(pagePath, '/company/')""")
def top2_traffic_ranked(spark, sf):
    """TOP2 / AGG19 per-page list: report pages by views, descending."""
    m = RP.page_metrics(page_report(spark, sf))
    return RP.ranked(m.select("page", "pageviews"), "pageviews", "page").select("rank", "page", "pageviews")


@register("rpt2_json_ld", DASH + f"""
SELECT company, {JSON_LD_SQL} AS json_ld
FROM (SELECT company, career_url, {S.rnd("final_score", 1)} AS ghost_score FROM best)""")
def rpt2_json_ld(spark, sf):
    """RPT2: JSON-LD block per company report."""
    p, r = D.postings(spark, sf), D.reviews(spark, sf)
    b = RP.best_per_company(RP.scored(p, _scores(spark, sf)), p, r)
    return b.select("company", RP.json_ld(F.col("company"), F.col("career_url"), F.col("ghost_score"),
                                          F.col("slug")).alias("json_ld"))
