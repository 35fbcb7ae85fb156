import json
from datetime import datetime

from pyspark.sql import functions as F

from postingscope.functions.features import ts
from postingscope.operators import reports as RP
from tests.conftest import one

PS = "id long, company string, title string, url string, location string, posted_date timestamp, " \
     "scraped_at timestamp, source string"
SS = ("job_posting_id long, genericness_score double, vagueness_score double, repost_score double, "
      "urgency_score double, bert_score double, sentiment_score double, final_score double")
T = datetime(2024, 1, 10)


def test_company_report_single_posting(spark):
    p = spark.createDataFrame([(1, "Acme Corp", "Dev", "https://acme.example/jobs/1", None, T, T, "career")], PS)
    s = spark.createDataFrame([(1, 0.3, 0.0, 0.55, 0.0, 0.2, 0.1, 68.5)], SS)
    r = spark.createDataFrame([], "company string, text string")
    best = RP.best_per_company(RP.scored(p, s), p, r)
    themes = RP.complaint_themes(r, best.select("company"))
    rows = RP.report_rows(best, themes, 50.0).collect()
    assert len(rows) == 1 and rows[0].slug == "acme-corp" and rows[0].ghost_score == 68.5
    doc = json.loads(rows[0].json_ld)
    assert "68.5/100" in doc["@graph"][1]["description"] and doc["@graph"][0]["name"] == "Acme Corp"
    assert rows[0].band == "high" and len(rows[0].themes) == 3


def test_threshold_fallback_keeps_all(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "company string, ghost_score double")
    assert RP.at_least_or_all(df, "ghost_score", 50.0).count() == 2
    assert [r.company for r in RP.at_least_or_all(df, "ghost_score", 15.0).collect()] == ["b"]


def test_loader_defaults_and_industry(spark):
    p = spark.createDataFrame([(1, "Acme", "Dev", None, "Remote", T, T, "career"),
                               (2, "Other", "Ops", None, None, T, T, "career")], PS)
    s = spark.createDataFrame([(1, 0.1, 0.1, 0.0, 0.1, 0.1, 0.2, 45.0)], SS)
    d = {r.posting_id: r for r in RP.scored_or_default(p, s).collect()}
    assert d[1].final_ghost_score == 45.0 and d[2].final_ghost_score == 0.0 and d[2].location == "Not Specified"
    comps = spark.createDataFrame([("Acme", "Fintech", None, None, None)],
                                  "name string, industry string, career_url string, query string, location string")
    ind = {r.company: r.industry for r in RP.with_industry(RP.scored_or_default(p, s),
                                                           RP.industry_dim(comps)).collect()}
    assert ind == {"Acme": "Fintech", "Other": "General Tech"}


def test_complaint_themes(spark):
    r = spark.createDataFrame([("A", "They ghosted me"), ("A", "took a long time"), ("B", "fine")],
                              "company string, text string")
    c = spark.createDataFrame([("A",), ("B",), ("C",)], "company string")
    from postingscope import lexicons as L
    t = {x.company: x.themes for x in RP.complaint_themes(r, c).collect()}
    assert t["A"] == [L.THEME_TEXT[0], L.THEME_TEXT[2], L.THEME_FILLER]
    assert t["B"] == [L.THEME_FILLER] * 3 and t["C"] == L.THEME_DEFAULTS


def test_page_metrics(spark):
    rep = spark.createDataFrame([("/company/h2o-labs.html", 10, 125.0, 0.33333), ("/about", 5, 1.0, 0.1),
                                 ("/company/acme.html", 0, 0.0, 0.5)],
                                "pagePath string, screenPageViews long, userEngagementDuration double, bounceRate double")
    m = {r.company: r for r in RP.page_metrics(rep).collect()}
    assert set(m) == {"H2O Labs", "Acme"} and m["H2O Labs"].avg_time_on_page == 12.5
    assert m["H2O Labs"].bounce_rate == 0.333 and m["Acme"].avg_time_on_page == 0.0
