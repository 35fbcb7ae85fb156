from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postingscope.functions.features import ts
from postingscope.operators import dedupe as DD
from postingscope.operators import stats as ST
from postingscope.operators.sentiment import sentiment_by_company
from postingscope.operators.sets import fallback_union
from postingscope.sources.forum import flatten_submissions
from tests.conftest import one

RS = "id long, company string, source string, text string, posted_at timestamp, scraped_at timestamp"
T = datetime(2024, 1, 10)


def test_review_save_twice(spark):
    batch = spark.createDataFrame([(1, "A", "f", "slow process, never heard back", T, T),
                                   (2, "A", "f", "great interview experience", T, T),
                                   (3, "A", "f", "   ", T, T)], RS)
    saved, skipped, blank = DD.new_reviews(batch, None)
    assert (saved.count(), skipped.count(), blank.count()) == (2, 0, 1)
    again = batch.withColumn("id", F.col("id") + 10)
    saved2, skipped2, blank2 = DD.new_reviews(again, saved)
    assert (saved2.count(), skipped2.count(), blank2.count()) == (0, 2, 1)
    tagged = (saved2.select("company", F.lit("saved").alias("status"))
              .unionByName(skipped2.select("company", F.lit("skipped").alias("status")))
              .unionByName(blank2.select("company", F.lit("blank").alias("status"))))
    tot = [r for r in DD.review_stats(tagged).collect() if r.company is None][0]
    assert (tot.total, tot.saved, tot.skipped) == (3, 0, 2)


def test_submissions(spark):
    subs = spark.createDataFrame(
        [(1, "Acme", "Ghosted after final round", "Waited weeks, nothing", 1704067200.0,
          [("Same here, never heard back from them", 1704067300.0), ("short", 1.0)])],
        "sub_id long, company string, title string, selftext string, created_utc double, "
        "comments array<struct<body:string,created_utc:double>>")
    out = flatten_submissions(subs, ts("2024-02-01 00:00:00")).collect()
    assert len(out) == 2
    assert out[1].text.startswith("Comment on 'Ghosted after final round': ")


def test_recency_weighting(spark):
    # a recent frustrated review outweighs an old neutral one
    rows = [(1, "A", "f", "ghosted after the onsite, radio silence since", datetime(2024, 1, 31), T),
            (2, "A", "f", "a normal process with clear updates", datetime(2023, 12, 2), T)]
    s = one(sentiment_by_company(spark.createDataFrame(rows, RS), ts("2024-02-01 00:00:00")))
    f1 = round(0.6 * min(1.0, (0.95 + 0.85) / 2 * 0.85), 4)
    import math
    w1, w2 = math.exp(-0.03 * 1), math.exp(-0.03 * 61)
    assert s.score == round(w1 * f1 / (w1 + w2), 4) and s.review_count == 2
    assert s.score > f1 / 2  # leans to the recent review (no valence table: baseline 0)


def test_fallback_union(spark):
    prim = spark.createDataFrame([(1, "A", "p", "x", T, T)] * 1 + [(i, "B", "p", "x", T, T) for i in range(10, 16)], RS)
    sec = spark.createDataFrame([(100 + i, c, "s", "y", T, T) for c in "ABC" for i in range(12)], RS)
    comps = spark.createDataFrame([("A",), ("B",), ("C",)], "company string")
    out = fallback_union(prim, sec, comps).groupBy("company", "source").count().collect()
    got = {(r.company, r.source): r["count"] for r in out}
    assert got == {("A", "p"): 1, ("A", "s"): 10, ("B", "p"): 6, ("C", "s"): 12}


def test_pearson_cases(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert tuple(one(ST.pearson(empty, "x", "y"))) == (0.0, 0, 1.0)
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert tuple(one(ST.pearson(const, "x", "y"))) == (0.0, 3, 1.0)
    xs = [(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (4.0, 8.2), (5.0, 9.8)]
    r = one(ST.pearson(spark.createDataFrame(xs, "x double, y double"), "x", "y"))
    import numpy as np
    assert abs(r.r - np.corrcoef([a for a, _ in xs], [b for _, b in xs])[0, 1]) < 1e-12


@pytest.mark.parametrize("r,n,p", [(-0.7870, 5, 0.1142), (0.9942, 5, 0.0005)])
def test_p_values(spark, r, n, p):
    got = spark.range(1).select(ST.two_sided_p(F.lit(r), F.lit(n).cast("long")).alias("p")).first().p
    assert round(got, 4) == p


def test_p_value_edges(spark):
    """Closed form at three degrees of freedom; degenerate cases."""
    import math
    rows = [(r, 5) for r in (-0.999, -0.5, 0.0, 0.25, 0.9)] + [(1.0, 9), (-1.0, 9), (None, 9), (0.3, 2), (0.3, None)]
    got = [x.p for x in spark.createDataFrame(rows, "r double, n long").select(ST.two_sided_p(F.col("r"), F.col("n")).alias("p")).collect()]

    def p3(r):
        t = abs(r) * math.sqrt(3 / (1 - r * r))
        return 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + t / math.sqrt(3) / (1 + t * t / 3))
    assert all(abs(g - p3(r)) < 1e-12 for g, (r, _) in zip(got, rows[:5])) and got[5:] == [0.0, 0.0, 1.0, 1.0, 1.0]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 2000])
def test_quantiles_of_unrounded_values(spark, n):
    """Exact, also where one value holds a third of all rows, and with few values."""
    import numpy as np
    rng = np.random.default_rng(n)
    v = [float(x) for x in np.where(rng.random(n) < 0.33, 0.125, rng.normal(size=n))]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = one(ST.quantiles(ST.value_ranges(df, "v"), probs))
    assert list(got) == ([None] * 7 if not n else pytest.approx(list(np.quantile(v, probs)), abs=1e-12))


def test_spearman_of_unrounded_values(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000).round(2)
    y = x * 0.3 + rng.normal(size=3000)
    got = one(ST.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(6), "x", "y"))

    def rank(v):
        s, (u, c) = np.sort(v), np.unique(v, return_counts=True)
        return dict(zip(u, np.searchsorted(s, u) + (c + 1) / 2))
    rx, ry = rank(x), rank(y)
    want = np.corrcoef([rx[a] for a in x], [ry[b] for b in y])[0, 1]
    assert abs(got.r - want) < 1e-12 and got.n == 3000 and got.p < 1e-20


def test_spearman_average_ranks(spark):
    xs = [(1.0, 5.0), (2.0, 5.0), (2.0, 3.0), (3.0, 1.0), (4.0, 1.0)]
    got = one(ST.spearman(spark.createDataFrame(xs, "x double, y double"), "x", "y", with_p=False)).r
    import numpy as np

    def avg_rank(v):
        s = sorted(v)
        return [np.mean([i + 1 for i, w in enumerate(s) if w == x]) for x in v]
    rx, ry = avg_rank([a for a, _ in xs]), avg_rank([b for _, b in xs])
    assert abs(got - np.corrcoef(rx, ry)[0, 1]) < 1e-12


def test_classifier_metrics(spark):
    y = [int(c) for c in "110010110010"]
    p = [int(c) for c in "110010100010"]
    m = one(ST.classifier_metrics(spark.createDataFrame(list(zip(y, p)), "y_true int, y_pred int")))
    assert (m.precision, m.recall, m.f1, m.accuracy) == (1.0, 0.8333, 0.9091, 0.9167)
    cm = {r.y_true: (r.pred_0, r.pred_1) for r in ST.confusion(
        spark.createDataFrame(list(zip(y, p)), "y_true int, y_pred int")).collect()}
    assert cm == {0: (6, 0), 1: (1, 5)}


def test_histogram_and_summary(spark):
    df = spark.createDataFrame([(0.0,), (4.99,), (5.0,), (100.0,), (None,)], "final_score double")
    h = {r.bin: r["count"] for r in ST.histogram(df).collect()}
    assert len(h) == 20 and h[0] == 2 and h[1] == 1 and h[19] == 1 and sum(h.values()) == 4
    import numpy as np
    v = [0.0, 4.99, 5.0, 100.0]
    s = one(ST.score_summary(df))
    assert abs(s.std - np.std(v)) < 1e-12 and s.median == np.percentile(v, 50) and s.p25 == np.percentile(v, 25)
