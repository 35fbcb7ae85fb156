from pyspark.sql import functions as F

from postingscope import lexicons as L
from postingscope.functions import features as FX
from tests.conftest import one

BUZZ = ("Join our dynamic team in a fast-paced environment! We need a self-starter and team player "
        "who can wear many hats, hit the ground running and think outside the box. Competitive salary.")
TECH = ("Implement a lock-free ring buffer in Rust for the ingest service; profile p99 latency with perf, "
        "tune NUMA pinning on 64-core hosts, and write property tests for the sequence-number recovery "
        "protocol across replicas during network partitions.")


def scores(spark, texts, fn):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


def test_genericness_bounds(spark):
    hi, lo = scores(spark, [BUZZ, TECH], FX.genericness)
    assert hi > 0.5 and lo < 0.2


def test_genericness_exact(spark):
    got = scores(spark, ["our synergy is great", "", "   ", "!!!", None], FX.genericness)
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]
    long = " ".join(["word"] * 99) + " synergy"
    assert scores(spark, [long], FX.genericness) == [round(1 / 100 * 25, 4)]


def test_nested_phrases_each_count(spark):
    t = "fast-growing company " + " ".join(["x"] * 97)
    # 'fast-growing company' and 'fast-growing' both present
    assert scores(spark, [t], FX.genericness) == [round(2 / 100 * 25, 4)]


def test_urgency(spark):
    t = "Always hiring! Immediate start, apply now to join our talent pool."
    assert scores(spark, [t], FX.urgency)[0] > 0.5


def test_repost_score(spark):
    df = spark.createDataFrame([(None, None), (7, None), (7, 2), (7, 4), (None, 3)], "rid long, cnt int")
    got = [r[0] for r in df.select(FX.repost_score("rid")).collect()]
    assert got == [0.0, 0.55, 0.55, 0.55, 0.0]
    got = [r[0] for r in df.select(FX.repost_score("rid", "cnt")).collect()]
    assert got == [0.0, 0.55, 0.7, 1.0, 0.85]


def test_final_score(spark):
    rows = [(0.0,) * 6, (1.0,) * 6, (0.5,) * 6, (1.5,) * 6]
    df = spark.createDataFrame(rows, "g double, v double, r double, u double, b double, s double")
    got = [r[0] for r in df.select(FX.final_score("g", "v", "r", "u", "b", "s")).collect()]
    assert got == [0.0, 100.0, 50.0, 100.0]
    zero = {k: 0.0 for k in L.DEFAULT_WEIGHTS}
    assert [r[0] for r in df.select(FX.final_score("g", "v", "r", "u", "b", "s", zero)).collect()] == [0.0] * 4
    partial = {"genericness": 0.5}
    got = [r[0] for r in df.select(FX.final_score("g", "v", "r", "u", "b", "s", partial)).collect()]
    # numerator uses defaults for missing keys, denominator only 0.5
    exp = [min(100.0, max(0.0, round((0.5 * x + 0.2 * x + 0.2 * x + 0.15 * x + 0.15 * x + 0.1 * x) / 0.5 * 100, 2)))
           for x in (0.0, 1.0, 0.5, 1.5)]
    assert got == exp


def test_rule_probability_and_label(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.55, 0.9, "text"), (0.9, 0.9, 0.55, 0.9, "  ")],
                               "g double, v double, r double, u double, t string")
    got = df.select(FX.rule_probability("g", "v", "r", "u", "t"), FX.bootstrap_label("g", "v", "u")).collect()
    assert got[0][0] == round(0.3 * 0.9 + 0.3 * 0.9 + 0.2 * 0.55 + 0.2 * 0.9, 4) and got[0][1] == 1
    assert got[1][0] == 0.0


def test_frustration(spark):
    t1 = "I was ghosted after the interview and it was awful"
    t4 = "fake job posting, job wasn't real, interviewed for a job that didn't exist, no intention of hiring"
    got = scores(spark, ["a perfectly fine day", t1, t4, ""], FX.frustration)
    assert got == [0.0, round(0.6 * min(1.0, 0.95 / 1 * 0.85), 4), 0.6, 0.0]


def test_baseline_negativity(spark):
    df = spark.createDataFrame([(0.0, 0.0, "x"), (-1.0, 1.0, "x"), (None, None, "x"), (0.0, 0.0, " ")],
                               "c double, n double, t string")
    got = [r[0] for r in df.select(FX.baseline_negativity("c", "n", "t")).collect()]
    assert got == [0.35, 1.0, 0.0, 0.0]


def test_signals_and_bands(spark):
    df = spark.createDataFrame([(0.55, 0.3, 0.0, 0.0, 0.0, 68.5), (0.0, 0.0, 0.0, 0.0, 0.0, 10.0)],
                               "r double, g double, v double, u double, s double, score double")
    rows = df.select(FX.signals("r", "g", "v", "u", "s").alias("sig"), FX.risk_band("score").alias("b")).collect()
    assert [x["title"] for x in rows[0].sig] == [L.SIGNAL_TEXT["repost"][0], L.SIGNAL_TEXT["genericness"][0]]
    assert "3 times" in rows[0].sig[0]["description"]
    assert [x["title"] for x in rows[1].sig] == [L.SIGNAL_TEXT["standard"][0]]
    assert [r.b for r in rows] == ["high", "low"]


def test_default_weights_sum_to_one():
    assert abs(sum(L.DEFAULT_WEIGHTS.values()) - 1.0) < 1e-12


def test_training_set_csv(spark, tmpdir_path):
    import os
    from postingscope.operators.maintenance import write_csv
    from postingscope.operators.scoring import training_set
    p = spark.createDataFrame([(1, "A", "Dev", BUZZ, None, None), (2, "B", "Ops", TECH, "", 5)],
                              "id long, company string, title string, description string, cleaned_text string, "
                              "repost_of_id long")
    t = training_set(p)
    path = write_csv(t, os.path.join(tmpdir_path, "train"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["id", "company", "title", "description", "genericness_score", "vagueness_score",
                            "repost_score", "urgency_score", "bootstrap_ghost_label", "manually_verified_label"]
    rows = {int(r.id): r for r in back.collect()}
    assert rows[2].repost_score == "0.55" and rows[1].bootstrap_ghost_label == rows[1].manually_verified_label
