import os
from datetime import datetime

from pyspark.sql import functions as F

from postingscope.functions.features import ts
from postingscope.operators import maintenance as M
from postingscope.operators.lexicon import match_phrase_list, match_phrases, rarest_grams
from postingscope.operators.scoring import vagueness
from postingscope.sources.config import read_companies, read_phrases, read_weighted_phrases
from postingscope.streaming.scoring import start_scoring


def test_read_companies(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c.json")
    with open(p, "w") as f:
        f.write('{"companies": [{"name": "Acme", "industry": "Fintech"}, {"name": "Beta"}, {"bad": 1}]}')
    df = read_companies(spark, p)
    assert [(r.name, r.industry) for r in df.collect()] == [("Acme", "Fintech"), ("Beta", None)]
    assert read_companies(spark, p, limit=1).count() == 1
    assert read_companies(spark, os.path.join(tmpdir_path, "missing.yaml")).count() == 0
    q = os.path.join(tmpdir_path, "l.json")
    with open(q, "w") as f:
        f.write('[{"name": "Gamma"}]')
    assert read_companies(spark, q).first().name == "Gamma"


def test_read_lexicons(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "u.txt")
    with open(p, "w") as f:
        f.write("  Always Hiring \n\n talent pool\n   \n")
    for path in (p, "file://" + p):
        assert [r.phrase for r in read_phrases(spark, path).collect()] == ["always hiring", "talent pool"]
    c = os.path.join(tmpdir_path, "w.csv")
    with open(c, "w") as f:
        f.write("phrase,weight\nGhosted After ,0.95\nradio silence,abc\n ,0.3\n")
    for path in (c, "file://" + c):
        assert [tuple(r) for r in read_weighted_phrases(spark, path).collect()] == [("ghosted after", 0.95), ("radio silence", 0.5)]


def test_match_phrases_paths_agree(spark):
    docs = spark.createDataFrame([(1, "We are ALWAYS hiring for the talent pool"), (2, "nothing here"),
                                  (3, "poolside ab")], "id long, text string")
    lex = spark.createDataFrame([("always hiring",), ("talent pool",), ("pool",), ("ab",)], "phrase string")
    small = {(r.id, r.phrase) for r in match_phrase_list(docs, [r.phrase for r in lex.collect()]).collect()}
    large = {(r.id, r.phrase) for r in match_phrases(docs, lex).collect()}
    assert small == large == {(1, "always hiring"), (1, "talent pool"), (1, "pool"), (3, "pool"), (3, "ab")}


def test_vagueness_with_nouns(spark):
    df = spark.createDataFrame([(1, "The team needs 3 people and the right culture"), (2, "Rust Go")],
                               "id long, _text string")
    nouns = spark.createDataFrame([("team", "team", False), ("people", "people", False),
                                   ("culture", "culture", False), ("rust", "rust", True)],
                                  "token string, lemma string, is_proper boolean")
    got = {r.id: r.vagueness_score for r in vagueness(df, nouns).collect()}
    # nouns: team, people (numeric modifier), culture -> vague: team, culture
    assert got == {1: round(2 / 3, 4), 2: 0.0}
    assert {r.vagueness_score for r in vagueness(df, None).collect()} == {0.0}


def test_score_stream_upserts(spark, tmpdir_path):
    S = ("id long, company string, title string, description string, cleaned_text string, "
         "repost_of_id long, url string")
    src = os.path.join(tmpdir_path, "in")
    spark.createDataFrame([(1, "A", "t", "<p>Dynamic team, fast-paced environment</p>", None, None, None),
                           (2, "B", "t", "Plain text", None, None, None)], S).write.parquet(src)
    sent = spark.createDataFrame([("A", 0.5)], "company string, score double")
    path = os.path.join(tmpdir_path, "scores")
    q = start_scoring(spark.readStream.schema(S).parquet(src), sent, ts("2024-02-01 00:00:00"), path,
                      os.path.join(tmpdir_path, "ck"))
    q.processAllAvailable()
    q.stop()
    got = {r.job_posting_id: (r.sentiment_score, r.genericness_score > 0) for r in M.read_table(spark, path).collect()}
    assert got == {1: (0.5, True), 2: (0.0, False)}


def test_phrases_enter_by_their_rarest_gram(spark):
    """A common first n-gram is no join key; candidates are few; phrases of one and two letters and absent ones too."""
    from pyspark.sql import functions as F
    texts = [f"the {w} of item {i}" for i, w in enumerate(["quick", "zebra", "plain", "story"] * 25)] + ["the", "", None, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    lex = spark.createDataFrame([("the zebra", 1), ("the quick of", 2), ("The Plain", 3), ("of", 4), ("b", 5), ("absent thing", 6), ("", 7), (None, 8)], "phrase string, w int")
    lt = docs.select("id", F.lower("text").alias("_lt"))
    words = lex.select(F.lower("phrase").alias("phrase")).filter("phrase is not null and phrase <> ''")
    rare = {r.phrase: (r._g, r.texts) for r in rarest_grams(lt, words, [1, 2, 3]).collect()}
    assert rare["the zebra"][1] == 25 and rare["the quick of"][1] == 25 and "the" not in {g for g, _ in rare.values()} and "absent thing" not in rare
    assert rare["of"][0] == "of" and rare["b"][0] == "b"
    want = {(i, p, w) for i, t in enumerate(texts) for p, w in [("the zebra", 1), ("the quick of", 2), ("the plain", 3), ("of", 4), ("b", 5)] if t and p in t}
    assert {tuple(r) for r in match_phrases(docs, lex).collect()} == want
    assert match_phrases(docs, lex.limit(0)).count() == 0
