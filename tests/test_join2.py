"""JOIN2 on own rows: the joins of the ingest and of the scores carry no text, and no result depends on it."""

import re

import pytest
from pyspark.sql import DataFrame

from postingscope.plans import q_reports as Q
from postingscope.plans.q_ingest import job1_saved_postings, win1_mark_reposts

TEXT = {"description", "text", "_text", "_lt", "_toks", "html"}
WORDY = "all rights reserved and the license of the round\n" + "that is the long text with the words and the rest of it " * 20


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("join2"))
    docs = [(1, WORDY + "1", "en", "src1", 40), (200, WORDY + "200", "en", "src1", 50), (201, " " * 300 + "far behind spaces", "fr", "src2", 60),
            (202, "   short   ", "de", "src1", 70), (203, WORDY + "203", None, None, 80), (204, None, "en", "src3", None),
            (205, WORDY + "200", "en", "src1", 50), (206, WORDY + "206", "en", "src1", 50)]
    vecs = [(i, [1.0, 2.0, 3.0], 7) for i in (1, 200, 201, 202, 206)] + [(203, [0.0, 0.0, 0.0], None), (206, [1.0, 2.0, 3.0], 7)]
    w = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
         "embeddings": (vecs, "vec_id long, embedding array<float>, label int"),
         "conversations": ([(1, 0, "user", "and the reply of the company"), (2, 1, "user", None)], "conv_id long, turn int, role string, text string"),
         "benchmark": ([(1, "that text with words and the rest")], "item_id long, text string")}
    for name, (rows, schema) in w.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def exchanged(df: DataFrame) -> set[str]:
    """Names of the columns that go through the exchanges of a plan."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"^\(\d+\) Exchange *\nInput \[\d+\]: \[(.*)\]$", plan, re.M)
    return {name for cols in inputs for name in re.findall(r"(\w+)#\d+", cols)}


@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_join2_shuffles_no_text(spark, tables, monkeypatch, ids):
    seen, kind = set(), type(spark.range(0))
    checkpoint = kind.checkpoint

    def watched(df, *args, **kw):
        seen.update(exchanged(df))
        return checkpoint(df, *args, **kw)

    monkeypatch.setattr(kind, "checkpoint", watched)
    monkeypatch.setattr(Q, "BROADCAST_IDS", ids, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = Q.join2_scored_or_default(spark, tables)
        seen |= exchanged(out)
        rows = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "url" in seen and "embedding" in seen and not seen & TEXT, seen
    got = {r[0]: r[1:] for r in rows}
    assert set(got) == {1, 200, 201, 202, 203, 204, 205, 206}
    assert got[204] == ("en", 0.0, 0.0) and got[205] == ("en", 0.0, 0.0)                    # no vector: no score
    assert got[203][0] == "Not Specified" and all(got[i][2] > 0 for i in (1, 200, 203, 206))
    assert len(rows) == 9          # 206 has two vectors: twice in the batch, a mark from each


def test_eligibility_is_of_the_whole_text(spark, tables):
    got = {r.id: r.repost_of_id for r in win1_mark_reposts(spark, tables).collect()}
    assert got[201] == 200 and got[202] is None and got[200] == 1


def test_saved_postings_hash_the_same_characters(spark, tables):
    import hashlib
    got = {r.id: r.content_hash for r in job1_saved_postings(spark, tables).collect()}
    head = WORDY[:250].strip()
    assert got[206] == hashlib.sha256(f"c7:{WORDY.split(chr(10))[0].lower()}:{head}".encode()).hexdigest()
