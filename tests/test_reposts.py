import math
import random
from datetime import datetime, timedelta

from postingscope.operators.dedupe import new_by_url
from postingscope.operators.reposts import mark_reposts
from postingscope.operators.sequence import keyed_cumsum

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, company string, url string, description string, scraped_at timestamp, embedding array<float>"


def rows(items):
    return [(i, c, u, d, T0 + timedelta(minutes=i), e) for i, c, u, d, e in items]


def status(df):
    return {r.id: (r.status, r.repost_of_id) for r in df.collect()}


def test_new_repost_distinct(spark):
    inc = spark.createDataFrame(rows([
        (1, "A", "u1", "Backend engineer building payment APIs", [1.0, 0.0, 0.0]),
        (2, "A", "u2", "Backend engineer building payment APIs!", [0.99, 0.05, 0.0]),
        (3, "A", "u3", "Chef for a busy seafood kitchen downtown", [0.0, 0.0, 1.0]),
    ]), SCHEMA)
    out = status(mark_reposts(inc, None, threshold=0.92))
    assert out == {1: ("new", None), 2: ("repost", 1), 3: ("new", None)}


def test_window_limit_tie_and_short(spark):
    items = [(1, "B", None, "original description long enough", [1.0, 0.0])]
    items += [(i, "B", None, "filler posting description text", [0.0, 1.0]) for i in range(2, 22)]
    items += [(22, "B", None, "original description long enough", [1.0, 0.0])]   # match only at 21 back
    items += [(23, "C", None, "tie candidate one xxxxxxxx", [1.0, 1.0]),
              (24, "C", None, "tie candidate two xxxxxxxx", [1.0, 1.0]),
              (25, "C", None, "tie probe text long enough", [2.0, 2.0]),
              (26, "C", None, "short", [1.0, 1.0])]
    out = status(mark_reposts(spark.createDataFrame(rows(items), SCHEMA), None, threshold=0.92))
    assert out[22] == ("new", None)          # id 1 is 21 rows back: outside k=20
    assert out[3][0] == "repost"             # fillers repost each other
    assert out[25] == ("repost", 24)         # tie -> most recent
    assert out[26] == ("new", None)          # description too short


def test_stored_precede_incoming(spark):
    st = spark.createDataFrame(rows([(1, "A", "s1", "stored posting description", [1.0, 0.0])]), SCHEMA)
    inc = spark.createDataFrame([(2, "A", "x", "incoming posting description", T0 - timedelta(days=1), [1.0, 0.0])],
                                SCHEMA)
    assert status(mark_reposts(inc, st)) == {2: ("repost", 1)}


def brute(items, k, thr, min_len):
    out, hist = {}, {}
    for i, c, _u, d, e in sorted(items, key=lambda x: (x[0])):
        cands = hist.get(c, [])[-k:]
        best, bid = None, None
        if cands and d and len(d.strip()) > min_len:
            for j, (cid, ce) in enumerate(cands):
                na = math.sqrt(sum(x * x for x in e))
                nb = math.sqrt(sum(x * x for x in ce))
                s = sum(float(x) * float(y) for x, y in zip(e, ce)) / (na * nb) if na and nb else 0.0
                if best is None or s >= best:
                    best, bid = s, cid
        out[i] = ("repost", bid) if best is not None and best >= thr else ("new", None)
        hist.setdefault(c, []).append((i, e))
    return out


def test_matches_brute_force_with_hot_company(spark):
    rnd = random.Random(7)
    items = []
    for i in range(1, 400):
        c = "HOT" if rnd.random() < 0.6 else rnd.choice(["x", "y", "z"])
        base = [rnd.choice([0.0, 1.0]) for _ in range(4)]
        e = [float(round(b + rnd.random() * 0.2, 3)) for b in base]
        d = "d" * rnd.choice([5, 30])
        items.append((i, c, None, d, e))
    df = spark.createDataFrame(rows(items), SCHEMA)
    got = status(mark_reposts(df, None, threshold=0.95))
    f32 = [(i, c, u, d, [float(__import__("numpy").float32(x)) for x in e]) for i, c, u, d, e in items]
    assert got == brute(f32, 20, 0.95, 10)


def test_new_by_url(spark):
    st = spark.createDataFrame(rows([(1, "A", "u1", "d", [1.0])]), SCHEMA)
    inc = spark.createDataFrame(rows([(2, "A", "u1", "d", [1.0]), (3, "A", "u2", "d", [1.0]),
                                      (4, "A", "u2", "d", [1.0]), (5, "A", None, "d", [1.0]),
                                      (6, "A", "", "d", [1.0])]), SCHEMA)
    kept, skipped = new_by_url(inc, st)
    assert sorted(r.id for r in kept.collect()) == [3, 5, 6]
    assert sorted(r.id for r in skipped.collect()) == [2, 4]


def test_keyed_cumsum(spark):
    rnd = random.Random(3)
    data = [(i, "hot" if rnd.random() < 0.7 else rnd.choice("abc"), rnd.randint(1, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, k string, v long")
    got = {r.id: r._cum for r in keyed_cumsum(df, "k", ["id"], "v").collect()}
    run = {}
    exp = {}
    for i, k, v in data:
        run[k] = run.get(k, 0) + v
        exp[i] = run[k]
    assert got == exp


def test_partition_count_invariance(spark):
    """Repost marks do not depend on the partition count."""
    rnd = random.Random(11)
    items = [(i, rnd.choice(["HOT", "HOT", "HOT", "a", "b"]), None, "d" * 30,
              [float(rnd.choice([0.0, 1.0])) for _ in range(3)]) for i in range(1, 300)]
    df = spark.createDataFrame(rows(items), SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(status(mark_reposts(df, None, threshold=0.9)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]


def test_postings_without_a_vector_have_similarity_zero(spark):
    inc = spark.createDataFrame(rows([
        (1, "A", "u1", "first posting, long enough", [1.0, 0.0]), (2, "A", "u2", "no vector, long enough", None),
        (3, "A", "u3", "no vector again, long enough", None), (4, "A", "u4", "first posting, long enough", [1.0, 0.0])]), SCHEMA)
    got = mark_reposts(inc, None, threshold=0.3).collect()
    assert {r.id: (r.status, r.repost_of_id, r.max_similarity) for r in got} == {
        1: ("new", None, None), 2: ("new", None, 0.0), 3: ("new", None, 0.0), 4: ("repost", 1, 1.0)}


def test_feat4_scores_every_posting(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    # documents whose vectors are only those of every third one
    import os
    import tempfile
    sf = tempfile.mkdtemp(prefix="ps-test-")
    for name, keep in (("documents", "true"), ("embeddings", "vec_id % 3 = 0")):
        spark.read.parquet(os.path.join(SF_SMALL, f"{name}.parquet")).where(keep).write.parquet(f"{sf}/{name}.parquet")
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = E.queries()["feat4_repost_score"](spark, sf).collect()
    assert len(out) == n == len({r.id for r in out}) and any(r.repost_score > 0 for r in out)
