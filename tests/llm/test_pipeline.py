from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from postingscope.llm import mixing, more_queries, queries, toxicity

from .conftest import SF


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == spark.read.parquet(f"{SF}/documents.parquet").columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name in ("toxicity", "exact_dedup", "ngram_join"):
            assert docs.exceptAll(before).count() == 0
    assert docs.count() == before.count() and {"doc_id", "n_tokens", "ids"} <= set(docs.columns)


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept: scores from the weights, texts in a dict, all pairs, quotas, the library."""
    import sentencepiece
    import public_tokenizers
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(160):
        t = rng.choices(words, k=rng.randrange(5, 60))
        rows.append((i, " ".join(t + (["vile", "scum"] if i % 8 == 0 else [])), "en", f"s{i % 4}"))
    for i, k in enumerate(range(0, 160, 3)):        # exact and near copies
        t = rows[k][1].split()
        if i % 2:
            t[rng.randrange(len(t))] = "changed"
        rows.append((1000 + i, " ".join(t), "en", f"s{i % 3}"))
    rows += [(2000, None, "en", "s0"), (2001, "", None, None), (None, "no id here at all", "en", "s1")]
    sf = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, stage = spark.read.parquet(f"{sf}/documents.parquet"), dict(corpus_pipeline.STAGES)

    def kept(name, docs):
        path = str(tmp_path / name)
        stage[name](spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        return out, [tuple(r) for r in out.collect()]

    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), allowed=~queries.held_out())
    z = {r[1]: model.bias + sum(float(model.weights[x]) for x in toxicity.features_of(r[1] or "")) for r in rows}
    clean, got = kept("toxicity", docs)
    assert Counter(got) == Counter(r for r in rows if z[r[1]] < 0) and len(got) < len(rows)

    best = {}
    for r in got:
        k = (r[0] is not None, r[0] or 0)
        best[r[1] or ""] = max(best.get(r[1] or "", (k, r)), (k, r))
    single, was = kept("exact_dedup", clean)
    assert Counter(was) == Counter(r for _, r in best.values()) and len(was) < len(got)

    sets = {r[0]: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r[1] or "").lower().split()) else set() for r in was}
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in root:
        for b in root:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    apart, got = kept("ngram_join", single)
    assert Counter(got) == Counter(r for r in was if r[0] is None or find(r[0]) == r[0]) and len(got) < len(was)

    plan = mixing.mix_plan(apart).collect()
    whole = {(r.doc_id, r.source): r for r in plan}
    mixed, was = kept("mixing", apart)
    words_of = Counter()
    for i, t, _, s in was:
        words_of[i, s] += len(t.split())
    assert {k: n for k, n in words_of.items()} == {k: r.taken for k, r in whole.items() if r.taken}
    assert all(t == dict(((r[0], r[3]), r[1]) for r in got)[i, s] or dict(((r[0], r[3]), r[1]) for r in got)[i, s].startswith(t) for i, t, _, s in was)

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, got = kept("sentencepiece", mixed)
    assert Counter(r[1] for r in got) == Counter(len(lib.encode(t or "", add_eos=True)) for _, t, _, _ in was) and len(got) == len(was)


@pytest.mark.parametrize("name,sf", [(n, SF) for n, (_, sql) in queries.QUERIES.items() if sql and n not in more_queries.QUERIES] + [("op1_quality_rules", SF.replace("0.001", "0.1"))])
def test_against_sql(spark, name, sf):
    """op1 at sf0.1 too: only there are cut-offs certified."""
    fn, sql = queries.QUERIES[name]
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.execute(sql).df(), fn(spark, sf).toPandas()
    if sf != SF:
        assert (got.failed_rules != "").sum() > 100
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
