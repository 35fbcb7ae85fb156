"""Token alignment, WARC and vector codes against the libraries, brute force and hand-made cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postingscope.llm import alignment, common, more_queries, vector_codes, warc

from .conftest import SF
from .test_ops import tricky_texts

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"


def paths():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path(A_NAME), tokenizers.path(B_NAME)


def align_by_sets(al, text):
    """(A ids, B ids, [(A ids, B ids) per group]) of one text by the libraries and sets of offsets."""
    if not text:
        return [], [], []
    a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    want = (" " + text).encode()
    if b"".join(al.a_bytes[i] for i in a) != want or b"".join(al.b_bytes[i] for i in b) != want:
        return [], [], []
    groups, i, j, left, right = [], 0, 0, 0, 0
    ga, gb = [], []
    while i < len(a) or j < len(b):
        if left <= right:
            left += len(al.a_bytes[a[i]])
            ga.append(a[i])
            i += 1
        else:
            right += len(al.b_bytes[b[j]])
            gb.append(b[j])
            j += 1
        if left == right:
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, groups


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else ""


def odd_texts():
    rng = random.Random(9)
    alphabet = [chr(c) for c in [*range(0x250), 0x2581, 0x3000, 0x2028, 0x200B, 0x1F600, 0x85]]
    return [None, *tricky_texts(), "x\x1cy z\x1c q", "<s> </s> <unk> <0x41>", "a\x00b c", "  lead trail  ", "a  b  c",
            *["".join(rng.choice(alphabet) if rng.random() < .5 else rng.choice("abet 's  \n") for _ in range(rng.randrange(1, 100))) for _ in range(300)]]


def test_alignment_equals_libraries(monkeypatch):
    al = alignment.Aligner(*paths())
    texts = odd_texts()
    want = [align_by_sets(al, t) for t in texts]
    for limit, store in ((alignment.PIECE_CHARS, alignment.STORE_BYTES), (40, 20_000)):      # whole texts, then cut into pieces with a store that overflows
        monkeypatch.setattr(alignment, "PIECE_CHARS", limit)
        monkeypatch.setattr(alignment, "STORE_BYTES", store)
        for t, got, (a, b, groups) in zip(texts, al.documents(texts, list(alignment.OUTPUTS)), want):
            assert got["a_ids"].tolist() == a and got["b_ids"].tolist() == b, t
            assert (got["n_a"], got["n_b"], got["n_groups"]) == (len(a), len(b), len(groups))
            assert got["groups_sha256"] == digest(groups)
            assert got["a_groups"].tolist() == [k for k, g in enumerate(groups) for _ in g[0]]
            assert got["b_groups"].tolist() == [k for k, g in enumerate(groups) for _ in g[1]]
            codes = np.frombuffer(got["links"], al.codes).astype(np.int64).tolist()
            assert codes == [g[0][-1] * len(al.b_bytes) + g[1][-1] for g in groups]


def test_pointer_jumping_labels_components():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(np.r_[rng.integers(1, n + 1, n // 2), n])
        b = np.unique(np.r_[rng.integers(1, n + 1, n // 2), n])
        la, lb = alignment.last_of_component(a, b)
        common_ends = np.intersect1d(a, b)
        assert (a[la] == common_ends[np.searchsorted(common_ends, a)]).all() and (a[lb] == common_ends[np.searchsorted(common_ends, b)]).all()


@pytest.mark.parametrize("head", [None, 0, 40])
def test_linked_counts_with_and_without_head(spark, head):
    """All pairs broadcast, none, and some: the same counts as brute force."""
    a, b = paths()
    al = alignment.aligner(a, b)
    texts = ["the cat sat on the mat", "the cat, the dog and the cat", "the cat sat on the mat", "", None, "internationalization of the cat", "▁ no", "zqxjk the"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "the mat", "x"), (1, "the mat", "x")], "doc_id long, text string, links string").repartition(3)
    got = alignment.linked_counts(alignment.align_documents(docs, a, b, outputs=("groups_sha256",)), len(al.a_bytes), len(al.b_bytes), head_pairs=head)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    links = {k: [(g[0][-1], g[1][-1]) for g in align_by_sets(al, t)[2]] for k, (_, t) in enumerate(rows)}
    count = Counter(p for ls in links.values() for p in ls)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    want = Counter((i, len(links[k]), sum(count[p] == most[p[1]] for p in links[k]), sum(count[p] for p in links[k]), digest(align_by_sets(al, t)[2])) for k, (i, t) in enumerate(rows))
    assert Counter((r.doc_id, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()) == want


def test_alignment_odd_and_empty_tables(spark, odd_docs):
    a, b = paths()
    al = alignment.aligner(a, b)
    got = alignment.align_documents(odd_docs, a, b)
    want = Counter((r.doc_id, digest(align_by_sets(al, r.text)[2])) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.groups_sha256) for r in got.collect()) == want
    empty = alignment.linked_counts(alignment.align_documents(odd_docs.limit(0), a, b), len(al.a_bytes), len(al.b_bytes))
    assert empty.count() == 0 and {"n_links", "n_best", "count_sum"} <= set(empty.columns)


# ---- WARC ----

def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [(1, "http://a/x y\r\nz", "<p>one</p>", "k"), (2, "http://b", "<p>one</p>", "k"), (3, None, None, "k"), (4, "http://c", "", None),
         (5, "http://d", "ü日本" * 3000, "k"), (5, "http://d", "ü日本" * 3000, "k"), (5, "http://d", "ü日本" * 3000, "k"), (None, "http://e", "<p>one</p>", "k"),
         (6, "http://f", "WARC/1.1\r\n\r\n" * 50, "k"), (7, "http://g", "alone", "k"), (None, None, "alone too", "k")]
PAGES_SCHEMA = "page_id long, url string, html string, record_type string"


def expected(rows, least):
    """(id, bytes, digest, type, refers) of every row, ties among equal rows counted once."""
    top, out = {}, Counter()
    for i, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) >= least:
            top.setdefault(body, []).append(i)
    for body, ids in top.items():
        best = max((i for i in ids if i is not None), default=None)
        ids = list(ids)
        ids.remove(best)
        shared = bool(ids)
        out[best, len(body), b32(body), "response", None] += 1
        for i in ids:
            out[i, len(body), b32(body), "revisit", best] += shared
    for i, _, html, _ in rows:
        body = (html or "").encode()
        if len(body) < least:
            out[i, len(body), b32(body), "response", None] += 1
    return out


@pytest.mark.parametrize("least,options", [(0, {}), (5, {"compression": "none"}), (0, {"rollBytes": "300"})])
def test_warc_round_trip(spark, tmp_path, least, options):
    pages = spark.createDataFrame(PAGES, PAGES_SCHEMA).repartition(3)
    folder = str(tmp_path / "w")
    warc.write_captures(pages, folder, least_bytes=least, options=options)
    rows = warc.read_captures(spark, folder, payloads=True).collect()
    assert Counter((r.row_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_row) for r in rows) == expected(PAGES, least)
    bodies = {b32((h or "").encode()): (h or "").encode() for _, _, h, _ in PAGES}
    for r in rows:
        assert bytes(r.payload) == (bodies[r.payload_digest] if r.record_type == "response" else b"")
    if not options:                 # any gzip tool reads the archives
        for f in (tmp_path / "w").glob("*.warc.gz"):
            assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    # ids of records are unique, and revisits refer to the record of their response
    whole = spark.read.format("warc").load(folder).collect()
    assert len({r.record_id for r in whole}) == len(whole)
    assert {r.refers_to for r in whole if r.refers_to} <= {r.record_id for r in whole if r.record_type == "response"}


def test_warc_pushes_filters_and_skips_payloads(spark, tmp_path, monkeypatch):
    warc.register(spark)
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", f"body {i}" * 500, None) for i in range(60)], PAGES_SCHEMA)
    folder = str(tmp_path / "w")
    warc.write_captures(pages, folder)
    df = spark.read.format("warc").load(folder)
    got = df.where("record_type = 'response' and target_uri like 'http://h1/%' and payload_bytes > 3000 and date is not null").select("target_uri", "payload")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan.split("Filter")[-1].split("BatchScan")[0] if "Filter" in plan else True
    want = {f"http://h{i % 3}/{i}" for i in range(60) if i % 3 == 1 and len(f"body {i}" * 500) > 3000}
    assert {r.target_uri for r in got.collect()} == want
    # outside Spark: a record that a filter rejects is not inflated beyond its header
    fed = []
    real = warc.zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", lambda *a: Spy(real(*a), fed))
    from pyspark.sql.datasource import EqualTo
    for f in (tmp_path / "w").glob("*.warc.gz"):
        with f.open("rb") as s:
            assert [r["record_type"] for r in warc.records(s, f.name, [EqualTo(("record_type",), "warcinfo")], ["record_type"])] == ["warcinfo"]
    assert max(fed) <= 4096


class Spy:
    """A decompressor that notes how much came out of each record."""

    def __init__(self, z, sizes):
        self.z, self.sizes, self.out = z, sizes, 0

    def decompress(self, *a):
        got = self.z.decompress(*a)
        self.out += len(got)
        self.sizes.append(self.out)
        return got

    def __getattr__(self, name):
        return getattr(self.z, name)


def test_warc_reads_other_writers_archives(spark, tmp_path):
    """Members without a skip length, folded header lines, records that are not HTTP, a plain archive; damage is an error."""
    def record(kind, body, extra=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    some = [record("resource", b"plain body", "Content-Type: text/plain\r\nX-Long: a\r\n  b\r\n"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("metadata", b"")]
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in some))
    (folder / "b.warc").write_bytes(b"".join(some))
    warc.register(spark)
    rows = spark.read.format("warc").load(str(folder)).collect()
    assert Counter((r.record_type, bytes(r.payload), r.payload_bytes) for r in rows) == Counter({
        ("resource", b"plain body", 10): 2, ("request", b"GET / HTTP/1.1\r\n\r\n", 18): 2, ("metadata", b"", 0): 2})
    assert {r.fields["x-long"] for r in rows if r.record_type == "resource"} == {"a b"}
    for damaged in (b"".join(some)[:-30], some[0][:40], gzip.compress(some[0])[:-20], b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"):
        f = tmp_path / "bad.warc"
        f.write_bytes(damaged)
        with f.open("rb") as s, pytest.raises(ValueError, match="offset"):
            list(warc.records(s, "bad.warc", [], ["payload"]))


def test_warc_counts_manifested_archives_only(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:3], PAGES_SCHEMA)
    folder = tmp_path / "w"
    warc.write_captures(pages, str(folder))
    (folder / "left-by-a-failed-task.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    assert warc.read_captures(spark, str(folder)).count() == 3
    warc.write_captures(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_captures(spark, str(tmp_path / "none")).count() == 0


# ---- vector codes ----

def by_hand(rows, parts=8, entries=16, rounds=6):
    """Everything in Python integers: (id, label, code, error) of the rows that stay, and the codebooks."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    size = max(1, -(-max((len(r[1]) for r in kept), default=0) // parts)) * parts
    whole = [[math.floor(4096 * x) if abs(x) < 2 ** 900 else 4096 * int(x) for x in r[1]] + [0] * (size - len(r[1])) for r in kept]
    w = size // parts
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0))
    books = [[whole[i][p * w:(p + 1) * w] for i in order[:entries]] for p in range(parts)]

    def pick(v, c):
        d = [sum((x - y) ** 2 for x, y in zip(v, e)) for e in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in whole:
                held.setdefault(pick(v[p * w:(p + 1) * w], books[p])[0], []).append(v[p * w:(p + 1) * w])
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else books[p][e] for e in range(len(books[p]))]
    out = []
    for r, v in zip(kept, whole):
        got = [pick(v[p * w:(p + 1) * w], books[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for k, _ in got), sum(d for _, d in got)))
    return out, books


def label_sums(out):
    total = Counter()
    for _, label, _, error in out:
        total[label] += error
    return total


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e7, 1e15])
def test_vector_codes_exact_at_any_magnitude(spark, scale):
    """From one limb of 25 bits over two limbs to Python integers."""
    rng = np.random.default_rng(int(scale) % 97)
    rows = [(i, (rng.normal(size=16) * scale).tolist(), int(i % 3)) for i in range(70)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4))
    want, want_books = by_hand(rows)
    assert books == want_books
    total = label_sums(want)
    fits = lambda x: x if x < 1 << 63 else None
    expect = Counter((i, c, fits(e), fits(total[la]) if all(e2 < 1 << 63 for _, l2, _, e2 in want if l2 == la) else None) for i, la, c, e in want)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()) == expect


def test_vector_codes_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5] * 8, None), (1, [-0.5, None] * 4, 1), (2, None, 1), (4, [nan] * 8, 1), (5, [inf] * 8, 2), (None, [1.0] * 8, None),
            (7, [0.25] * 3, 2), (7, [0.25] * 3, 2), (8, [], 2), (9, [-1e-30] * 9, 4)]
    coded, books = vector_codes.compress(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string"))
    want, want_books = by_hand([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], la) for i, v, la in rows])
    total = label_sums(want)
    assert books == want_books and len(books[0]) == 6
    assert Counter((r.vec_id, r.label, r.code, r.error, r.label_error) for r in coded.collect()) == Counter((i, la, c, e, total[la]) for i, la, c, e in want)
    empty, books = vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert empty.count() == 0 and books == [[]] * 8


def test_limb_products_are_exact():
    rng = np.random.default_rng(2)
    for bits in (10, 24, 27):
        v, c = rng.integers(-(1 << bits), 1 << bits, (50, 8)), rng.integers(-(1 << bits), 1 << bits, (7, 8))
        assert (vector_codes.dots(v, c) == v @ c.T).all()


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3 if i % 2 else i) for i in range(200)], "i int, k int")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s"))
    got = common.per_key(rows, groups, ["k"], "n", 200)
    sums = Counter()
    for r in rows.collect():
        sums[r.k] += r.i
    assert Counter((r.i, r.s) for r in got.collect()) == Counter((r.i, sums[r.k]) for r in rows.collect())


@pytest.mark.parametrize("name", [n for n, (_, sql) in more_queries.QUERIES.items() if sql])
def test_new_queries_against_sql(spark, name):
    import duckdb
    fn, sql = more_queries.QUERIES[name]
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(sql).df(), fn(spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (sorted(map(tuple, x[cols].astype(object).where(x[cols].notna(), None).values.tolist()), key=str) for x in (got, want))
    assert a == b
