"""Toxicity (operator 5): a counterfactual-regularised logistic classifier on hashed words.

A text's features are the hashes of its distinct letter runs (A-Z as a-z) and of their stems.  Training minimises the logistic
loss, an L1 term, and for every labelled text that names a group the squared change of its logit when the
group term is swapped for another of its kind, for a neutral word or for nothing.  Terms (per language, a parameter) are found
in the text as whole words, the text is rewritten, and its features are extracted anew.  So the weights of group terms
are drawn together and to zero, and the mention of a group alone does not raise a score.

The classifier is fitted on at most MAX_LABELLED labelled texts, chosen by a seeded hash of their id, with at most
MAX_LABELLED_BYTES of feature ids; these (not texts) go to the driver.  Scoring covers every whole text; the weights are broadcast
(2**HASH_BITS floats, four megabytes).

Defined cases: null or empty text: the score of the intercept; null labels and ids are not learned from; of
several labels of one id the largest counts; without labels of both classes every score is the share of
label 1 (0 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.llm import textbytes as tb
from postingscope.llm.common import cut, lean_map, small_batches

MAX_LABELLED = 6_000
MAX_LABELLED_BYTES = 64 << 20       # feature ids of labelled texts that go to the driver, in the order of their choice
HASH_BITS = 20
STEMS = (4, 6, 7, 9)        # stem lengths in bytes
SEED = 7
# per language, groups of terms that may be swapped for each other; the last one of each is the neutral word
IDENTITY_TERMS = {
    "en": (("women", "men", "girls", "boys", "people"), ("woman", "man", "girl", "boy", "person"),
           ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"),
           ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"),
           ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "person"),
           ("black", "white", "asian", "latino", "african", "european", "american"),
           ("immigrants", "refugees", "foreigners", "locals", "people")),
    "de": (("frauen", "männer", "mädchen", "jungs", "leute"), ("muslime", "christen", "juden", "buddhisten", "atheisten", "leute"),
           ("muslimisch", "christlich", "jüdisch", "buddhistisch", "religiös"), ("schwule", "lesben", "heteros", "leute"),
           ("einwanderer", "flüchtlinge", "ausländer", "einheimische", "leute")),
    "fr": (("femmes", "hommes", "filles", "garçons", "gens"), ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées", "gens"),
           ("musulman", "chrétien", "juif", "bouddhiste", "croyant"), ("gays", "lesbiennes", "hétéros", "gens"),
           ("immigrés", "réfugiés", "étrangers", "habitants", "gens")),
    "es": (("mujeres", "hombres", "chicas", "chicos", "gente"), ("musulmanes", "cristianos", "judíos", "budistas", "ateos", "gente"),
           ("musulmán", "cristiano", "judío", "budista", "creyente"), ("lesbianas", "heterosexuales", "homosexuales", "gente"),
           ("inmigrantes", "refugiados", "extranjeros", "vecinos", "gente")),
}


def _letters() -> np.ndarray:
    sep = np.ones(256, dtype=bool)
    for a, z in ((48, 58), (65, 91), (97, 123), (128, 256)):
        sep[a:z] = False
    sep[39] = False
    return sep


_SEPARATOR = _letters()


def _word_ids(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature id) of every letter run of a chunk."""
    plain = np.where(_SEPARATOR[data], np.uint8(32), data)
    start, end, first = tb.word_spans(off, plain)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    rows, hashes = [row], [tb.word_hashes(plain, start, end)]
    for k in STEMS:                                     # the stem of a longer word counts as a word of its kind
        long = np.flatnonzero(end - start > k)
        rows.append(row[long])
        hashes.append(tb.mix64(tb.word_hashes(plain, start[long], start[long] + k) + np.uint64(k)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(row, kind="stable")
    return row[order], (h[order] >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def feature_ids(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, off, data in tb.text_chunks(texts):
        row, ids = _word_ids(off, data)
        edge = np.searchsorted(row, np.arange(len(off)))
        for a, z in zip(edge[:-1], edge[1:]):
            yield np.unique(ids[a:z])


def features_of(text: str) -> np.ndarray:
    """Distinct feature ids of one text."""
    return next(feature_ids(pa.array([text], pa.large_string())))


class Swaps:
    """Texts with a group term swapped: for the next term of its group, the neutral word, or nothing.

    Terms are found in the text itself, as whole words (A-Z as a-z), in all languages of `terms`, whatever the text's own.
    """

    def __init__(self, terms: dict[str, tuple[tuple[str, ...], ...]] = IDENTITY_TERMS):
        self.others: dict[bytes, list[bytes]] = {}
        for groups in terms.values():
            for group in groups:
                named, neutral = [t.encode() for t in group[:-1]], group[-1].encode()
                for k, t in enumerate(named):
                    self.others.setdefault(t, [named[(k + 1) % len(named)], neutral, b""])
        letter = rb"[0-9A-Za-z'\x80-\xff]"
        names = b"|".join(map(re.escape, sorted(self.others, key=len, reverse=True)))
        self.any = re.compile(rb"(?<!" + letter + rb")(?:" + names + rb")(?!" + letter + rb")", re.I) if names else None

    def texts(self, text: str) -> Iterator[str]:
        data = text.encode()
        for term in sorted({m.lower() for m in self.any.findall(data)}) if self.any else []:
            for other in self.others[term]:
                yield self.any.sub(lambda m: other if m.group().lower() == term else m.group(), data).decode()

    def changes(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """(feature ids that go, feature ids that come) of every swapped text; its features are extracted anew."""
        own = None
        out = []
        for swapped in self.texts(text):
            own = features_of(text) if own is None else own
            new = features_of(swapped)
            out.append((np.setdiff1d(own, new), np.setdiff1d(new, own)))
        return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def fit(rows: list[np.ndarray], labels: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]] = (), swap_penalty: float = 1.0,
        l1: float = 1e-3, rounds: int = 250) -> Model:
    """Accelerated proximal gradient descent on sparse 0/1 rows; `changes` are those of swapped labelled texts."""
    size = 1 << HASH_BITS
    y = np.asarray(labels, dtype=np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if not len(y) or share in (0.0, 1.0):
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(size, dtype=np.float32), float(np.log(p / (1 - p))))
    df = np.zeros(size, dtype=np.int32)
    for r in rows:
        df[r] += 1                                      # ids are distinct inside a row
    used = np.flatnonzero(df >= 3)                      # a word in one or two texts says nothing reliable
    place = np.full(size, -1, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    rows = [c[c >= 0] for c in (place[r] for r in rows)]
    col = np.concatenate(rows)
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    rows = []
    # a swap: +1 the features that go, -1 those that come; equal changes count together
    kinds = Counter((gone.tobytes(), come.tobytes()) for gone, come in changes if len(gone) or len(come))
    swaps: list[tuple[float, dict[int, int]]] = []
    for (gone, come), found in sorted(kinds.items()) if swap_penalty else []:
        change = {int(i): 1 for i in np.frombuffer(gone, np.int64)} | {int(i): -1 for i in np.frombuffer(come, np.int64)}
        swaps.append((found * swap_penalty / len(y), change))
    extra = sorted({i for _, c in swaps for i in c if place[i] < 0})
    place[extra] = np.arange(len(used), len(used) + len(extra), dtype=np.int32)
    used = np.r_[used, np.array(extra, dtype=np.int64)]
    sp = np.array([k for k, (_, c) in enumerate(swaps) for _ in c], dtype=np.int64)
    sf = np.array([place[i] for _, c in swaps for i in c], dtype=np.int64)
    sd = np.array([d for _, c in swaps for d in c.values()], dtype=np.float64)
    sn = np.array([x for x, _ in swaps])
    n, m = len(y), len(used)
    scale = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))  # both classes weigh the same
    scale /= scale.sum()
    # step from the largest eigenvalue of the loss (power iteration), plus the penalty's
    v = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(12):
        z = np.bincount(at, weights=v[:m][col], minlength=n) + v[m]
        g = np.r_[np.bincount(col, weights=(scale * z)[at], minlength=m), (scale * z).sum()]
        top = np.linalg.norm(g)
        v = g / top
    step = 1 / (0.25 * top * 1.05 + (np.bincount(sf, weights=2 * sn[sp] * np.abs(sd) * np.bincount(sp, weights=np.abs(sd))[sp]).max() if len(sn) else 0))
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    u, ub, t = w.copy(), b, 1.0
    for _ in range(rounds):
        z = np.bincount(at, weights=u[col], minlength=n) + ub
        r = scale * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(col, weights=r[at], minlength=m)
        if len(sn):
            gap = 2 * sn * np.bincount(sp, weights=sd * u[sf])
            g += np.bincount(sf, weights=gap[sp] * sd, minlength=m)
        new = u - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = ub - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    weights = np.zeros(size, dtype=np.float32)
    weights[used] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_col: str = "doc_id",
          allowed=None, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_LABELLED_BYTES, seed: int = SEED,
          terms: dict[str, tuple[tuple[str, ...], ...]] = IDENTITY_TERMS, **options) -> Model:
    """Fit on the labelled texts whose id satisfies the condition `allowed` (a Column over `id_col`)."""
    small_batches(docs.sparkSession)
    pool = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    pool = pool.where(allowed) if allowed is not None else pool
    pool = (pool.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label).cast("int").alias("y"))
            .withColumn("place", F.xxhash64(F.lit(seed), "label_id")).orderBy("place", "label_id").limit(max_labelled))
    joined = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(pool), F.expr("doc_id = label_id")).select("doc_id", "y", "place", "text")   # at most max_labelled rows

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps = Swaps(terms)
        for b in batches:
            ids = pa.array([x.astype(np.int32).tobytes() for x in feature_ids(b.column(3))], pa.binary())
            found = [swaps.changes(t.as_py() or "") for t in b.column(3)]
            sides = [pa.array([[c[k].astype(np.int32).tobytes() for c in row] for row in found], pa.list_(pa.binary())) for k in (0, 1)]
            size = pa.array([len(x.as_py()) + 4 * sum(len(g) + len(c) for g, c in row) for x, row in zip(ids, found)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], size, ids, *sides], names=["doc_id", "y", "place", "n", "ids", "gone", "come"])

    kind = dict(joined.dtypes)["doc_id"]
    one = F.min(F.struct("place", "doc_id", "y", "n", "ids", "gone", "come")).alias("r")       # of rows that repeat an id
    rows = cut(joined.mapInArrow(lean_map(prepare), f"doc_id {kind}, y int, place bigint, n bigint, ids binary, gone array<binary>, come array<binary>")
               .groupBy("doc_id").agg(one).select("r.*"))
    # in their order, as many as the bound on bytes lets in
    held, last = 0, None
    for r in sorted(rows.select("place", "doc_id", "n").collect(), key=lambda r: (r.place, r.doc_id)):
        held += r.n
        if held > max_bytes and last is not None:
            break
        last = r
    got = [] if last is None else sorted(rows.where((F.col("place") < last.place) | ((F.col("place") == last.place) & (F.col("doc_id") <= F.lit(last.doc_id)))).collect(),
                                         key=lambda r: r.doc_id)
    wide = lambda x: np.frombuffer(x, dtype=np.int32).astype(np.int64)
    changes = [(wide(g), wide(c)) for r in got for g, c in zip(r.gone, r.come)]
    return fit([np.frombuffer(r.ids, dtype=np.int32) for r in got], np.array([r.y for r in got]), changes, **options)


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    out = []
    for _, off, data in tb.text_chunks(texts):
        row, ids = _word_ids(off, data)
        hit = model.weights[ids] != 0
        pair = np.unique(row[hit] << HASH_BITS | ids[hit])
        z = model.bias + np.bincount(pair >> HASH_BITS, weights=model.weights[pair & ((1 << HASH_BITS) - 1)], minlength=len(off) - 1)
        out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
    return np.concatenate(out) if out else np.zeros(0)


def with_score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """docs with the score of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(t):
        import pandas as pd
        return pd.Series(score_texts(shared.value, pa.array(t, pa.large_string(), from_pandas=True)))

    return docs.withColumn(out, score(F.col(text)))
