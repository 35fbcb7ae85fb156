"""URL filters (operator 10): host and path rules, then logistic regression on hashed character n-grams.

A rule (verdict, "host/path") fits its host and all subdomains if the url's path starts with the rule's path;
the longest fitting rule decides (of equally long ones a blocking rule, then the smaller text).  Urls without a
rule get the verdict of a classifier on the character 3- to 5-grams of host and path, kept apart by a marker.
It is trained on a small labelled table (url, label; 1 blocks), apart from the rules: at most MAX_LABELLED rows, chosen by a
seeded hash of the url; both classes weigh the same, whatever their shares, and scores are
probabilities under a prior of PRIOR, so a name that says nothing is allowed.  `labelled_urls` is our own table of some 270 urls, made by a
rule from words of site names: half of sites that a text corpus does not want (gambling, pills, adult, link farms, malware,
advertising), half of ordinary ones.  The broadcast weights are 2**HASH_BITS floats (one megabyte).

Columns that the input has already keep their names; the new ones (host, path, rule, block_score, verdict) then get a trailing
underscore.

Defined cases: a null url or one without "://" has empty host and path, fits no rule and gets the classifier's
verdict for empty strings; repeated labelled urls count once (the larger label); without labels of both
classes the verdict is that class's (allow without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postingscope.llm.common import free_name
from postingscope.llm.textbytes import mix64

HASH_BITS = 18
GRAMS = (3, 4, 5)
MAX_LABELLED = 5_000
SEED = 11
PRIOR = 0.1         # share of urls without a rule that are taken to be unwanted, before anything is known of them


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def with_rule(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """urls with host, path, rule (text of the deciding rule or null) and rule_verdict."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    h, p, name, told = (free_name(urls, c) for c in ("host", "path", "rule", "rule_verdict"))
    out = urls.withColumn(h, host_of(F.col(url))).withColumn(p, path_of(F.col(url)))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in reversed(ranked):
        fits = rule_fits(r, F.col(h), F.col(p))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumn(name, rule).withColumn(told, verdict)


# words of site names: sites that a text corpus does not want, and ordinary ones
UNWANTED = ("casino poker betting bets jackpot slots roulette lottery pills viagra pharmacy meds steroids diet adult porn xxx "
            "escort webcam dating spam scam phishing malware warez crack keygen torrent pirate replica payday loans forex "
            "bitcoin-doubler backlinks link-farm content-farm clickbait popunder ads adserver tracker doorway coupons giveaway winner").split()
ORDINARY = ("library university school college museum gallery gazette tribune chronicle observer weather climate science physics "
            "biology history poetry theatre orchestra gardening baking recipes cooking cycling sailing running hiking chess football "
            "railway harbour village cityhall parliament hospital clinic forest mountain island painter writer engineer teacher wiki docs").split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): three urls for each word, in the same shapes for both classes, so that only the names tell them apart."""
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        n = len(words)
        for i, w in enumerate(words):
            end, lang = ("com", "net", "org")[i % 3], ("en", "de", "fr", "es")[i % 4]
            rows += [(f"http://{w}.{end}/", label), (f"https://www.{w}-{words[(7 * i + 3) % n]}.{('org', 'com', 'net')[i % 3]}/{lang}/{i}", label),
                     (f"http://blog.{words[(5 * i + 1) % n]}{w}.{end}/{lang}/{i}.html?page=2", label)]
    return spark.createDataFrame(rows, "url string, label int")


def gram_ids(text: str, part: int) -> np.ndarray:
    """Distinct hashed n-grams of a host (part 0) or path (part 1); the part is mixed into the hash."""
    out = []
    b = np.frombuffer(f"^{text}$".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64)
    for n in GRAMS:
        k = len(b) - n + 1
        if k > 0:
            h = np.full(k, np.uint64(n * 2 + part), dtype=np.uint64)
            for i in range(n):
                h = mix64(h + b[i:i + k] + np.uint64(i))
            out.append(h >> np.uint64(64 - HASH_BITS))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float


def fit(hosts: list[str], paths: list[str], labels: list[int], l2: float = 1e-4, rounds: int = 200, prior: float = PRIOR) -> UrlModel:
    """Accelerated gradient descent on the logistic loss; the share of blocked urls in use is taken to be `prior`."""
    y = np.asarray(labels, dtype=np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return UrlModel(np.zeros(1 << HASH_BITS, dtype=np.float32), 40.0 if share else -40.0)
    rows = [np.concatenate([gram_ids(h, 0), gram_ids(p, 1)]) for h, p in zip(hosts, paths)]
    used, col = np.unique(np.concatenate(rows), return_inverse=True)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, m = len(rows), len(used)
    scale = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / n     # both classes weigh the same
    step = 1 / (0.25 * max(len(r) + 1 for r in rows) * n * scale.max() + l2)    # rows are 0/1: squared norm = their length
    w, b, u, ub, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(rounds):
        z = np.bincount(at, weights=u[col], minlength=n) + ub
        r = scale * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        new = u - step * (np.bincount(col, weights=r[at], minlength=m) + l2 * u)
        nb = ub - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    weights = np.zeros(1 << HASH_BITS, dtype=np.float32)
    weights[used] = w
    return UrlModel(weights, float(b + np.log(prior / (1 - prior))))


def train(labelled: DataFrame, url: str = "url", label: str = "label", max_labelled: int = MAX_LABELLED, seed: int = SEED) -> UrlModel:
    pool = (labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(url).alias("u")).agg(F.max(label).cast("int").alias("y"))
            .orderBy(F.xxhash64(F.lit(seed), "u"), "u").limit(max_labelled))
    rows = pool.select(host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"), "y").collect()
    return fit([r.h for r in rows], [r.p for r in rows], [r.y for r in rows])


def scores(model: UrlModel, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Score of every url; hosts and paths that come again are hashed once."""
    held = [{x: float(model.weights[gram_ids(x, part)].sum()) for x in set(texts)} for part, texts in enumerate((hosts, paths))]
    z = np.array([model.bias + held[0][h] + held[1][p] for h, p in zip(hosts, paths)], dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def judge(urls: DataFrame, rules: list[tuple[str, str]], model: UrlModel, url: str = "url") -> DataFrame:
    """urls with host, path, rule, block_score (null where a rule decides) and verdict."""
    shared = urls.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(host, path):
        import pandas as pd
        return pd.Series(scores(shared.value, list(host), list(path)))

    h, p, rule, told, out, verdict = (free_name(urls, c) for c in ("host", "path", "rule", "rule_verdict", "block_score", "verdict"))
    todo = F.col(rule).isNull()
    got = with_rule(urls, rules, url).withColumn(out, F.when(todo, score(F.when(todo, F.col(h)).otherwise(""), F.when(todo, F.col(p)).otherwise(""))))
    return got.withColumn(verdict, F.coalesce(F.col(told), F.when(F.col(out) >= 0.5, "block").otherwise("allow"))).drop(told)
