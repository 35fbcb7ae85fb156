"""Posting features, sentiment and score arithmetic (Column -> Column).

Lexicons are passed in; they become literal arrays inside one expression,
so matching stays JVM-side and fused with the scan (no join, no shuffle).
For lexicons too large to inline, see `operators.lexicon.match_phrases`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postingscope import lexicons as L
from postingscope.functions.text import col, is_blank, word_count


def _round_body(v: Column, n: int) -> Column:
    s = F.lit(float(10 ** n))
    p = v * s
    c = F.lit(134217729.0) * v
    hi = c - (c - v)
    err = (hi * s - p) + (v - hi) * s
    fl = F.floor(p).cast("double")
    frac = p - fl
    up = fl + F.lit(1.0)
    tie = (F.when(err > 0, up).when(err < 0, fl)
            .when(F.pmod(fl, F.lit(2.0)) == 0, fl).otherwise(up))
    k = F.when(frac > 0.5, up).when(frac < 0.5, fl).otherwise(tie)
    return F.when(F.abs(p) >= F.lit(4503599627370496.0), v).otherwise(k / s)


def round_sql(e: str, n: int) -> str:
    """Spark SQL text of Python's round(e, n) (same rule as `_round_body`).

    Building the expression from text costs one parser call instead of a
    hundred Column constructions; `e` should be cheap (it is repeated)."""
    s = f"{float(10 ** n)!r}D"
    v = f"CAST(({e}) AS DOUBLE)"
    p = f"({v} * {s})"
    fl = f"CAST(FLOOR({p}) AS DOUBLE)"
    hi = f"((134217729.0D * {v}) - ((134217729.0D * {v}) - {v}))"
    err = f"(({hi} * {s} - {p}) + ({v} - {hi}) * {s})"
    return (f"(CASE WHEN abs({p}) >= 4503599627370496.0D THEN {v} "
            f"WHEN {p} - {fl} > 0.5D THEN ({fl} + 1.0D) / {s} "
            f"WHEN {p} - {fl} < 0.5D THEN {fl} / {s} "
            f"WHEN {err} > 0.0D THEN ({fl} + 1.0D) / {s} "
            f"WHEN {err} < 0.0D THEN {fl} / {s} "
            f"WHEN pmod({fl}, 2.0D) = 0.0D THEN {fl} / {s} "
            f"ELSE ({fl} + 1.0D) / {s} END)")


def clamp01r4_sql(e: str) -> str:
    return f"least(1.0D, greatest(0.0D, {round_sql(e, 4)}))"


def q(name: str) -> str:
    """Quoted column reference for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def pyround(x, n: int) -> Column:
    """Round a double to n decimals exactly like Python's `round`.

    Python rounds the exact binary value (half-even only on exact ties);
    Spark's `round` rounds the shortest decimal form half-up, so they
    disagree on values such as 0.045649999999999996.  The scaled product's
    rounding error is recovered exactly (Dekker split, double arithmetic,
    whole-stage codegen) and decides the only ambiguous case, a scaled
    value landing on .5.

    `x` is referenced several times: pass a column or a cheap expression.
    Operators stage expensive inputs into their own column first; because
    that column is then consumed more than once, the optimizer keeps it in
    its own projection and computes it once.  `pyround_once` binds an
    arbitrary expression once instead.  A column name (str) takes the
    SQL-text fast path.
    """
    if isinstance(x, str):
        return F.expr(round_sql(q(x), n))
    return _round_body(x.cast("double"), n)


def pyround_once(x: Column, n: int) -> Column:
    """`pyround` of an expensive expression, evaluated a single time."""
    return F.transform(F.array(x.cast("double")), lambda v: _round_body(v, n)).getItem(0)


def clamp01r4(x, once: bool = False) -> Column:
    """min(1, max(0, round(x, 4))) with Python rounding (x: Column or name)."""
    if isinstance(x, str):
        return F.expr(clamp01r4_sql(q(x)))
    r = pyround_once(x, 4) if once else pyround(x, 4)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), r))


def ts(value: str) -> Column:
    """A timestamp literal such as the job's `as_of`."""
    return F.lit(value).cast("timestamp")


def _phrases(phrases) -> list[str]:
    return [p.strip().lower() for p in phrases if p and p.strip()]


def phrase_hits(text, phrases, lowered: bool = False) -> Column:
    """Number of distinct lexicon phrases occurring as substrings of lower(text)
    (a sum of `contains` tests: JVM-side, codegen'd, no join)."""
    lt = F.coalesce(col(text), F.lit("")) if lowered else F.lower(F.coalesce(col(text), F.lit("")))
    ps = _phrases(phrases)
    if not ps:
        return F.lit(0)
    out = None
    for p in ps:
        t = F.when(lt.contains(p), F.lit(1)).otherwise(F.lit(0))
        out = t if out is None else out + t
    return out


def density_of(hits, words, scale: float, min_words: int = L.MIN_WORDS, once: bool = False) -> Column:
    """clamp01r4(hits / greatest(min_words, words) * scale); no words -> 0."""
    if isinstance(hits, str) and isinstance(words, str) and not once:
        d = f"{q(hits)} / greatest({int(min_words)}, {q(words)}) * {float(scale)!r}D"
        return F.expr(f"CASE WHEN {q(words)} = 0 THEN 0.0D ELSE {clamp01r4_sql(d)} END")
    dens = col(hits) / F.greatest(F.lit(min_words), col(words)) * F.lit(float(scale))
    return F.when(col(words) == 0, F.lit(0.0)).otherwise(clamp01r4(dens, once))


def phrase_density(text, phrases, scale: float, min_words: int = L.MIN_WORDS) -> Column:
    """clamp01r4(hits / greatest(min_words, words) * scale); no words -> 0."""
    return density_of(phrase_hits(text, phrases), word_count(text), scale, min_words, once=True)


# FEAT1
def genericness(text, phrases=None) -> Column:
    return phrase_density(text, L.GENERIC_BUZZWORDS if phrases is None else phrases,
                          L.GENERICNESS_SCALE)


# FEAT2
def urgency(text, phrases=None) -> Column:
    return phrase_density(text, L.URGENCY_PHRASES if phrases is None else phrases,
                          L.URGENCY_SCALE)


# FEAT4
def repost_score(repost_of_id="repost_of_id", repost_count=None) -> Column:
    """0 without a repost; else least(1, 0.4 + 0.15 * count).

    A stored posting carries no count, so a repost counts once (0.55).
    """
    rid = col(repost_of_id)
    truthy = rid.isNotNull() & (rid != 0)
    count = (F.when(truthy, F.lit(1)).otherwise(F.lit(0)) if repost_count is None
             else F.coalesce(col(repost_count), F.when(truthy, F.lit(1)).otherwise(F.lit(0))))
    score = clamp01r4(F.least(F.lit(1.0), F.lit(L.REPOST_BASE) + count * F.lit(L.REPOST_STEP)))
    return F.when(~truthy & (count == 0), F.lit(0.0)).otherwise(score)


# FEAT5
def rule_probability(g, v, r, u, text) -> Column:
    if all(isinstance(c, str) for c in (g, v, r, u)):
        a, b, c_, d = (f"{float(w)!r}D" for w in L.RULE_WEIGHTS)
        e = f"{a} * {q(g)} + {b} * {q(v)} + {c_} * {q(r)} + {d} * {q(u)}"
        return F.when(is_blank(text), F.lit(0.0)).otherwise(F.expr(clamp01r4_sql(e)))
    wg, wv, wr, wu = (F.lit(w) for w in L.RULE_WEIGHTS)
    p = wg * col(g) + wv * col(v) + wr * col(r) + wu * col(u)
    return F.when(is_blank(text), F.lit(0.0)).otherwise(clamp01r4(p))


# FEAT6
def bootstrap_label(g, v, u, cut: float = L.BOOTSTRAP_CUT) -> Column:
    return F.when((col(g) + col(v) + col(u)) / F.lit(3.0) > F.lit(cut), 1).otherwise(0)


# SENT1
def baseline_negativity(compound, neg, text) -> Column:
    """0.7 * (1 - compound)/2 + 0.3 * neg; blank text -> 0.

    Without a valence table the analyzer is absent: compound/neg are null
    and the baseline is 0.0.
    """
    a, b = L.NEGATIVITY_BLEND
    val = F.lit(a) * ((F.lit(1.0) - col(compound)) / F.lit(2.0)) + F.lit(b) * col(neg)
    return F.when(is_blank(text) | col(compound).isNull(), F.lit(0.0)).otherwise(clamp01r4(val))


# SENT3
def frustration_parts(text, weighted_phrases=None, lowered: bool = False) -> tuple[Column, Column]:
    """(matched count, matched weight sum) as codegen'd sums of `contains`;
    the weight sum adds 0.0 for misses, which leaves the in-order sum of the
    matched weights bit-identical."""
    wp = L.FRUSTRATION_PHRASES if weighted_phrases is None else weighted_phrases
    wp = [(p.strip().lower(), float(w)) for p, w in wp if p and p.strip()]
    lt = F.coalesce(col(text), F.lit("")) if lowered else F.lower(F.coalesce(col(text), F.lit("")))
    m, s = F.lit(0), F.lit(0.0)
    for p, w in wp:
        hit = lt.contains(p)
        m = m + F.when(hit, F.lit(1)).otherwise(F.lit(0))
        s = s + F.when(hit, F.lit(w)).otherwise(F.lit(0.0))
    return m, s


def frustration_of(m, s, baseline, text, once: bool = False) -> Column:
    """0.4 * baseline + 0.6 * least(1, s / least(3, m) * 0.85) (0 if m = 0)."""
    cap, scale = L.FRUSTRATION_DENSITY
    if isinstance(m, str) and isinstance(s, str) and isinstance(baseline, str) and not once:
        a, b = L.FRUSTRATION_BLEND
        dens = (f"(CASE WHEN {q(m)} = 0 THEN 0.0D ELSE least(1.0D, {q(s)} / least({float(cap)!r}D, "
                f"CAST({q(m)} AS DOUBLE)) * {float(scale)!r}D) END)")
        e = f"{float(a)!r}D * {q(baseline)} + {float(b)!r}D * {dens}"
        return F.when(is_blank(text), F.lit(0.0)).otherwise(F.expr(clamp01r4_sql(e)))
    density = F.when(col(m) == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), col(s) / F.least(F.lit(cap), col(m).cast("double")) * F.lit(scale)))
    a, b = L.FRUSTRATION_BLEND
    base = F.lit(0.0) if baseline is None else col(baseline)
    return F.when(is_blank(text), F.lit(0.0)).otherwise(clamp01r4(F.lit(a) * base + F.lit(b) * density, once))


def frustration(text, weighted_phrases=None, baseline=None) -> Column:
    """SENT3: 0.4 * baseline + 0.6 * density with density =
    least(1, sum(weights) / least(3, matched) * 0.85), 0 when nothing matched."""
    m, s = frustration_parts(text, weighted_phrases)
    return frustration_of(m, s, baseline, text, once=True)


# SENT4
def recency_weight(posted, scraped, as_of, lam: float = L.DECAY_LAMBDA) -> Column:
    from postingscope.functions.text import elapsed_days
    when_ts = F.coalesce(col(posted), col(scraped), col(as_of))
    return F.exp(F.lit(-lam) * elapsed_days(when_ts, as_of))


# SCORE1
SCORE_KEYS = ["genericness", "vagueness", "repost", "urgency", "bert_classifier", "company_sentiment"]


def final_score(g, v, r, u, b, s, weights: dict | None = None) -> Column:
    """Weighted mean of six sub-scores on a 0-100 scale, round 2, clamped.

    A partial `weights` dict uses defaults for missing keys in the numerator
    but only the given weights in the denominator.
    """
    w = L.DEFAULT_WEIGHTS if weights is None else weights
    wsum = sum(w.values())
    if wsum == 0:
        return F.lit(0.0)
    cols = [g, v, r, u, b, s]
    if all(isinstance(c, str) for c in cols):
        raw = None
        for k, c in zip(SCORE_KEYS, cols):
            t = f"{float(w.get(k, L.DEFAULT_WEIGHTS[k]))!r}D * {q(c)}"
            raw = t if raw is None else f"({raw} + {t})"
        e = f"{raw} / {float(wsum)!r}D * 100.0D"
        return F.expr(f"least(100.0D, greatest(0.0D, {round_sql(e, 2)}))")
    terms = [F.lit(float(w.get(k, L.DEFAULT_WEIGHTS[k]))) * col(c)
             for k, c in zip(SCORE_KEYS, [g, v, r, u, b, s])]
    raw = terms[0]
    for t in terms[1:]:
        raw = raw + t
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0),
                                            pyround(raw / F.lit(float(wsum)) * F.lit(100.0), 2)))


# RPT3
def risk_band(score, cuts=(30.0, 60.0), labels=("low", "medium", "high")) -> Column:
    s = col(score)
    return (F.when(s < cuts[0], labels[0]).when(s < cuts[1], labels[1]).otherwise(labels[2]))


def spotlight_band(score) -> Column:
    s = col(score)
    return F.when(s >= 15, "elevated").when(s >= 8, "moderate").otherwise("low")


# RPT1
def signals(repost, generic, vague, urgent, sentiment, cuts=None) -> Column:
    """array<struct<title, description>> of plain-language signals."""
    c = L.SIGNAL_CUTS if cuts is None else cuts
    T = L.SIGNAL_TEXT

    def item(key, cond, desc=None):
        title, text = T[key]
        return F.when(cond, F.struct(F.lit(title).alias("title"),
                                     (desc if desc is not None else F.lit(text)).alias("description")))

    mult = (col(repost) * F.lit(5.0) + F.lit(1.0)).cast("int")
    rep_desc = F.format_string(T["repost"][1].replace("{n}", "%d"), mult)
    items = F.array_compact(F.array(
        item("repost", F.coalesce(col(repost), F.lit(0.0)) > c["repost"], rep_desc),
        item("genericness", F.coalesce(col(generic), F.lit(0.0)) > c["genericness"]),
        item("vagueness", F.coalesce(col(vague), F.lit(0.0)) > c["vagueness"]),
        item("urgency", F.coalesce(col(urgent), F.lit(0.0)) > c["urgency"]),
        item("sentiment", F.coalesce(col(sentiment), F.lit(0.0)) > c["sentiment"]),
    ))
    standard = F.array(F.struct(F.lit(T["standard"][0]).alias("title"),
                                F.lit(T["standard"][1]).alias("description")))
    return F.when(F.size(items) == 0, standard).otherwise(items)
