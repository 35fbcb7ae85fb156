"""JOIN8: text x lexicon on substring containment.

`match_phrases` takes a lexicon table of any size.  Every occurrence of a
phrase contains all its character n-grams (n = 3, or the length of a shorter
phrase), so one of them is enough to find candidates: the texts that hold each
n-gram are counted first, and a phrase is looked up by its rarest one, so that
a common n-gram such as "the" is no join key unless a phrase has nothing
else.  Candidates are verified with `contains`; no match is lost, and work
grows with the data, not with texts x phrases.  `match_phrase_list` is the form for a literal list of phrases (a
configuration value): an expression per text, no join.  The caller chooses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_phrase_list(df: DataFrame, phrases: list[str], text: str = "text", key: str = "id") -> DataFrame:
    """(key, phrase) for every distinct phrase of the list contained in lower(text)."""
    wanted = sorted({p.lower() for p in phrases if p})
    if not wanted:
        return df.select(key, F.lit("").alias("phrase")).limit(0)
    lt = df.select(F.col(key), F.lower(F.col(text)).alias("_lt"))
    hits = F.array_compact(F.array(*[F.when(F.col("_lt").contains(p), F.lit(p)) for p in wanted]))
    return lt.select(key, F.explode(hits).alias("phrase"))


GRAM = 3
BROADCAST_PHRASES = 1_000_000       # a table of at most so many (n-gram, phrase) rows is sent to every executor


def _grams(c, n: int):
    """Distinct overlapping n-grams in one regex pass (lookahead)."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def rarest_grams(lt: DataFrame, lex: DataFrame, lengths: list[int]) -> DataFrame:
    """(_g, phrase, texts): the n-gram of every phrase that the fewest texts hold; phrases with an n-gram that no text holds go.

    Texts are counted per n-gram with map-side partials."""
    held = lt.select(F.explode(F.concat(*[_grams(F.col("_lt"), n) for n in lengths])).alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("texts"))
    own = F.when(F.length("phrase") >= GRAM, _grams(F.col("phrase"), GRAM)).otherwise(F.array("phrase"))
    mine = lex.select("phrase", F.explode(own).alias("_p"))
    counted = mine.join(held, F.col("_p") == F.col("_g"), "left")
    return (counted.groupBy("phrase").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), F.col("_p").alias("_g"))).alias("_r"))
            .select("_r._g", "phrase", "_r.texts").where("texts > 0"))


def match_phrases(df: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(key, phrase, other lexicon columns) for every distinct phrase contained
    in lower(text)."""
    lt = df.select(F.col(key), F.lower(F.col(text)).alias("_lt"))
    extra = [c for c in lexicon.columns if c != "phrase"]
    lex = (lexicon.select(F.lower(F.col("phrase")).alias("phrase"), *extra)
           .filter(F.col("phrase").isNotNull() & (F.col("phrase") != "")))
    words = lex.select("phrase").distinct()
    lengths = sorted(r[0] for r in words.select(F.least(F.lit(GRAM), F.length("phrase"))).distinct().collect())    # of 1, 2, 3
    if not lengths:
        return lt.join(lex, F.lit(False)).select(key, "phrase", *extra)
    rare = rarest_grams(lt, words, lengths).select("_g", "phrase").checkpoint(eager=True)
    if rare.count() <= BROADCAST_PHRASES:
        rare = F.broadcast(rare)
    text_grams = lt.select(key, F.explode(F.concat(*[_grams(F.col("_lt"), n) for n in lengths])).alias("_g"))
    # candidates carry only (key, phrase); the text joins back once per candidate
    cand = text_grams.join(rare, "_g").select(key, "phrase").distinct()
    return (cand.join(lt, key).filter(F.col("_lt").contains(F.col("phrase")))
            .join(lex, "phrase").select(key, "phrase", *extra))
