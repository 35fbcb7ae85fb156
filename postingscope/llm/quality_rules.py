r"""Quality rules (operator 1): cut-offs certified on labelled holdouts by exact binomial bounds.

Every document gets word and line statistics of its whole text, and from them a few signals scaled to 0..100.
A rule rejects a document whose signal reaches a cut-off; cut-offs are learned per stratum (language) so that
the share of good documents that a stratum's rules reject together is at most `max_false`, with probability
at least 1 - `risk` over all strata and rules:

* For each (stratum, rule) the cut-offs 100, 99, ... are tested from the most lenient on.  "The false
  rejection rate at this cut-off is above max_false / rules" is rejected if P(X <= k | n, max_false / rules)
  is at most risk / (strata * rules), k of the n good labelled documents being rejected there.  Testing in a
  fixed order needs no correction along the cut-offs; strata and rules are corrected by Bonferroni.
* All certified cut-offs hold at once, so any may be chosen: the one with the largest difference between the
  shares of bad and of good documents rejected (the most lenient of equals), if that is above zero.

The exact binomial tail is the regularised incomplete beta function, called on the JVM.  All of it is
DataFrame expressions; texts are read once and only their statistics are written to the shared folder.

Defined cases: a null text has no words and fails the base rule; a null stratum is a stratum of its own; labels
that are null or without a document are ignored, of several labels of one id the largest counts (a document
once called good is good); strata without labels get no cut-off; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postingscope.llm.common import cut

SPACES = r"[\x20\x09-\x0D]+"
MAX_FALSE = 0.02
RISK = 0.05
# signal name -> percent 0..100 as integer arithmetic on the statistics
RULES = {
    "symbols": "100 * n_symbols div greatest(word_chars, 1)",
    "dup_lines": "100 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "100 * n_repeat_words div greatest(n_words, 1)",
    "shouting": "100 * n_upper div greatest(word_chars, 1)",
    "long_words": "least(100, word_chars div greatest(n_words, 1))",
}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    a = (docs.withColumn("_t", t).withColumn("_w", F.array_remove(F.split("_t", SPACES), ""))
         .withColumn("_v", F.transform("_w", lambda w: F.xxhash64(w))))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    b = (a.withColumn("n_words", F.size("_w").cast("bigint"))
         .withColumn("word_chars", F.length(F.concat_ws("", "_w")).cast("bigint"))
         .withColumn("_m", F.regexp_replace("_t", r"[^#*$%&|<>\p{Lu}]+", ""))                # symbols and capitals
         .withColumn("_l", lines)
         # a 3-word window as 40 bits of its hash and its place: sorted, likely repeats become neighbours
         .withColumn("_h", F.when(F.col("n_words").between(3, 1 << 24), F.sort_array(F.transform(
             F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
             lambda i: F.shiftleft(F.xxhash64(F.get("_v", i), F.get("_v", i + 1), F.get("_v", i + 2)), 24).bitwiseOR(i.cast("bigint"))))))
         .drop("_t", "_v"))
    gap = lambda x, k: F.shiftright(F.get("_h", k).bitwiseXOR(x), 24) == 0
    c = (b.withColumn("n_symbols", F.length(F.regexp_replace("_m", r"[^#*$%&|<>]+", "")).cast("bigint"))
         .withColumn("n_upper", F.length("_m") - F.col("n_symbols")).drop("_m")
         .withColumn("n_lines", F.size("_l").cast("bigint"))
         .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"))
         .drop("_l")
         .withColumn("_c", F.when(F.col("n_words") > 1 << 24, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).when(
             F.exists(F.filter("_h", lambda x, k: gap(x, k + 1)), lambda x: x.isNotNull()),
             F.transform(F.filter("_h", lambda x, k: gap(x, k + 1) | gap(x, k - 1)), lambda x: x.bitwiseAND((1 << 24) - 1).cast("int"))))
         .drop("_h")
         # the likely repeats are compared by their words
         .withColumn("_s", F.when(F.col("_c").isNotNull(), F.sort_array(F.transform("_c", lambda i: F.struct(
             F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b"), F.get("_w", i + 2).alias("c")).alias("g"), i.alias("i"))))))
         .drop("_w", "_c"))
    d = c.withColumn("_p", F.transform(F.filter(
        "_s", lambda x, k: (F.get("_s", k - 1)["g"] == x["g"]) | (F.get("_s", k + 1)["g"] == x["g"])), lambda x: x["i"])).drop("_s")
    covered = F.array_union(F.array_union("_p", F.transform("_p", lambda x: x + 1)), F.transform("_p", lambda x: x + 2))
    return d.withColumn("n_repeat_words", F.when(F.col("_p").isNotNull(), F.size(covered)).otherwise(0).cast("bigint")).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact, as an incomplete beta function."""
    beta = F.call_function("java_method", F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta"),
                           (F.lit(1.0) - p).cast("double"), F.greatest(n - k, F.lit(1)).cast("double"), (k + 1).cast("double"))
    return F.when(k >= n, F.lit(1.0)).otherwise(beta.cast("double"))


def certify(labelled: DataFrame, rules: list[str], max_false: float = MAX_FALSE, risk: float = RISK) -> DataFrame:
    """(stratum, rule, cutoff, n_good, rejected_good, p_value) of the chosen certified cut-offs.

    labelled: stratum, good (0/1) and one 0..100 column per rule.  At most 101 rows per stratum and rule are
    left after the first aggregation.
    """
    long = labelled.select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).cast("int").alias("value")) for r in rules])).alias("x")).select("stratum", "good", "x.*")
    hist = long.groupBy("stratum", "rule", "value").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    cells = hist.select("stratum", "rule").distinct().select("stratum", "rule", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("value"))
    h = hist.withColumnsRenamed({"stratum": "s", "rule": "r", "value": "v"})
    grid = (cells.join(h, F.expr("stratum <=> s and rule = r and value = v"), "left")
            .select("stratum", "rule", "value", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")))
    totals = hist.groupBy(F.col("stratum").alias("s"), F.col("rule").alias("r")).agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    strata = hist.select(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("")).alias("k")).agg(F.count_distinct("k").alias("strata"))
    w = Window.partitionBy("stratum", "rule").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    tested = (grid.withColumn("rejected_good", F.sum("good").over(w)).withColumn("rejected_bad", F.sum("bad").over(w))
              .join(totals, F.expr("stratum <=> s and rule = r")).drop("s", "r")
              .join(F.broadcast(strata))                                                 # one row
              .withColumn("p_value", binomial_cdf(F.col("rejected_good"), F.col("n_good"), F.lit(max_false / len(rules))))
              .withColumn("passed", (F.col("n_good") > 0) & (F.col("p_value") <= F.lit(risk) / (F.col("strata") * F.lit(len(rules))))))
    # fixed order: a cut-off counts only if all more lenient ones passed too
    tested = tested.withColumn("certified", F.min(F.col("passed").cast("int")).over(w) == 1)
    gain = F.col("rejected_bad") / F.greatest("n_bad", F.lit(1)) - F.col("rejected_good") / F.greatest("n_good", F.lit(1))
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("value"))
    return (tested.where("certified").withColumn("gain", gain).where("gain > 0")
            .withColumn("place", F.row_number().over(best)).where("place = 1")
            .select("stratum", "rule", F.col("value").alias("cutoff"), "n_good", "rejected_good", "p_value"))


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", stratum: str = "lang", text: str = "text",
                  id_col: str = "doc_id", max_false: float = MAX_FALSE, risk: float = RISK) -> DataFrame:
    """Per row: doc_id, the statistics, base_failed, kept, failed_rules."""
    stats = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))).drop("text")
    stats = cut(stats.withColumn("base_failed", base_failed()).withColumns({r: F.expr(e) for r, e in RULES.items()}))
    lab = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label).cast("int")).alias("good")))
    holdout = stats.where(~F.col("base_failed")).join(lab, F.expr("doc_id = label_id")).select("stratum", "good", *RULES)
    chosen = (certify(holdout, list(RULES), max_false, risk).groupBy(F.col("stratum").alias("s"))
              .agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]))
    judged = stats.join(chosen, F.expr("stratum <=> s"), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    return (judged.withColumn("failed_rules", F.concat_ws(",", failed))
            .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"))
