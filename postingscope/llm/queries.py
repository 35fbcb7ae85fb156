"""One query per operator over its whole intended table, with the SQL that DuckDB runs beside it.

Where no SQL is given (model training, tokenisers, crc32, seeded hashes), tests compare with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingscope.llm import (exact_dedup, hilbert_shards, license_scan, mixing, ngram_join, piece_codec,
                              quality_rules, token_counts, toxicity, url_filter)
from postingscope.llm import more_queries
from postingscope.llm.common import table

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]
TOKEN_LIMIT = 2048


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard_words")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), (TOKEN_LIMIT,))
    return got.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), allowed=~held_out())
    return toxicity.with_score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source, language and id; the licence files of directories speak for what lies below."""
    return license_scan.license_scan(license_scan.document_tree(table(spark, sf_dir, "documents")), keep=("doc_id",))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard_rows(table(spark, sf_dir, "documents")).drop("text_hash")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "block_score")


SQL_OP6 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
     g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""

SQL_OP1 = r"""
WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
s AS (SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             100 * n_symbols // greatest(word_chars, 1) AS symbols, 100 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
             100 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * n_upper // greatest(word_chars, 1) AS shouting,
             least(100, word_chars // greatest(n_words, 1)) AS long_words FROM s),
lab AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
long AS (UNPIVOT (SELECT stratum, good, symbols, dup_lines, repeats, shouting, long_words FROM f JOIN lab USING (doc_id) WHERE NOT base_failed)
         ON symbols, dup_lines, repeats, shouting, long_words INTO NAME rule VALUE value),
tot AS (SELECT stratum, rule, sum(good) AS n_good, sum(1 - good) AS n_bad FROM long GROUP BY stratum, rule),
grid AS (SELECT tot.*, c.v AS cutoff,
                (SELECT coalesce(sum(good), 0) FROM long l WHERE l.stratum = tot.stratum AND l.rule = tot.rule AND l.value >= c.v) AS k,
                (SELECT coalesce(sum(1 - good), 0) FROM long l WHERE l.stratum = tot.stratum AND l.rule = tot.rule AND l.value >= c.v) AS kb
         FROM tot, (SELECT unnest(range(1, 101)) AS v) c),
p AS (SELECT *, list_sum(list_transform(range(0, (k + 1)::BIGINT), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)
             + i * ln(0.004) + (n_good - i) * ln(0.996)))) AS pv FROM grid WHERE n_good > 0),
cert AS (SELECT *, min(CASE WHEN pv <= 0.05 / (5 * (SELECT count(DISTINCT stratum) FROM tot)) THEN 1 ELSE 0 END)
              OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS ok, kb / greatest(n_bad, 1) - k / greatest(n_good, 1) AS gain FROM p),
pick AS (SELECT stratum, rule, cutoff FROM cert WHERE ok = 1 AND gain > 0
         QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cutoff DESC) = 1),
cuts AS (SELECT stratum, max(cutoff) FILTER (rule = 'symbols') AS c1, max(cutoff) FILTER (rule = 'dup_lines') AS c2,
                max(cutoff) FILTER (rule = 'repeats') AS c3, max(cutoff) FILTER (rule = 'shouting') AS c4,
                max(cutoff) FILTER (rule = 'long_words') AS c5 FROM pick GROUP BY stratum),
j AS (SELECT f.*, array_to_string(list_filter([CASE WHEN symbols >= c1 THEN 'symbols' END, CASE WHEN dup_lines >= c2 THEN 'dup_lines' END,
             CASE WHEN repeats >= c3 THEN 'repeats' END, CASE WHEN shouting >= c4 THEN 'shouting' END,
             CASE WHEN long_words >= c5 THEN 'long_words' END], lambda x: x IS NOT NULL), ',') AS failed_rules
      FROM f LEFT JOIN cuts USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM j
"""

# whole tables: word lists, distinct shingles, pairs that share one, exact overlap, components by relaxation
SQL_OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], chr(10))) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
sf AS (SELECT s.* FROM s JOIN f USING (g)),
near AS (SELECT doc_id FROM sf JOIN n USING (doc_id) GROUP BY doc_id, n HAVING 100 * count(*) >= 75 * n),
c AS (SELECT sf.* FROM sf JOIN near USING (doc_id)),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM c a JOIN c b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(m) FROM r WHERE r.doc_id = documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id)
"""

QUERIES = {
    "op1_quality_rules": (op1, SQL_OP1),
    "op2_sentencepiece": (op2, None),
    "op3_mix_sources": (op3, None),
    "op4_token_counts": (op4, None),
    "op5_toxicity": (op5, None),
    "op6_exact_dedup": (op6, SQL_OP6),
    "op7_license_scan": (op7, None),
    "op8_hilbert_shards": (op8, None),
    "op9_ngram_jaccard": (op9, SQL_OP9),
    "op10_url_filter": (op10, None),
    **more_queries.QUERIES,
}
