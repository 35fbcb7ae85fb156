"""Queries of operators 11 to 13 over their whole tables, with the SQL that DuckDB runs beside them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingscope.llm import alignment, vector_codes, warc
from postingscope.llm.common import table
from postingscope.session import checkpoint_dir


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    both = alignment.aligner(a, b)
    aligned = alignment.align_documents(table(spark, sf_dir, "documents"), a, b, outputs=("groups_sha256",))
    return alignment.linked_counts(aligned, len(both.a_bytes), len(both.b_bytes)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_captures(pages, folder)
    return warc.read_captures(spark, folder, dict(pages.dtypes)["page_id"]).select(
        F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_row").alias("refers_to"))


# base32: five hex digits are four characters; equal rows tie, one of them is the response
SQL_OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, url FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h,
             row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST, url DESC) AS pos,
             max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, (5 * i + 1)::INT, 5))::INT >> s & 31) + 1, 1)), lambda a, b: a || b)), '') AS payload_digest,
       CASE WHEN pos = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN pos > 1 THEN top END AS refers_to
FROM d
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def sql_op13(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Integer rows cut into parts; every round assigns by distance, then index, and floors the means."""
    def assign(k: int) -> str:
        return f"""
d{k} AS (SELECT r.row, r.p, c.e, sum((r.x - c.x) * (r.x - c.x)) AS d FROM long r JOIN c{k} c ON c.p = r.p AND c.k = r.k GROUP BY r.row, r.p, c.e),
a{k} AS (SELECT row, p, e, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY d, e) = 1)"""

    steps = []
    for k in range(rounds):
        steps.append(assign(k))
        steps.append(f"""
m{k} AS (SELECT l.p, a.e, l.k, sum(l.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM long l JOIN a{k} a ON a.row = l.row AND a.p = l.p GROUP BY l.p, a.e, l.k),
c{k + 1} AS (SELECT c.p, c.e, c.k, CASE WHEN m.n IS NULL THEN c.x ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::HUGEINT END AS x
             FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e AND m.k = c.k)""")
    steps.append(assign(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT (greatest(1, (max(len(v)) + {parts - 1}) // {parts}))::BIGINT AS w FROM kept),
long AS MATERIALIZED (SELECT row, (i // w)::INT AS p, (i % w)::INT AS k, floor(4096 * coalesce(v[i + 1], 0)::DOUBLE)::HUGEINT AS x
         FROM (SELECT row, v, w, unnest(range(0, {parts} * w)) AS i FROM kept, size)),
c0 AS (SELECT p, (row - 1)::INT AS e, k, x FROM long WHERE row <= {entries}),{','.join(steps)},
code AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row),
lab AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN code USING (row) GROUP BY label)
SELECT kept.vec_id, code.code, code.error, lab.label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, k)) FROM c{rounds}) AS codebooks_sha256
FROM kept JOIN code USING (row) JOIN lab ON lab.label IS NOT DISTINCT FROM kept.label
"""


QUERIES = {
    "op11_token_alignment": (op11, None),
    "op12_warc": (op12, SQL_OP12),
    "op13_vector_codes": (op13, sql_op13()),
}
