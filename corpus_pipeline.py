"""Corpus pipeline: toxicity filter, exact dedup, near-duplicate join, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes every result as Parquet in the
shared folder and reads it again as the next stage's docs, so a lost executor costs one stage at most.  All
stages but the last return the columns of `documents`.

Rows: a document that scores 0.5 or more goes (a null text scores as an empty one); of equal texts the row with
the largest doc_id stays; of each component of near copies the smallest doc_id stays; the mix repeats a document
once per copy it takes (texts without words are not taken, one document per source may be taken in part); the
last stage gives one encoded row per row of the mix.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingscope.llm import exact_dedup, mixing, ngram_join, piece_codec, queries, toxicity
from postingscope.llm.common import free_name, table
from postingscope.session import checkpoint_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), allowed=~queries.held_out())
    score = free_name(docs, "score")
    return toxicity.with_score(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"),
                                        outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

# model training, a tokeniser and seeded hashes: not SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
