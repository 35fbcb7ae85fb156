"""STR4: continuous cleaning and scoring of arriving postings.

Each micro-batch is cleaned (UPS4) and scored (JOB5 core) with the current
company sentiment, and upserted by posting id into the bucketed scores
table (UPS1): only the buckets that its ids hit are rewritten.  The commit
carries the query's id and the epoch, so a batch run again after a crash
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.functions.text import clean_text
from postingscope.operators.maintenance import upsert
from postingscope.operators.scoring import score_postings
from postingscope.operators.store import writer_of


def score_batch(batch: DataFrame, sentiment: DataFrame, as_of, **kw) -> DataFrame:
    cleaned = batch.withColumn("cleaned_text", F.coalesce(F.col("cleaned_text"), clean_text(F.col("description"))))
    return score_postings(cleaned, sentiment, as_of, **kw)


def start_scoring(stream: DataFrame, sentiment: DataFrame, as_of, scores_path: str, checkpoint: str,
                  trigger: dict | None = None, **kw):
    def handle(batch: DataFrame, epoch_id: int) -> None:
        upsert(scores_path, score_batch(batch, sentiment, as_of, **kw), "job_posting_id",
               epoch=(writer_of(batch.sparkSession, checkpoint), epoch_id))
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if trigger:
        q = q.trigger(**trigger)
    return q.start()
