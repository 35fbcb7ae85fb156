"""STR2: repost detection on a stream of postings.

Every micro-batch goes through the batch detector (WIN1) against the last k
postings of its companies, which `RecentPostings` keeps in buckets by company;
the marks and the new last k come into force in one commit.  A company's rows
are spread over tasks as in the batch, the work follows the micro-batch,
and the commit carries the query's id and the epoch, so a batch run again
after a crash changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from postingscope.operators.reposts import RecentPostings
from postingscope.operators.store import writer_of


def start_reposts(stream: DataFrame, index: RecentPostings, checkpoint: str, trigger: dict | None = None):
    """Columns of the stream: id, company, scraped_at, description, embedding."""
    def handle(batch: DataFrame, epoch_id: int) -> None:
        index.apply(batch, (writer_of(batch.sparkSession, checkpoint), epoch_id))
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if trigger:
        q = q.trigger(**trigger)
    return q.start()
