"""STR1: streaming ingest with de-duplication.

Every micro-batch keeps the earliest row of each key (by its time, then by
its content), drops rows that are later than the watermark, and adds the
keys that the store does not have.  Keys lie in hash buckets; bitmaps with one bit
per key hash tell which keys of the batch may be stored at all, and only the
buckets of those are read, their key columns alone.  Rows, bitmaps, the
watermark and the count of late rows come into force in one commit that carries the
query's id and the epoch: a batch run again after a crash changes nothing, and no
key is ever forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.operators.store import Store, Transaction, writer_of

BITS = 1 << 26          # bits of all bitmaps together (8 MB), in segments of 4 kB


class SeenKeys:
    """Rows of a store's table, one per key: the first to arrive."""

    def __init__(self, store: Store, keys: list[str], ts: str, delay_seconds: int, table: str = "rows", bits: int = BITS):
        self.store, self.keys, self.ts, self.delay, self.table, self.bits = store, keys, ts, delay_seconds, table, bits

    def _spots(self, df: DataFrame) -> DataFrame:
        h = F.pmod(F.xxhash64(*self.keys), F.lit(self.bits))
        return df.withColumn("_segment", F.bitmap_bucket_number(h)).withColumn("_spot", F.bitmap_bit_position(h))

    def _merged(self, old: DataFrame | None, spots: DataFrame) -> DataFrame:
        new = spots.groupBy("_segment").agg(F.bitmap_construct_agg("_spot").alias("bitmap"))
        return new if old is None else old.select(*new.columns).unionByName(new).groupBy("_segment").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    def stage(self, tx: Transaction, batch: DataFrame) -> None:
        name, bitmaps = self.table, f"{self.table}_bitmaps"
        horizon = tx.notes.get(f"{name}.horizon")               # microseconds; the watermark that earlier batches set
        when = F.unix_micros(F.col(self.ts).cast("timestamp"))
        late = F.lit(False) if horizon is None else F.coalesce(when < horizon, F.lit(False))
        told = batch.agg(F.max(when), F.count_if(late)).first()
        first = F.min_by(F.struct(*batch.columns), F.struct(self.ts, F.xxhash64(*batch.columns))).alias("_r")
        # grouped with map-side partials: a key that fills the batch is one row per task
        rows = self._spots(batch.filter(~late).groupBy(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).agg(first).select("_r.*")).checkpoint(eager=True)
        known = tx.read_hit(bitmaps, rows, "_segment")
        fresh = rows
        if known is not None:
            marks = known.select(F.col("_segment").alias("_s"), "bitmap")
            byte = F.conv(F.hex(F.substring("bitmap", (F.col("_spot") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            bit = F.expr("shiftright(_byte, cast(_spot % 8 as int)) & 1") == 1
            rows = (rows.join(marks, F.col("_segment") == F.col("_s"), "left").withColumn("_byte", byte)
                    .withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_s", "bitmap", "_byte").checkpoint(eager=True))
            maybe = rows.filter("_maybe")
            stored = tx.read_hit(name, maybe, self.keys)
            match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
            unseen = maybe.join(stored.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys]), match, "left_anti")
            fresh = rows.filter("not _maybe").unionByName(unseen).drop("_maybe").checkpoint(eager=True)
        spots = fresh.select("_segment", "_spot")
        tx.append(name, fresh.select(*batch.columns), self.keys)
        tx.replace(bitmaps, self._merged(None if known is None else known.join(spots.select("_segment").distinct(), "_segment", "left_semi"), spots), "_segment")
        if told[0] is not None:
            tx.notes[f"{name}.horizon"] = max(told[0] - self.delay * 1_000_000, horizon if horizon is not None else told[0] - self.delay * 1_000_000)
        tx.notes[f"{name}.late"] = tx.notes.get(f"{name}.late", 0) + told[1]

    def apply(self, batch: DataFrame, epoch: tuple[str, int] | None = None) -> int:
        return self.store.transact(lambda tx: self.stage(tx, batch), epoch)

    def late_rows(self) -> int:
        """Rows dropped behind the watermark so far."""
        return self.store.manifest().get("notes", {}).get(f"{self.table}.late", 0)


def start_dedup(stream: DataFrame, seen: SeenKeys, checkpoint: str, trigger: dict | None = None):
    def handle(batch: DataFrame, epoch_id: int) -> None:
        seen.apply(batch, (writer_of(batch.sparkSession, checkpoint), epoch_id))
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if trigger:
        q = q.trigger(**trigger)
    return q.start()
