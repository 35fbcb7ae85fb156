"""Exact dedup (operator 6): Golomb-coded fingerprint exchange, duplicate bitmaps, byte verification.

1. Every partition (a "sender") hashes its texts, sorts the 64-bit fingerprints and sends each owner (a range
   of fingerprints) the distinct ones it holds, as Golomb-Rice coded differences.  A fingerprint that a sender
   holds itself more than once is one entry, flagged; so a hot text costs one entry per sender.
2. Each owner merges what it received and returns to every sender a bitmap over that sender's list: one bit
   per fingerprint that is held elsewhere too (or was flagged).
3. The fingerprints so marked are the suspects.  Only rows that can be suspects leave the second scan (a bit
   filter of bounded size; it lets others pass by chance, never drops one) and are grouped by their whole
   text: partial aggregation first, so a hot text crosses the network once per task.  Equality is thus decided
   on bytes, never on hashes.

Defined cases: a null text counts as empty; a null doc_id is smaller than any other; of rows that repeat a
doc_id within one text exactly one stays (any, they are equal in all that is compared); an empty table gives
an empty result; further columns pass through `keep_first_copies` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingscope.llm.common import bounded_filter, cut, free_name, may_contain, shuffle_partitions

OWNED_ROWS = 1 << 20      # rows whose fingerprints one owner merges, on average
STEP = 64                 # codes between two marked places of a list


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values: first value, count, Rice parameter, where every STEP-th code begins, and the Rice-coded
    differences (minus one)."""
    if not len(values):
        return b""
    gap = np.diff(values) - np.uint64(1)
    mean = float(gap.astype(np.float64).mean()) if len(gap) else 0.0
    low = max(0, int(np.floor(np.log2(mean * 0.69 + 1)))) if len(gap) else 0
    low = min(low, 56)
    quot = (gap >> np.uint64(low)).astype(np.int64)
    width = quot + 1 + low
    end = np.cumsum(width)
    bits = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    start = end - width
    ones = np.repeat(start, quot) + (np.arange(int(quot.sum())) - np.repeat(np.cumsum(quot) - quot, quot))
    bits[ones] = 1                                             # unary quotient, closed by a zero
    for k in range(low):
        bits[start + quot + 1 + k] = (gap >> np.uint64(low - 1 - k) & np.uint64(1)).astype(np.uint8)
    head = np.array([int(values[0]), len(values), low], dtype=np.uint64).tobytes()
    return head + start[::STEP].astype(np.uint64).tobytes() + np.packbits(bits).tobytes()


def golomb_decode_many(blobs: list[bytes]) -> list[np.ndarray]:
    """The values of many lists at once: all runs of STEP codes advance together, one code a round."""
    first, n, low, runs, parts = [], [], [], [], []
    bits_before, codes_before = 0, 0
    for x in blobs:
        f, count, rice = (int(v) for v in np.frombuffer(x[:24], dtype=np.uint64)) if x else (0, 0, 0)
        begins = -(-max(count - 1, 0) // STEP)
        starts = np.frombuffer(x[24:24 + 8 * begins], dtype=np.uint64).astype(np.int64)
        bits = np.unpackbits(np.frombuffer(x[24 + 8 * begins:], dtype=np.uint8)) if x else np.zeros(0, np.uint8)
        first.append(f)
        n.append(count)
        low.append(rice)
        parts.append(bits)
        left = np.minimum(STEP, max(count - 1, 0) - STEP * np.arange(begins))
        runs.append(np.stack([starts + bits_before, codes_before + STEP * np.arange(begins), left, np.full(begins, rice)], axis=1).astype(np.int64))
        bits_before += len(bits)
        codes_before += max(count - 1, 0)
    bits = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    at, code, left, rice = np.concatenate(runs).T if runs else np.zeros((4, 0), np.int64)
    # the closing zero of a unary quotient: the next zero at or after the code's start
    zero = np.flatnonzero(bits == 0)
    begin, stop, rices = (np.zeros(codes_before, dtype=np.int64) for _ in range(3))
    for k in range(STEP):
        alive = np.flatnonzero(left > k)
        if not len(alive):
            break
        c = code[alive] + k
        begin[c], rices[c] = at[alive], rice[alive]
        stop[c] = zero[np.searchsorted(zero, at[alive])]
        at[alive] = stop[c] + 1 + rice[alive]
    gaps = (stop - begin).astype(np.uint64) << rices.astype(np.uint64)
    for j in range(int(rices.max(initial=0))):                  # the remainders' bits, highest first
        has = np.flatnonzero(rices > j)
        gaps[has] |= bits[stop[has] + 1 + j].astype(np.uint64) << (rices[has] - 1 - j).astype(np.uint64)
    out, done = [], 0
    for f, count in zip(first, n):
        v = np.zeros(count, dtype=np.uint64)
        if count:
            v[0] = f
            v[1:] = gaps[done:done + count - 1] + np.uint64(1)
            done += count - 1
        out.append(np.cumsum(v, dtype=np.uint64))
    return out


def golomb_decode(blob: bytes) -> np.ndarray:
    return golomb_decode_many([blob])[0]


def _fingerprint(digest: Column) -> Column:
    """First 60 bits of the hex digest, as a non-negative long."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def owners_of(rows: int) -> int:
    return max(16, -(-rows // OWNED_ROWS))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, sha, fp, owner, sender, slot, again -- written to the shared folder.

    slot is the rank of fp among the sender's distinct fingerprints for that owner; again marks one that the
    sender holds more than once.
    """
    span = (1 << 60) // owners_of(docs.count()) + 1
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    kind = dict(docs.dtypes)[id_col]
    narrow = (docs.select(F.col(id_col).alias("doc_id"), sha.alias("sha"), F.spark_partition_id().alias("sender"))
              .withColumn("fp", _fingerprint(F.col("sha")))
              .withColumn("owner", F.expr(f"cast(fp div {span} as int)"))
              .sortWithinPartitions("fp"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_fp, last_owner, slot = -1, -1, -1
        for b in batches:
            fp = b.column(b.schema.get_field_index("fp")).to_numpy()
            own = b.column(b.schema.get_field_index("owner")).to_numpy()
            if not len(fp):
                continue
            new = np.r_[fp[0] != last_fp, fp[1:] != fp[:-1]]
            turn = np.r_[own[0] != last_owner, own[1:] != own[:-1]]
            seen = np.cumsum(new)
            base = np.where(turn, seen - 1, -1)
            base = np.maximum.accumulate(np.where(turn, base, np.int64(-(1 << 40))))
            slots = np.where(base >= 0, seen - 1 - base, slot + seen)
            last_fp, last_owner, slot = int(fp[-1]), int(own[-1]), int(slots[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slots, pa.int64())], names=[*b.schema.names, "slot"])

    return cut(narrow.mapInArrow(number, f"doc_id {kind}, sha string, sender int, fp bigint, owner int, slot bigint"))


def duplicate_bitmaps(narrow: DataFrame) -> DataFrame:
    """(sender, owner, bits): 60-bit words over the sender's list for that owner, set where held again."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packet(owner, sender, parts):
            fp = np.concatenate(parts)
            u, c = np.unique(fp, return_counts=True)
            return pa.RecordBatch.from_pydict({
                "owner": pa.array([owner], pa.int32()), "sender": pa.array([sender], pa.int32()),
                "codes": pa.array([golomb_encode(u.astype(np.uint64))], pa.binary()),
                "again": pa.array([np.packbits(c > 1).tobytes()], pa.binary())})
        at, sender, parts = None, 0, []
        for b in batches:
            fp, own = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(fp):
                continue
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for a, z in zip(edge, np.r_[edge[1:], len(own)]):
                if own[a] != at:
                    if parts:
                        yield packet(at, sender, parts)
                    at, sender, parts = int(own[a]), b.column(2)[0].as_py(), []
                parts.append(fp[a:z])
        if parts:
            yield packet(at, sender, parts)

    def own(t: pa.Table) -> pa.Table:
        senders = t["sender"].to_pylist()
        lists = golomb_decode_many(t["codes"].to_pylist())
        again = [np.unpackbits(np.frombuffer(x, np.uint8))[:len(v)].astype(np.int64) for x, v in zip(t["again"].to_pylist(), lists)]
        _, inverse, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        several = count > 1
        bits, a = [], 0
        for v, g in zip(lists, again):
            hit = several[inverse[a:a + len(v)]] | (g > 0)
            a += len(v)
            pad = np.zeros(-len(hit) % 60, dtype=bool)
            words = np.r_[hit, pad].reshape(-1, 60) @ (np.int64(1) << np.arange(60, dtype=np.int64))
            bits.append(words.astype(np.int64))
        return pa.table({"sender": pa.array(senders, pa.int32()), "owner": pa.array(t["owner"].to_pylist(), pa.int32()),
                         "bits": pa.array(bits, pa.list_(pa.int64()))})

    sent = narrow.select("fp", "owner", "sender").mapInArrow(send, "owner int, sender int, codes binary, again binary")
    # dealt out explicitly: small lists would else be gathered in one task
    return sent.repartition(shuffle_partitions(narrow.sparkSession), "owner").groupBy("owner").applyInArrow(own, "sender int, owner int, bits array<bigint>")


def suspects(narrow: DataFrame) -> DataFrame:
    """The rows of `narrow` whose fingerprint occurs again."""
    word = F.get(F.col("bits"), (F.expr("cast(slot div 60 as int)")))
    bit = F.expr("shiftright(get(bits, cast(slot div 60 as int)), cast(slot % 60 as int)) & 1L")
    return narrow.join(duplicate_bitmaps(narrow), ["sender", "owner"]).where(word.isNotNull() & (bit == 1))


def _suspect_rows(docs: DataFrame, narrow: DataFrame, text: str, flag: str) -> DataFrame:
    """docs with a boolean `flag`: false only if the row's text certainly occurs once."""
    spark = docs.sparkSession
    marked = cut(suspects(narrow).groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    bits, size = bounded_filter(marked, "fp", marked.count())
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def listed(fp):
        import pandas as pd
        return pd.Series(may_contain(shared.value, size, fp.to_numpy()))

    return docs.withColumn(flag, listed(_fingerprint(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))))


def dedup_report(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    narrow = fingerprints(slim, "text", "doc_id").withColumn("row", F.monotonically_increasing_id())
    groups = cut(_suspect_rows(slim, narrow, "text", "listed").where("listed").groupBy("text")
                 .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                 .where("group_size > 1")
                 .select(F.sha2("text", 256).alias("sha"), "keep_id", "group_size"))
    out = narrow.select("doc_id", "sha", "row").join(groups, "sha", "left")
    # one row of a group stays even if its doc_id is repeated: the first of those with that doc_id
    first = (narrow.select(F.col("doc_id").alias("d"), F.col("sha").alias("s"), F.col("row").alias("r"))
             .join(groups, F.expr("s = sha and d <=> keep_id"))
             .groupBy("s").agg(F.min("r").alias("first_row")))
    alone = F.col("group_size").isNull()
    return (out.join(first, out["sha"] == first["s"], "left")
            .select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
                    (alone | (F.col("row") == F.col("first_row"))).alias("kept"),
                    F.col("sha").alias("text_sha256")))


def keep_first_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with all columns: rows that are no suspects pass without any shuffle."""
    cols = docs.columns
    flag = free_name(docs, "listed")
    narrow = fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id")
    seen = _suspect_rows(docs, narrow, text, flag)
    body, rank, row = free_name(docs, "whole_text"), free_name(docs, "rank"), free_name(docs, "row")
    order = F.struct(F.col(id_col), F.xxhash64(*[F.col(c) for c, t in docs.dtypes if not t.startswith(("map", "variant"))]))
    best = (seen.where(F.col(flag)).select(F.coalesce(F.col(text), F.lit("")).alias(body),
                                           order.alias(rank), F.struct(*[F.col(c) for c in cols]).alias(row))
            .groupBy(body).agg(F.max_by(row, rank).alias(row)))
    return seen.where(~F.col(flag)).select(*cols).unionByName(best.select(f"{row}.*"))
