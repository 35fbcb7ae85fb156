"""Helpers shared by the training-data operators: table reads, durable lineage cuts, bounded bit filters."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingscope.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
MAX_FILTER_BITS = 1 << 30     # a broadcast bit filter never exceeds 128 MB
SEGMENT_BITS = 1 << 19        # the part of a bit filter that one row carries (64 kB)
BATCH_BYTES = "8m"            # Arrow batch sent to a Python worker (one longer text is a batch of its own)
GIVE_BACK_BYTES = 4 << 20     # a group of at least this size has its memory returned when it is done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept for later stages and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


def lean_map(fn: Callable) -> Callable:
    """A mapInArrow function that leaves no freed memory behind in its worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()
    return run


def lean_group(fn: Callable) -> Callable:
    """The same for applyInArrow functions, after groups that were not small."""
    def done(out: pa.Table, size: int) -> pa.Table:
        if size >= GIVE_BACK_BYTES:
            give_back()
        return out

    def one(t: pa.Table) -> pa.Table:
        return done(fn(t), t.nbytes)

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        return done(fn(a, b), a.nbytes + b.nbytes)

    return two if fn.__code__.co_argcount == 2 else one


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not use (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def probe_bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bit positions (bits is a power of two) of every 64-bit key."""
    k = keys.astype(np.uint64)
    mask = np.uint64(bits - 1)
    return [k & mask, (k >> np.uint64(31) ^ k * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) & mask]


def bounded_filter(keys: DataFrame, key: str, expected: int) -> tuple[np.ndarray, int]:
    """Bit filter over the 64-bit column `key`: no false negatives, at most MAX_FILTER_BITS bits.

    Sixteen bits per expected key up to the bound; beyond it more keys pass by chance, which costs work but
    never changes a result, because every user of the filter checks exactly afterwards.  Partitions send
    segments of 64 kB, which are OR-ed by segment; the driver receives the filter alone.
    """
    bits = SEGMENT_BITS
    while bits < min(MAX_FILTER_BITS, 16 * max(1, expected)):
        bits *= 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for pos in probe_bits(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits):
                seg = (pos // np.uint64(SEGMENT_BITS)).astype(np.int64)
                order = np.argsort(seg, kind="stable")
                seg, low = seg[order], (pos % np.uint64(SEGMENT_BITS)).astype(np.int64)[order]
                edges = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.zeros(0, int)
                for a, z in zip(edges, np.r_[edges[1:], len(seg)]):
                    m = parts.setdefault(int(seg[a]), np.zeros(SEGMENT_BITS // 8, dtype=np.uint8))
                    np.bitwise_or.at(m, low[a:z] >> 3, (1 << (low[a:z] & 7)).astype(np.uint8))
        for s, m in parts.items():
            yield pa.RecordBatch.from_pydict({"seg": pa.array([s], pa.int64()), "m": pa.array([m.tobytes()], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        m = np.zeros(SEGMENT_BITS // 8, dtype=np.uint8)
        for x in t["m"]:
            m |= np.frombuffer(x.as_py(), dtype=np.uint8)
        return pa.table({"seg": t["seg"][:1], "m": pa.array([m.tobytes()], pa.binary())})

    schema = "seg bigint, m binary"
    rows = (keys.select(F.col(key).cast("bigint").alias("k")).where("k is not null").mapInArrow(partial, schema)
            .groupBy("seg").applyInArrow(merge, schema).collect())
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        out[r.seg * SEGMENT_BITS // 8:(r.seg + 1) * SEGMENT_BITS // 8] = np.frombuffer(r.m, dtype=np.uint8)
    return out, bits


def may_contain(filter_bits: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), dtype=bool)
    for pos in probe_bits(keys, bits):
        p = pos.astype(np.int64)
        ok &= (filter_bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return ok


HOT_KEYS = 1000               # a key is hot if it holds more than one row in so many: at most so many are


def per_key(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """`rows` with the columns of `groups`, which has at most one row per key (null keys match) and the key's row count in `size`.

    Hot keys, at most HOT_KEYS of the `total` rows' keys, are joined by broadcast, so that no key gathers in one task; the
    rest is joined by a shuffle.  `rows` is read twice.  Rows without a group get nulls.
    """
    extra = [c for c in groups.columns if c not in keys and c != size]
    limit = total / HOT_KEYS
    named = groups.select(*[F.col(k).alias(f"__g_{k}") for k in keys], *extra, F.col(size).alias("__size"))
    hot, cold = named.where(F.col("__size") > limit), named.where(F.col("__size") <= limit)
    match = [rows[k].eqNullSafe(F.col(f"__g_{k}")) for k in keys]
    out = [*rows.columns, *extra]
    tagged = rows.join(F.broadcast(hot.limit(HOT_KEYS)), match, "left")
    rest = tagged.where("__size is null").select(*rows.columns)
    return (tagged.where("__size is not null").select(*out)
            .unionByName(rest.join(cold, [rest[k].eqNullSafe(F.col(f"__g_{k}")) for k in keys], "left").select(*out)))
