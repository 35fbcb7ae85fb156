"""Vector code compression (operator 13): product quantisation in exact integer arithmetic.

Components become integers floor(scale * x).  A vector is cut into `parts` equal parts; each part position has a
codebook of `entries` integer entries, trained by rounds of nearest-entry assignment and floored means.  Distances
come from one matrix product per part: integers are broken into limbs so small that float64 BLAS adds up products below
2**53 exactly, the products of limbs are shifted and recombined in int64, and the first least distance wins.
Batches whose numbers leave no room in int64 (vectors with components around 2**28 and more) go through Python
integers, so every result is exact at any magnitude.

Only sums per codebook entry leave the tasks: 32-bit limbs of sums and counts, added by Spark; the driver gets one
row per (part, entry, position, limb), whatever the input.

Defined cases: rows whose vector is null or holds null, NaN or infinite components go.  A vector shorter than the
longest counts as filled up with zeros, and the length is rounded up to a multiple of `parts`.  Null ids sort last;
equal ids by their vector.  With fewer rows than `entries`, codebooks have as many entries as rows.  Errors
beyond a long are null, and so is the label_error they go into.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.llm.common import cut, lean_map, per_key, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
ROOM = 1 << 60                  # largest dot product of the int64 path
NARROW = 1 << 31                # integers up to here are stored in four bytes
SUM_LIMB = 32
ROWS_TOGETHER = 4096


def integers(x: float, scale: int = SCALE) -> int:
    """floor(scale * x) exactly, for any finite double."""
    a, b = float(x).as_integer_ratio()
    return scale * a // b


def limbs(v: np.ndarray, width: int) -> list[np.ndarray]:
    """Signed integers as float64 limbs of `width` bits, least first; the last one carries the sign."""
    out = []
    while True:
        if not v.size or (v.max() < 1 << width and v.min() >= -(1 << width)):
            return [*out, v.astype(np.float64)]
        out.append((v & ((1 << width) - 1)).astype(np.float64))
        v = v >> width


def dots(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact v @ c.T of int64 matrices whose products fit in int64."""
    width = (53 - max(1, math.ceil(math.log2(max(2, v.shape[1]))))) // 2
    out = np.zeros((len(v), len(c)), np.int64)
    right = limbs(c, width)
    for i, a in enumerate(limbs(v, width)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << np.int64(width * (i + j))
    return out


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest row of c, squared distance) of every row of v; int64, or object beyond it."""
    if v.dtype != object and c.dtype != object:
        top = max(int(np.abs(v).max(initial=0)), 1) * max(int(np.abs(c).max(initial=0)), 1)
        if max(top, int(np.abs(v).max(initial=0)) ** 2, int(np.abs(c).max(initial=0)) ** 2) * v.shape[1] < ROOM:
            d = (v * v).sum(axis=1)[:, None] - 2 * dots(v, c) + (c * c).sum(axis=1)[None, :]
            best = d.argmin(axis=1)
            return best, d[np.arange(len(v)), best]
    v, c = v.astype(object), c.astype(object)
    best, least = np.zeros(len(v), np.int64), np.zeros(len(v), object)
    for i, row in enumerate(v):
        d = [sum((x - y) ** 2 for x, y in zip(row, entry)) for entry in c]
        least[i] = min(d)
        best[i] = d.index(least[i])
    return best, least


def integer_rows(vectors: DataFrame, id_col: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, n, ints, wide): the rows that stay; ints are packed 32-bit integers, wide their decimal text where one is larger."""
    kinds = dict(vectors.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label")).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            for at in range(0, len(col), ROWS_TOGETHER):
                part = col.slice(at, ROWS_TOGETHER)
                flat = part.flatten()
                sizes = np.array(part.value_lengths().fill_null(-1))
                x = flat.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)      # null components come as NaN
                edge = np.r_[0, np.cumsum(np.maximum(sizes, 0))]
                bad = np.r_[0, np.cumsum(~np.isfinite(x))]
                stay = np.flatnonzero((sizes >= 0) & (bad[edge[1:]] == bad[edge[:-1]]))
                y = np.floor(np.where(np.abs(x) < NARROW, x, 0) * scale)
                big = np.r_[0, np.cumsum(~(np.abs(x) < NARROW) | (np.abs(y) >= NARROW))]
                small = np.where(np.abs(y) < NARROW, y, 0).astype(np.int32)
                is_wide = big[edge[1:]] > big[edge[:-1]]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": b.column(0).slice(at, ROWS_TOGETHER).take(pa.array(stay)), "label": b.column(1).slice(at, ROWS_TOGETHER).take(pa.array(stay)),
                    "n": pa.array(sizes[stay], pa.int64()),
                    "ints": pa.array([None if is_wide[i] else small[edge[i]:edge[i + 1]].tobytes() for i in stay], pa.binary()),
                    "wide": pa.array([",".join(str(integers(v, scale)) for v in x[edge[i]:edge[i + 1]]) if is_wide[i] else None for i in stay], pa.string())})

    return (vectors.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
            .mapInArrow(lean_map(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, n bigint, ints binary, wide string"))


def _row(ints: bytes | None, wide: str | None, size: int) -> list[int]:
    got = [int(x) for x in wide.split(",")] if ints is None else np.frombuffer(ints, np.int32).tolist()
    return got + [0] * (size - len(got))


def matrices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers) of the rows with four-byte integers, then of the others."""
    n, ints = batch.column("n").to_numpy(), batch.column("ints")
    for at in range(0, len(n), ROWS_TOGETHER):
        rows = np.arange(at, min(len(n), at + ROWS_TOGETHER))
        here = ints.slice(at, ROWS_TOGETHER)
        plain = rows[np.array(here.is_valid())]
        if len(plain):
            flat = np.frombuffer(b"".join(x.as_buffer() for x in here if x.is_valid), np.int32)
            out = np.zeros((len(plain), size), np.int64)
            out[np.arange(size)[None, :] < n[plain][:, None]] = flat
            yield plain, out
        other = rows[~np.array(here.is_valid())]
        if len(other):
            yield other, np.array([_row(None, batch.column("wide")[int(i)].as_py(), size) for i in other], dtype=object)


def _fitting(c: list[list[int]]) -> np.ndarray:
    """Entries as int64 if they fit, else as Python integers."""
    return np.array(c, dtype=np.int64 if max((abs(x) for row in c for x in row), default=0) < NARROW << 20 else object)


def _sums(rows: DataFrame, books: list[list[list[int]]], size: int) -> dict[tuple[int, int, int], int]:
    """Sums of the parts assigned to every entry: (part, entry, position) -> sum, position -1 -> count."""
    width = size // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(c), width + 1), dtype=object) for c in books]
        coded = [_fitting(c) for c in books]
        for b in batches:
            for _, v in matrices(b, size):
                for p, c in enumerate(coded):
                    part = v[:, p * width:(p + 1) * width]
                    best, _ = nearest(part, c)
                    total = np.zeros((len(c), width + 1), part.dtype)       # at most ROWS_TOGETHER rows of 32 bits: fits
                    np.add.at(total, best, np.concatenate([part, np.ones((len(part), 1), part.dtype)], axis=1))
                    held[p] += total.astype(object)
        out = []
        for p, total in enumerate(held):
            for e, row in enumerate(total):
                for k, value in enumerate(row):
                    at = 0
                    while value:
                        low = value if -(1 << SUM_LIMB) < value < 0 else value & ((1 << SUM_LIMB) - 1)
                        out.append((p, e, k if k < width else -1, at, int(low)))
                        value, at = (value - low) >> SUM_LIMB, at + 1
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int32()] * 4 + [pa.int64()])], names=["p", "e", "k", "at", "value"])

    found: dict[tuple[int, int, int], int] = {}
    for r in rows.select("n", "ints", "wide").mapInArrow(lean_map(run), "p int, e int, k int, at int, value bigint").groupBy("p", "e", "k", "at").agg(F.sum("value").alias("value")).collect():
        found[r.p, r.e, r.k] = found.get((r.p, r.e, r.k), 0) + (r.value << SUM_LIMB * r["at"])
    return found


def train(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks [part][entry][position] from integer rows: the first `entries` rows by id, then rounds of floored means."""
    first = [_row(r.ints, r.wide, size) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "wide", "ints").limit(entries).collect()]
    width = size // parts
    books = [[row[p * width:(p + 1) * width] for row in first] for p in range(parts)]
    for _ in range(rounds):
        found = _sums(rows, books, size)
        books = [[[found.get((p, e, k), 0) // found[p, e, -1] for k in range(width)] if (p, e, -1) in found else entry
                  for e, entry in enumerate(book)] for p, book in enumerate(books)]
    return books


def encode(rows: DataFrame, books: list[list[list[int]]], size: int) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for the entry of every part, and the sum of squared distances."""
    kinds = dict(rows.dtypes)
    width = size // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [_fitting(c) for c in books]
        for b in batches:
            best = np.zeros((b.num_rows, len(books)), np.uint8)
            error = np.zeros(b.num_rows, dtype=object)
            for at, v in matrices(b, size):
                for p, c in enumerate(coded):
                    k, d = nearest(v[:, p * width:(p + 1) * width], c)
                    best[at, p] = k
                    error[at] += d.astype(object)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id"), "label": b.column("label"), "code": pa.array([row.tobytes().hex() for row in best], pa.string()),
                "error": pa.array([int(x) if x < 1 << 63 else None for x in error], pa.int64())})

    return rows.mapInArrow(lean_map(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error, label_error) of the rows that stay, and the codebooks (at most 256 entries a part)."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have one byte a part: 1 to 256 entries")
    small_batches(vectors.sparkSession)
    rows = cut(integer_rows(vectors, id_col, vector, label, scale))
    longest, n = rows.agg(F.max("n"), F.count(F.lit(1))).first()
    size = max(1, -(-(longest or 0) // parts)) * parts
    books = train(rows, size, parts, entries, rounds) if n else [[] for _ in range(parts)]
    coded = cut(encode(rows, books, size))
    sums = coded.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.when(F.count(F.lit(1)) == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)"))).alias("total"))
    sums = sums.select("label", "rows", F.expr("try_cast(total as bigint)").alias("label_error"))
    return per_key(coded, sums, ["label"], "rows", n).select("vec_id", "label", "code", "error", "label_error"), books


def codebooks_sha256(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
