"""Vectorised word and shingle hashing on the raw UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D (all ASCII, so a multi-byte character never
splits).  A word's 64-bit hash is a polynomial prefix-sum difference, finished by a bit mixer; a shingle's
hash combines the hashes of its words in order.  All work is numpy on flat arrays of about one megabyte of
text, so memory does not depend on the size of the incoming batch; one longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15            # odd, so it has an inverse modulo 2**64
_MUL = [np.uint64(c | 1) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                                   0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_pow = {"base": np.ones(1, dtype=np.uint64), "inverse": np.ones(1, dtype=np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_pow[kind]) < n:
        step = _BASE if kind == "base" else pow(_BASE, -1, 1 << 64)
        p = np.full(max(n, CHUNK_BYTES + 1), step, dtype=np.uint64)
        p[0] = 1
        _pow[kind] = np.multiply.accumulate(p)
    return _pow[kind][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (well-known public constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets, bytes) of consecutive runs of rows with at most `limit` bytes (or one row).

    Null texts count as empty.
    """
    arr = col.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + n + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, off[a:b + 1] - off[a], data[off[a]:off[b]]
        a = b


def word_spans(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word and, per row, the index of its first word (length rows + 1)."""
    solid = ~_WS[data]
    cut = off[off < len(data)]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    before[cut] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    after[cut[cut > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    return start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash per word; with `lower`, A-Z count as a-z."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    value = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value * _powers("base", len(data)), out=run[1:])
    h = (run[end] - run[start]) * _powers("inverse", len(data))[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(col: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct 64-bit hashes of its `words`-word shingles.

    Fewer words: the whole sequence is the one shingle; no words: an empty array.
    """
    for _, off, data in text_chunks(col):
        start, end, first = word_spans(off, data)
        h = word_hashes(data, start, end)
        full = max(0, len(h) - words + 1)
        s = np.full(full, np.uint64(words), dtype=np.uint64)
        for k in range(words):
            s += h[k:k + full] * _MUL[k % len(_MUL)] + np.uint64(k)
            s = mix64(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                v = np.sort(s[a:b - words + 1])
                keep = np.ones(len(v), dtype=bool)
                keep[1:] = v[1:] != v[:-1]
                yield v[keep]
            elif b > a:
                one = np.full(1, np.uint64(b - a), dtype=np.uint64)
                for k in range(b - a):
                    one = mix64(one + h[a + k:a + k + 1] * _MUL[k % len(_MUL)] + np.uint64(k))
                yield one
            else:
                yield np.zeros(0, dtype=np.uint64)
