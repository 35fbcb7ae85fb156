"""SentencePiece encoding and decoding (operator 2): vectorised merge rounds.

Texts are cut where no vocabulary piece can cross, so the parts ("words") are independent.  All unseen words
of a chunk are encoded together on flat numpy arrays of symbols: each round finds every word's best pair (a
segmented minimum of pair ranks), merges all its occurrences in the word from the left, compacts the arrays
and retires words without a pair, until none remains.

A merge may create a pair that comes before the other occurrences (a piece made later in the vocabulary's
order can be part of an earlier one).  Occurrences behind the first such merge wait for the next round, so
the result is the library's, which merges one pair at a time, best score first, leftmost among equals.

Defined cases: null counts as empty; an empty text gives the end id alone; characters outside the vocabulary
become byte pieces; decoding removes the one added leading space mark and turns space marks into spaces.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.llm.common import lean_map, small_batches

SPACE = "▁"
CACHE_WORDS = 300_000       # encoded words remembered by a worker (about 130 MB); the store is emptied when full
STORE_BYTES = 128 << 20     # the same bound in bytes: a word of a script without spaces can be a whole line
LONG_WORD = 64              # longer words are encoded anew in each chunk
ENTRY_BYTES = 200           # a stored entry beside its strings
CHUNK_CHARS = 1 << 20
NONE = np.int64(1 << 40)


class PieceCodec:
    """Byte-pair pieces of a model file; the library only reads the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end = sp.get_piece_size(), sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.control = {i for i in range(self.size) if sp.is_control(i)}
        self.byte_of = {i: int(self.pieces[i][1:-1], 16) for i in range(self.size) if sp.is_byte(i)}
        self.byte_id = np.zeros(256, dtype=np.int64)
        for i, b in self.byte_of.items():
            self.byte_id[b] = i
        ids = {self.pieces[i]: i for i in plain}
        scores = np.array([sp.get_score(i) for i in range(self.size)])
        order = np.unique(-scores[plain], return_inverse=True)[1]         # equal scores share a rank
        rank = dict(zip(plain, order.tolist()))
        keys, made, ranks, inner = [], [], [], set()
        for p, i in ids.items():
            for k in range(1, len(p)):
                inner.add(ord(p[k - 1]) << 21 | ord(p[k]))
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    made.append(i)
                    ranks.append(rank[i])
        at = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[at]
        self.made = np.array(made, dtype=np.int64)[at]
        self.ranks = np.array(ranks, dtype=np.int64)[at]
        self.inner = np.array(sorted(inner), dtype=np.int64)              # character pairs inside some piece
        single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self.chars = np.array([c for c, _ in single], dtype=np.int64)
        self.char_ids = np.array([i for _, i in single], dtype=np.int64)
        open_end = any(SPACE in p.lstrip(SPACE) for p in ids)             # a piece continues over a space
        self.cutter = re.compile("(?s).+" if open_end else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.plain = set(plain)
        self.names = [str(i) for i in range(self.size)]
        self.seen: dict[str, tuple[str, int, str]] = {}
        self.seen_bytes = 0

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of symbol pairs; rank NONE where no piece exists."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[at], NONE), np.where(ok, self.made[at], -1)

    def merge_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final (symbol, word, position) triples; symbols below zero are characters outside the vocabulary."""
        pos = np.arange(len(sym))
        done = []
        while len(sym):
            rank, made = np.full(len(sym), NONE), np.full(len(sym), -1)
            same = np.flatnonzero(word[:-1] == word[1:])
            rank[same], made[same] = self._pairs(sym[same], sym[same + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank, first)
            idle = np.repeat(best == NONE, size)
            if idle.any():                                                # retire words without a pair
                done.append((sym[idle], word[idle], pos[idle]))
                go = ~idle
                sym, word, pos, rank, made = sym[go], word[go], pos[go], rank[go], made[go]
                if not len(sym):
                    break
                size, best = size[best != NONE], best[best != NONE]
                first = np.cumsum(size) - size
            low = np.repeat(best, size)
            hit = np.flatnonzero(rank == low)
            start = np.r_[True, np.diff(hit) != 1]                        # runs of overlapping occurrences
            run = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            take = hit[(np.arange(len(hit)) - run) % 2 == 0]
            new = made[take]
            left = np.where(take > 0, sym[take - 1], -1)
            left[(take > 0) & (word[take - 1] != word[take])] = -1
            joined = np.r_[False, np.diff(take) == 2]
            left[joined] = new[np.flatnonzero(joined) - 1]
            after = np.minimum(take + 2, len(sym) - 1)
            right = np.where((take + 2 < len(sym)) & (word[after] == word[take]), sym[after], -1)
            early = (np.minimum(self._pairs(left, new)[0], self._pairs(new, right)[0]) <= low[take]).astype(np.int64)
            before = np.cumsum(early) - early                             # merges that jump the queue, so far
            lead = np.flatnonzero(np.r_[True, word[take][1:] != word[take][:-1]])
            before -= np.repeat(before[lead], np.diff(np.r_[lead, len(take)]))
            take, new = take[before == 0], new[before == 0]
            sym = sym.copy()
            sym[take] = new
            stay = np.ones(len(sym), dtype=bool)
            stay[take + 1] = False
            sym, word, pos = sym[stay], word[stay], pos[stay]
        if not done:
            return sym, word, pos
        return tuple(np.concatenate(x) for x in zip(*done))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, end of each word in them) of texts whose spaces are already space marks."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        length = np.array([len(w) for w in words], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), length)
        pair = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.inner, pair), len(self.inner) - 1)
        cut = (self.inner[at] != pair) | (owner[1:] != owner[:-1])        # no piece crosses here
        part = np.cumsum(np.r_[0, cut.astype(np.int64)]) if len(code) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        sym = np.where(self.chars[at] == code, self.char_ids[at], -1)
        sym, _, pos = self.merge_rounds(sym, part)
        order = np.argsort(pos)
        sym, pos = sym[order], pos[order]
        unknown = np.flatnonzero(sym < 0)
        if len(unknown):                                                  # byte pieces
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[pos[unknown]]]
            times = np.ones(len(sym), dtype=np.int64)
            times[unknown] = [len(b) for b in raw]
            pos = np.repeat(pos, times)
            fill = np.repeat(sym < 0, times)
            sym = np.repeat(sym, times)
            sym[fill] = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return sym, np.searchsorted(pos, np.cumsum(length))

    def decode_raw(self, ids) -> str:
        """Pieces of the ids joined: byte pieces as UTF-8, space marks kept, control ids left out."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.control:
                out.append(self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids) -> str:
        return self.decode_raw(ids).removeprefix(SPACE).replace(SPACE, " ")

    def split(self, text: str) -> list[str]:
        return self.cutter.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _learn(self, words: set[str]) -> dict[str, tuple[str, int, str]]:
        """Stores the answers of the words; those of long words are returned and not kept."""
        long: dict[str, tuple[str, int, str]] = {}
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > CACHE_WORDS or self.seen_bytes > STORE_BYTES:
            self.seen.clear()
            self.seen_bytes = 0
            new = list(words)
        names, pieces, plain = self.names, self.pieces, self.plain
        flat, ends = self.encode_words(new)
        flat, a = flat.tolist(), 0
        for w, z in zip(new, ends.tolist()):
            ids = flat[a:z]
            a = z
            text = "".join([pieces[i] for i in ids]) if plain.issuperset(ids) else self.decode_raw(ids)
            got = " ".join([names[i] for i in ids]), len(ids), text
            if len(w) > LONG_WORD:
                long[w] = got
            else:
                self.seen[w] = got
                self.seen_bytes += ENTRY_BYTES + sys.getsizeof(w) + sys.getsizeof(got[0]) + sys.getsizeof(text)
        return long

    def codes(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by a space, decoded text) of every text, end id included."""
        a = 0
        while a < len(texts):
            z, chars = a, 0
            while z < len(texts) and (z == a or chars + len(texts[z]) <= CHUNK_CHARS):
                chars += len(texts[z])
                z += 1
            split = [self.split(t) for t in texts[a:z]]
            long = self._learn(set().union(*split))
            for words in split:
                if not words:
                    yield 1, str(self.end), ""
                    continue
                ids, count, text = zip(*([long[w] if w in long else self.seen[w] for w in words] if long else map(self.seen.__getitem__, words)))
                yield sum(count) + 1, f"{' '.join(ids)} {self.end}", "".join(text).removeprefix(SPACE).replace(SPACE, " ")
            a = z


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model: str, text: str = "text", id_col: str = "doc_id",
                     outputs: tuple[str, ...] = ("ids_sha256", "decoded_sha256")) -> DataFrame:
    """Per row: doc_id, n_tokens and the chosen outputs of ids, decoded, ids_sha256, decoded_sha256."""
    kind = dict(docs.dtypes)[id_col]
    types = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    arrow = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    make = {"ids": lambda i, t: np.fromstring(i, dtype=np.int32, sep=" "), "decoded": lambda i, t: t,
            "ids_sha256": lambda i, t: hashlib.sha256(i.encode()).hexdigest(),
            "decoded_sha256": lambda i, t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                rows = [(n, *[make[o](i, t) for o in outputs])
                        for n, i, t in c.codes([x or "" for x in b.column(1).to_pylist()])]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(cols[0], pa.int64()), *[pa.array(v, arrow[o]) for o, v in zip(outputs, cols[1:])]],
                    names=["doc_id", "n_tokens", *outputs])

    small_batches(docs.sparkSession)
    spec = ", ".join(f"{o} {types[o]}" for o in outputs)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean_map(run), f"doc_id {kind}, n_tokens bigint, {spec}")
