"""Token counts (operator 4): prefix dynamic programming over byte-pair merges.

For byte-pair encoding the last token of every prefix is fixed: among the vocabulary entries that end at a
position, exactly one fits behind the last token of the text before it, where two tokens "fit" if encoding
their concatenation gives just these two.  So one left-to-right pass fills count[i] = count[i - len] + 1 and
last[i] for every prefix of a word, without running merges.  A word's last character carries the word-end mark,
so the prefix that stops at i inside a word is answered by the best fitting end token behind last[.].

A document's counts at all its word boundaries are a cumulative sum over its words; a budget is answered by
a binary search there and one look into the cut word's own prefix table; nothing is encoded again.

Defined cases: null counts as empty (0 tokens); empty tables give empty results; special strings inside a text
are split off first and count one token each, as the tokenizer library does by default.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.llm.common import lean_map, small_batches

WORD_END = "</w>"
CACHE_WORDS = 800_000       # words remembered by a worker; the store is emptied when full
STORE_BYTES = 128 << 20     # the same bound in bytes, for the words and for the prefixes
SHARED_PREFIX = 32          # longer prefixes are not shared: all prefixes of a long run take n * n / 2 bytes
LONG_WORD = 64              # longer words are counted anew each time
ENTRY_BYTES = 160           # a stored entry beside its string
PLAIN_LIMIT = 0x250         # below: Latin script, stable in all Unicode versions


def _byte_symbols() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others move up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(moved)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of a word-end BPE tokenizer file, by prefix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ranks = {(tuple(m) if isinstance(m, list) else tuple(m.split(" "))): i for i, m in enumerate(model["merges"])}
        self.vocab = set(model["vocab"])
        self.longest = max(len(t.removesuffix(WORD_END)) for t in self.vocab)
        self.bytes = _byte_symbols()
        self.lib = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.ascii_split = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9]+", re.ASCII)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.born: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for pair, rank in self.ranks.items():
            if self.born.setdefault("".join(pair), rank) == rank:
                self.parts["".join(pair)] = pair
        self.forms: dict[str, bool] = {}
        self.forming = {t for t in self.vocab if self.alone(t)}
        self.seams: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, tuple[str, int]] = {}
        self.words: dict[str, int] = {}
        self.prefix_bytes = self.word_bytes = 0

    def fits(self, left: str, right: str, limit: int = 1 << 60) -> bool:
        """Whether no merge crosses the seam between two tokens, each of which forms on its own.

        Walks back in time: the part that was formed last is taken apart, and the seam's pair must not have
        had a rank that comes before that moment (equal ranks merge from the left).
        """
        ranks, born, parts = self.ranks, self.born, self.parts
        while True:
            k = ranks.get((left, right))
            if k is not None and k < limit:
                return False
            a, b = born.get(left, -1), born.get(right, -1)
            if a > b:
                left, limit = parts[left][1], a
            elif b >= 0:
                right, limit = parts[right][0], b + 1
            else:
                return True

    def alone(self, token: str) -> bool:
        """Whether the token's own characters merge to it (some vocabulary entries are unreachable)."""
        got = self.forms.get(token)
        if got is None:
            split = self.parts.get(token)
            got = split is None or (self.alone(split[0]) and self.alone(split[1]) and self.fits(*split, self.born[token]))
            self.forms[token] = got
        return got

    def _interior(self, word: str) -> tuple[list[str], list[int]]:
        """last[i], count[i] of every prefix word[:i] without a word-end mark."""
        known, forming, seams, longest = self.prefixes, self.forming, self.seams, self.longest
        if len(known) > CACHE_WORDS or self.prefix_bytes > STORE_BYTES:
            known.clear()
            self.prefix_bytes = 0
        n = len(word)
        last, count = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n):
            # a prefix's answer is the same in every word
            got = known.get(word[:i]) if i <= SHARED_PREFIX else None
            if got is None:
                for j in range(max(0, i - longest), i):
                    token = word[j:i]
                    if token in forming:
                        if not j:
                            got = token, 1
                            break
                        seam = last[j], token
                        ok = seams.get(seam)
                        if ok is None:
                            if len(seams) > CACHE_WORDS:
                                seams.clear()
                            ok = seams[seam] = self.fits(*seam)
                        if ok:
                            got = token, count[j] + 1
                            break
                if i <= SHARED_PREFIX:
                    known[word[:i]] = got
                    self.prefix_bytes += ENTRY_BYTES + sys.getsizeof(word[:i])
            last[i], count[i] = got
        return last, count

    def _close(self, word: str, i: int, last: list[str], count: list[int]) -> int:
        """Tokens of word[:i] read as a whole word."""
        for j in range(max(0, i - self.longest), i):
            token = word[j:i] + WORD_END
            if token in self.forming:
                if not j:
                    return 1
                ok = self.seams.get((last[j], token))
                if ok is None:
                    ok = self.seams[last[j], token] = self.fits(last[j], token)
                if ok:
                    return count[j] + 1
        raise ValueError(f"no token closes {word[:i]!r}")

    def prefix_table(self, word: str) -> np.ndarray:
        """Token counts of all prefixes (in byte symbols) of a word, each read as a whole word."""
        last, count = self._interior(word)
        return np.array([0] + [self._close(word, i, last, count) for i in range(1, len(word) + 1)], dtype=np.int64)

    def count_word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            marked = "".join(self.bytes[b] for b in word.encode())
            whole = marked + WORD_END
            got = 1 if whole in self.forming else self._close(marked, len(marked), *self._interior(marked))
            if len(word) <= LONG_WORD:
                if len(self.words) > CACHE_WORDS or self.word_bytes > STORE_BYTES:
                    self.words.clear()
                    self.word_bytes = 0
                self.words[word] = got
                self.word_bytes += ENTRY_BYTES + sys.getsizeof(word)
        return got

    def split_words(self, text: str) -> list[str]:
        """The library's normaliser and word splitter; a plain equivalent where the text allows it."""
        if not text:
            return []
        if text.isascii():
            return self.ascii_split.findall(text.lower())
        if ord(max(text)) < PLAIN_LIMIT and "İ" not in text:
            return self.split.findall(unicodedata.normalize("NFC", text).lower())
        plain = self.lib.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.bytes)}
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(plain)]

    def pieces(self, text: str) -> Iterator[str | None]:
        """Words of the text in order; None for a special token."""
        a = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self.split_words(text[a:m.start()])
            yield None
            a = m.end()
        yield from self.split_words(text[a:])

    def boundary_counts(self, text: str) -> np.ndarray:
        """Tokens up to the end of every word (cumulative)."""
        known = self.words
        if self.special is None or not self.special.search(text):
            words = self.split_words(text)
            got = list(map(known.get, words))
            if None in got:
                fresh = {w for w, n in zip(words, got) if n is None}
                new = {w: self.count_word(w) for w in fresh}
                got = [new[w] if n is None else n for w, n in zip(words, got)]
        else:
            got = [1 if w is None else self.count_word(w) for w in self.pieces(text)]
        return np.cumsum(np.array(got, dtype=np.int64))


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, budgets: tuple[int, ...] = (2048,), text: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and, per budget b, words_in_<b>: leading words that fit b tokens."""
    kind = dict(docs.dtypes)[id_col]
    extra = "".join(f", words_in_{b} bigint" for b in budgets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            total, fit = [], [[] for _ in budgets]
            for t in b.column(2):
                at = c.boundary_counts(t.as_py() or "")
                total.append(int(at[-1]) if len(at) else 0)
                for k, limit in enumerate(budgets):
                    fit[k].append(int(np.searchsorted(at, limit, "right")))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(total, pa.int64()), *[pa.array(x, pa.int64()) for x in fit]],
                names=["doc_id", "n_bytes", "n_tokens", *[f"words_in_{x}" for x in budgets]])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text).alias("text"))
    return slim.mapInArrow(lean_map(count), f"doc_id {kind}, n_bytes bigint, n_tokens bigint{extra}")


def fit_prefix(text: str, tokenizer: str, budget: int) -> int:
    """Longest prefix, in byte symbols of the split words, that needs at most `budget` tokens."""
    c, used, size = counter(tokenizer), 0, 0
    for w in c.pieces(text):
        n = 1 if w is None else c.count_word(w)
        if used + n <= budget:
            used, size = used + n, size + len((w or "").encode())
            continue
        if w is not None:
            inside = c.prefix_table("".join(c.bytes[b] for b in w.encode()))
            fits = np.flatnonzero(inside <= budget - used)
            size += int(fits[-1]) if len(fits) else 0
        break
    return size
