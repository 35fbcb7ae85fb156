"""Cross-tokenizer alignment (operator 11): groups of tokens of two tokenizers that cover the same bytes.

A text, with a space before it, is encoded by tokenizer A (`tokenizers` .json, byte level) and tokenizer B
(`sentencepiece` .model, which adds the space itself).  Two tokens overlap if their byte ranges do.  Every token points to its
farthest-right overlapping token of the other side, or to itself where both end together (on A's side); successors
are doubled, all at once, until nothing moves.  Then every token points to the last token of its connected
component, which labels the groups.  They are cut exactly where tokens of A and B end together, and each such
place is a link between the two ids that end there.

Neither tokenizer has a token across a single space between two characters that are not white space, so both encode
the parts between such spaces alike anywhere.  Distinct parts of a batch are encoded and aligned once, all
tokens of new parts in one pointer jumping; a bounded store keeps them for later batches.  Texts of any length go through in
pieces of about a megabyte.

`linked_counts` adds how often id pairs are linked in the whole corpus: pairs are pre-aggregated by task and
summed; the most frequent pairs (at most HEAD_PAIRS, whole classes of counts) are broadcast, links of all
others are joined by a shuffle on the pair.

Defined cases: a text that is null, empty, or that either tokenizer does not give back byte by byte has no
tokens: zeros, empty arrays, groups_sha256 ''.  Null ids and repeated rows are kept as rows of their own.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.llm.common import cut, lean_map, small_batches

PART_CUT = re.compile(r"(?<=\S) (?=\S)")
PIECE_CHARS = 1 << 20           # characters of one piece of a long text, and of texts handled together
STORE_BYTES = 64 << 20          # tokens and strings kept per worker between pieces
LONG_PART = 64                  # characters; longer parts are encoded alone and not kept for long
RUN = 256                       # parts that one call text joins
ENCODE_TOGETHER = 1 << 14       # parts aligned at once
KEEP_PARTS = 60_000             # parts that outlive a full store
COUNT_TOGETHER = 1 << 22        # links aggregated at once in a task
HEAD_PAIRS = 1 << 20            # id pairs that are broadcast (13 bytes each)
OUTPUTS = {"groups_sha256": "string", "a_ids": "array<int>", "b_ids": "array<int>",
           "a_groups": "array<int>", "b_groups": "array<int>"}


def unicode_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the rest from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] - 1 of all i, one after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def last_of_component(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of A (0 ..) the A token that ends its component, and the same for every token of B.

    The ends (byte offsets, ascending) of the two sides reach the same last offset.
    """
    n = len(a_ends)
    to_b, to_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    nxt = np.concatenate([np.where(b_ends[to_b] == a_ends, np.arange(n), n + to_b), to_a]) if n else np.zeros(0, np.int64)
    while True:
        further = nxt[nxt]
        if np.array_equal(further, nxt):
            return nxt[:n], nxt[n:]
        nxt = further


def _room(data: np.ndarray, used: int, more: int) -> np.ndarray:
    """`data` with room for `more` entries after the first `used`."""
    if used + more <= len(data):
        return data
    return np.concatenate([data[:used], np.zeros(max(len(data), more), data.dtype)])


class _Flat:
    """A growing array of ragged rows."""

    def __init__(self, dtype):
        self.data, self.used = np.zeros(1 << 12, dtype), 0
        self.starts, self.sizes, self.n = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.data = _room(self.data, self.used, len(flat))
        self.starts, self.sizes = (_room(x, self.n, len(sizes)) for x in (self.starts, self.sizes))
        self.data[self.used:self.used + len(flat)] = flat
        self.sizes[self.n:self.n + len(sizes)] = sizes
        self.starts[self.n:self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat values, sizes) of rows, in the order asked for."""
        sizes = self.sizes[which]
        return self.data[ragged(self.starts[which], sizes)], sizes


class Aligner:
    """Both tokenizers, their token bytes, and the store of aligned parts (one per worker)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.encode_a = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        byte = unicode_bytes()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if all(c in byte for c in token):
                self.a_bytes[i] = bytes(byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.codes = code_type(len(self.a_bytes), len(self.b_bytes))
        # parts stand alone only if no piece holds a space after another character
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        # ids as text, followed by a comma, a bar or a semicolon
        self.marked = [f"{i}{m}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for m in ",|;"]
        self.marked_len = np.array([len(x) for x in self.marked], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[str] = []
        self.groups: list[str] = []         # a1,a2|b1;a3|b2,b3
        self.sound, self.uses = np.zeros(1 << 10, bool), np.zeros(1 << 10, np.int64)
        self.links, self.a_ids, self.b_ids, self.a_groups, self.b_groups = (_Flat(t) for t in (self.codes, np.int32, np.int32, np.int32, np.int32))
        self.bytes = 0

    def learn(self, parts: list[str]) -> None:
        """Encode and align parts that the store does not have.

        Parts with no white space at their ends are joined by single spaces and encoded in runs, then cut again by bytes.
        """
        joined = [] if self.whole else [p for p in parts if len(p) <= LONG_PART and len(p.strip()) == len(p)]
        for k in range(0, len(joined), ENCODE_TOGETHER):
            some = joined[k:k + ENCODE_TOGETHER]
            if not self._learn_joined(some):
                self._learn_alone(some)
        rest = parts if len(joined) == 0 else [p for p in parts if len(p) > LONG_PART or len(p.strip()) < len(p)]
        for k in range(0, len(rest), RUN):
            self._learn_alone(rest[k:k + RUN])

    def _learn_joined(self, parts: list[str]) -> bool:
        runs = [" ".join(parts[k:k + RUN]) for k in range(0, len(parts), RUN)]
        ta = [x for e in self.encode_a([" " + r for r in runs], add_special_tokens=False) for x in e.ids]
        tb = [x for row in self.b.encode(runs, num_threads=1) for x in row]
        want = "".join([" " + r for r in runs]).encode()
        if b"".join(map(self.a_bytes.__getitem__, ta)) != want or b"".join(map(self.b_bytes.__getitem__, tb)) != want:
            return False
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        counts = []
        for ids, size in ((ta, self.a_len), (tb, self.b_len)):
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, ends)
            if not np.array_equal(at[last], ends):
                return False
            counts.append(np.diff(last, prepend=-1))
        self._keep(parts, np.ones(len(parts), bool), np.array(ta), np.array(tb), *counts)
        return True

    def _learn_alone(self, parts: list[str]) -> None:
        a = [e.ids for e in self.encode_a([" " + p for p in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1)
        ok = np.zeros(len(parts), bool)
        for i, p in enumerate(parts):
            want = b" " + p.encode()
            ok[i] = b"".join([self.a_bytes[x] for x in a[i]]) == want and b"".join([self.b_bytes[x] for x in b[i]]) == want
            if not ok[i]:
                a[i], b[i] = [], []
        self._keep(parts, ok, *(np.array([x for row in t for x in row], dtype=np.int64) for t in (a, b)),
                   *(np.array([len(x) for x in t], dtype=np.int64) for t in (a, b)))

    def _keep(self, parts: list[str], ok: np.ndarray, ta: np.ndarray, tb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
        """Align the tokens of parts (na and nb of each) and store the parts."""
        ends_a, ends_b = np.cumsum(self.a_len[ta]), np.cumsum(self.b_len[tb])
        last_a, last_b = last_of_component(ends_a, ends_b)
        tail = np.flatnonzero(last_a == np.arange(len(ta)))                     # the A token that ends each group
        with_b = np.searchsorted(ends_b, ends_a[tail])                          # the B token that ends there too
        part = np.repeat(np.arange(len(parts)), na)
        per_part = np.bincount(part[tail], minlength=len(parts))
        first = np.cumsum(per_part) - per_part
        ga, gb = np.searchsorted(tail, last_a), np.searchsorted(tail, last_b)   # group numbers over all parts
        n = len(self.names)
        self.sound, self.uses = _room(self.sound, n, len(parts)), _room(self.uses, n, len(parts))
        self.sound[n:n + len(parts)], self.uses[n:n + len(parts)] = ok, 0
        self.known.update(zip(parts, range(n, n + len(parts))))
        self.names.extend(parts)
        self.links.extend((ta[tail] * len(self.b_bytes) + tb[with_b]).astype(self.codes), per_part)
        self.a_ids.extend(ta, na)
        self.b_ids.extend(tb, nb)
        self.a_groups.extend(ga - np.repeat(first, na), na)
        self.b_groups.extend(gb - np.repeat(first, nb), nb)
        self.groups.extend(self._texts(ta, tb, ga, gb, tail, with_b, na + nb))
        self.bytes += 300 * len(parts) + 4 * sum(map(len, parts)) + 18 * (len(ta) + len(tb))

    def _texts(self, ta, tb, ga, gb, tail, with_b, sizes) -> Iterator[str]:
        """`a1,a2|b1;a3|b2,b3` of every part: decimal ids with the mark that follows each, in group order, A before B."""
        mark_a, mark_b = np.zeros(len(ta), np.int64), np.zeros(len(tb), np.int64)
        mark_a[tail], mark_b[with_b] = 1, 2
        order = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
        pick = np.concatenate([ta * 3 + mark_a, tb * 3 + mark_b])[order]
        text = "".join(map(self.marked.__getitem__, pick.tolist()))
        edge = np.r_[0, np.cumsum(self.marked_len[pick])]
        ends = edge[np.cumsum(sizes)].tolist()
        at = 0
        for end in ends:
            yield text[at:max(at, end - 1)]
            at = end

    def forget(self) -> None:
        """Keep the parts that came at least twice (the latest KEEP_PARTS of them)."""
        stay = np.flatnonzero(self.uses[:len(self.names)] > 1)[-KEEP_PARTS:]
        stay = stay[self.a_ids.sizes[stay] <= LONG_PART]
        names, groups, flats = [self.names[i] for i in stay], [self.groups[i] for i in stay], {}
        for f in ("links", "a_ids", "b_ids", "a_groups", "b_groups"):
            flats[f] = getattr(self, f).rows(stay)
        sound, uses = self.sound[stay], self.uses[stay]
        self.clear()
        self.names, self.groups, self.sound, self.uses = names, groups, sound, uses // 2
        self.known = dict(zip(names, range(len(names))))
        for f, (data, sizes) in flats.items():
            getattr(self, f).extend(data, sizes)
        self.bytes = 300 * len(names) + 4 * sum(map(len, names)) + 18 * (self.a_ids.used + self.b_ids.used)

    def parts(self, text: str) -> list[str]:
        return [text] if self.whole else PART_CUT.split(text)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Rows of the store for parts, new ones learned first."""
        new = list(dict.fromkeys([w for w in words if w not in self.known]))
        if new:
            self.learn(new)
        rows = np.array([self.known[w] for w in words], dtype=np.int64)
        self.uses[:len(self.names)] += np.bincount(rows, minlength=len(self.names))
        return rows

    def documents(self, texts: Sequence[str | None], outputs: Sequence[str]) -> Iterator[dict]:
        """Per text its counts, links (bytes of id pair codes) and the outputs asked for."""
        waiting: list[tuple[int, str, bool]] = []       # document, piece, whether it ends the document
        size = 0
        state: dict[int, _Document] = {}
        for d, t in enumerate(texts):
            for piece, last in self.pieces(t or ""):
                waiting.append((d, piece, last))
                size += len(piece) + 1
                if size >= PIECE_CHARS:
                    yield from self._run(waiting, state, outputs)
                    waiting, size = [], 0
        yield from self._run(waiting, state, outputs)

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        while len(text) - at > PIECE_CHARS and not self.whole:
            m = PART_CUT.search(text, at + PIECE_CHARS)
            if not m:
                break
            yield text[at:m.start()], False
            at = m.end()
        yield text[at:], True

    def _run(self, waiting, state, outputs) -> Iterator[dict]:
        if self.bytes > STORE_BYTES:
            self.forget()
        words = [self.parts(piece) if piece else [] for _, piece, _ in waiting]
        rows = self.look_up([w for ws in words for w in ws])
        sizes = np.array([len(ws) for ws in words], dtype=np.int64)
        edge = np.r_[0, np.cumsum(sizes)]
        for k, (d, _, last) in enumerate(waiting):
            doc = state.setdefault(d, _Document())
            own = rows[edge[k]:edge[k + 1]]
            if len(own):
                doc.add(self, own, bool(self.sound[own].all()), outputs)
            if last:
                yield state.pop(d).result(outputs)


class _Document:
    """What the pieces of one text have given so far."""

    def __init__(self):
        self.ok, self.some, self.sha = True, False, hashlib.sha256()
        self.n_a = self.n_b = self.n_groups = 0
        self.links: list[np.ndarray] = []
        self.arrays: dict[str, list[np.ndarray]] = {}

    def add(self, al: Aligner, rows: np.ndarray, ok: bool, outputs: Sequence[str]) -> None:
        self.ok &= ok
        if not self.ok:
            self.links, self.arrays = [], {}
            return
        links, per_part = al.links.rows(rows)
        if "groups_sha256" in outputs:
            self.sha.update(((";" if self.some else "") + ";".join([al.groups[i] for i in rows.tolist()])).encode())
        first = self.n_groups + np.cumsum(per_part) - per_part
        self.n_a += int(al.a_ids.sizes[rows].sum())
        self.n_b += int(al.b_ids.sizes[rows].sum())
        for side in "ab":
            if f"{side}_ids" in outputs:
                self.arrays.setdefault(f"{side}_ids", []).append(getattr(al, f"{side}_ids").rows(rows)[0])
            if f"{side}_groups" in outputs:
                at, sizes = getattr(al, f"{side}_groups").rows(rows)
                self.arrays.setdefault(f"{side}_groups", []).append(at + np.repeat(first, sizes))
        self.n_groups += int(per_part.sum())
        self.links.append(links)
        self.some = True

    def result(self, outputs: Sequence[str]) -> dict:
        good = self.ok and self.some
        out = {"n_a": self.n_a if good else 0, "n_b": self.n_b if good else 0, "n_groups": self.n_groups if good else 0,
               "links": b"".join(x.tobytes() for x in self.links) if good else b""}
        for o in outputs:
            if o == "groups_sha256":
                out[o] = self.sha.hexdigest() if good else ""
            else:
                out[o] = np.concatenate(self.arrays[o]).astype(np.int32) if good and o in self.arrays else np.zeros(0, np.int32)
        return out


_cache: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _cache:
        _cache[a_path, b_path] = Aligner(a_path, b_path)
    return _cache[a_path, b_path]


def code_type(a_size: int, b_size: int):
    """Type of the code a * b_size + b of an id pair."""
    return np.dtype(np.uint32 if a_size * b_size <= 1 << 32 else np.int64)


def align_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text", id_col: str = "doc_id",
                    outputs: Sequence[str] = tuple(OUTPUTS)) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, links (codes of linked id pairs, packed) and the outputs asked for:

    groups_sha256 (of `a1,a2|b1;a3|b2,b3`), a_ids and b_ids, and the group number of every token (a_groups, b_groups).
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    wanted = [o for o in OUTPUTS if o in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        for b in batches:
            ids = b.column(0)
            got: list[dict] = []
            for i, r in enumerate(al.documents([x.as_py() for x in b.column(1)], wanted)):
                got.append(r)
                if len(got) == 256 or i == len(ids) - 1:
                    done = i + 1 - len(got)
                    cols = {"doc_id": ids.slice(done, len(got)), "n_a": pa.array([g["n_a"] for g in got], pa.int64()),
                            "n_b": pa.array([g["n_b"] for g in got], pa.int64()), "n_groups": pa.array([g["n_groups"] for g in got], pa.int64()),
                            "links": pa.array([g["links"] for g in got], pa.binary())}
                    for o in wanted:
                        cols[o] = pa.array([g[o] for g in got], pa.string() if OUTPUTS[o] == "string" else pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(cols)
                    got = []

    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, links binary" + "".join(f", {o} {OUTPUTS[o]}" for o in wanted)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean_map(run), schema)


def _flat_links(col: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    rows = [np.frombuffer(x.as_buffer() if x.is_valid else b"", dtype=kind) for x in col]
    return (np.concatenate(rows) if rows else np.zeros(0, kind)), np.array([len(r) for r in rows], dtype=np.int64)


def pair_counts(aligned: DataFrame, a_size: int, b_size: int) -> DataFrame:
    """(code, n, best) of every linked id pair of the corpus; best: no pair with the same B id has more links."""
    kind = code_type(a_size, b_size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"code": pa.array(code.astype(np.int64)), "m": pa.array(n.astype(np.int64))})

        for b in batches:
            flat, _ = _flat_links(b.column(0), kind)
            held.append(flat)
            size += len(flat)
            if size >= COUNT_TOGETHER:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    pairs = cut(aligned.select("links").mapInArrow(lean_map(count), "code bigint, m bigint").groupBy("code").agg(F.sum("m").alias("n")))
    top = pairs.groupBy(F.expr(f"code % {b_size}").alias("b")).agg(F.max("n").alias("most"))       # at most one row per B id
    return cut(pairs.join(F.broadcast(top), F.expr(f"code % {b_size} = b")).select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def linked_counts(aligned: DataFrame, a_size: int, b_size: int, head_pairs: int | None = None) -> DataFrame:
    """`aligned` without links, plus n_links, n_best and count_sum (sum over links of how often their pair is linked corpus-wide)."""
    spark, kind = aligned.sparkSession, code_type(a_size, b_size)
    bound = HEAD_PAIRS if head_pairs is None else head_pairs
    aligned = cut(aligned)
    pairs = pair_counts(aligned, a_size, b_size)
    # pairs by classes of their count, the highest classes that fit together are the head
    level = F.floor(F.log2("n") * 8)
    room, least, rest = bound, None, 0
    for r in sorted(pairs.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if rest or r["count"] > room:
            rest += r["count"]
        else:
            room, least = room - r["count"], r["level"]
    is_head = F.lit(False) if least is None else level >= least
    head = pairs.where(is_head).orderBy("code").toArrow()
    shared = spark.sparkContext.broadcast((head["code"].to_numpy(), head["n"].to_numpy(), head["best"].to_numpy()))
    others = [f for f in aligned.schema.fields if f.name != "links"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        ctx = TaskContext.get()
        base, seen = (ctx.partitionId() if ctx else 0) << 33, 0
        for b in batches:
            flat, sizes = _flat_links(b.column("links"), kind)
            flat = flat.astype(np.int64)
            who = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(codes, flat), max(len(codes) - 1, 0))
            hit = codes[at] == flat if len(codes) else np.zeros(len(flat), bool)
            total, good = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(total, who[hit], counts[at[hit]])
            np.add.at(good, who[hit], best[at[hit]].astype(np.int64))
            miss, edge = flat[~hit], np.r_[0, np.cumsum(np.bincount(who[~hit], minlength=len(sizes)))]
            cols = [b.column(f.name) for f in others] + [
                pa.array(sizes), pa.array(good), pa.array(total), pa.array(base + seen + np.arange(len(sizes))),
                pa.array([miss[edge[i]:edge[i + 1]] for i in range(len(sizes))], pa.list_(pa.int64()))]
            seen += len(sizes)
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in others] + ["n_links", "n_best", "count_sum", "row", "rare"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", n_links bigint, n_best bigint, count_sum bigint, row bigint, rare array<bigint>"
    scored = aligned.mapInArrow(lean_map(score), schema)
    if not rest:
        return scored.drop("row", "rare")
    scored = cut(scored)                        # read twice, and its row numbers must stay
    links = scored.select("row", F.explode("rare").alias("c")).groupBy("row", "c").agg(F.count(F.lit(1)).alias("times"))
    tail = pairs.where(~is_head).select(F.col("code").alias("pc"), "n", "best")
    more = (links.join(tail, F.expr("c = pc")).groupBy(F.col("row").alias("r"))
            .agg(F.sum(F.expr("times * n")).alias("more_sum"), F.sum(F.expr("if(best, times, 0)")).alias("more_best")))
    return (scored.join(more, F.expr("row = r"), "left")
            .select(*[f"`{f.name}`" for f in others], "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum")))
