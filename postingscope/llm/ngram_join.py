"""N-gram Jaccard join (operator 9): adaptive multi-match prefixes.

Two documents link if the Jaccard similarity of their sets of five-word shingles is at least 0.75.  Sets with n
members that link share at least need(n) = ceil(0.75 n) of each other's members.  So for every l, the first
n - need(n) + l members of both sets, in any order common to all sets, share at least l ("l-prefixes", l
matches).  With two different lengths the smaller l holds.

1. Documents with equal sets are one class; classes take part once.
2. Which classes can link at all?  In hash order, prefixes with l = a tenth of the set are exchanged: a second read of the texts
   sends (token, class tag) packed by a hash of the token, to as many owners as the text asks for; owners credit every class
   whose token is held by another class too, and credits are added up by ranges of tags.  A token that a sender sees
   in several classes is sent once and credited on the spot, so frequent tokens stay small.  Classes with fewer than
   l credits have no partner; the rest ("candidates") is read again in full.
3. Among candidates tokens are counted exactly and ordered rare first; tokens held once only count towards the
   prefix.  Each class chooses its own l: the estimated cost of a length is the sum of its tokens' frequencies
   (list entries read) plus the bound sum / l on the partners to verify; the cheapest l wins, so classes with
   costly tokens get longer prefixes and need more matches.
4. Very frequent tokens mark large families of near copies.  Their members are compared with a pivot of
   families that agree on a min-hash (linear, salted); the links found are true links and give first
   components, so that a family does not meet itself pair by pair.
5. The prefix index is joined on tokens between classes and components: (class, other component) pairs with at
   least min(l of the class, smallest l of the component) matches are verified exactly, in blocks of members.  The larger
   of two partners finds the smaller one, which shares 6/7 of itself, not only 3/4, and so lists fewer tokens; a class
   whose shared tokens are fewer than that is not listed at all.
   This is the pairwise join with equal partners' components folded; a pair inside one component need not be
   verified.  No link between different components can be missed, so the components are exact.

Tokens are 64-bit hashes of shingles; step 2 packs 48 bits of a token (chance agreement only adds work) and 40
bits of a class tag.  Defined cases: null or empty text, or one without words: empty set, no links,
component_id its own id; fewer than five words: the whole sequence is the one shingle; null ids are ignored
in the minimum; repeated rows are members of one class; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postingscope.llm.common import (bounded_filter, cut, free_name, lean_group, lean_map, may_contain, per_key, small_batches)
from postingscope.llm.components import components as connected
from postingscope.llm.textbytes import mix64, shingle_sets

PERCENT = 75                # 100 * intersection >= PERCENT * union
FLUSH_TOKENS = 1 << 20      # tokens a sender gathers before it sends
OWNED_TOKENS = 1 << 20      # tokens that one owner sorts, at most on average
RANGE_TAGS = 1 << 16        # classes whose credits are added up together
MAX_L = 16                  # longest extension of a candidate's prefix
VERIFY_COST = 8             # verifying one partner costs as much as reading so many list entries
FAMILY_FREQUENCY = 64       # mean token frequency in the prefix from which a class is compared with pivots first
PIVOT_ROUNDS = 4
FAMILY_GROUP = 1_000        # members that one pivot meets
BLOCK = 256                 # component members verified together
GUESTS = 256                # classes that meet one block together


def need(n: np.ndarray) -> np.ndarray:
    return (PERCENT * n + 99) // 100


def links(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def owners(octets: int) -> int:
    """How many owners share the prefix tokens of texts of so many bytes (a word and its end take two at least)."""
    words = octets // 2 + 1
    return max(16, -(-words * (100 - PERCENT + 10) // 100 // OWNED_TOKENS))


def owner_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Owner of every 48-bit token: mixed again, as prefixes hold the smallest hashes of their sets."""
    return (mix64(tokens) % np.uint64(buckets)).astype(np.int64)


def _pack(values: np.ndarray, size: int) -> np.ndarray:
    """The low `size` bytes of every value, one row each."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :size]


def _unpack(col, size: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(x.as_buffer() for x in col if x.is_valid), np.uint8).reshape(-1, size)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :size] = raw
    return full.view(np.uint64).ravel()


def _keyed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n) of every row; key is null for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [(_key(s) if len(s) else None, len(s)) for s in shingle_sets(b.column(1), words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in sets], pa.binary()), pa.array([n for _, n in sets], pa.int64())],
                                             names=["doc_id", "key", "n"])

    kind = dict(docs.dtypes)["doc_id"]
    return cut(docs.select("doc_id", "text").mapInArrow(lean_map(run), f"doc_id {kind}, key binary, n bigint"))


def _credits(docs: DataFrame, words: int, classes: int) -> DataFrame:
    """(tag, credits): how many prefix tokens of a class are held by another one too (step 2).

    The texts are read once more and their packed tokens go straight into the exchange, so they are never
    written elsewhere.  What an owner credits goes on packed by ranges of tags and is added up there.
    """
    octets = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets, ranges = owners(octets), -(-max(1, classes) // RANGE_TAGS)

    def by(where: np.ndarray, n: int, *cols: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
        """Rows dealt out by `where` (0 .. n - 1): the number and the bytes of every column."""
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(n + 1))
        cols = [c[order] for c in cols]
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
            yield int(k), [c[cuts[k]:cuts[k + 1]].tobytes() for c in cols]

    def packet(tokens: list[np.ndarray], tags: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(tokens) >> np.uint64(16)
        own = np.repeat(np.array(tags, dtype=np.uint64), [len(t) for t in tokens])
        order = np.argsort(flat, kind="stable")
        flat, own = flat[order], own[order]
        edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        several = np.diff(np.r_[edge, len(flat)]) > 1
        inside = np.repeat(several, np.diff(np.r_[edge, len(flat)]))
        tag, n = np.unique(own[inside], return_counts=True)                     # credited on the spot
        flat, own = flat[edge], np.where(several, np.uint64(0), own[edge])      # tag 0: held by several
        rows = [(k, x, y, None, None) for k, (x, y) in by(owner_of(flat, buckets), buckets, _pack(flat, 6), _pack(own, 5))]
        if len(tag):
            rows += [(k, None, None, x, y) for k, (x, y) in by(owner_of(tag, buckets), buckets, _pack(tag, 5), n.astype(np.uint32))]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "tokens", "tags", "credited", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, tags, here, held = [], [], set(), 0
        for b in batches:
            for s in shingle_sets(b.column(0), words):
                key = _key(s) if len(s) else None
                if key is None or key in here:
                    continue
                here.add(key)
                n = len(s)
                length = n - int(need(np.int64(n))) + -(-n // 10)
                tokens.append(s[:length])
                tags.append(int.from_bytes(key[:5], "little") or 1)
                held += length
                if held >= FLUSH_TOKENS:
                    yield packet(tokens, tags)
                    tokens, tags, here, held = [], [], set(), 0
        if tokens:
            yield packet(tokens, tags)

    def own(t: pa.Table) -> pa.Table:
        tok, tag = _unpack(t["tokens"], 6), _unpack(t["tags"], 5)
        order = np.lexsort((tag, tok))
        tok, tag = tok[order], tag[order]
        new = np.r_[True, tok[1:] != tok[:-1]][:len(tok)]
        fresh = new | np.r_[True, tag[1:] != tag[:-1]][:len(tok)]
        group = np.cumsum(new) - 1
        shared = np.bincount(group[fresh]) + np.bincount(group, weights=tag == 0) > 1 if len(tok) else np.zeros(0, bool)
        met = tag[fresh & shared[group] & (tag > 0)] if len(tok) else tag
        told = np.frombuffer(b"".join(x.as_buffer() for x in t["counts"] if x.is_valid), np.uint32)
        who, n = add_up(np.r_[met, _unpack(t["credited"], 5)], np.r_[np.ones(len(met), np.int64), told.astype(np.int64)])
        rows = list(by((who % np.uint64(ranges)).astype(np.int64), ranges, _pack(who, 5), n.astype(np.uint32)))
        return pa.table({"part": pa.array([k for k, _ in rows], pa.int32()), "tags": pa.array([x[0] for _, x in rows], pa.binary()),
                         "counts": pa.array([x[1] for _, x in rows], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:                       # what is held grows with the tags of the range, not with what is sent
            counts = np.frombuffer(b"".join(x.as_buffer() for x in b.column("counts")), np.uint32)
            who, n = add_up(np.r_[who, _unpack(b.column("tags"), 5)], np.r_[n, counts.astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int64)), pa.array(n)], names=["tag", "credits"])

    owned = (docs.select("text").mapInArrow(lean_map(send), "bucket int, tokens binary, tags binary, credited binary, counts binary")
             .groupBy("bucket").applyInArrow(lean_group(own), "part int, tags binary, counts binary"))
    return owned.groupBy("part").applyInArrow(total, "tag bigint, credits bigint")


def add_up(who: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the sum of n of each."""
    order = np.argsort(who, kind="stable")
    who, n = who[order], n[order]
    edge = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][:len(who)])
    return who[edge], np.add.reduceat(n, edge) if len(edge) else n


def _low(key: str, size: int):
    """The first `size` bytes of a binary column as a little-endian long."""
    return sum(F.shiftleft(F.conv(F.hex(F.substring(key, i + 1, 1)), 16, 10).cast("bigint"), 8 * i) for i in range(size))


def _candidates(docs: DataFrame, classes: DataFrame, credits: DataFrame, words: int) -> DataFrame:
    """(cid, rep_id, n, tokens) of the classes that may have a partner; cid is 60 bits of the key."""
    enough = F.greatest(F.lit(1), F.ceil(F.col("n") / 10))
    alive = cut(classes.withColumn("t", F.when(F.col("tag5") == 0, F.lit(1)).otherwise(F.col("tag5")))
                .join(credits, F.expr("t = tag")).where(F.col("credits") >= enough).select("key", "cid", "rep_id", "n"))
    bits, size = bounded_filter(alive, "cid", alive.count())
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sets = [], []
            for s in shingle_sets(b.column(0), words):
                if len(s):
                    keys.append(_key(s))
                    sets.append(s)
            cid = np.array([int.from_bytes(k[:8], "little") & ((1 << 60) - 1) for k in keys], dtype=np.int64)
            ok = np.flatnonzero(may_contain(shared.value, size, cid.view(np.uint64))) if len(cid) else []
            for a in range(0, len(ok), 256):
                pick = ok[a:a + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in pick], pa.binary()),
                     pa.array([sets[i].view(np.int64) for i in pick], pa.list_(pa.int64()))], names=["k", "tokens"])

    found = docs.select("text").mapInArrow(lean_map(read), "k binary, tokens array<bigint>").dropDuplicates(["k"])
    return cut(alive.join(found, F.expr("key = k")).select("cid", "rep_id", "n", "tokens"))


def _ordered(cand: DataFrame) -> DataFrame:
    """(cid, n, toks, freqs): shared tokens, rare first; classes whose shared tokens cannot reach need(n) go."""
    tok = cand.select("cid", "n", F.explode("tokens").alias("t"))
    freq = tok.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1").withColumnRenamed("t", "ft")
    both = (tok.join(freq, F.expr("t = ft")).groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("s"))
            .where(F.expr(f"size(s) >= ({PERCENT} * n + 99) div 100")))
    return both.select("cid", "n", F.col("s.t").alias("toks"), F.col("s.f").alias("freqs"))


def choose_prefix(n: int, freqs: np.ndarray) -> tuple[int, int]:
    """(l, prefix length among the shared tokens) with the least estimated cost."""
    base = len(freqs) - int(need(np.int64(n)))              # tokens held once already fill the rest
    top = min(MAX_L, int(need(np.int64(n))))
    ls = np.arange(1, top + 1)
    read = np.cumsum(freqs)[base + ls - 1]
    best = int(np.argmin(read + VERIFY_COST * read / ls))
    return int(ls[best]), base + int(ls[best])


def index_length(n: int, held: int, l: int) -> int:
    """How many of the shared tokens are listed for larger partners to find: with a partner of n members or more the overlap is 6/7 n at least.

    None if even all `held` shared tokens stay below that: then only a smaller partner, which this one finds, can link.
    """
    least = -(-2 * PERCENT * n // (100 + PERCENT))
    return held - least + l if held >= least else 0


def _prefixes(ordered: DataFrame) -> DataFrame:
    """Adds l, k (prefix length), family (whether frequent tokens ask for pivots) and the min-hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ls, ks, kis, family, hashes = [], [], [], [], []
            for n, toks, freqs in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                f, t = np.array(freqs.values), np.array(toks.values).astype(np.int64).view(np.uint64)
                le, k = choose_prefix(n, f)
                ls.append(le)
                ks.append(k)
                kis.append(index_length(n, len(f), le))
                hot = f[:k].mean() >= FAMILY_FREQUENCY or np.median(f) >= FAMILY_FREQUENCY
                family.append(bool(hot))
                hashes.append([int(mix64(t ^ np.uint64(0x5851F42D4C957F2D * (r + 1) & (1 << 64) - 1)).min().view(np.int64)) for r in range(PIVOT_ROUNDS)] if hot else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ls, pa.int32()), pa.array(ks, pa.int32()), pa.array(kis, pa.int32()), pa.array(family, pa.bool_()),
                                              pa.array(hashes, pa.list_(pa.int64()))], names=[*b.schema.names, "l", "k", "ki", "family", "hashes"])

    return cut(ordered.mapInArrow(lean_map(run), "cid bigint, n bigint, toks array<bigint>, freqs array<bigint>, l int, k int, ki int, family boolean, hashes array<bigint>"))


def overlaps(a_sets: list[np.ndarray], b_sets: list[np.ndarray], least: np.ndarray | None = None) -> np.ndarray:
    """Matrix of intersection sizes of token sets (any order inside a set).

    Rows whose overlap with the union of all b_sets stays below `least` are left at zero.
    """
    flat = np.concatenate(b_sets) if b_sets else np.zeros(0, np.int64)
    who = np.repeat(np.arange(len(b_sets)), [len(x) for x in b_sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    out = np.zeros((len(a_sets), len(b_sets)), dtype=np.int64)
    for i, s in enumerate(a_sets):
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        size = hi - lo
        if least is not None and np.count_nonzero(size) < least[i]:
            continue
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[i] = np.bincount(who[at], minlength=len(b_sets))
    return out


def _sets(col) -> list[np.ndarray]:
    return [np.array(x.values).astype(np.int64) for x in col]


def _pivot_links(prefixed: DataFrame) -> DataFrame:
    """(u, v): true links between family members and the pivots of their min-hash groups (step 4)."""
    long = prefixed.where("family").select("cid", "n", "toks", F.posexplode("hashes").alias("r", "h"))
    sizes = cut(long.groupBy("r", "h").agg(F.count(F.lit(1)).alias("members")).where("members > 1").withColumn("rows", F.col("members")))
    salted = (per_key(long, sizes, ["r", "h"], "rows", sizes.agg(F.sum("rows")).first()[0] or 0).where("members is not null")
              .withColumn("salt", F.expr(f"pmod(xxhash64(cid, r), (members + {FAMILY_GROUP - 1}) div {FAMILY_GROUP})"))
              .select("r", "h", "salt", "cid", "n", "toks"))

    def meet(t: pa.Table) -> pa.Table:
        cid, n, r = t["cid"].to_numpy(), t["n"].to_numpy(), int(t["r"][0].as_py())
        sets = _sets(t["toks"])
        if r == 0:
            lead = int(np.lexsort((cid, -np.array([len(s) for s in sets]) / n))[0])     # the fewest edits
        else:
            lead = int(np.argmin(mix64(cid.view(np.uint64) + np.uint64(r))))
        o = overlaps([sets[lead]], sets)[0]
        ok = links(o, n, n[lead])
        ok[lead] = False
        return pa.table({"u": pa.array(cid[ok], pa.int64()), "v": pa.array(np.full(int(ok.sum()), cid[lead]), pa.int64())})

    return salted.groupBy("r", "h", "salt").applyInArrow(lean_group(meet), "u bigint, v bigint")


def _verified(prefixed: DataFrame, first: DataFrame) -> DataFrame:
    """(u, v): for every class and other component that it links with, at least one true link (step 5)."""
    label = first.select(F.col("node").alias("ln"), "root")
    known = prefixed.join(label, F.expr("cid = ln"), "left").withColumn("comp", F.coalesce("root", "cid")).drop("ln", "root")
    stats = known.groupBy(F.col("comp").alias("sc")).agg(F.min("l").alias("lmin"), F.min("n").alias("nmin"), F.max("n").alias("nmax"),
                                                         F.count(F.lit(1)).alias("members"))
    px = known.select("cid", "n", "l", "comp", F.explode(F.slice("toks", F.lit(1), F.col("k"))).alias("t"))
    listed = (known.where("ki > 0").select("comp", "n", F.explode(F.slice("toks", F.lit(1), F.col("ki"))).alias("t"))
              .groupBy(F.col("t").alias("at"), F.col("comp").alias("other")).agg(F.min("n").alias("least")))
    pairs = (px.join(listed, F.expr("t = at and other <> comp and (least < n or least = n and other < comp)")).groupBy("cid", "n", "l", "other").agg(F.count(F.lit(1)).alias("matches"))
             .join(stats, F.expr("other = sc"))
             .where(f"matches >= least(l, lmin) and 100 * nmin <= n * 10000 / {PERCENT} and 100 * nmax >= {PERCENT} * n")
             .select("cid", "n", "other", "members"))
    pairs = cut(pairs)
    guests = pairs.groupBy(F.col("other").alias("go")).agg(F.expr(f"(count(1) + {GUESTS - 1}) div {GUESTS}").alias("salts"))
    sets = prefixed.select(F.col("cid").alias("sid"), "toks")
    left = (pairs.join(guests, F.expr("other = go")).withColumn("salt", F.expr("pmod(xxhash64(cid), salts)"))
            .withColumn("block", F.explode(F.expr(f"sequence(0L, (members - 1) div {BLOCK})")))
            .join(sets, F.expr("cid = sid"))
            .select("other", "block", "salt", F.col("cid").alias("gcid"), F.col("n").alias("gn"), F.col("toks").alias("gtoks")))
    hosts = (known.select("cid", "n", "toks", "comp").join(stats.select("sc", "members"), F.expr("comp = sc")).join(guests, F.expr("comp = go"))
             .withColumn("block", F.expr(f"pmod(xxhash64(cid), (members - 1) div {BLOCK} + 1)"))
             .withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)")))
             .select(F.col("comp").alias("home"), F.col("block").alias("hblock"), F.col("salt").alias("hsalt"),
                     F.col("cid").alias("hcid"), F.col("n").alias("hn"), F.col("toks").alias("htoks")))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        ca, cb, na, nb = a["gcid"].to_numpy(), b["hcid"].to_numpy(), a["gn"].to_numpy(), b["hn"].to_numpy()
        ok = links(overlaps(_sets(a["gtoks"]), _sets(b["htoks"]), need(na)), na[:, None], nb[None, :])
        i = np.flatnonzero(ok.any(axis=1))
        return pa.table({"u": pa.array(ca[i], pa.int64()), "v": pa.array(cb[ok[i].argmax(axis=1)], pa.int64())})

    return left.groupBy("other", "block", "salt").cogroup(hosts.groupBy("home", "hblock", "hsalt")).applyInArrow(lean_group(compare), "u bigint, v bigint")


def components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, copies (rows with the same shingle set)."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    rows = _keyed(slim, words)
    classes = (rows.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"))
               .withColumn("tag5", _low("key", 5)).withColumn("cid", _low("key", 8).bitwiseAND((1 << 60) - 1)))
    cand = _candidates(slim, classes, _credits(slim, words, classes.count()), words)
    prefixed = _prefixes(_ordered(cand))
    seeds = cut(_pivot_links(prefixed))
    found = _verified(prefixed, connected(seeds))
    root = cut(connected(seeds.union(found)))
    # the smallest document of each component, for the classes that link
    names = root.join(cand.select(F.col("cid").alias("c"), "rep_id"), F.expr("node = c"))
    least = names.groupBy(F.col("root").alias("r")).agg(F.min("rep_id").alias("component"))
    linked = names.join(least, F.expr("root = r")).select(F.col("node").alias("linked_cid"), "component")
    named = classes.join(linked, F.expr("cid = linked_cid"), "left").select(
        F.col("key").alias("k"), "copies", F.coalesce("component", "rep_id").alias("component_id"))
    return rows.join(named, F.expr("key = k"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def keep_one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5) -> DataFrame:
    """The documents that stay, with all columns: the smallest id of every component.

    Rows that go are found by id; rows that certainly stay (a bounded bit filter) are not shuffled.  Rows with
    a null id and those that repeat the id of a document that stays, stay.
    """
    gone = cut(components(docs, text, id_col, words).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
               .withColumn("h", F.xxhash64("gone_id")))
    bits, size = bounded_filter(gone, "h", gone.count())
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    flag, gone_id = free_name(docs, "listed"), free_name(docs, "gone_id")

    @F.pandas_udf("boolean")
    def listed(h):
        import pandas as pd
        return pd.Series(may_contain(shared.value, size, h.to_numpy().astype(np.int64).view(np.uint64)))

    seen = docs.withColumn(flag, listed(F.xxhash64(F.col(id_col))))
    drop = gone.select(F.col("gone_id").alias(gone_id))
    some = seen.where(F.col(flag)).join(drop, F.col(id_col) == F.col(gone_id), "left_anti")
    return seen.where(~F.col(flag)).unionByName(some).select(*docs.columns)
