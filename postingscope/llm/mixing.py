"""Mixing sources to target weights (operator 3): Sainte-Lague apportionment of equal-token blocks.

Targets: sources share a budget by weight; a source stops at `max_copies` times its own size and the excess
is shared again by weight until none is above.  The budget is then cut into blocks of `block_words` words and
every output shard gets integer block quotas: the quota of shard m is the difference of the apportionments for
the seats up to m + 1 and up to m.  Divisor methods never take a seat back when the house grows, so these
differences are never negative, each prefix of shards has the best mix for its size, and they add up to the
apportionment of the whole budget.

Selection: the documents of a source form a stream in seeded hash order; the blocks of the shards are consecutive stretches
of that stream, going round again after the last document (a second and third copy).  So every shard holds its
quota of every source, block by block, in seeded order, and only one document of a source is taken in part.
`shard_words` says how many words of a row each shard takes; `mix_documents` can name the shard in which a copy begins.  Stream positions come from (source, hash range) sums and a window inside one
hash range, so a source holding a third of all rows is spread over many tasks.

Defined cases: null text has size 0; null source is a source of its own, last in order; size 0 is never taken;
rows that repeat id and text keep their own place in the stream; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postingscope.llm.common import cut, free_name
from postingscope.operators.sequence import global_position

SEED = 20_240
ROWS_PER_RANGE = 5_000
HASH_BITS = 62
BROADCAST_SOURCES = 100_000     # boundary rows broadcast up to this checked count (about 10 MB); else a join


def n_words(text):
    """Words of [^\\x20\\x09-\\x0D]+ in a text column; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("bigint")


def _place(id_col: str, text: str, seed: int):
    """(h, id, tie): the seeded order of a source's stream."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 64 - HASH_BITS)
    return h, F.xxhash64(F.lit(seed + 1), F.col(text))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_copies: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from one row per source; sources in code point order, null last."""
    ranked = global_position(sizes.withColumn("is_null", F.col("source").isNull().cast("int")), ["is_null", "source"], "rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = cut(ranked.select("source", "source_size", w.cast("double").alias("weight")))
    budget = share * float(src.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:     # one-row aggregates; a round stops at least one more source, in practice two or three rounds
        full = F.lit(max_copies) * F.col("source_size") <= F.lit(level) * F.col("weight")
        row = src.agg(F.sum(F.when(full, max_copies * F.col("source_size")).otherwise(0)).alias("held"),
                      F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open"),
                      F.sum(full.cast("int")).alias("n")).first()
        if not row.open or row.n == capped:
            break
        level, capped = max(level, (budget - float(row.held)) / row.open), row.n
    return src.withColumn("target", F.least(max_copies * F.col("source_size").cast("double"), F.lit(level) * F.col("weight")))


def shard_quotas(targets: DataFrame, block_words: int, shards: int) -> DataFrame:
    """(source, shard, blocks, blocks_before): Sainte-Lague seats per source and output shard.

    For the house of each shard prefix, rounding target / divisor gives all but a few seats; the rest go to (or
    come from) the highest (lowest) quotients target / (2 k - 1).  Per source only as many quotients are listed
    as it could possibly win of the seats left over, so the list has at most four rows per source.
    """
    total = float(targets.agg(F.sum("target")).first()[0] or 0.0)
    seats = int(round(total / block_words))
    n = targets.count()
    houses = targets.where("target > 0").select(
        "source", "target", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("m")).withColumn(
        "house", F.expr(f"cast({seats} * m div {shards} as bigint)"))
    base = houses.withColumn("seats", F.floor(F.col("target") * F.col("house") / F.lit(max(total, 1e-300)) + 0.5))
    short = base.groupBy("m").agg((F.first("house") - F.sum("seats")).alias("miss"))
    room = F.ceil(F.col("target") / F.lit(max(total, 1e-300)) * (F.abs("miss") + F.lit(n))) + 1
    # open seats: quotients after the seats held; surplus seats: the lowest quotients held
    step = F.explode(F.sequence(F.lit(1).cast("bigint"), F.when(F.col("miss") < 0, F.least(room, F.col("seats"))).otherwise(room)))
    listed = (base.join(short, "m").where("miss != 0 and (miss > 0 or seats > 0)").withColumn("k", step)
              .withColumn("seat", F.when(F.col("miss") > 0, F.col("seats") + F.col("k")).otherwise(F.col("seats") - F.col("k") + 1))
              .withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1)))
    order = F.when(F.col("miss") > 0, -F.col("quotient")).otherwise(F.col("quotient"))
    won = (listed.withColumn("place", F.row_number().over(Window.partitionBy("m").orderBy(order, F.col("source").asc_nulls_last())))
           .where(F.col("place") <= F.abs("miss"))
           .groupBy("m", F.col("source").alias("s")).agg(F.sum(F.signum("miss")).cast("bigint").alias("change")))
    a, b = base.alias("a"), won.alias("b")
    upto = a.join(b, F.expr("a.m = b.m and a.source <=> b.s"), "left").select(
        "source", a["m"], (F.col("seats") + F.coalesce("change", F.lit(0))).cast("bigint").alias("upto"))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("m")), F.lit(0))
    return upto.select("source", (F.col("m") - 1).alias("shard"), (F.col("upto") - before).alias("blocks"),
                       before.alias("blocks_before"))


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", block_words: int = 16,
             shards: int = 16, max_copies: int = 3, seed: int = SEED, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, shard_words (what each shard takes of it), and its place: h, tie,
    start, quota_words, ends (where the shards' stretches of the source's stream end)."""
    h, tie = _place(id_col, text, seed)
    narrow = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                             h.alias("h"), tie.alias("tie")))
    sizes = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    bits = max(6, int(rows // ROWS_PER_RANGE).bit_length())
    targets = cut(source_targets(sizes.drop("n"), weights, max_copies=max_copies))
    quotas = (shard_quotas(targets, block_words, shards).groupBy(F.col("source").alias("s"))
              .agg(F.array_sort(F.collect_list(F.struct("shard", (F.col("blocks_before") + F.col("blocks")).alias("upto")))).alias("q")))     # one per shard
    ends = F.transform(F.coalesce("q.upto", F.array_repeat(F.lit(0).cast("bigint"), shards)),
                       lambda b: F.least(b * block_words, max_copies * F.col("source_size")))
    plan = targets.join(quotas, F.expr("source <=> s"), "left").select(
        "source", "source_size", "target", ends.alias("ends"), F.element_at(ends, -1).alias("quota_words"))
    ranged = narrow.withColumn("part", F.shiftright("h", HASH_BITS - bits))
    offsets = (ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
               .withColumn("offset", F.sum("part_size").over(Window.partitionBy("source").orderBy("part")
                                                             .rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_size")))
    o = offsets.join(plan.withColumnRenamed("source", "ps"), F.expr("source <=> ps")).drop("ps", "part_size") \
        .withColumnRenamed("source", "os").withColumnRenamed("part", "op")
    w = Window.partitionBy("source", "part").orderBy("h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = (ranged.withColumn("inside", F.sum("size").over(w) - F.col("size"))
              .join(o, F.expr("source <=> os and part = op"))
              .withColumn("start", F.col("offset") + F.col("inside")))
    at = [F.col("start") + c * F.col("source_size") for c in range(max_copies)]
    taken = sum(F.greatest(F.lit(0), F.least(F.col("quota_words"), a + F.col("size")) - a) for a in at)

    def inside(end, m):
        begin = F.when(m > 0, F.get("ends", m - 1)).otherwise(F.lit(0))
        return sum(F.greatest(F.lit(0).cast("bigint"), F.least(end, a + F.col("size")) - F.greatest(begin, a)) for a in at)

    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"),
                         F.transform("ends", inside).alias("shard_words"), "h", "tie", "start", "quota_words", "ends")


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", shard_col: str | None = None,
                  **options) -> DataFrame:
    """The mixed documents, same columns: whole copies, and the one document per source that is taken in part
    with the words taken.  Rows equal in id and text share one decision.  `shard_col` adds the shard in which a copy begins.

    The decision needs one boundary row per source (and per shard, where asked for), so texts are not shuffled.
    """
    plan = cut(mix_plan(docs, text, source, id_col, **options).where("size > 0"))
    rest = F.expr("quota_words % source_size")
    edge = (plan.where((F.col("start") <= rest) & (rest < F.col("start") + F.col("size")))
            .groupBy("source").agg(F.min(F.struct("h", "doc_id", "tie")).alias("edge"), F.first(rest - F.col("start")).alias("part"),
                                   F.first(F.expr("quota_words div source_size")).alias("rounds"))
            .select(F.col("source").alias("edge_source"), "edge", "part", "rounds"))
    if shard_col:
        # where each shard begins: the copy and the document, or the place after one that begins before
        begins = F.transform(F.concat(F.array(F.lit(0).cast("bigint")), F.slice("ends", F.lit(1), F.size("ends") - 1)), lambda p, m: F.struct(m.alias("m"), p.alias("p")))
        here = F.filter(begins, lambda x: (F.col("start") <= x["p"] % F.col("source_size")) & (x["p"] % F.col("source_size") < F.col("start") + F.col("size")))
        starts = (plan.select("source", "source_size", "start", "h", "doc_id", "tie", F.explode(here).alias("x"))
                  .groupBy(F.col("source").alias("s")).agg(F.collect_list(F.struct(
                      F.expr("cast(x.p div source_size as int)").alias("copy"), "h", "doc_id", "tie", F.expr("cast(x.p % source_size > start as int)").alias("after"))).alias("starts")))
        edge = edge.join(starts, F.expr("edge_source <=> s"), "left").drop("s")
    if edge.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        edge = F.broadcast(edge)
    h, tie = _place(id_col, text, options.get("seed", SEED))
    row, copy = free_name(docs, "row"), free_name(docs, "copy")
    here = F.struct(h.alias("h"), F.col(f"{row}.{id_col}").alias("doc_id"), tie.alias("tie"))
    wide = docs.select(F.struct(*docs.columns).alias(row), n_words(F.col(text)).alias("n"), h.alias("h"), tie.alias("tie"))
    here = F.struct("h", F.col(row)[id_col].alias("doc_id"), "tie")
    both = (wide.join(edge, F.col(row)[source].eqNullSafe(F.col("edge_source"))).where("n > 0")
            .withColumn("full", (F.col("rounds") + (here < F.col("edge")).cast("int")).cast("int"))
            .withColumn("words", F.when(here == F.col("edge"), F.col("part")).otherwise(F.lit(0))))
    pieces = F.concat(F.array_repeat(F.lit(-1).cast("bigint"), F.col("full")),
                      F.when(F.col("words") > 0, F.array("words")).otherwise(F.array().cast("array<bigint>")))
    out = both.select("*", F.posexplode(pieces).alias("nth", copy))
    mark = F.struct(F.col("nth").alias("copy"), "h", F.col(row)[id_col].alias("doc_id"), "tie", F.lit(0).alias("after"))
    extra = [(F.size(F.filter("starts", lambda e: e <= mark)) - 1).alias(shard_col)] if shard_col else []
    kept = F.array_join(F.slice(F.array_remove(F.split(F.col(row)[text], r"[\x20\x09-\x0D]+"), ""), 1, F.greatest(F.col(copy), F.lit(1)).cast("int")), " ")
    return out.select(*[F.when(F.col(copy) > 0, kept).otherwise(F.col(row)[c]).alias(c) if c == text else F.col(row)[c].alias(c)
                        for c in docs.columns], *extra)
