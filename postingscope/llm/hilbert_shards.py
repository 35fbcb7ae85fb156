"""Sharding (operator 8): rows in the order of a Hilbert curve over metadata, cut into equal runs.

Three metadata dimensions (source, language, text size) are quantised to `bits` bits each; the index of the
cell on the three-dimensional Hilbert curve orders the rows, so a shard covers a compact region of the
metadata and files can be pruned by any of the dimensions.  Categories are quantised by their rank in code point order (nulls
first), sizes by half powers of two.  Equal texts count as one group: all take the cell of their smallest member, and lie
side by side.  Shard = position * shards div rows: the law is `rows`, the counts of two shards differ by at most one.

`write_shards` writes the whole rows, one folder per shard, in curve order, and a table of each shard's bounds (row count,
smallest and largest source, language and size); `read_shards` opens only the shards whose bounds meet the wanted ranges.

Positions are exact without one task seeing all rows: range partitions, the index inside a partition and the
number of rows of earlier partitions (one row per partition, broadcast).

Defined cases: null text has no bytes (size 1); null metadata is a category of its own, the first; rows that are equal in
all of this take neighbouring places; fewer rows than shards leave shards empty; an empty table gives an
empty result.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postingscope.llm.common import cut, free_name, per_key
from postingscope.operators.sequence import global_position

BITS = 4


def hilbert_index(dims: list[Column], bits: int = BITS) -> tuple[Column, list[Column]]:
    """Skilling's transform of integer coordinates (each below 2**bits) to the Hilbert curve.

    Returns the folded state and the bits of the index, highest first, as expressions over the state column
    `_x` (struct x: array, t).  The fold runs over the bit planes; a plane's dimensions are literal steps.
    """
    n = len(dims)

    def at(x: Column, k: int) -> Column:
        return F.get(x, F.lit(k))

    def with_items(x: Column, items: dict[int, Column]) -> Column:
        return F.array(*[items.get(k, at(x, k)) for k in range(n)])

    def step(i: int, q: Column):
        def go(x: Column) -> Column:
            inverted = with_items(x, {0: at(x, 0).bitwiseXOR(q - 1)})
            t = at(x, 0).bitwiseXOR(at(x, i)).bitwiseAND(q - 1)
            swapped = with_items(x, {0: at(x, 0).bitwiseXOR(t), i: at(x, i).bitwiseXOR(t)}) if i else x
            return F.when(at(x, i).bitwiseAND(q) != 0, inverted).otherwise(swapped)
        return go

    def undo(x: Column, q: Column) -> Column:
        for i in range(n):
            x = F.transform(F.array(x), step(i, q))[0]          # a let-binding: x is used many times
        return x

    def gray(x: Column) -> Column:
        parts = [at(x, 0)]
        for k in range(1, n):
            parts.append(at(x, k).bitwiseXOR(parts[-1]))
        return F.array(*parts)

    def flip(last: Column):
        return lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)

    def finish(x: Column) -> Column:
        return F.struct(x.alias("x"), F.aggregate(planes, F.lit(0), flip(at(x, n - 1))).alias("t"))

    planes = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    x = F.aggregate(planes, F.array(*[d.cast("int") for d in dims]), undo)
    state = F.transform(F.transform(F.array(x), gray), finish)[0]
    out = [F.shiftright(F.get(F.col("_x.x"), F.lit(k)).bitwiseXOR(F.col("_x.t")), b).bitwiseAND(F.lit(1)).cast("bigint")
           for b in range(bits - 1, -1, -1) for k in range(n)]
    return state, out


def with_hilbert(df: DataFrame, dims: list[Column], out: str, bits: int = BITS) -> DataFrame:
    state, index_bits = hilbert_index(dims, bits)
    index = sum(F.shiftleft(b, len(index_bits) - 1 - i) for i, b in enumerate(index_bits))
    return df.withColumn("_x", state).withColumn(out, index).drop("_x")


def ranked_cells(df: DataFrame, col: str, bits: int = BITS) -> DataFrame:
    """(value, rows, cell) per category: its rank among the categories, quantised to 2**bits cells of equal numbers of categories."""
    values = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("rows")).withColumn("some", F.col("value").isNotNull())
    placed = cut(global_position(values, ["some", "value"], "rank"))
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    cell = F.when(F.col("total") <= 1 << bits, F.col("rank")).otherwise(F.expr(f"rank * {1 << bits} div total"))
    return placed.crossJoin(F.broadcast(total)).select("value", "rows", cell.cast("int").alias("cell"))        # one row


def magnitude(size: Column, bits: int = BITS) -> Column:
    """Half powers of two above 64, clipped: the cell of a size."""
    return F.least(F.greatest(F.floor(2 * (F.log2(size.cast("double")) - 6)), F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def shard_rows(docs: DataFrame, shards: int = 16, text: str = "text", id_col: str = "doc_id", source: str = "source",
               lang: str = "lang", bits: int = BITS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    t = F.coalesce(F.col(text), F.lit(""))
    slim = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + 1).cast("bigint").alias("size"),
                           F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.xxhash64(t).alias("text_hash"),
                           F.col(source).alias("source"), F.col(lang).alias("lang")))
    total = slim.count()
    for c in ("source", "lang"):
        cells = ranked_cells(slim, c, bits).select(F.col("value").alias(c), "rows", F.col("cell").alias(f"{c}_cell"))
        slim = per_key(slim, cells, [c], "rows", total)
    slim = cut(with_hilbert(slim, [F.col("source_cell"), F.col("lang_cell"), magnitude(F.col("size"), bits)], "cell", bits)
               .select("doc_id", "size", "text_crc32", "text_hash", "cell"))
    groups = (slim.groupBy("text_hash", "size").agg(F.min(F.struct("doc_id", "cell"))["cell"].alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    both = per_key(slim, groups, ["text_hash", "size"], "n", total)         # a hot text is joined by broadcast
    keyed = both.select("doc_id", "size", "text_crc32", "text_hash", F.coalesce("first", "cell").alias("curve"))
    placed = global_position(keyed, ["curve", "text_hash", "size", "doc_id"], "pos")
    n = max(total, 1)
    shard = F.expr(f"cast(pos * {shards} div {n} as int)")
    # the first position of shard s is ceil(s * n / shards)
    first = F.expr(f"(cast(pos * {shards} div {n} as bigint) * {n} + {shards - 1}) div {shards}")
    return (placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
                    (F.col("pos") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", "text_hash"))


def write_shards(docs: DataFrame, folder: str, shards: int = 16, text: str = "text", id_col: str = "doc_id", source: str = "source",
                 lang: str = "lang", bits: int = BITS) -> None:
    """Whole rows below `folder`/rows, one folder per shard, in curve order, and the shards' bounds below `folder`/bounds.

    Rows find their place by id, size and text hash; of rows equal in all three each takes one of their places."""
    names = [free_name(docs, c) for c in ("_d", "_s", "_h", "_n", "shard", "slot")]
    d, s, h, n, shard, slot = names
    t = F.coalesce(F.col(text), F.lit(""))
    same = Window.partitionBy(d, s, h).orderBy(F.lit(0))
    wide = docs.withColumns({d: F.col(id_col), s: (F.octet_length(t) + 1).cast("bigint"), h: F.xxhash64(t)}).withColumn(n, F.row_number().over(same))
    places = shard_rows(docs, shards, text, id_col, source, lang, bits).select(
        F.col("doc_id").alias("p_d"), F.col("size").alias("p_s"), F.col("text_hash").alias("p_h"), F.col("shard").alias("p_shard"), F.col("slot").alias("p_slot"))
    places = places.withColumn("p_n", F.row_number().over(Window.partitionBy("p_d", "p_s", "p_h").orderBy("p_shard", "p_slot")))
    match = [F.col(d).eqNullSafe(F.col("p_d")), F.col(s) == F.col("p_s"), F.col(h) == F.col("p_h"), F.col(n) == F.col("p_n")]
    out = wide.join(places, match).select(*docs.columns, F.col("p_shard").alias(shard), F.col("p_slot").alias(slot), F.col(s))
    ranged = out.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot)
    ranged.drop(slot, s).write.partitionBy(shard).parquet(f"{folder}/rows")
    bounds = [F.count(F.lit(1)).alias("rows"), F.min(s).alias("min_size"), F.max(s).alias("max_size")]
    for c, k in ((source, "source"), (lang, "lang")):
        bounds += [F.min(c).alias(f"min_{k}"), F.max(c).alias(f"max_{k}"), F.count_if(F.col(c).isNull()).alias(f"null_{k}")]
    out.groupBy(F.col(shard).alias("shard")).agg(*bounds).write.parquet(f"{folder}/bounds")


def wanted_shards(spark: SparkSession, folder: str, sources: tuple | None = None, langs: tuple | None = None, sizes: tuple | None = None) -> list[int]:
    """Shards whose bounds meet a set of sources and of languages (None in a set: nulls) and a range of sizes (bytes plus 1)."""
    keep = F.lit(True)
    for values, k in ((sources, "source"), (langs, "lang")):
        if values is not None:
            hits = [F.lit(v).between(F.col(f"min_{k}"), F.col(f"max_{k}")) if v is not None else F.col(f"null_{k}") > 0 for v in values]
            keep = keep & F.coalesce(F.array_contains(F.array(*[F.coalesce(x, F.lit(False)) for x in hits]), True), F.lit(False))
    if sizes is not None:
        keep = keep & (F.col("max_size") >= sizes[0]) & (F.col("min_size") <= sizes[1])
    return sorted(r.shard for r in spark.read.parquet(f"{folder}/bounds").where(keep).select("shard").collect())   # one row per shard


def read_shards(spark: SparkSession, folder: str, shards: list[int], name: str = "shard") -> DataFrame:
    """The rows of some shards; Spark opens the folders of these only."""
    return spark.read.parquet(f"{folder}/rows").where(F.col(name).isin(shards))
