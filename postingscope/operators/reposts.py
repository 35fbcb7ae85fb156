"""WIN1: repost detection against the k most recent postings of the company.

For every incoming posting (kept after url de-duplication) the candidates
are the k most recent postings of the same company that precede it --
stored postings and earlier postings of the same batch.  The most similar
candidate by cosine (ties -> most recent) marks a repost when the
similarity reaches the threshold and the description is longer than
`min_len` characters.

Plan (no per-company task, so a company with a third of all rows is
spread over many tasks):

1. Range-partition all postings by (company, order, id), sort inside each
   partition and give every row its global position (index inside the
   partition + rows of earlier partitions, a one-row-per-partition table,
   broadcast); the sample-based range partitioner splits a hot company
   over several partitions.  The positioned rows are checkpointed so the
   numbering is stable under task retries and executor loss.
2. A company's rows are contiguous in that order, so its k preceding rows
   are those at positions [p-k, p-1] with the same company.
3. Rows are dealt in blocks of BLOCK positions; the last k rows of a block
   also go to the next one.  A block's vectors are one matrix, and each of
   the k lags is one row-wise product of it with itself: no pairs are
   written, joined or grouped.

Of the stored table only the last k postings of each company matter:
`last_k_postings` takes them, and `RecentPostings` keeps them in a bucketed
table, of which a batch reads and rewrites the buckets of its companies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingscope import lexicons as L
from postingscope.functions.text import strip_ws
from postingscope.operators.store import Store, Transaction
from postingscope.operators.windows import first_k

BLOCK = 2048        # positions whose vectors make one matrix


def long_enough(text: str = "description", min_len: int = L.MIN_DESCRIPTION) -> Column:
    """Whether a text has more than `min_len` characters between its outer whitespace."""
    return F.col(text).isNotNull() & (F.length(strip_ws(F.col(text))) > min_len)


def block_matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of one matrix of doubles; null vectors, missing and null components are 0."""
    rows = col.combine_chunks()
    flat = rows.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    sizes = np.array(rows.value_lengths().fill_null(0))
    out = np.zeros((len(rows), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def preceding_best(company: np.ndarray, position: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row (in order of position) how far back its most similar of the k preceding rows of its company lies
    (0: there is none; ties: the most recent) and that cosine; 0 where a vector is zero or not finite."""
    n = len(position)
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    best, lag_of = np.full(n, -np.inf), np.zeros(n, np.int64)
    for lag in range(1, min(k, n - 1) + 1):
        same = (company[lag:] == company[:-lag]) & (position[lag:] - position[:-lag] == lag)
        if not same.any():
            break
        dot = np.einsum("ij,ij->i", v[lag:], v[:-lag])
        scale = norm[lag:] * norm[:-lag]
        with np.errstate(invalid="ignore", divide="ignore"):
            sim = np.where(scale > 0, dot / scale, 0.0)
        sim[~np.isfinite(sim)] = 0.0
        better = np.flatnonzero(same & (sim > best[lag:])) + lag
        best[better], lag_of[better] = sim[better - lag], lag
    return lag_of, best


def mark_reposts(incoming: DataFrame, stored: DataFrame | None = None, *, k: int = L.REPOST_WINDOW,
                 threshold: float = L.SIMILARITY_THRESHOLD, min_len: int = L.MIN_DESCRIPTION,
                 order: tuple[str, ...] = ("scraped_at", "id"), emb: str = "embedding",
                 with_columns: bool = False) -> DataFrame:
    """Mark reposts among `incoming` (already url-de-duplicated).

    Returns (id, company, repost_of_id, max_similarity, status) with status
    'new' | 'repost'; `with_columns=True` joins the result back onto all
    incoming columns.  `stored` may be the full stored table or only its
    last k rows per company.  Only narrow columns (ids, order, embedding,
    an eligibility flag) travel through the range shuffle and checkpoint;
    a precomputed boolean `_eligible` column on `incoming` is used as is.
    """
    order = list(order)
    base_cols = ["id", "company", *[c for c in order if c != "id"], emb]
    ok = F.col("_eligible") if "_eligible" in incoming.columns else long_enough(min_len=min_len)
    inc = incoming.select(*base_cols, ok.alias("_ok")).withColumn("_inc", F.lit(True))
    if stored is not None:
        st = stored.select(*base_cols, F.lit(False).alias("_ok")).withColumn("_inc", F.lit(False))
        allrows = st.unionByName(inc)
    else:
        allrows = inc
    # Total order: company, then stored postings before every incoming one
    # (incoming rows are stored at ingest time), then arrival order.  A
    # company's rows are contiguous in it, so its k preceding rows are the
    # rows at positions [p-k, p-1] carrying the same company.
    from postingscope.operators.sequence import global_position
    ranked = global_position(allrows, ["company", "_inc"] + [c for c in order if c != "id"] + ["id"], "_rn")
    size = max(BLOCK, k)
    own = F.floor(F.col("_rn") / size).cast("long")
    blocks = ranked.select("id", "company", "_rn", "_inc", "_ok", F.col(emb).alias("_e"),
                           F.explode(F.when(F.col("_rn") % size >= size - k, F.array(own, own + 1)).otherwise(F.array(own))).alias("_block"))
    kinds = dict(blocks.dtypes)

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("_rn")
        position, ids = t["_rn"].to_numpy(), t["id"].combine_chunks()
        company = t["company"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        lag, best = preceding_best(company, position, block_matrix(t["_e"]), k)
        block = t["_block"][0].as_py()
        mine = t["_inc"].to_numpy() & (position // size == block)
        found = mine & (lag > 0) & t["_ok"].to_numpy()
        rows = np.flatnonzero(mine)
        hit = found & (best >= threshold)
        back = pa.array(np.where(hit, np.arange(len(ids)) - lag, 0)[rows], mask=~hit[rows])
        return pa.table({"id": ids.take(pa.array(rows)), "company": t["company"].combine_chunks().take(pa.array(rows)),
                         "repost_of_id": ids.take(back), "max_similarity": pa.array(best[rows], mask=~found[rows]),
                         "status": pa.array(np.where(hit[rows], "repost", "new"))})

    out = blocks.groupBy("_block").applyInArrow(
        compare, f"id {kinds['id']}, company {kinds['company']}, repost_of_id {kinds['id']}, max_similarity double, status string")
    if with_columns:
        src = incoming.drop("repost_of_id", "max_similarity", "status", "_eligible")
        return src.join(out.drop("company"), "id", "left")
    return out


def last_k_postings(postings: DataFrame, k: int = L.REPOST_WINDOW, order: tuple[str, ...] = ("scraped_at", "id")) -> DataFrame:
    """The last k postings of every company by `order` (the later batch's candidates)."""
    return first_k(postings, "company", [F.col(c).desc() for c in order if c != "id"], k, descending_id=True)


class RecentPostings:
    """The last k (id, vector) per company in a table of a store, in buckets by company.

    `apply` marks a batch against it, puts the batch's own last k in their place and keeps the marks, in one commit: its
    work follows the batch and the companies in it, not the stored postings.
    """

    ORDER = ("arrived", "scraped_at", "id")

    def __init__(self, store: Store, recent: str = "recent_postings", marks: str = "repost_marks",
                 k: int = L.REPOST_WINDOW, threshold: float = L.SIMILARITY_THRESHOLD, min_len: int = L.MIN_DESCRIPTION):
        self.store, self.recent, self.marks, self.k, self.threshold, self.min_len = store, recent, marks, k, threshold, min_len

    def load(self, stored: DataFrame) -> int:
        """First fill from a stored table."""
        rows = last_k_postings(stored, self.k).select("company", F.lit(-1).cast("bigint").alias("arrived"), "scraped_at", "id", "embedding")
        return self.store.transact(lambda tx: tx.replace(self.recent, rows, "company"))

    def stage(self, tx: Transaction, batch: DataFrame) -> DataFrame:
        """Mark a batch and stage the new last k of its companies; returns the marks."""
        arrived = F.lit(tx.base["version"] + 1).cast("bigint")
        rows = batch.select("company", arrived.alias("arrived"), "scraped_at", "id", "embedding",
                            ("_eligible" if "_eligible" in batch.columns else long_enough(min_len=self.min_len).alias("_eligible"))).checkpoint(eager=True)
        before = tx.read_hit(self.recent, rows, "company")
        if before is not None:
            before = before.join(rows.select("company").distinct(), "company", "left_semi").select("company", *self.ORDER, "embedding")
        marked = mark_reposts(rows, before, k=self.k, threshold=self.threshold, order=self.ORDER).checkpoint(eager=True)
        after = rows.drop("_eligible") if before is None else before.unionByName(rows.drop("_eligible"))
        tx.replace(self.recent, last_k_postings(after, self.k, self.ORDER), "company")
        return marked

    def apply(self, batch: DataFrame, epoch: tuple[str, int] | None = None) -> int:
        return self.store.transact(lambda tx: tx.upsert(self.marks, self.stage(tx, batch), "id"), epoch)
