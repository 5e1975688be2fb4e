"""Exact top-k search by distributed histogram selection.

Queries are handled in blocks of bounded size, given to the tasks as one
matrix.  Each pass scores every row again; per query a task counts its scores
in the bins of the current range, from the top down to its own k-th score, and
Spark adds the counts up.  The bin that holds the k-th score is the next range,
until a bin is one score wide.  The last pass keeps scores from the k-th up;
of ties at the k-th a task hands on only its k smallest ids, so a vector that a
third of all rows repeat costs no more than any other.

Components are floor(256 * x); scores are exact whole numbers.  Defined
results: vectors that are null, or hold a null or non-finite component, and
rows without an id take no part; vectors of different lengths do not meet;
a query id that stands on several rows asks with its smallest vector, once, and
meets none of those rows.  Scores beyond 64 bits are held at the limits.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

BINS = 1024
ROWS = 2048


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


class Block:
    """The queries of a block, by length of vector, and the scores of a batch against them."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        by_length = defaultdict(list)
        for vec_id, v in sorted(rows):
            by_length[len(v)].append((vec_id, np.floor(256.0 * np.array(v, float))))
        self.ids = {n: np.array([r[0] for r in own], np.int64) for n, own in by_length.items()}
        self.matrix = {n: np.array([r[1] for r in own]).reshape(len(own), n) for n, own in by_length.items()}

    def scores(self, batch: pa.RecordBatch):
        """(length, row ids, scores by query and row, which of them count) for parts of a batch."""
        lists = batch.column("v")
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id").to_numpy()
        for n, queries in self.ids.items():
            at = np.flatnonzero(lengths == n)
            for start in range(0, len(at), ROWS):
                part = at[start:start + ROWS]
                rows = np.floor(256.0 * lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), n))
                own = ids[part]
                yield n, own, _products(self.matrix[n], rows), queries[:, None] != own[None, :]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    limit = (1 << 63) - 1
    return np.vectorize(lambda x: max(-limit, min(limit, x)), otypes=[np.int64])(whole(a) @ whole(b).T)


def _ends(block: Block):
    def run(batches):
        for batch in batches:
            for n, _, s, counts in block.scores(batch):
                has = counts.any(1)
                big = np.iinfo(np.int64).max
                low, high = np.where(counts, s, big).min(1), np.where(counts, s, -big).max(1)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(block.ids[n][has]), "low": pa.array(low[has]), "high": pa.array(high[has]), "n": pa.array(counts.sum(1)[has])})
    return run


def _histogram(block: Block, ranges: dict[int, tuple[int, int, int, int]], k: int):
    """Counts per bin within each query's range (low, width, rank, last), bins a task cannot need left out."""
    def run(batches):
        for batch in batches:
            for n, _, s, counts in block.scores(batch):
                queries = block.ids[n]
                low = np.array([ranges[q][0] if q in ranges else 0 for q in queries.tolist()], np.int64)
                width = np.array([ranges[q][1] if q in ranges else 0 for q in queries.tolist()], np.int64)
                last = np.array([ranges[q][3] if q in ranges else -1 for q in queries.tolist()], np.int64)
                ok = counts & (width[:, None] > 0) & (s >= low[:, None]) & (s <= last[:, None])
                bins = np.where(ok, (s - low[:, None]) // np.maximum(width, 1)[:, None], BINS)
                q, at = np.nonzero(bins < BINS)
                table = np.bincount(q * BINS + bins[q, at], minlength=len(queries) * BINS).reshape(-1, BINS)
                above = table[:, ::-1].cumsum(1)[:, ::-1] - table  # scores in higher bins
                q, b = np.nonzero((table > 0) & (above < k))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(queries[q]), "bin": pa.array(b.astype(np.int64)), "n": pa.array(table[q, b])})
    return run


def _best(block: Block, least: dict[int, int], k: int):
    def run(batches):
        for batch in batches:
            for n, ids, s, counts in block.scores(batch):
                queries = block.ids[n]
                floor = np.array([least.get(q, np.iinfo(np.int64).max) for q in queries.tolist()], np.int64)
                q, at = np.nonzero(counts & (s >= floor[:, None]))
                order = np.lexsort((ids[at], -s[q, at], q))
                q, at = q[order], at[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, at = q[place < k], at[place < k]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(queries[q]), "vec_id": pa.array(ids[at]), "score": pa.array(s[q, at])})
    return run


def _search(rows: DataFrame, block: Block, k: int) -> DataFrame:
    ends = (rows.mapInArrow(_ends(block), "query_id long, low long, high long, n long").groupBy("query_id")
            .agg(F.min("low"), F.max("high"), F.sum("n")).collect())
    least = {r[0]: r[1] for r in ends if r[3] <= k}
    # The score wanted is the (rank)-th highest of those from low to high.
    open_ = {r[0]: (r[1], -(-(r[2] - r[1] + 1) // BINS), k, r[2]) for r in ends if r[3] > k}
    while open_:
        counts = rows.mapInArrow(_histogram(block, open_, k), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.col("bin").desc())
        want = F.lit(k)
        if any(r[2] != k for r in open_.values()):
            ranks = rows.sparkSession.createDataFrame([(q, r[2]) for q, r in open_.items()], "query_id long, want long")
            counts, want = counts.join(F.broadcast(ranks), "query_id"), F.col("want")
        hit = (counts.withColumn("upto", F.sum("n").over(down)).where((F.col("upto") >= want) & (F.col("upto") - F.col("n") < want))
               .select("query_id", "bin", (F.col("upto") - F.col("n")).alias("above")).collect())
        following = {}
        for q, b, above in hit:
            low, width, rank, last = open_[q]
            if width == 1:
                least[q] = low + b
            else:
                following[q] = (low + b * width, -(-width // BINS), rank - above, min(last, low + (b + 1) * width - 1))
        open_ = following
    return rows.mapInArrow(_best(block, least, k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row that ``is_query`` (over vec_id) marks."""
    rows = _usable(vectors, vec_id, vector)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // block))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = None
    for n in range(blocks):
        own = _search(rows, Block([(r[0], r[1]) for r in queries.where(part == n).collect()]), k)
        found = own if found is None else found.unionByName(own)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
