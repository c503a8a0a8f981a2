"""Operator 4, exact top-k search by distributed histogram selection.

Queries come in blocks of bounded size and one vector length. For a block every candidate is
scored, and global score histograms are refined round by round until each query's k-th score is
known exactly: a round splits the range that holds it into equal bins, counts the scores of all
queries in one pass of array operations, and keeps the bin in which the count from above reaches
k. A last pass keeps what lies above that score and, of what equals it, the smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import U64, table
from pagequarry.session import settle

#: Counters of a block's histogram, shared by its queries, and scores that are held at once.
COUNTERS, SCORES = 1 << 20, 1 << 22
#: Queries of a block, and components of its vectors that are broadcast (8 bytes each).
BLOCK_QUERIES, BLOCK_VALUES = 4096, 1 << 20
SCALE = 1024
SIGN = U64(1 << 63)
LONG = np.iinfo(np.int64)


def quantized(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): components floored after scaling, as longs; vectors that are null, empty of an id, or hold null or non-finite components are left out."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long"))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("v"))


def size_class(vectors: np.ndarray) -> np.ndarray:
    """0 where products with each other are exact in doubles, 1 where they are in longs, 2 beyond."""
    largest = np.abs(vectors.astype(np.float64)).max(axis=1, initial=0.0)
    width = max(1, vectors.shape[1])
    return (largest**2 * width >= 2.0**53).astype(np.int64) + (largest**2 * width >= 2.0**62)


class Block:
    """Query vectors of one length, and exact integer inner products with candidates."""

    def __init__(self, ids: list[int], rows: list[list[int]]):
        self.ids = np.array(ids, dtype=np.int64)
        self.vectors = np.array(rows, dtype=np.int64).reshape(len(rows), -1)
        self.classes = size_class(self.vectors)

    def scores(self, candidates: np.ndarray) -> np.ndarray:
        """One row for each query; products are exact, and what no long can hold becomes the largest or smallest long."""
        classes = size_class(candidates)
        out = np.empty((len(self.ids), len(candidates)), dtype=np.int64)
        for a in np.unique(self.classes):
            for b in np.unique(classes):
                q, c = np.flatnonzero(self.classes == a), np.flatnonzero(classes == b)
                out[np.ix_(q, c)] = products(self.vectors[q], candidates[c], max(a, b))
        return out


def products(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    if size == 0:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if size == 1:
        return left @ right.T
    exact = left.astype(object) @ right.T.astype(object)
    return np.clip(exact, int(LONG.min), int(LONG.max)).astype(np.int64)


def parts(batches, block: Block):
    """(candidate ids, scores, whether a score counts) for a few candidates at a time: of the queries' length, not the query itself."""
    width = block.vectors.shape[1]
    step = max(1, SCORES // max(1, len(block.ids)))
    for batch in batches:
        ids = np.asarray(batch.column("vec_id"))
        lists = batch.column("v")
        size = np.asarray(lists.value_lengths())
        flat, first = np.asarray(lists.values), np.asarray(lists.offsets)[:-1]
        fit = np.flatnonzero(size == width)
        for lo in range(0, len(fit), step):
            at = fit[lo : lo + step]
            candidates = flat[first[at][:, None] + np.arange(width)[None, :]] if width else np.zeros((len(at), 0), np.int64)
            yield ids[at], block.scores(candidates), ids[at][None, :] != block.ids[:, None]


def in_order(scores: np.ndarray) -> np.ndarray:
    """Scores as numbers without a sign, in the same order."""
    return scores.view(U64) ^ SIGN


def counts_by_bin(block: Block, low: np.ndarray, step: int, bins: int, k: int):
    """Counts of scores by bin (low + i * step; the last bin has all above); of each partition only bins down to its own k-th score, below which the k-th of all cannot lie."""

    def run(batches):
        n = len(block.ids)
        held = np.zeros(n * (bins + 1), dtype=np.int64)
        for _, scores, counts in parts(batches, block):
            key = in_order(scores)
            query, at = np.nonzero(counts & (key >= low[:, None]))
            if len(query):
                place = np.minimum((key[query, at] - low[query]) // U64(step), U64(bins)).astype(np.int64)
                held += np.bincount(query * (bins + 1) + place, minlength=len(held))
        held = held.reshape(n, bins + 1)
        above = np.cumsum(held[:, ::-1], axis=1)[:, ::-1] - held
        query, place = np.nonzero((held > 0) & (above < k))
        arrays = [pa.array(x.astype(np.int64)) for x in (query, place, held[query, place])]
        yield pa.RecordBatch.from_arrays(arrays, names=["query", "bin", "n"])

    return run


def kth_scores(candidates: DataFrame, block: Block, k: int) -> np.ndarray:
    """Each query's k-th best score, or the least score if it has fewer candidates. The driver gets one bin for each query of the block and round."""
    n = len(block.ids)
    span = sum(abs(int(x)) for x in max(block.vectors.tolist(), key=lambda v: sum(map(abs, v)), default=[]))
    most, least = candidates.agg(F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    bound = min(span * max(abs(most or 0), abs(least or 0)) + 1, int(LONG.max))
    low = np.full(n, in_order(np.array([-bound]))[0], dtype=U64)
    if bound == LONG.max:
        low[:] = 0
    width = min(2 * bound + 2, 1 << 64)
    bins = max(16, COUNTERS // max(1, n))
    while width > 1:
        step = -(-width // bins)
        counted = candidates.mapInArrow(counts_by_bin(block, low, step, bins, k), "query long, bin long, n long")
        # of each query, the bin in which the running count from the top reaches k
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        summed = counted.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        running = summed.withColumn("above", F.sum("n").over(down) - F.col("n"))
        for row in running.where(F.col("above") < k).groupBy("query").agg(F.min("bin").alias("bin")).collect():
            low[row["query"]] += U64(row["bin"] * step)
        width = step
    return (low ^ SIGN).view(np.int64)


def best(block: Block, floor: np.ndarray, k: int):
    """Of one partition, each query's scores from its k-th on: those above it, and the smallest ids of those that equal it."""

    def first(query, score, vec):
        by = np.lexsort((vec, ~score, query))
        query, score, vec = query[by], score[by], vec[by]
        start = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - start < k
        return query[keep], score[keep], vec[keep]

    def run(batches):
        held = [np.empty(0, np.int64)] * 3
        new: list[tuple] = []
        for ids, scores, counts in parts(batches, block):
            query, at = np.nonzero((scores >= floor[:, None]) & counts)
            new.append((query, scores[query, at], ids[at]))
            if sum(len(x[0]) for x in new) > SCORES:
                held, new = first(*(np.concatenate(x) for x in zip(held, *new, strict=True))), []
        query, score, vec = first(*(np.concatenate(x) for x in zip(held, *new, strict=True)))
        arrays = [pa.array(x.astype(np.int64)) for x in (block.ids[query], vec, score)]
        yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return run


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    block_values: int = BLOCK_VALUES
) -> DataFrame:
    """Each query's ``k`` candidates of highest integer inner product, but for its own id: (query_id, rank, vec_id, score).

    Components become floor(1024 * x), and where that is beyond a long the largest or
    smallest one; a score beyond a long likewise. Ties go to the smaller vec_id; all
    candidates, if there are fewer than k. Vectors that are null or hold null or non-finite components, and
    rows without an id, take no part; vectors of different lengths are not compared. Query
    ids that repeat are one query, of the vector that comes first in order; candidates that
    repeat count as often as they occur. Empty tables give no rows. Other columns are not read.
    """
    wanted = quantized(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    pool = settle(quantized(candidates, id_col, vector_col), "topk-candidates")
    found = None
    for block in blocks(wanted, block_values):
        floor = kth_scores(pool, block, k)
        part = settle(pool.mapInArrow(best(block, floor, k), "query_id long, vec_id long, score long"), "topk-block")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = pool.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def blocks(wanted: DataFrame, block_values: int):
    """Query vectors in blocks of one length, each of at most ``block_values`` components (one vector at least); the driver holds one block."""
    ids: list[int] = []
    rows: list[list[int]] = []
    for row in wanted.orderBy(F.size("v"), "vec_id").toLocalIterator():
        if ids and (len(row["v"]) != len(rows[0]) or len(ids) >= BLOCK_QUERIES or (len(ids) + 1) * len(row["v"]) > block_values):
            yield Block(ids, rows)
            ids, rows = [], []
        ids.append(row["vec_id"])
        rows.append(row["v"])
    if ids:
        yield Block(ids, rows)


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best of all other rows for each row whose id is divisible by 100; see top_k()."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM flat q JOIN flat c ON q.i = c.i WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 10
"""
