"""Connected components as alternating star joins, for groups of copies of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.session import discard, settle

#: Keys at most that are broadcast as too frequent for one task, and rows from which a key may be one.
HOT_KEYS, HOT_ROWS = 4096, 256


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined with a written table of one row for each key, which says how many rows the key has.

    Keys with more than their share, of which there can be no more than HOT_KEYS, are
    broadcast, so their rows stay where they lie; all others are dealt by key.
    """
    total, largest = table.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if largest <= limit:
        return rows.join(table.drop(weight), key)
    hot, rest = table.where(F.col(weight) > limit).drop(weight), table.where(F.col(weight) <= limit).drop(weight)
    apart = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(apart.join(rest, key))


def _with_least(edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Edges with the smallest neighbour ``m`` of u, and the table of that; a node with very many links is no single task's."""
    least = settle(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")), f"{label}-least")
    return spread_join(edges, least, "u", "links"), least


def _large_star(edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours move to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved, least = _with_least(both, label)
    return moved.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v").distinct(), least


def _small_star(edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours move to the smallest of them; every edge has u > v."""
    moved, least = _with_least(edges, label)
    there = least.select("u", F.col("m").alias("v"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(there).distinct(), least


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v) with the smallest node v reachable from each u that isn't itself smallest.

    ``edges`` are pairs of longs in any direction; repeats and self-links are ignored. Each
    round is joins and minimums of a node's links, never a list of a group's members, and
    its result is written to the shared folder. The number of rounds grows with the
    logarithm of the longest chain.
    """
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), label)
    seen = None
    while True:
        large, one = _large_star(now, label)
        large = settle(large, label)
        small, two = _small_star(large, label)
        small = settle(small, label)
        discard(now, one, large, two)
        now = small
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now
        seen = tuple(state)
