"""Places of rows in an order over all partitions, and keyed permutations of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglens.session import Scratch


def global_rank(df: DataFrame, order: Sequence[str], name: str, scratch: Scratch) -> DataFrame:
    """Staged df with `name`, each row's place from 0 in the given order; no task sorts more than its part.

    The order has to tell all rows apart, or rows alike in it are interchangeable.
    """
    parts = scratch.stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rank-parts")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = parts.withColumn("_inside", inside).join(F.broadcast(starts), "_part")
    return scratch.stage(placed.withColumn(name, F.col("_start") + F.col("_inside")).drop("_part", "_inside", "_start"), "ranked")


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def permuted(places: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed bijection of 0 .. n - 1: a Feistel network over the next power of four, walked until it is back inside."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = places.astype(np.uint64)
    out, open_ = np.zeros(len(x), np.uint64), np.arange(len(x))
    while len(open_):
        left, right = x >> shift, x & mask
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right, key * 1_000_003 + r) & mask)
        x = (left << shift) | right
        inside = x < n
        out[open_[inside]] = x[inside]
        x, open_ = x[~inside], open_[~inside]
    return out.astype(np.int64)
