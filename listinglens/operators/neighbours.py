"""Exact nearest neighbours that skip parts of the corpus by the triangle inequality.

Each row belongs to the cell of its nearest pivot and stands there at its
distance from the pivot. Sorted by cell and distance, the corpus is cut into
parts of bounded bytes and rows; what a part has of a cell is a unit, a ring
around the pivot. From a query's distances to the pivots follow lower bounds of its
distance to anything in a unit: from the ring's radii, and from the plane
between the cell's pivot and the query's own. A query is compared with the most
promising units first. Its k-th distance there is an upper bound, and units
that cannot beat it are never read for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listinglens.session import Scratch

#: Pivots, and the rows that they are chosen from.
PIVOTS, SAMPLE = 48, 4096
#: Bytes of the vectors of a part and its rows, and the least and the most parts.
PART_BYTES, PART_ROWS, LEAST_PARTS, MOST_PARTS = 16 << 20, 1 << 16, 8, 50_000
#: Queries that meet a unit in one group, and the distances that are held at a time.
QUERY_BLOCK, HELD = 1024, 1 << 22


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - pivots[None]) ** 2).sum(axis=2), 0)) if x.size * len(pivots) < 1 << 22 else np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


class Units:
    """The units of a corpus: cell, inner and outer radius and rows of each, with its part."""

    def __init__(self, pivots: np.ndarray, rows: pd.DataFrame):
        self.pivots = pivots
        self.part, self.cell, self.n = (rows[c].to_numpy().astype(np.int64) for c in ("part", "cell", "n"))
        self.low, self.high = (rows[c].to_numpy().astype(float) for c in ("low", "high"))

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """For each point and unit a distance that no row of the unit is nearer than; rounding is allowed for."""
        to = distances(points, self.pivots)
        own, mine = to[:, self.cell], to.min(axis=1)[:, None]
        ring = np.maximum(own - self.high, self.low - own)
        # rows of a cell are no nearer to another pivot p than to their own c: d(q, x) >= (d(q, c) - d(q, p)) / 2
        bound = np.maximum(ring, (own - mine) / 2)
        return np.maximum(bound - 1e-9 * (own + self.high), 0)

    def first(self, bounds: np.ndarray, k: int) -> list[np.ndarray]:
        """For each point its most promising units, until they have more than k rows."""
        order = np.argsort(bounds, axis=1, kind="stable")
        return [row[: int(np.searchsorted(np.cumsum(self.n[row]), k + 1)) + 1] for row in order]


def _cells(column: str, pivots: np.ndarray):
    @F.pandas_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())]))
    def place(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": np.zeros(0, np.int32), "r": np.zeros(0)})
        to = distances(np.stack(vectors.to_numpy()).astype(float), pivots)
        return pd.DataFrame({"cell": to.argmin(axis=1).astype(np.int32), "r": to.min(axis=1)})

    return place(F.col(column))


def _asked(units: Units, k: int, again: bool):
    """mapInPandas' function: rows (query, _q, part, cell, n) of the units that a query has to meet.

    At first those that are most promising; again, with a column `reach`, the
    others that may hold something within it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.iloc[at : at + 256].reset_index(drop=True)
                bounds = units.bounds(np.stack(rows["_q"].to_numpy()).astype(float))
                chosen = units.first(bounds, k)
                if again:
                    chosen = [np.setdiff1d(np.flatnonzero(b <= r), c) for b, r, c in zip(bounds, rows["reach"].to_numpy(), chosen, strict=True)]
                row, unit = np.repeat(np.arange(len(rows)), [len(c) for c in chosen]), np.concatenate([np.zeros(0, np.int64), *chosen]).astype(np.int64)
                yield pd.DataFrame({"query": rows["query"].to_numpy()[row], "_q": rows["_q"].to_numpy()[row], "part": units.part[unit], "cell": units.cell[unit], "n": units.n[unit]})

    return run


def _nearest(k: int):
    """A cogroup's function: the k nearest rows of a unit for each query that meets it."""

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": left["query"].iloc[:0], "found": right["found"].iloc[:0], "distance": np.zeros(0)})
        points, x = np.stack(left["_q"].to_numpy()).astype(float), np.stack(right["_v"].to_numpy()).astype(float)
        asked, own = left["query"].to_numpy(), right["found"].to_numpy()
        order = np.empty(len(own), np.int64)
        order[np.argsort(own, kind="stable")] = np.arange(len(own))  # ties fall to the smaller key, whatever its type
        square, rows, found, far = (x * x).sum(axis=1), [], [], []
        step = max(1, min(64, HELD // len(x)))
        for at in range(0, len(points), step):
            part = points[at : at + step]
            rough = square[None, :] - 2 * part @ x.T + (part * part).sum(axis=1)[:, None]  # one product, then exact distances of the nearest
            slack = 1e-9 * (square.max() + (part * part).sum(axis=1))
            for i, row in enumerate(rough):
                row[own == asked[at + i]] = np.inf
                limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                some = np.flatnonzero((row <= limit + slack[i]) & np.isfinite(row))
                d = np.sqrt(((x[some] - part[i]) ** 2).sum(axis=1))
                top = np.lexsort((order[some], d))[:k]
                rows += [at + i] * len(top)
                found.append(some[top])
                far.append(d[top])
        return pd.DataFrame({"query": asked[np.array(rows, np.int64)], "found": own[np.concatenate(found)], "distance": np.concatenate(far)})

    return nearest


def _met(asked: DataFrame, corpus: DataFrame, k: int, kinds: str) -> DataFrame:
    """Rows (query, found, distance): asked queries meet their units; a unit that many ask for meets them in blocks."""
    unit = ["part", "cell"]
    blocks = asked.groupBy(*unit).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    left = asked.join(F.broadcast(blocks), unit).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))  # a row for each unit at most
    right = corpus.join(F.broadcast(blocks), unit).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*unit, "block"]
    left, right = left.select(*key, "query", "_q"), right.select(*key, "found", "_v")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_nearest(k), kinds)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """Rows (query, <key>, distance, rank, compared): the k nearest corpus rows of each query, itself left out, exact.

    Keys are of any type that has an order; ties in distance fall to the
    smaller key. Rows with a null key or vector take no part. compared counts
    the corpus rows that a query met.
    """
    spark, scratch = queries.sparkSession, Scratch(queries.sparkSession)
    kind = corpus.schema[key].dataType.simpleString()
    there = F.col(key).isNotNull() & F.col(vector).isNotNull()
    rows = scratch.stage(corpus.where(there).select(F.col(key).alias("found"), F.col(vector).cast("array<double>").alias("_v")), "corpus")
    asked = queries.where(there).select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("_q"))
    n, low, high = rows.agg(F.count("*"), F.min(F.size("_v")), F.max(F.size("_v"))).first()
    if n == 0:
        return asked.where("false").select("query", F.col("query").alias(key), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("compared"))
    if low != high:
        raise ValueError(f"{vector} has vectors of {low} to {high} values")
    sample = rows.orderBy(F.xxhash64("_v")).select("_v").limit(SAMPLE).toPandas()["_v"]
    pivots = choose_pivots(np.stack(sample.to_numpy()), PIVOTS)
    parts = min(MOST_PARTS, max(LEAST_PARTS, -(-n * low * 8 // PART_BYTES), -(-n // PART_ROWS)))  # short vectors are many rows in few bytes
    placed = rows.withColumn("_at", _cells("_v", pivots)).select("found", "_v", "_at.cell", "_at.r")
    placed = scratch.stage(placed.repartitionByRange(parts, "cell", "r", F.xxhash64("found")).withColumn("part", F.spark_partition_id()), "neighbour-parts")
    unit = placed.groupBy("part", "cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n"))
    units = Units(pivots, unit.orderBy("part", "cell").toPandas())  # MOST_PARTS and PIVOTS rows at most
    kinds, met = f"query {kind}, found {kind}, distance double", f"query {kind}, _q array<double>, part int, cell int, n long"
    first = scratch.stage(asked.mapInPandas(_asked(units, k, False), met), "neighbour-first")
    near = scratch.stage(_met(first, placed, k, kinds), "neighbour-near")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "found"))
    reach = near.withColumn("rank", rank).where(F.col("rank") == k).select("query", F.col("distance").alias("reach"))
    wider = asked.join(reach, "query", "left").fillna(float("inf"), ["reach"])
    more = scratch.stage(wider.mapInPandas(_asked(units, k, True), met), "neighbour-more")
    every = near.unionByName(_met(more, placed, k, kinds)).withColumn("rank", rank).where(F.col("rank") <= k)
    work = first.select("query", "n").unionByName(more.select("query", "n")).groupBy("query").agg(F.sum("n").alias("compared"))
    return scratch.result(every.join(work, "query").select("query", F.col("found").alias(key), "distance", "rank", "compared"), "neighbours")
