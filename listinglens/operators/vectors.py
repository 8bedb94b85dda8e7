"""Vector columns: checks, normalisation, pooling, nearest concepts and neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglens.operators.neighbours import nearest

#: Least norm that a vector is divided by.
LEAST_NORM = 1e-12


def require_vector_dim(df: DataFrame, column: str) -> int:
    """The common length of all vectors; a ValueError if they differ."""
    low, high = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"{column} has vectors of {low} to {high} values")
    return low


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(c: Column) -> Column:
    return F.sqrt(_dot(c, c))


def l2_normalize(c: Column) -> Column:
    """c over its norm, or over LEAST_NORM if that is smaller."""
    return F.transform(c, lambda x: x.cast("double") / F.greatest(norm(c), F.lit(LEAST_NORM)))


def expand_vector(df: DataFrame, column: str, prefix: str, n: int) -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], *[F.get(column, i).alias(f"{prefix}_{i}") for i in range(n)])


def assemble_vector(df: DataFrame, prefix: str, n: int, column: str) -> DataFrame:
    names = [f"{prefix}_{i}" for i in range(n)]
    return df.withColumn(column, F.array(*names)).drop(*names)


def pool_vectors(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Element-wise mean and max of each key. Sums meet in partial aggregates, so a large key is no large task."""
    items = df.select(*key, F.posexplode(column).alias("pos", "x"))
    by_place = items.groupBy(*key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.max(F.col("x").cast("double")).alias("max"))
    rows = by_place.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "max"))).alias("r"))
    return rows.select(*key, F.transform("r", lambda x: x["mean"]).alias("mean"), F.transform("r", lambda x: x["max"]).alias("max"))


def meanmax(pooled: DataFrame) -> DataFrame:
    """pooled with `meanmax`: both normalised vectors one after the other, normalised again."""
    both = F.concat(l2_normalize(F.col("mean")), l2_normalize(F.col("max")))
    return pooled.withColumn("_both", both).withColumn("meanmax", l2_normalize(F.col("_both"))).drop("_both")


def rank_for_caps(df: DataFrame, key: str, order: str, caps: Sequence[int]) -> DataFrame:
    """A row for each item and cap that admits it: the item is ranked once within its key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    admits = F.array(*[F.lit(c) for c in sorted(set(caps))])
    ranked = df.select(F.struct("*").alias("row"), rank.alias("rank")).where(F.col("rank") <= max(caps))
    ranked = ranked.select("row", F.explode(F.filter(admits, lambda c: c >= F.col("rank"))).alias("cap"))
    return ranked.select("row.*", "cap")


def cap_stats(ranked: DataFrame, key: str) -> DataFrame:
    """Keys, items and mean items of each cap."""
    used = ranked.groupBy("cap", key).agg(F.count("*").alias("used"))
    return used.groupBy("cap").agg(F.count("*").alias("keys"), F.sum("used").alias("items"), F.round(F.avg("used"), 4).alias("mean_items"))


def nearest_concept(df: DataFrame, bank: DataFrame, column: str) -> DataFrame:
    """df with the label of the bank vector of greatest dot product; the bank (label, vector) is a small fixed list."""
    words = bank.agg(F.collect_list(F.struct("label", "vector")).alias("bank"))
    scored = F.transform("bank", lambda b: F.struct(_dot(F.col(column), b["vector"]).alias("score"), b["label"].alias("label")))
    best = F.array_max(scored)
    return df.crossJoin(F.broadcast(words)).withColumn("best", best).drop("bank")  # one row that holds the bank


def encode(c: Column, load: Callable[[], Callable[[list], Sequence[Sequence[float]]]], rows: int = 64) -> Column:
    """The vector that an encoder gives each value, null for null.

    load makes the encoder once for each task; it takes a list of at most
    `rows` values and gives as many vectors.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for batch in batches:
            given, found = batch.dropna(), []
            for at in range(0, len(given), rows):
                found += [list(map(float, v)) for v in encoder(given.iloc[at : at + rows].tolist())]
            yield pd.Series(found, index=given.index, dtype=object).reindex(batch.index).where(batch.notna(), None)

    return run(c)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)


def knn(queries: DataFrame, corpus: DataFrame, k: int, key: str, vector: str, block: Sequence[str] = ()) -> DataFrame:
    """Rows (query, key, distance, rank): the k nearest corpus rows of each query, itself left out, exact.

    With block columns only rows that agree in them are compared, in one
    equi-join; without, parts of the corpus are skipped where their distance
    from a query shows that they hold none of its neighbours.
    """
    if not block:
        return nearest(queries, corpus, k, key, vector).drop("compared")
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("_q"), *block).where(F.col(vector).isNotNull())
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    pairs = q.join(corpus.select(key, vector, *block), list(block)).where(F.col("query") != F.col(key))
    scored = pairs.select("query", key, F.sqrt(squared_distance(F.col("_q"), F.col(vector))).alias("distance"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
