"""Joins, set operations, deduplication, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_last(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order; ties fall to the greatest row."""
    return _one(df, key, [F.desc(c) for c in order])


def dedup_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return _one(df, key, [F.asc(c) for c in order])


def _one(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.select(F.struct("*").alias("row"), rank.alias("rank")).where("rank = 1").select("row.*")


def cap_per_group(df: DataFrame, key: str, order: str, k: int, readable: Column | None = None) -> DataFrame:
    """The first k readable rows of each key with their 1-based rank."""
    rows = df if readable is None else df.where(readable)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rank") <= k)


def with_order_index(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("order_index", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def join_vectors(listings: DataFrame, vectors: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Inner join with the first vector row of each key."""
    return listings.join(dedup_first(vectors, key, order), key)


def keep_known(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def pending(queue: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    return queue.join(visited, key, "left_anti")


def lookup_strict(df: DataFrame, store: DataFrame, key: str, value: str) -> DataFrame:
    """df with the stored value; a key without one fails the job when the value is read."""
    joined = df.join(store.select(key, value), key, "left")
    message = F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string"))
    return joined.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(F.raise_error(message)))


def with_child_stats(parent: DataFrame, child: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """parent with aggregates of its children, made before the join."""
    return parent.join(child.groupBy(key).agg(*[a.alias(n) for n, a in aggregates.items()]), key, "left")


def align_predictions(base: DataFrame, predictions: Mapping[str, DataFrame], key: str, column: str = "prediction") -> DataFrame:
    """The predictions of several models side by side, joined by key."""
    return reduce(lambda df, kv: df.join(kv[1].select(key, F.col(column).alias(kv[0])), key), predictions.items(), base)


def with_density(df: DataFrame, counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """df with the count of its key in a dimension table, zero if it is not there."""
    return df.join(counts.select(key, n), key, "left").fillna(0, [n])


def complete_domain(definitions: DataFrame, counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    return definitions.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def relationship(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of both, shared ones, coverage in per cent, rows per key and the kind of relation."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))

    both = side(a, "na").join(side(b, "nb"), key, "full")
    one = both.agg(
        F.count("na").alias("keys_a"),
        F.count("nb").alias("keys_b"),
        F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("shared"),
        (F.sum("na") / F.count("na")).alias("per_a"),
        (F.sum("nb") / F.count("nb")).alias("per_b"),
    )
    many_a, many_b = F.col("per_a") > 1.05, F.col("per_b") > 1.05
    kind = F.when(many_a & many_b, "N:M").when(many_a, "N:1").when(many_b, "1:N").otherwise("1:1")
    share = lambda n: F.round(100 * F.try_divide(F.col("shared").cast("double"), F.col(n).cast("double")), 4)
    return one.select("keys_a", "keys_b", "shared", share("keys_a").alias("coverage_a"), share("keys_b").alias("coverage_b"), kind.alias("kind"))


def complete_keys(df: DataFrame, key: str, column: str, values: Sequence) -> DataFrame:
    """Rows whose key has every one of the values."""
    whole = df.where(F.col(column).isin(*values)).groupBy(key).agg(F.count_distinct(column).alias("n")).where(F.col("n") == len(set(values)))
    return df.join(whole.select(key), key, "left_semi")


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def all_ids(frames: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.union, [f.select(key).where(F.col(key).isNotNull()) for f in frames]).distinct()


def missing_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def shared_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


#: Hex bounds of an eight-digit hash: 70 and 85 per cent.
SPLIT = ("b3333333", "d9999999")


def split_label(key: Column, seed: int = 42) -> Column:
    """train, validation or test by a hash of the key: the same in any order and on any cluster."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return F.when(h < SPLIT[0], "train").when(h < SPLIT[1], "validation").otherwise("test")
