"""Exact quantiles of many columns and groups by distributed selection.

An exact percentile aggregate keeps every distinct value of a group in one
buffer. Here a mergeable sketch gives each wanted rank a narrow range of
values that certainly holds it; one pass counts what lies below the range and
how often each value inside it occurs; and a cumulated sum over these counts
finds the value at the rank. The counts are sorted over all partitions if they
are many, so no task holds more than its part of a range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglens.session import Scratch

#: A sketch's ranks are right to one in ACCURACY rows; a range reaches MARGIN times that to either side.
ACCURACY, MARGIN = 10_000, 3
#: Groups of up to so many rows have one range for all ranks.
SMALL = 100_000
#: Counted values of one rank that one task sorts.
SORTED = 1_000_000
#: Groups whose ranges are broadcast.
BROADCAST = 10_000

KEYS = ("g", "field")


def _cells(df: DataFrame, columns: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """Rows (g, field, v): a row for each cell; NaN counts as null."""
    g = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.lit(0)
    cells = [F.struct(F.lit(n).alias("field"), F.nanvl(c.cast("double"), F.lit(None)).alias("v")) for n, c in columns.items()]
    return df.select(g.alias("g"), F.explode(F.array(*cells)).alias("c")).select("g", "c.field", "c.v")


def _ranges(cells: DataFrame, ps: Sequence[float]) -> DataFrame:
    """Rows (g, field, n, low, high, missing, ranges): for each probability its ranks and the range that holds them."""
    slack = MARGIN / ACCURACY
    sides = [min(1.0, max(0.0, p + d)) for p in ps for d in (-slack, slack)]
    sketch = F.percentile_approx("v", F.array(*map(F.lit, sides)), ACCURACY)
    facts = cells.groupBy(*KEYS).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("missing"), sketch.alias("s"))
    ranges = []
    for j, p in enumerate(ps):
        at = (F.col("n") - 1) * F.lit(float(p))
        whole = F.col("n") <= SMALL
        a = F.when(whole | F.lit(sides[2 * j] <= 0), F.col("low")).otherwise(F.get("s", 2 * j))
        b = F.when(whole | F.lit(sides[2 * j + 1] >= 1), F.col("high")).otherwise(F.get("s", 2 * j + 1))
        ranges.append(F.struct(F.lit(j).alias("j"), at.alias("at"), F.floor(at).alias("r0"), F.ceil(at).alias("r1"), a.alias("a"), b.alias("b")))
    return facts.withColumn("ranges", F.array(*ranges)).drop("s")


def _counted(cells: DataFrame, ranges: DataFrame, few: bool) -> DataFrame:
    """Rows (g, field, j, v, w): how often each value of a range occurs, and at a null value how many cells lie below it."""
    known = ranges.select(*KEYS, "ranges")
    met = cells.where("v is not null").join(F.broadcast(known) if few else known, list(KEYS))
    told = F.filter("ranges", lambda r: F.col("v") <= r["b"])
    told = F.transform(told, lambda r: F.struct(r["j"].alias("j"), F.when(F.col("v") >= r["a"], F.col("v")).alias("v")))
    return met.select(*KEYS, F.explode(told).alias("x")).groupBy(*KEYS, F.col("x.j").alias("j"), F.col("x.v").alias("v")).agg(F.count("*").alias("w"))


def _reached(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (g, field, j, v, upto): the cells up to each value of a range, those below the range included."""
    keys = [*KEYS, "j"]
    inside, below = counted.where("v is not null"), counted.where("v is null").select(*keys, F.col("w").alias("below"))
    most = inside.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= SORTED:
        upto = F.sum("w").over(Window.partitionBy(*keys).orderBy("v"))
        return inside.withColumn("upto", upto).join(below, keys, "left").select(*keys, "v", (F.col("upto") + F.coalesce("below", F.lit(0))).alias("upto"))
    parts = scratch.stage(inside.repartitionByRange(*keys, "v").withColumn("part", F.spark_partition_id()), "quantile-parts")
    sums = parts.groupBy(*keys, "part").agg(F.sum("w").alias("w"))
    earlier = F.sum("w").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = sums.select(*keys, "part", F.coalesce(earlier, F.lit(0)).alias("start")).join(below, keys, "left")
    upto = F.sum("w").over(Window.partitionBy(*keys, "part").orderBy("v"))
    placed = parts.withColumn("upto", upto).join(starts, [*keys, "part"])
    return placed.select(*keys, "v", (F.col("upto") + F.col("start") + F.coalesce("below", F.lit(0))).alias("upto"))


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (*by, field, n, low, high, missing, quantiles) for each group and column; quantiles between two values are interpolated.

    n counts the values, missing the nulls and NaNs; a group without values has
    null quantiles. A null is a group too. Infinite values are values.
    """
    if not isinstance(columns, Mapping):
        columns = {c: F.col(f"`{c}`") for c in columns}
    cells, keys, scratch = _cells(df, columns, by), [*KEYS, "j"], Scratch(df.sparkSession)
    ranges = _ranges(cells, probabilities)
    if not by:  # a row for each column even of no rows
        every = df.sparkSession.range(1).select(F.lit(0).alias("g"), F.explode(F.array(*map(F.lit, columns))).alias("field"))
        ranges = every.join(ranges, list(KEYS), "left").fillna(0, ["n", "missing"])
    ranges = scratch.stage(ranges, "quantile-ranges")
    few = ranges.count() <= BROADCAST
    counted = scratch.stage(_counted(cells, ranges, few), "quantile-counts")
    asked = ranges.select(*KEYS, F.explode("ranges").alias("r")).select(*KEYS, "r.j", "r.at", "r.r0", "r.r1")
    met = _reached(counted, scratch).join(F.broadcast(asked) if few else asked, keys)
    ends = met.groupBy(*keys, "at", "r0").agg(*[F.min(F.when(F.col("upto") > F.col(r), F.col("v"))).alias(v) for r, v in (("r0", "v0"), ("r1", "v1"))])
    share = F.col("at") - F.col("r0")
    value = F.when((share == 0) | (F.col("v0") == F.col("v1")), F.col("v0")).otherwise(F.col("v0") * (1 - share) + F.col("v1") * share)
    found = ends.groupBy(*KEYS).agg(*[F.max(F.when(F.col("j") == j, value)).alias(f"q{j}") for j in range(len(probabilities))])
    rows = ranges.join(found, list(KEYS), "left")
    quantiles = F.array(*[F.col(f"q{j}") for j in range(len(probabilities))]).alias("quantiles")
    return scratch.result(rows.select(*([F.col("g.*")] if by else []), "field", "n", "low", "high", "missing", quantiles), "quantiles")
