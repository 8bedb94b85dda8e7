"""Exact quantiles against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from listinglens.operators import quantiles as Q

PS = (0.0, 0.05, 0.5, 0.9, 0.95, 1.0)


def plain(values):
    x = [v for v in values if v is not None and not math.isnan(v)]
    return [float(np.quantile(x, p)) for p in PS] if x else [None] * len(PS)


def check(df, rows):
    """rows: (group, a, b) of df."""
    found = {(r["grp"], r["field"]): r for r in Q.exact_quantiles(df, {"a": F.col("a"), "twice b": F.col("b") * 2}, PS, ["grp"]).collect()}
    groups = {g for g, _, _ in rows}
    assert set(found) == {(g, f) for g in groups for f in ("a", "twice b")}
    for g in groups:
        for f, values in (("a", [a for h, a, _ in rows if h == g]), ("twice b", [None if b is None else 2 * b for h, _, b in rows if h == g])):
            r = found[g, f]
            assert r["quantiles"] == pytest.approx(plain(values), rel=1e-12) if plain(values)[0] is not None else r["quantiles"] == plain(values)
            assert r["n"] + r["missing"] == len(values)


def data(n=3000):
    rng = np.random.default_rng(2)
    rows = [(["x", "y", None][i % 3], float(rng.lognormal(3, 2)), int(rng.integers(0, 4))) for i in range(n)]
    rows += [("x", None, None), ("x", float("nan"), 1), ("none", None, None), ("one", 7.5, 3), ("two", 1.0, None), ("two", 2.0, None)]
    rows += [("hot", 5.0, 1)] * n + [("hot", 4.0, 1), ("hot", 6.0, 1)]
    return rows


SCHEMA = "grp string, a double, b int"


def test_small_groups(spark):
    rows = data()
    check(spark.createDataFrame(rows, SCHEMA), rows)


@pytest.mark.parametrize(("small", "sorted_", "broadcast"), [(10, 10**6, 10**4), (10, 5, 10**4), (10, 5, 1)])
def test_ranges_and_a_sort_over_partitions(spark, monkeypatch, small, sorted_, broadcast):
    monkeypatch.setattr(Q, "SMALL", small)
    monkeypatch.setattr(Q, "SORTED", sorted_)
    monkeypatch.setattr(Q, "BROADCAST", broadcast)
    monkeypatch.setattr(Q, "ACCURACY", 300)
    rows = data()
    check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows)


def test_ranges_are_narrow_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 1000)
    df = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    x = np.array([r.v for r in df.collect()])
    cells = Q._cells(df, {"v": F.col("v")}, ())
    counted = Q._counted(cells, Q._ranges(cells, (0.5,)), True)
    assert counted.where("v is not null").count() < 1000
    assert Q.exact_quantiles(df, ["v"], (0.5, 0.999)).first()["quantiles"] == pytest.approx(np.quantile(x, [0.5, 0.999]).tolist())


def test_no_rows(spark):
    assert Q.exact_quantiles(spark.createDataFrame([], SCHEMA), ["a"], PS, ["grp"]).count() == 0
    assert Q.exact_quantiles(spark.createDataFrame([], SCHEMA), ["a"], PS).collect() == [("a", 0, None, None, 0, [None] * len(PS))]
