"""Ranks over partitions, keyed permutations, what they serve: importances and level dictionaries."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from listinglens.operators import features as E
from listinglens.operators import models as M
from listinglens.operators import ranks as K
from listinglens.session import Scratch


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutations_are_bijections(n):
    places = np.arange(n)
    dealt = [K.permuted(places, n, key) for key in range(4)]
    assert all(sorted(d.tolist()) == places.tolist() for d in dealt)
    assert n < 10 or len({tuple(d) for d in dealt}) == 4
    if n == 4097:  # spread over the whole range, from everywhere
        assert abs(np.corrcoef(places, dealt[0])[0, 1]) < 0.06 and (dealt[0] == places).sum() < 10


def test_ranks(spark):
    rows = [(f"k{i * 7919 % 1000:04d}", i) for i in range(1000)]
    ranked = K.global_rank(spark.createDataFrame(rows, "k string, v int").repartition(6), ["k"], "at", Scratch(spark))
    assert {r.k: r["at"] for r in ranked.collect()} == {f"k{i:04d}": i for i in range(1000)}


def frame(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 4 * x[:, 0] + x[:, 1] + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(f"id{i}", float(a), *map(float, b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "id string, y double, a double, b double, c double")
    return df.select("id", "y", array_to_vector(F.array("a", "b", "c")).alias("features"))


def test_importance_agrees_with_numpy_and_not_with_the_order(spark):
    df = frame(spark)
    model = LinearRegression(labelCol="y").fit(df)
    found = {r.feature: (r.importance, r.deviation) for r in M.permutation_importance(model, df, "y", "id", ["a", "b", "c"], repeats=3).collect()}
    again = {r.feature: (r.importance, r.deviation) for r in M.permutation_importance(model, df.orderBy(F.desc("y")).repartition(7), "y", "id", ["a", "b", "c"], repeats=3).collect()}
    assert found == again
    rows = df.withColumn("h", F.xxhash64(F.lit(42), "id")).orderBy("h").collect()
    x, y = np.array([list(r.features) for r in rows]), np.array([r.y for r in rows])

    def mae(z):
        return np.abs(y - (z @ model.coefficients.toArray() + model.intercept)).mean()

    for f, name in enumerate("abc"):
        rises = []
        for r in range(3):
            z = x.copy()
            z[K.permuted(np.arange(300), 300, 43 + 3 * f + r), f] = x[:, f]
            rises.append(mae(z) - mae(x))
        assert found[name] == pytest.approx((np.mean(rises), np.std(rises)), abs=1e-4)
    assert found["a"][0] > found["b"][0] > found["c"][0]


def test_importance_on_a_sample_and_on_nothing(spark):
    df = frame(spark)
    model = LinearRegression(labelCol="y").fit(df)
    assert M.permutation_importance(model, df, "y", "id", ["a", "b", "c"], sample=50, repeats=2).count() == 3
    assert M.permutation_importance(model, df.where("false"), "y", "id", ["a", "b", "c"]).count() == 0


def test_importance_broadcasts_no_rows(spark, monkeypatch):
    """Test rows are files of few bytes, and many in memory: what is broadcast is one row, never them."""
    plans = []
    done = Scratch.result
    monkeypatch.setattr(Scratch, "result", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or done(self, df, name))
    df = frame(spark)
    M.permutation_importance(LinearRegression(labelCol="y").fit(df), df, "y", "id", ["a", "b", "c"], repeats=1)
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


@pytest.mark.parametrize("levels", [10, 100_000])
def test_one_hot(spark, monkeypatch, levels):
    monkeypatch.setattr(E, "LEVELS", levels)
    train = spark.createDataFrame([(x,) for x in ["b", "a", "c", "a", None, *[f"z{i:02d}" for i in range(20)]]], "v string")
    df = spark.createDataFrame([(1, "a"), (2, "c"), (3, "unseen"), (4, None), (5, "z19")], "k int, v string")
    found = {r.k: (r.v_hot.size, list(r.v_hot.indices)) for r in E.one_hot(train, df, "v").collect()}
    assert found == {1: (23, [0]), 2: (23, [2]), 3: (23, []), 4: (23, []), 5: (23, [22])}
    assert {r.v_hot.size for r in E.one_hot(train.where("false"), df, "v").collect()} == {0}


def test_a_million_levels(spark):
    train = spark.range(1_000_000).select(F.col("id").cast("string").alias("v"))
    df = spark.createDataFrame([("999999",), ("x",)], "v string")
    found = {r.v: (r.v_hot.size, r.v_hot.numNonzeros()) for r in E.one_hot(train, df, "v").collect()}
    assert found == {"999999": (1_000_000, 1), "x": (1_000_000, 0)}
