"""Training, comparison and scoring of price models with pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listinglens.operators import stats as S
from listinglens.operators.ranks import global_rank, permuted
from listinglens.session import Scratch, require_columns, rounded

#: Contributions smaller than this are not told.
LEAST_SCORE = 1e-6


def candidates(y: str, features: str = "features", seed: int = 42, stop: str | None = None) -> dict[str, Estimator]:
    """Ridge, elastic net, forest and boosted trees; with a stop column the trees end where its rows stop to gain."""
    common = {"featuresCol": features, "labelCol": y}
    trees = GBTRegressor(**common, seed=seed, maxIter=20, maxDepth=4)
    if stop:
        trees = trees.setValidationIndicatorCol(stop)
    return {
        "ridge": LinearRegression(**common, regParam=1.0, elasticNetParam=0.0),
        "elastic_net": LinearRegression(**common, regParam=0.1, elasticNetParam=0.5, maxIter=50),
        "forest": RandomForestRegressor(**common, seed=seed, numTrees=20, maxDepth=6),
        "boosted": trees,
    }


def grid_search(spark: SparkSession, train: DataFrame, validation: DataFrame, y: str, grid: Mapping[str, Estimator]) -> tuple[DataFrame, dict[str, Model]]:
    """Trials (model, n, mae, rmse, r2, mape, error) on the validation rows, and the fitted models; a failed fit is a row with its error."""
    rows, fitted = None, {}
    for name, estimator in grid.items():
        try:
            model = estimator.fit(train)
            scored = S.metrics(model.transform(validation), y, "prediction").withColumn("error", F.lit(None).cast("string"))
            fitted[name] = model
        except (PySparkException, ValueError) as e:
            cells = "cast(0 as bigint) n, cast(null as double) mae, cast(null as double) rmse, cast(null as double) r2, cast(null as double) mape"
            scored = spark.range(1).selectExpr(*cells.split(", ")).withColumn("error", F.lit(str(e).splitlines()[0][:200]))
        scored = scored.withColumn("model", F.lit(name))
        rows = scored if rows is None else rows.unionByName(scored)
    return rows, fitted


def leaderboard(trials: DataFrame) -> DataFrame:
    order = Window.orderBy(F.asc_nulls_last("mae"), F.asc_nulls_last("rmse"), "model")  # a row for each trial
    return trials.withColumn("rank", F.row_number().over(order))


def best_trial(trials: DataFrame) -> str:
    """The name of the model of least error, the first of ties."""
    return trials.where("mae is not null").agg(F.min_by("model", F.struct("mae", "rmse", "model")).alias("m")).first()["m"]


def refit_and_test(best: Estimator, train: DataFrame, validation: DataFrame, test: DataFrame, y: str) -> tuple[Model, DataFrame]:
    """Fit on train and validation rows, and the metrics on the test rows."""
    model = best.fit(train.unionByName(validation))
    return model, S.metrics(model.transform(test), y, "prediction")


def matched_baseline(estimator: Callable[[str], Estimator], train: DataFrame, test: DataFrame, y: str, block: str) -> DataFrame:
    """Metrics of the same kind of model on one block of the same rows."""
    return S.metrics(estimator(block).fit(train).transform(test), y, "prediction")


def masked(df: DataFrame, slots: Sequence[range], features: str = "features") -> DataFrame:
    """df with the feature slots of the ranges set to zero."""
    gone = F.array(*[F.lit(i) for r in slots for i in r]) if any(len(r) for r in slots) else F.expr("cast(array() as array<int>)")
    cells = F.transform(vector_to_array(features), lambda x, i: F.when(F.array_contains(gone, i), 0.0).otherwise(x))
    return df.withColumn(features, array_to_vector(cells))


def ablation_predictions(model: Model, df: DataFrame, key: str, variants: Mapping[str, Sequence[range]]) -> DataFrame:
    """One row per key with the prediction of each variant: one transform over the rows with their masks, then a pivot."""
    parts = [masked(df, slots).withColumn("variant", F.lit(name)) for name, slots in variants.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return model.transform(every).groupBy(key).pivot("variant", list(variants)).agg(F.first("prediction"))


def ablate(model: Model, df: DataFrame, y: str, variants: Mapping[str, Sequence[range]]) -> DataFrame:
    """Metrics of each variant."""
    rows = None
    for name, slots in variants.items():
        part = masked(df, slots).withColumn("variant", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return S.metrics(model.transform(rows), y, "prediction", ["variant"])


def native_importance(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """Importances of trees, else sizes of coefficients; a row for each feature."""
    values = model.featureImportances if hasattr(model, "featureImportances") else [abs(x) for x in model.coefficients]
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


def permutation_importance(model: Model, df: DataFrame, y: str, key: str, names: Sequence[str], seed: int = 42, repeats: int = 5, sample: int | None = None) -> DataFrame:
    """Rows (feature, importance, deviation): the rise of MAE when one feature's values are dealt anew, mean and deviation over the repeats.

    With `sample` only so many rows take part, those of least hash of the key.
    Rows are numbered in hash order, and a keyed bijection of the numbers deals
    the values: each row sends each value of its own to the row that it goes to,
    so one join serves all features and repeats. It is a merge join: the rows
    grow with the data, and as files they look small enough for a broadcast.
    """
    scratch = Scratch(df.sparkSession)
    cells = df.select(F.col(key).alias("_key"), F.col(y).cast("double").alias("y"), vector_to_array("features").alias("x"), F.xxhash64(F.lit(seed), key).alias("_hash"))
    rows = global_rank(cells, ["_hash", "_key"], "i", scratch).drop("_key", "_hash")
    n = rows.count()
    if sample is not None and sample < n:
        rows, n = rows.where(F.col("i") < sample), sample
    if not n:
        scratch.clear()
        return df.sparkSession.createDataFrame([], "feature string, importance double, deviation double")
    keys = [seed + 1 + k for k in range(len(names) * repeats)]

    @F.pandas_udf("array<long>")
    def targets(places: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack([permuted(places.to_numpy(), n, k) for k in keys], axis=1)) if len(places) else [], dtype=object)

    sent = rows.select("x", F.posexplode(targets("i")).alias("k", "i")).withColumn("f", F.expr(f"k div {repeats}").cast("int"))
    sent = sent.select("i", "k", "f", F.get("x", F.col("f")).alias("v"))
    met = sent.join(rows.hint("merge"), "i").select("k", "f", "y", array_to_vector(F.transform("x", lambda v, j: F.when(j == F.col("f"), F.col("v")).otherwise(v))).alias("features"))
    base = model.transform(rows.select("y", array_to_vector("x").alias("features"))).agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("base"))
    errors = model.transform(met).groupBy("f", "k").agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"))
    rises = errors.crossJoin(F.broadcast(base)).withColumn("rise", F.col("mae") - F.col("base"))  # one row
    told = F.get(F.array(*map(F.lit, names)), F.col("f")).alias("feature")
    out = rises.groupBy("f").agg(F.avg("rise").alias("m"), F.stddev_pop("rise").alias("d")).select(told, rounded(F.col("m")).alias("importance"), rounded(F.col("d")).alias("deviation"))
    return scratch.result(out, "importance")


def top_features(importance: DataFrame, n: int = 20, prefix: str = "") -> DataFrame:
    return importance.where(F.col("feature").startswith(prefix)).orderBy(F.desc("importance"), "feature").limit(n)


def signed_top(df: DataFrame, value: str, name: str, n: int = 20) -> DataFrame:
    """The n largest, the n smallest and the n largest by size, with a side label."""
    sides = {"largest": [F.desc(value), name], "smallest": [F.asc(value), name], "size": [F.desc(F.abs(value)), name]}
    rows = None
    for side, order in sides.items():
        part = df.orderBy(*order).limit(n).withColumn("side", F.lit(side))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def attribute_linear(df: DataFrame, means: Mapping[str, float], coefficients: Mapping[str, float], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with `factors`: for each group the sum of coefficient times distance from the mean."""

    def total(columns: Sequence[str]) -> Column:
        out = F.lit(0.0)
        for c in columns:
            out = out + coefficients[c] * (F.col(c) - means[c])
        return out

    return df.withColumn("factors", F.array(*[F.struct(F.lit(g).alias("group"), total(c).alias("score")) for g, c in groups.items()]))


def top_factors(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Up to k factors of each sign, strongest first; tiny ones are left out."""
    rows = df.select(key, F.explode("factors").alias("f")).select(key, "f.*").where(F.abs("score") >= LEAST_SCORE)
    sign = F.when(F.col("score") > 0, "positive").otherwise("negative")
    rank = F.row_number().over(Window.partitionBy(key, "sign").orderBy(F.desc(F.abs("score")), "group"))
    return rows.withColumn("sign", sign).withColumn("rank", rank).where(F.col("rank") <= k)


def merged_factors(factors: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Positive factors, then negative ones, the first k of a row."""
    order = Window.partitionBy(key).orderBy(F.desc("sign"), "rank")
    return factors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def factor_message(group: Column, score: Column) -> Column:
    """A sentence for a factor; null for a tiny one."""
    told = F.when(score > 0, "raises the price").otherwise("lowers the price")
    return F.when(F.abs(score) >= LEAST_SCORE, F.concat_ws(" ", group, told))


#: Columns that a bundle's description must have.
BUNDLE = ("model", "features", "target", "mae")


def save_bundle(model: Model, info: Mapping[str, object], path: str, spark: SparkSession) -> None:
    """The model and one row that describes it."""
    row = spark.createDataFrame([tuple(str(v) for v in info.values())], ", ".join(f"{k} string" for k in info))
    require_columns(row, BUNDLE)
    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().overwrite().save(f"{path}/model")
    row.write.mode("overwrite").parquet(f"{path}/info")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    info = require_columns(spark.read.parquet(f"{path}/info"), BUNDLE)
    return PipelineModel.load(f"{path}/model"), info


def score(df: DataFrame, model: Model, key: str) -> DataFrame:
    """Rows (key, prediction), not under zero; one row or billions."""
    return model.transform(df).select(key, F.greatest("prediction", F.lit(0.0)).alias("prediction"))
