"""Models that are plain aggregates: group means and one-feature least squares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_means(train: DataFrame, group: str, y: str) -> DataFrame:
    """The mean of y in each group."""
    return train.groupBy(group).agg(F.avg(y).alias("group_mean"))


def predict_group_mean(df: DataFrame, train: DataFrame, group: str, y: str) -> DataFrame:
    """df with `prediction`, the training mean of its group or of all, and `overall`, that of all."""
    overall = train.agg(F.avg(y).alias("overall"))
    joined = df.join(group_means(train, group, y), group, "left").crossJoin(F.broadcast(overall))  # one row
    return joined.withColumn("prediction", F.coalesce("group_mean", "overall")).drop("group_mean")


def ols1(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept and r2 of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
