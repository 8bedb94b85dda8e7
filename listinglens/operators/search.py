"""Search over representations and models: blocks fitted once for all their sizes, trials in parallel, a log target, boosting with patience."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglens.operators import features as E
from listinglens.operators import stats as S
from listinglens.operators import vectors as V
from listinglens.session import stage_table

# -- representations -------------------------------------------------------------------------------------------------


class RepresentationCache:
    """Staged representations by kind and configuration; `fits` counts how often each kind had to be made."""

    def __init__(self):
        self.tables: dict[tuple, DataFrame] = {}
        self.fits: Counter = Counter()

    def get(self, kind: str, config: tuple, fit: Callable[[], DataFrame]) -> DataFrame:
        if (kind, config) not in self.tables:
            self.fits[kind] += 1
            self.tables[kind, config] = stage_table(fit(), f"block-{kind}")
        return self.tables[kind, config]


def text_block(cache: RepresentationCache, rows: DataFrame, key: str, words: str, train: str, size: int, terms: int = 5000, least_df: int = 2) -> DataFrame:
    """Rows (key, text): TF-IDF of the training vocabulary on `size` singular vectors. Smaller sizes are its first cells."""

    def fit() -> DataFrame:
        vectors, _ = E.tfidf_vectors(rows.where(train), rows, words, terms, least_df)
        vectors = stage_table(vectors.select(key, "text_vector", F.expr(train).alias("_train")), "block-terms")
        loadings = E.truncated_svd(vectors.where("_train"), "text_vector", size)
        return E.project(vectors, "text_vector", loadings, "_text").select(key, vector_to_array("_text").alias("text"))

    return cache.get("text", (terms, least_df, size), fit)


def image_block(cache: RepresentationCache, rows: DataFrame, images: DataFrame, key: str, order: str, vector: str, train: str, cap: int, size: int) -> DataFrame:
    """Rows (key, image): the first `cap` vectors of each key pooled, then `size` principal components. Smaller sizes are its first cells."""

    def fit() -> DataFrame:
        ranked = V.rank_for_caps(images, key, order, [cap])
        pooled = V.meanmax(V.pool_vectors(ranked, [key], vector)).select(key, array_to_vector("meanmax").alias("_v"))
        pooled = stage_table(rows.select(key, F.expr(train).alias("_train")).join(pooled, key), "block-pooled")
        fitted = E.vector_reducer("_v", size, "_image").fit(pooled.where("_train"))
        return fitted.transform(pooled).select(key, vector_to_array("_image").alias("image"))

    return cache.get("image", (cap, size), fit)


@dataclass(frozen=True)
class Trial:
    """Cells of the text and the image block, vectors of a key that are pooled, and the model."""

    text: int
    image: int
    cap: int
    model: str

    @property
    def name(self) -> str:
        return f"{self.model} text={self.text} image={self.image} cap={self.cap}"


def fused(cache: RepresentationCache, rows: DataFrame, key: str, text: DataFrame, image: DataFrame, cap: int) -> DataFrame:
    """rows with both blocks, staged once for each cap."""
    return cache.get("fused", (cap,), lambda: rows.join(text, key).join(image, key))


def trial_features(wide: DataFrame, trial: Trial, table: str = "table") -> DataFrame:
    """wide with `features`: the table's cells and the first cells of both blocks."""
    cells = F.concat(F.col(table), F.slice("text", 1, trial.text), F.slice("image", 1, trial.image))
    return wide.withColumn("features", array_to_vector(cells))


def search(spark: SparkSession, wide: Mapping[int, DataFrame], trials: Sequence[Trial], models: Mapping[str, Estimator], y: str, parallel: int = 4) -> DataFrame:
    """Rows (model, text, image, cap, n, mae, rmse, r2, mape, error): each trial fitted on part = train and measured on part = validation.

    Trials run side by side on tables that are staged; one that fails is a row with its error.
    """
    names = ("n", "mae", "rmse", "r2", "mape")

    def run(trial: Trial) -> tuple:
        try:
            rows = trial_features(wide[trial.cap], trial)
            model = models[trial.model].fit(rows.where("part = 'train'"))
            found = S.metrics(model.transform(rows.where("part = 'validation'")), y, "prediction").first()
            return (trial.model, trial.text, trial.image, trial.cap, *[found[n] for n in names], None)
        except (PySparkException, ValueError) as e:
            return (trial.model, trial.text, trial.image, trial.cap, 0, None, None, None, None, str(e).splitlines()[0][:200])

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(run, trials))
    return spark.createDataFrame(rows, "model string, text int, image int, cap int, n long, mae double, rmse double, r2 double, mape double, error string")


def best_of(trials: DataFrame) -> Trial:
    """The trial of least error; of ties the one that comes first."""
    r = trials.where("mae is not null").orderBy("mae", "rmse", "model", "text", "image", "cap").first()
    return Trial(r["text"], r["image"], r["cap"], r["model"])


# -- targets and rounds ----------------------------------------------------------------------------------------------


class LogTarget:
    """An estimator that learns log(1 + y); its model gives predictions of y itself, not under zero."""

    def __init__(self, estimator: Estimator, y: str):
        self.estimator, self.y = estimator.copy().setLabelCol("_log_y").setPredictionCol("_log_prediction"), y

    def fit(self, df: DataFrame) -> PipelineModel:
        model = self.estimator.fit(df.withColumn("_log_y", F.log1p(self.y)))
        return PipelineModel([model, SQLTransformer(statement="SELECT *, greatest(expm1(_log_prediction), 0.0D) AS prediction FROM __THIS__")])


def staged_errors(model: Model, df: DataFrame, y: str, log: bool = False) -> list[float]:
    """The mean absolute error of a boosted model after each of its rounds, in one pass; with log the trees tell log(1 + y)."""
    rows, total, errors = df.select(y, "features"), F.lit(0.0), []
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        rows = tree.setPredictionCol(f"_t{i}").transform(rows)
        total = total + float(weight) * F.col(f"_t{i}")
        told = F.greatest(F.expm1(total), F.lit(0.0)) if log else total
        errors.append(F.avg(F.abs(F.col(y) - told)).alias(f"_e{i}"))
    return list(rows.agg(*errors).first())


def rounds_with_patience(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """(rounds, settled): the round of least error before `patience` rounds brought no gain, and whether so many have passed."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boosted_with_patience(gbt: GBTRegressor, train: DataFrame, validation: DataFrame, y: str, patience: int = 50, most: int = 500, log: bool = False) -> tuple[Model, int]:
    """A boosted model of as many rounds as bring a gain on the validation rows, and their number.

    The rounds are doubled until `patience` of them bring none. The trees of
    fewer rounds are the first of more, so the model is fitted at last with the
    rounds that were best.
    """
    target = "_log_y" if log else y
    rows = train.withColumn("_log_y", F.log1p(y)) if log else train
    rounds = min(most, 2 * patience)
    while True:
        model = gbt.copy({gbt.maxIter: rounds, gbt.labelCol: target}).fit(rows)
        best, settled = rounds_with_patience(staged_errors(model, validation, y, log), patience)
        if settled or rounds >= most:
            break
        rounds = min(most, 2 * rounds)
    if best < rounds:
        model = gbt.copy({gbt.maxIter: best, gbt.labelCol: target}).fit(rows)
    if log:
        model = PipelineModel([model.setPredictionCol("_log_prediction"), SQLTransformer(statement="SELECT *, greatest(expm1(_log_prediction), 0.0D) AS prediction FROM __THIS__")])
    return model, best
