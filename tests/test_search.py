"""Representations are fitted once, fused cells agree with numpy, rounds agree with the library's own evaluation."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from listinglens.operators import search as H
from listinglens.plans import modelling as P


@pytest.fixture(scope="module")
def made(spark, sf):
    return P.blocks(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))


def test_blocks_are_fitted_once_for_all_trials(spark, made):
    cache, wide = made
    assert cache.fits == {"text": 1, "image": len(P.CAPS), "fused": len(P.CAPS)}
    models = {"ridge": LinearRegression(labelCol="y", regParam=1.0), "broken": LinearRegression(labelCol="absent")}
    trials = [H.Trial(a, b, c, m) for a in P.TEXT_SIZES for b in P.IMAGE_SIZES for c in P.CAPS for m in models]
    rows = H.search(spark, wide, trials, models, "y").collect()
    assert [(r.text, r.image, r.cap, r.model) for r in rows] == [(t.text, t.image, t.cap, t.model) for t in trials]
    assert all((r.mae is None) == (r.error is not None) == (r.model == "broken") for r in rows)
    assert cache.fits == {"text": 1, "image": len(P.CAPS), "fused": len(P.CAPS)}
    best = H.best_of(spark.createDataFrame(rows))
    assert min(r.mae for r in rows if r.mae) == next(r.mae for r in rows if (r.text, r.image, r.cap, r.model) == (best.text, best.image, best.cap, best.model))


def test_fused_cells_agree_with_numpy(spark, sf, made):
    """The image cells are principal components of the pooled, scaled vectors; text cells have the singular values' size."""
    rows = sorted(made[1][4].collect(), key=lambda r: r["id"])
    images = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    pooled = []
    for r in rows:
        x = np.stack(images[images["vec_id"] // 4 == r["id"]].sort_values("vec_id")["embedding"][:4]).astype(float)
        both = np.concatenate([x.mean(axis=0) / np.linalg.norm(x.mean(axis=0)), x.max(axis=0) / np.linalg.norm(x.max(axis=0))])
        pooled.append(both / np.linalg.norm(both))
    x, train = np.array(pooled), np.array([r["part"] == "train" for r in rows])
    z = (x - x[train].mean(axis=0)) / x[train].std(axis=0, ddof=1)
    _, _, v = np.linalg.svd(z[train] - z[train].mean(axis=0), full_matrices=False)
    mine, expected = np.array([r["image"] for r in rows]), z @ v[: max(P.IMAGE_SIZES)].T
    signs = np.sign((mine * expected).sum(axis=0))
    assert np.allclose(mine, expected * signs, atol=1e-6)
    assert all(len(r["text"]) == max(P.TEXT_SIZES) for r in rows)
    text = np.array([r["text"] for r in rows])[train]
    sizes = np.linalg.norm(text, axis=0)
    assert (np.diff(sizes) < 1e-9).all() and np.allclose(text.T @ text, np.diag(sizes**2), atol=1e-6)
    cells = H.trial_features(made[1][4], H.Trial(3, 2, 4, "")).orderBy("id").first()
    assert list(cells["features"]) == [*rows[0]["table"], *rows[0]["text"][:3], *rows[0]["image"][:2]]


def boosted_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (400, 3))
    y = np.exp(3 * x[:, 0]) + 5 * x[:, 1] + rng.exponential(2, 400)
    df = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(y, x, strict=True)], "y double, a double, b double, c double")
    df = df.select("y", array_to_vector(F.array("a", "b", "c")).alias("features"), (F.col("c") < 0.3).alias("held")).cache()
    return df.where("not held"), df.where("held")


def test_rounds_agree_with_a_loop_over_the_evaluation(spark):
    train, held = boosted_rows(spark)
    gbt = GBTRegressor(labelCol="y", maxDepth=3, stepSize=0.5, seed=1)
    full = gbt.copy({gbt.maxIter: 24}).fit(train)
    expected = full.evaluateEachIteration(held, "absolute")
    assert H.staged_errors(full, held, "y") == pytest.approx(expected, rel=1e-9)
    best = 0
    for i, e in enumerate(expected):
        if e < expected[best]:
            best = i
        elif i - best >= 4:
            break
    model, rounds = H.boosted_with_patience(gbt, train, held, "y", patience=4, most=24)
    assert rounds == best + 1 and model.getNumTrees == rounds
    assert H.staged_errors(model, held, "y") == pytest.approx(expected[:rounds], rel=1e-9)


@pytest.mark.parametrize(("errors", "patience", "expected"), [([5, 4, 3, 4, 5], 2, (3, True)), ([5, 4, 3, 4], 2, (3, False)), ([3, 3, 3], 2, (1, True)), ([1], 5, (1, False))])
def test_patience(errors, patience, expected):
    assert H.rounds_with_patience(errors, patience) == expected


def test_log_target_is_back_transformed(spark, tmp_path):
    train, held = boosted_rows(spark)
    model = H.LogTarget(LinearRegression(regParam=0.0), "y").fit(train)
    x, y = (np.array([list(r.features) for r in train.collect()]), np.array([r.y for r in train.collect()]))
    design = np.column_stack([np.ones(len(x)), x])
    weights = np.linalg.lstsq(design, np.log1p(y), rcond=None)[0]
    model.write().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    rows = PipelineModel.load(str(tmp_path / "m")).transform(held.drop("y")).collect()
    assert [r.prediction for r in rows] == pytest.approx([max(0, float(np.expm1(weights[0] + weights[1:] @ np.array(list(r.features))))) for r in rows], rel=1e-6)
    boosted, rounds = H.boosted_with_patience(GBTRegressor(maxDepth=2, seed=1), train, held, "y", patience=2, most=8, log=True)
    assert min(r.prediction for r in boosted.transform(held).collect()) >= 0 and rounds <= 8
