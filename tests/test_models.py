"""Model queries against numpy: the reducer, the grid, baselines, ablations, bundles and scores."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from listinglens.plans import modelling as P

QUERIES = P.QUERIES


@pytest.fixture(scope="module")
def split(spark, sf):
    """id, part, y and cells of the priced rows, as arrays."""
    rows = P.priced(lambda name: spark.read.parquet(f"{sf}/{name}.parquet")).select("id", "part", "y", vector_to_array("features").alias("x")).collect()
    return np.array([r["id"] for r in rows]), np.array([r["part"] for r in rows]), np.array([float(r["y"]) for r in rows]), np.array([list(map(float, r["x"])) for r in rows])


def ridge(x, y, strength):
    """The weights and intercept of a ridge over scaled columns, as the library's solver has them: the mean squared error and half the strength."""
    scale, centre, size = x.std(axis=0, ddof=1), x.mean(axis=0), y.std(ddof=1)
    used = scale > 0
    z, t = (x[:, used] - centre[used]) / scale[used], (y - y.mean()) / size
    inner = np.linalg.solve(z.T @ z / len(z) + np.eye(used.sum()) * strength / size, z.T @ t / len(z))
    weights = np.zeros(x.shape[1])
    weights[used] = inner * size / scale[used]
    return weights, y.mean() - weights @ centre


def fit(split, parts=("train", "validation"), strength=1.0, columns=None):
    _, part, y, x = split
    rows = np.isin(part, parts)
    x = x if columns is None else x * np.isin(np.arange(x.shape[1]), columns)
    return ridge(x[rows], y[rows], strength)


def mae(split, weights, intercept, columns=None):
    _, part, y, x = split
    x = x if columns is None else x * np.isin(np.arange(x.shape[1]), columns)
    rows = part == "test"
    return np.abs(y[rows] - x[rows] @ weights - intercept).mean()


def test_grid_search_ranks_every_trial(spark, sf, split):
    _, part, y, x = split
    held = part == "validation"
    rows = {r["model"]: r for r in QUERIES["m10_grid_search"](spark, sf).collect()}
    for strength in (0.0, 1.0, 100.0):
        weights, intercept = fit(split, ("train",), strength)
        assert rows[f"ridge_{strength}"]["mae"] == pytest.approx(np.abs(y[held] - x[held] @ weights - intercept).mean(), rel=1e-4)
    assert rows["broken"]["mae"] is None and rows["broken"]["error"] and rows["broken"]["rank"] == 4


def test_matched_baseline(spark, sf, split):
    rows = {r["model"]: r for r in QUERIES["m13_matched_baseline"](spark, sf).collect()}
    assert rows["all"]["mae"] == pytest.approx(mae(split, *fit(split)), rel=1e-4)
    table = [0, 1, 2]
    assert rows["tabular"]["mae"] == pytest.approx(mae(split, *fit(split, columns=table), table), rel=1e-4)
    assert rows["all"]["mae_gain"] == pytest.approx(rows["tabular"]["mae"] - rows["all"]["mae"], abs=2e-4)


KEPT = {"full": range(6), "no_text": [0, 1, 2, 4, 5], "no_image": [0, 1, 2, 3], "tabular_only": [0, 1, 2]}


def test_ablations(spark, sf, split):
    weights, intercept = fit(split)
    rows = {r["variant"]: r["mae"] for r in QUERIES["m15_ablation"](spark, sf).collect()}
    assert rows == pytest.approx({n: mae(split, weights, intercept, list(c)) for n, c in KEPT.items()}, rel=1e-4)
    ids, part, _, x = split
    told = {r["id"]: r for r in QUERIES["m16_ablation_predictions"](spark, sf).collect()}
    assert set(told) == set(ids[part == "test"])
    for i, cells in zip(ids[part == "test"][:50], x[part == "test"][:50], strict=True):
        for n, c in KEPT.items():
            assert told[i][n] == pytest.approx(cells[list(c)] @ weights[list(c)] + intercept, rel=1e-4)


def test_bundle_and_scores(spark, sf, split):
    weights, intercept = fit(split)
    row = QUERIES["m23_bundle"](spark, sf).first()
    assert (row["model"], row["target"], row["features"]) == ("ridge", "y", ",".join(P.NAMES))
    assert row["mae"] == pytest.approx(mae(split, weights, intercept), rel=1e-4)
    ids, part, _, x = split
    scores = {r["id"]: r["prediction"] for r in QUERIES["m24_batch_score"](spark, sf).collect()}
    expected = np.maximum(x[part == "test"] @ weights + intercept, 0)
    assert [scores[i] for i in ids[part == "test"]] == pytest.approx(expected.tolist(), rel=1e-4, abs=1e-3)


def test_vector_reducer(spark, sf):
    rows = QUERIES["m06_vector_reducer"](spark, sf).orderBy("vec_id").collect()
    x = np.stack(spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()["embedding"]).astype(float)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    expected = z @ np.linalg.svd(z, full_matrices=False)[2][:16].T
    mine = np.array([r["reduced"] for r in rows])
    assert np.allclose(mine, expected * np.sign((mine * expected).sum(axis=0)), atol=1e-6)


def test_refit_is_one_of_the_candidates(spark, sf):
    row = QUERIES["m12_refit_and_test"](spark, sf).first()
    assert row["n"] > 0 and row["mae"] > 0
