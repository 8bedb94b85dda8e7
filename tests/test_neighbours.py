"""Nearest neighbours against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from listinglens.operators import neighbours as B


def plain(rows, asked, k):
    out = []
    for q in asked:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(rows[q])) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out += [(q, n + 1, i, round(x, 9)) for n, (x, i) in enumerate(d[:k])]
    return sorted(out)


def found(df, condition, k, key="id"):
    rows = B.nearest(df.where(condition), df, k, key, "v").collect()
    return sorted((r["query"], r["rank"], r[key], round(r["distance"], 9)) for r in rows), rows


def test_ties_and_nulls(spark):
    rng = np.random.default_rng(4)
    x = {i: v for i, v in enumerate(rng.integers(0, 4, (300, 3)).astype(float).tolist())}
    df = spark.createDataFrame([*x.items(), (999, None), (None, [1.0, 2.0, 3.0])], "id long, v array<double>")
    assert found(df, "id % 10 = 0 or id is null", 4)[0] == plain(x, range(0, 300, 10), 4)


@pytest.mark.parametrize("block", [3, 1024])
def test_clusters_are_skipped(spark, monkeypatch, block):
    monkeypatch.setattr(B, "PART_BYTES", 2000)
    monkeypatch.setattr(B, "QUERY_BLOCK", block)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 20, (12, 5))
    x = {i: (centres[i % 12] + rng.normal(0, 1, 5)).tolist() for i in range(1500)}
    x |= {2000 + i: [1.0] * 5 for i in range(300)}  # a hot vector
    df = spark.createDataFrame(list(x.items()), "id long, v array<double>")
    mine, rows = found(df, "id % 50 = 0", 5)
    asked = [i for i in x if i % 50 == 0]
    assert mine == plain(x, asked, 5)
    assert {r["query"] for r in rows} == set(asked)
    assert sum(r["compared"] for r in rows) < 0.5 * len(rows) * len(x)  # of all pairs


def test_text_keys(spark):
    rng = np.random.default_rng(8)
    x = {f"listing-{i:03d}é": rng.integers(0, 5, 4).astype(float).tolist() for i in range(200)}
    df = spark.createDataFrame(list(x.items()), "listing string, v array<float>")
    rows = B.nearest(df.where(F.col("listing").endswith("5é")), df, 6, "listing", "v").collect()
    assert sorted((r["query"], r["rank"], r["listing"], round(r["distance"], 9)) for r in rows) == plain(x, [i for i in x if i.endswith("5é")], 6)


def test_more_neighbours_than_rows(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id long, v array<double>")
    assert found(df, "id = 0", 9)[0] == plain({i: [float(i)] for i in range(4)}, [0], 9)
    none = df.where("false")
    assert B.nearest(none, df, 2, "id", "v").count() == 0 and B.nearest(df, none, 2, "id", "v").count() == 0
    one = df.where("id = 1")
    assert B.nearest(one, one, 2, "id", "v").count() == 0
    with pytest.raises(ValueError, match="1 to 2"):
        B.nearest(df, df.unionByName(spark.createDataFrame([(9, [1.0, 2.0])], df.schema)), 2, "id", "v")


def test_a_large_unit_is_compared_in_bounded_memory():
    """A unit of short vectors has very many rows: the distances that are held at a time do not grow with them."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(11)
    x = rng.integers(0, 300, (400_000, 2)).astype(float)
    right = pd.DataFrame({"found": np.arange(len(x)), "_v": list(x)})
    left = pd.DataFrame({"query": np.arange(64), "_q": list(x[:64])})
    tracemalloc.start()
    rows = B._nearest(3)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    for q in range(0, 64, 9):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert rows["found"][rows["query"] == q].tolist() == np.lexsort((np.arange(len(x)), d))[:3].tolist()


def test_units_of_short_vectors_have_few_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "PART_ROWS", 40)
    held = []
    made = B.Units
    monkeypatch.setattr(B, "Units", lambda pivots, rows: held.append(rows) or made(pivots, rows))
    x = {i: [float(i * 37 % 1000)] for i in range(2000)}
    df = spark.createDataFrame(list(x.items()), "id long, v array<double>")
    assert found(df, "id % 400 = 0", 5)[0] == plain(x, range(0, 2000, 400), 5)
    assert held[0]["part"].nunique() >= 45 and held[0]["n"].max() <= 120


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x, q = rng.normal(0, 3, (400, 6)), rng.normal(0, 3, (50, 6))
    pivots = B.choose_pivots(x, 8)
    to = B.distances(x, pivots)
    cell, r = to.argmin(axis=1), to.min(axis=1)
    import pandas as pd

    part = np.digitize(r, [2.0, 4.0])
    units = pd.DataFrame({"part": part, "cell": cell, "r": r}).groupby(["part", "cell"]).agg(low=("r", "min"), high=("r", "max"), n=("r", "size")).reset_index()
    u = B.Units(pivots, units)
    bounds = u.bounds(q)
    for i in range(len(units)):
        inside = x[(part == units["part"][i]) & (cell == units["cell"][i])]
        assert (bounds[:, i] <= np.sqrt(((q[:, None] - inside[None]) ** 2).sum(axis=2)).min(axis=1)).all()
    assert (bounds > 0).any()
