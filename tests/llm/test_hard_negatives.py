"""Hard negatives against plain loops."""

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listinglens.llm import hard_negatives as H
from listinglens.llm import queries as K

SCHEMA = "vec_id long, label int, embedding array<double>, id long, a long, score long, q string"


def plain(rows, positives=5, negatives=5, least=80):
    sound = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    v = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in e]) for i, lab, e in sound]
    out = []
    for i, lab, e in v:
        if i % 100:
            continue
        scored = [(-max(-H.LAST, min(H.LAST, sum(x * y for x, y in zip(e, f, strict=True)))), j, m) for j, m, f in v if len(f) == len(e)]
        for s, j, _ in sorted((s, j, m) for s, j, m in scored if m == lab and j != i)[:positives]:
            inside = sorted((t, n) for t, n, m in scored if m != lab and least * -s <= 100 * -t <= 100 * -s)
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside[:negatives])]
    return sorted(out)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).repartition(parts)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, H.mine(docs, "vec_id", label, "embedding", F.col("id") % 100 == 0).collect()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 9)), max_size=30), st.integers(1, 6))
def test_best(pairs, k):
    scores, ids = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [])))
    picked = H.best(scores, ids, k)
    assert [(-scores[i], ids[i]) for i in picked] == sorted((-s, i) for s, i in pairs)[:k]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-20, 200), max_size=6), st.integers(-30, 210))
def test_a_score_is_in_one_slot_if_a_window_holds_it(scores, x):
    mine = [j for j, low, high in H.slots(scores, 80) if low <= x <= high]
    windows = [s for s in scores if 80 * s <= 100 * x <= 100 * s]
    assert len(mine) == bool(windows)
    if windows:
        assert sorted({s for s in scores if s >= 0}, reverse=True)[mine[0]] == min(windows)


@pytest.mark.parametrize("big", [1, 2**14, 2**25, 2**40])
def test_products_are_exact(big):
    rng = np.random.default_rng(3)
    x, y = rng.integers(-big, big, (4, 9)), rng.integers(-big, big, (5, 9))
    assert H.products(x, y).tolist() == [[max(-H.LAST, min(H.LAST, sum(int(a) * int(b) for a, b in zip(r, s, strict=True)))) for s in y] for r in x]


def test_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(0.3, 0.4, 4).round(1).tolist()) for i in range(0, 1200, 3)]  # ties abound
    rows += [(100, 1, [0.5] * 4), (100, 1, [0.5] * 4), (300, 2, [0.25] * 4)]  # repeated and clashing ids
    rows += [(1500 + i, i % 2, [0.5] * 4) for i in range(200)]  # a hot vector
    rows += [(None, 1, [1.0] * 4), (401, None, [1.0] * 4), (402, 1, None), (403, 1, [1.0, None, 1.0, 1.0]), (404, 1, [float("nan")] * 4), (405, 1, [float("inf")] * 4)]
    rows += [(500, 1, [0.5, 0.5]), (502, 1, [0.5, 0.4]), (503, 2, [0.5, 0.3]), (600, 1, []), (601, 1, []), (602, 2, []), (700, 9, [-1.0] * 4), (701, 0, [-1.0] * 4)]
    expected = plain(rows)
    assert expected
    assert found(spark, rows) == expected
    monkeypatch.setattr(H, "BLOCK_BYTES", 300)
    monkeypatch.setattr(H, "CHUNK", 64)
    monkeypatch.setattr(H, "ANCHORS", 2)
    assert found(spark, rows, 2) == expected


def test_huge_components(spark):
    for x in (1e6, 1e9, 1e12):  # 1e9 and more leave 64 bits
        rows = [(0, 0, [x] * 3), (2, 2, [x] * 3), (3, 2, [x, x, 0.9 * x]), (4, 3, [x, x, 0.5 * x]), (15, 1, [x] * 3), (16, 1, [x, x, -x]), (17, 5, [-x] * 3)]
        assert found(spark, rows) == plain(rows) != []


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0])]) == []


def test_sql_twin(spark, sf):
    with duckdb.connect() as sql:
        sql.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        rel = sql.sql(H.ORACLE_SQL)
        names, theirs = rel.columns, rel.fetchall()
    mine = K.op12_hard_negatives(spark, sf)
    assert mine.columns == names
    assert sorted(map(tuple, mine.collect())) == sorted(theirs)
