"""Vocabulary, sparse singular vectors and projections against numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from listinglens.operators import features as E


def sparse_rows(n, terms, seed=1):
    """Rows that share topics, as texts do."""
    rng = np.random.default_rng(seed)
    topics = rng.gamma(0.1, size=(12, terms))
    a = np.zeros((n, terms))
    for i in range(n):
        p = topics[rng.integers(12)] + 0.02
        for j in rng.choice(terms, 25, p=p / p.sum()):
            a[i, j] += 1
    return a / np.linalg.norm(a, axis=1)[:, None]


def frame(spark, a):
    rows = [(i, Vectors.sparse(a.shape[1], {int(j): float(x[j]) for j in np.flatnonzero(x)})) for i, x in enumerate(a)]
    return spark.createDataFrame(rows, ["id", "v"])


def test_singular_vectors_and_rows_agree_with_numpy(spark):
    a = sparse_rows(2000, 600)
    df = frame(spark, a).repartition(3)
    v = E.truncated_svd(df, "v", 10)
    _, _, exact = np.linalg.svd(a, full_matrices=False)
    exact = exact[:10].T
    exact *= np.sign(exact[np.abs(exact).argmax(axis=0), np.arange(10)])
    assert np.abs(v - exact).max() < 1e-6
    rows = {r.id: r.p for r in E.project(df, "v", v, "out").select("id", vector_to_array("out").alias("p")).collect()}
    assert np.abs(np.array([rows[i] for i in range(len(a))]) - a @ exact).max() < 1e-6


@pytest.mark.parametrize(("n", "terms", "k"), [(1, 5, 3), (4, 6, 6), (30, 8, 20)])
def test_small_and_short_of_rank(spark, n, terms, k):
    a = np.random.default_rng(2).normal(size=(n, terms)).round(1)
    df = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in enumerate(a)], ["id", "v"])
    v = E.truncated_svd(df, "v", k)
    assert v.shape == (terms, min(k, terms))
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-8)
    size = np.sqrt(((a @ v) ** 2).sum(axis=0))
    assert np.allclose(size[: min(n, k, terms)], np.linalg.svd(a)[1][: min(n, k, terms)], atol=1e-6)


def test_projection_of_empty_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(3, {})), (2, None), (3, Vectors.sparse(3, {1: 2.0}))], ["id", "v"])
    v = np.array([[1.0, 0.0], [0.5, 2.0], [0.0, 1.0]])
    rows = {r.id: r.out for r in E.project(df, "v", v, "out").collect()}
    assert list(rows[1]) == [0.0, 0.0] and rows[2] is None and list(rows[3]) == [1.0, 4.0]


def test_vocabulary_counts_documents_and_occurrences(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b", "a"]), (3, []), (4, None)], "id int, words array<string>")
    found = {r.term: (r.df, r.n) for r in E.vocabulary(df, "words", 10, 1).collect()}
    assert found == {"a": (2, 3), "b": (2, 2), "a a": (1, 1), "a b": (1, 1), "b a": (1, 1)}
    assert [r.term for r in E.vocabulary(df, "words", 1, 2).collect()] == ["a"]


def test_component_tokens(spark):
    v = np.array([[0.1, -0.9], [0.8, 0.0], [-0.8, 0.4]])
    rows = E.component_tokens(spark, v, ["x", "z", "y"], 2).orderBy("component", "rank").collect()
    assert [(r.component, r.term, r["rank"]) for r in rows] == [(0, "y", 1), (0, "z", 2), (1, "x", 1), (1, "y", 2)]


def test_tfidf_rows_have_length_one(spark):
    df = spark.createDataFrame([(i, ["a", "b", f"w{i % 3}"]) for i in range(9)], "id int, words array<string>")
    rows = E.tfidf(df, "id", "words", 100, 1).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(rows) == 9 and all(abs(r.n - 1) < 1e-12 for r in rows)


def test_sparse_rows_agree_with_plain_counts(spark, monkeypatch):
    """In one run and in many; a null text and an unknown one have no cells."""
    rng = np.random.default_rng(6)
    texts = [[f"w{j}" for j in rng.integers(0, 6, int(rng.integers(1, 12)))] for _ in range(60)] + [[], None, ["unknown"]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, words array<string>").repartition(2)
    grams = [[] if t is None else t + [f"{a} {b}" for a, b in zip(t, t[1:])] for t in texts]
    n, there = {}, {}
    for g in grams:
        for x in g:
            n[x] = n.get(x, 0) + 1
        for x in set(g):
            there[x] = there.get(x, 0) + 1
    known = sorted([x for x in n if there[x] >= 3], key=lambda x: (-n[x], x))[:20]
    for size in (1 << 19, 9):
        monkeypatch.setattr(E, "WORDS", size)
        rows, vocabulary = E.tfidf_vectors(df, df, "words", 20, 3)
        assert vocabulary == known
        for r in rows.collect():
            raw = {known.index(x): grams[r.id].count(x) * (np.log((1 + len(texts)) / (1 + there[x])) + 1) for x in set(grams[r.id]) & set(known)}
            length = np.sqrt(sum(x * x for x in raw.values()))
            assert r.text_vector["size"] == 20 and r.text_vector["indices"] == sorted(raw)
            assert r.text_vector["values"] == pytest.approx([raw[i] / length for i in sorted(raw)])


@pytest.mark.parametrize("dense", [0, 10**9])
def test_rounds_multiply_dense_and_sparse_alike(spark, monkeypatch, dense):
    monkeypatch.setattr(E, "DENSE", dense)
    a = sparse_rows(300, 80)
    v = E.truncated_svd(frame(spark, a), "v", 4)
    exact = np.linalg.svd(a, full_matrices=False)[2][:4].T
    assert np.abs(v - exact * np.sign((v * exact).sum(axis=0))).max() < 1e-6


def test_words_are_made_once(spark, sf):
    """The projected rows come from files: no text is split again."""
    from listinglens.plans.modelling import QUERIES

    plan = QUERIES["f11_truncated_svd"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


@pytest.mark.parametrize("most", [1, 3, 7, 20, 400])
def test_pairs_that_cannot_be_among_the_commonest_are_not_counted(spark, monkeypatch, most):
    """The same vocabulary as by counting all terms, ties included, from fewer counts."""
    rng = np.random.default_rng(most)
    texts = [[f"w{j:02d}" for j in (30 * rng.random(int(rng.integers(1, 20))) ** 3).astype(int)] for _ in range(80)]
    grams = [t + [f"{a} {b}" for a, b in zip(t, t[1:])] for t in texts]
    n, there = {}, {}
    for g in grams:
        for x in g:
            n[x] = n.get(x, 0) + 1
        for x in set(g):
            there[x] = there.get(x, 0) + 1
    kept = sorted([x for x in n if there[x] >= 3], key=lambda x: (-n[x], x))[:most]
    df = spark.createDataFrame([(t,) for t in texts], "words array<string>")
    assert [(r.term, r.df, r.n) for r in E.vocabulary(df, "words", most, 3).collect()] == [(x, there[x], n[x]) for x in kept]
    pairs = E._term_counts(kept[:2], kept[:3])  # only pairs of known words leave a task
    told = df.mapInArrow(pairs, "term string, df long, n long").collect()
    assert all(r.term.split(" ")[0] in kept[:2] and r.term.split(" ")[-1] in kept[:3] and " " in r.term for r in told)
