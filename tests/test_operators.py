"""Operators on small tables: rules, metamorphic properties, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from listinglens.operators import comparables as C
from listinglens.operators import confidence as Q
from listinglens.operators import features as E
from listinglens.operators import relate as R
from listinglens.operators import stats as S
from listinglens.operators import vectors as V
from listinglens.session import nan_to_null, require_columns
from listinglens.sources import tables as A


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="a, b"):
        require_columns(spark.range(1), ["b", "a", "id"])


def test_nan_becomes_null(spark):
    assert nan_to_null(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first()["a"] is None


def test_split_is_disjoint_and_order_free(spark):
    ids = spark.range(2000)
    a = {r["id"]: r["p"] for r in ids.select("id", R.split_label(F.col("id")).alias("p")).collect()}
    b = {r["id"]: r["p"] for r in ids.orderBy(F.desc("id")).select("id", R.split_label(F.col("id")).alias("p")).collect()}
    assert a == b
    assert 0.65 < sum(p == "train" for p in a.values()) / 2000 < 0.75


def test_helper_names_do_not_clash(spark):
    df = spark.createDataFrame([("a", 1, 5, 6, 7), ("a", 2, 5, 6, 7)], "g string, v int, rank int, _rank int, row int")
    assert [tuple(r) for r in S.best_per_group(df, "g", ["v"]).collect()] == [("a", 1, 5, 6, 7)]
    assert [tuple(r) for r in R.dedup_last(df, "g", ["v"]).collect()] == [("a", 2, 5, 6, 7)]
    assert sorted(tuple(r) for r in V.rank_for_caps(df, "g", "v", [1, 2]).collect()) == [("a", 1, 5, 6, 7, 1), ("a", 1, 5, 6, 7, 2), ("a", 2, 5, 6, 7, 2)]
    hot = E.one_hot(df, df.withColumn("place", F.lit(9)).withColumn("_n", F.lit(8)), "g")
    assert [(r.place, r._n, list(r.g_hot)) for r in hot.collect()] == [(9, 8, [1.0])] * 2


def test_corrupt_payloads_are_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": \n')
    rows = A.read_payloads(spark, str(tmp_path), "a int", multi_line=False).cache()
    assert sorted((r.a, r._corrupt_record is None) for r in rows.collect() if r.a) == [(1, True)]
    assert rows.where("_corrupt_record is not null").count() == 1


def test_strict_lookup_fails_on_a_missing_key(spark):
    store = spark.createDataFrame([(1, "x")], "k int, v string")
    assert R.lookup_strict(store.select("k"), store, "k", "v").count() == 1
    with pytest.raises(Exception, match="no v for k 2"):
        R.lookup_strict(spark.createDataFrame([(2,)], "k int"), store, "k", "v").collect()


def test_empty_segment_has_no_row(spark):
    df = spark.createDataFrame([(10.0, 9.0, 8.0)], "y double, p double, q double")
    rows = S.segment_metrics(df, {"all": F.lit(True), "none": F.lit(False)}, "y", "q", "p").collect()
    assert [r.segment for r in rows] == ["all"]


def test_normalised_vectors_have_length_one(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    out = [r["n"] for r in df.select(V.norm(V.l2_normalize(F.col("v"))).alias("n")).collect()]
    assert out == pytest.approx([1.0, 0.0])


def test_knn_with_and_without_blocks(spark):
    rows = [(i, [float(i), 0.0], i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, v array<double>, b int")
    near = {(r["query"], r["id"]) for r in V.knn(df.where("id = 4"), df, 2, "id", "v").collect()}
    assert near == {(4, 3), (4, 5)}
    near = {(r["query"], r["id"]) for r in V.knn(df.where("id = 4"), df, 2, "id", "v", ["b"]).collect()}
    assert near == {(4, 2), (4, 6)}


LISTING = "listing_id int, district string, neighborhood string, rooms double, m2_gross double, building_age double, floor double, heating_type string, price double"


def pairs(spark, query, candidates):
    q = spark.createDataFrame([query], LISTING).select(F.struct("*").alias("q"))
    c = spark.createDataFrame(candidates, LISTING).select(F.struct("*").alias("c"))
    return q.join(c, F.lit(True)).withColumns({"price": F.col("q.price"), "knn_score": F.lit(90)})


def test_comparables_prefer_strict_and_drop_repeats(spark):
    query = (1, "d", "n", 3.0, 100.0, 5.0, 2.0, "gas", 1000.0)
    found = pairs(
        spark,
        query,
        [
            (2, "d", "n", 3.0, 100.0, 5.0, 2.0, "gas", 1000.0),
            (3, "d", "n", 3.0, 100.0, 5.0, 2.0, "gas", 1000.0),  # the same signature as 2
            (4, "d", "m", 3.0, 105.0, 5.0, 2.0, "gas", 1100.0),
            (5, "d", "m", 9.0, 105.0, 5.0, 2.0, "gas", 1100.0),  # rooms too far
            (6, "d", "k", 4.0, 90.0, 6.0, 2.0, "gas", 900.0),
        ],
    )
    assert [r.listing_id for r in C.comparables(found).orderBy("place").collect()] == [2, 4, 6]


def test_blank_sides_are_the_same_but_unknown(spark):
    row = spark.createDataFrame([(None, " ")], "a string, b string").select(C.same_text(F.col("a"), F.col("b")).alias("same"), C.cat_sim(F.col("a"), F.col("b")).alias("sim")).first()
    assert (row.same, row.sim) == (True, None)


def test_visual_scores(spark):
    df = spark.createDataFrame([(n,) for n in (0, 3, 4, 8, 9, 10, 16, 17)], "n int")
    assert [r.s for r in df.select(Q.visual_score(F.col("n")).alias("s")).collect()] == [20, 65, 70, 86, 88, 89, 98, 98]


@pytest.mark.parametrize(
    ("scores", "label", "expected"),
    [
        ((100, 90, 85, 70, 50), "Yüksek", [("completeness", 0), ("visual", 0), ("location", 0)]),
        ((50, 60, 70, 90, 90), "Düşük", [("completeness", 2), ("visual", 2), ("location", 1)]),
        ((90, 60, 65, 80, 70), "Orta", [("completeness", 0), ("visual", 2), ("location", 2)]),
    ],
)
def test_reasons_follow_the_label(spark, scores, label, expected):
    df = spark.createDataFrame([(*scores, label)], ", ".join(f"{n} int" for n in Q.WEIGHTS) + ", label string")
    found = df.select(Q.confidence_reasons(F.col("label")).alias("r")).first()["r"]
    assert found == [Q.REASONS[n][i] for n, i in expected]


def test_model_bundle_needs_its_keys(spark):
    from listinglens.operators import models as M

    with pytest.raises(ValueError, match="missing columns"):
        M.save_bundle(None, {"model": "x"}, "/nowhere", spark)


def test_encoder_sees_small_lists_and_no_nulls(spark):
    def load():
        def encode(values):
            assert len(values) <= 2 and None not in values
            return [[len(v), 1] for v in values]

        return encode

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "abc"), (4, "ab"), (5, "")], "k int, v string").coalesce(1)
    found = {r.k: r.e for r in df.select("k", V.encode(F.col("v"), load, rows=2).alias("e")).collect()}
    assert found == {1: [1.0, 1.0], 2: None, 3: [3.0, 1.0], 4: [2.0, 1.0], 5: [0.0, 1.0]}
