"""Registered queries of the reference's operators run on the small tables, and agree with their SQL twins."""

import glob
import json
import os

import duckdb
import pandas as pd
import pytest

from listinglens.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def cells(frame):
    out = []
    for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else float(v) if isinstance(v, float) else str(v) for v in row))
    return sorted(out, key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)


@pytest.mark.parametrize("name", ["m06_vector_reducer", "m07_fuse_blocks", "m08_candidates", "m12_refit_and_test", "m13_matched_baseline", "m15_ablation", "m21_early_stopping", "m24_batch_score", "a20_classify_tables", "f11_truncated_svd", "m16_ablation_predictions", "a22_profile_tables", "s03_catalog", "r17_score_report", "m11_multimodal_search", "m17_importance", "a19_detect_roles", "f12_component_tokens"])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["n_name", "n", "mae", "rmse"]


def test_report_adds_up(spark, sf):
    """The factors of a price add up to its distance from the price of mean features, and every part of the report is there."""
    rows = [r.asDict() for r in QUERIES["r17_score_report"](spark, sf).collect()]
    assert rows and all(r["low"] <= r["prediction"] <= r["high"] and r["label"] for r in rows)
    base = [r["prediction"] - sum(f["score"] for f in json.loads(r["factors"])) for r in rows]
    assert base == pytest.approx([base[0]] * len(base), abs=0.02)
    assert all(1 <= len(json.loads(r["similar"])) <= 5 for r in rows if r["similar"])


@pytest.mark.parametrize("name", ["r06_distance_score", "r09_comparable_rows"])
def test_no_task_holds_all_distances(spark, sf, name):
    """A percentile aggregate keeps every distinct distance of all pairs in one buffer."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
