"""A run scores every row, whatever its key columns hold."""

import numpy as np
import pytest

from anomspark.engine import run
from anomspark.plans.ordering import ROW_NAME, with_row_id

SCHEMA = "i int, k string, a double, b double, c string"


def table():
    r = np.random.default_rng(4)
    rows = []
    for i in range(240):
        key = None if i % 5 == 0 else "hot" if i % 3 else f"k{i}"
        rows.append((i, key, float(np.round(r.normal(), 1)), float(np.round(r.normal() * 9)), "xyz"[i % 3]))
    return rows


def ecod(x):
    le = (x[None] <= x[:, None]).sum(1) / len(x)
    ge = (x[None] >= x[:, None]).sum(1) / len(x)
    skew = np.sign(((x - x.mean(0)) ** 3).sum(0))
    left, right = -np.log(le), -np.log(ge)
    return np.where(skew == 0, left + right, np.maximum(left, right)).sum(1)


@pytest.mark.parametrize("key", [["k"], ["k", "c"], []])
def test_rows_in_are_rows_out(spark, key):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    res = run(df, key=key, order_by=["i"], detectors=["ecod", "lof"])
    out = res.result.toPandas().sort_values("row_id").reset_index(drop=True)
    assert list(out.columns[:2 + len(key)]) == ["row_id", *key, "anomaly_score"]
    assert out.row_id.tolist() == list(range(240))
    for j, k in enumerate(key):
        assert [x or None for x in out[k]] == [r[{"k": 1, "c": 4}[k]] for r in rows]
    x = res.features.toPandas().sort_values(ROW_NAME).drop(columns=[ROW_NAME]).to_numpy(float)
    raw = ecod(x)
    assert np.allclose(out.score_ecod, (raw - raw.min()) / (raw.max() - raw.min()))
    assert np.allclose(out.anomaly_score, (out.score_ecod + out.score_lof) / 2)
    assert res.summary().first()["rows"] == 240
    assert {r["detector"] for r in res.detector_figures().collect()} == {"ecod", "lof"}


def test_key_columns_are_features_unless_id_or_label(spark):
    df = spark.createDataFrame(table(), SCHEMA).select("a", "b", "c")
    res = run(df, key=["c"], detectors=["ecod"])
    assert {"c_x", "c_y", "c_z"} <= set(res.spec.feature_names)
    assert res.result.count() == 240 and res.result.columns[:2] == ["row_id", "c"]


def test_all_rows_alike_and_key_named_row_id(spark):
    df = spark.createDataFrame([(1, 2.0, "a")] * 30 + [(2, 3.0, "b")], "row_id int, x double, s string")
    res = run(df, key=["row_id"], detectors=["ecod"])
    assert res.result.columns[:2] == ["_row_id", "row_id"] and res.result.count() == 31


def test_row_ids_are_contiguous_in_scan_order(spark):
    df = spark.range(0, 1000, 1, 7)
    out = with_row_id(df).collect()
    assert sorted(r[ROW_NAME] for r in out) == list(range(1000))
    assert all(r["id"] == r[ROW_NAME] for r in out)
    assert with_row_id(df.where("id < 0")).count() == 0


def test_fill_by_order_is_an_option_of_a_run(spark):
    rows = [(f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", None if i % 4 == 3 else float(i // 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "ts string, x double").selectExpr("cast(ts as timestamp) as ts", "x")
    got = {}
    for flag in (False, True):
        res = run(df, order_by=["ts"], detectors=["ecod"], fill_by_order=flag)
        mid, scale = res.spec.scaled["x"]
        f = res.features.toPandas().sort_values(ROW_NAME)
        got[flag] = (f["x"].to_numpy() * scale + mid).round(3)
    assert got[True][3] == 0.0 and got[True][7] == 1.0  # from the row before
    assert got[False][3] == got[False][7] == 24.5  # the median
