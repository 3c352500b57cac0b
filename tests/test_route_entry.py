"""Routing table, end-to-end run, sources, and a DuckDB oracle subset."""

import duckdb
import pytest

from anomspark.plans import route as RT


def _profile_row(**kw):
    base = dict(total_rows=100, total_columns=3, dataset_type="tabular", missing_data_ratio=0.0,
                feature_to_sample_ratio=0.03, high_dimensionality=False, continuous_cols=["a"],
                categorical_cols=[], timestamp_cols=[], text_cols=[], id_cols=[], temporal_candidate_cols=[],
                label_cols=[], numeric_ratio=0.3, categorical_ratio=0.0, text_ratio=0.0, id_ratio=0.0,
                column_cardinality={}, column_cardinality_ratio={}, high_cardinality_cols=[],
                is_time_series=False, temporal_regularity="none", temporal_min={}, temporal_max={},
                observations_per_entity=0.0, anomaly_characteristics=["point"], supervision_level="unsupervised",
                imbalance_ratio=0.0, has_trend=False, has_seasonality=False, is_stationary=False, trend_cols=[],
                seasonality_cols=[], stationary_cols=[])
    base.update(kw)
    return base


@pytest.mark.parametrize("kw,models", [
    (dict(), ["isolation_forest", "ecod", "lof", "autoencoder"]),
    (dict(high_dimensionality=True), ["autoencoder", "vae", "isolation_forest", "ecod"]),
    (dict(anomaly_characteristics=["collective", "point"]),
     ["sliding_window_isolation_forest", "isolation_forest", "ecod", "lof", "autoencoder"]),
    (dict(dataset_type="time_series"), ["lstm_autoencoder", "anomaly_transformer", "matrix_profile"]),
    (dict(dataset_type="text"), ["text_embedding", "log_anomaly_detector"]),
    (dict(dataset_type="graph"), ["graph_anomaly_detector"]),
    (dict(supervision_level="supervised"), ["xgboost", "random_forest", "lightgbm"]),
    (dict(supervision_level="supervised", anomaly_characteristics=["collective"]), ["lstm_classifier", "xgboost_with_lags"]),
    (dict(supervision_level="semi-supervised"), ["deep_svdd", "one_class_svm"]),
    (dict(supervision_level="semi-supervised", dataset_type="time_series"), ["deep_svdd_sequential", "one_class_svm"]),
])
def test_route_table(spark, kw, models):
    from anomspark.operators.profile import PROFILE_SCHEMA
    df = spark.createDataFrame([_profile_row(**kw)], PROFILE_SCHEMA)
    row = RT.route_df(df).first()
    assert row["recommended_models"] == models
    assert row["detectors"] == RT.resolve_detectors(models)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    cols = df.columns
    assert cols[:2] == ["row_id", "event_id"] and "anomaly_score" in cols and cols[-1] == "is_anomaly"
    assert df.count() == 1000


def test_csv_roundtrip(spark, tmp_path):
    from anomspark.sources.io import read_table
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.write.option("header", "true").csv(str(tmp_path / "ev"))
    back = read_table(spark, str(tmp_path / "ev"), fmt="csv")
    types = dict(back.dtypes)
    assert types["ts"] == "string" and types["value"] == "double" and back.count() == 1000


ORACLE_KEYS = ["column_roles", "missing_ratio", "class_balance", "ecod", "ensemble", "lag_autocorr",
               "acf_values", "robust_scale", "tfidf", "lof"]


@pytest.mark.parametrize("name", ORACLE_KEYS)
def test_oracle_sf0001(spark, name):
    import math

    from __spark_entry__ import oracle_sql, queries
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")

    def norm(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    sdf = queries()[name](spark, sf)
    cols = sorted(sdf.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    res = con.execute(oracle_sql()[name])
    names = [d[0] for d in res.description]
    exp = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted(names) == cols
    assert got == exp
