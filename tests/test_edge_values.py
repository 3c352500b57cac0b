"""Values and shapes that rules must not trip over."""

from __future__ import annotations

import datetime as dt

from anomspark.operators import temporal as TM
from anomspark.operators.histogram import value_histogram
from anomspark.operators.profile import profile


def test_even_steps_below_a_second_are_regular(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(microseconds=100_000 * i),) for i in range(300)]
    st = TM.regularity_stats(spark.createDataFrame(rows, "t timestamp"), "t", True).first()
    assert st["min_pos_gap"] == st["max_gap"] == 0.1
    assert TM.regularity_label(st) == "regular"


def test_signed_zeros_are_one_value(spark):
    for kind in ("double", "float"):
        df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], f"x {kind}")
        got = {r["value"]: r["cnt"] for r in value_histogram(df, ["x"]).collect()}
        assert got == {"0.0": 2, "1.5": 1}


def test_profile_of_empty_continuous_column(spark):
    rows = [(f"name {i % 7}", None) for i in range(120)]
    p = profile(spark.createDataFrame(rows, "k string, year double"))
    assert p.column_cardinality == {"k": 7, "year": 0}
    assert p.trend_cols == []


def test_profile_counts_nan_as_missing_and_keeps_row_names(spark):
    rows = [(float("nan") if i % 2 else i * 1.5, i) for i in range(100)]
    p = profile(spark.createDataFrame(rows, "x double, _row_total long"))
    assert p.missing_data_ratio == 0.25
    assert set(p.column_cardinality) == {"x", "_row_total"}
