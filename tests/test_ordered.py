"""Scale helpers: contiguous index, prefix sums, block + halo equals one window."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from anomspark.operators import temporal as TM
from anomspark.plans.ordering import group_index, group_prefix_sum, with_halo


def test_group_index_is_contiguous(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    out = group_index(df, ["k"], ["g"], "idx", num_partitions=7).toPandas()
    for _, grp in out.groupby("g"):
        grp = grp.sort_values("k")
        assert list(grp["idx"]) == list(range(len(grp)))


def test_prefix_sum_matches_cumsum(spark):
    pdf = pd.DataFrame({"g": np.repeat(["a", "b", "c"], 400), "v": np.tile(np.arange(400), 3),
                        "w": np.random.default_rng(0).integers(1, 9, 1200)})
    out = group_prefix_sum(spark.createDataFrame(pdf), ["v"], "w", "g", num_partitions=5).toPandas()
    exp = pdf.sort_values(["g", "v"]).assign(cum=lambda d: d.groupby("g")["w"].cumsum())
    m = out.merge(exp, on=["g", "v"])
    assert (m["cum_x"] == m["cum_y"]).all()


def test_halo_equals_single_window(spark, ):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    long = TM.series_long(ev, ["value"], ["event_id"])
    small = TM.rolling_trend(long, block_rows=100).collect()[0]
    big = TM.rolling_trend(long).collect()[0]
    assert small["var_rm"] == pytest.approx(big["var_rm"], rel=1e-9)
    framed = with_halo(long, "idx", 19, 100)
    w = Window.partitionBy("column", "_blk").orderBy("idx")
    blocked = framed.select("idx", F.avg("x").over(w.rowsBetween(-19, 0)).alias("rm"), "_own").where("_own")
    single = long.select("idx", F.avg("x").over(Window.orderBy("idx").rowsBetween(-19, 0)).alias("rm2"))
    j = blocked.join(single, "idx").toPandas()
    assert len(j) == 10000 and np.allclose(j["rm"], j["rm2"])


def test_lag_autocorr_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=300))
    df = spark.createDataFrame(pd.DataFrame({"i": range(300), "x": x}))
    long = TM.series_long(df, ["x"], ["i"])
    r = {row["lag"]: row["autocorr"] for row in TM.lag_autocorr(long, [1, 7], block_rows=64).collect()}
    s = pd.Series(x)
    assert r[1] == pytest.approx(s.autocorr(1), abs=1e-9)
    assert r[7] == pytest.approx(s.autocorr(7), abs=1e-9)


def test_acf_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.sin(np.arange(400) / 5.0) + rng.normal(scale=0.1, size=400)
    df = spark.createDataFrame(pd.DataFrame({"i": range(400), "x": x}))
    long = TM.series_long(df, ["x"], ["i"])
    got = {r["lag"]: r["acf"] for r in TM.acf(long, 40, 2, block_rows=128).collect()}
    d = x - x.mean()
    for k in (1, 5, 17, 40):
        assert got[k] == pytest.approx((d[k:] * d[:-k]).sum() / (d * d).sum(), abs=1e-9)


def test_regularity(spark):
    base = pd.Timestamp("2024-01-01")
    eq = [base + pd.Timedelta(minutes=i) for i in range(50)]
    near = [base + pd.Timedelta(seconds=60 * i + (0.5 if i % 2 else 0)) for i in range(50)]
    rnd = [base + pd.Timedelta(seconds=float(s)) for s in np.cumsum(np.random.default_rng(3).exponential(60, 50))]
    out = []
    for ts in (eq, near, rnd):
        df = spark.createDataFrame(pd.DataFrame({"ts": ts}))
        out.append(TM.regularity_label(TM.regularity_stats(df, "ts", True).first()))
    assert out == ["regular", "near_regular", "irregular"]


def test_adf_matches_ols(spark):
    rng = np.random.default_rng(4)
    x = np.zeros(300)
    for t in range(1, 300):
        x[t] = 0.5 * x[t - 1] + rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"i": range(300), "x": x}))
    res = TM.adf_test(TM.series_long(df, ["x"], ["i"]), block_rows=100)[0]
    p = res["usedlag"]
    dx = np.diff(x)
    rows = range(p + 1, len(x))
    X = np.array([[1.0, x[t - 1]] + [dx[t - 1 - k] for k in range(1, p + 1)] for t in rows])
    y = np.array([dx[t - 1] for t in rows])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    s2 = resid @ resid / (len(y) - X.shape[1])
    se = np.sqrt(s2 * np.linalg.inv(X.T @ X)[1, 1])
    assert res["adf_stat"] == pytest.approx(beta[1] / se, rel=1e-6)
    assert res["stationary"]


@pytest.mark.parametrize("n, big_p", [(9, 2), (40, 7), (200, 15)])
def test_lag_sums_rebuild_every_gram_matrix(n, big_p):
    y = np.cumsum(np.random.default_rng(n).normal(size=n))
    lags: dict = {}
    for lo in range(0, n, 17):  # blocks with a halo
        at = np.arange(max(0, lo - big_p - 1), min(n, lo + 17))
        part = TM._lag_sums(big_p)(pd.DataFrame({"column": "x", "idx": at, "y": y[at], "_own": at >= lo}))
        for r in part.itertuples():
            a, b = lags.get(r.lag, (0.0, 0.0))
            lags[r.lag] = (a + r.a, b + r.b)
    sums = TM.LagSums(n, big_p, lags, y[:big_p + 2], y[max(0, n - big_p - 2):])
    d = np.diff(y, prepend=np.nan)
    for p in range(big_p + 1):
        for start in {p + 1, big_p + 1}:
            t = np.arange(start, n)
            z = np.column_stack([np.ones(len(t)), y[t - 1], *[d[t - i] for i in range(1, p + 1)], d[t]])
            assert np.allclose(sums.gram(start, p), z.T @ z, rtol=1e-9, atol=1e-9)


def test_adf_of_blocks_and_of_several_columns(spark):
    r = np.random.default_rng(6)
    walk, noise = np.cumsum(r.normal(size=3000)), r.normal(size=700)
    rows = [(i, float(walk[i]), float(noise[i]) if i < 700 else None) for i in range(3000)]
    long = TM.series_long(spark.createDataFrame(rows, "i int, w double, e double"), ["w", "e"], ["i"])
    whole = {x["column"]: x for x in TM.adf_test(long)}
    parts = {x["column"]: x for x in TM.adf_test(long, block_rows=64)}
    assert whole["e"]["stationary"] and not whole["w"]["stationary"] and (whole["w"]["n"], whole["e"]["n"]) == (3000, 700)
    for k in whole:
        assert parts[k]["usedlag"] == whole[k]["usedlag"]
        assert parts[k]["adf_stat"] == pytest.approx(whole[k]["adf_stat"], rel=1e-9)


def test_group_index_counts_null_as_a_group(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(60)], "k int, g string")
    out = group_index(df, ["k"], ["g"], "idx", num_partitions=3).collect()
    for g in (None, "a"):
        assert sorted(r["idx"] for r in out if r["g"] == g) == list(range(sum(r["g"] == g for r in out)))


def test_adf_needs_no_linear_algebra_library(monkeypatch):
    """Profiles of long series (many lags) stood still in ``numpy.linalg.inv`` on the driver."""
    import numpy as np

    from anomspark.operators import temporal as TM
    rng = np.random.default_rng(3)
    a = rng.normal(size=(400, 9))
    g = a.T @ a
    want = [np.linalg.lstsq(a[:, :k], a[:, 8], rcond=None)[1][0] for k in range(1, 9)]
    x = np.linalg.solve(g[:8, :8], np.stack([g[:8, 8], np.eye(8)[0]], axis=1))
    y = np.cumsum(rng.normal(size=300))
    d = np.diff(y, prepend=y[0])
    p = TM.adf_maxlag(300)
    lags = {h: (d[1 + h:] @ d[1:300 - h], y[h:299] @ d[1:300 - h]) for h in range(p + 1)}
    lags[-1] = (y[:-1].sum(), y[:-1] @ y[:-1])
    monkeypatch.setattr(np, "linalg", None)
    assert np.allclose(TM._nested_ssr(g, list(range(9))), want)
    assert np.allclose(TM._solved(g[:8, :8], np.stack([g[:8, 8], np.eye(8)[0]], axis=1)), x)
    assert TM._solved(np.zeros((2, 2)), np.ones((2, 1))) is None
    got = TM._adf_from_sums("y", 300, TM.LagSums(300, p, lags, y[:p + 2], y[300 - p - 2:]))
    assert got["usedlag"] is not None and got["adf_stat"] is not None
