"""Ordered / time-series statistics (D1-D9) as windowed Spark jobs.

Every test works on the *non-null* values of a column in row order, re-indexed
0..n-1 (what a dropped-NA pandas series is).  The long frame ``(column, idx, x)`` is
built once with :func:`series_long`; lags and rolling windows run per block with a halo
(:func:`anomspark.plans.ordering.with_halo`), so no window holds more than
``block_rows + halo`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anomspark.operators.histogram import long_values
from anomspark.plans.ordering import DEFAULT_BLOCK_ROWS, group_index, with_halo

# Fixed values of the temporal tests.
ACF_MAX_LAGS = 40
COLLECTIVE_ACF_LAGS = 10
SEASONAL_LAGS = [7, 12, 24]
ADF_CRITICAL_5PCT = -2.86154  # asymptotic 5 % Dickey-Fuller critical value, constant term


def series_long(df: DataFrame, columns: Sequence[str], order_cols: Sequence[str],
                value_type: str = "double") -> DataFrame:
    """(column, idx, x): non-null values of each column, indexed in row order."""
    order_cols = list(order_cols)
    long = long_values(df, columns, value_type, keep=order_cols).withColumnRenamed("value", "x")
    return group_index(long, order_cols, ["column"], "idx").select("column", "idx", "x")


def _blocked(long: DataFrame, halo: int, block_rows: int):
    framed = with_halo(long, "idx", halo, block_rows)
    w = Window.partitionBy("column", "_blk").orderBy("idx")
    return framed, w


def lag_autocorr(long: DataFrame, lags: Sequence[int], block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Pearson r of (x_t, x_{t-k}) per column and lag -> (column, lag, autocorr, n)."""
    lags = list(lags)
    framed, w = _blocked(long, max(lags), block_rows)
    cols = [F.lag("x", k).over(w).alias(f"_l{k}") for k in lags]
    lagged = framed.select("column", "idx", "x", "_own", *cols).where("_own")
    agg = lagged.groupBy("column").agg(
        F.count("x").alias("n"),
        *[F.corr("x", f"_l{k}").alias(f"r{k}") for k in lags])
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("autocorr"))
                                  for k in lags]))
    return agg.select("column", "n", stacked.alias("s")).select(
        "column", "s.lag", F.nanvl("s.autocorr", F.lit(None).cast("double")).alias("autocorr"), "n")


def acf(long: DataFrame, max_lags: int, cap_half: int = 2,
        block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Biased ACF per column for lags 1..min(max_lags, n // cap_half).

    Returns (column, n, lag, acf).  Lag products use the column mean (one small table,
    one row per column) and run per block with a halo of ``max_lags`` rows.
    """
    stats = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("m"))
    framed, w = _blocked(long, max_lags, block_rows)
    framed = framed.join(F.broadcast(stats), "column")
    dev = F.col("x") - F.col("m")
    lagged = framed.select("column", "_own", "n", dev.alias("d"),
                           *[(F.lag("x", k).over(w) - F.col("m")).alias(f"_l{k}")
                             for k in range(1, max_lags + 1)]).where("_own")
    agg = lagged.groupBy("column", "n").agg(
        F.sum(F.col("d") * F.col("d")).alias("den"),
        *[F.sum(F.col("d") * F.col(f"_l{k}")).alias(f"p{k}") for k in range(1, max_lags + 1)])
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"p{k}").alias("num"))
                                  for k in range(1, max_lags + 1)]))
    out = agg.select("column", "n", "den", stacked.alias("s")).select(
        "column", "n", "s.lag", "s.num", "den")
    out = out.where(F.col("lag") <= F.least(F.lit(max_lags), F.floor(F.col("n") / cap_half)))
    return out.select("column", "n", "lag",
                      F.try_divide(F.coalesce("num", F.lit(0.0)), F.col("den")).alias("acf"))


def acf_flags(acf_df: DataFrame) -> DataFrame:
    """Trend (acf1 > .7 and acf5 > .4) and seasonality (interior local peak > .3)."""
    arr = acf_df.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("a"))
    vals = F.transform("a", lambda s: s["acf"])
    # full ACF array with acf[0] = 1 prepended, as the library returns it
    full = F.concat(F.array(F.lit(1.0)), vals)
    n = F.size(full)
    trend = (n > 5) & (F.element_at(full, 2) > 0.7) & (F.element_at(full, 6) > 0.4)
    seas = F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), n - 2)),
                    lambda i: (i <= n - 2)
                    & (F.element_at(full, i + 1) > F.element_at(full, i))
                    & (F.element_at(full, i + 1) > F.element_at(full, i + 2))
                    & (F.element_at(full, i + 1) > 0.3))
    return arr.select("column", F.coalesce(trend, F.lit(False)).alias("has_trend"),
                      F.coalesce(seas, F.lit(False)).alias("has_seasonality"))


def split_variance(long: DataFrame) -> DataFrame:
    """Stationary if 0.5 < var(second half) / var(first half) < 2 (sample variances)."""
    n = long.groupBy("column").agg(F.count("x").alias("n"))
    j = long.join(F.broadcast(n), "column")
    first = F.col("idx") < F.floor(F.col("n") / 2)
    agg = j.groupBy("column", "n").agg(
        F.var_samp(F.when(first, F.col("x"))).alias("var1"),
        F.var_samp(F.when(~first, F.col("x"))).alias("var2"))
    ratio = F.try_divide(F.col("var2"), F.col("var1"))
    stat = (F.col("var1") > 0) & (ratio > 0.5) & (ratio < 2.0)
    return agg.select("column", "n", "var1", "var2", F.coalesce(stat, F.lit(False)).alias("stationary"))


def _per_window(long: DataFrame, window_of, build):
    """Run ``build(frame_of_columns, win)`` once per distinct window length.

    Window frames need literal bounds; the length depends on each column's count, so
    columns are grouped by it (one small count job; usually a single group)."""
    counts = long.groupBy("column").agg(F.count("x").alias("n")).collect()
    by_win: dict[int, list[str]] = {}
    for r in counts:
        by_win.setdefault(int(window_of(r["n"])), []).append(r["column"])
    parts = [build(long.where(F.col("column").isin(cols)), win) for win, cols in sorted(by_win.items() or [(1, [])])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rolling_trend(long: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS, max_window: int = 20) -> DataFrame:
    """Trend if var(rolling mean, window min(20, n // 5), full windows) > 0.5 var(x)."""
    def build(part: DataFrame, win: int) -> DataFrame:
        st = part.groupBy("column").agg(F.count("x").alias("n"), F.var_samp("x").alias("var_x"))
        if win < 1:
            return st.select("column", "n", F.lit(win).alias("win"), F.lit(None).cast("double").alias("var_rm"),
                             "var_x", F.lit(False).alias("trend"))
        framed, w = _blocked(part, win - 1, block_rows)
        rm = F.avg("x").over(w.rowsBetween(-(win - 1), 0))
        rolled = framed.select("column", "_own", "idx", rm.alias("rm")).where("_own")
        rolled = rolled.where(F.col("idx") >= win - 1)
        agg = rolled.groupBy("column").agg(F.var_samp("rm").alias("var_rm")).join(st, "column")
        return agg.select("column", "n", F.lit(win).alias("win"), "var_rm", "var_x",
                          F.coalesce(F.col("var_rm") > F.col("var_x") * 0.5, F.lit(False)).alias("trend"))
    return _per_window(long, lambda n: min(max_window, n // 5), build)


def lag_seasonality(long: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Seasonal if abs(lag-k autocorr) > 0.4 for k in 7, 12, 24 with k < n // 2."""
    ac = lag_autocorr(long, SEASONAL_LAGS, block_rows)
    ok = (F.col("lag") < F.floor(F.col("n") / 2)) & (F.abs(F.col("autocorr")) > 0.4)
    return ac.groupBy("column").agg(F.coalesce(F.max(ok), F.lit(False)).alias("seasonal"))


def global_local_z(long: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS, max_window: int = 50) -> DataFrame:
    """Global z (population sd + 1e-8) and trailing local z per value.

    Window = max(5, min(50, n // 20)), min one value; rolling sample sd, NULL -> 1e-8;
    a zero rolling sd gives no local z (0/0 in the reference).
    """
    def build(part: DataFrame, win: int) -> DataFrame:
        st = part.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mu"),
                                        F.stddev_pop("x").alias("sd"))
        framed, w = _blocked(part, win - 1, block_rows)
        frame = w.rowsBetween(-(win - 1), 0)
        framed = framed.select("column", "idx", "x", "_own", F.avg("x").over(frame).alias("rm"),
                               F.stddev_samp("x").over(frame).alias("rs")).where("_own")
        framed = framed.join(F.broadcast(st), "column")
        rsd = F.coalesce(F.nanvl("rs", F.lit(None).cast("double")), F.lit(1e-8))
        dev = F.abs(F.col("x") - F.col("rm"))
        local = F.when(rsd == 0, F.when(dev != 0, F.lit(float("inf")))).otherwise(dev / rsd)
        glob = F.abs((F.col("x") - F.col("mu")) / (F.col("sd") + F.lit(1e-8)))
        return framed.select("column", "idx", "x", "n", glob.alias("global_z"), local.alias("local_z"),
                             F.lit(win).alias("window"))
    return _per_window(long, lambda n: max(5, min(max_window, n // 20)), build)


def collective_test(long: DataFrame, dataset_is_time_series: bool = False,
                    block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """D9a-D9d per column: mean abs ACF (lags 1..min(10, n//4)), candidate share, verdict."""
    a = acf(long, COLLECTIVE_ACF_LAGS, cap_half=4, block_rows=block_rows)
    mean_acf = a.groupBy("column").agg(F.avg(F.abs("acf")).alias("mean_abs_acf"))
    z = global_local_z(long, block_rows)
    cand = z.groupBy("column", "n").agg(
        F.avg(((F.col("global_z") <= 3.0) & (F.col("local_z") > 3.0)).cast("double")).alias("candidate_ratio"))
    out = cand.join(mean_acf, "column", "left")
    verdict = ((F.col("n") >= 30)
               & ((F.coalesce(F.col("mean_abs_acf"), F.lit(0.0)) >= 0.25) | F.lit(dataset_is_time_series))
               & (F.col("candidate_ratio") > 0.01))
    return out.select("column", "n", "mean_abs_acf", "candidate_ratio",
                      F.coalesce(verdict, F.lit(False)).alias("collective"))


def regularity_stats(df: DataFrame, column: str, is_datetime: bool) -> DataFrame:
    """D1 for one column: gaps of the sorted non-null values (seconds for datetimes).

    Only the distinct values need an order: duplicates give zero gaps, so
    ``nunique(gaps) == 1`` iff all values are equal or the distinct values are evenly
    spaced without duplicates.  Returns one row: n, n_distinct, min_gap, max_gap,
    mean_gap, sd_gap over all n - 1 gaps.
    """
    v = F.col(f"`{column}`")
    num = F.unix_micros(v.cast("timestamp")) if is_datetime else v.cast("double")
    hist = (df.select(num.alias("v")).where(F.col("v").isNotNull())
            .groupBy("v").agg(F.count(F.lit(1)).alias("cnt")).withColumn("column", F.lit(column)))
    idx = group_index(hist, ["v"], ["column"], "i")
    nxt = idx.select("column", (F.col("i") - 1).alias("i"), F.col("v").alias("v_next"))
    gaps = idx.join(nxt, ["column", "i"], "left").select(
        "column", "cnt", ((F.col("v_next") - F.col("v")) / F.lit(1e6 if is_datetime else 1.0)).alias("g"))
    n = F.sum("cnt")
    n_dist = F.count(F.lit(1))
    agg = gaps.groupBy("column").agg(n.alias("n"), n_dist.alias("n_distinct"),
                                     F.min("g").alias("min_pos_gap"), F.max("g").alias("max_gap"),
                                     F.coalesce(F.sum("g"), F.lit(0.0)).alias("sum_g"))
    m = F.col("n") - 1
    agg = agg.withColumn("n_zero", F.col("n") - F.col("n_distinct")).withColumn(
        "mean_gap", F.try_divide(F.col("sum_g"), m))
    # second pass for the spread: sum of squared deviations over the distinct gaps, the
    # zero gaps contribute n_zero * mean^2
    dev = (gaps.join(F.broadcast(agg.select("column", "mean_gap")), "column")
           .groupBy("column").agg(F.sum(F.pow(F.col("g") - F.col("mean_gap"), 2)).alias("ss")))
    out = agg.join(dev, "column", "left")
    ss = F.coalesce(F.col("ss"), F.lit(0.0)) + F.col("n_zero") * F.col("mean_gap") * F.col("mean_gap")
    return out.select("column", "n", "n_distinct", "n_zero", "min_pos_gap", "max_gap", "mean_gap",
                      F.sqrt(F.try_divide(ss, m - 1)).alias("sd_gap"))


def regularity_label(row) -> str | None:
    """Map one :func:`regularity_stats` row to regular / near_regular / irregular."""
    if row is None or row["n"] is None or row["n"] < 3:
        return None
    if row["n_distinct"] == 1:
        return "regular"
    if row["n_zero"] == 0 and row["min_pos_gap"] == row["max_gap"]:
        return "regular"
    mean = row["mean_gap"]
    if mean is not None and mean != 0 and row["sd_gap"] is not None and row["sd_gap"] / mean < 0.1:
        return "near_regular"
    return "irregular"


# ---------------------------------------------------------------------------
# Augmented Dickey-Fuller (D4).  Every entry of the regressions' Gram matrices is a sum of products
# d_{t-i} d_{t-j} or y_{t-1} d_{t-j} over a range of t.  Over the whole series such a sum depends on j - i
# (or j) alone, so O(P) lag sums per column, added up in Spark, and the first and last P + 2 values give
# all of them; the small least-squares problems are solved on the driver.
# ---------------------------------------------------------------------------

def adf_maxlag(n: int) -> int:
    return int(min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25)))


ADF_BLOCK_ROWS = 1 << 17


def _lag_sums(big_p: int):
    """applyInPandas body: of one (column, block) group with a halo of P + 1 rows the sums over its own t >= 1 of
    ``a = d_t d_{t-h}`` and ``b = y_{t-1} d_{t-h}`` for h = 0..P, and of y_{t-1} and its square (lag -1)."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        y, idx = pdf["y"].to_numpy(dtype=float), pdf["idx"].to_numpy()
        at = np.flatnonzero(pdf["_own"].to_numpy(dtype=bool) & (idx >= 1))
        d = np.diff(y, prepend=y[:1])
        rows = []
        if len(at):
            lo, hi = at[0], at[-1] + 1  # own rows are consecutive
            before = y[lo - 1:hi - 1]
            rows.append((-1, before.sum(), before @ before))
            for h in range(min(big_p, int(idx[hi - 1]) - 1) + 1):
                first = max(lo, hi - 1 - (int(idx[hi - 1]) - 1 - h))  # t - h >= 1
                lagged = d[first - h:hi - h]
                rows.append((h, d[first:hi] @ lagged, before[first - lo:] @ lagged))
        out = pd.DataFrame(rows, columns=["lag", "a", "b"])
        out.insert(0, "column", pdf["column"].iloc[0])
        return out
    return fn


class LagSums:
    """Lag sums of one column and its first and last values; :meth:`gram` rebuilds Gram matrices."""

    def __init__(self, n: int, big_p: int, lags: dict[int, tuple[float, float]], head: np.ndarray, tail: np.ndarray):
        self.n, self.head, self.tail = n, head, tail  # y_0.. and ..y_{n-1}
        self.sum_y, self.sum_yy = lags.get(-1, (0.0, 0.0))
        self.dd, self.yd = (np.array([lags.get(h, (0.0, 0.0))[k] for h in range(big_p + 1)]) for k in (0, 1))

    def gram(self, start: int, p: int) -> np.ndarray:
        """Sums over t = start..n-1 (start > p) of products of 1, y_{t-1}, d_{t-1}..d_{t-p}, d_t."""
        y, z = self.head, self.tail
        d = np.diff(y, prepend=np.nan)           # d[s] = d_s
        e = np.diff(z)[::-1]                     # e[s] = d_{n-1-s}
        lag = np.zeros((p + 1, p + 1))
        for h in range(p + 1):
            first = np.concatenate(([0.0], np.cumsum(d[1 + h:start] * d[1:start - h])))  # to s = 1+h-1, 1+h, ..
            last = np.concatenate(([0.0], np.cumsum(e[:p - h] * e[h:p])))                # of the last 0, 1, .. values
            for i in range(p - h + 1):
                lag[i, i + h] = lag[i + h, i] = self.dd[h] - first[max(0, start - i - 1 - h)] - last[i]
        cross = np.array([self.yd[j] - y[j:start - 1] @ d[1:start - j] for j in range(p + 1)])
        level = np.array([z[len(z) - 1 - i] - y[start - i - 1] for i in range(p + 1)])
        one = self.sum_y - y[:start - 1].sum()
        g = np.zeros((p + 3, p + 3))
        order = [p + 2, *range(2, p + 2)]        # where d_t, d_{t-1}, .. stand
        g[np.ix_(order, order)] = lag
        g[1, order] = g[order, 1] = cross
        g[0, order] = g[order, 0] = level
        g[0, 0], g[0, 1], g[1, 0] = self.n - start, one, one
        g[1, 1] = self.sum_yy - y[:start - 1] @ y[:start - 1]
        return g


def adf_test(long: DataFrame, block_rows: int = ADF_BLOCK_ROWS):
    """D4 per column: tau statistic with the lag picked by AIC; stationary if tau is
    below the 5 % critical value.  Returns a list of dicts (one per column).

    Lag products are summed per (column, block) group with a halo of P + 1 rows in ``applyInPandas`` and
    then per column and lag by Spark; the driver gets O(P) numbers of a column (P grows as n^(1/4)).
    """
    stats = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("m"))
    counts = {r["column"]: r["n"] for r in stats.collect()}
    if not counts:
        return []
    big_p = max(max(adf_maxlag(n), 0) for n in counts.values())
    centred = long.join(F.broadcast(stats), "column").select("column", "idx", "n", (F.col("x") - F.col("m")).alias("y"))
    framed = with_halo(centred.drop("n"), "idx", big_p + 1, max(block_rows, big_p + 1))
    sums = (framed.groupBy("column", "_blk").applyInPandas(_lag_sums(big_p), "column string, lag long, a double, b double")
            .groupBy("column", "lag").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect())
    ends = centred.where((F.col("idx") <= big_p + 1) | (F.col("idx") >= F.col("n") - big_p - 2)).collect()
    lags: dict[str, dict[int, tuple[float, float]]] = {}
    for r in sums:
        lags.setdefault(r["column"], {})[r["lag"]] = (r["a"], r["b"])
    near: dict[str, dict[int, float]] = {}
    for r in ends:
        near.setdefault(r["column"], {})[r["idx"]] = r["y"]
    out = []
    for col, n in counts.items():
        y = near.get(col, {})
        head = np.array([y[i] for i in range(min(n, big_p + 2))])
        tail = np.array([y[i] for i in range(max(0, n - big_p - 2), n)])
        out.append(_adf_from_sums(col, n, LagSums(n, big_p, lags.get(col, {}), head, tail)))
    return out


def _nested_ssr(g: np.ndarray, order: list[int]) -> list[float]:
    """Residual sums of squares of the last column of ``order`` on the first 1, 2, ... others, by one elimination
    of the Gram matrix; shorter where a column depends on those before it.

    Element-wise on purpose: profiles of long series were seen to stand still in ``numpy.linalg.inv`` on the driver."""
    a = g[np.ix_(order, order)].astype(float)
    out = []
    for k in range(len(order) - 1):
        if a[k, k] <= 0:
            break
        a[k + 1:, k + 1:] -= np.multiply.outer(a[k + 1:, k] / a[k, k], a[k, k + 1:])
        out.append(max(float(a[-1, -1]), 0.0))
    return out


def _solved(a: np.ndarray, rhs: np.ndarray) -> np.ndarray | None:
    """Solution of the small system by elimination with row exchanges (element-wise, see above); None if singular."""
    m = np.concatenate([a, rhs], axis=1).astype(float)
    k = len(a)
    for i in range(k):
        at = i + int(np.argmax(np.abs(m[i:, i])))
        if m[at, i] == 0:
            return None
        m[[i, at]] = m[[at, i]]
        m[i + 1:, i:] -= np.multiply.outer(m[i + 1:, i] / m[i, i], m[i, i:])
    x = np.zeros(rhs.shape)
    for i in range(k - 1, -1, -1):
        x[i] = (m[i, k:] - (m[i, i + 1:k, None] * x[i + 1:]).sum(axis=0)) / m[i, i]
    return x


def _adf_from_sums(col: str, n: int, sums: LagSums) -> dict:
    res = {"column": col, "n": n, "usedlag": None, "adf_stat": None, "stationary": False}
    maxlag = adf_maxlag(n)
    if n < 4 or maxlag < 0:
        return res

    # AIC search on the common sample t >= maxlag + 1
    g_common = sums.gram(maxlag + 1, maxlag)
    target = maxlag + 2
    nobs = n - 1 - maxlag
    best = None
    ssrs = _nested_ssr(g_common, [*range(maxlag + 2), target]) if nobs > 0 else []
    for p, ssr in enumerate(ssrs[1:]):
        if ssr <= 0:
            continue
        llf = -nobs / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1)
        aic = -2 * llf + 2 * (p + 2)
        if best is None or aic < best[0]:
            best = (aic, p)
    if best is None:
        return res
    p = best[1]
    g = sums.gram(p + 1, p)
    nobs = n - 1 - p
    cols = [1, 0] + list(range(2, 2 + p))
    first = np.eye(len(cols))[:, :1]
    fit = _solved(g[np.ix_(cols, cols)], np.concatenate([g[cols, p + 2][:, None], first], axis=1))
    if fit is None or nobs - len(cols) <= 0:
        return res
    beta, inv = fit[:, 0], fit[:, 1]
    ssr = max(float(g[p + 2, p + 2] - (beta * g[cols, p + 2]).sum()), 0.0)
    sigma2 = ssr / (nobs - len(cols))
    se = math.sqrt(max(sigma2 * inv[0], 0.0))
    if se == 0:
        return res
    tau = beta[0] / se
    res.update(usedlag=p, adf_stat=float(tau), stationary=bool(tau < ADF_CRITICAL_5PCT))
    return res
