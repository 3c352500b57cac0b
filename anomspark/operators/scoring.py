"""Post-processing (H1-H8): normalise, ensemble, embed, threshold, summarise."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomspark.operators.partials import tree_sum
from anomspark.plans.ordering import c


def minmax(scores: DataFrame, col: str = "score", out: str | None = None) -> DataFrame:
    """H1: (s - min) / (max - min); constant scores map to 0.0."""
    out = out or col
    mn, mx = scores.agg(F.min(col), F.max(col)).first()
    if mn is None or mx is None or mx == mn:
        norm = F.lit(0.0)
    else:
        norm = (F.col(col) - F.lit(float(mn))) / F.lit(float(mx - mn))
    others = [c(x) for x in scores.columns if x != col]
    return scores.select(*others, norm.alias(out))


def ensemble(scores: dict[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """H4: one column ``score_<detector>`` per detector and their unweighted mean.

    Scores are stacked long and pivoted back in one aggregation on the key (one
    shuffle), instead of one join per detector.
    """
    key = list(key)
    names = list(scores)
    stacked = None
    for name, df in scores.items():
        part = df.select(*[c(k) for k in key], F.lit(name).alias("detector"), F.col("score").cast("double").alias("score"))
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = stacked.groupBy(*[c(k) for k in key]).pivot("detector", names).agg(F.first("score"))
    for n in names:
        wide = wide.withColumnRenamed(n, f"score_{n}")
    cols = [F.col(f"score_{n}") for n in names]
    mean = sum(cols, F.lit(0.0)) / F.lit(float(len(names)))
    return wide.withColumn("anomaly_score", mean)


def three_sigma(scored: DataFrame, col: str = "anomaly_score") -> DataFrame:
    """H6: flag rows with score >= mean + 3 * population sd."""
    thr = scored.agg(F.avg(col) + F.lit(3.0) * F.stddev_pop(col)).first()[0]
    return scored.withColumn("is_anomaly", F.col(col) >= F.lit(thr))


def score_summary(scored: DataFrame, col: str = "anomaly_score") -> DataFrame:
    """H7: rows, mean, population sd, threshold, anomaly count and percent."""
    thr = scored.agg(F.avg(col) + F.lit(3.0) * F.stddev_pop(col)).first()[0]
    out = scored.agg(F.count(col).alias("rows"), F.avg(col).alias("mean_score"),
                     F.stddev_pop(col).alias("std_score"),
                     F.count_if(F.col(col) >= F.lit(thr)).alias("anomalies"))
    return out.select("rows", "mean_score", "std_score",
                      (F.col("mean_score") + F.lit(3.0) * F.col("std_score")).alias("threshold"),
                      "anomalies", (F.col("anomalies") * 100.0 / F.col("rows")).alias("anomaly_pct"))


def detector_summary(scores: dict[str, DataFrame], embedding_dims: dict[str, int]) -> DataFrame:
    """H8: mean normalised score and embedding size per detector."""
    parts = None
    for name, df in scores.items():
        p = df.agg(F.avg("score").alias("mean_score")).select(
            F.lit(name).alias("detector"), "mean_score",
            F.lit(int(embedding_dims.get(name, 0))).alias("embedding_dim"))
        parts = p if parts is None else parts.unionByName(p)
    return parts


# ---------------------------------------------------------------------------
# H2: PCA embedding.  The moments are added up by a tree of tasks, so the driver gets one row of
# d + d^2 numbers (bounded by the feature count) however many partitions there are; the
# eigen-decomposition of that d x d matrix runs there; the projection is a plain select.
# ---------------------------------------------------------------------------

def moments(features: DataFrame, names: Sequence[str]):
    """(n, column sums, X'X) of the feature columns."""
    names = list(names)
    d = len(names)
    vec = features.select(F.array(*[F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in names]).alias("x"))

    def partial(batches):
        n, total = 0, np.zeros(d + d * d)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            n += len(x)
            total[:d] += x.sum(axis=0)
            total[d:] += (x.T @ x).ravel()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "v"])

    n, total = tree_sum(vec.mapInArrow(partial, "n long, v array<double>")) or (0, np.zeros(d + d * d))
    return n, total[:d], total[d:].reshape(d, d)


def pca_fit(features: DataFrame, names: Sequence[str], k: int):
    names = list(names)
    d = len(names)
    n, s1, s2 = moments(features, names)
    mean = s1 / max(n, 1)
    cov = (s2 - n * np.outer(mean, mean)) / max(n - 1, 1)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    comps = vecs[:, order].T
    k = max(1, min(k, d, n))
    comps = comps[:k]
    for r in range(k):  # sign: largest-magnitude loading positive
        if comps[r, np.argmax(np.abs(comps[r]))] < 0:
            comps[r] = -comps[r]
    return mean, comps


def pca_embedding(features: DataFrame, key: Sequence[str], names: Sequence[str], k: int = 16) -> DataFrame:
    """(key..., embedding_0..embedding_{k-1}) from centred PCA."""
    mean, comps = pca_fit(features, names, k)
    cols = []
    for r in range(comps.shape[0]):
        terms = [(c(n).cast("double") - F.lit(float(mean[i]))) * F.lit(float(comps[r, i]))
                 for i, n in enumerate(names)]
        cols.append(sum(terms, F.lit(0.0)).alias(f"embedding_{r}"))
    return features.select(*[c(x) for x in key], *cols)
