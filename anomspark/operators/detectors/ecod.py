"""Empirical-CDF outlier score (Li et al. 2022), exact and SQL-checkable.

For every feature f and value v: left tail ``-ln(#{x <= v} / n)``, right tail
``-ln(#{x >= v} / n)``; the per-feature score is the larger tail, or their sum when
the feature's skewness is zero; the row score is the sum over features.  Ranks come
from the per-feature value histogram and a distributed prefix sum, so no feature is
ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomspark.operators.histogram import long_values, with_ranks
from anomspark.plans.ordering import c


def tail_table(long: DataFrame) -> DataFrame:
    """(column, value, o): per feature value contribution, from (key.., column, value)."""
    hist = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = with_ranks(hist)
    mean = hist.groupBy("column").agg((F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("mu"))
    skew = (hist.join(F.broadcast(mean), "column")
            .groupBy("column").agg(F.sum(F.col("cnt") * F.pow(F.col("value") - F.col("mu"), 3)).alias("m3")))
    ul = -F.ln(F.col("le") / F.col("n"))
    ur = -F.ln(F.col("ge") / F.col("n"))
    o = F.when(F.signum("m3") == 0, ul + ur).otherwise(F.greatest(ul, ur))
    return ranked.join(F.broadcast(skew), "column").select("column", "value", o.alias("o"))


def ecod(features: DataFrame, key: Sequence[str], feature_names: Sequence[str]) -> DataFrame:
    """Raw ECOD score per row: (key..., score)."""
    key = list(key)
    long = long_values(features, feature_names, "double", keep=key)
    contrib = tail_table(long)
    joined = long.join(contrib, ["column", "value"])
    return joined.groupBy(*[c(k) for k in key]).agg(F.sum("o").alias("score"))
