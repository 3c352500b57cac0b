"""Value histograms and the statistics derived from them.

Two histograms, each one shuffle with map-side combine, so a value holding a third of all
rows costs one row per map task:

* :func:`digest_histogram` groups by a 128-bit digest of the value and its length.  Distinct
  counts, lengths, frequencies and modes need no more, and no text ever crosses the network;
  values are fetched afterwards for the few winners (:func:`modes_of`).
* :func:`value_histogram` groups by the value itself: for numbers (exact quantiles, ECDF
  ranks) and for columns known to hold few values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anomspark.plans.ordering import c, group_prefix_sum

#: Rows of a digest table (a few longs each) up to which it is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
DIGEST = ["d1", "d2", "size"]
_SEED = 0x5EED


def one_zero(df: DataFrame, name: str) -> Column:
    """The column with 0.0 and -0.0 as one value."""
    dt = df.schema[name].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(c(name) == 0, F.lit(0.0).cast(dt)).otherwise(c(name))
    return c(name)


#: Types whose ``xxhash64`` differs for different values: all of at most 64 bits.
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NARROW = (*INTEGRAL, T.BooleanType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


def digest(value: Column, dt: T.DataType) -> list[Column]:
    """128 bits of hash and the length of a text (0 for other types), named as :data:`DIGEST`.  A value of at most
    64 bits needs one number, an integer stands for itself: the rows shrink in the shuffle."""
    if isinstance(dt, NARROW) or (isinstance(dt, T.DecimalType) and dt.precision <= 18):
        d1 = value.cast("long") if isinstance(dt, INTEGRAL) else F.xxhash64(value)
        return [d1.alias("d1"), F.lit(0).cast("long").alias("d2"), F.lit(0).alias("size")]
    size = F.length(value) if isinstance(dt, T.StringType) else F.lit(0)
    return [F.xxhash64(value).alias("d1"), F.xxhash64(F.lit(_SEED), value).alias("d2"), size.alias("size")]


def digest_cells(df: DataFrame, columns: Sequence[str], facts=None, keys=None, label=None) -> DataFrame:
    """(column, d1, d2, size, ...), one row for each non-null cell; for :func:`digest_histogram`.
    ``label(name)`` may name or number a column otherwise."""
    cells = []
    for n in columns:
        more = [*(facts(n) if facts else []), *(keys(n) if keys else [])]
        cells.append(F.when(c(n).isNotNull(), F.struct(
            F.lit(label(n) if label else n).alias("column"),
            *digest(one_zero(df, n), df.schema[n].dataType), *[e.alias(x) for x, e in more])))
    return df.select(F.explode(F.array(*cells)).alias("cell")).where("cell is not null").select("cell.*")


def counted(cells: DataFrame, facts: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """The histogram of :func:`digest_cells`."""
    return cells.groupBy("column", *DIGEST, *keys).agg(F.count(F.lit(1)).alias("cnt"), *[F.max(x).alias(x) for x in facts])


def digest_histogram(df: DataFrame, columns: Sequence[str], facts=None, keys=None) -> DataFrame:
    """(column, d1, d2, size, cnt, ...) over non-null values.

    ``facts(name)`` and ``keys(name)`` give further (name, column) pairs that depend on the value
    alone, the same names and types for every column.  Facts (numbers, flags) are kept per value by
    ``max``; keys (short texts) are grouped by, which changes no group."""
    first = columns[0] if columns else None
    return counted(digest_cells(df, columns, facts, keys), [x for x, _ in facts(first)] if facts else [],
                   [x for x, _ in keys(first)] if keys else [])


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct) of the columns that have a value."""
    return digest_histogram(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def by_digest(table: DataFrame, rows: int) -> DataFrame:
    """``table`` marked for broadcast if it has at most :data:`BROADCAST_ROWS` rows."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def modes_of(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """the most frequent value of each column as text; ties go to the smallest value.

    Winners are found among the digests; only their values are read."""
    hist = digest_histogram(df, columns)
    top = hist.groupBy("column").agg(F.max("cnt").alias("most"))
    tied = hist.join(F.broadcast(top), "column").where("cnt = most").select("column", *DIGEST)
    rows = {r["column"]: r["k"] for r in tied.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    out = {}
    for n in rows:
        mine = by_digest(tied.where(F.col("column") == n).drop("column"), rows[n])
        cells = df.where(c(n).isNotNull()).select(
            one_zero(df, n).cast("string").alias("value"), *digest(one_zero(df, n), df.schema[n].dataType))
        out[n] = cells.join(mine, DIGEST, "left_semi").agg(F.min("value")).first()[0]
    return out


def long_values(df: DataFrame, columns: Sequence[str], value_type: str = "string",
                keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) for every non-null cell of ``columns``."""
    keep = list(keep)
    alias = [f"__key{i}" for i in range(len(keep))]  # a kept column may also be a value column
    proj = df.select(*[c(k).alias(a) for k, a in zip(keep, alias)],
                     *[one_zero(df, x).cast(value_type).alias(x) for x in columns])
    long = proj.unpivot([F.col(a) for a in alias], [c(x) for x in columns], "column", "value")
    long = long.where(F.col("value").isNotNull())
    for k, a in zip(keep, alias):
        long = long.withColumnRenamed(a, k)
    return long


def value_histogram(df: DataFrame, columns: Sequence[str], value_type: str = "string") -> DataFrame:
    """(column, value, cnt) over non-null values."""
    return (long_values(df, columns, value_type)
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")))


def frequencies(hist: DataFrame) -> DataFrame:
    """Share of each value among the column's non-null values."""
    tot = hist.groupBy("column").agg(F.sum("cnt").alias("_tot"))
    return hist.join(F.broadcast(tot), "column").withColumn("share", F.col("cnt") / F.col("_tot")).drop("_tot")


def with_ranks(hist: DataFrame) -> DataFrame:
    """Add ``le`` = #values <= value and ``ge`` = #values >= value, and ``n`` per column."""
    cum = group_prefix_sum(hist, ["value"], "cnt", group_col="column", out_col="le")
    tot = hist.groupBy("column").agg(F.sum("cnt").alias("n"))
    return (cum.join(tot, "column")
            .withColumn("ge", F.col("n") - F.col("le") + F.col("cnt")))


def exact_quantiles(hist: DataFrame, qs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per column from a numeric histogram.

    Returns (column, q, value).  Ranks are found by a prefix sum over the histogram, so
    no single task ever holds a column's values; the join partner is the targets table
    (columns x quantiles rows).
    """
    ranked = with_ranks(hist)
    tot = hist.groupBy("column").agg(F.sum("cnt").alias("n"))
    h = (F.col("n") - 1) * F.col("q")
    targets = (tot.select("column", "n", F.explode(F.array(*[F.lit(float(x)) for x in qs])).alias("q"))
               .withColumn("r_lo", F.floor(h)).withColumn("r_hi", F.ceil(h))
               .withColumn("frac", h - F.floor(h))
               .drop("n"))
    start = F.col("le") - F.col("cnt")
    hit_lo = (start <= F.col("r_lo")) & (F.col("r_lo") < F.col("le"))
    hit_hi = (start <= F.col("r_hi")) & (F.col("r_hi") < F.col("le"))
    joined = ranked.join(F.broadcast(targets), "column").where(hit_lo | hit_hi)
    agg = joined.groupBy("column", "q").agg(
        F.max(F.when(hit_lo, F.col("value"))).alias("v_lo"),
        F.max(F.when(hit_hi, F.col("value"))).alias("v_hi"),
        F.first("frac").alias("frac"))
    return agg.select("column", "q",
                      (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("value"))
