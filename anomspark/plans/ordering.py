"""Ordered work without a global single-partition window.

Spark has no row order, and ``Window.orderBy`` without ``partitionBy`` moves every row
into one task.  Everything ordered in this library goes through three helpers instead:

* :func:`group_index`   contiguous 0-based position of each row inside its group
  (range partitioning + per-partition offsets, JVM only);
* :func:`group_prefix_sum` running sum of a weight inside its group (same layout, the
  per-partition scan runs in ``mapInPandas``);
* :func:`with_halo`     cuts an indexed frame into blocks of ``block_rows`` rows and copies
  the last ``halo`` rows of each block into the next one, so that lag / rolling windows
  of reach ``halo`` run per block (bounded tasks) and equal the single global window.

Hot groups are harmless: a group is spread over as many range partitions as it needs,
and only per-(partition, group) totals, at most ``partitions + groups`` rows, are
aggregated to compute offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anomspark.session import default_parallelism, reliable_checkpoint

DEFAULT_BLOCK_ROWS = 1 << 20


def q(name: str) -> str:
    """Back-quote a column name for use in a column reference."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def _sort_exprs(order_cols: Sequence, descending: bool = False) -> list[Column]:
    out = []
    for o in order_cols:
        col = c(o) if isinstance(o, str) else o
        out.append(col.desc_nulls_last() if descending else col.asc_nulls_first())
    return out


#: Generated scan-order column.
ROW_NAME = "__anomspark_row"


def ensure_order(df: DataFrame, order_by: Sequence[str] | None, name: str = ROW_NAME):
    """Return ``(df, order_cols)``.  Without an explicit order the scan order is used
    (``monotonically_increasing_id`` right after the read), which matches the row order
    of a file read by a single-process reader."""
    if order_by:
        return df, list(order_by)
    return df.withColumn(name, F.monotonically_increasing_id()), [name]


def group_index(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                idx_col: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Contiguous 0-based index of every row within ``group_cols`` by ``order_cols``.

    ``order_cols`` should be a total order inside each group; ties get an arbitrary but
    fixed order.  One range shuffle; the offsets table has one row per (range
    partition, group) pair.
    """
    spark = df.sparkSession
    parts = num_partitions or default_parallelism(spark)
    group_cols = list(group_cols)
    keys = [*group_cols, *order_cols]
    ranged = (df.repartitionByRange(parts, *[c(k) for k in keys])
              .sortWithinPartitions(*[c(k) for k in keys])
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_lpos", F.monotonically_increasing_id()
                          - F.shiftleft(F.col("_pid").cast("long"), 33)))
    # Range bounds are sampled with a seed tied to the RDD id, so two evaluations of
    # ``ranged`` may cut differently.  A reliable checkpoint fixes one layout for both
    # the offsets table and the rows, and survives executor loss.
    ranged = reliable_checkpoint(ranged)
    meta = ranged.groupBy("_pid", *[c(g) for g in group_cols]).agg(
        F.min("_lpos").alias("_start"), F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*[c(g) for g in group_cols]).orderBy("_pid")
         .rowsBetween(Window.unboundedPreceding, -1))
    meta = meta.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    side = meta.select(F.col("_pid").alias("_p"), *[c(g).alias(f"_g{i}") for i, g in enumerate(group_cols)], "_start", "_off")
    same = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group_cols):  # null is a group of its own
        same &= c(g).eqNullSafe(F.col(f"_g{i}"))
    if not group_cols:  # one row for each range partition: broadcast, else the rows were shuffled once more to meet it
        side = F.broadcast(reliable_checkpoint(side))
    out = ranged.join(side, same).drop("_p", *[f"_g{i}" for i in range(len(group_cols))])
    return (out.withColumn(idx_col, (F.col("_off") + F.col("_lpos") - F.col("_start")).cast("long"))
            .drop("_pid", "_lpos", "_start", "_off"))


def with_row_id(df: DataFrame, order_cols: Sequence[str] | None = None, name: str = ROW_NAME) -> DataFrame:
    """``df`` with a contiguous 0-based row id ``name``, fixed for good in a reliable checkpoint.

    Rows are numbered by ``order_cols`` (ties in any order), or without them as they are scanned: then
    nothing is shuffled, a row's id is its place in its partition plus the rows of the partitions before,
    of which the table has one row each.  Rows alike in all columns get ids of their own.
    """
    if order_cols:  # both the layout and its offsets are in a checkpoint there
        return group_index(df, order_cols, (), name)
    pid, at, start = "__pid", "__at", "__start"
    fixed = reliable_checkpoint(df.withColumn(pid, F.spark_partition_id()).withColumn(
        at, F.monotonically_increasing_id() - F.shiftleft(F.col(pid).cast("long"), 33)))
    sizes = fixed.groupBy(pid).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select(pid, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    return (fixed.join(F.broadcast(starts), pid).withColumn(name, F.col(at) + F.col(start)).drop(pid, at, start))


def _local_cumsum(group_col: str | None, weight_col: str, out_col: str):
    def scan(batches):
        carry_key = None
        carry = 0
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(**{out_col: pd.Series([], dtype="int64")})
                continue
            w = pdf[weight_col].fillna(0).astype("int64")
            if group_col is None:
                cs = w.cumsum() + carry
                carry = int(cs.iloc[-1])
            else:
                g = pdf[group_col]
                run = (g != g.shift()).cumsum()
                cs = w.groupby(run.values).cumsum()
                if carry_key is not None:
                    cs = cs + np.where((run == 1) & (g == carry_key), carry, 0)
                carry_key = g.iloc[-1]
                carry = int(cs.iloc[-1])
            yield pdf.assign(**{out_col: cs.astype("int64")})
    return scan


def group_prefix_sum(df: DataFrame, order_cols: Sequence[str], weight_col: str,
                     group_col: str | None = None, out_col: str = "cum",
                     num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``weight_col`` within ``group_col`` by ``order_cols``.

    Used on value histograms (ECDF, exact quantiles), where ties are already merged
    into one row per value.
    """
    spark = df.sparkSession
    parts = num_partitions or default_parallelism(spark)
    groups = [group_col] if group_col else []
    keys = [*groups, *order_cols]
    ranged = reliable_checkpoint(df.repartitionByRange(parts, *[c(k) for k in keys])
                                 .sortWithinPartitions(*[c(k) for k in keys])
                                 .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields + [T.StructField("_lcum", T.LongType())])
    local = ranged.mapInPandas(_local_cumsum(group_col, weight_col, "_lcum"), schema)
    meta = ranged.groupBy("_pid", *[c(g) for g in groups]).agg(
        F.sum(c(weight_col)).cast("long").alias("_tot"))
    w = (Window.partitionBy(*[c(g) for g in groups]).orderBy("_pid")
         .rowsBetween(Window.unboundedPreceding, -1))
    meta = meta.withColumn("_off", F.coalesce(F.sum("_tot").over(w), F.lit(0)))
    out = local.join(meta.select("_pid", *groups, "_off"), ["_pid", *groups])
    return (out.withColumn(out_col, (F.col("_off") + F.col("_lcum")).cast("long"))
            .drop("_pid", "_lcum", "_off"))


def with_halo(indexed: DataFrame, idx_col: str = "idx", halo: int = 0,
              block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Add ``_blk`` and ``_own``; rows in the last ``halo`` positions of a block are
    copied into the next block with ``_own = false``.

    Windows over ``partitionBy(group..., "_blk").orderBy(idx)`` that look back at most
    ``halo`` rows then give the global result on the owned rows.
    """
    if halo > block_rows:
        raise ValueError("halo must not exceed block_rows")
    blk = F.floor(F.col(idx_col) / F.lit(block_rows)).cast("long")
    owned = indexed.withColumn("_blk", blk).withColumn("_own", F.lit(True))
    if halo <= 0:
        return owned
    copies = (indexed.where(F.pmod(F.col(idx_col), F.lit(block_rows)) >= block_rows - halo)
              .withColumn("_blk", blk + 1).withColumn("_own", F.lit(False)))
    return owned.unionByName(copies)


def tail_rows(df: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """A3: the last ``n`` rows by ``order_cols`` (distributed top-k, never ``tail()``)."""
    return df.orderBy(*_sort_exprs(order_cols, descending=True)).limit(n)


def head_rows(df: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """A5: the first ``n`` rows by ``order_cols``."""
    return df.orderBy(*_sort_exprs(order_cols)).limit(n)
