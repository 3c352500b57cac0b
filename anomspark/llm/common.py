"""Shared pieces of the training-data operators: checkpoints, checked broadcasts, names."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anomspark.session import ensure_checkpoint_dir, prepare_session, reliable_checkpoint

#: Rows of a slim table (a few longs) up to which it is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 2_000_000

WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["BROADCAST_ROWS", "WORD", "checked_broadcast", "fresh", "read", "reliable_checkpoint",
           "ensure_checkpoint_dir", "release", "seeded_hash", "words_of", "docs_without_row_once"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare_session(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is (the join
    then shuffles, with AQE splitting hot keys).  ``df`` should be checkpointed or cheap."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of frames that nothing refers to any more.

    It does so when the driver's collectors find them; until then a query of many steps keeps those of every step.
    Py4J tells the JVM up to a second later what Python has let go, so a call frees what was let go before the call
    before it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names based on ``names`` that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def seeded_hash(seed: int, *cols: Column) -> Column:
    """64-bit hash of the columns and a seed; nulls count as their own value."""
    parts = []
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(F.lit(seed), *parts)


def words_of(text: Column) -> Column:
    """Array of the words of a text, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def docs_without_row_once(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (one row per id), one row per id.

    Ids that name one row are taken by an anti join; only the rows of repeated ids are grouped,
    so texts do not shuffle for the others.  A null id is matched too.
    """
    rep = reliable_checkpoint(docs.groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("_rid")))
    small = checked_broadcast(ids.select(F.col(id_col).alias("_kid")))
    kept = docs.join(small, docs[id_col].eqNullSafe(F.col("_kid")), "left_anti")
    n = rep.count()
    if not n:
        return kept
    repeated = checked_broadcast(rep, n)
    single = kept.join(repeated, kept[id_col].eqNullSafe(F.col("_rid")), "left_anti")
    several = kept.join(repeated, kept[id_col].eqNullSafe(F.col("_rid")), "left_semi")
    key = [F.xxhash64(*[c for c in several.columns])]
    several = several.groupBy(id_col).agg(F.min_by(F.struct(*several.columns), key[0]).alias("_r")).select("_r.*")
    return single.unionByName(several.select(*docs.columns))
