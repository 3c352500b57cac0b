"""Bounded labelled samples for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomspark.llm.common import seeded_hash

SEED = 7


def fold(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def training_texts(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(text, y)`` of at most ``rows`` labelled documents among those where ``keep`` holds.

    The sample is drawn by a seeded hash of the id, so it is the same in every run.  Null labels,
    null ids and labels of absent documents do not count; an id with several labels takes the
    greatest one; several documents of one id all count.
    """
    keep = F.lit(True) if keep is None else keep
    one = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & keep)
           .groupBy(F.col(id_col).alias("_lid")).agg(F.max(label).cast("int").alias("y"))
           .withColumn("_h", seeded_hash(SEED, F.col("_lid"))).orderBy("_h", "_lid").limit(rows))
    return (docs.select(F.col(id_col).alias("_did"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .join(F.broadcast(one), F.expr("_did = _lid")).select("text", "y"))  # bounded by ``rows``
