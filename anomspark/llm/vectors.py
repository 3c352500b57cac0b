"""Integer vectors from a column of float arrays, for the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column, most: float) -> Column:
    """Whether a vector is there and holds only finite entries of less than ``most`` in size."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(most)))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def scaled(vector: Column) -> Column:
    """floor(256 * entry) of each entry as a long."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * 256))


def width_of(rows: DataFrame, col: str = "x") -> int:
    """The number of entries that most vectors have (the larger of two as common), 0 for none."""
    first = rows.groupBy(F.size(col).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return 0 if first is None else first.width
