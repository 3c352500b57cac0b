"""Sums of equally long arrays that tasks hand in, added up by a tree of tasks.

Each task of the first level gives one row ``(n, v)``; a few tasks add these rows as they stream by and one
more adds their results, so the driver gets a single row however many partitions there were.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks of the middle level.
FAN_IN = 16


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, kind = 0, None, None
    for b in batches:
        if not b.num_rows:
            continue
        n += sum(b.column(0).to_pylist())
        kind = b.column(1).type
        flat = b.column(1).flatten()
        whole = pa.types.is_decimal(flat.type)
        values = np.array(flat.to_pylist(), object) if whole else flat.to_numpy()
        part = values.reshape(b.num_rows, -1).sum(axis=0)
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], kind)], names=["n", "v"])


def tree_sum(parts: DataFrame) -> tuple[int, np.ndarray] | None:
    """(sum of ``n``, sum of the arrays ``v``) of ``parts(n long, v array<double or decimal>)``; whole
    numbers (decimals) come as Python integers.  None if no task handed in a row."""
    schema = parts.schema
    row = parts.repartition(FAN_IN).mapInArrow(_add, schema).coalesce(1).mapInArrow(_add, schema).first()
    if row is None:
        return None
    exact = schema["v"].dataType.elementType.typeName() == "decimal"
    return row["n"], np.array([int(x) for x in row["v"]], object) if exact else np.array(row["v"], float)
