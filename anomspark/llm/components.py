"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomspark.llm.common import reliable_checkpoint

#: Edges of a task between two shuffles; a small table then makes few files, a large one many tasks.
TASK_EDGES = 20_000
#: Edges of a task that makes a spanning forest of its own edges.
FOREST_EDGES = 500_000


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task to one edge for each node: to the least node it reaches through them."""
    root: dict[int, int] = {}

    def ends():
        held = [(x, t) for x in root if (t := top(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int64()),
                                           pa.array([t for _, t in held], pa.int64())], names=["a", "b"])

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(y, y)
        return x
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            root[max(x, y)] = min(x, y)
        if len(root) >= 2 * FOREST_EDGES:
            yield ends()
    yield ends()


def _largest(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _smallest(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """``(node, comp)`` for every node of ``edges(a, b)`` (longs): the least node reachable.

    Each task first replaces its edges by a spanning forest, one edge for each node it holds; the forest of a
    single task is the answer.  Else each round is a pair of keyed aggregations and joins; a hub's rows combine
    before the shuffle and AQE splits its join.  Every round is checkpointed, nothing reaches the driver
    but a count and a checksum; the count sets the number of tasks.  An empty edge table gives an
    empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    n = edges.count()
    tasks, forests = 1 + n // TASK_EDGES, 1 + n // forest_edges
    e = e.coalesce(forests).mapInArrow(_forest, "a long, b long")
    e = reliable_checkpoint(e if forests == 1 else e.distinct())
    seen = None
    while forests > 1:
        e = reliable_checkpoint(_smallest(_largest(e.coalesce(tasks)).coalesce(tasks)).coalesce(tasks))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == seen or not now[0]:
            break
        seen = now
        tasks = 1 + now[0] // TASK_EDGES
    tops = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(tops)
