"""Operator 11: hard negatives by a search with length buckets and coordinate pruning.

Vectors become integers (floor of 256 times the entry) and are numbered by falling length; ``BUCKET`` of them in
a row make a bucket, so equal vectors, however many, are split.  A bucket keeps, for each coordinate of the vectors
scaled to length 1, a sorted list.  An anchor that looks for inner products of at least theta visits the buckets
whose longest vector can reach theta; there the angle between them must stay below acos(theta / lengths), which
gives each of the anchor's ``FOCUS`` largest coordinates a range of feasible values.  The ranges cut the sorted
lists, the candidate sets are intersected, and what is left is multiplied out exactly, in whole numbers.

theta starts from the first bucket (the longest vectors): the k-th best found there bounds the result from below.
A search runs twice: for the positives (same label, no bound), then for the negatives, with a band of allowed scores
for each positive.  Anchors are sent to buckets and stream through a task that holds one bucket; each answers with at
most k rows for each band, which are merged by anchor.

Results: a row with a null id or label, a null or empty vector, or one with a null, non-finite or enormous
entry (65,536 and more) takes no part; nor does one of another length than most vectors have (the longer of two as
common).  Rows that repeat count each (equal scores and ids in any order, the rows being alike); an anchor whose
row repeats answers as often.  An anchor without other rows of its label, or a positive without a row in its
band, has no rows.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomspark.llm.common import read, reliable_checkpoint
from anomspark.llm.vectors import scaled, valid, width_of
from anomspark.plans.ordering import group_index

BUCKET, FOCUS, BATCH = 4096, 3, 256
LARGEST = 2.0 ** 16
ANYTHING = 1 << 62
FOUND = "asker long, band int, score long, id long, idx long"
ASKED = "bucket int, asks boolean, idx long, id long, label long, x array<bigint>, bands array<struct<band:int,low:bigint,high:bigint>>"


class Bucket:
    """Vectors of similar length with sorted coordinate lists."""

    def __init__(self, x: np.ndarray, idx: np.ndarray, ids: np.ndarray, label: np.ndarray):
        self.x, self.idx, self.id, self.label = x, idx, ids, label
        self.f = x.astype(float)
        length = np.sqrt((self.f * self.f).sum(axis=1))
        self.longest = float(length.max(initial=0.0))
        self.unit = self.f / np.where(length > 0, length, 1)[:, None]
        self.most = float(np.abs(self.f).max(initial=0))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, least: int) -> np.ndarray | None:
        """Rows whose inner product with ``q`` may be ``least`` or more; None for all of them."""
        length = float(np.sqrt(q @ q))
        if least <= 0 or not length:
            return None if least <= 0 else np.zeros(0, np.int64)
        cosine = least / (length * self.longest) * (1 - 1e-12) if self.longest else 2.0
        if cosine > 1:
            return np.zeros(0, np.int64)
        q = q / length
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        angle, reach = np.arccos(np.clip(q[focus], -1, 1)), np.arccos(cosine)
        low = np.cos(np.minimum(np.pi, angle + reach)) - 1e-9
        high = np.cos(np.maximum(0, angle - reach)) + 1e-9
        cut = []
        for f, lo, hi in zip(focus.tolist(), low, high, strict=True):
            values = self._list(f)[1]
            cut.append((int(np.searchsorted(values, lo)), int(np.searchsorted(values, hi, side="right"))))
        best = min(range(len(cut)), key=lambda k: cut[k][1] - cut[k][0])
        if cut[best][1] - cut[best][0] == len(self.x):
            return None
        rows = self._list(int(focus[best]))[0][slice(*cut[best])]
        for k, f in enumerate(focus.tolist()):
            if k != best:
                v = self.unit[rows, f]
                rows = rows[(v >= low[k]) & (v <= high[k])]
        return rows

    def products(self, q: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Exact inner products with the vectors ``q`` (one in a row), of all or some rows."""
        if self.x.shape[1] * self.most * float(np.abs(q).max(initial=0)) < 1 << 53:
            f = self.f if rows is None else self.f[rows]
            return (q.astype(float) @ f.T).astype(np.int64)
        return q @ (self.x if rows is None else self.x[rows]).T

    def best(self, score: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` highest of ``rows``, ties by id."""
        if len(rows) > 4 * k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            score, rows = score[score >= kth], rows[score >= kth]
        return rows[np.lexsort((self.idx[rows], self.id[rows], -score))[:k]]


def _search(k: int, same: bool):
    def answers(bucket: Bucket, b: pa.RecordBatch) -> Iterator[tuple]:
        q = b.column(5).flatten().to_numpy().reshape(b.num_rows, -1)
        label, bands = b.column(4).to_numpy(), b.column(6).to_pylist()
        some = [bucket.candidates(x, min(y["low"] for y in w)) for x, w in zip(q.astype(float), bands, strict=True)]
        some = [None if r is None or 2 * len(r) > len(bucket.x) else r for r in some]
        every = bucket.products(q) if any(r is None for r in some) else None
        for i, (asker, rows) in enumerate(zip(b.column(2).to_pylist(), some, strict=True)):
            score = every[i] if rows is None else bucket.products(q[i:i + 1], rows)[0]
            rows = np.arange(len(bucket.x)) if rows is None else rows
            fit = (bucket.label[rows] == label[i]) & (bucket.idx[rows] != asker) if same else bucket.label[rows] != label[i]
            for y in bands[i]:
                ok = fit & (score >= y["low"]) & (score <= y["high"])
                at = rows[ok]
                if len(at):
                    top = bucket.best(score[ok], at, k)
                    for r, s in zip(top.tolist(), bucket.products(q[i:i + 1], top)[0].tolist(), strict=True):
                        yield asker, y["band"], s, int(bucket.id[r]), int(bucket.idx[r])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, bucket = None, [], None
        for b in batches:
            numbers, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            cut = [0, *new.tolist(), b.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if numbers[lo] != number:
                    number, held, bucket = numbers[lo], [], None
                if not asks[lo]:
                    held.append(part)
                    continue
                if bucket is None:
                    if not held:
                        continue
                    rows = pa.concat_batches(held)
                    x = rows.column(5).flatten().to_numpy().reshape(rows.num_rows, -1)
                    bucket = Bucket(x, *(rows.column(c).to_numpy() for c in (2, 3, 4)))
                for at in range(0, part.num_rows, BATCH):
                    out = list(answers(bucket, part.slice(at, BATCH)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[c] for o in out], pa.int32() if c == 1 else pa.int64()) for c in range(5)],
                        names=["asker", "band", "score", "id", "idx"])
    return run


def _routes(longest, first: int, last: int):
    """Anchors to the buckets ``first`` to ``last`` that hold a vector long enough."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q = np.array(b.column(5)[i].as_py(), float)
                least = min(y["low"] for y in b.column(6)[i].as_py())
                reach = float(np.sqrt(q @ q)) * longest.value[first:last] * (1 + 1e-12)
                to = first + np.flatnonzero(reach >= least)
                one = b.take(pa.array(np.full(len(to), i)))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *one.columns[1:]], names=b.schema.names)
    return run


def _answers(rows: DataFrame, asks: DataFrame, longest, first: int, last: int, k: int, same: bool) -> DataFrame:
    sent = asks.mapInArrow(_routes(longest, first, last), ASKED)
    held = rows.where(F.col("bucket").between(first, last - 1)).select(
        "bucket", F.lit(False).alias("asks"), "idx", "id", "label", "x", F.lit(None).cast(asks.schema["bands"].dataType).alias("bands"))
    both = held.unionByName(sent).repartition(min(10_000, last - first), "bucket").sortWithinPartitions("bucket", "asks")
    return both.mapInArrow(_search(k, same), FOUND)


def search(rows: DataFrame, asks: DataFrame, longest, k: int, same: bool) -> DataFrame:
    """For each anchor and band of ``asks`` its ``k`` best rows: ``asker, band, found array<struct<fall, id, idx>>``.

    ``same``: other rows of the anchor's label, else rows of other labels.  ``longest``: broadcast lengths of the
    longest vector of each bucket (8 bytes for ``BUCKET`` rows).
    """
    buckets = len(longest.value)
    near = reliable_checkpoint(_answers(rows, asks, longest, 0, 1, k, same))
    if buckets > 1:
        full = near.groupBy("asker", "band").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        bands = asks.select("idx", F.explode("bands").alias("b")).join(
            full, F.expr("idx = asker and b.band = band"), "left").groupBy("idx").agg(F.collect_list(F.struct(
                "b.band", F.coalesce("kth", "b.low").alias("low"), "b.high")).alias("bands"))
        raised = asks.drop("bands").join(bands, "idx").select(*asks.columns)
        near = near.unionByName(_answers(rows, raised, longest, 1, buckets, k, same))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("fall"), "id", "idx"))), 1, k)
    return reliable_checkpoint(near.groupBy("asker", "band").agg(best.alias("found")))


def hard_negatives(table: DataFrame, anchors: str, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", relabel: str | None = None, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, bucket: int = BUCKET) -> DataFrame:
    """For each anchor and positive the first hard negatives, by rank.

    ``anchors``: SQL condition on ``id``; ``relabel``: SQL expression of the label on ``id`` and ``label``;
    ``low`` and ``high``: percent of the positive's score between which a negative's score lies.
    """
    spark, vector = table.sparkSession, F.col(f"`{vector_col}`")
    rows = table.where(valid(vector, LARGEST) & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                       scaled(vector).alias("x"))
    if relabel:
        rows = rows.withColumn("label", F.expr(relabel).cast("long"))
    rows = rows.where(F.size("x") == width_of(rows))
    rows = rows.withColumn("square", F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v))
    rows = group_index(rows.withColumn("fall", -F.col("square")), ["fall", "id", "label"])
    rows = rows.withColumn("bucket", F.expr(f"cast(idx div {bucket} as int)"))
    lengths = rows.groupBy("bucket").agg(F.max("square").alias("s")).orderBy("bucket").collect()  # one for each bucket
    result = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not lengths:
        return spark.createDataFrame([], result)
    longest = spark.sparkContext.broadcast(np.sqrt(np.array([r.s for r in lengths], float)))

    none = F.array(F.struct(F.lit(0).alias("band"), F.lit(-ANYTHING).alias("low"), F.lit(ANYTHING).alias("high")))
    asks = reliable_checkpoint(rows.where(anchors).select(
        F.lit(0).alias("bucket"), F.lit(True).alias("asks"), "idx", "id", "label", "x", none.alias("bands")))
    pairs = search(rows, asks, longest, positives, True).select("asker", F.posexplode("found").alias("band", "p"))
    pairs = pairs.select("asker", "band", F.col("p.id").alias("positive_id"), (-F.col("p.fall")).alias("positive_score"))
    limits = pairs.select("asker", F.struct(
        "band", F.expr(f"-floor(-cast({low} * positive_score as decimal(38,0)) / 100)").cast("long").alias("low"),
        F.expr(f"floor(cast({high} * positive_score as decimal(38,0)) / 100)").cast("long").alias("high")).alias("b"))
    limits = limits.where("b.low <= b.high").groupBy("asker").agg(F.collect_list("b").alias("bands"))
    asks = asks.drop("bands").join(limits, F.col("idx") == F.col("asker")).select(*asks.columns)
    found = search(rows, asks, longest, negatives, False).select("asker", "band", F.posexplode("found").alias("at", "n"))
    names = rows.where(anchors).select(F.col("idx").alias("asker"), F.col("id").alias("anchor_id"))
    return found.join(pairs, ["asker", "band"]).join(names, "asker").select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
        "positive_score", (-F.col("n.fall")).alias("negative_score"))


def op11_lemp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"), "id % 50 = 0",
                          relabel="case when id % 7 = 0 then (label + 1) % 10 else label end")


SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  [floor(256 * c::double) for c in embedding] as x
           from embeddings
           where label is not null and embedding is not null
             and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
             list_inner_product(a.x, b.x)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id,
       (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id))::int as rank,
       s.id as negative_id, positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same
 and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
qualify rank <= 3
"""
