"""Exact k-nearest neighbours and local outlier factor (Breunig et al. 2000).

Exact kNN without a cross join, by metric partitions:

* **Copies.**  Of rows with equal vectors only the first ``k + 1`` (by tie order) can be anyone's
  neighbours, and a vector with more copies than that has its neighbours among them.  So a hot vector,
  however many rows hold it, costs ``k + 1`` candidates and no search.
* **Cells and blocks.**  Up to ``MAX_PIVOTS`` pivot vectors (broadcast) cut the space into Voronoi cells; a
  cell's rows are ordered by their distance to its pivot and cut into blocks of at most ``block_rows`` rows.
* **Search.**  By the triangle inequality a block whose rows lie between ``lo`` and ``hi`` from its pivot is at
  least ``max(d - hi, lo - d)`` away from a query at distance ``d`` from that pivot, and at least
  ``(d^2 - e^2) / 2f`` for a query at ``e`` from its own pivot, ``f`` between both pivots.  The nearest blocks
  that hold ``k`` other rows give each query an upper bound of its k-th distance; a second round visits the
  blocks whose lower bound does not exceed it.  Every block that may matter is visited and nothing is capped.

A task holds one block and streams the queries sent to it, so its memory is bounded by ``block_rows``
whatever the data; isotropic data of many dimensions only means more visits.

LOF then needs only equi-joins on the neighbour lists: k-distance, reachability,
local reachability density, ratio.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anomspark.operators.histogram import by_digest
from anomspark.plans.ordering import c, group_index, with_row_id
from anomspark.session import reliable_checkpoint

# Neighbourhood size and the LOF density offset.
N_NEIGHBORS = 20
LRD_EPS = 1e-10
BLOCK_ROWS = 4096
MAX_PIVOTS = 512
#: Queries worked on at a time.
BATCH = 512
#: Distances by expansion of the square are off by at most this share of the vectors' lengths.
SLACK = 1e-7
SALTS = 64

_SENT = "block long, asks boolean, idx long, tie long, bound double, x binary"
_FOUND = "qidx long, nidx long, tie long, dist double"


def _vectors(col: pa.Array, rows: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _pack(x: np.ndarray) -> pa.Array:
    """Vectors as bytes to send around: 4 bytes an entry where all entries of a row are single-precision numbers
    (nothing is rounded), else 8."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    exact = (short == x).all(axis=1)
    wide = x.astype("<f8", copy=False)
    return pa.array([(short if e else wide)[i].tobytes() for i, e in enumerate(exact)], pa.binary())


def _unpack(col: pa.Array, d: int) -> np.ndarray:
    """The vectors of :func:`_pack`, of ``d`` entries."""
    raw = col.to_pylist()
    if all(len(r) == 4 * d for r in raw):
        return np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), d).astype(float)
    return np.array([np.frombuffer(r, "<f4" if len(r) == 4 * d else "<f8") for r in raw], float)


def _apart(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances between the rows of both (to within the slack), and the slack of each row of ``q``."""
    qq, pp = (q * q).sum(axis=1), (p * p).sum(axis=1)
    d = np.sqrt(np.maximum(qq[:, None] + pp[None, :] - 2.0 * (q @ p.T), 0.0))
    return d, SLACK * np.sqrt(qq + pp.max(initial=0.0))


# ---- cells and blocks

def _pivots(vec: DataFrame, rows: int, wanted: int) -> np.ndarray:
    """About ``wanted`` different vectors, by a hash threshold on the vector (the same whatever the layout)."""
    h = F.xxhash64("x")
    share = min(1.0, 4.0 * wanted / max(rows, 1))
    some = vec.select("x", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    found = some.groupBy("h").agg(F.first("x").alias("x")).orderBy("h").limit(wanted).collect()
    found = found or vec.select("x").limit(1).collect()
    return np.array([r["x"] for r in found], float)


def _assign(pivots):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for b in batches:
            x = _vectors(b.column(3), b.num_rows)
            cell, away = [], []
            for i in range(0, len(x), BATCH):
                d, _ = _apart(x[i:i + BATCH], p)
                near = d.argmin(axis=1)
                cell.append(near)
                away.append(d[np.arange(len(near)), near])
            both = [np.concatenate(a) if a else np.zeros(0) for a in (cell, away)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _pack(x), pa.array(both[0].astype(np.int64)), pa.array(both[1].astype(float))],
                                             names=[*b.schema.names, "cell", "away"])
    return run


class Layout:
    """Pivots, and for each block (sorted by cell): cell, range of distances to the pivot, rows."""

    def __init__(self, pivots: np.ndarray, blocks: list):
        self.pivots = pivots
        self.block = np.array([b["block"] for b in blocks], np.int64)
        self.cell = np.array([b["cell"] for b in blocks], np.int64)
        self.lo, self.hi = (np.array([b[k] for b in blocks], float) for k in ("lo", "hi"))
        self.rows = np.array([b["n"] for b in blocks], np.int64)
        self.between = _apart(pivots, pivots)[0]

    def bounds(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(queries, blocks): least distance of a query to any row of a block, never too large."""
        d, slack = _apart(x, self.pivots)
        own = d[np.arange(len(x)), cell]
        at = d[:, self.cell]
        apart = 2.0 * self.between[cell][:, self.cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (at * at - (own * own)[:, None]) / apart, 0.0)
        low = np.maximum(np.maximum(at - self.hi, self.lo - at), np.where(np.isfinite(plane), plane, 0.0))
        # the plane's error grows with the distances over the gap between the pivots
        loose = 4 * slack[:, None] * (1 + np.where(apart > 0, 4 * at / np.where(apart > 0, apart, 1.0), 0.0))
        return np.maximum(low - loose, 0.0)

    def nearest(self, low: np.ndarray, k: int) -> np.ndarray:
        """(queries, blocks): the blocks of the first round, the nearest that hold ``k`` rows besides the query."""
        order = np.argsort(low, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        first = np.zeros(low.shape, bool)
        np.put_along_axis(first, order, before < k + 1, axis=1)
        return first


def _route(layout, k: int, second: bool):
    """Queries (idx, tie, x, cell, bound) to the blocks of the first or second round."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay = layout.value
        step = max(1, min(BATCH, (4 << 20) // max(1, len(lay.block))))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                low = lay.bounds(_unpack(b.column(2), lay.pivots.shape[1]), b.column(3).to_numpy())
                to = lay.nearest(low, k)
                if second:
                    to = ~to & (low <= b.column(4).to_numpy()[:, None])
                i, j = np.nonzero(to)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lay.block[j]), pa.array(np.ones(len(i), bool)), b.column(0).take(take), b.column(1).take(take),
                     b.column(4).take(take), b.column(2).take(take)], names=["block", "asks", "idx", "tie", "bound", "x"])
    return run


# ---- search in a block

def _nearest(x: np.ndarray, idx: np.ndarray, tie: np.ndarray, q: np.ndarray, me: np.ndarray, bound: np.ndarray, k: int):
    """For each query the ``k`` nearest other rows within its bound: (query, row, distance) arrays.

    BLAS distances shortlist ``k + 8`` rows, exact distances decide; where the shortlist's end is within
    rounding of the k-th distance, all rows are measured."""
    sq, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
    d2 = qq[:, None] + sq[None, :] - 2.0 * (q @ x.T)
    d2[me[:, None] == idx[None, :]] = np.inf
    top = sq.max()
    # most visits of the second round find nothing: queries without a row within their bound (and rounding) are done
    live = np.flatnonzero(~(d2.min(axis=1) > bound * bound + 1e-9 * (qq + top)))
    if len(live) < len(q):
        d2, q, qq, me, bound = d2[live], q[live], qq[live], me[live], bound[live]
    if not len(live):
        return live, live, np.zeros(0)
    kk = min(k, len(x))
    margin = min(kk + 8, len(x))
    some = np.argpartition(d2, min(margin, len(x) - 1), axis=1)
    short = some[:, :margin]
    diff = q[:, None, :] - x[short]
    exact = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    exact[idx[short] == me[:, None]] = np.inf
    order = np.lexsort((tie[short], exact), axis=1)[:, :kk]
    row, dist = np.take_along_axis(short, order, 1), np.take_along_axis(exact, order, 1)
    if margin < len(x):
        rest = np.take_along_axis(d2, some[:, margin:margin + 1], 1)[:, 0]
        for r in np.flatnonzero(rest - 1e-9 * (qq + top) <= dist[:, -1] * dist[:, -1]):
            full = np.sqrt(((x - q[r]) ** 2).sum(axis=1))
            full[idx == me[r]] = np.inf
            row[r] = np.lexsort((tie, full))[:kk]
            dist[r] = full[row[r]]
    i, j = np.nonzero(np.isfinite(dist) & (dist <= bound[:, None]))
    return live[i], row[i, j], dist[i, j]


def _search(k: int, d: int):
    """Rows sorted by (block, asks): a block's rows come first, then its queries stream by."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, data = None, [], None
        for b in batches:
            block, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if block[lo] != number:
                    number, held, data = block[lo], [], None
                if not asks[lo]:
                    held.append(part)
                    continue
                if data is None:
                    rows = pa.concat_batches(held)
                    data = _unpack(rows.column(5), d), rows.column(2).to_numpy(), rows.column(3).to_numpy()
                for at in range(0, part.num_rows, BATCH):
                    s = part.slice(at, BATCH)
                    me = s.column(2).to_numpy()
                    i, j, dist = _nearest(*data, _unpack(s.column(5), d), me, s.column(4).to_numpy(), k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(me[i]), pa.array(data[1][j]), pa.array(data[2][j]), pa.array(dist)],
                        names=["qidx", "nidx", "tie", "dist"])
    return run


def _visits(rows: DataFrame, asks: DataFrame, layout, k: int, second: bool) -> DataFrame:
    sent = asks.select("idx", "tie", "x", "cell", "bound").mapInArrow(_route(layout, k, second), _SENT)
    held = rows.select("block", F.lit(False).alias("asks"), "idx", "tie", F.lit(0.0).alias("bound"), "x")
    both = held.unionByName(sent).repartition("block").sortWithinPartitions("block", "asks")
    return both.mapInArrow(_search(k, layout.value.pivots.shape[1]), _FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(qidx, near): the ``k`` nearest of each query as sorted (dist, tie, nidx)."""
    return found.groupBy("qidx").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("dist", "tie", "nidx"))), 1, k).alias("near"))


# ---- kNN

def candidates(base: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``base(idx, tie, x)`` as (rows that may be neighbours with ``asks``, first copies ``(h1, h2, first)`` of
    vectors with more than ``k + 1`` copies, rows of such vectors)."""
    keyed = base.withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64(F.lit(7), "x"))
    heavy = reliable_checkpoint(keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
                                .where(F.col("copies") > k + 1).select("h1", "h2"))
    side = by_digest(heavy, heavy.count())
    many = keyed.join(side, ["h1", "h2"], "left_semi")
    salted = Window.partitionBy("h1", "h2", "salt").orderBy("tie", "idx")
    first = Window.partitionBy("h1", "h2").orderBy("tie", "idx")  # k + 1 rows of each salt at most
    reps = (many.withColumn("salt", F.pmod(F.xxhash64("idx"), F.lit(SALTS)))
            .withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
            .withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1))
    reps = reliable_checkpoint(reps.select("idx", "tie", "x", "h1", "h2"))
    few = keyed.join(side, ["h1", "h2"], "left_anti").select("idx", "tie", "x", F.lit(True).alias("asks"))
    rows = few.unionByName(reps.select("idx", "tie", "x", F.lit(False).alias("asks")))
    firsts = reps.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("tie", "idx"))).alias("first"))
    return rows, firsts, many.select("idx", "h1", "h2")


def blocks_of(rows: DataFrame, pivots, block_rows: int) -> DataFrame:
    """``rows`` with ``cell``, distance ``away`` from its pivot, and ``block`` (at most ``block_rows`` rows);
    ``x`` is packed into bytes."""
    cells = rows.select("idx", "tie", "asks", "x").mapInArrow(
        _assign(pivots), "idx long, tie long, asks boolean, x binary, cell long, away double")
    placed = group_index(cells, ["away", "idx"], ["cell"], "place")
    return reliable_checkpoint(placed.withColumn(
        "block", F.shiftleft("cell", 40) + F.expr(f"place div {block_rows}")).drop("place"))


def knn(features: DataFrame, key: Sequence[str], names: Sequence[str], k: int = N_NEIGHBORS,
        block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS):
    """Exact k nearest neighbours.  Returns (indexed, pairs): ``indexed`` maps key ->
    idx; ``pairs`` is (qidx, nidx, dist) with k rows per row.  Equal distances are ordered by the first key
    column if that is an integer, else by a hash of the key."""
    key = list(key)
    spark = features.sparkSession
    whole = isinstance(features.schema[key[0]].dataType, T.IntegralType)
    tie = F.coalesce(c(key[0]).cast("long"), F.lit((1 << 63) - 1)) if whole else F.xxhash64(*[c(x) for x in key])
    xs = [F.coalesce(c(n).cast("double"), F.lit(0.0)) + F.lit(0.0) for n in names]  # -0.0 is 0.0
    keys = [c(x).alias(f"__key{i}") for i, x in enumerate(key)]
    base = with_row_id(features.select(*keys, F.array(*xs).alias("x"), tie.alias("tie")), name="idx")
    indexed = base.select(*[F.col(f"__key{i}").alias(x) for i, x in enumerate(key)], "idx")

    rows, firsts, many = candidates(base.select("idx", "tie", "x"), k)
    n = rows.count()
    if not n:
        return indexed, spark.createDataFrame([], "qidx long, nidx long, dist double")
    pivots = _pivots(rows, n, max(1, min(max_pivots, 2 * n // block_rows)))
    rows = blocks_of(rows, spark.sparkContext.broadcast(pivots), block_rows)
    # one row for each block: a few numbers for block_rows rows
    blocks = rows.groupBy("block").agg(F.first("cell").alias("cell"), F.min("away").alias("lo"), F.max("away").alias("hi"),
                                       F.count(F.lit(1)).alias("n")).orderBy("block").collect()
    layout = spark.sparkContext.broadcast(Layout(pivots, blocks))
    asks = rows.where("asks").withColumn("bound", F.lit(float("inf")))
    near = reliable_checkpoint(_merged(_visits(rows, asks, layout, k, False), k))
    if len(blocks) > 1:
        reach = F.when(F.size("near") >= k, F.element_at("near", k)["dist"] * (1 + 1e-12)).otherwise(float("inf"))
        bounded = asks.drop("bound").join(near.select(F.col("qidx").alias("idx"), reach.alias("bound")), "idx", "left")
        bounded = bounded.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        more = near.select("qidx", F.explode("near").alias("p")).select("qidx", "p.nidx", "p.tie", "p.dist")
        near = _merged(more.unionByName(_visits(rows, bounded, layout, k, True)), k)
    pairs = near.select("qidx", F.explode("near").alias("p")).select("qidx", "p.nidx", "p.dist")
    copies = many.join(firsts, ["h1", "h2"]).select(F.col("idx").alias("qidx"), F.explode(F.slice(
        F.filter("first", lambda p: p["idx"] != F.col("idx")), 1, k)).alias("p"))
    pairs = pairs.unionByName(copies.select("qidx", F.col("p.idx").alias("nidx"), F.lit(0.0).alias("dist")))
    return indexed, reliable_checkpoint(pairs)


def lof_from_knn(pairs: DataFrame) -> DataFrame:
    """(qidx, lof) from exact neighbour lists."""
    kdist = pairs.groupBy(F.col("qidx").alias("nidx")).agg(F.max("dist").alias("kdist"))
    reach = pairs.join(kdist, "nidx").select("qidx", "nidx", F.greatest("dist", "kdist").alias("reach"))
    lrd = reach.groupBy("qidx").agg((F.lit(1.0) / (F.avg("reach") + F.lit(LRD_EPS))).alias("lrd"))
    nbr = pairs.join(lrd.withColumnRenamed("qidx", "nidx").withColumnRenamed("lrd", "nlrd"), "nidx")
    ratio = nbr.groupBy("qidx").agg(F.avg("nlrd").alias("mean_nlrd"))
    return ratio.join(lrd, "qidx").select("qidx", (F.col("mean_nlrd") / F.col("lrd")).alias("lof"))


def lof(features: DataFrame, key: Sequence[str], names: Sequence[str], k: int = N_NEIGHBORS) -> DataFrame:
    """(key..., score) with score = LOF (higher is more anomalous)."""
    key = list(key)
    indexed, pairs = knn(features, key, names, k)
    scores = lof_from_knn(pairs).withColumnRenamed("qidx", "idx")
    return indexed.join(scores, "idx").select(*[c(x) for x in key], F.col("lof").alias("score"))


def knn_with_keys(features: DataFrame, key: str, names: Sequence[str], k: int = N_NEIGHBORS) -> DataFrame:
    """(key, neighbour key, dist) for a single-column key."""
    indexed, pairs = knn(features, [key], names, k)
    m = indexed.select(F.col("idx"), c(key).alias("_k"))
    return (pairs.join(m.withColumnRenamed("idx", "qidx").withColumnRenamed("_k", key), "qidx")
            .join(m.withColumnRenamed("idx", "nidx").withColumnRenamed("_k", f"nbr_{key}"), "nidx")
            .select(c(key), c(f"nbr_{key}"), "dist"))
