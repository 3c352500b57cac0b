"""Exact neighbours against brute force: clusters, copies, isotropic vectors, few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from anomspark.operators.detectors import lof as L


def frame(spark, x, keys=None):
    names = [f"f{i}" for i in range(x.shape[1])]
    keys = range(len(x)) if keys is None else keys
    rows = [(int(k), *map(float, r)) for k, r in zip(keys, x, strict=True)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names)).repartition(5), names


def brute(x, k):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        for j in np.lexsort((np.arange(len(x)), d))[:k]:
            if np.isfinite(d[j]):
                out.append((i, int(j), round(float(d[j]), 9)))
    return out


def found(spark, x, k, **options):
    df, names = frame(spark, x)
    indexed, pairs = L.knn(df, ["k"], names, k, **options)
    name = {r["idx"]: r["k"] for r in indexed.collect()}
    return sorted((name[r["qidx"]], name[r["nidx"]], round(r["dist"], 9)) for r in pairs.collect())


def test_clusters_ties_and_copies(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(150, 3)) * .1 + 9 * c for c in (0, 1, 5)])
    x = np.concatenate([x, np.tile(x[3], (200, 1)), np.tile(x[200], (5, 1)), np.round(r.normal(size=(100, 3))), [[1e6, -1e6, 3]]])
    assert found(spark, x, 6, block_rows=40) == sorted(brute(x, 6))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_fewer_rows_than_neighbours(spark, n):
    x = np.arange(3.0 * n).reshape(n, 3)
    assert found(spark, x, 6) == sorted(brute(x, 6))
    assert found(spark, np.ones((n, 2)), 3) == sorted(brute(np.ones((n, 2)), 3))


def test_isotropic_vectors_keep_groups_bounded(spark):
    x = np.random.default_rng(9).normal(size=(900, 64))
    df, names = frame(spark, x)
    assert found(spark, x, 20, block_rows=64) == sorted(brute(x, 20))
    base = df.select(F.col("k").alias("idx"), F.col("k").alias("tie"), F.array(*names).alias("x"))
    rows, _, many = L.candidates(base, 20)
    pivots = L._pivots(rows, 900, 28)
    blocks = L.blocks_of(rows, spark.sparkContext.broadcast(pivots), 64).groupBy("block").count()
    assert blocks.agg(F.max("count"), F.sum("count")).first()[:] == (64, 900) and many.count() == 0


def test_a_hot_vector_costs_few_candidates(spark):
    x = np.concatenate([np.zeros((500, 4)), np.random.default_rng(1).normal(size=(60, 4))])
    df, names = frame(spark, x)
    rows, firsts, many = L.candidates(df.select(F.col("k").alias("idx"), F.col("k").alias("tie"), F.array(*names).alias("x")), 20)
    assert (rows.count(), rows.where("asks").count(), many.count(), firsts.count()) == (81, 60, 500, 1)


def test_bounds_never_exceed_the_distance():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(300, 5)), 1e3 + r.normal(size=(50, 5)) * 1e-3])
    p = x[r.permutation(350)[:12]]
    d = np.sqrt(((x[:, None] - p[None]) ** 2).sum(2))
    cell, away = d.argmin(1), d.min(1)
    blocks, member = [], []
    for c in range(12):
        mine = np.flatnonzero(cell == c)
        mine = mine[np.argsort(away[mine])]
        for i in range(0, len(mine), 9):
            m = mine[i:i + 9]
            blocks.append({"block": len(blocks), "cell": c, "lo": away[m].min(), "hi": away[m].max(), "n": len(m)})
            member.append(m)
    low = L.Layout(p, blocks).bounds(x, cell)
    for b, m in enumerate(member):
        real = np.sqrt(((x[:, None] - x[m][None]) ** 2).sum(2)).min(1)
        assert (low[:, b] <= real).all()
    assert (low > 0).mean() > .5


def test_vectors_travel_short_and_unrounded():
    single = np.random.default_rng(4).normal(size=(30, 8)).astype(np.float32).astype(float)
    packed = L._pack(single)
    assert {len(v) for v in packed.to_pylist()} == {32} and (L._unpack(packed, 8) == single).all()
    mixed = single.copy()
    mixed[::3, 2] = 0.1 + 1e300
    mixed[1, 0] = np.nan
    packed = L._pack(mixed)
    assert [len(v) for v in packed.to_pylist()][:4] == [64, 64, 32, 64]
    assert np.array_equal(L._unpack(packed, 8), mixed, equal_nan=True)
