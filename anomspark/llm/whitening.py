"""Operator 12: whitening by pivoted Cholesky and one-sided Jacobi.

Entries become integers (floor of 256 times the entry).  Each distinct vector counts once in the fit list.  Sums,
and then sums of products of the entries less their rounded mean, are exact integers: numpy adds them up in each
task, a tree of tasks adds these up, and the driver gets one row of d and one of d (d + 1) / 2 numbers.  The scatter matrix
is factored by Cholesky with pivots; one-sided Jacobi rotates the columns of the triangular factor until they are
orthogonal.  Their squared norms over n are the eigenvalues, their directions the components, which the scan of
the rows applies.

Results: a null vector, an empty one, or one with a null, non-finite or enormous entry (2**32 and more) takes
no part and has no row; nor has one of another length than most vectors have (the longer of two as common); rows
that repeat each have theirs, a null id too.  Where the covariance has a lower rank than the components asked for,
there are only as many (none at all for a single distinct vector).  A ``deviation`` beyond 64 bits is null.  An empty
table gives an empty result; other columns are ignored.  The largest loading of each component is positive.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomspark.llm.common import read, reliable_checkpoint
from anomspark.llm.vectors import scaled, valid, width_of
from anomspark.operators.partials import tree_sum

LARGEST = 2.0 ** 32
EXACT = pa.decimal128(38, 0)


class Whitening(NamedTuple):
    """The fit: number of distinct vectors, entry sums (integers), rounded means, components (rows),
    eigenvalues, their share of the trace."""

    n: int
    sums: list[int]
    centre: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray


# ---- factorisation of a d x d matrix

def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``m`` (d x rank) with ``m @ m.T == a``: the triangular factor, its rows in the order of ``a``."""
    a = np.array(a, float)
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    rest = a.diagonal().copy()
    least = d * np.finfo(float).eps * rest.max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(rest[order[k:]]))
        order[[k, p]] = order[[p, k]]
        i, below = order[k], order[k + 1:]
        if rest[i] <= least:
            return factor[:, :k]
        factor[i, k] = np.sqrt(rest[i])
        factor[below, k] = (a[below, i] - factor[below, :k] @ factor[i, :k]) / factor[i, k]
        rest[below] -= factor[below, k] ** 2
    return factor


def one_sided_jacobi(m: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``m`` rotated until they are orthogonal, longest first.  The pairs of a sweep are dealt
    like a round-robin tournament, so that the pairs of one round are rotated together."""
    m = m.copy()
    r = m.shape[1]
    seats = np.arange(r + r % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[:len(seats) // 2], seats[::-1][:len(seats) // 2]
            both = (p < r) & (q < r)
            x, y = m[:, p[both]], m[:, q[both]]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            go = np.abs(c) > 1e-15 * np.sqrt(a * b)
            if go.any():
                turned = True
                zeta = (b[go] - a[go]) / (2 * c[go])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.hypot(1, t)
                x, y = x[:, go], y[:, go]
                m[:, p[both][go]], m[:, q[both][go]] = cos * (x - t * y), cos * (t * x + y)
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if not turned:
            break
    return m[:, np.argsort(-(m * m).sum(axis=0), kind="stable")]


# ---- sums in tasks

def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, width)


def _handed(n: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[Decimal(int(v)) for v in values]], pa.list_(EXACT))],
                                      names=["n", "v"])


def _sums(width: int):
    """Number of vectors and sums of the entries."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for b in batches:
            x = _matrix(b.column(0), width)
            n += len(x)
            total += x.sum(axis=0).astype(object)  # fewer than 2**23 vectors a batch
        if n:
            yield _handed(n, total)
    return run


def _products(width: int, centre: np.ndarray):
    """Sums of products of the entries less ``centre`` (upper triangle), exact."""
    upper = np.triu_indices(width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((width, width), object)
        for b in batches:
            z = _matrix(b.column(0), width) - centre
            n += len(z)
            most = int(np.abs(z).max(initial=0))
            if most * most * len(z) < 1 << 53:
                f = z.astype(float)
                total += (f.T @ f).astype(np.int64).astype(object)
            else:
                z = z.astype(object)
                total += z.T @ z
        if n:
            yield _handed(n, total[upper])
    return run


def fit_whitening(fit: DataFrame, width: int, components: int) -> Whitening | None:
    """The whitening of a table of distinct integer vectors ``x`` of ``width`` entries."""
    exact = "n long, v array<decimal(38,0)>"
    sums = tree_sum(fit.mapInArrow(_sums(width), exact))
    if sums is None:
        return None
    n, total = sums[0], sums[1].tolist()
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    product = tree_sum(fit.mapInArrow(_products(width, centre), exact))[1].tolist()
    left = [s - n * int(m) for s, m in zip(total, centre, strict=True)]  # sums less n times the centre
    scatter = np.zeros((width, width))
    for i, j, v in zip(*(u.tolist() for u in np.triu_indices(width)), product, strict=True):
        scatter[i, j] = scatter[j, i] = (n * v - left[i] * left[j]) / n  # of whole numbers: rounded once
    rotated = one_sided_jacobi(pivoted_cholesky(scatter))[:, :components]
    norm = np.sqrt((rotated * rotated).sum(axis=0))
    parts = (rotated / norm).T
    top = np.abs(parts).argmax(axis=1)
    parts *= np.sign(parts[np.arange(len(parts)), top])[:, None]
    values = norm ** 2 / n
    trace = scatter.trace() / n
    return Whitening(n, total, centre, parts, values, values / trace if trace else values)


# ---- rows

def _whitened(w: Whitening, x: np.ndarray) -> np.ndarray:
    left = np.array([(s - w.n * int(m)) / w.n for s, m in zip(w.sums, w.centre, strict=True)])
    return ((x - w.centre) - left) @ w.components.T / np.sqrt(w.values)


def _second_moments(w: Whitening):
    k = len(w.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(k + k * k)
        for b in batches:
            y = _whitened(w, _matrix(b.column(0), len(w.sums)))
            n += len(y)
            total[:k] += y.sum(axis=0)
            total[k:] += (y.T @ y).ravel()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "v"])
    return run


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(w.values)
    n, total = tree_sum(fit.mapInArrow(_second_moments(w), "n long, v array<double>"))
    mean = total[:k] / n
    return float(np.abs(total[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(w: Whitening, x: np.ndarray) -> list[int | None]:
    z = x - w.centre
    left = [s - w.n * int(m) for s, m in zip(w.sums, w.centre, strict=True)]
    most = w.n * int(np.abs(z).max(initial=0)) + max(map(abs, left))
    if z.shape[1] * most * most < 1 << 63:
        return ((w.n * z - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((w.n * z.astype(object) - np.array(left, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _rows(w: Whitening, error: float):
    k = len(w.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), len(w.sums))
            take = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(x) * k, w.n)), pa.array(_deviation(w, x), pa.int64()).take(take),
                 pa.array(_whitened(w, x).ravel()), pa.array(np.tile(w.explained, len(x))),
                 pa.array(np.full(len(x) * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """For each row and component: ``id_col, component, n, deviation, whitened, explained, identity_error``."""
    spark, kind = table.sparkSession, table.schema[id_col].dataType.simpleString()
    vector = F.col(f"`{vector_col}`")
    rows = table.where(valid(vector, LARGEST)).select(F.col(f"`{id_col}`").alias("id"), scaled(vector).alias("x"))
    schema = (f"id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    width = width_of(rows)
    rows = rows.where(F.size("x") == width)
    fit = reliable_checkpoint(rows.select("x").distinct())
    w = fit_whitening(fit, width, components)
    if w is None or not len(w.values):
        out = spark.createDataFrame([], schema)
    else:
        out = rows.mapInArrow(_rows(w, identity_error(fit, w)), schema)
    return out.withColumnRenamed("id", id_col)


def op12_cholesky_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
