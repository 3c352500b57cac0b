"""Operator 12 against numpy's eigenvectors and whole-number arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from anomspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, x long"


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (7, 7), (12, 5), (33, 32)])
def test_factor_and_rotation(d, rank):
    r = np.random.default_rng(d)
    m = r.normal(size=(d, rank)) * np.logspace(0, -3, rank)
    a = m @ m.T
    f = whitening.pivoted_cholesky(a)
    assert f.shape == (d, rank) and np.allclose(f @ f.T, a, rtol=0, atol=1e-13 * np.abs(a).max())
    j = whitening.one_sided_jacobi(f)
    values, vectors = np.linalg.eigh(a)
    assert np.allclose((j * j).sum(axis=0), values[::-1][:rank], rtol=1e-9)
    along = np.abs(((j / np.linalg.norm(j, axis=0)) * vectors[:, ::-1][:, :rank]).sum(axis=0))
    assert np.allclose(along, 1, atol=1e-9)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def brute(rows, k=4):
    x = [(i, [int(np.floor(np.float64(c) * 256)) for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    z = np.array([[float(Fraction(v[j]) - Fraction(s[j], n)) for j in range(d)] for v in fit])
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    out = []
    for i, v in x:
        dev = sum((n * v[j] - s[j]) ** 2 for j in range(d))
        c = np.array([float(Fraction(v[j]) - Fraction(s[j], n)) for j in range(d)])
        for m in range(min(k, d)):
            e, u = values[-1 - m], vectors[:, -1 - m]
            out.append((i, m + 1, n, dev, abs(c @ u / np.sqrt(e)), e / cov.trace()))
    return out


def same(found, rows):
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_whiten(spark):
    r = np.random.default_rng(3)
    plain = [(i, np.float32(r.normal(size=6) * [3, 2, 1.5, 1, .5, .2] + 10).tolist()) for i in range(200)]
    plain += plain[:50] + [(300 + i, plain[0][1]) for i in range(100)] + [(None, plain[1][1])]
    bad = [(900, None), (901, [1.0] * 5 + [None]), (902, [1.0] * 5 + [float("nan")]), (903, [1.0] * 5 + [float("inf")]),
           (904, []), (905, [1.0] * 7), (906, [1e30] * 6)]
    table = spark.createDataFrame([(i, v, "n", 1) for i, v in plain + bad], SCHEMA).repartition(5)
    found = whitening.whiten(table).collect()
    assert all((r.whitened is not None) for r in found)
    same(found, plain)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2 ** 30 + 64 * i), float(-2 ** 31 + 128 * (i * i % 17)), float(i % 3)]) for i in range(40)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {(i, d) for i, _, _, d, *_ in brute(rows)}
    assert {(r.vec_id, r.deviation) for r in found} == want
    wide = spark.createDataFrame([(1, [4e9]), (2, [-4e9]), (3, [0.0])] + [(4 + i, [float(i)]) for i in range(9)],
                                 "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(wide).where("vec_id = 1").collect()} == {None}


def test_few_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], "", 0)] * 3, SCHEMA)
    assert whitening.whiten(one).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], "", 0) for i in range(5)], SCHEMA)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = whitening.op12_cholesky_jacobi(spark, sf)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                          ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    same(out.collect(), rows)
