"""Operator 11 against brute force."""

import math

import numpy as np
import pytest

from anomspark.llm import lemp

SCHEMA = "vec_id long, embedding array<float>, label int, idx string, bands int"
RELABEL = "case when id % 7 = 0 then (label + 1) % 10 else label end"


def brute(rows, every=50, positives=5):
    v = [(i, (k + 1) % 10 if i % 7 == 0 else k, [math.floor(np.float64(c) * 256) for c in x]) for i, x, k in rows]
    out = []
    for a, (i, k, x) in enumerate(v):
        if i % every:
            continue
        score = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j, b, m) for b, (j, m, y) in enumerate(v) if b != a)
        for s, j, _, _ in [r for r in score if r[3] == k][:positives]:
            band = [(j2, -s2) for s2, j2, _, m in score if m != k and 50 * -s <= 100 * -s2 <= 95 * -s][:3]
            out += [(i, j, n + 1, j2, -s, s2) for n, (j2, s2) in enumerate(band)]
    return sorted(out)


def mined(table, **options):
    return sorted(tuple(r) for r in lemp.hard_negatives(table, "id % 50 = 0", relabel=RELABEL, **options).collect())


@pytest.mark.parametrize("bucket", [64, 4096])
def test_against_brute_force(spark, bucket):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 8)) * np.exp(r.normal(size=(400, 1)))
    x[100:220] = x[100]  # equal vectors, ties by id
    x[300:320] = 0
    x[250:300] = np.round(x[250:300])
    rows = [(int(i), np.float32(v).tolist(), int(k)) for i, v, k in zip(r.permutation(400), x, r.integers(0, 4, 400), strict=True)]
    bad = [(50, None, 1), (100, [1.0] * 7 + [None], 1), (150, [1.0] * 7 + [float("inf")], 1), (200, [1.0] * 8, None),
           (None, [1.0] * 8, 1), (250, [], 1), (300, [1.0] * 5, 1), (350, [1e9] * 8, 1)]
    table = spark.createDataFrame([(i, v, k, "s", 1) for i, v, k in rows + bad], SCHEMA).repartition(5)
    assert mined(table, bucket=bucket) == brute(rows)


def test_pruning_keeps_every_row_that_reaches():
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(500, 4)) * 200).astype(np.int64)
    b = lemp.Bucket(x, np.arange(500), np.arange(500), np.zeros(500, np.int64))
    pruned = 0
    for q in np.floor(r.normal(size=(60, 4)) * 200):
        score = x @ q.astype(np.int64)
        for least in np.sort(score)[[10, 250, 400, 480, 499]].tolist():
            c = b.candidates(q, least)
            c = np.arange(500) if c is None else c
            assert set(np.flatnonzero(score >= least)) <= set(c.tolist())
            pruned += 500 - len(c)
    assert pruned > 10_000


def test_repeated_and_few_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [2.0, 1.0], 2), (3, [1.0, 0.5], 2), (3, [1.0, 0.5], 2), (2, [.6, 0.0], 3)]
    table = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    assert mined(table) == brute(rows)
    assert mined(table.where("vec_id in (0, 2)")) == brute([r for r in rows if r[0] in (0, 2)])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    out = lemp.op11_lemp_negatives(spark, sf)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, out.collect())) == brute(rows)
