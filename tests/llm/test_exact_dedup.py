"""Operator 13: code round trips, brute force, and odd tables."""

import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from anomspark.llm import exact_dedup, golomb

SCHEMA = "doc_id long, text string, _metadata string, `_row` long, words string"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 40) - 1), max_size=300))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert (golomb.decode(golomb.encode(v, 1 << 40)) == v).all()
    dense = np.arange(len(v), dtype=np.uint64)
    assert (golomb.decode(golomb.encode(dense, max(1, len(v)))) == dense).all()


def test_golomb_is_short():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 50_000, dtype=np.uint64))
    assert len(golomb.encode(v, 1 << 40)) * 8 < 27 * len(v)  # 1.5 bits above log2 of the mean gap (24.4)


def expected(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        name = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            kept = first and i == keep
            first = first and not kept
            out.append((i, keep, len(ids), kept, name))
    return sorted(out, key=str)


def table():
    rows = [(i, f"text {i % 37}" if i % 3 else f"own {i}", None, i, "w") for i in range(400)]
    rows += [(1000 + i, "hot " * 50, "m", None, None) for i in range(300)]
    rows += [(None, None, "m", 1, "x"), (None, "", None, None, None), (5, "", None, 1, None), (5, "", None, 2, None)]
    rows += [(None, "no id", None, 1, None)] * 2 + [(7, "á\n" * 40_000, None, 1, None)] * 2
    return rows + [(9, "Case", None, 0, ""), (10, "case", None, 0, ""), (11, "case ", None, 0, "")]


@pytest.mark.parametrize("size, owned", [(4096, 4 << 20), (6, 50)])
def test_against_brute_force(spark, size, owned):
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = [tuple(r) for r in exact_dedup.exact_classes(docs, size=size, owned=owned).collect()]
    assert sorted(out, key=str) == expected(rows)
    kept = exact_dedup.drop_copies(docs, size=size, owned=owned)
    assert kept.columns == docs.columns
    stays = sorted(str((e[0], e[4])) for e in expected(rows) if e[3])
    assert sorted(str((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())) for r in kept.collect()) == stays


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_classes(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = exact_dedup.op13_golomb_dedup(spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"),
                          ("text_sha256", "string")]
    assert sorted(map(tuple, out.collect()), key=str) == expected(rows)
