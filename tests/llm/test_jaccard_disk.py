"""What the steps of op8 and of the pipeline's near_duplicates send and broadcast where tables are too large to broadcast."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from anomspark.llm import common, jaccard_join


def families(seed=3, n=60):
    """Families of near copies with a passage that several families share."""
    r = random.Random(seed)
    base = [[f"f{f}w{r.randrange(4000)}" for _ in range(60)] for f in range(6)]
    passage = [f"p{r.randrange(4000)}" for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(base[i % 6])
        w[r.randrange(len(w))] = f"m{i}"
        rows.append((i, " ".join(w + passage if i % 2 else w)))
    return rows


def sets(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def classes(rows):
    found, top = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if 100 * both >= 75 * (len(found[i]) + len(found[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [4096, 8])
def test_rows_go_to_their_shingle_once_without_lists(spark, monkeypatch, block):
    """Rows with a whole list of shingles once went through a join by shingle when the table of shared shingles was too
    large to broadcast: 22.6 GB for 0.51 GB of documents."""
    plans = []
    grouped = jaccard_join._grouped

    def seen(rows):
        if "head" in rows.columns:
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return grouped(rows)
    monkeypatch.setattr(jaccard_join, "_grouped", seen)
    limit = common.BROADCAST_ROWS if block == 8 else 0
    monkeypatch.setattr(jaccard_join, "checked_broadcast", lambda df, *a: common.checked_broadcast(df, None, limit))
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = families()
    try:
        got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert {r.doc_id: r.component_id for r in got} == classes(rows)
    assert len(plans) == 1 and "Exchange hashpartitioning(token" not in plans[0]


def test_near_copies_are_what_is_broadcast(spark, monkeypatch):
    """The kept documents, which are most, once were broadcast, or beyond the limit all texts shuffled."""
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(20))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(3)]
    sizes, checked = [], common.checked_broadcast

    def seen(df, *a):
        sizes.append((df.columns, df.count()))
        return checked(df, *a)
    monkeypatch.setattr(common, "checked_broadcast", seen)
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(map(tuple, kept)) == collections.Counter(rows[:40])
    assert [n for names, n in sizes if names == ["_kid"]] == [3]


def test_largest_class_of_a_group():
    r = np.random.default_rng(1)
    group, comp = np.sort(r.integers(0, 40, 400)), r.integers(-3, 3, 400)
    group = np.unique(group, return_inverse=True)[1]
    want = [max(collections.Counter(comp[group == g].tolist()).items(), key=lambda x: (x[1], x[0]))[0] for g in range(group[-1] + 1)]
    assert jaccard_join._largest_class(group, comp).tolist() == want


def test_filter_over_batches_of_one_class_groups():
    """Groups of one class are left out whatever batch they come in, and a given largest class is kept."""
    names = ["token", "block", "sig", "n", "comp", "pos", "more", "index", "top", "head"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
    rows = [(1, 0, 10 + i, 20, 7, 0, 5, True, None, []) for i in range(3)]
    rows += [(2, 0, 20 + i, 20, 7 if i else 8, 0, 5, True, None, []) for i in range(3)]
    rows += [(3, 0, 30 + i, 20, 5 + i, 0, 5, True, 6, []) for i in range(2)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i:i + 2]], t) for k, t in enumerate(kinds)], names=names)
               for i in range(0, len(rows), 2)]
    out = [r for b in jaccard_join._with_partner(75)(batches) for r in b.to_pylist()]
    assert {(r["token"], r["sig"], r["top"]) for r in out} == {(2, 20, 7), (2, 21, 7), (2, 22, 7), (3, 30, 6), (3, 31, 6)}
    assert not list(jaccard_join._with_partner(75)(batches[:1]))
