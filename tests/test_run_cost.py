"""Steps of a whole run that once took more work than their result needs."""

import numpy as np

from anomspark.operators import features as FE
from anomspark.operators.detectors import lof as L
from anomspark.plans.ordering import ROW_NAME, group_index, with_row_id


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_hold_term_counts_and_no_texts(spark):
    texts = ["red fox", "red red hen", None, "", "fox den", "red fox"]
    df = spark.createDataFrame([(i, t, float(i)) for i, t in enumerate(texts)], "k long, t string, v double")
    feats, spec = FE.fit_transform(df, {"text_columns": ["t"], "scale_continuous": True}, ["k"])
    assert spec.text_vocab["t"] == FE.fit_vocabulary(df, "t")
    assert "regexp_extract_all" not in plan(feats)  # the features were planned from the texts
    names = [f"t_tfidf_{t}" for t, _ in spec.text_vocab["t"]]
    want = FE.tfidf_frame(df, "t", spec.text_vocab["t"], ["k"]).orderBy("k").toPandas()[names].to_numpy("float32")
    assert np.array_equal(feats.orderBy("k").toPandas()[names].to_numpy("float32"), want)


def test_row_ids_shuffle_rows_once(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(200)], "k long, v long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(group_index(df, ["k"]))
        out = with_row_id(df, ["k"])
        rows = out.orderBy(ROW_NAME).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [r[ROW_NAME] for r in rows] == list(range(200)) and [r.k for r in rows] == sorted(r.k for r in rows)
    assert out.orderBy(ROW_NAME).collect() == rows


def test_queries_without_a_row_within_their_bound_are_not_ranked(monkeypatch):
    r = np.random.default_rng(4)
    x, q = r.normal(size=(300, 4)), np.concatenate([r.normal(size=(6, 4)), 50 + r.normal(size=(90, 4))])
    idx, me, bound = np.arange(300), 1000 + np.arange(96), np.full(96, 1.0)
    bound[0] = np.inf
    ranked, real = [], np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda a, *args, **kw: ranked.append(len(a)) or real(a, *args, **kw))
    i, j, dist = L._nearest(x, idx, idx, q, me, bound, 5)
    away = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    want = [(a, b) for a in range(96) for b in np.argsort(away[a])[:5] if away[a, b] <= bound[a]]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want and np.allclose(dist, away[i, j])
    assert sum(ranked) <= 6
