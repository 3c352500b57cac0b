"""Preprocessing: tf-idf formula, encodings, scaling set, imputation."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from anomspark.operators import features as FE


def test_tfidf_matches_python(spark):
    docs = ["the cat sat on the mat", "The dog; the CAT!", "", None, "a b c dog dog dog", "mat mat cat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "k long, t string")
    vocab = FE.fit_vocabulary(df, "t", max_terms=3)
    toks = [re.findall(r"[^\W\d_]*\w{2,}", (t or "").lower()) for t in docs]
    toks = [[w for w in re.findall(r"\w+", (t or "").lower()) if len(w) >= 2] for t in docs]
    counts = Counter(w for ts in toks for w in ts)
    top = sorted(sorted(counts, key=lambda w: (-counts[w], w))[:3])
    assert [t for t, _ in vocab] == top
    n = len(docs)
    idf = {w: math.log((1 + n) / (1 + sum(w in ts for ts in toks))) + 1 for w in top}
    got = FE.tfidf_frame(df, "t", vocab, ["k"]).toPandas().set_index("k").sort_index()
    for i, ts in enumerate(toks):
        w = np.array([ts.count(t) * idf[t] for t in top])
        nrm = np.linalg.norm(w)
        exp = w / nrm if nrm > 0 else w
        assert np.allclose(got.loc[i, [f"t_tfidf_{t}" for t in top]].to_numpy(float), exp)


def test_tfidf_is_of_the_row_whatever_the_key(spark):
    rows = [(1, "cat dog"), (1, "dog dog"), (None, "cat"), (None, "bird"), (1, "cat dog")]
    df = spark.createDataFrame(rows, "k long, t string")
    vocab = FE.fit_vocabulary(df, "t", 2)
    out = FE.tfidf_frame(df, "t", vocab, ["k"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    a = math.sqrt(0.5)
    assert sorted(str((r[0], round(r[1], 6), round(r[2], 6))) for r in out.collect()) == sorted(
        str((k, round(x, 6), round(y, 6))) for k, x, y in [(1, a, a), (1, 0.0, 1.0), (None, 1.0, 0.0), (None, 0.0, 0.0), (1, a, a)])


def test_one_hot_and_frequency_with_nulls(spark):
    rows = [(i, ["a", "b", "c", "d", "e"][i % 5] if i % 7 else None,
             ["p", "q", "r", "s", "t", "u"][i % 6] if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, five string, six string")
    steps = {"encode_categorical": True, "exclude_id_columns": [], "text_columns": []}
    feats, spec = FE.fit_transform(df, steps, ["k"])
    assert spec.one_hot["five"] == ["a", "b", "c", "d", "e"]
    assert spec.freq_encoded == ["six"]
    pdf = feats.toPandas().set_index("k")
    null_rows = [i for i in range(60) if i % 7 == 0]
    assert (pdf.loc[null_rows, [f"five_{v}" for v in "abcde"]].sum(axis=1) == 0).all()
    assert (pdf.loc[[i for i in range(60) if i % 5 == 0], "six"] == 0.0).all()


def test_scaling_set_and_zero_iqr(spark):
    rows = [(i, ["x", "y"][i % 2], i * 3, 7) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, status string, status_code int, c int")
    steps = {"encode_categorical": True, "scale_continuous": True, "exclude_id_columns": [], "text_columns": []}
    feats, spec = FE.fit_transform(df, steps, ["k"])
    assert "status_code" not in spec.scaled   # starts with "status_"
    assert spec.scaled["c"] == (7.0, 1.0)     # zero IQR -> divide by 1
    assert feats.agg({"c": "max"}).first()[0] == 0.0


def test_median_and_mode_imputation(spark):
    rows = [(i, float(i) if i % 4 else None, "a" if i % 3 == 0 else ("b" if i % 3 == 1 else None)) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, v double, s string")
    steps = {"impute_missing": True, "encode_categorical": False, "exclude_id_columns": [], "text_columns": []}
    feats, spec = FE.fit_transform(df, steps, ["k"])
    vals = [float(i) for i in range(30) if i % 4]
    assert spec.medians["v"] == pytest.approx(float(np.median(vals)))
    assert spec.modes["s"] == "a"   # tie a/b (10 each) goes to the smaller value


def test_ffill_bfill(spark):
    pdf = pd.DataFrame({"k": range(10), "v": [None, None, 1.0, None, 3.0, None, None, 4.0, None, None]})
    out = FE.ffill_bfill(spark.createDataFrame(pdf), ["v"], ["k"], block_rows=3).toPandas().sort_values("k")
    assert list(out["v"]) == [1.0, 1.0, 1.0, 1.0, 3.0, 3.0, 3.0, 4.0, 4.0, 4.0]


def test_documents_feature_order(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    steps = {"scale_continuous": True, "encode_categorical": True, "exclude_id_columns": ["doc_id"],
             "text_columns": ["text"]}
    _, spec = FE.fit_transform(d, steps, ["doc_id"])
    names = spec.feature_names
    assert names[:2] == ["source", "n_chars"] and names[-4:] == ["lang_de", "lang_en", "lang_es", "lang_fr"]
    assert [n.split("_tfidf_")[1] for n in names[2:17]] == sorted(
        ["the", "of", "de", "and", "to", "in", "la", "der", "is", "that", "en", "it", "for", "was", "on"])
