"""Detectors against brute force and on planted anomalies (F-20, F-21)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anomspark.operators import scoring as SC
from anomspark.operators.detectors.ecod import ecod
from anomspark.operators.detectors.lof import knn, lof


@pytest.fixture(scope="module")
def blob(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(500, 4))
    far = rng.uniform(6, 9, size=(10, 4)) * rng.choice([-1, 1], size=(10, 4))
    data = np.vstack([x, far])
    pdf = pd.DataFrame(data, columns=[f"f{i}" for i in range(4)])
    pdf.insert(0, "k", np.arange(len(pdf)))
    return spark.createDataFrame(pdf).checkpoint(eager=True), pdf


def top_share(scores: pd.DataFrame, planted=range(500, 510), frac=0.05):
    cut = scores["score"].quantile(1 - frac)
    return scores.set_index("k").loc[list(planted), "score"].ge(cut).mean()


def test_ecod_matches_numpy(blob):
    df, pdf = blob
    got = ecod(df, ["k"], [f"f{i}" for i in range(4)]).toPandas().set_index("k").sort_index()["score"]
    x = pdf[[f"f{i}" for i in range(4)]].to_numpy()
    n = len(x)
    le = np.array([(x[:, j][None, :] <= x[:, j][:, None]).sum(1) for j in range(4)]).T / n
    ge = np.array([(x[:, j][None, :] >= x[:, j][:, None]).sum(1) for j in range(4)]).T / n
    ul, ur = -np.log(le), -np.log(ge)
    m3 = ((x - x.mean(0)) ** 3).sum(0)
    o = np.where(np.sign(m3) == 0, ul + ur, np.maximum(ul, ur))
    assert np.allclose(got.to_numpy(), o.sum(1))


def test_lof_matches_brute_force(blob, spark):
    df, pdf = blob
    x = pdf[[f"f{i}" for i in range(4)]].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    k = 20
    nb = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, nb, 1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, nb, 1), kd[nb])
    lrd = 1 / (reach.mean(1) + 1e-10)
    exp = lrd[nb].mean(1) / lrd
    got = lof(df, ["k"], [f"f{i}" for i in range(4)]).toPandas().set_index("k").sort_index()["score"]
    assert np.allclose(got.to_numpy(), exp, rtol=1e-9)


def test_knn_small_blocks_equal(blob):
    df, _ = blob
    names = [f"f{i}" for i in range(4)]
    _, a = knn(df, ["k"], names, block_rows=64)
    _, b = knn(df, ["k"], names)
    pa = a.toPandas().sort_values(["qidx", "dist"]).reset_index(drop=True)
    pb = b.toPandas().sort_values(["qidx", "dist"]).reset_index(drop=True)
    assert np.allclose(pa["dist"], pb["dist"]) and len(pa) == 510 * 20


@pytest.mark.parametrize("name", ["isolation_forest", "ecod", "lof", "one_class_svm", "autoencoder", "vae",
                                  "deep_svdd"])
def test_planted_anomalies(blob, name):
    from anomspark.engine import DETECTORS
    df, _ = blob
    scores = DETECTORS[name](df, ["k"], [f"f{i}" for i in range(4)]).toPandas()
    assert len(scores) == 510
    assert top_share(scores) >= 0.8


def test_minmax_and_three_sigma(spark):
    const = spark.createDataFrame([(i, 3.0) for i in range(10)], "k long, score double")
    assert {r["score"] for r in SC.minmax(const).collect()} == {0.0}
    s = spark.createDataFrame([(i, 1.0 if i == 9 else 0.0) for i in range(10)], "k long, anomaly_score double")
    flagged = SC.three_sigma(s).where("is_anomaly").collect()
    assert [r["k"] for r in flagged] == [9]
    summ = SC.score_summary(s).first()
    assert summ["threshold"] == pytest.approx(1.0, abs=1e-12)


def test_ensemble_mean_and_bounds(blob):
    df, _ = blob
    names = [f"f{i}" for i in range(4)]
    a = SC.minmax(ecod(df, ["k"], names))
    b = SC.minmax(lof(df, ["k"], names))
    ens = SC.ensemble({"ecod": a, "lof": b}, ["k"]).toPandas()
    assert np.allclose(ens["anomaly_score"], (ens["score_ecod"] + ens["score_lof"]) / 2)
    assert ens["anomaly_score"].between(0, 1).all()


def test_pca_embedding_shape(blob):
    df, _ = blob
    emb = SC.pca_embedding(df, ["k"], [f"f{i}" for i in range(4)], 16).toPandas()
    assert [c for c in emb.columns if c.startswith("embedding_")] == [f"embedding_{i}" for i in range(4)]
    assert abs(emb["embedding_0"].mean()) < 1e-9


def test_resize_rule():
    from anomspark.operators.detectors.neural import resize_widths
    assert resize_widths([64, 32, 16, 32, 64], 9) == [32, 16, 8, 16, 32]
    assert resize_widths([64, 32], 21) == [64, 32]


def test_scores_invariant_to_partitioning(blob):
    """SURVEY §5 property: results do not depend on partitioning or row order."""
    df, _ = blob
    names = [f"f{i}" for i in range(4)]
    shuffled = df.orderBy(F.rand(7)).repartition(7)
    for det in (ecod, lof):
        a = det(df, ["k"], names).toPandas().sort_values("k").reset_index(drop=True)
        b = det(shuffled, ["k"], names).toPandas().sort_values("k").reset_index(drop=True)
        assert np.allclose(a["score"], b["score"])


def test_forest_samples_are_uniform_and_few(spark):
    from anomspark.operators.detectors import iforest as I
    from anomspark.plans.ordering import with_row_id
    rng = np.random.default_rng(3)
    hits = np.zeros(40)
    for _ in range(3000):
        s = I.draw(rng, 40, 7)
        assert len(set(s)) == 7
        hits[s] += 1
    assert abs(hits / 3000 - 7 / 40).max() < 0.035  # five standard deviations
    assert I.draw(rng, 5, 5).tolist() == [0, 1, 2, 3, 4]
    vec = with_row_id(spark.range(3000).select(F.array(F.col("id").cast("double")).alias("x")))
    nodes, psi, d = I.fit_forest(vec, 3000, n_trees=5)
    assert (psi, d) == (256, 1) and nodes[nodes.node == 0]["size"].tolist() == [256] * 5
