"""Isolation forest (Liu, Ting & Zhou 2008), 200 trees on 256-row subsamples.

* Sampling: rows are numbered, each tree draws ``psi`` different numbers (a seeded uniform subsample),
  and the numbers, ``trees * psi`` at most, are broadcast to the scan: only the drawn vectors are shuffled.
* Growing: ``groupBy(tree).applyInPandas`` -- each group holds at most ``psi`` rows.
* Scoring: the forest (at most ``trees * (2 psi - 1)`` nodes) is broadcast and every
  partition computes path lengths with numpy in ``mapInPandas``.
Score = 2 ** (-E[h(x)] / c(psi)); higher is more anomalous.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anomspark.plans.ordering import ROW_NAME, c, with_row_id

# Forest size and subsample size.
N_TREES = 200
MAX_SAMPLES = 256
SEED = 42


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search, c(n)."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + np.euler_gamma) - 2.0 * (nb - 1.0) / nb
    return out


def _grow(max_depth: int, seed: int, d: int):
    schema_cols = ["tree", "node", "feat", "thr", "left", "right", "size", "depth"]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("row")
        x = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, d))
        rng = np.random.default_rng(seed + tree)
        rows = []
        stack = [(np.arange(len(x)), 0, 0)]
        next_id = 1
        while stack:
            members, depth, node = stack.pop()
            sub = x[members]
            feat, thr, left, right = -1, 0.0, -1, -1
            if depth < max_depth and len(members) > 1:
                lo, hi = sub.min(axis=0), sub.max(axis=0)
                usable = np.flatnonzero(hi > lo)
                if len(usable):
                    feat = int(rng.choice(usable))
                    thr = float(rng.uniform(lo[feat], hi[feat]))
                    go_left = sub[:, feat] <= thr
                    left, right = next_id, next_id + 1
                    next_id += 2
                    stack.append((members[go_left], depth + 1, left))
                    stack.append((members[~go_left], depth + 1, right))
            rows.append((tree, node, feat, thr, left, right, len(members), depth))
        return pd.DataFrame(rows, columns=schema_cols)
    return grow


FOREST_SCHEMA = "tree int, node int, feat int, thr double, left int, right int, size long, depth int"


def draw(rng: np.random.Generator, n: int, psi: int) -> np.ndarray:
    """``psi`` different numbers of ``range(n)``, every subset alike likely (Floyd's algorithm: no list of n)."""
    chosen: set[int] = set()
    for j in range(n - psi, n):
        i = int(rng.integers(0, j + 1))
        chosen.add(j if i in chosen else i)
    return np.sort(np.fromiter(chosen, np.int64, psi))


def fit_forest(vec: DataFrame, n: int, n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES,
               seed: int = SEED) -> tuple[pd.DataFrame, int, int]:
    """Grow the forest on ``vec`` (row id and ``x``); returns (node table, psi, d)."""
    psi = min(max_samples, n)
    d = len(vec.select("x").first()["x"])
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rng = np.random.default_rng(seed)
    drawn = pd.DataFrame([(int(i), t) for t in range(n_trees) for i in draw(rng, n, psi)], columns=["row", "tree"])
    picks = F.broadcast(vec.sparkSession.createDataFrame(drawn, "row long, tree int"))  # n_trees * psi rows
    sample = vec.join(picks, vec[ROW_NAME] == picks["row"]).select("tree", "row", "x")
    nodes = sample.groupBy("tree").applyInPandas(_grow(max_depth, seed, d), FOREST_SCHEMA).toPandas()
    return nodes, psi, d


def _score_fn(forest_bc, psi: int, key: Sequence[str]):
    def score(batches):
        nodes = forest_bc.value
        trees = []
        for _, t in nodes.groupby("tree"):
            t = t.sort_values("node")
            size = t["node"].max() + 1
            feat = np.full(size, -1)
            thr = np.zeros(size)
            left = np.zeros(size, dtype=int)
            right = np.zeros(size, dtype=int)
            path = np.zeros(size)
            ids = t["node"].to_numpy()
            feat[ids] = t["feat"].to_numpy()
            thr[ids] = t["thr"].to_numpy()
            left[ids] = t["left"].to_numpy()
            right[ids] = t["right"].to_numpy()
            path[ids] = t["depth"].to_numpy() + c_factor(t["size"].to_numpy())
            trees.append((feat, thr, left, right, path))
        norm = float(c_factor([psi])[0]) or 1.0
        for pdf in batches:
            if pdf.empty:
                yield pd.DataFrame({**{k: pdf[k] for k in key}, "score": pd.Series([], dtype=float)})
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(float)
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for feat, thr, left, right, path in trees:
                node = np.zeros(len(x), dtype=int)
                while True:
                    f = feat[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    fi = np.where(inner, f, 0)
                    go_left = x[rows, fi] <= thr[node]
                    node = np.where(inner, np.where(go_left, left[node], right[node]), node)
                total += path[node]
            mean_h = total / len(trees)
            out = {k: pdf[k].to_numpy() for k in key}
            out["score"] = np.power(2.0, -mean_h / norm)
            yield pd.DataFrame(out)
    return score


def isolation_forest(features: DataFrame, key: Sequence[str], names: Sequence[str],
                     n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES, seed: int = SEED) -> DataFrame:
    """(key..., score) with score = 2^(-E[h]/c(psi))."""
    key = list(key)
    vec = features.select(*[c(k) for k in key],
                          F.array(*[F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in names]).alias("x"))
    if ROW_NAME not in key:  # a run's features are numbered already
        vec = with_row_id(vec)
    n = vec.count()
    nodes, psi, _ = fit_forest(vec, n, n_trees, max_samples, seed)
    bc = features.sparkSession.sparkContext.broadcast(nodes)
    key_fields = [f for f in vec.schema.fields if f.name in key]
    schema = T.StructType(key_fields + [T.StructField("score", T.DoubleType())])
    return vec.select(*[c(k) for k in key], "x").mapInPandas(_score_fn(bc, psi, key), schema)
