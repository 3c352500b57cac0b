"""Data-parallel training for the model-based detectors.

Each epoch is one Spark job: the current parameters are broadcast, every partition
runs mini-batch Adam steps on its own rows (``mapInPandas``) and returns its updated
parameters with its row count; the driver averages them, weighted by rows.  Only
parameter vectors (fixed size, independent of the data) cross the driver.  Scoring
is a ``mapInPandas`` forward pass with the final parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anomspark.plans.ordering import c


def vectorize(features: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    return features.select(*[c(k) for k in key],
                           F.array(*[F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in names]).alias("x"))


def _stack(pdf: pd.DataFrame, d: int) -> np.ndarray:
    if len(pdf) == 0:
        return np.zeros((0, d))
    return np.stack(pdf["x"].to_numpy()).astype(float)


class Model:
    """Interface: parameters as a flat vector; loss gradient on a batch; scores."""

    def init(self, rng: np.random.Generator, d: int) -> np.ndarray: ...
    def grad(self, theta: np.ndarray, xb: np.ndarray, rng: np.random.Generator) -> np.ndarray: ...
    def score(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray: ...
    def embed(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray | None:
        return None
    def prep_stat(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray | None:
        """Per-row statistic averaged over all rows before training (or None)."""
        return None

    def prepare(self, theta: np.ndarray, mean_stat: np.ndarray | None) -> np.ndarray:
        return theta


def _epoch_fn(model: Model, theta_bc, d: int, epoch: int, seed: int, batch: int, lr: float,
              local_epochs: int = 1):
    def run(batches):
        from pyspark import TaskContext
        parts = [_stack(pdf, d) for pdf in batches]
        x = np.concatenate(parts) if parts else np.zeros((0, d))
        theta = theta_bc.value.copy()
        n = len(x)
        if n == 0:
            yield pd.DataFrame({"theta": [theta.tolist()], "n": [0]})
            return
        pid = TaskContext.get().partitionId() if TaskContext.get() else 0
        rng = np.random.default_rng([seed, epoch, pid])
        m = np.zeros_like(theta)
        v = np.zeros_like(theta)
        b1, b2, eps = 0.9, 0.999, 1e-8
        step = 0
        for _ in range(local_epochs):
            order = rng.permutation(n)
            for start in range(0, n, batch):
                xb = x[order[start:start + batch]]
                g = model.grad(theta, xb, rng)
                step += 1
                m = b1 * m + (1 - b1) * g
                v = b2 * v + (1 - b2) * g * g
                mh = m / (1 - b1 ** step)
                vh = v / (1 - b2 ** step)
                theta = theta - lr * mh / (np.sqrt(vh) + eps)
        yield pd.DataFrame({"theta": [theta.tolist()], "n": [n]})
    return run


def train(model: Model, vec: DataFrame, d: int, epochs: int, batch: int = 64, lr: float = 1e-3,
          seed: int = 42, sync_every: int = 5) -> np.ndarray:
    """Fit ``model`` on the ``x`` column of ``vec``.

    ``epochs`` passes over the data in total; partitions average their parameters every
    ``sync_every`` local epochs (one Spark job per synchronisation)."""
    from anomspark.session import reliable_checkpoint
    vec = reliable_checkpoint(vec.select("x"))
    sc = vec.sparkSession.sparkContext
    rng = np.random.default_rng(seed)
    theta = model.init(rng, d)
    schema = "theta array<double>, n long"
    if model.prep_stat(theta, np.zeros((1, d))) is not None:
        bc0 = sc.broadcast(theta)

        def stat(batches):
            tot, n = None, 0
            for pdf in batches:
                x = _stack(pdf, d)
                if len(x):
                    s_ = model.prep_stat(bc0.value, x).sum(axis=0)
                    tot = s_ if tot is None else tot + s_
                    n += len(x)
            if n:
                yield pd.DataFrame({"theta": [tot.tolist()], "n": [n]})
        rows = vec.select("x").mapInPandas(stat, schema).collect()
        tot = sum(r["n"] for r in rows)
        mean_stat = sum(np.asarray(r["theta"]) for r in rows) / tot if tot else None
        theta = model.prepare(theta, mean_stat)
    done = 0
    while done < epochs:
        local = min(sync_every, epochs - done)
        bc = sc.broadcast(theta)
        rows = vec.mapInPandas(_epoch_fn(model, bc, d, done, seed, batch, lr, local), schema).collect()
        done += local
        bc.unpersist()
        tot = sum(r["n"] for r in rows)
        if tot == 0:
            break
        theta = sum(np.asarray(r["theta"]) * r["n"] for r in rows if r["n"]) / tot
    return theta


def score_frame(model: Model, theta: np.ndarray, vec: DataFrame, key: Sequence[str], d: int,
                embed: bool = False) -> DataFrame:
    """(key..., score) or, with ``embed``, (key..., embedding_0..)."""
    key = list(key)
    bc = vec.sparkSession.sparkContext.broadcast(theta)
    key_fields = [f for f in vec.schema.fields if f.name in key]
    if embed:
        probe = model.embed(theta, np.zeros((1, d)))
        k = probe.shape[1] if probe is not None else 0
        fields = key_fields + [T.StructField(f"embedding_{i}", T.DoubleType()) for i in range(k)]
    else:
        fields = key_fields + [T.StructField("score", T.DoubleType())]

    def fn(batches):
        th = bc.value
        for pdf in batches:
            x = _stack(pdf, d)
            out = {kk: pdf[kk].to_numpy() for kk in key}
            if embed:
                e = model.embed(th, x) if len(x) else np.zeros((0, len(fields) - len(key)))
                for i in range(e.shape[1]):
                    out[f"embedding_{i}"] = e[:, i]
            else:
                out["score"] = model.score(th, x) if len(x) else np.zeros(0)
            yield pd.DataFrame(out)
    return vec.mapInPandas(fn, T.StructType(fields))


# ---------------------------------------------------------------------------
# A small dense network with manual back-propagation (ReLU hidden, linear output).
# ---------------------------------------------------------------------------

class MLP:
    def __init__(self, sizes: Sequence[int], bias: bool = True):
        self.sizes = list(sizes)
        self.bias = bias
        self.shapes = []
        for a, b in zip(self.sizes[:-1], self.sizes[1:]):
            self.shapes.append((a, b))

    def n_params(self) -> int:
        return sum(a * b + (b if self.bias else 0) for a, b in self.shapes)

    def init(self, rng: np.random.Generator) -> np.ndarray:
        parts = []
        for a, b in self.shapes:
            parts.append(rng.normal(0, np.sqrt(2.0 / a), size=a * b))
            if self.bias:
                parts.append(np.zeros(b))
        return np.concatenate(parts)

    def unpack(self, theta: np.ndarray):
        out, pos = [], 0
        for a, b in self.shapes:
            w = theta[pos:pos + a * b].reshape(a, b)
            pos += a * b
            bb = None
            if self.bias:
                bb = theta[pos:pos + b]
                pos += b
            out.append((w, bb))
        return out

    def forward(self, theta: np.ndarray, x: np.ndarray, linear_last: bool = True):
        acts = [x]
        h = x
        layers = self.unpack(theta)
        for i, (w, b) in enumerate(layers):
            z = h @ w + (b if b is not None else 0.0)
            last = i == len(layers) - 1
            h = z if (last and linear_last) else np.maximum(z, 0.0)
            acts.append(h)
        return acts

    def backward(self, theta: np.ndarray, acts, grad_out: np.ndarray, linear_last: bool = True) -> tuple[np.ndarray, np.ndarray]:
        layers = self.unpack(theta)
        grads = []
        g = grad_out
        for i in range(len(layers) - 1, -1, -1):
            w, b = layers[i]
            last = i == len(layers) - 1
            if not (last and linear_last):
                g = g * (acts[i + 1] > 0)
            gw = acts[i].T @ g
            grads.append((gw, g.sum(axis=0) if self.bias else None))
            g = g @ w.T
        parts = []
        for gw, gb in reversed(grads):
            parts.append(gw.ravel())
            if self.bias:
                parts.append(gb)
        return np.concatenate(parts), g
