"""One-class SVM and neural detectors on the data-parallel trainer.

* one_class_svm: RBF kernel (gamma = 1/d) approximated by random Fourier features
  (Rahimi & Recht 2007), linear one-class SVM with nu = 0.5 trained by sub-gradient
  steps; score = rho - w.z(x).
* autoencoder: widths 64-32-16-32-64 (ReLU), reconstruction distance as score.
* vae: encoder 64-32-16, latent 16 (mean / log-variance), decoder 16-32-64; ELBO loss
  (Kingma & Welling 2014); reconstruction distance as score.
* deep_svdd / deep_svdd_sequential: bias-free 64-32 / 128-64-32 network, centre =
  mean initial output, loss and score = squared distance to the centre (Ruff et al.
  2018).  The "sequential" variant has only other widths and epochs.
* G10: when the first width exceeds 4 d, every width w becomes max(max(1, d // 2), w // 2)
  (autoencoder and both Deep SVDD variants).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from anomspark.operators.detectors.trainer import MLP, Model, score_frame, train, vectorize

# Architectures and schedules of the neural detectors.
CONFIGS = {
    "autoencoder": {"hidden": [64, 32, 16, 32, 64], "epochs": 50, "batch": 64, "resize": True},
    "vae": {"encoder": [64, 32, 16], "decoder": [16, 32, 64], "epochs": 50, "batch": 64, "resize": False},
    "deep_svdd": {"hidden": [64, 32], "epochs": 50, "batch": 64, "resize": True},
    "deep_svdd_sequential": {"hidden": [128, 64, 32], "epochs": 80, "batch": 64, "resize": True},
}
OCSVM_NU = 0.5
OCSVM_FEATURES = 256
OCSVM_EPOCHS = 30


def resize_widths(widths: Sequence[int], d: int) -> list[int]:
    """G10."""
    widths = list(widths)
    if widths and widths[0] > 4 * d:
        floor = max(1, d // 2)
        return [max(floor, w // 2) for w in widths]
    return widths


class AutoEncoder(Model):
    def __init__(self, d: int, hidden: Sequence[int]):
        self.net = MLP([d, *hidden, d])
        self.mid = len(hidden) // 2 + 1  # index of the bottleneck activation

    def init(self, rng, d):
        return self.net.init(rng)

    def grad(self, theta, xb, rng):
        acts = self.net.forward(theta, xb)
        g_out = 2.0 * (acts[-1] - xb) / (xb.shape[0] * xb.shape[1])
        return self.net.backward(theta, acts, g_out)[0]

    def score(self, theta, x):
        return np.sqrt(((self.net.forward(theta, x)[-1] - x) ** 2).sum(axis=1))

    def embed(self, theta, x):
        return self.net.forward(theta, x)[self.mid]


class VAE(Model):
    def __init__(self, d: int, encoder: Sequence[int], decoder: Sequence[int]):
        self.latent = encoder[-1]
        self.enc = MLP([d, *encoder[:-1], 2 * self.latent])
        self.dec = MLP([self.latent, *decoder[1:], d])
        self.n_enc = self.enc.n_params()

    def init(self, rng, d):
        return np.concatenate([self.enc.init(rng), self.dec.init(rng)])

    def _split(self, theta):
        return theta[:self.n_enc], theta[self.n_enc:]

    def grad(self, theta, xb, rng):
        te, td = self._split(theta)
        n, d = xb.shape
        ea = self.enc.forward(te, xb)
        mu, logvar = ea[-1][:, :self.latent], np.clip(ea[-1][:, self.latent:], -10, 10)
        eps = rng.standard_normal(mu.shape)
        std = np.exp(0.5 * logvar)
        z = mu + std * eps
        da = self.dec.forward(td, z)
        g_rec = 2.0 * (da[-1] - xb) / (n * d)
        gd, gz = self.dec.backward(td, da, g_rec)
        # KL = -0.5 * mean(sum(1 + logvar - mu^2 - exp(logvar)))
        g_mu = gz + mu / n
        g_lv = gz * eps * 0.5 * std + 0.5 * (np.exp(logvar) - 1.0) / n
        ge, _ = self.enc.backward(te, ea, np.concatenate([g_mu, g_lv], axis=1))
        return np.concatenate([ge, gd])

    def _mu(self, theta, x):
        te, _ = self._split(theta)
        return self.enc.forward(te, x)[-1][:, :self.latent]

    def score(self, theta, x):
        _, td = self._split(theta)
        rec = self.dec.forward(td, self._mu(theta, x))[-1]
        return np.sqrt(((rec - x) ** 2).sum(axis=1))

    def embed(self, theta, x):
        return self._mu(theta, x)


class DeepSVDD(Model):
    def __init__(self, d: int, hidden: Sequence[int]):
        self.net = MLP([d, *hidden], bias=False)
        self.k = hidden[-1]
        self.n_net = self.net.n_params()

    def init(self, rng, d):
        return np.concatenate([self.net.init(rng), np.zeros(self.k)])

    def prep_stat(self, theta, x):
        return self.net.forward(theta[:self.n_net], x, linear_last=False)[-1]

    def prepare(self, theta, mean_stat):
        centre = np.asarray(mean_stat, dtype=float)
        centre[(np.abs(centre) < 0.1) & (centre < 0)] = -0.1  # keep the centre away from 0
        centre[(np.abs(centre) < 0.1) & (centre >= 0)] = 0.1
        return np.concatenate([theta[:self.n_net], centre])

    def grad(self, theta, xb, rng):
        tn, centre = theta[:self.n_net], theta[self.n_net:]
        acts = self.net.forward(tn, xb, linear_last=False)
        g = 2.0 * (acts[-1] - centre) / xb.shape[0]
        gn = self.net.backward(tn, acts, g, linear_last=False)[0]
        return np.concatenate([gn, np.zeros(self.k)])  # the centre stays fixed

    def score(self, theta, x):
        tn, centre = theta[:self.n_net], theta[self.n_net:]
        return ((self.net.forward(tn, x, linear_last=False)[-1] - centre) ** 2).sum(axis=1)


class OneClassSVM(Model):
    """Linear one-class SVM on random Fourier features of an RBF kernel."""

    def __init__(self, d: int, gamma: float, n_features: int = OCSVM_FEATURES, nu: float = OCSVM_NU,
                 seed: int = 42):
        rng = np.random.default_rng(seed)
        self.w_rff = rng.normal(0, np.sqrt(2 * gamma), size=(d, n_features))
        self.b_rff = rng.uniform(0, 2 * np.pi, size=n_features)
        self.D = n_features
        self.nu = nu

    def _z(self, x):
        return np.sqrt(2.0 / self.D) * np.cos(x @ self.w_rff + self.b_rff)

    def init(self, rng, d):
        return np.concatenate([np.full(self.D, 1.0 / np.sqrt(self.D)), [0.5]])

    def grad(self, theta, xb, rng):
        w, rho = theta[:-1], theta[-1]
        z = self._z(xb)
        viol = (z @ w) < rho
        n = len(xb)
        gw = w - (z[viol].sum(axis=0) / (self.nu * n))
        grho = -1.0 + viol.sum() / (self.nu * n)
        return np.concatenate([gw, [grho]])

    def score(self, theta, x):
        return theta[-1] - self._z(x) @ theta[:-1]


def build_model(kind: str, d: int) -> tuple[Model, int, int]:
    if kind == "one_class_svm":
        return OneClassSVM(d, 1.0 / max(d, 1)), OCSVM_EPOCHS, 64
    cfg = CONFIGS[kind]
    if kind == "vae":
        return VAE(d, cfg["encoder"], cfg["decoder"]), cfg["epochs"], cfg["batch"]
    hidden = resize_widths(cfg["hidden"], d) if cfg["resize"] else list(cfg["hidden"])
    if kind == "autoencoder":
        return AutoEncoder(d, hidden), cfg["epochs"], cfg["batch"]
    return DeepSVDD(d, hidden), cfg["epochs"], cfg["batch"]


_FITTED: dict[tuple, tuple[Model, np.ndarray]] = {}


def fit(kind: str, features: DataFrame, key: Sequence[str], names: Sequence[str], seed: int = 42):
    d = len(names)
    model, epochs, batch = build_model(kind, d)
    vec = vectorize(features, key, names)
    theta = train(model, vec, d, epochs, batch, lr=1e-3, seed=seed)
    _FITTED[(kind, id(features))] = (model, theta)
    return model, theta, vec


def neural_detector(kind: str, features: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(key..., score) for one of the model-based detectors."""
    model, theta, vec = fit(kind, features, key, names)
    return score_frame(model, theta, vec, key, len(names))


def neural_embedding(kind: str, features: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame | None:
    """H3: encoder output of a fitted model (autoencoder bottleneck, VAE latent mean);
    None when the model has no encoder (Deep SVDD) -- the caller falls back to PCA."""
    fitted = _FITTED.get((kind, id(features)))
    if fitted is None:
        model, theta, _ = fit(kind, features, key, names)
    else:
        model, theta = fitted
    if model.embed(theta, np.zeros((1, len(names)))) is None:
        return None
    return score_frame(model, theta, vectorize(features, key, names), key, len(names), embed=True)
