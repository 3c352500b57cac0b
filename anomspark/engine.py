"""End-to-end run: profile -> route -> features -> detectors -> scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomspark.functions import rules as R
from anomspark.operators import features as FE
from anomspark.operators import scoring as SC
from anomspark.operators.profile import Profile, profile
from anomspark.plans import route as RT
from anomspark.plans.ordering import ROW_NAME, c, with_row_id
from anomspark.session import reliable_checkpoint
from anomspark.sources.io import normalize_missing


def _ecod(feats, key, names, **kw):
    from anomspark.operators.detectors.ecod import ecod
    return ecod(feats, key, names)


def _iforest(feats, key, names, **kw):
    from anomspark.operators.detectors.iforest import isolation_forest
    return isolation_forest(feats, key, names)


def _lof(feats, key, names, **kw):
    from anomspark.operators.detectors.lof import lof
    return lof(feats, key, names)


def _ocsvm(feats, key, names, **kw):
    from anomspark.operators.detectors.ocsvm import one_class_svm
    return one_class_svm(feats, key, names)


def _neural(kind):
    def fit(feats, key, names, **kw):
        from anomspark.operators.detectors.neural import neural_detector
        return neural_detector(kind, feats, key, names)
    return fit


DETECTORS: dict[str, Callable] = {
    "isolation_forest": _iforest,
    "ecod": _ecod,
    "lof": _lof,
    "one_class_svm": _ocsvm,
    "autoencoder": _neural("autoencoder"),
    "vae": _neural("vae"),
    "deep_svdd": _neural("deep_svdd"),
    "deep_svdd_sequential": _neural("deep_svdd_sequential"),
}


@dataclass
class RunResult:
    result: DataFrame                      # row_id, key..., anomaly_score, embedding_*, score_*, is_anomaly
    profile: Profile | None
    config: dict[str, Any]
    features: DataFrame                    # row id (ROW_NAME) and the feature columns
    spec: FE.FeatureSpec
    status: list[dict[str, Any]] = field(default_factory=list)   # G11
    scores: dict[str, DataFrame] = field(default_factory=dict)
    embedding_source: str | None = None

    def status_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.status, "detector string, status string, message string")

    def summary(self) -> DataFrame:
        """H7: rows, mean, population sd, threshold, anomaly count and percent of the run."""
        return SC.score_summary(self.result)

    def detector_figures(self) -> DataFrame:
        """H8: mean normalised score of each detector and the embedding size of the one embedded."""
        size = sum(x.startswith("embedding_") for x in self.result.columns)
        return SC.detector_summary(self.scores, {n: size if n == self.embedding_source else 0 for n in self.scores})


def run_detectors(feats: DataFrame, key: Sequence[str], names: Sequence[str],
                  detectors: Sequence[str], checkpoint: bool = True):
    """G1 + G11: run each resolved detector as its own job; failures are recorded."""
    key = list(key)
    if checkpoint:
        feats = reliable_checkpoint(feats)

    def fit_one(name):
        try:
            raw = DETECTORS[name](feats, key, list(names))
            return name, SC.minmax(reliable_checkpoint(raw) if checkpoint else raw, "score"), None
        except Exception as e:  # one failing detector never stops the others
            return name, None, str(e)[:500]

    # the detectors are independent jobs over one checkpointed matrix: submit them together so
    # the scheduler interleaves their stages (iterative trainers leave cores idle between epochs)
    resolved = RT.resolve_detectors(detectors)
    with ThreadPoolExecutor(max_workers=max(1, len(resolved))) as pool:
        fitted = list(pool.map(fit_one, resolved))
    scores: dict[str, DataFrame] = {}
    status = []
    for name, norm, err in fitted:  # resolved order, whatever order they finished in
        if err is None:
            scores[name] = norm
            status.append({"detector": name, "status": "ok", "message": ""})
        else:
            status.append({"detector": name, "status": "failed", "message": err})
    if not scores:
        raise RuntimeError("no detector could be fitted: "
                           + "; ".join(f"{s['detector']}: {s['message']}" for s in status))
    return feats, scores, status


def run(df: DataFrame, key: Sequence[str] = (), order_by: Sequence[str] | None = None,
        profile_kwargs: dict[str, Any] | None = None, detectors: Sequence[str] | None = None,
        embedding_dim: int = R.EMBEDDING_DIM, checkpoint: bool = True, fill_by_order: bool = False) -> RunResult:
    """Score every row of ``df``.

    Each row gets a contiguous id (``row_id``, in ``order_by`` order, by default that of ``key`` or else
    the scan's) that is carried through features, detectors and scores, so there is a score per row
    whatever the data: ``key`` columns may repeat, be null or be absent.  They are only attached to the
    result, and are features like any other column unless the profile says id or label.
    ``fill_by_order`` fills missing values of a time series forward and backward in row order instead
    of by median and mode.
    """
    key = list(key)
    ident = [ROW_NAME]
    df = with_row_id(normalize_missing(df), order_by or key or None)
    prof = profile(df, **(profile_kwargs or {}))
    cfg = RT.route(prof)
    steps = dict(cfg["preprocessing_steps"])
    meta = dict(cfg.get("metadata") or {}, is_time_series=prof.is_time_series) if fill_by_order else None
    feats, spec = FE.fit_transform(df, steps, ident, meta=meta)
    names = detectors or cfg["detectors"]
    feats, scores, status = run_detectors(feats, ident, spec.feature_names, names, checkpoint)
    combined = SC.ensemble(scores, ident)
    # H5: first neural detector that ran, else the first detector; non-neural -> PCA
    src = next((n for n in scores if n in RT.NEURAL_DETECTORS), next(iter(scores)))
    emb = None
    if src in RT.NEURAL_DETECTORS:
        try:
            from anomspark.operators.detectors.neural import neural_embedding
            emb = neural_embedding(src, feats, ident, spec.feature_names)
        except Exception:
            emb = None
    if emb is None:
        emb = SC.pca_embedding(feats, ident, spec.feature_names, embedding_dim)
    emb_cols = [x for x in emb.columns if x.startswith("embedding_")]
    scored = SC.three_sigma(combined.join(emb, ROW_NAME))
    row_id = "row_id"
    while row_id in key:
        row_id = "_" + row_id
    made = [F.col("anomaly_score"), *map(c, emb_cols), *[c(f"score_{n}") for n in scores], F.col("is_anomaly")]
    if key:
        keys = df.select(F.col(ROW_NAME).alias("__row"), *[c(k).alias(f"__key{i}") for i, k in enumerate(key)])
        scored = scored.join(keys, F.col(ROW_NAME) == F.col("__row"))
    result = scored.select(F.col(ROW_NAME).alias(row_id), *[F.col(f"__key{i}").alias(k) for i, k in enumerate(key)], *made)
    return RunResult(result=result, profile=prof, config=cfg, features=feats, spec=spec, status=status, scores=scores,
                     embedding_source=src)
