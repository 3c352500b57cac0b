"""Routing (E1-E5) and detector-name resolution (G1).

The decision table is one ``when`` expression over profile records, so a DataFrame of
many profiles (one per table) is routed in one projection.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strategy strings and detector lists of the routing table.
STRATEGY_SUPERVISED = "Supervised Classification Pipeline"
STRATEGY_SEMI = "Semi-Supervised Anomaly Detection Pipeline"
STRATEGY_TIME_SERIES = "Time-Series Anomaly Detection Pipeline"
STRATEGY_TEXT = "Text / Log Anomaly Detection Pipeline"
STRATEGY_GRAPH = "Graph Anomaly Detection Pipeline"
STRATEGY_TABULAR = "Tabular Anomaly Detection Pipeline"

MODELS_SUPERVISED_COLLECTIVE = ["lstm_classifier", "xgboost_with_lags"]
MODELS_SUPERVISED = ["xgboost", "random_forest", "lightgbm"]
MODELS_SEMI_SEQUENTIAL = ["deep_svdd_sequential", "one_class_svm"]
MODELS_SEMI = ["deep_svdd", "one_class_svm"]
MODELS_TIME_SERIES = ["lstm_autoencoder", "anomaly_transformer", "matrix_profile"]
MODELS_TEXT = ["text_embedding", "log_anomaly_detector"]
MODELS_GRAPH = ["graph_anomaly_detector"]
MODELS_TABULAR_HIGH_DIM = ["autoencoder", "vae", "isolation_forest", "ecod"]
MODELS_TABULAR = ["isolation_forest", "ecod", "lof", "autoencoder"]
COLLECTIVE_PREFIX = "sliding_window_isolation_forest"

KNOWN_DETECTORS = ["isolation_forest", "ecod", "lof", "one_class_svm", "autoencoder", "vae",
                   "deep_svdd", "deep_svdd_sequential"]
FALLBACK_DETECTORS = ["isolation_forest", "ecod"]
NEURAL_DETECTORS = ["autoencoder", "vae", "deep_svdd", "deep_svdd_sequential"]


def _arr(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def strategy_expr() -> Column:
    sup = F.col("supervision_level")
    dtype = F.col("dataset_type")
    return (F.when(sup == "supervised", F.lit(STRATEGY_SUPERVISED))
            .when(sup == "semi-supervised", F.lit(STRATEGY_SEMI))
            .when(dtype == "time_series", F.lit(STRATEGY_TIME_SERIES))
            .when(dtype == "text", F.lit(STRATEGY_TEXT))
            .when(dtype == "graph", F.lit(STRATEGY_GRAPH))
            .otherwise(F.lit(STRATEGY_TABULAR)))


def models_expr() -> Column:
    """E1 + E2: ordered detector list."""
    sup = F.col("supervision_level")
    dtype = F.col("dataset_type")
    collective = F.array_contains(F.col("anomaly_characteristics"), "collective")
    base = (F.when((sup == "supervised") & collective, _arr(MODELS_SUPERVISED_COLLECTIVE))
            .when(sup == "supervised", _arr(MODELS_SUPERVISED))
            .when((sup == "semi-supervised") & (collective | (dtype == "time_series")),
                  _arr(MODELS_SEMI_SEQUENTIAL))
            .when(sup == "semi-supervised", _arr(MODELS_SEMI))
            .when(dtype == "time_series", _arr(MODELS_TIME_SERIES))
            .when(dtype == "text", _arr(MODELS_TEXT))
            .when(dtype == "graph", _arr(MODELS_GRAPH))
            .when(F.col("high_dimensionality"), _arr(MODELS_TABULAR_HIGH_DIM))
            .otherwise(_arr(MODELS_TABULAR)))
    prefix = (sup == "unsupervised") & (dtype == "tabular") & collective
    return F.when(prefix, F.concat(_arr([COLLECTIVE_PREFIX]), base)).otherwise(base)


def preprocessing_expr() -> Column:
    """The preprocessing plan as a struct."""
    return F.struct(
        (F.col("missing_data_ratio") > 0).alias("impute_missing"),
        (F.size("continuous_cols") > 0).alias("scale_continuous"),
        (F.size("categorical_cols") > 0).alias("encode_categorical"),
        F.col("id_cols").alias("exclude_id_columns"),
        F.col("label_cols").alias("exclude_label_columns"),
        F.col("text_cols").alias("text_columns"),
        F.col("seasonality_cols").alias("remove_seasonality_columns"),
        F.col("trend_cols").alias("detrend_columns"))


def metadata_expr() -> Column:
    """Metadata (is_time_series is deliberately not part of it)."""
    return F.struct(
        F.col("total_rows").alias("rows"), F.col("total_columns").alias("columns"),
        F.col("feature_to_sample_ratio"), F.col("high_dimensionality"),
        F.col("label_cols").alias("label_columns"), F.col("id_cols").alias("id_columns"),
        F.col("temporal_candidate_cols").alias("temporal_candidates"),
        F.col("supervision_level"), F.col("anomaly_characteristics"), F.col("is_stationary"))


def resolved_models_expr(models: Column) -> Column:
    """G1: keep known detector names in order; nothing left -> the fallback pair."""
    known = F.filter(models, lambda m: F.array_contains(_arr(KNOWN_DETECTORS), m))
    return F.when(F.size(known) > 0, known).otherwise(_arr(FALLBACK_DETECTORS))


def route_df(profiles: DataFrame) -> DataFrame:
    """Route every profile record of ``profiles`` (one row per table)."""
    routed = profiles.select(
        "*", strategy_expr().alias("strategy"), models_expr().alias("recommended_models"),
        preprocessing_expr().alias("preprocessing_steps"), metadata_expr().alias("metadata"))
    return routed.withColumn("detectors", resolved_models_expr(F.col("recommended_models")))


def route(profile, spark=None) -> dict[str, Any]:
    """Route one :class:`~anomspark.operators.profile.Profile` and return the config dict."""
    spark = spark or profile.roles.sparkSession
    row = route_df(profile.to_df(spark)).select(
        "dataset_type", "strategy", "recommended_models", "preprocessing_steps", "metadata",
        "detectors").first()
    cfg = row.asDict(recursive=True)
    return cfg


def resolve_detectors(names) -> list[str]:
    """Python form of G1 for a plain list of names."""
    known = [n for n in names if n in KNOWN_DETECTORS]
    return known or list(FALLBACK_DETECTORS)
