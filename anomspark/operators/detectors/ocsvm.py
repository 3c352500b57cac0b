"""One-class SVM (see :mod:`anomspark.operators.detectors.neural`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from anomspark.operators.detectors.neural import neural_detector


def one_class_svm(features: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    return neural_detector("one_class_svm", features, key, names)
