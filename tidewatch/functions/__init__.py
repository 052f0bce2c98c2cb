"""Scalar functions of the engine, as Column expressions."""

from ..operators.sequence import argmax_type, features, reconstruction_score, sigmoid_score
from ..operators.zscore import anomaly_score, severity, strongest
from ..sources.normalize import empty_to_null, first_metric

__all__ = ["anomaly_score", "argmax_type", "empty_to_null", "features", "first_metric", "reconstruction_score", "severity", "sigmoid_score", "strongest"]
