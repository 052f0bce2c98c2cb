"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_METRICS = ["cpu_percent", "latency_p99", "error_rate", "request_rate"]

# A span as services publish it: metrics nested.
SPAN_JSON = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("service_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("metrics", T.StructType([T.StructField(m, T.DoubleType()) for m in _METRICS])),
        T.StructField("anomaly_type", T.StringType()),
        T.StructField("is_anomaly", T.BooleanType()),
    ]
)

# A span as the batch RPC carries it: metrics as repeated name/value pairs.
SPAN_PAIRS = T.StructType(
    [
        *[f for f in SPAN_JSON.fields if f.name != "metrics"],
        T.StructField("metrics", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())]))),
    ]
)

# The canonical event, and the flat record of the ingest API.
EVENT = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("service_id", T.StringType()),
        T.StructField("timestamp_ms", T.LongType()),
        *[T.StructField(m, T.DoubleType()) for m in _METRICS],
        T.StructField("anomaly_type", T.StringType()),
        T.StructField("is_anomaly", T.BooleanType()),
    ]
)

SPAN_FLAT = T.StructType([T.StructField("timestamp", T.LongType()) if f.name == "timestamp_ms" else f for f in EVENT.fields])

AGGREGATE_DDL = "service_id string, window_start_ms long, window_end_ms long, cpu_mean double, cpu_max double, latency_p99 double, latency_mean double, error_rate_mean double, request_rate_mean double, span_count long"
