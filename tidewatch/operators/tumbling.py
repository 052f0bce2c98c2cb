"""Tumbling windows, anchored at events or aligned to the epoch, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chain import greedy_chain


def metric_aggregates() -> list[Column]:
    return [
        F.avg("cpu_percent").alias("cpu_mean"),
        F.max("cpu_percent").alias("cpu_max"),
        F.percentile("latency_p99", 0.99).alias("latency_p99"),
        F.avg("latency_p99").alias("latency_mean"),
        F.avg("error_rate").alias("error_rate_mean"),
        F.avg("request_rate").alias("request_rate_mean"),
        F.count(F.lit(1)).alias("span_count"),
    ]


def aligned(events: DataFrame, size_ms: int = 60_000, slide_ms: int | None = None) -> DataFrame:
    """Aggregates per service and window [start, end) aligned to the epoch."""
    span = F.window("event_time", f"{size_ms} milliseconds", f"{slide_ms or size_ms} milliseconds")
    out = events.groupBy("service_id", span.alias("w")).agg(*metric_aggregates())
    bounds = [F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms")]
    return out.select("service_id", *bounds, *[c for c in out.columns if c not in ("service_id", "w")])


def anchored(events: DataFrame, size_ms: int = 60_000, order: str = "arrival_seq") -> DataFrame:
    """Aggregates per service and chained window: the first event anchors it; the event at
    anchor + size or later closes it, belongs to it, and anchors the next.  A window that no
    event closed is not given out."""
    return closed(greedy_chain(events, "service_id", order, "timestamp_ms", size_ms, out="closes"))


def is_closing() -> Column:
    """Of rows of the chain `closes`: does the row close a window?"""
    return F.col("closes") & F.col("closes_anchor").isNotNull()


def closed(rows: DataFrame) -> DataFrame:
    """Aggregates of the windows that rows of the chain `closes` have closed."""
    closing = F.when(is_closing(), F.col("timestamp_ms"))
    # All rows of a closed window were tested against its anchor; the anchoring first row was not.
    out = rows.groupBy("service_id", "closes_no").agg(F.max("closes_anchor").alias("window_start_ms"), F.max(closing).alias("window_end_ms"), *metric_aggregates()).where("window_end_ms is not null")
    return out.select("service_id", "window_start_ms", "window_end_ms", "cpu_mean", "cpu_max", "latency_p99", "latency_mean", "error_rate_mean", "request_rate_mean", "span_count")


def unpivoted(aggregates: DataFrame) -> DataFrame:
    """Long rows (time, service_id, metric_name, value, is_anomaly) of aggregates; nulls go."""
    long = aggregates.unpivot(["service_id", "window_end_ms"], ["cpu_mean", "latency_p99", "error_rate_mean", "request_rate_mean"], "name", "value").where("value is not null")
    named = F.when(F.col("name") == "cpu_mean", "cpu_percent").when(F.col("name") == "latency_p99", "latency_p99").when(F.col("name") == "error_rate_mean", "error_rate").otherwise("request_rate")
    return long.select(F.timestamp_millis("window_end_ms").alias("time"), "service_id", named.alias("metric_name"), "value", F.lit(False).alias("is_anomaly"))
