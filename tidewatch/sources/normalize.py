"""Every wire format to the canonical event (schema.EVENT plus event_time).

A missing or null metric is 0.0, a missing text "", a missing timestamp 0, a missing flag
false; anomaly_type alone stays null.  `from_json` cannot tell a missing key from a null one,
so both take the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import METRICS
from ..schema import SPAN_JSON, SPAN_PAIRS


def _canonical(df: DataFrame, metric: dict[str, Column], ms: Column, anomaly_type: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(
        text("trace_id").alias("trace_id"),
        text("span_id").alias("span_id"),
        text("service_id").alias("service_id"),
        F.coalesce(ms, F.lit(0)).cast("long").alias("timestamp_ms"),
        *[F.coalesce(metric[m], F.lit(0.0)).alias(m) for m in METRICS],
        anomaly_type.alias("anomaly_type"),
        F.coalesce(F.col("is_anomaly"), F.lit(False)).alias("is_anomaly"),
        *keep,
    ).withColumn("event_time", F.timestamp_millis("timestamp_ms"))


def from_nested(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Spans with a struct of metrics; columns `keep` stay."""
    return _canonical(df, {m: F.col(f"metrics.{m}") for m in METRICS}, F.col("timestamp"), F.col("anomaly_type"), keep)


def first_metric(pairs: Column, name: str) -> Column:
    """Value of the first pair of that name, else 0.0."""
    return F.coalesce(F.get(F.filter(pairs, lambda p: p["name"] == name), F.lit(0))["value"], F.lit(0.0))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def from_pairs(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Spans with name/value pairs; an empty anomaly_type means none."""
    return _canonical(df, {m: first_metric(F.col("metrics"), m) for m in METRICS}, F.col("timestamp"), empty_to_null(F.col("anomaly_type")), keep)


def from_flat(df: DataFrame) -> DataFrame:
    """Flat records (schema.SPAN_FLAT)."""
    return _canonical(df, {m: F.col(m) for m in METRICS}, F.col("timestamp"), F.col("anomaly_type"))


def from_batches(df: DataFrame) -> DataFrame:
    """Batch envelopes with an array `spans` of pair spans."""
    return from_pairs(df.select(F.explode("spans").alias("s")).select("s.*"))


def parse_json(df: DataFrame, payload: str = "value", pairs: bool = False, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) from JSON payloads: a payload that is no JSON object, or lacks
    service_id or timestamp, goes to the dead letters with its text and a reason.  Columns `keep`
    stay beside the events."""
    schema = SPAN_PAIRS if pairs else SPAN_JSON
    text = F.col(payload).cast("string")
    parsed = df.withColumn("_s", F.from_json(text, schema)).withColumn("_map", F.from_json(text, "map<string,string>"))
    reason = (
        F.when(F.col("_s").isNull() | F.col("_map").isNull(), "malformed")
        .when(F.col("_s.service_id").isNull(), "no service_id")
        .when(F.col("_s.timestamp").isNull(), "no timestamp")
    )
    parsed = parsed.withColumn("_reason", reason)
    good = parsed.where("_reason is null").select("_s.*", *keep)
    bad = parsed.where("_reason is not null").select(text.alias("payload"), F.col("_reason").alias("reason"))
    return (from_pairs if pairs else from_nested)(good, keep), bad


def validated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters) of flat records: identifiers, timestamp and all metrics are required."""
    needed = ["trace_id", "span_id", "service_id", "timestamp", *METRICS]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]))
    marked = df.withColumn("_missing", missing)
    good = from_flat(marked.where(F.size("_missing") == 0).drop("_missing"))
    bad = marked.where(F.size("_missing") > 0).select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("payload"), F.concat(F.lit("missing "), F.array_join("_missing", ", ")).alias("reason"))
    return good, bad


def from_events(df: DataFrame, service: str = "event_type") -> DataFrame:
    """The `events` table as canonical events: cpu_percent is `value`, latency_p99 is k of
    `props`; the other metrics are fixed shares of these.  arrival_seq is event_id."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    value = F.coalesce(F.col("value"), F.lit(0.0))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return df.select(
        F.lit("").alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.col(service).cast("string").alias("service_id"),
        ms.alias("timestamp_ms"),
        value.alias("cpu_percent"),
        k.alias("latency_p99"),
        (value / 1000).alias("error_rate"),
        (k * 2 + value).alias("request_rate"),
        F.lit(None).cast("string").alias("anomaly_type"),
        F.lit(False).alias("is_anomaly"),
        F.timestamp_millis(ms).alias("event_time"),
        F.col("event_id").alias("arrival_seq"),
    )
