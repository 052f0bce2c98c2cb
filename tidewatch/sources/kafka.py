"""Span events from Kafka topics, as a stream or a batch.

Needs Spark's Kafka connector on the class path (spark-sql-kafka-0-10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .normalize import parse_json

# Topics and their partitions.
TOPICS = {"raw-telemetry": 16, "aggregated-metrics": 8, "anomaly-events": 4, "incident-alerts": 2}


def source_options(servers: str, topic: str = "raw-telemetry", group: str | None = None, starting: str = "latest", **more: str) -> dict[str, str]:
    """Options of a Kafka source: a new query begins at the latest offsets, a restarted one where
    its checkpoint says; offsets that are gone don't stop it."""
    own = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"}
    return own | ({"kafka.group.id": group} if group else {}) | more


def events_of(messages: DataFrame, pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of Kafka rows (value, partition, offset): events in a topic's order
    have arrival_seq, the offset, which rises within a partition (services are keys, so a
    service's events lie in one)."""
    good, bad = parse_json(messages, "value", pairs, keep=("offset",))
    return good.withColumnRenamed("offset", "arrival_seq"), bad


def spans(spark: SparkSession, servers: str, topic: str = "raw-telemetry", streaming: bool = True, **options: str) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of a topic of JSON spans."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    found = reader.options(**source_options(servers, topic, starting="latest" if streaming else "earliest", **options)).load()
    return events_of(found.select(F.col("value"), F.col("offset")))
