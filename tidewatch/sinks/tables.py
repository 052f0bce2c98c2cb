"""Writers for streaming and batch results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_folder(path: str, batch_id: int, query: str | None = None) -> str:
    """Where a micro-batch's rows lie: queries that share a table have folders of their own."""
    return f"{path}/{'' if query is None else f'query={query}/'}batch_id={batch_id}"


def parquet_batches(path: str, query: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each micro-batch replaces its own partition, so a batch that is
    run again leaves its rows once.  Queries that write to one table need names."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(batch_folder(path, batch_id, query))

    return write


def _stored(rows: DataFrame, path: str, batch_id: int | None, by: list[str], query: str | None = None) -> None:
    """Append rows, or as a micro-batch: replace the batch's own partitions."""
    if batch_id is None:
        rows.write.mode("append").partitionBy(*by).parquet(path)
    else:
        rows.write.mode("overwrite").partitionBy(*by).parquet(batch_folder(path, batch_id, query))


def metrics_table(rows: DataFrame, path: str, batch_id: int | None = None, query: str | None = None) -> None:
    """Long metric rows (see operators.tumbling.unpivoted), partitioned by date.  With a
    batch_id a repeated micro-batch replaces its rows; without, rows are appended."""
    _stored(rows.withColumn("date", F.to_date("time")), path, batch_id, ["date"], query)


def anomaly_table(rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Anomalies as stored: event time, unresolved; severity must be 1 to 5.  With a batch_id a
    repeated micro-batch replaces its rows; without, rows are appended."""
    checked = rows.withColumn("severity", F.when(F.col("severity").between(1, 5), F.col("severity")).otherwise(F.raise_error(F.lit("severity out of range"))))
    _stored(checked.select(F.uuid().alias("id"), F.timestamp_millis("detected_at").alias("detected_at"), "service_id", "anomaly_type", "severity", "model_used", F.lit(False).alias("resolved")), path, batch_id, [])


def jdbc_batches(url: str, target: str, **options: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a JDBC table, in batched multi-row inserts; a micro-batch that
    is run again is inserted again, unless the table has a key that refuses it."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.format("jdbc").options(**({"url": url, "dbtable": target, "batchsize": "1000"} | options)).mode("append").save()

    return write


def kafka_rows(df: DataFrame, key: str = "service_id") -> DataFrame:
    """(key, value) with the row as JSON, for a Kafka writer."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


# Options of the ingest producer.
KAFKA_OPTIONS = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "snappy", "kafka.linger.ms": "5", "kafka.batch.size": "65536"}

def to_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """Needs Spark's Kafka connector on the class path."""
    kafka_rows(df).write.format("kafka").options(**KAFKA_OPTIONS).option("kafka.bootstrap.servers", servers).option("topic", topic).save()
