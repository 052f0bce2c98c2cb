"""Anomalies that belong together: close in time, on one service or on services near in the graph.

Two anomalies are linked if they are at most `band_ms` apart and their services are one or at
most `hops` dependency edges apart, either way; an incident is what links connect.  No pair of
anomalies is ever made.  Time is cut into buckets of the band's length: all anomalies of a
service in a bucket are linked, so they are one cell, and of a cell its first and last time say
all that links need.  Cells of one bucket are linked where their services are near, cells of
neighbouring buckets where the later one's first time is within the band of the other's last.
Components are taken over cells, whose number doesn't grow with a burst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected, within_hops
from .staged import staged


def near_services(edges: DataFrame, hops: int = 2) -> DataFrame:
    """(a, b) of different services that are at most `hops` edges (src, dst) apart, both ways round."""
    found = within_hops(edges, edges.select(F.col("src").alias("root")).distinct(), hops).select(F.col("root").alias("a"), F.col("node").alias("b"))
    return found.union(found.select("b", "a")).distinct()


def correlated(anomalies: DataFrame, edges: DataFrame, band_ms: int = 60_000, hops: int = 2, t: str = "detected_at", event: str = "span_id", service: str = "service_id") -> DataFrame:
    """anomalies with correlated_incident_id: the smallest event id of their incident, by (time, id).

    A row without a service or a time is an incident of its own; rows of equal id, service and
    time are one event."""
    rows = anomalies.withColumn("_bucket", F.floor(F.col(t) / band_ms).cast("long"))
    whole = F.col("_bucket").isNotNull() & F.col(service).isNotNull()
    first = F.min(F.struct(F.col(t).alias("t"), F.col(event).alias("event")))
    cells = rows.where(whole).groupBy(F.col(service).alias("service"), F.col("_bucket").alias("bucket")).agg(F.min(t).alias("low"), F.max(t).alias("high"), first.alias("first"))
    cells = staged(cells.withColumn("cell", F.concat_ws(":", "bucket", "service")), "incident-cells")
    near = near_services(edges, hops)
    every = near.union(cells.select("service", "service").distinct())  # and each with itself
    a = cells.select("cell", "bucket", F.col("service").alias("a"), "high")
    b = cells.select(F.col("cell").alias("other"), F.col("bucket").alias("_at"), F.col("service").alias("b"), "low")
    beside = a.join(near, "a").join(b.withColumnRenamed("_at", "bucket"), ["b", "bucket"]).select("cell", "other")
    after = a.join(every, "a").withColumn("bucket", F.col("bucket") + 1).join(b.withColumnRenamed("_at", "bucket"), ["b", "bucket"])
    links = beside.union(after.where(F.col("low") - F.col("high") <= band_ms).select("cell", "other"))
    groups = connected(links.toDF("src", "dst"))
    named = cells.join(groups, cells["cell"] == groups["node"], "left").withColumn("component", F.coalesce("component", "cell"))
    least = named.groupBy("component").agg(F.min("first").alias("least")).select("component", F.col("least.event").alias("_incident"))
    ids = named.join(least, "component").select(F.col("service").alias("_service"), F.col("bucket").alias("_own"), "_incident")
    out = rows.join(ids, (F.col(service) == F.col("_service")) & (F.col("_bucket") == F.col("_own")), "left")
    return out.select(*anomalies.columns, F.coalesce("_incident", F.col(event)).alias("correlated_incident_id"))


def summary(found: DataFrame, t: str = "detected_at", service: str = "service_id") -> DataFrame:
    """One row for each incident: its times, size, services and the service of its first event."""
    return found.groupBy("correlated_incident_id").agg(
        F.min(t).alias("started_at"), F.max(t).alias("ended_at"), F.count(F.lit(1)).alias("n_events"), F.count_distinct(service).alias("n_services"), F.min(F.struct(F.col(t), F.col(service)))[service].alias("first_service")
    )
