"""Lateness against the running maximum of all events so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_watermark(df: DataFrame, arrival: str = "arrival_seq", ms: str = "timestamp_ms", lag_ms: int = 5_000, bucket: int = 100_000, top_ms: int | None = None) -> DataFrame:
    """df with `watermark_ms`: the maximum of ms over all rows up to and with this one in arrival
    order, less the lag.  `top_ms` is the maximum of the rows before all of df's, if there were any.

    Two levels: a maximum for each bucket of arrivals and a running one inside it, so only one
    row for each bucket meets in a single task."""
    df = df.withColumn("_bucket", F.floor(F.col(arrival) / bucket))
    tops = df.groupBy("_bucket").agg(F.max(ms).alias("_top"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_bucket", F.greatest(F.max("_top").over(ahead), F.lit(top_ms).cast("long")).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_run", F.max(ms).over(inside))
    # Buckets number arrivals / bucket: the planner broadcasts them only where they are few.
    return run.join(tops, "_bucket").withColumn("watermark_ms", F.greatest("_run", "_before") - lag_ms).drop("_bucket", "_run", "_before")


def drop_late(df: DataFrame, **how) -> DataFrame:
    """Rows that are not behind the watermark; one equal to it stays."""
    ms = how.get("ms", "timestamp_ms")
    return with_watermark(df, **how).where(F.col(ms) >= F.col("watermark_ms")).drop("watermark_ms")
