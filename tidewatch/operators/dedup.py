"""Duplicates by id, with and without a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chain import greedy_chain


def first_by_id(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in arrival order.  A rank filter is applied before the shuffle
    too, so a key that very many rows share sends one of them from each task."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_rn = 1").drop("_rn")


def with_empty_ids(df: DataFrame, key: str, order: str, empty: str = "collapse") -> DataFrame:
    """first_by_id for one text id; rows without an id (null or "") are one id (`collapse`) or
    all kept (`keep`)."""
    if empty == "collapse":
        return first_by_id(df.withColumn("_id", F.coalesce(F.col(key), F.lit(""))), ["_id"], order).drop("_id")
    has = F.coalesce(F.col(key), F.lit("")) != ""
    return first_by_id(df.where(has), [key], order).unionByName(df.where(~has))


def ttl_by_id(df: DataFrame, key: str, order: str, arrival_ms: str, ttl_ms: int) -> DataFrame:
    """Rows admitted when an id is forgotten `ttl_ms` after it was first seen (strictly more);
    duplicates don't refresh it, and a readmitted id starts anew."""
    chained = greedy_chain(df, key, order, arrival_ms, ttl_ms, strict=True)
    return chained.where("fired").drop("fired", "fired_anchor", "fired_no")
