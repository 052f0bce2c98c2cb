"""Exact quantiles of groups of any size.

`percentile` keeps every distinct value of a group in one buffer.  Here values are counted by
(group, value) first, so repeated values travel once from each task; the counts are dealt by
ranges of (group, value), whose splitters Spark takes from a sample, so that a large group lies
in many ranges; counts of the ranges give the rank at which each begins; and a quantile's two
order statistics are found inside the ranges that hold their ranks.  A task sorts one range, on
disk if need be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staged import staged


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each of `shares`): quantiles by linear interpolation at share * (n - 1),
    as percentile() gives them.  Nulls of `value` don't count; a group without values has nulls,
    null groups are groups, NaN is the largest value."""
    group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)])
    rows = df.select(group.alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    counts = rows.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    dealt = staged(counts.repartitionByRange("_g", "_v").withColumn("_part", F.spark_partition_id()), "quantile-ranges")
    whole = Window.partitionBy("_g")
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_g", "_part").agg(F.sum("_c").alias("_s")).select("_g", "_part", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_base"), F.sum("_s").over(whole).alias("_n"))
    inside = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("_end", F.sum("_c").over(inside)).join(sizes, ["_g", "_part"])
    ranked = ranked.withColumn("_end", F.col("_end") + F.col("_base"))
    found = []
    for name, share in shares.items():
        at = (F.col("_n") - 1) * float(share)
        # The value whose run of equal ones covers a rank.
        covers = lambda rank: F.max(F.when((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c")), F.col("_v")))
        found += [covers(F.floor(at)).alias(f"_low_{name}"), covers(F.ceil(at)).alias(f"_high_{name}")]
    picked = ranked.groupBy("_g").agg(F.max("_n").alias("_n"), *found)
    out = []
    for name, share in shares.items():
        at, low, high = (F.col("_n") - 1) * float(share), F.col(f"_low_{name}"), F.col(f"_high_{name}")
        out.append(F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    groups = df.select(group.alias("_g")).distinct()
    return groups.join(picked, "_g", "left").select(*[F.col(f"_g.g{i}").alias(c) for i, c in enumerate(by)], *out)
