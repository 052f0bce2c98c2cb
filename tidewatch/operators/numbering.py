"""Row numbers and row windows of a key whose rows lie in many tasks.

A window function sorts all rows of a key in one task.  Here rows are numbered inside ranges of
their order, from counts of those ranges, and windows run over blocks of numbered rows that
borrow the rows they need from the next or the last block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

WIDTH, ROWS = 1 << 16, 1 << 17


def spread(df: DataFrame, total: int, *by: str) -> DataFrame:
    """df of `total` rows dealt by columns to tasks of about ROWS rows.  By number, as adaptive
    execution joins tasks by compressed bytes, which may be a tenth of what a sort holds."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // ROWS)), *by)


def numbered(df: DataFrame, key: str, order: str, width: int = WIDTH) -> DataFrame:
    """df with _rn, the 0-based row of its key in `order`, and _n, the key's rows.

    `order` is a number, as an arrival number is.  A task sorts the rows of one key in a range
    of `width` of it; the table of counts has a row for each such range.  Null keys are one key,
    null orders come first, and ties are numbered in any order."""
    if not isinstance(df.schema[order].dataType, NumericType):
        raise ValueError(f"{order} must be a number")
    rows = _ranged(df, key, order, width)
    every = Window.partitionBy(F.col("_g.k"))
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(every.orderBy(F.col("_g.b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_g", before.alias("_before"), F.sum("_c").over(every).alias("_n"))
    own = F.row_number().over(Window.partitionBy("_g").orderBy(order)) - 1
    return rows.withColumn("_rn", own.cast("long")).join(sizes, "_g").withColumn("_rn", F.col("_rn") + F.col("_before")).drop("_g", "_before")


def blocks(rows: DataFrame, key: str, length: int, ahead: bool = False, width: int = WIDTH) -> tuple[DataFrame, WindowSpec]:
    """(numbered rows with _own, window) such that every window of `length` rows that ends (ahead:
    starts) at a row where _own holds lies in one partition of the window, in order of _rn.

    Blocks have at least `length` rows, so a row is in two at most."""
    span = max(width, length)
    own, at = F.floor(F.col("_rn") / span), F.col("_rn") % span
    lent = (at < length - 1) & (own > 0) if ahead else at >= span - length + 1
    both = F.when(lent, F.array(own, own - 1 if ahead else own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_block", F.explode(both)).withColumn("_own", F.col("_block") == own)
    return dealt, Window.partitionBy(key, "_block").orderBy("_rn").rowsBetween(0, length - 1) if ahead else Window.partitionBy(key, "_block").orderBy("_rn").rowsBetween(1 - length, 0)


def running_max(df: DataFrame, key: str, order: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with `out`: the maximum of `value` over the key's rows up to and with this in `order`, a
    number.  A task sorts the rows of one key in a range of `width` of it."""
    rows = _ranged(df, key, order, width)
    ahead = Window.partitionBy(F.col("_g.k")).orderBy(F.col("_g.b")).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_g").agg(F.max(value).alias("_top")).select("_g", F.max("_top").over(ahead).alias("_before"))
    inside = Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_run", F.max(value).over(inside)).join(tops, "_g").withColumn(out, F.greatest("_run", "_before")).drop("_g", "_run", "_before")


def running_sum(df: DataFrame, key: str, order: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with `out`: the sum of `value` over the key's rows up to and with this in `order`."""
    rows = _ranged(df, key, order, width)
    ahead = Window.partitionBy(F.col("_g.k")).orderBy(F.col("_g.b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_g").agg(F.sum(value).alias("_sum")).select("_g", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_run", F.sum(value).over(inside)).join(sums, "_g").withColumn(out, F.col("_run") + F.col("_before")).drop("_g", "_run", "_before")


def previous(df: DataFrame, key: str, order: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with `out`: `value` of the key's row before this in `order`; null for the first."""
    rows = _ranged(df, key, order, width)
    ranges = Window.partitionBy(F.col("_g.k")).orderBy(F.col("_g.b"))
    last = rows.groupBy("_g").agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("_last")).select("_g", F.lag("_last").over(ranges).alias("_edge"))
    inside = Window.partitionBy("_g").orderBy(order)
    rows = rows.withColumns({"_at": F.row_number().over(inside), "_lag": F.lag(value).over(inside)}).join(last, "_g")
    return rows.withColumn(out, F.when(F.col("_at") == 1, F.col("_edge.v")).otherwise(F.col("_lag"))).drop("_g", "_at", "_lag", "_edge")


def _ranged(df: DataFrame, key: str, order: str, width: int) -> DataFrame:
    """df with _g: the key and the range of `order`."""
    return df.withColumn("_g", F.struct(F.col(key).alias("k"), F.floor(F.col(order).cast("double") / width).alias("b")))
