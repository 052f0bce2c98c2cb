"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_BYTES, _BATCH = str(4 << 20), "spark.sql.execution.arrow.maxBytesPerBatch"
_LOCAL: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_BYTES unless the session says otherwise: at Spark's own 64 MB
    a task's buffers, in the JVM and in Python, are most of an executor's memory."""
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, BATCH_BYTES)


def _trim() -> None:
    """Give freed memory back, so that a worker that is used again does not hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, from spark.checkpoint.dir.

    Only a local[...] session may go without the setting: it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return f"file://{_LOCAL[app]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, label)
    schema = df.schema
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], weight: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column `weight` (string or binary) holds about `most`
    bytes in each; a single longer value stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(weight))
        size = np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(float))
        at = np.cumsum(size)
        lo = 0
        while lo < batch.num_rows:
            base = at[lo - 1] if lo else 0.0
            hi = max(lo + 1, int(np.searchsorted(at, base + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    _trim()


def running_offsets(df: DataFrame, order: list[str], size: str, group: str | None = None, label: str = "offsets") -> DataFrame:
    """df with `before`: the sum of `size` over all rows ahead in `order` (of the same group).

    Two levels, so that no task sees more than one range of rows: rows are dealt by range,
    summed inside a range, and the ranges' totals (a row for each range) are summed apart.
    `order` must be total; df should hold no wide columns.
    """
    keys = ([group] if group else []) + order
    asc = [F.col(c).asc_nulls_last() for c in keys]
    dealt = stage(df.repartitionByRange(*asc).withColumn("_range", F.spark_partition_id()), label)
    inner = (["_range"] + [group]) if group else ["_range"]
    ahead = Window.partitionBy(*inner).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*inner).agg(F.sum(size).alias("_total"))
    over = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*inner, F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_base"))
    within = dealt.withColumn("_within", F.coalesce(F.sum(size).over(ahead), F.lit(0)))
    # `base` has a row for each range and group in it: its size is checked by the planner.
    out = within.join(base, inner, "left").withColumn("before", (F.col("_base") + F.col("_within")).cast("long"))
    return out.drop("_base", "_within", "_range")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b) of longs, for every node
    of an edge.  Labels spread to neighbours and jump to their label's label, until stable.

    Every round is staged in the shared folder; joins have plain exchanges on both sides,
    so adaptive execution can split the edges of a hub.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{label}-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{label}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        step = stage(step, f"{label}-{k}s")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = stage(step.join(jump, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved")), f"{label}-{k}")
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def named(col: str) -> Column:
    """A column by its name alone, whatever characters that has."""
    return F.col("`" + col.replace("`", "``") + "`")


def guarded(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but `own` under names _c0, _c1, ... that clash with none of an
    operator's, and the names to give back: {_c0: name, ...}."""
    small_batches(docs.sparkSession)
    names = {f"_c{i}": c for i, c in enumerate(c for c in docs.columns if c not in own)}
    return docs.select(*[named(c) for c in docs.columns if c in own], *[named(c).alias(k) for k, c in names.items()]), names


def restored(rows: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """rows of a guarded table under their own names again, as `columns`."""
    return rows.withColumnsRenamed(names).select(*[named(c) for c in columns])


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
