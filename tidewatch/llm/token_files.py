"""Token ids as Parquet list columns.

Texts are tokenized where they lie; only the ids, in the tokenizer's width, are dealt out by
ranges of doc_id that a pass over keys alone finds.  Files are ordered by doc_id, one range each.  Ids are dictionary-encoded int32 lists
(delta where a row group has too many values for a dictionary), narrow metadata columns
stand beside them, row groups and pages are kept small, and Parquet's column and offset
indexes let a reader fetch a few documents' ids, or metadata without any ids.

Defined results: null text is empty (its end id alone is written); rows of equal doc_id
are ordered by a hash of the text; repeated rows are written each; null doc_id goes last;
an empty table gives no row; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import fresh_path, slices, table, text_or_empty

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def _bounds(keys: DataFrame, parts: int, each: int = 60) -> list[tuple]:
    """Ascending keys that part (doc_id, tie, salt) in about `parts` equal ranges: quantiles of a
    hash sample of about `each` rows a range, a million at most, as range partitioning takes.
    The salt parts rows of equal doc_id and text."""
    every = max(1, keys.count() // min(1_000_000, each * parts))
    found = keys.where(F.pmod(F.xxhash64("doc_id", "tie", "salt"), F.lit(every)) == 0).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.tie, r.salt) for r in found)
    return sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


def write_tokens(docs: DataFrame, path: str, tokenizer: str = tokens.BYTE_BPE, end_id: int = 0) -> None:
    """Write doc_id, part, part_start, n_tokens, ids to `path`, in ascending doc_id order.

    `part_start` counts the ids ahead in the same part; parts ascend with doc_id."""

    spark = docs.sparkSession
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), text.alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows.select("doc_id", "tie", "salt"), parts)
    held = spark.sparkContext.broadcast(bounds)  # three numbers a part

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.load(tokenizer)
        end = np.array([end_id], t.dtype).tobytes()
        for b in slices(batches, "text"):
            ids = pa.array([x.tobytes() + end for x in t.encode(b.column("text").to_pylist())], pa.binary())
            part = [bisect_right(held.value, (i is None, i or 0, tie, salt)) for i, tie, salt in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tie", "salt")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), b.column("salt"), ids, pa.array([t.dtype.itemsize] * b.num_rows, pa.int32()), pa.array(part, pa.int32())], names=["doc_id", "tie", "salt", "raw", "width", "to"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ahead = TaskContext.get().partitionId(), 0
        for b in slices(batches, "raw"):
            raw, width = b.column("raw"), b.column("width")[0].as_py()
            size = pc.binary_length(raw).to_numpy().astype(np.int64) // width
            ends = np.cumsum(size)
            flat = np.frombuffer(b"".join(raw.to_pylist()), f"<u{width}").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(size), part), pa.int32()), pa.array(ahead + ends - size, pa.int64()), pa.array(size, pa.int64()), ids], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            ahead += int(ends[-1])

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("salt")]
    dealt = rows.mapInArrow(encode, "doc_id long, tie long, salt long, raw binary, width int, to int").repartitionById(parts, "to")
    dealt = dealt.sortWithinPartitions(*order).select("doc_id", "raw", "width")
    dealt.mapInArrow(lists, "doc_id long, part int, part_start long, n_tokens long, ids array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, where=None, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """Documents of a token table; `start` counts all ids ahead of a document.

    A filter on doc_id or n_tokens is pushed to the page indexes; ids are read only if asked for."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    rows = files.where(where) if where is not None else files
    # One row per written part: bounded by the writer's number of tasks, not by the rows.
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("part_start")).select(*columns)


def checksums(df: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of token rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[lo:hi].tobytes()) for lo, hi in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return checksums(read_tokens(spark, path))
