"""The greedy anchor chain: per key in arrival order, an anchor is kept until `t - anchor`
crosses a gap, then the crossing row is the next anchor.

It is sequential, so no window function expresses it.  Keys of at most `most` rows are streamed
through Arrow, partitioned by key and sorted in the shuffle: a task holds one batch and one anchor.

A key of more rows never meets in a task.  Only a row later than all before it can be crossed to,
so of each range of arrivals the records (running maxima, each value once) are kept and cut into
blocks.  What crosses after a record is the first record at its time plus the gap: a block's
jump table.  Followed to its end, it says for each record that the pending bound could cross
to which record is the block's last anchor.  A bound is at most one gap past the block's first
record, so this map holds the records of one gap; handing the bound from block to block takes
one look into each map.  Each block then lists its anchors, and rows find theirs by running
maxima inside their range of arrivals and over the ranges before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import WIDTH, numbered, spread
from .staged import staged

MOST, RECORDS = 1 << 20, 1 << 18

_NEVER = -(1 << 62)  # a row without a time crosses no gap


def greedy_chain(df: DataFrame, key: str, order: str, t: str, gap: int, strict: bool = False, out: str = "fired", most: int = MOST, width: int = WIDTH, records: int = RECORDS) -> DataFrame:
    """df with `out` (the row crossed the gap, or is its key's first) and `{out}_anchor` (the
    anchor that the row was tested against; null for a key's first) and `{out}_no` (number of
    crossings before the row, so rows between two crossings share it, the crossing one
    included in the earlier).  `strict` crosses at > gap, else at >= gap.

    Rows are counted by key first.  If any key has over `most`, those keys go in ranges of `width` of `order`, a number, and in blocks of `records` records; the
    others in a task each.  A null key is a key; a row without a time crosses nothing, but is
    fired while its key has no anchor."""
    long = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).select("_key")
    if long.isEmpty():
        return _streamed(df, key, order, t, gap, strict, out)
    long = staged(long, "chain-keys")
    same = F.col(key).eqNullSafe(F.col("_key"))
    split = _split(df.join(long, same, "left_semi"), key, order, t, gap, strict, out, width, records)
    return _streamed(df.join(long, same, "left_anti"), key, order, t, gap, strict, out).unionByName(split)


def _jumps(values: np.ndarray, gap: int, side: str) -> np.ndarray:
    """Place of the record that crosses after each one; the number of records for none."""
    return np.searchsorted(values, values + gap, side)


def _ends(jump: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(last anchor, anchors) of the chains that begin at the first `entries` records."""
    n = len(jump)
    to, count = np.append(jump, n), np.append(np.ones(n, np.int64), 0)
    last = np.append(np.where(jump == n, np.arange(n), -1), -1)
    while (to[:n] < n).any():  # pointers of twice the length each round
        last = np.where(last >= 0, last, last[to])
        count = count + count[to]
        to = to[to]
    return last[:entries], count[:entries]


def _split(df: DataFrame, key: str, order: str, t: str, gap: int, strict: bool, out: str, width: int, records: int) -> DataFrame:
    """greedy_chain of keys whose rows no task may hold."""
    side = "right" if strict else "left"
    k, g = F.to_json(F.struct(F.col(key).alias("k"))), F.floor(F.col(order).cast("double") / width).cast("long")
    times = staged(df.select(k.alias("_k"), g.alias("_g"), F.col(order).alias("_o"), F.col(t).cast("long").alias("_t")), "chain-times")
    total = times.count()
    ranges = Window.partitionBy("_k").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_k", "_g").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    tops = times.groupBy("_k", "_g").agg(F.max("_t").alias("_top")).select("_k", "_g", F.max("_top").over(ranges).alias("_before"))
    rising = spread(times.where("_t is not null"), total, "_k", "_g").withColumn("_run", F.max("_t").over(inside)).join(tops, ["_k", "_g"])
    rising = rising.where(F.col("_t") > F.coalesce(F.greatest("_run", "_before"), F.lit(_NEVER))).select("_k", "_o", "_t")
    cut = numbered(rising, "_k", "_o", width).withColumn("_block", F.floor(F.col("_rn") / records).cast("long"))
    cut = staged(cut.select("_k", "_block", "_o", "_t"), "chain-records")

    def mapped(block: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(block["_t"].to_numpy(np.int64))
        entries = min(len(v), int(np.searchsorted(v, v[0] + gap)) + 1)
        last, count = _ends(_jumps(v, gap, side), entries)
        return pd.DataFrame({"_k": block["_k"].iloc[0], "_block": block["_block"].iloc[0], "_t": v[:entries], "_last": v[last], "_count": count})

    maps = cut.groupBy("_k", "_block").applyInPandas(mapped, "_k string, _block long, _t long, _last long, _count long")

    def handed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bound and the number of anchors that come into each block of a key."""
        held, bound, number, at, crossed = None, _NEVER, 0, None, False
        for f in frames:
            keys, blocks, values = f["_k"].to_numpy(object), f["_block"].to_numpy(), f["_t"].to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(f)] if len(f) else [0]
            rows = []
            for lo, hi in zip(edges, edges[1:]):
                if keys[lo] != held:
                    held, bound, number, at = keys[lo], _NEVER, 0, None
                if blocks[lo] != at:
                    at, crossed = blocks[lo], False
                    rows.append((held, at, bound, number))
                if crossed:
                    continue
                e = lo + int(np.searchsorted(values[lo:hi], bound, side))
                if e < hi:
                    bound, number, crossed = int(f["_last"].iat[e]) + gap, number + int(f["_count"].iat[e]), True
            yield pd.DataFrame(rows, columns=["_k", "_block", "_bound", "_number"])

    states = maps.repartition("_k").sortWithinPartitions("_k", "_block", "_t").mapInPandas(handed, "_k string, _block long, _bound long, _number long")

    def listed(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_t")
        v = block["_t"].to_numpy(np.int64)
        jump, at, found = _jumps(v, gap, side).tolist(), int(np.searchsorted(v, block["_bound"].iloc[0], side)), []
        while at < len(v):
            found.append(at)
            at = jump[at]
        rows = block.iloc[found]
        return pd.DataFrame({"_k": rows["_k"], "_o": rows["_o"], "_at": rows["_t"], "_no": block["_number"].iloc[0] + np.arange(len(found))})

    kind = df.schema[order].dataType.simpleString()
    anchors = cut.join(states, ["_k", "_block"]).groupBy("_k", "_block").applyInPandas(listed, f"_k string, _o {kind}, _at long, _no long")
    anchors = staged(anchors, "chain-anchors").withColumn("_g", F.floor(F.col("_o").cast("double") / width).cast("long"))
    # Each anchor stands right after its row: rows look back, and a row's own anchor is next.
    rows = df.withColumns({"_k": k, "_g": g, "_o": F.col(order), "_mark": F.lit(0)})
    both = spread(rows.unionByName(anchors.withColumn("_mark", F.lit(1)), allowMissingColumns=True), total, "_k", "_g")
    line = Window.partitionBy("_k", "_g").orderBy("_o", "_mark")
    back = line.rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"_near": F.max("_at").over(back), "_near_no": F.max("_no").over(back), "_next": F.lead("_mark").over(line)}).where("_mark = 0")
    last = anchors.groupBy("_k", "_g").agg(F.max("_at").alias("_at"), F.max("_no").alias("_no"))
    carried = times.select("_k", "_g").distinct().join(last, ["_k", "_g"], "left")
    carried = carried.select("_k", "_g", F.max("_at").over(ranges).alias("_far"), F.max("_no").over(ranges).alias("_far_no"))
    both = both.join(carried, ["_k", "_g"])
    anchor, number = F.greatest("_near", "_far"), F.greatest("_near_no", "_far_no")
    fired = anchor.isNull() | (F.coalesce(F.col("_next"), F.lit(0)) == 1)
    return both.select(*df.columns, fired.alias(out), anchor.alias(f"{out}_anchor"), F.coalesce(number, F.lit(0)).cast("long").alias(f"{out}_no"))


def _streamed(df: DataFrame, key: str, order: str, t: str, gap: int, strict: bool, out: str) -> DataFrame:
    cols = [c for c in df.columns]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType()), T.StructField(f"{out}_anchor", T.LongType()), T.StructField(f"{out}_no", T.LongType())])
    side = "right" if strict else "left"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor, number = object(), None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(cols.index(key))
            codes = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            column = b.column(cols.index(t)).cast(pa.int64())
            missing = column.is_null().to_numpy(zero_copy_only=False)
            times = pc.fill_null(column, _NEVER).to_numpy(zero_copy_only=False)
            fired, anchors, numbers = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
            none = np.zeros(n, bool)
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), n]
            for lo, hi in zip(edges, edges[1:]):
                own = keys[lo].as_py()
                if own != last:
                    last, anchor, number = own, None, 0
                while lo < hi and anchor is None:  # until a row has a time, each is tested against none
                    fired[lo], none[lo], numbers[lo] = True, True, number
                    anchor = None if missing[lo] else int(times[lo])
                    lo += 1
                if lo == hi:
                    continue
                top = np.maximum.accumulate(times[lo:hi])
                at = 0
                while at < hi - lo:  # from anchor to anchor: what crosses is a running maximum
                    to = at + int(np.searchsorted(top[at:], anchor + gap, side))
                    end = min(to + 1, hi - lo)
                    anchors[lo + at : lo + end], numbers[lo + at : lo + end] = anchor, number
                    if to < hi - lo:
                        fired[lo + to] = True
                        anchor, number = int(times[lo + to]), number + 1
                    at = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fired), pa.array(anchors, mask=none), pa.array(numbers)], names=[*cols, out, f"{out}_anchor", f"{out}_no"])

    return df.repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(run, schema)
