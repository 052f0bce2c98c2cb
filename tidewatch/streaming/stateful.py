"""Stateful operators on event streams with per-key state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tumbling import metric_aggregates
from ..schema import AGGREGATE_DDL


def aligned_windows(events: DataFrame, size_ms: int = 60_000, lag_ms: int = 5_000, slide_ms: int | None = None) -> DataFrame:
    """Aggregates per service and epoch-aligned window, given out once the watermark passes."""
    late = events.withWatermark("event_time", f"{lag_ms} milliseconds")
    out = late.groupBy("service_id", F.window("event_time", f"{size_ms} milliseconds", f"{slide_ms or size_ms} milliseconds").alias("w")).agg(*metric_aggregates())
    return out.select("service_id", F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), *[c for c in out.columns if c not in ("service_id", "w")])


def dedup_ttl(events: DataFrame, key: str = "span_id", ttl_ms: int = 600_000, lag_ms: int = 5_000, order: str = "arrival_seq") -> DataFrame:
    """The first event of each id; an id is forgotten ttl_ms after it was first seen, by event
    time in arrival order (in the order given, if there is no column `order`), and duplicates
    don't refresh it.  Its state is removed once the watermark (`lag_ms` behind the latest event)
    has passed that time, so state holds the ids of one time to live, no more."""
    schema, given = events.schema, order in events.columns

    def admit(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = state.get[0] if state.exists else None
        rows = pd.concat(list(frames))
        rows = rows.sort_values(order, kind="stable") if given else rows
        keep = []
        for t in rows["timestamp_ms"]:
            ok = first is None or t - first > ttl_ms
            keep.append(ok)
            if ok:
                first = int(t)
        state.update((first,))
        state.setTimeoutTimestamp(max(first + ttl_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    late = events.withWatermark("event_time", f"{lag_ms} milliseconds")
    return late.groupBy(key).applyInPandasWithState(admit, schema, "first long", "append", GroupStateTimeout.EventTimeTimeout)


def anchored_windows(events: DataFrame, size_ms: int = 60_000, order: str = "arrival_seq") -> DataFrame:
    """Chained windows anchored at events (see operators.tumbling.anchored)."""

    def close(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, held = (state.get[0], [tuple(x) for x in state.get[1]]) if state.exists else (None, [])
        out = []
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for r in zip(rows["timestamp_ms"], rows["cpu_percent"], rows["latency_p99"], rows["error_rate"], rows["request_rate"]):
            t = int(r[0])
            anchor = t if anchor is None else anchor
            held.append(tuple(float(x) for x in r[1:]))
            if t - anchor >= size_ms:
                x = np.array(held)
                out.append((key[0], anchor, t, x[:, 0].mean(), x[:, 0].max(), np.percentile(x[:, 1], 99), x[:, 1].mean(), x[:, 2].mean(), x[:, 3].mean(), len(x)))
                anchor, held = t, []
        state.update((anchor, held))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in AGGREGATE_DDL.split(", ")])

    keep = "anchor long, held array<struct<cpu:double,latency:double,error:double,request:double>>"
    return events.groupBy("service_id").applyInPandasWithState(close, AGGREGATE_DDL, keep, "append", GroupStateTimeout.NoTimeout)


def sliding_detector(events: DataFrame, window_ms: int = 300_000, slide_ms: int = 30_000, least: int = 10, order: str = "arrival_seq") -> DataFrame:
    """service_id, span_id, timestamp_ms and z of the four metrics at each evaluated event: the
    history is evicted from its head only, in arrival order."""
    names = ["cpu_percent", "latency_p99", "error_rate", "request_rate"]

    def score(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = (state.get[0], [tuple(x) for x in state.get[1]]) if state.exists else (None, [])
        out = []
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for span, *r in zip(rows["span_id"], rows["timestamp_ms"], *[rows[n] for n in names]):
            t = int(r[0])
            held.append((t, *(float(x) for x in r[1:])))
            while held and held[0][0] < t - window_ms:
                held.pop(0)
            if last is None or t - last >= slide_ms:
                last = t
                if len(held) >= least:
                    x = np.array(held)[:, 1:]
                    z = np.round((x[-1] - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), 4)
                    out.append((key[0], span, t, len(held), *z.tolist()))
        state.update((last, held))
        yield pd.DataFrame(out, columns=["service_id", "span_id", "timestamp_ms", "n", *[f"z_{n}" for n in names]])

    keep = "last long, held array<struct<t:long,cpu:double,latency:double,error:double,request:double>>"
    shape = "service_id string, span_id string, timestamp_ms long, n long, " + ", ".join(f"z_{n} double" for n in names)
    return events.groupBy("service_id").applyInPandasWithState(score, shape, keep, "append", GroupStateTimeout.NoTimeout)


def hashed_normal(*columns: str, seed: int = 42) -> Column:
    """A standard normal number that depends on the columns' values and the seed alone."""
    share = lambda k: (F.pmod(F.xxhash64(*columns, F.lit(seed + k)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(share(0))) * F.cos(2 * F.pi() * share(1))


def ar1(steps: DataFrame, key: str = "service_id", order: str = "step", rho: float = 0.9, seed: int = 42) -> DataFrame:
    """(key, order, x) with x[t] = rho * x[t-1] + sqrt(1 - rho^2) * e[t], of unit variance, for
    a stream of ticks; the state is the last x."""
    scale = float(np.sqrt(1 - rho * rho))
    ticks = steps.select(key, order, (scale * hashed_normal(key, order, seed=seed)).alias("e"))
    types = dict(steps.dtypes)
    shape = f"`{key}` {types[key]}, `{order}` {types[order]}, x double"

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for e in rows["e"]:
            x = rho * x + e
            out.append(x)
        state.update((x,))
        yield rows[[key, order]].assign(x=out)

    return ticks.groupBy(key).applyInPandasWithState(run, shape, "x double", "append", GroupStateTimeout.NoTimeout)


def live_load(spark: SparkSession, n_services: int = 100, rows_per_second: int = 100, seed: int = 42) -> DataFrame:
    """An endless stream (service_id, step, x): one tick per service in turn, each with its AR(1) load."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ar1(ticks.select((F.col("value") % n_services).alias("service_id"), F.expr(f"value div {n_services}").alias("step")), seed=seed)
