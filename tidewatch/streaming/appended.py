"""Stateful operators whose state grows by new rows alone (transformWithState)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import AGGREGATE_DDL

_COLUMNS = ["cpu_percent", "latency_p99", "error_rate", "request_rate"]


class AnchoredWindows(StatefulProcessor):
    """The open window's anchor is a value, its rows a list: a micro-batch appends its rows and
    reads the list only when a window closes, so what it writes is in proportion to what came."""

    def __init__(self, size_ms: int, order: str):
        self.size_ms, self.order = size_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "anchor long")
        self.held = handle.getListState("held", "cpu double, latency double, error double, request double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        times, values = given["timestamp_ms"].to_numpy(np.int64), given[_COLUMNS].to_numpy(float)
        anchor = int(self.anchor.get()[0]) if self.anchor.exists() else int(times[0])
        out, lo, stored = [], 0, self.held.exists()
        while len(past := np.flatnonzero(times[lo:] - anchor >= self.size_ms)):
            hi = lo + int(past[0]) + 1
            x = values[lo:hi]
            if stored:
                x = np.concatenate([np.array([tuple(r) for r in self.held.get()], float), x])
                self.held.clear()
                stored = False
            out.append((key[0], anchor, int(times[hi - 1]), x[:, 0].mean(), x[:, 0].max(), np.percentile(x[:, 1], 99), x[:, 1].mean(), x[:, 2].mean(), x[:, 3].mean(), len(x)))
            anchor, lo = int(times[hi - 1]), hi
        if lo < len(values):
            self.held.appendList([tuple(r) for r in values[lo:].tolist()])
        self.anchor.update((anchor,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in AGGREGATE_DDL.split(", ")])

    def close(self) -> None:
        pass


def anchored_windows(events: DataFrame, size_ms: int = 60_000, order: str = "arrival_seq") -> DataFrame:
    """The rows of stateful.anchored_windows; the session needs RocksDB as its state store
    (spark.sql.streaming.stateStore.providerClass).  Null metrics take part as NaN; an empty
    stream gives no row; columns beyond the event's are ignored."""
    narrow = events.select("service_id", "timestamp_ms", order, *_COLUMNS)
    return narrow.groupBy("service_id").transformWithStateInPandas(AnchoredWindows(size_ms, order), AGGREGATE_DDL, "Append", "None")


_METRICS = [f"z_{c}" for c in _COLUMNS]
DETECTOR_DDL = "service_id string, span_id string, timestamp_ms long, n long, " + ", ".join(f"{z} double" for z in _METRICS)


class SlidingDetector(StatefulProcessor):
    """A service's history as a map of chunks, one for each micro-batch that brought rows: a
    chunk is written once and removed when its last row leaves.  A value holds the time of the
    last evaluation, the first and next chunk, the rows of the first that have left, and the
    time of the oldest row, so chunks are read only when a row leaves or an event is evaluated."""

    def __init__(self, window_ms: int, slide_ms: int, least: int, order: str):
        self.window_ms, self.slide_ms, self.least, self.order = window_ms, slide_ms, least, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "last long, first long, next long, gone long, oldest long")
        self.chunks = handle.getMapState("chunks", "chunk long", "times binary, metrics binary")

    def _held(self) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """The chunks' numbers, times and metrics, in order."""
        found = sorted((int(k[0]), bytes(v[0]), bytes(v[1])) for k, v in self.chunks.iterator())
        return [c for c, _, _ in found], [np.frombuffer(t, np.int64) for _, t, _ in found], [np.frombuffer(x, float).reshape(-1, 4) for _, _, x in found]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        times, values = given["timestamp_ms"].to_numpy(np.int64), given[_COLUMNS].to_numpy(float)
        last, first, nxt, gone, oldest = (None if v is None else int(v) for v in self.at.get()) if self.at.exists() else (None, 0, 0, 0, None)
        numbers, own_t, own_x = [], [], []
        leaves = oldest is not None and int(times.max()) - self.window_ms > oldest
        if leaves or last is None or int(times.max()) - last >= self.slide_ms:
            numbers, own_t, own_x = self._held()
        kept = sum(map(len, own_t))
        t, x = np.concatenate([*own_t, times]), np.concatenate([*own_x, values])
        head, out = (gone if numbers else 0), []
        for r, span in enumerate(given["span_id"], start=kept):
            now = int(t[r])
            while t[head] < now - self.window_ms:
                head += 1
            if last is None or now - last >= self.slide_ms:
                last = now
                if r + 1 - head >= self.least:
                    held = x[head : r + 1]
                    z = np.round((held[-1] - held.mean(axis=0)) / (held.std(axis=0) + 1e-9), 4)
                    out.append((key[0], span, now, r + 1 - head, *z.tolist()))
        if numbers or first == nxt:  # the history was read, or is empty
            oldest, past = int(t[head]), head
            for c, n in zip(numbers, map(len, own_t)):
                if past < n:
                    break
                self.chunks.removeKey((c,))
                past, first = past - n, c + 1
            # Rows of this micro-batch that have left already are not written.
            lo, gone = (past, 0) if first == nxt else (0, past)
        else:
            lo = 0
        self.chunks.updateValue((nxt,), (times[lo:].tobytes(), np.ascontiguousarray(values[lo:]).tobytes()))
        self.at.update((last, first, nxt + 1, gone, oldest))
        yield pd.DataFrame(out, columns=["service_id", "span_id", "timestamp_ms", "n", *_METRICS])

    def close(self) -> None:
        pass


def sliding_detector(events: DataFrame, window_ms: int = 300_000, slide_ms: int = 30_000, least: int = 10, order: str = "arrival_seq") -> DataFrame:
    """The rows of stateful.sliding_detector, with a history of which each micro-batch writes its
    new rows only; needs RocksDB as anchored_windows does.  Null metrics take part as NaN; a null
    timestamp fails, as there; an empty stream gives no row; further columns are ignored."""
    narrow = events.select("service_id", "span_id", "timestamp_ms", order, *_COLUMNS)
    return narrow.groupBy("service_id").transformWithStateInPandas(SlidingDetector(window_ms, slide_ms, least, order), DETECTOR_DDL, "Append", "None")


class FirstSeen(StatefulProcessor):
    """An id's first time as a value, and a timer that removes it."""

    def __init__(self, ttl_ms: int, order: str | None):
        self.ttl_ms, self.order = ttl_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "first long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))
        given = given.sort_values(self.order, kind="stable") if self.order else given
        known = first = int(self.first.get()[0]) if self.first.exists() else None
        keep = []
        for t in given["timestamp_ms"]:
            keep.append(first is None or t - first > self.ttl_ms)
            first = int(t) if keep[-1] else first
        if first != known:
            if known is not None:
                self.handle.deleteTimer(known + self.ttl_ms + 1)
            self.first.update((first,))
            self.handle.registerTimer(first + self.ttl_ms + 1)
        yield given[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter([])

    def close(self) -> None:
        pass


def dedup_ttl(events: DataFrame, key: str = "span_id", ttl_ms: int = 600_000, lag_ms: int = 5_000, order: str = "arrival_seq") -> DataFrame:
    """The rows of stateful.dedup_ttl.  State is written for a new id alone, not for duplicates;
    needs RocksDB as anchored_windows does.  Null ids are one id; further columns are kept."""
    late = events.withWatermark("event_time", f"{lag_ms} milliseconds")
    return late.groupBy(key).transformWithStateInPandas(FirstSeen(ttl_ms, order if order in events.columns else None), events.schema, "Append", "EventTime")
