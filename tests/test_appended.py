"""Operators on appending state give the rows of those that rewrite it."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import appended, stateful

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SHAPE = "service_id string, span_id string, timestamp_ms long, arrival_seq long, cpu_percent double, latency_p99 double, error_rate double, request_rate double, held int"


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def _rows():
    r = random.Random(4)
    rows = []
    for k in range(360):  # disordered times, repeated ids, one service silent for a while
        t = 1_000 * k + r.randint(-9_000, 9_000) + 20_000
        service = "b" if k % 7 == 0 and not 120 <= k < 240 else "a"
        rows.append((service, f"s{r.randint(0, 150)}", t, k, r.random(), r.random() * 9, r.random(), r.random() * 5, k))
    return rows


def _read(spark, path):
    parts = spark.readStream.schema(SHAPE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    return parts.withColumn("event_time", F.timestamp_millis("timestamp_ms"))


@pytest.fixture()
def written(spark, tmp_path):
    rows = _rows()
    for k in range(4):
        spark.createDataFrame(rows[90 * k : 90 * k + 90], SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return f"{tmp_path}/in"


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


@pytest.mark.parametrize("window, slide, least", [(40_000, 7_000, 3), (500_000, 1, 1)])
def test_sliding_detector(spark, rocks, written, window, slide, least):
    want = _run(stateful.sliding_detector(_read(spark, written), window, slide, least), f"rewritten_{window}")
    got = _run(appended.sliding_detector(_read(spark, written), window, slide, least), f"appended_{window}")
    assert len(want) > 30 and sorted(got) == sorted(want)


def test_dedup(spark, rocks, written):
    for ttl in (30_000, 10_000_000):
        want = _run(stateful.dedup_ttl(_read(spark, written), ttl_ms=ttl), f"rewritten_ids_{ttl}")
        got = _run(appended.dedup_ttl(_read(spark, written), ttl_ms=ttl), f"appended_ids_{ttl}")
        assert 100 < len(want) < 360 and sorted(got) == sorted(want)


def test_dedup_with_null_ids(spark, rocks, tmp_path):
    # Not at time 0: the watermark begins there, and what is not after it is late.
    rows = [("s", None if k % 2 else "x", 1_000 * k + 1_000, k, 1.0, 1.0, 2.0, 3.0, k) for k in range(8)]
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = _run(appended.dedup_ttl(_read(spark, f"{tmp_path}/in"), ttl_ms=3_000), "appended_null_ids")
    assert sorted((r.timestamp_ms, r.span_id, r.held) for r in got) == [(1_000, "x", 0), (2_000, None, 1), (5_000, "x", 4), (6_000, None, 5)]


def test_sliding_detector_with_null_metrics_and_no_rows(spark, rocks, tmp_path):
    rows = [("s", f"x{t}", 1_000 * t, t, None if t == 2 else 1.0 * t, 1.0, 2.0, 3.0, None) for t in range(6)]
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = _run(appended.sliding_detector(_read(spark, f"{tmp_path}/in"), 2_000, 1, 1), "appended_nulls")
    z = {r.timestamp_ms // 1000: (r.n, r.z_cpu_percent) for r in got}
    assert [z[t][0] for t in range(6)] == [1, 2, 3, 3, 3, 3]
    assert all((z[t][1] is None or z[t][1] != z[t][1]) == (2 <= t <= 4) for t in range(6))
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/none")
    assert _run(appended.sliding_detector(_read(spark, f"{tmp_path}/none"), 2_000, 1, 1), "appended_none") == []


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map:
    def __init__(self):
        self.held, self.written, self.read = {}, 0, 0

    def iterator(self):
        self.read += 1
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        assert key not in self.held
        self.held[key] = value
        self.written += sum(map(len, value))

    def removeKey(self, key):
        del self.held[key]


class _Handle:
    def __init__(self):
        self.value, self.map = _Value(), _Map()

    def getValueState(self, name, schema):
        return self.value

    def getMapState(self, name, key, value):
        return self.map


@pytest.mark.parametrize("slide, rounds", [(10_000, 40), (1, 40), (1 << 40, 40)])
def test_history_is_written_once(slide, rounds):
    """Each round writes its own rows (40 bytes each), however long the history; what has left goes."""
    r, handle, held, last = random.Random(9), _Handle(), [], None
    detector, names = appended.SlidingDetector(60_000, slide, 1, "arrival_seq"), SHAPE.replace(",", "").split()[::2]
    detector.init(handle)
    for k in range(rounds):
        rows = [("s", f"{k}-{i}", 10_000 * k + 500 * i + r.randint(-4_000, 4_000), 20 * k + i, r.random(), 1.0, 2.0, 3.0, 0) for i in range(20)]
        before, want = handle.map.written, []
        for x in rows:
            held.append(x[2])
            while held[0] < x[2] - 60_000:
                held.pop(0)
            if last is None or x[2] - last >= slide:
                last = x[2]
                want.append((x[1], len(held)))
        (out,) = detector.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=names)]), None)
        assert list(zip(out["span_id"], out["n"])) == want
        assert handle.map.written - before <= 40 * len(rows)
        stored = sum(len(t) // 8 for t, _ in handle.map.held.values())
        assert len(held) <= stored < len(held) + 20 + 20
    if slide == 1 << 40:  # nothing is evaluated: read only where a row leaves
        assert handle.map.read < rounds
