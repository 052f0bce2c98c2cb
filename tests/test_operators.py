"""Boundaries of the telemetry operators on rows made by hand, and stream against batch."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import chain, dedup, graph, numbering, sequence, tumbling, watermark, zscore
from tidewatch.plans import catalog
from tidewatch.sinks import tables
from tidewatch.sources import generator, kafka, normalize, simulator
from tidewatch.streaming import appended, stateful


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_chain_bounds(spark):
    rows = [("a", i, t) for i, t in enumerate((0, 59, 60, 61, 119, 120, 181))]
    df = frame(spark, rows, "k string, o long, t long")
    fired = lambda strict: [r.t for r in chain.greedy_chain(df, "k", "o", "t", 60, strict).orderBy("o").collect() if r.fired]
    assert fired(False) == [0, 60, 120, 181]
    assert fired(True) == [0, 61, 181]


def test_ttl_readmits_and_is_not_refreshed(spark):
    df = frame(spark, [("x", i, t) for i, t in enumerate((0, 300, 600, 601, 1201, 1202))], "id string, o long, t long")
    assert [r.t for r in dedup.ttl_by_id(df, "id", "o", "t", 600).orderBy("o").collect()] == [0, 601, 1202]


def test_empty_ids(spark):
    df = frame(spark, [("", 1), (None, 2), ("a", 3), ("a", 4)], "id string, o long")
    assert dedup.with_empty_ids(df, "id", "o").count() == 2
    assert dedup.with_empty_ids(df, "id", "o", "keep").count() == 3


def test_late_rows_equal_to_the_watermark_stay(spark):
    df = frame(spark, [(1, 100_000), (2, 94_999), (3, 95_000), (4, 95_001)], "arrival_seq long, timestamp_ms long")
    for bucket in (1, 2, 100):
        assert [r.arrival_seq for r in watermark.drop_late(df, bucket=bucket).orderBy("arrival_seq").collect()] == [1, 3, 4]


def events(spark, rows):
    df = frame(spark, rows, "service_id string, span_id string, arrival_seq long, timestamp_ms long, cpu_percent double, latency_p99 double, error_rate double, request_rate double")
    return df.withColumn("trace_id", F.lit("")).withColumn("event_time", F.timestamp_millis("timestamp_ms"))


def test_anchored_window_takes_its_closing_event(spark):
    df = events(spark, [("s", str(i), i, t, float(i), 1.0, 0.0, 0.0) for i, t in enumerate((5, 10, 60_005, 60_006, 130_000))])
    got = tumbling.anchored(df).orderBy("window_start_ms").collect()
    assert [(r.window_start_ms, r.window_end_ms, r.span_count, r.cpu_max) for r in got] == [(5, 60_005, 3, 2.0), (60_005, 130_000, 2, 4.0)]


@pytest.mark.parametrize("n, found", [(10, 0), (11, 1)])
def test_z_bound_needs_eleven_rows(spark, n, found):
    df = events(spark, [("s", str(i), i, i, 1.0 if i < n - 1 else 100.0, 1.0, 0.0, 0.0) for i in range(n)])
    assert zscore.anomalies(zscore.trailing_z(df)).count() == found


def test_prefix_sums_equal_range_frames_on_large_means(spark):
    df = events(spark, [("s", str(i), i, i * 1000, 1e9 + i % 7, 1.0 * (i % 5), 0.0, 0.0) for i in range(200)])
    a, b = (zscore.trailing_z(df, 20_000, by_prefix=p).orderBy("arrival_seq").collect() for p in (True, False))
    assert [r.n for r in a] == [r.n for r in b]
    for x, y in zip(a, b):
        for m in ("z_cpu_percent", "z_latency_p99"):
            assert (x[m] is None and y[m] is None) or abs(x[m] - y[m]) < 1e-3


def test_ties_take_the_earlier_metric_and_sign_is_kept(spark):
    df = frame(spark, [(-4.0, 4.0, 1.0, 0.0), (1.0, 2.0, 3.0, 3.0)], "z_cpu_percent double, z_latency_p99 double, z_error_rate double, z_request_rate double")
    kind, z = zscore.strongest()
    assert [tuple(r) for r in df.select(kind, z).collect()] == [("CPU_SPIKE", -4.0), (None, None)]


def test_severity_buckets(spark):
    df = frame(spark, [(x,) for x in (0.34, 0.35, 0.55, 0.75, 0.9, 1.0)], "s double")
    assert [r[0] for r in df.select(zscore.severity(F.col("s"))).collect()] == [1, 2, 3, 4, 5, 5]


def test_dead_letters(spark):
    body = '{"service_id":"s","timestamp":1,"metrics":{"cpu_percent":2.5}}'
    good, bad = normalize.parse_json(frame(spark, [(body,), ("no",), ('{"timestamp":1}',), ('{"service_id":"s"}',)], "value string"))
    row = good.first()
    assert (row.cpu_percent, row.error_rate, row.span_id, row.is_anomaly) == (2.5, 0.0, "", False)
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "no service_id", "no timestamp"]


def test_debounce_and_ratios(spark):
    df = frame(spark, [("s", i, e) for i, e in enumerate((2.0, 2.0, 0.0, 2.0, 2.0, 2.0))], "k string, o long, e double")
    assert [r.flag for r in sequence.debounced(df, "k", "o", "e", 1.0, 2).orderBy("o").collect()] == [False, True, False, False, True, True]
    none = sequence.confusion(frame(spark, [(False, False)], "t boolean, f boolean"), "t", "f").first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)


@pytest.fixture(scope="module")
def stream(spark, data, tmp_path_factory):
    source = catalog._events(spark, f"{data}/sf0.001").where("service_id in ('click', 'error')")
    path = str(tmp_path_factory.mktemp("events"))
    for k in range(3):
        source.where(f"arrival_seq div 400 = {k}").coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    schema = source.schema
    make = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    return make, source


def drained(df, name, tmp_path):
    query = df.writeStream.outputMode("append").foreachBatch(tables.parquet_batches(f"{tmp_path}/{name}")).option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}").drop("batch_id")


def test_stream_equals_batch(spark, stream, tmp_path):
    make, source = stream
    key = lambda r: (r.service_id, r.window_start_ms, r.window_end_ms, r.span_count, round(r.latency_p99, 6), round(r.cpu_mean, 6))
    got = drained(stateful.anchored_windows(make(), catalog.DAY), "anchored", tmp_path)
    assert sorted(map(key, got.collect())) == sorted(map(key, tumbling.anchored(source, catalog.DAY).collect()))
    z = drained(stateful.sliding_detector(make(), catalog.DAY, catalog.HOUR), "z", tmp_path).collect()
    want = zscore.throttled(zscore.trailing_z(source, catalog.DAY), catalog.HOUR).where("n >= 10").collect()
    assert sorted((r.span_id, r.n) for r in z) == sorted((r.span_id, r.n) for r in want)
    by = {r.span_id: r.z_cpu_percent for r in want}
    assert all(abs(r.z_cpu_percent - by[r.span_id]) < 1e-3 for r in z)


def test_streaming_dedup_and_aligned_windows_equal_batch(spark, stream, tmp_path):
    make, source = stream
    by_user = lambda df: df.withColumn("span_id", (F.col("arrival_seq") % 7).cast("string"))
    got = drained(stateful.dedup_ttl(by_user(make()), ttl_ms=catalog.DAY), "dedup", tmp_path)
    want = dedup.ttl_by_id(by_user(source), "span_id", "arrival_seq", "timestamp_ms", catalog.DAY)
    assert sorted(r.arrival_seq for r in got.collect()) == sorted(r.arrival_seq for r in want.collect())
    assert want.count() < source.count()
    windows = drained(stateful.aligned_windows(make(), catalog.DAY), "aligned", tmp_path)
    rows = {(r.service_id, r.window_start_ms): (r.span_count, round(r.cpu_mean, 6)) for r in windows.collect()}
    all_ = {(r.service_id, r.window_start_ms): (r.span_count, round(r.cpu_mean, 6)) for r in tumbling.aligned(source, catalog.DAY).collect()}
    open_ = max(t for _, t in all_)  # what the watermark has not passed is not given out
    assert rows == {k: v for k, v in all_.items() if k[1] < open_}


def test_streaming_dedup_forgets(spark, tmp_path):
    schema = "span_id string, arrival_seq long, timestamp_ms long, event_time timestamp"
    make = lambda rows: spark.createDataFrame(rows, "span_id string, arrival_seq long, timestamp_ms long").withColumn("event_time", F.timestamp_millis("timestamp_ms"))
    for k, rows in enumerate([[(f"s{i}", i, 1000 + i) for i in range(50)], [("x", 100, 10_000)], [("y", 101, 20_000)], [("s1", 102, 30_000)]]):
        make(rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    df = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stateful.dedup_ttl(df, ttl_ms=1000, lag_ms=1)
    query = out.writeStream.outputMode("append").foreachBatch(tables.parquet_batches(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(240)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 50 and held[-1] <= 2
    assert sorted(r.arrival_seq for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [*range(50), 100, 101, 102]


def test_kafka_rows_to_events(spark):
    body = '{"service_id":"s","span_id":"a","timestamp":1,"metrics":{"cpu_percent":2.5}}'
    good, bad = kafka.events_of(frame(spark, [(body.encode(), 7), (b"no", 8)], "value binary, offset long"))
    assert (good.first().arrival_seq, good.first().span_id, bad.first().reason) == (7, "a", "malformed")
    options = kafka.source_options("h:9092", group="g", maxOffsetsPerTrigger="100")
    assert options["subscribe"] == "raw-telemetry" and options["startingOffsets"] == "latest" and options["kafka.group.id"] == "g" and options["maxOffsetsPerTrigger"] == "100"


def test_validated_and_batches(spark):
    rows = [("t", "p", "s", 1, 1.0, 2.0, 0.1, 3.0, None, True), ("t", None, "s", 1, 1.0, None, 0.1, 3.0, "X", False)]
    good, bad = normalize.validated(frame(spark, rows, "trace_id string, span_id string, service_id string, timestamp long, cpu_percent double, latency_p99 double, error_rate double, request_rate double, anomaly_type string, is_anomaly boolean"))
    assert [r.span_id for r in good.collect()] == ["p"] and [r.reason for r in bad.collect()] == ["missing span_id, latency_p99"]
    pair = "struct<name:string,value:double>"
    batch = frame(spark, [([("t", "p", "s", 5, [("cpu_percent", 4.0), ("cpu_percent", 9.0)], "", False), ("t", "q", "s", 6, [], "X", True)],)], f"spans array<struct<trace_id:string,span_id:string,service_id:string,timestamp:long,metrics:array<{pair}>,anomaly_type:string,is_anomaly:boolean>>")
    assert [(r.span_id, r.cpu_percent, r.latency_p99, r.anomaly_type) for r in normalize.from_batches(batch).collect()] == [("p", 4.0, 0.0, None), ("q", 0.0, 0.0, "X")]


def test_components_of_a_long_path(spark):
    edges = frame(spark, [(i, i + 1) for i in range(0, 120)] + [(500, 501)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected(edges).collect()}
    assert got == {i: 0 for i in range(121)} | {500: 500, 501: 500}


def test_chain_over_keys_batches_and_missing_times(spark):
    rows = [("a", 0, None), ("a", 1, None), ("a", 2, 10), ("a", 3, None), ("a", 4, 5), ("a", 5, 70), ("a", 6, 69), ("a", 7, 130), ("b", 0, 3), ("b", 1, 62), ("b", 2, 63), (None, 0, 1), (None, 1, 100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    got = {(r.k, r.o): (r.fired, r.fired_anchor, r.fired_no) for r in chain.greedy_chain(frame(spark, rows, "k string, o long, t long"), "k", "o", "t", 60).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got["a", o] for o in range(8)] == [(True, None, 0), (True, None, 0), (True, None, 0), (False, 10, 0), (False, 10, 0), (True, 10, 0), (False, 70, 1), (True, 70, 1)]
    assert [got["b", o] for o in range(3)] == [(True, None, 0), (False, 3, 0), (True, 3, 0)]
    assert got[None, 1] == (True, 1, 0)


def test_series_bursts_change_one_metric_and_injection_rate(spark):
    rows = generator.series(spark, 4, 2000).toPandas()
    share = rows["is_anomaly"].mean()
    assert 0.02 < share < 0.09 and not rows[rows["step"] >= 1999]["is_anomaly"].all()
    calm = rows[~rows["is_anomaly"]]
    assert abs(calm["cpu_percent"].mean() - 40) < 3 and abs(calm["latency_p99"].mean() - 120) < 9 and abs(calm["request_rate"].mean() - 200) < 15
    hit = rows[rows["is_anomaly"]]
    odd = (hit["cpu_percent"] > 65).astype(int) + (hit["latency_p99"] > 200) + (hit["error_rate"] > 0.08) + (hit["request_rate"] < 90)
    assert (odd <= 1).mean() > 0.95 and (odd == 1).mean() > 0.8
    spans = spark.range(4000).selectExpr("cast(id as string) span_id", "10.0D cpu_percent", "10.0D latency_p99", "0.001D error_rate", "10.0D request_rate")
    got = generator.maybe_injected(spans, 0.05).where("is_anomaly").groupBy("anomaly_type").count().collect()
    assert len(got) == 4 and 140 < sum(r["count"] for r in got) < 260


def test_anomaly_table_replaces_a_repeated_batch(spark, tmp_path):
    rows = frame(spark, [("s", "CPU_SPIKE", 3, "ZSCORE", 1000)], "service_id string, anomaly_type string, severity int, model_used string, detected_at long")
    for _ in range(2):
        tables.anomaly_table(rows, f"{tmp_path}/a", batch_id=4)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 1


def test_row_windows_over_blocks_equal_those_over_whole_keys(spark):
    """A hot key, a key of few rows, a null key and one null order; ranges of few and of many rows."""
    keys = ["hot"] * 37 + ["few"] * 4 + [None] * 9
    rows = [(k, None if i == 5 else 3 * i * i, float(i * 7 % 11), i % 6 == 0) for i, k in enumerate(keys)]
    df = frame(spark, rows, "k string, o long, x double, f boolean")
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        groups.setdefault(r[0], []).append(r)
    n = 5
    for width in (1, 3, 40, 1000):
        own = lambda out, *cols: sorted((tuple(r[c] for c in cols) for r in out.collect()), key=str)
        got = numbering.numbered(df, "k", "o", width)
        assert own(got, "k", "o", "_rn", "_n") == sorted(((k, r[1], i, len(g)) for k, g in groups.items() for i, r in enumerate(g)), key=str)
        at = [(k, g, i) for k, g in groups.items() for i in range(len(g))]
        starts = [(k, g, i) for k, g, i in at if i < len(g) - n]
        assert own(sequence.rolling(df, "k", "o", F.col("x"), n, width=width), "o", "sequence") == sorted(((g[i][1], [r[2] for r in g[max(0, i - n + 1) : i + 1]]) for _, g, i in at), key=str)
        assert own(sequence.training_windows(df, "k", "o", F.col("x"), n, width=width), "k", "start", "sequence") == sorted(((k, i, [r[2] for r in g[i : i + n]]) for k, g, i in starts), key=str)
        assert own(sequence.label_windows(df, "k", "o", "f", n, width=width), "k", "start", "label") == sorted(((k, i, any(r[3] for r in g[i : i + n])) for k, g, i in starts), key=str)
        assert own(sequence.trailing_label(df, "k", "o", "f", n, width=width), "o", "label") == sorted(((g[i][1], any(r[3] for r in g[max(0, i - n + 1) : i + 1])) for _, g, i in at), key=str)
        assert own(sequence.debounced(df, "k", "o", "x", 3.0, 2, width=width), "o", "flag") == sorted(((g[i][1], i > 0 and g[i][2] > 3 and g[i - 1][2] > 3) for _, g, i in at), key=str)
    with pytest.raises(ValueError):
        numbering.numbered(df, "x", "k")


def test_a_gap_resets_the_debouncer(spark):
    df = frame(spark, [("a", i, t, 9.0) for i, t in enumerate((0, 10, 500, 510))], "k string, o long, t long, e double").coalesce(1)
    out = sequence.sessions(df, "k", "o", "t", 100)
    assert [r.session for r in out.orderBy("o").collect()] == [0, 0, 1, 1]
    out = sequence.debounced(out.withColumn("ks", F.concat_ws("/", "k", "session")), "ks", "o", "e", 5.0, 2)
    assert [r.flag for r in out.orderBy("o").collect()] == [False, True, False, True]


def test_simulated_spans(spark):
    """Every service and tick has a span; cascades reach two hops, and a repeated run is the same."""
    services = generator.services(spark, 8)
    edges = frame(spark, [(f"svc-{i:04d}", f"svc-{i + 1:04d}") for i in range(7)], "src string, dst string")
    assert simulator.ticks(services, 50, chunk=7).exceptAll(simulator.ticks(services, 50)).isEmpty()
    rows = simulator.spans(services, edges, 200, 1_000, cascade=1.0).collect()
    assert sorted(map(str, rows)) == sorted(map(str, simulator.spans(services, edges, 200, 1_000, cascade=1.0).collect()))
    assert len({r.span_id for r in rows}) == len(rows)
    own = [r for r in rows if r.anomaly_type != "CASCADE"]
    assert {(r.service_id, r.timestamp) for r in own} == {(f"svc-{i:04d}", 1_000 + t * 1000) for i in range(8) for t in range(1, 201)}
    assert len(own) == 1600 and 40 < sum(r.is_anomaly for r in own) < 130
    assert all(r.is_anomaly == (r.anomaly_type is not None) for r in rows)
    at = lambda r: int(r.service_id[-4:])
    want = sorted((r.trace_id, at(r) + d) for r in own if r.is_anomaly for d in (1, 2) if at(r) + d < 8)
    assert sorted((r.trace_id, at(r)) for r in rows if r.anomaly_type == "CASCADE") == want
    plain = {(r.service_id, r.timestamp): r.metrics for r in own if not r.is_anomaly}
    late = [r for r in rows if r.anomaly_type == "CASCADE" and (r.service_id, r.timestamp) in plain]
    changed = sum(r.metrics != plain[r.service_id, r.timestamp] for r in late) / len(late)
    assert 0.6 < changed < 0.95
    assert all(0 <= r.metrics.cpu_percent <= 100 and 0 <= r.metrics.error_rate <= 1 for r in rows)


def test_appended_windows_equal_batch(spark, stream, tmp_path):
    make, source = stream
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = drained(appended.anchored_windows(make(), catalog.DAY), "appended", tmp_path)
    finally:
        spark.conf.set(provider, before)
    key = lambda r: (r.service_id, r.window_start_ms, r.window_end_ms, r.span_count, round(r.latency_p99, 6), round(r.cpu_mean, 6))
    want = sorted(map(key, tumbling.anchored(source, catalog.DAY).collect()))
    assert want and sorted(map(key, got.collect())) == want


def test_appended_windows_with_null_metrics_and_further_columns(spark, tmp_path):
    shape = "service_id string, timestamp_ms long, arrival_seq long, cpu_percent double, latency_p99 double, error_rate double, request_rate double, held int"
    spark.createDataFrame([("s", t, t, None if t == 1 else 2.0, 3.0, 0.5, 1.0, 9) for t in range(12)], shape).coalesce(1).write.parquet(f"{tmp_path}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = drained(appended.anchored_windows(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), 5), "nulls", tmp_path).collect()
    finally:
        spark.conf.set(provider, before)
    got = sorted((r.window_start_ms, r.window_end_ms, r.span_count, r.latency_p99, r.cpu_mean) for r in got)
    assert [g[:4] for g in got] == [(0, 5, 6, 3.0), (5, 10, 5, 3.0)]
    assert (got[0][4] is None or got[0][4] != got[0][4]) and got[1][4] == 2.0
