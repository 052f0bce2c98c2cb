"""One query for each operator, and its SQL.  Services are event types, spans are events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..models import autoencoders, evaluation, forest, gateway
from ..operators import chain, dedup, granger, graph, incidents as incident, sequence, tumbling, watermark, zscore
from ..sources import generator, normalize

HOUR, DAY = 3_600_000, 86_400_000
SERVICE_METRICS = ("cpu_percent", "latency_p99")

# The canonical events in SQL; every query below starts from it.
EVENTS_SQL = """
ev AS (SELECT event_type AS service_id, CAST(event_id AS VARCHAR) AS span_id, event_id AS arrival_seq, user_id,
              epoch_us(ts) // 1000 AS timestamp_ms, coalesce(value, 0.0) AS cpu_percent,
              coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS latency_p99,
              coalesce(value, 0.0) / 1000 AS error_rate,
              coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) * 2 + coalesce(value, 0.0) AS request_rate
       FROM events)"""


def _events(spark: SparkSession, sf_dir: str, service: str = "event_type") -> DataFrame:
    return normalize.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), service)


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def span_normalize(spark, sf_dir):
    return _round(_events(spark, sf_dir).drop("event_time", "anomaly_type", "is_anomaly", "trace_id"), "error_rate", "request_rate")


def metric_array_pivot(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("double").alias("value"))
    pairs = F.array(pair("cpu_percent", F.col("value")), pair("cpu_percent", F.lit(1.0)), pair("latency_p99", F.col("event_id") % 7))
    kind = normalize.empty_to_null(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")))
    return rows.select("event_id", normalize.first_metric(pairs, "cpu_percent").alias("cpu_percent"), normalize.first_metric(pairs, "latency_p99").alias("latency_p99"), normalize.first_metric(pairs, "error_rate").alias("error_rate"), kind.alias("anomaly_type"))


def dlq_split(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = F.to_json(F.struct(F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("service_id"), F.when(F.col("event_id") % 13 != 0, F.col("event_id")).alias("timestamp")))
    payload = F.when(F.col("event_id") % 17 == 0, F.lit("no json")).otherwise(body)
    good, bad = normalize.parse_json(rows.select(payload.alias("value")))
    return good.groupBy(F.lit("ok").alias("reason")).count().unionByName(bad.groupBy("reason").count()).withColumnRenamed("count", "n")


def dedup_first(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("hour", F.date_trunc("hour", "ts"))
    return dedup.first_by_id(rows, ["user_id", "event_type", "hour"], "event_id").select("event_id", "user_id", "event_type")


def dedup_ttl(spark, sf_dir):
    return dedup.ttl_by_id(_events(spark, sf_dir).withColumn("id", F.col("arrival_seq") % 50), "id", "arrival_seq", "timestamp_ms", 6 * HOUR).select("id", "arrival_seq", "timestamp_ms")


def _disordered(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp_ms", F.col("timestamp_ms") - (F.col("arrival_seq") * 7919 % 13) * F.lit(1_000_000))


def late_drop(spark, sf_dir):
    return watermark.drop_late(_disordered(_events(spark, sf_dir)), lag_ms=5_000_000, bucket=1000).select("arrival_seq", "timestamp_ms")


def dedup_then_late(spark, sf_dir):
    rows = _disordered(_events(spark, sf_dir)).withColumn("id", F.floor(F.col("arrival_seq") / 2))
    return watermark.drop_late(dedup.first_by_id(rows, ["id"], "arrival_seq"), lag_ms=5_000_000, bucket=1000).select("id", "arrival_seq", "timestamp_ms")


# Means differ in their last digits with the order of a sum: a shift larger than that, and far
# smaller than a place, rounds a tie alike on both sides.
TIE = 1e-9


def _settled(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + TIE, 6) for c in cols})


MEANS = ["cpu_mean", "cpu_max", "latency_p99", "latency_mean", "error_rate_mean", "request_rate_mean"]
AGG_SQL = """round(avg(cpu_percent) + 1e-9, 6) AS cpu_mean, round(max(cpu_percent) + 1e-9, 6) AS cpu_max, round(quantile_cont(latency_p99, 0.99) + 1e-9, 6) AS latency_p99,
  round(avg(latency_p99) + 1e-9, 6) AS latency_mean, round(avg(error_rate) + 1e-9, 6) AS error_rate_mean, round(avg(request_rate) + 1e-9, 6) AS request_rate_mean, count(*) AS span_count"""


def tumbling_aligned(spark, sf_dir):
    return _settled(tumbling.aligned(_events(spark, sf_dir), 60_000), *MEANS)


def tumbling_anchored(spark, sf_dir):
    return _settled(tumbling.anchored(_events(spark, sf_dir), DAY), *MEANS)


def sliding_hop(spark, sf_dir):
    return _settled(tumbling.aligned(_events(spark, sf_dir), 6 * HOUR, HOUR), *MEANS)


def metrics_unpivot(spark, sf_dir):
    out = tumbling.unpivoted(tumbling.aligned(_events(spark, sf_dir), DAY))
    return _settled(out.withColumn("time", F.unix_millis("time")), "value")


def sliding_zscore(spark, sf_dir):
    out = zscore.trailing_z(_events(spark, sf_dir), DAY, metrics=SERVICE_METRICS)
    return out.select("arrival_seq", F.col("n").cast("long").alias("n"), *[f"z_{m}" for m in SERVICE_METRICS])


def sliding_history(spark, sf_dir):
    out = zscore.history_z(_disordered(_events(spark, sf_dir)), DAY, metrics=SERVICE_METRICS)
    return out.select("arrival_seq", F.col("n").cast("long").alias("n"), *[f"z_{m}" for m in SERVICE_METRICS])


def zscore_anomalies(spark, sf_dir, window_ms=DAY):
    scored = zscore.trailing_z(_events(spark, sf_dir), window_ms, metrics=SERVICE_METRICS)
    out = zscore.anomalies(scored, metrics=SERVICE_METRICS)
    return out.select("service_id", "span_id", "anomaly_type", "z_score", F.round("anomaly_score", 6).alias("anomaly_score"), "severity", "model_used", "detected_at")


def slide_throttle(spark, sf_dir):
    return zscore.throttled(_events(spark, sf_dir), 2 * HOUR).select("service_id", "arrival_seq", "timestamp_ms")


def detect_full(spark, sf_dir):
    out = zscore.anomalies(zscore.throttled(zscore.trailing_z(_events(spark, sf_dir), DAY, metrics=SERVICE_METRICS), HOUR), metrics=SERVICE_METRICS)
    return out.select("service_id", "span_id", "anomaly_type", "z_score", "severity")


def rolling_sequence(spark, sf_dir):
    out = sequence.rolling(_events(spark, sf_dir), "service_id", "arrival_seq", F.col("cpu_percent"))
    return out.select("arrival_seq", F.col("n_buf").cast("long").alias("n_buf"), F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.element_at("sequence", 1).alias("oldest"))


FEATURES = ["f_mean", "f_std", "f_p95", "f_p99", "f_max", "f_error", "f_request"]


def feature_summary(spark, sf_dir):
    return _round(sequence.summary(_events(spark, sf_dir), ["service_id"], bounded=False), *FEATURES)


def iforest_windows(spark, sf_dir):
    return _round(sequence.summary(sequence.numbered_blocks(_events(spark, sf_dir), "service_id", "arrival_seq"), ["service_id", "block"]), *FEATURES)


def train_windows(spark, sf_dir):
    out = sequence.training_windows(_events(spark, sf_dir), "service_id", "arrival_seq", F.col("cpu_percent"))
    return out.select("service_id", F.col("start").cast("long").alias("start"), F.size("sequence").cast("long").alias("length"), F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def window_labels(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("flag", F.col("arrival_seq") % 97 == 0)
    return sequence.label_windows(rows, "service_id", "arrival_seq", "flag").withColumn("start", F.col("start").cast("long"))


def trailing_labels(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("flag", F.col("arrival_seq") % 97 == 0)
    return sequence.trailing_label(rows, "service_id", "arrival_seq", "flag").select("arrival_seq", "label")


def normalize_columns(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return _round(sequence.normalised(rows, rows.where("arrival_seq % 2 = 0"), SERVICE_METRICS).select("arrival_seq", *SERVICE_METRICS), *SERVICE_METRICS)


def chrono_split(spark, sf_dir):
    return sequence.chronological_split(_events(spark, sf_dir), "service_id", "arrival_seq").select("arrival_seq", "part")


def threshold_sigma(spark, sf_dir):
    return _round(sequence.threshold(_events(spark, sf_dir), "cpu_percent"), "mean", "std", "threshold")


def recon_score(spark, sf_dir):
    rows = _events(spark, sf_dir)
    limit = sequence.threshold(rows, "cpu_percent").select("threshold")
    return rows.crossJoin(F.broadcast(limit)).select("arrival_seq", F.round(sequence.reconstruction_score(F.col("cpu_percent"), F.col("threshold")), 6).alias("score"))


def debounce(spark, sf_dir):
    return sequence.debounced(_events(spark, sf_dir), "service_id", "arrival_seq", "cpu_percent", 60.0, 3).select("arrival_seq", "flag")


def sigmoid_scores(spark, sf_dir):
    vector = F.array("cpu_percent", "latency_p99", "error_rate", "request_rate")
    kind = sequence.argmax_type(vector, ["CPU_SPIKE", "LATENCY_BURST", "ERROR_RATE_SPIKE", "REQUEST_DROP"])
    return _events(spark, sf_dir).select("arrival_seq", F.round(sequence.sigmoid_score(F.col("cpu_percent") / 100 - 0.5), 6).alias("score"), kind.alias("anomaly_type"))


def model_counts(spark, sf_dir):
    rows = sequence.rolling(_events(spark, sf_dir), "service_id", "arrival_seq", F.col("cpu_percent"))
    return sequence.routed(rows).groupBy("service_id", "model_used").agg(F.count(F.lit(1)).alias("n"))


def confusion_metrics(spark, sf_dir):
    rows = _events(spark, sf_dir).select("service_id", (F.col("arrival_seq") % 5 == 0).alias("truth"), (F.col("cpu_percent") > 50).alias("flag"))
    return _round(sequence.confusion(rows, "truth", "flag", ["service_id"]), "precision", "recall", "f1")


def inject_clamp(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("CPU_SPIKE", "LATENCY_BURST", "ERROR_RATE_SPIKE", "REQUEST_DROP")])
    rows = _events(spark, sf_dir).withColumns({"kind": F.get(kinds, (F.col("arrival_seq") % 4).cast("int")), "factor": (F.col("arrival_seq") % 10) / 10 + 0.01379131717})
    return generator.clamped(generator.injected(rows, "kind", "factor")).select("arrival_seq", "cpu_percent", "latency_p99", "error_rate", "request_rate")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("src"), F.explode(F.array((n * 3 + 1) % 25, (n * 5 + 2) % 25)).alias("dst")).where("src <> dst")


def cascade_bfs(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.within_hops(edges, edges.select(F.col("src").alias("root")).distinct()).withColumn("depth", F.col("depth").cast("long"))


def components(spark, sf_dir):
    return graph.connected(_edges(spark, sf_dir).where("src % 4 = dst % 4"))


def topk_scores(spark, sf_dir):
    rows = zscore_anomalies(spark, sf_dir)
    w = Window.partitionBy("service_id").orderBy(F.desc("anomaly_score"), "detected_at", "span_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("service_id", "rank", "anomaly_score")


def _type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type depends on the next one by name."""
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("src")).distinct()
    return kinds.withColumn("dst", F.lead("src").over(Window.partitionBy(F.lit(0)).orderBy("src"))).where("dst is not null")


def _correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zscore_anomalies(spark, sf_dir).withColumn("event", F.col("span_id").cast("long"))
    return incident.correlated(found, _type_edges(spark, sf_dir), 2 * HOUR, hops=1, event="event")


def incidents(spark, sf_dir):
    return _correlated(spark, sf_dir).select("span_id", "service_id", "detected_at", "severity", "correlated_incident_id")


def incident_summary(spark, sf_dir):
    return incident.summary(_correlated(spark, sf_dir))


def ar1_filter(spark, sf_dir):
    rows = _events(spark, sf_dir).select("service_id", "arrival_seq", "cpu_percent")
    return generator.ar1_by_key(rows, "service_id", "arrival_seq", "cpu_percent").select("arrival_seq", F.round(F.col("x") + TIE, 6).alias("x"))


def seasonal(spark, sf_dir):
    return _events(spark, sf_dir).select("arrival_seq", F.round(generator.seasonal_load(F.col("arrival_seq")) + TIE, 6).alias("load"))


def labelled_series(spark, sf_dir):
    return generator.series(spark, 5, 500)


def service_registry(spark, sf_dir):
    return generator.services(spark)


FOREST_FEATURES = ["f_mean", "f_std", "f_p95", "f_p99", "f_max", "f_error", "f_request"]


def _train_forest(rows: DataFrame) -> tuple[DataFrame, forest.Forest]:
    blocks = sequence.summary(sequence.numbered_blocks(rows, "service_id", "arrival_seq"), ["service_id", "block"])
    return blocks, forest.train(blocks, FOREST_FEATURES)


def iforest_scores(spark, sf_dir):
    blocks, model = _train_forest(_events(spark, sf_dir))
    out = forest.with_decision(blocks, model, FOREST_FEATURES).withColumn("score", sequence.sigmoid_score(F.col("decision")))
    return out.select("service_id", "block", F.round("decision", 6).alias("decision"), F.round("score", 6).alias("score"), (F.col("decision") < 0).alias("outlier"))


def autoencoder_windows(spark, sf_dir):
    rows = sequence.chronological_split(_events(spark, sf_dir), "service_id", "arrival_seq")
    train, val = rows.where("part = 'train'"), rows.where("part = 'val'")
    fitted = autoencoders.fit(autoencoders.Transformer(), train, val, "service_id", "arrival_seq")
    return gateway.score(rows, gateway.Gateway(fitted, None), "service_id", "arrival_seq").where("model_used <> 'NONE'").select("service_id", "arrival_seq", F.round("reconstruction_error", 4).alias("reconstruction_error"), "is_anomaly")


def gateway_scores(spark, sf_dir):
    rows = _events(spark, sf_dir)
    _, model = _train_forest(rows)
    fitted = autoencoders.fit(autoencoders.Linear(), rows, None, "service_id", "arrival_seq")
    out = gateway.score(rows, gateway.Gateway(fitted, model), "service_id", "arrival_seq")
    return out.select("service_id", "arrival_seq", "n_buf", "model_used", F.round("anomaly_score", 4).alias("anomaly_score"), "is_anomaly", "anomaly_type")


def granger_pairs(spark, sf_dir):
    hours = _events(spark, sf_dir).groupBy("service_id", F.expr(f"timestamp_ms div {6 * HOUR}").alias("slot")).agg(F.avg("cpu_percent").alias("cpu"))
    services = hours.select("service_id").distinct()
    pairs = services.withColumnRenamed("service_id", "src").crossJoin(services.withColumnRenamed("service_id", "dst")).where("src <> dst")
    return granger.tests(hours, pairs, "service_id", "slot", "cpu").withColumns({"f_stat": F.round("f_stat", 4), "p_value": F.round("p_value", 4)})


RATIOS = ("precision", "recall", "f1")


def debounce_sweep(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("truth", F.col("arrival_seq") % 5 == 0)
    return _round(evaluation.sweep(rows, "service_id", "arrival_seq", "cpu_percent", "truth", 60.0), *RATIOS)


def error_by_class(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("label", F.col("arrival_seq") % 5 == 0)
    return _settled(sequence.error_by_class(rows, "label", "cpu_percent", 60.0), "mean_error")


def evaluation_replay(spark, sf_dir):
    """A linear autoencoder, fitted on the table's training part, judged on its later rows with
    injected anomalies."""
    rows = sequence.chronological_split(_events(spark, sf_dir), "service_id", "arrival_seq")
    fitted = autoencoders.fit(autoencoders.Linear(), rows.where("part = 'train'"), None, "service_id", "arrival_seq")
    judged = generator.maybe_injected(rows.where("part = 'val'"), 0.01)
    trace = evaluation.replay(judged, fitted, "service_id", "arrival_seq", "is_anomaly")
    return _round(evaluation.sweep(trace, "service_id", "start", "error", "truth", fitted.threshold), *RATIOS)


_CHAIN = """
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY arrival_seq) AS rn FROM src),
c AS (SELECT k, rn, arrival_seq, timestamp_ms, timestamp_ms AS anchor, true AS fired, CAST(NULL AS BIGINT) AS tested, CAST(0 AS BIGINT) AS no FROM r WHERE rn = 1
  UNION ALL
  SELECT r.k, r.rn, r.arrival_seq, r.timestamp_ms, CASE WHEN r.timestamp_ms - c.anchor {op} {gap} THEN r.timestamp_ms ELSE c.anchor END,
         r.timestamp_ms - c.anchor {op} {gap}, c.anchor, c.no + CASE WHEN c.fired AND c.tested IS NOT NULL THEN 1 ELSE 0 END
  FROM r JOIN c ON r.k = c.k AND r.rn = c.rn + 1)"""


def _chain(source: str, op: str, gap: int) -> str:
    return f"WITH RECURSIVE {EVENTS_SQL}, src AS ({source}), {_CHAIN.format(op=op, gap=gap)}"


def _z(m: str) -> str:
    return f"CASE WHEN count(*) OVER w >= 10 THEN round(({m} - avg({m}) OVER w) / (stddev_pop({m}) OVER w + 1e-9), 4) END AS z_{m}"


def _head_z(m: str) -> str:
    return f"CASE WHEN count(*) >= 10 THEN round((any_value(r.{m}) - avg(o.{m})) / (stddev_pop(o.{m}) + 1e-9), 4) END AS z_{m}"


Z_SQL = f"{EVENTS_SQL}, z AS (SELECT *, count(*) OVER w AS n, {_z('cpu_percent')}, {_z('latency_p99')} FROM ev WINDOW w AS (PARTITION BY service_id ORDER BY timestamp_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW))"
A_SQL = f"""{Z_SQL}, a AS (SELECT *, CASE WHEN abs(z_cpu_percent) >= abs(z_latency_p99) THEN 'CPU_SPIKE' ELSE 'LATENCY_BURST' END AS anomaly_type,
  CASE WHEN abs(z_cpu_percent) >= abs(z_latency_p99) THEN z_cpu_percent ELSE z_latency_p99 END AS z_score FROM z WHERE greatest(abs(z_cpu_percent), abs(z_latency_p99)) > 3.0),
s AS (SELECT *, least(1.0, abs(z_score) / 10) AS anomaly_score FROM a),
an AS (SELECT *, CASE WHEN anomaly_score >= 0.9 THEN 5 WHEN anomaly_score >= 0.75 THEN 4 WHEN anomaly_score >= 0.55 THEN 3 WHEN anomaly_score >= 0.35 THEN 2 ELSE 1 END AS severity FROM s)"""
DIS_SQL = f"{EVENTS_SQL}, d AS (SELECT arrival_seq, timestamp_ms - (arrival_seq * 7919 % 13) * 1000000 AS timestamp_ms FROM ev)"
# The head of each row's history moves from the head before it, row by row.
HISTORY_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, ev2 AS (SELECT * REPLACE (timestamp_ms - (arrival_seq * 7919 % 13) * 1000000 AS timestamp_ms) FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY arrival_seq) AS rn FROM ev2),
l AS (SELECT service_id, list(timestamp_ms ORDER BY rn) AS ts FROM r GROUP BY service_id),
h AS (SELECT service_id, 1 AS rn, CAST(1 AS BIGINT) AS head FROM l
  UNION ALL
  SELECT h.service_id, h.rn + 1, h.head - 1 + list_position(list_transform(l.ts[h.head : h.rn + 1], lambda t: t >= l.ts[h.rn + 1] - {DAY}), true)
  FROM h JOIN l USING (service_id) WHERE h.rn < len(l.ts)),
w AS (SELECT r.arrival_seq, count(*) AS n, {_head_z("cpu_percent")}, {_head_z("latency_p99")} FROM r JOIN h USING (service_id, rn) JOIN r o ON o.service_id = r.service_id AND o.rn BETWEEN h.head AND r.rn GROUP BY r.arrival_seq)
SELECT arrival_seq, n, z_cpu_percent, z_latency_p99 FROM w"""
SUMMARY_SQL = """SELECT {by}, round(avg(x), 6) AS f_mean, round(stddev_pop(x), 6) AS f_std, round(quantile_cont(x, 0.95), 6) AS f_p95, round(quantile_cont(x, 0.99), 6) AS f_p99,
  round(max(x), 6) AS f_max, round(avg(error_rate), 6) AS f_error, round(avg(request_rate), 6) AS f_request
FROM (SELECT {by}, cpu_percent AS x, error_rate, request_rate FROM b UNION ALL SELECT {by}, latency_p99, error_rate, request_rate FROM b) GROUP BY {by}"""
EDGES_SQL = "e AS (SELECT * FROM (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) AS dst FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey * 5 + 2) % 25 AS BIGINT) FROM nation) WHERE src <> dst)"
ROWS60 = "(PARTITION BY service_id ORDER BY arrival_seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
AHEAD60 = "(PARTITION BY service_id ORDER BY arrival_seq ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)"
NUMBERED = "row_number() OVER (PARTITION BY service_id ORDER BY arrival_seq) - 1 AS start, count(*) OVER (PARTITION BY service_id) AS cnt"

INCIDENT_SQL = f"""WITH RECURSIVE {A_SQL}, k AS (SELECT event_type AS src, lead(event_type) OVER (ORDER BY event_type) AS dst FROM (SELECT DISTINCT event_type FROM events)),
x AS (SELECT CAST(span_id AS BIGINT) AS id, span_id, service_id, timestamp_ms AS detected_at, severity FROM an),
l AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON abs(a.detected_at - b.detected_at) <= {2 * HOUR}
      AND (a.service_id = b.service_id OR EXISTS (SELECT 1 FROM k WHERE (k.src = a.service_id AND k.dst = b.service_id) OR (k.src = b.service_id AND k.dst = a.service_id)))),
c AS (SELECT id AS a, id AS b FROM x UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
i AS (SELECT x.span_id, x.service_id, x.detected_at, x.severity, arg_min(o.id, (o.detected_at, o.id)) AS correlated_incident_id
      FROM c JOIN x ON x.id = c.a JOIN x o ON o.id = c.b GROUP BY x.id, x.span_id, x.service_id, x.detected_at, x.severity)"""

REGISTRY: dict[str, tuple] = {
    "incidents": (incidents, f"{INCIDENT_SQL} SELECT * FROM i"),
    "incident_summary": (incident_summary, f"""{INCIDENT_SQL} SELECT correlated_incident_id, min(detected_at) AS started_at, max(detected_at) AS ended_at, count(*) AS n_events,
      count(DISTINCT service_id) AS n_services, arg_min(service_id, (detected_at, service_id)) AS first_service FROM i GROUP BY correlated_incident_id"""),
    "span_normalize": (span_normalize, f"WITH {EVENTS_SQL} SELECT span_id, service_id, timestamp_ms, cpu_percent, latency_p99, round(error_rate, 6) AS error_rate, round(request_rate, 6) AS request_rate, arrival_seq FROM ev"),
    "metric_array_pivot": (metric_array_pivot, "SELECT event_id, coalesce(value, 0.0) AS cpu_percent, CAST(event_id % 7 AS DOUBLE) AS latency_p99, CAST(0.0 AS DOUBLE) AS error_rate, CASE WHEN event_id % 3 <> 0 THEN event_type END AS anomaly_type FROM events"),
    "dlq_split": (dlq_split, "SELECT CASE WHEN event_id % 17 = 0 THEN 'malformed' WHEN event_id % 11 = 0 THEN 'no service_id' WHEN event_id % 13 = 0 THEN 'no timestamp' ELSE 'ok' END AS reason, count(*) AS n FROM events GROUP BY 1"),
    "dedup_first": (dedup_first, "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY event_id) = 1"),
    "dedup_ttl": (dedup_ttl, _chain("SELECT *, arrival_seq % 50 AS k FROM ev", ">", 6 * HOUR) + " SELECT k AS id, arrival_seq, timestamp_ms FROM c WHERE fired"),
    "late_drop": (late_drop, f"WITH {DIS_SQL} SELECT arrival_seq, timestamp_ms FROM d QUALIFY timestamp_ms >= max(timestamp_ms) OVER (ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING) - 5000000"),
    "dedup_then_late": (dedup_then_late, f"WITH {DIS_SQL}, f AS (SELECT arrival_seq // 2 AS id, * FROM d QUALIFY row_number() OVER (PARTITION BY arrival_seq // 2 ORDER BY arrival_seq) = 1) SELECT id, arrival_seq, timestamp_ms FROM f QUALIFY timestamp_ms >= max(timestamp_ms) OVER (ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING) - 5000000"),
    "tumbling_aligned": (tumbling_aligned, f"WITH {EVENTS_SQL} SELECT service_id, timestamp_ms // 60000 * 60000 AS window_start_ms, timestamp_ms // 60000 * 60000 + 60000 AS window_end_ms, {AGG_SQL} FROM ev GROUP BY 1, 2, 3"),
    "tumbling_anchored": (tumbling_anchored, _chain("SELECT *, service_id AS k FROM ev", ">=", DAY) + f", w AS (SELECT ev.*, c.no, c.fired, c.tested FROM c JOIN ev USING (arrival_seq)) SELECT service_id, max(coalesce(tested, 0)) AS window_start_ms, max(CASE WHEN fired AND tested IS NOT NULL THEN timestamp_ms END) AS window_end_ms, {AGG_SQL} FROM w GROUP BY service_id, no HAVING max(CASE WHEN fired AND tested IS NOT NULL THEN timestamp_ms END) IS NOT NULL"),
    "sliding_hop": (sliding_hop, f"WITH {EVENTS_SQL}, h AS (SELECT *, timestamp_ms // {HOUR} * {HOUR} - i * {HOUR} AS s FROM ev, range(6) t(i)) SELECT service_id, s AS window_start_ms, s + {6 * HOUR} AS window_end_ms, {AGG_SQL} FROM h GROUP BY 1, 2, 3"),
    "metrics_unpivot": (metrics_unpivot, f"WITH {EVENTS_SQL}, g AS (SELECT service_id, timestamp_ms // {DAY} * {DAY} + {DAY} AS time, avg(cpu_percent) AS a, quantile_cont(latency_p99, 0.99) AS b, avg(error_rate) AS c, avg(request_rate) AS d FROM ev GROUP BY 1, 2) " + " UNION ALL ".join(f"SELECT time, service_id, '{m}' AS metric_name, round({c} + 1e-9, 6) AS value, false AS is_anomaly FROM g" for m, c in (("cpu_percent", "a"), ("latency_p99", "b"), ("error_rate", "c"), ("request_rate", "d")))),
    "sliding_zscore": (sliding_zscore, f"WITH {Z_SQL} SELECT arrival_seq, n, z_cpu_percent, z_latency_p99 FROM z"),
    "sliding_history": (sliding_history, HISTORY_SQL),
    "zscore_anomalies": (zscore_anomalies, f"WITH {A_SQL} SELECT service_id, span_id, anomaly_type, z_score, round(anomaly_score, 6) AS anomaly_score, severity, 'ZSCORE' AS model_used, timestamp_ms AS detected_at FROM an"),
    "slide_throttle": (slide_throttle, _chain("SELECT *, service_id AS k FROM ev", ">=", 2 * HOUR) + " SELECT k AS service_id, arrival_seq, timestamp_ms FROM c WHERE fired"),
    "detect_full": (detect_full, f"WITH RECURSIVE {A_SQL}, src AS (SELECT *, service_id AS k FROM ev), {_CHAIN.format(op='>=', gap=HOUR)} SELECT service_id, span_id, anomaly_type, z_score, severity FROM an WHERE arrival_seq IN (SELECT arrival_seq FROM c WHERE fired)"),
    "rolling_sequence": (rolling_sequence, f"WITH {EVENTS_SQL} SELECT arrival_seq, count(*) OVER w AS n_buf, round(list_sum(list(cpu_percent) OVER w), 6) AS total, first_value(cpu_percent) OVER w AS oldest FROM ev WINDOW w AS {ROWS60}"),
    "feature_summary": (feature_summary, f"WITH {EVENTS_SQL}, b AS (SELECT * FROM ev) {SUMMARY_SQL.format(by='service_id')}"),
    "iforest_windows": (iforest_windows, f"WITH {EVENTS_SQL}, q AS (SELECT *, {NUMBERED} FROM ev), b AS (SELECT *, start // 60 AS block FROM q WHERE start // 60 * 60 < cnt - 60) {SUMMARY_SQL.format(by='service_id, block')}"),
    "train_windows": (train_windows, f"WITH {EVENTS_SQL}, q AS (SELECT *, {NUMBERED}, list(cpu_percent) OVER {AHEAD60} AS l FROM ev) SELECT service_id, start, len(l) AS length, round(list_sum(l), 6) AS total FROM q WHERE start < cnt - 60"),
    "window_labels": (window_labels, f"WITH {EVENTS_SQL}, q AS (SELECT *, {NUMBERED}, bool_or(arrival_seq % 97 = 0) OVER {AHEAD60} AS label FROM ev) SELECT service_id, start, label FROM q WHERE start < cnt - 60"),
    "trailing_labels": (trailing_labels, f"WITH {EVENTS_SQL} SELECT arrival_seq, bool_or(arrival_seq % 97 = 0) OVER {ROWS60} AS label FROM ev"),
    "normalize_columns": (normalize_columns, f"WITH {EVENTS_SQL}, s AS (SELECT avg(cpu_percent) AS m1, stddev_pop(cpu_percent) AS s1, avg(latency_p99) AS m2, stddev_pop(latency_p99) AS s2 FROM ev WHERE arrival_seq % 2 = 0) SELECT arrival_seq, round((cpu_percent - m1) / (s1 + 1e-9), 6) AS cpu_percent, round((latency_p99 - m2) / (s2 + 1e-9), 6) AS latency_p99 FROM ev, s"),
    "chrono_split": (chrono_split, f"WITH {EVENTS_SQL}, q AS (SELECT *, {NUMBERED} FROM ev) SELECT arrival_seq, CASE WHEN start + 1 <= floor(cnt * (1 - CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'val' END AS part FROM q"),
    "threshold_sigma": (threshold_sigma, f"WITH {EVENTS_SQL} SELECT round(avg(cpu_percent), 6) AS mean, round(stddev_pop(cpu_percent), 6) AS std, round(avg(cpu_percent) + 3 * stddev_pop(cpu_percent), 6) AS threshold FROM ev"),
    "recon_score": (recon_score, f"WITH {EVENTS_SQL}, s AS (SELECT avg(cpu_percent) + 3 * stddev_pop(cpu_percent) AS t FROM ev) SELECT arrival_seq, round(least(1.0, cpu_percent / t), 6) AS score FROM ev, s"),
    "debounce": (debounce, f"WITH {EVENTS_SQL} SELECT arrival_seq, count(*) OVER w = 3 AND bool_and(cpu_percent > 60) OVER w AS flag FROM ev WINDOW w AS (PARTITION BY service_id ORDER BY arrival_seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "sigmoid_scores": (sigmoid_scores, f"WITH {EVENTS_SQL} SELECT arrival_seq, round(1 / (1 + exp(5 * (cpu_percent / 100 - 0.5))), 6) AS score, CASE greatest(abs(cpu_percent), abs(latency_p99), abs(error_rate), abs(request_rate)) WHEN abs(cpu_percent) THEN 'CPU_SPIKE' WHEN abs(latency_p99) THEN 'LATENCY_BURST' WHEN abs(error_rate) THEN 'ERROR_RATE_SPIKE' ELSE 'REQUEST_DROP' END AS anomaly_type FROM ev"),
    "model_counts": (model_counts, f"WITH {EVENTS_SQL}, q AS (SELECT *, {NUMBERED} FROM ev) SELECT service_id, CASE WHEN start >= 59 THEN 'TRANSFORMER' ELSE 'ISOLATION_FOREST' END AS model_used, count(*) AS n FROM q GROUP BY 1, 2"),
    "confusion_metrics": (confusion_metrics, f"WITH {EVENTS_SQL}, q AS (SELECT service_id, count(*) FILTER (arrival_seq % 5 = 0 AND cpu_percent > 50) AS tp, count(*) FILTER (arrival_seq % 5 <> 0 AND cpu_percent > 50) AS fp, count(*) FILTER (arrival_seq % 5 = 0 AND cpu_percent <= 50) AS fn, count(*) FILTER (arrival_seq % 5 <> 0 AND cpu_percent <= 50) AS tn FROM ev GROUP BY 1), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM q) SELECT service_id, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM p"),
    "debounce_sweep": (debounce_sweep, f"WITH {EVENTS_SQL}, o AS (SELECT service_id, arrival_seq, arrival_seq % 5 = 0 AS t, cpu_percent > 60 AS over60 FROM ev), d AS (" + " UNION ALL ".join(f"SELECT {p} AS persistence, t, count(*) OVER w = {p} AND bool_and(over60) OVER w AS f FROM o WINDOW w AS (PARTITION BY service_id ORDER BY arrival_seq ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)" for p in range(1, 6)) + "), q AS (SELECT persistence, count(*) FILTER (t AND f) AS tp, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (t AND NOT f) AS fn, count(*) FILTER (NOT t AND NOT f) AS tn FROM d GROUP BY 1), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM q) SELECT persistence, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM p"),
    "error_by_class": (error_by_class, f"WITH {EVENTS_SQL} SELECT arrival_seq % 5 = 0 AS label, round(avg(cpu_percent) + 1e-9, 6) AS mean_error, count(*) FILTER (cpu_percent > 60) AS n_over, count(*) AS n FROM ev GROUP BY 1"),
    "evaluation_replay": (evaluation_replay, None),
    "inject_clamp": (inject_clamp, f"WITH {EVENTS_SQL}, q AS (SELECT *, arrival_seq % 4 AS k, (arrival_seq % 10) / 10 + CAST(0.01379131717 AS DOUBLE) AS f FROM ev) SELECT arrival_seq, round(least(100.0, greatest(0.0, CASE WHEN k = 0 THEN least(100.0, cpu_percent * (2.5 + 1.5 * f)) ELSE cpu_percent END)), 4) AS cpu_percent, round(greatest(0.0, CASE WHEN k = 1 THEN latency_p99 * (5 + 10 * f) ELSE latency_p99 END), 4) AS latency_p99, round(least(1.0, greatest(0.0, CASE WHEN k = 2 THEN least(1.0, error_rate * (10 + 40 * f)) ELSE error_rate END)), 6) AS error_rate, round(greatest(0.0, CASE WHEN k = 3 THEN request_rate * (CAST(0.05 AS DOUBLE) + (CAST(0.2 AS DOUBLE) - CAST(0.05 AS DOUBLE)) * f) ELSE request_rate END), 4) AS request_rate FROM q"),
    "cascade_bfs": (cascade_bfs, f"WITH {EDGES_SQL} SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT src AS root, dst AS node, 1 AS depth FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src) WHERE root <> node GROUP BY 1, 2"),
    "components": (components, f"WITH RECURSIVE {EDGES_SQL}, u AS (SELECT src, dst FROM e WHERE src % 4 = dst % 4 UNION SELECT dst, src FROM e WHERE src % 4 = dst % 4), t AS (SELECT src AS node, src AS reached FROM u UNION SELECT t.node, u.dst FROM t JOIN u ON t.reached = u.src) SELECT node, min(reached) AS component FROM t GROUP BY 1"),
    "topk_scores": (topk_scores, f"WITH {A_SQL}, q AS (SELECT service_id, round(anomaly_score, 6) AS anomaly_score, row_number() OVER (PARTITION BY service_id ORDER BY round(anomaly_score, 6) DESC, timestamp_ms, span_id) AS rank FROM an) SELECT service_id, rank, anomaly_score FROM q WHERE rank <= 3"),
    "ar1_filter": (ar1_filter, f"WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT service_id, arrival_seq, cpu_percent, row_number() OVER (PARTITION BY service_id ORDER BY arrival_seq) AS rn FROM ev), c AS (SELECT service_id, rn, arrival_seq, cpu_percent AS x FROM r WHERE rn = 1 UNION ALL SELECT r.service_id, r.rn, r.arrival_seq, CAST(0.9 AS DOUBLE) * c.x + r.cpu_percent FROM r JOIN c ON r.service_id = c.service_id AND r.rn = c.rn + 1) SELECT arrival_seq, round(x + 1e-9, 6) AS x FROM c"),
    "seasonal": (seasonal, f"WITH {EVENTS_SQL} SELECT arrival_seq, round(0.3 * sin(2 * pi() * arrival_seq / 500) + 1e-9, 6) AS load FROM ev"),
    "labelled_series": (labelled_series, None),
    "iforest_scores": (iforest_scores, None),
    "autoencoder_windows": (autoencoder_windows, None),
    "gateway_scores": (gateway_scores, None),
    "granger_pairs": (granger_pairs, None),
    "service_registry": (service_registry, None),
}

QUERIES = {name: f for name, (f, _) in REGISTRY.items()}
ORACLES = {name: sql for name, (_, sql) in REGISTRY.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of trailing one-week z-scores: not empty on the smallest tables either."""
    return zscore_anomalies(spark, sf_dir, 168 * HOUR)
