"""Trailing z-scores, their throttle, and the anomalies made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANOMALY_TYPES, METRICS, UNKNOWN_TYPE
from .chain import greedy_chain
from .numbering import WIDTH, running_max, spread

RANGE = 1 << 15  # rows for each range that a window's length is cut into


def trailing_z(events: DataFrame, window_ms: int = 300_000, least: int = 10, metrics: tuple[str, ...] = METRICS, by_prefix: bool = True, key: str = "service_id") -> DataFrame:
    """events with n and z_<metric>: (x - mean) / (population std + 1e-9) over the trailing window
    (its lower bound included, the row included), rounded to 4 places; null where n < least.

    A moving range frame (by_prefix=False) costs rows times window, a task for each key.  With
    `by_prefix`, a key's rows are dealt to time buckets of the window's length, each with the sum
    of the bucket before, and running sums with an expiry marker for each row do it in one pass.
    Buckets are cut into ranges of time that start from the sums of those before, so a hot key is
    split however dense it is, and no sum runs over more than two windows."""
    out = _by_prefix(events, window_ms, metrics, key) if by_prefix else _by_range(events, window_ms, metrics, key)
    return _scored(out, least, metrics)


def history_z(events: DataFrame, window_ms: int = 300_000, least: int = 10, metrics: tuple[str, ...] = METRICS, order: str = "arrival_seq", key: str = "service_id", width: int = WIDTH) -> DataFrame:
    """events with n and z_<metric> over the history as a service keeps it in arrival order: a row
    is appended, then rows leave from the head only, while the head is older than the window, so
    an out-of-order head shelters older rows behind it.

    The head after a row is the first row whose running maximum of time is within the window of
    this row's running maximum: older ones have all left at the row that set it, and no later row
    moves the head beyond.  So histories are trailing windows over that running maximum, which
    never falls, and the same prefix sums and buckets do for them, rows in arrival order."""
    timed = running_max(events.withColumn("_order", F.col(order)), key, order, "timestamp_ms", "_top", width)
    return _scored(_by_prefix(timed, window_ms, metrics, key, "_top", "_order"), least, metrics).drop("_top", "_order")


def _scored(out: DataFrame, least: int, metrics: tuple[str, ...]) -> DataFrame:
    z = lambda m: F.round((F.col(m) - F.col(f"_mean_{m}")) / (F.col(f"_std_{m}") + 1e-9), 4)
    out = out.withColumns({f"z_{m}": F.when(F.col("n") >= least, z(m)) for m in metrics})
    return out.drop(*[f"_mean_{m}" for m in metrics], *[f"_std_{m}" for m in metrics])


def _by_range(events: DataFrame, window_ms: int, metrics: tuple[str, ...], key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("timestamp_ms").rangeBetween(-window_ms, 0)
    stats = {"n": F.count(F.lit(1)).over(w)}
    for m in metrics:
        stats |= {f"_mean_{m}": F.avg(m).over(w), f"_std_{m}": F.stddev_pop(m).over(w)}
    return events.withColumns(stats)


def _by_prefix(events: DataFrame, window_ms: int, metrics: tuple[str, ...], key: str, t: str = "timestamp_ms", order: str | None = None) -> DataFrame:
    # Sums of squares cancel where the mean is large: values are centred on their key's mean first.
    centre = events.groupBy(key).agg(*[F.avg(m).alias(f"_c_{m}") for m in metrics])
    rows = events.join(centre, key).withColumns({f"_x_{m}": F.col(m) - F.col(f"_c_{m}") for m in metrics})
    # A bucket is cut into ranges of time, more of them the more rows there are.
    total = events.count()
    ranges = max(1, min(window_ms, total // RANGE))
    bucket = F.floor(F.col(t) / window_ms).cast("long")
    at = F.coalesce(bucket * ranges + F.floor(F.pmod(F.col(t), F.lit(window_ms)) * ranges / window_ms).cast("long"), F.lit(-(1 << 62)))
    live = rows.withColumns({"_bucket": bucket, "_range": at, "_t": F.col(t), "_kind": F.lit(0), "_sign": F.lit(1)})
    # In the next bucket a row counts from the start until it expires.
    bare = [F.col(c) if c == key or c.startswith("_x_") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    gone = rows.select(*bare, (bucket + 1).alias("_bucket"), (at + ranges).alias("_range"), (F.col(t) + window_ms).alias("_t"), F.lit(1).alias("_kind"), F.lit(-1).alias("_sign"))
    parts = {"n": F.col("_sign")}
    for m in metrics:
        parts |= {f"_s_{m}": F.col("_sign") * F.col(f"_x_{m}"), f"_q_{m}": F.col("_sign") * F.col(f"_x_{m}") * F.col(f"_x_{m}")}
    both = live.unionByName(gone)
    # What stands before a range: the rows of the bucket before, and all of this one's earlier ranges.
    sums = both.groupBy(key, "_bucket", "_range").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in parts.items()])
    ahead = Window.partitionBy(key, "_bucket").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = live.groupBy(key, (F.col("_bucket") + 1).alias("_bucket")).agg(*[F.sum(c).alias(f"_last_{k}") for k, c in parts.items()])
    base = sums.withColumns({f"_sum_{k}": F.coalesce(F.sum(f"_sum_{k}").over(ahead), F.lit(0)) for k in parts}).join(last, [key, "_bucket"], "left")
    base = base.select(key, "_range", *[(F.col(f"_sum_{k}") + F.coalesce(f"_last_{k}", F.lit(0))).alias(f"_base_{k}") for k in parts])
    w = Window.partitionBy(key, "_range").orderBy("_t", "_kind").rangeBetween(Window.unboundedPreceding, 0)
    if order is not None:  # rows of one time count those before them alone
        w = Window.partitionBy(key, "_range").orderBy("_t", "_kind", order).rowsBetween(Window.unboundedPreceding, 0)
    out = spread(both, 2 * total, key, "_range").withColumns({k: F.sum(c).over(w) for k, c in parts.items()}).where("_kind = 0").join(base.hint("merge"), [key, "_range"])
    out = out.withColumns({k: F.coalesce(k, F.lit(0)) + F.col(f"_base_{k}") for k in parts}).withColumn("n", F.col("n").cast("long"))
    for m in metrics:
        mean = F.col(f"_s_{m}") / F.col("n")
        out = out.withColumns({f"_mean_{m}": mean + F.col(f"_c_{m}"), f"_std_{m}": F.sqrt(F.greatest(F.col(f"_q_{m}") / F.col("n") - mean * mean, F.lit(0.0)))})
    return out.select(*events.columns, "n", *[f"_mean_{m}" for m in metrics], *[f"_std_{m}" for m in metrics])


def strongest(metrics: tuple[str, ...] = METRICS, threshold: float = 3.0) -> tuple[Column, Column]:
    """(type, z) of the metric of largest |z| over the threshold, the earliest of equal ones; z
    keeps its sign.  Null where none is over."""
    size = F.greatest(*[F.abs(f"z_{m}") for m in metrics], F.lit(0.0))
    kind = z = F.lit(None)
    for m in reversed(metrics):
        kind = F.when(F.abs(f"z_{m}") == size, F.lit(ANOMALY_TYPES.get(m, UNKNOWN_TYPE))).otherwise(kind)
        z = F.when(F.abs(f"z_{m}") == size, F.col(f"z_{m}")).otherwise(z)
    over = size > threshold
    return F.when(over, kind), F.when(over, z)


def anomaly_score(z: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(z) / 10)


def severity(score: Column) -> Column:
    return F.when(score >= 0.9, 5).when(score >= 0.75, 4).when(score >= 0.55, 3).when(score >= 0.35, 2).otherwise(1)


def throttled(events: DataFrame, slide_ms: int = 30_000, order: str = "arrival_seq", key: str = "service_id") -> DataFrame:
    """Rows at which a service is evaluated: its first, then each that is slide_ms or more after
    the last evaluated one."""
    return greedy_chain(events, key, order, "timestamp_ms", slide_ms).where("fired").drop("fired", "fired_anchor", "fired_no")


def anomalies(scored: DataFrame, threshold: float = 3.0, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Anomaly events of scored rows (see trailing_z)."""
    kind, z = strongest(metrics, threshold)
    rows = scored.withColumns({"anomaly_type": kind, "z_score": z}).where("z_score is not null")
    score = anomaly_score(F.col("z_score"))
    return rows.select("service_id", "span_id", "trace_id", "anomaly_type", "z_score", score.alias("anomaly_score"), severity(score).alias("severity"), F.lit("ZSCORE").alias("model_used"), F.col("timestamp_ms").alias("detected_at"))


def identified(found: DataFrame) -> DataFrame:
    """Anomalies with an id and both times: detected_at is the event's, processed_at the clock's.
    The id depends on service, span and time alone, so a repeated run gives the same one."""
    key = F.sha2(F.concat_ws("\x1f", F.coalesce("service_id", F.lit("")), F.coalesce("span_id", F.lit("")), F.col("detected_at").cast("string"), "model_used"), 256)
    return found.withColumns({"id": F.substring(key, 1, 32), "processed_at": F.current_timestamp()})


def detect(events: DataFrame, window_ms: int = 300_000, slide_ms: int = 30_000, least: int = 10, threshold: float = 3.0, order: str = "arrival_seq") -> DataFrame:
    """The whole detector: trailing z-scores of all rows, anomalies of the evaluated ones."""
    return anomalies(throttled(trailing_z(events, window_ms, least), slide_ms, order), threshold)
