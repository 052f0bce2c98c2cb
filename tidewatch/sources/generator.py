"""Seeded synthetic telemetry: services, dependency graph, correlated series, injection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(*key) -> Column:
    """Uniform in [0, 1) from a hash: the same on every run and layout."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)


def services(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """Service dimension: id, name, tier, team and four baselines."""
    u = lambda lo, hi, k: F.round(lo + (hi - lo) * _unit("id", F.lit(seed), F.lit(k)), 6)
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(_unit("id", F.lit(seed), F.lit(k)) * len(words)) + 1).cast("int"))
    return spark.range(n).select(
        F.format_string("svc-%04d", F.col("id")).alias("service_id"),
        F.format_string("service %d", F.col("id")).alias("name"),
        pick(["frontend", "backend", "data", "infra"], 1).alias("tier"),
        pick(["team-a", "team-b", "team-c", "team-d"], 2).alias("team"),
        u(10, 60, 3).alias("base_cpu"),
        u(20, 200, 4).alias("base_latency"),
        u(0.001, 0.05, 5).alias("base_error"),
        u(50, 500, 6).alias("base_request"),
    )


def dependencies(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """Edges (src, dst): one to three distinct others for each service."""
    rows = spark.range(n).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(_unit("id", F.lit(seed), F.lit("deg")) * 3).cast("int"))))
    step = 1 + F.floor(_unit("id", F.lit(seed), "k") * (n - 1)).cast("long")
    name = lambda c: F.format_string("svc-%04d", c)
    return rows.select(name(F.col("id")).alias("src"), name((F.col("id") + step) % n).alias("dst")).distinct()


# Each metric's level, its share in the load and the spread of its own noise, and
# what a burst adds to it (requests: multiplies it by).
LEVELS = {"cpu_percent": (40.0, 8.0, 2.0), "latency_p99": (120.0, 25.0, 6.0), "error_rate": (0.01, 0.004, 0.0008), "request_rate": (200.0, 40.0, 8.0)}
BURSTS = {"cpu_percent": (30.0, 50.0), "latency_p99": (100.0, 300.0), "error_rate": (0.1, 0.3), "request_rate": (0.1, 0.3)}


def ar1(noise: np.ndarray, rho: float) -> np.ndarray:
    """x[t] = rho * x[t-1] + noise[t], x[-1] = 0."""
    out, x = np.empty(len(noise)), 0.0
    for t, e in enumerate(noise):
        out[t] = x = rho * x + e
    return out


def seasonal(t, period: float = 500.0, height: float = 0.3):
    return height * np.sin(2 * np.pi * t / period)


def seasonal_load(step: Column, period: float = 500.0, height: float = 0.3) -> Column:
    return height * F.sin(2 * F.pi() * step / period)


def ar1_by_key(df: DataFrame, key: str, order: str, noise: str, rho: float = 0.9) -> DataFrame:
    """df with `x`, the AR(1) filter of `noise` for each key in order.  Rows are streamed in the
    shuffle's order: a task holds one batch and one value, whatever a key's length."""
    cols = df.columns
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = object(), 0.0
        for b in batches:
            out = []
            for k, e in zip(b.column(cols.index(key)).to_pylist(), b.column(cols.index(noise)).to_pylist()):
                last, x = k, rho * (x if k == last else 0.0) + (e or 0.0)
                out.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*cols, "x"])

    return df.repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", x double")


def series(spark: SparkSession, n_services: int = 10, steps: int = 2000, duty: float = 0.05, burst: int = 15, seed: int = 42) -> DataFrame:
    """Labelled series (service_id, step, four metrics, is_anomaly): one load of seasonality and
    AR(1) noise drives all four metrics, each with an AR(1) noise of its own.  A burst of `burst`
    steps changes one metric: cpu, latency or errors are raised, or requests cut; a share `duty`
    of steps lies in bursts, none of which starts in the last `burst` steps.  One task for each
    service."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.random.default_rng([seed, int(pdf["id"][0])])
        drift = lambda scale: ar1(r.normal(0, scale, steps), 0.9)
        t = np.arange(steps)
        noise = drift(1.0)
        load = seasonal(t) + 0.5 * noise / (noise.std() + 1e-9)
        metric = {name: base + by * load + drift(own) for name, (base, by, own) in LEVELS.items()}
        mask, start, i = np.zeros(steps, bool), r.random(steps) < duty / (burst * (1 - duty)), 0
        while i < steps - burst:
            if start[i]:
                part, kind = slice(i, i + burst), list(LEVELS)[r.integers(4)]
                lo, hi = BURSTS[kind]
                if kind == "request_rate":
                    metric[kind][part] *= r.uniform(lo, hi)
                else:
                    metric[kind][part] += r.uniform(lo, hi)
                mask[part] = True
                i += burst
            else:
                i += 1
        cpu, error = np.clip(metric["cpu_percent"], 0, 100), np.clip(metric["error_rate"], 0, 1)
        return pd.DataFrame({"service_id": f"svc-{int(pdf['id'][0]):04d}", "step": t, "cpu_percent": cpu, "latency_p99": np.maximum(metric["latency_p99"], 0), "error_rate": error, "request_rate": np.maximum(metric["request_rate"], 0), "is_anomaly": mask})

    schema = "service_id string, step long, cpu_percent double, latency_p99 double, error_rate double, request_rate double, is_anomaly boolean"
    return spark.range(n_services).groupBy("id").applyInPandas(make, schema)


def injected(df: DataFrame, kind: str, factor: str) -> DataFrame:
    """Rows with the metric of anomaly type `kind` changed by a unit factor in [0, 1): cpu 2.5-4
    fold to 100 at most, latency 5-15 fold, errors 10-50 fold to 1 at most, requests 5-20 %."""
    f, is_ = F.col(factor), lambda k: F.col(kind) == k
    between = lambda lo, hi: lo + (hi - lo) * f
    return df.withColumns(
        {
            "cpu_percent": F.when(is_("CPU_SPIKE"), F.least(F.lit(100.0), F.col("cpu_percent") * between(2.5, 4.0))).otherwise(F.col("cpu_percent")),
            "latency_p99": F.when(is_("LATENCY_BURST"), F.col("latency_p99") * between(5.0, 15.0)).otherwise(F.col("latency_p99")),
            "error_rate": F.when(is_("ERROR_RATE_SPIKE"), F.least(F.lit(1.0), F.col("error_rate") * between(10.0, 50.0))).otherwise(F.col("error_rate")),
            "request_rate": F.when(is_("REQUEST_DROP"), F.col("request_rate") * between(0.05, 0.2)).otherwise(F.col("request_rate")),
        }
    )


def maybe_injected(df: DataFrame, p: float | Column = 0.05, seed: int = 1, kinds: tuple[str, ...] = ("CPU_SPIKE", "LATENCY_BURST", "ERROR_RATE_SPIKE", "REQUEST_DROP"), by: str = "span_id") -> DataFrame:
    """df with a share p of its rows changed by one of `kinds`, each as likely; anomaly_type names
    it and is_anomaly is set.  The draws hang on `by` and the seed alone."""
    draw = lambda k: _unit(by, F.lit(seed), F.lit(k))
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), F.floor(draw(1) * len(kinds)).cast("int"))
    rows = df.withColumns({"_kind": F.when(draw(0) < p, kind), "_factor": draw(2)})
    out = injected(rows, "_kind", "_factor")
    return out.withColumns({"anomaly_type": F.col("_kind"), "is_anomaly": F.col("_kind").isNotNull()}).drop("_kind", "_factor")


def clamped(df: DataFrame) -> DataFrame:
    """Metrics in their ranges, rounded to 4 places (errors 6)."""
    low = lambda m: F.greatest(F.lit(0.0), F.col(m))
    return df.withColumns({"cpu_percent": F.round(F.least(F.lit(100.0), low("cpu_percent")), 4), "latency_p99": F.round(low("latency_p99"), 4), "error_rate": F.round(F.least(F.lit(1.0), low("error_rate")), 6), "request_rate": F.round(low("request_rate"), 4)})


def ids() -> tuple[Column, Column]:
    """(trace id of 32, span id of 16 hex digits)"""
    whole = lambda: F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return whole(), F.substring(whole(), 1, 16)
