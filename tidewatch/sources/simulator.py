"""Spans as a simulated fleet emits them: metrics around each service's level, injected anomalies
and the cascades that these set off."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import METRICS
from ..operators import graph
from . import generator

# What share of its level a metric moves by with the load, and the spread of its own
# noise as a share of the level; period and height of the season; memory of the noises.
BY_LOAD = {"cpu_percent": 0.2, "latency_p99": 0.25, "error_rate": 0.4, "request_rate": 0.2}
OWN_NOISE = {"cpu_percent": 0.05, "latency_p99": 0.08, "error_rate": 0.1, "request_rate": 0.05}
PERIOD, HEIGHT, RHO = 500.0, 0.3, 0.9

BASES = ("base_cpu", "base_latency", "base_error", "base_request")


def ticks(services: DataFrame, steps: int, seed: int = 42, chunk: int = 10_000) -> DataFrame:
    """(service_id, step, four metrics) of `steps` ticks of each service (see generator.services).
    A task holds `chunk` ticks of one service and the last value of its five AR(1) noises; a
    service's draws hang on its id and the seed alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                r = np.random.default_rng([seed, *row.service_id.encode()])
                base = [getattr(row, b) for b in BASES]
                scale = [1.0, *(b * OWN_NOISE[m] for m, b in zip(METRICS, base))]
                last = np.zeros(5)
                for lo in range(0, steps, chunk):
                    t = np.arange(lo + 1, min(lo + chunk, steps) + 1)
                    noise = np.empty((len(t), 5))
                    for i, e in enumerate(r.normal(0, scale, (len(t), 5))):
                        noise[i] = last = RHO * last + e * np.sqrt(1 - RHO * RHO)
                    load = generator.seasonal(t, PERIOD, HEIGHT) + 0.5 * noise[:, 0]
                    out = {m: b * (1 + BY_LOAD[m] * load) + noise[:, i + 1] for i, (m, b) in enumerate(zip(METRICS, base))}
                    yield pd.DataFrame({"service_id": row.service_id, "step": t, **out})

    shape = "service_id string, step long, " + ", ".join(f"{m} double" for m in METRICS)
    return services.select("service_id", *BASES).mapInPandas(run, shape)


def _hex(digits: int, *columns: str | Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", *columns), 256), 1, digits)


def spans(services: DataFrame, edges: DataFrame, steps: int, start_ms: int = 0, interval_ms: int = 1000, p: float = 0.05, cascade: float = 0.3, inject: float = 0.8, seed: int = 42) -> DataFrame:
    """Nested spans (schema.SPAN_JSON's columns): one for each service and tick, a share p of them
    with an injected anomaly; for a share `cascade` of these also one of each service within two
    hops, which is tagged CASCADE and anomalous and has an injected metric in a share `inject`.

    A cascade's span has the metrics that its service shows at that tick, and the trace id of the
    span that set it off.  Ids hang on service, tick and cause, so a repeated run gives the same."""
    level = ticks(services, steps, seed).withColumn("span_id", _hex(16, "service_id", F.col("step").cast("string"), F.lit(str(seed))))
    own = generator.clamped(generator.maybe_injected(level, p, seed)).withColumn("trace_id", _hex(32, F.lit("trace"), "span_id"))
    hits = own.where("is_anomaly").select("service_id", "span_id", "step", "trace_id")
    hit = graph.cascades(hits.select("service_id", "span_id"), edges, cascade, inject, seed=seed)
    causes = hits.select(F.col("span_id").alias("cause_span_id"), "step", "trace_id")
    reached = hit.select("cause_span_id", "service_id", "injected").join(causes, "cause_span_id").join(level.drop("span_id"), ["service_id", "step"])
    reached = reached.withColumn("span_id", _hex(16, "cause_span_id", "service_id"))
    more = generator.clamped(generator.maybe_injected(reached, F.when(F.col("injected"), 1.0).otherwise(0.0), seed + 2))
    more = more.withColumns({"anomaly_type": F.lit("CASCADE"), "is_anomaly": F.lit(True)})
    cols = ["trace_id", "span_id", "service_id", "step", *METRICS, "anomaly_type", "is_anomaly"]
    every = own.select(*cols).unionByName(more.select(*cols))
    metrics = F.struct(*[F.col(m) for m in METRICS]).alias("metrics")
    return every.select("trace_id", "span_id", "service_id", (start_ms + F.col("step") * interval_ms).alias("timestamp"), metrics, "anomaly_type", "is_anomaly")
