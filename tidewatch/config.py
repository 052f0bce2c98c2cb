"""All durations and thresholds in one place; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of the reference pipeline."""

    tumbling_ms: int = 60_000
    sliding_ms: int = 300_000
    slide_ms: int = 30_000
    lag_ms: int = 5_000
    dedup_ttl_ms: int = 600_000
    z_threshold: float = 3.0
    min_history: int = 10
    sequence_length: int = 60
    sigma: float = 3.0
    contamination: float = 0.05
    persistence: int = 2
    forest_flag: float = 0.7


DEFAULTS = EngineConfig()

# Metrics in feature order, and the anomaly type each one stands for.
METRICS = ("cpu_percent", "latency_p99", "error_rate", "request_rate")
ANOMALY_TYPES = {
    "cpu_percent": "CPU_SPIKE",
    "latency_p99": "LATENCY_BURST",
    "error_rate": "ERROR_RATE_SPIKE",
    "request_rate": "REQUEST_DROP",
}
UNKNOWN_TYPE = "UNKNOWN"
