"""Replay of labelled series through a fitted model, and what debouncing makes of its errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import METRICS
from ..operators import sequence
from .autoencoders import Fitted


def replay(df: DataFrame, fitted: Fitted, key: str, order: str, label: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(key, start, error, truth) of every window at stride 1 (see sequence.training_windows);
    truth: any of its rows is labelled.  Null metrics count as 0, null labels as not set."""
    length, n = fitted.model.shape.length, len(metrics)
    values = F.array(*[F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in metrics])
    flag = F.coalesce(F.col(label), F.lit(False))
    windows = sequence.training_windows(df, key, order, F.struct(values.alias("x"), flag.alias("f")), length)
    rows = windows.select(key, "start", F.flatten("sequence.x").alias("x"), F.exists("sequence.f", lambda f: f).alias("truth"))

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 1024):
                part = f.iloc[lo : lo + 1024]
                raw = np.stack(part["x"].to_list()).reshape(-1, length, n)
                yield part[[key, "start"]].assign(error=fitted.errors(raw), truth=part["truth"])

    return rows.mapInPandas(errors, f"`{key}` {dict(df.dtypes)[key]}, start long, error double, truth boolean")


def sweep(trace: DataFrame, key: str, order: str, error: str, truth: str, limit: Column | float, persistences: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """One row for each persistence (1: errors as they are): tp, fp, fn, tn, precision, recall, f1
    of flags that need so many errors over the limit in a row.  The trace is windowed once."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    over = F.coalesce(F.col(error) > limit, F.lit(False))
    rows = sequence.rolling(trace, key, order, over, max(persistences), "_over")
    lasting = lambda p: (F.size("_over") >= p) & ~F.exists(F.slice(F.reverse("_over"), 1, p), lambda x: ~x)
    each = F.array(*[F.struct(F.lit(p).alias("persistence"), lasting(p).alias("_flag")) for p in persistences])
    flagged = rows.select(F.col(truth).alias("_truth"), F.inline(each))
    return sequence.confusion(flagged, "_truth", "_flag", ["persistence"])
