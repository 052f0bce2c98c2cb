"""Granger tests between services: do one's past values help to predict another's?"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def _residual(gram: np.ndarray, used: list[int]) -> float:
    """Sum of squared residuals of the last variable on the `used` ones."""
    inner, cross = gram[np.ix_(used, used)], gram[used, -1]
    return float(gram[-1, -1] - cross @ np.linalg.lstsq(inner, cross, rcond=None)[0])


def tests(df: DataFrame, pairs: DataFrame, key: str, order: str, value: str, maxlag: int = 5, level: float = 0.05) -> DataFrame:
    """src, dst, lag, n, f_stat, p_value, causes for each distinct pair and lag from 1 to maxlag.

    Series of (key, order, value) meet at equal `order`; all lags are judged on the rows that
    have maxlag rows before them in both series.  Values are standardised for each key, and
    only sums of products are gathered for a pair, with partial sums before the shuffle.  A
    pair with too few rows or a constant effect has null f_stat and p_value."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("t"), F.col(value).cast("double").alias("v"))
    stats = rows.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    level_rows = rows.join(stats, "k").select("k", "t", F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0).alias("v"))
    w = Window.partitionBy("k").orderBy("t")
    lagged = level_rows.withColumns({f"v{i}": F.lag("v", i).over(w) for i in range(1, maxlag + 1)}).where(F.col(f"v{maxlag}").isNotNull())
    cause = lagged.select(F.col("k").alias("src"), "t", *[F.col(f"v{i}").alias(f"x{i}") for i in range(1, maxlag + 1)])
    effect = lagged.select(F.col("k").alias("dst"), "t", F.col("v").alias("y0"), *[F.col(f"v{i}").alias(f"y{i}") for i in range(1, maxlag + 1)])
    met = pairs.select("src", "dst").distinct().join(cause, "src").join(effect, ["dst", "t"])
    lags = range(1, maxlag + 1)
    z = [F.lit(1.0), *[F.col(f"y{i}") for i in lags], *[F.col(f"x{i}") for i in lags], F.col("y0")]
    width = len(z)
    at = [(i, j) for i in range(width) for j in range(i, width)]
    sums = met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(z[i] * z[j]) for i, j in at]).alias("sums"))

    @F.pandas_udf("array<struct<lag:int,f_stat:double,p_value:double>>")
    def solve(sums: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for s, rows_ in zip(sums, n):
            gram = np.zeros((width, width))
            for (i, j), x in zip(at, s):
                gram[i, j] = gram[j, i] = x
            found = []
            for lag in lags:
                own = [0, *range(1, lag + 1)]
                both = own + list(range(maxlag + 1, maxlag + lag + 1))
                free = int(rows_) - len(both)
                less, more = (_residual(gram, own), _residual(gram, both)) if free > 0 else (0.0, 0.0)
                if free <= 0 or more <= 1e-12 * max(gram[-1, -1], 1e-300):
                    found.append({"lag": lag, "f_stat": None, "p_value": None})
                    continue
                f = max(0.0, (less - more) / lag / (more / free))
                found.append({"lag": lag, "f_stat": f, "p_value": beta_share(free / (free + lag * f), free / 2, lag / 2)})
            out.append(found)
        return pd.Series(out)

    flat = sums.select("src", "dst", "n", F.inline(solve("sums", "n")))
    return flat.select("src", "dst", "lag", "n", "f_stat", "p_value", (F.col("p_value") < level).alias("causes"))
