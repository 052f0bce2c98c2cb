"""Rolling sequences, windows for training, normalisation, thresholds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, METRICS
from .numbering import WIDTH, blocks, numbered, previous, running_sum
from .quantiles import quantiles


def features(metrics: tuple[str, ...] = METRICS) -> Column:
    return F.array(*[F.col(m).cast("double") for m in metrics])


def rolling(df: DataFrame, key: str, order: str, value: Column, length: int = DEFAULTS.sequence_length, out: str = "sequence", width: int = WIDTH) -> DataFrame:
    """df with `out`, the last `length` values of the key (this row's the last), and n_buf.

    Here and below, `order` is a number and a key's rows are dealt in ranges of `width`."""
    rows, w = blocks(numbered(df, key, order, width), key, length, width=width)
    rows = rows.withColumn(out, F.collect_list(value).over(w)).where("_own")
    return rows.select(*[c for c in df.columns if c != out], out).withColumn("n_buf", F.size(out))


def training_windows(df: DataFrame, key: str, order: str, value: Column, length: int = DEFAULTS.sequence_length, width: int = WIDTH) -> DataFrame:
    """Key, start (0-based row) and the `length` values from there, at stride 1; starts lie below
    rows - length, so the last full window is left out."""
    rows, w = blocks(numbered(df, key, order, width), key, length, True, width)
    rows = rows.withColumn("sequence", F.collect_list(value).over(w)).where(F.col("_own") & (F.col("_rn") < F.col("_n") - length))
    return rows.select(key, F.col("_rn").alias("start"), "sequence")


def label_windows(df: DataFrame, key: str, order: str, flag: str, length: int = DEFAULTS.sequence_length, width: int = WIDTH) -> DataFrame:
    """Key, start and whether any of the window's rows is flagged, for training_windows' starts."""
    rows, w = blocks(numbered(df, key, order, width), key, length, True, width)
    rows = rows.withColumn("label", F.max(flag).over(w)).where(F.col("_own") & (F.col("_rn") < F.col("_n") - length))
    return rows.select(key, F.col("_rn").alias("start"), "label")


def trailing_label(df: DataFrame, key: str, order: str, flag: str, length: int = DEFAULTS.sequence_length, width: int = WIDTH) -> DataFrame:
    """df with label: any of the last `length` rows is flagged (fewer at the start)."""
    rows, w = blocks(numbered(df, key, order, width), key, length, width=width)
    return rows.withColumn("label", F.max(flag).over(w)).where("_own").select(*[c for c in df.columns if c != "label"], "label")


def numbered_blocks(df: DataFrame, key: str, order: str, length: int = DEFAULTS.sequence_length, width: int = WIDTH) -> DataFrame:
    """Rows of non-overlapping windows, with `block`; starts lie below rows - length."""
    rows = numbered(df, key, order, width).withColumn("block", F.floor(F.col("_rn") / length))
    return rows.where(F.col("block") * length < F.col("_n") - length).drop("_rn", "_n")


def summary(df: DataFrame, by: list[str], first: str = "cpu_percent", second: str = "latency_p99", error: str = "error_rate", request: str = "request_rate", bounded: bool = True) -> DataFrame:
    """Seven features of a group: mean, population std, p95, p99 and maximum over both first
    metrics together, then mean error and mean request rate.

    Groups are windows (`bounded`), whose values fit one buffer; for groups of any size the
    percentiles are taken by ranks over ranges (see quantiles)."""
    rows = df.select(*by, error, request, F.posexplode(F.array(first, second)).alias("_at", "_x"))
    mean = lambda c: F.avg(F.when(F.col("_at") == 0, F.col(c)))
    plain = {"f_mean": F.avg("_x"), "f_std": F.stddev_pop("_x"), "f_max": F.max("_x"), "f_error": mean(error), "f_request": mean(request)}
    shares = {"f_p95": 0.95, "f_p99": 0.99}
    names = ["f_mean", "f_std", "f_p95", "f_p99", "f_max", "f_error", "f_request"]
    if bounded:
        return rows.groupBy(*by).agg(*[({n: F.percentile("_x", q) for n, q in shares.items()} | plain)[n].alias(n) for n in names])
    group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)])
    ranks = quantiles(rows, by, "_x", shares).select(group.alias("_g"), *shares)
    sums = rows.groupBy(group.alias("_g")).agg(*[c.alias(n) for n, c in plain.items()])
    return sums.join(ranks, "_g").select(*[F.col(f"_g.g{i}").alias(c) for i, c in enumerate(by)], *names)


def normalised(df: DataFrame, train: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """df with each metric less the training mean, over the training population std + 1e-9."""
    stats = train.agg(*[F.avg(m).alias(f"_m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"_s_{m}") for m in metrics])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({m: (F.col(m) - F.col(f"_m_{m}")) / (F.col(f"_s_{m}") + 1e-9) for m in metrics}).select(*df.columns)


def chronological_split(df: DataFrame, key: str, order: str, validation: float = 0.2, width: int = WIDTH) -> DataFrame:
    """df with `part`: the first floor(rows * (1 - validation)) rows of a key are train, others val."""
    train = F.col("_rn") < F.floor(F.col("_n") * (1 - validation))
    return numbered(df, key, order, width).withColumn("part", F.when(train, "train").otherwise("val")).drop("_rn", "_n")


def threshold(errors: DataFrame, error: str = "error", sigma: float = DEFAULTS.sigma) -> DataFrame:
    """One row: mean, population std and mean + sigma * std of errors."""
    return errors.agg(F.avg(error).alias("mean"), F.stddev_pop(error).alias("std")).withColumn("threshold", F.col("mean") + sigma * F.col("std"))


def debounced(df: DataFrame, key: str, order: str, error: str, limit: Column | float, persistence: int = DEFAULTS.persistence, out: str = "flag", width: int = WIDTH) -> DataFrame:
    """df with `out`: this and the persistence-1 rows before all exist and are over the limit."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    over = F.coalesce(F.col(error) > limit, F.lit(False)).cast("int")
    rows, w = blocks(numbered(df, key, order, width).withColumn("_over", over), key, persistence, width=width)
    rows = rows.withColumn(out, (F.count(F.lit(1)).over(w) == persistence) & (F.min("_over").over(w) == 1))
    return rows.where("_own").select(*[c for c in df.columns if c != out], out)


def sessions(df: DataFrame, key: str, order: str, t: str, gap_ms: int, width: int = WIDTH) -> DataFrame:
    """df with `session`: a gap of more than gap_ms starts a new one, which resets a debouncer
    that is partitioned by it.  The first row of a range of `order` looks at the last of the
    range before, and sessions begun in earlier ranges are added up."""
    rows = previous(df, key, order, t, "_last", width)
    new = F.coalesce((F.col(t) - F.col("_last") > gap_ms).cast("int"), F.lit(0))
    return running_sum(rows.withColumn("_new", new), key, order, "_new", "session", width).select(*[c for c in df.columns if c != "session"], "session")


def sigmoid_score(decision: Column) -> Column:
    return 1 / (1 + F.exp(5 * decision))


def reconstruction_score(error: Column, limit: Column) -> Column:
    return F.least(F.lit(1.0), error / limit)


def argmax_type(vector: Column, types: list[str]) -> Column:
    """The type at the first place of largest magnitude in a feature vector."""
    size = F.transform(vector, F.abs)
    return F.element_at(F.array(*[F.lit(t) for t in types]), F.array_position(size, F.array_max(size)).cast("int"))


def routed(df: DataFrame, length: int = DEFAULTS.sequence_length, n_buf: str = "n_buf") -> DataFrame:
    """df with model_used: the sequence model once the buffer is full, the forest before."""
    return df.withColumn("model_used", F.when(F.col(n_buf) == length, "TRANSFORMER").otherwise("ISOLATION_FOREST"))


def confusion(df: DataFrame, truth: str, flag: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; a ratio is 0 where undefined."""
    hit = lambda t, f: F.count_if((F.col(truth) == t) & (F.col(flag) == f))
    out = df.groupBy(*(by or [])).agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"), hit(False, False).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def error_by_class(df: DataFrame, label: str, error: str, limit: float) -> DataFrame:
    return df.groupBy(label).agg(F.avg(error).alias("mean_error"), F.count_if(F.col(error) > limit).alias("n_over"), F.count(F.lit(1)).alias("n"))
