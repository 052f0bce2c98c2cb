"""Fitted models kept in a folder: weights as one-row Parquet tables, statistics as JSON.

`normalisation` holds {mean: [4], std: [4]} and `threshold` {mean, std, threshold}, so files of
that form are read as well.  What is missing gets a default, as load() says.
"""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .autoencoders import Fitted, Linear, Recurrent, Shape, Transformer
from .forest import Forest
from .gateway import Gateway

# The limit of a model without one, and the statistics of a missing threshold.
NO_LIMIT = 1.0
NO_THRESHOLD = {"mean": 0.05, "std": 0.02, "threshold": 0.11}

KINDS = {c.kind: c for c in (Linear, Transformer, Recurrent)}


def _packed(arrays: dict[str, np.ndarray]) -> bytearray:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return bytearray(out.getvalue())


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def _first(rows: DataFrame) -> Row | None:
    return rows.limit(1).collect()[0] if rows.columns else None


def _read(spark: SparkSession, path: str, form: str) -> Row | None:
    """The one row under path, or None if there is no such path; other errors are raised."""
    try:
        return _first(spark.read.format(form).load(path))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _json(spark: SparkSession, path: str, value: dict) -> None:
    spark.range(1).select(F.lit(json.dumps(value)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save(spark: SparkSession, folder: str, gateway: Gateway) -> None:
    """Write the gateway's models; those it lacks are left as they are in the folder."""
    fitted, forest = gateway.sequence, gateway.forest
    if fitted is not None:
        shape = json.dumps(vars(fitted.model.shape))
        row = [(fitted.model.kind, shape, _packed(fitted.model.w))]
        spark.createDataFrame(row, "kind string, shape string, weights binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/sequence")
        _json(spark, f"{folder}/normalisation", {"mean": fitted.mean.tolist(), "std": fitted.std.tolist()})
        _json(spark, f"{folder}/threshold", {"mean": fitted.mean_error, "std": fitted.std_error, "threshold": fitted.threshold})
    if forest is not None:
        row = [(forest.per_tree, float(forest.offset), _packed({f"t{i:06d}": t for i, t in enumerate(forest.trees)}))]
        spark.createDataFrame(row, "per_tree long, offset double, trees binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/forest")


def threshold(spark: SparkSession, folder: str) -> dict[str, float]:
    """{mean, std, threshold} as kept, or NO_THRESHOLD."""
    found = _read(spark, f"{folder}/threshold", "json")
    return {k: float(found[k]) for k in NO_THRESHOLD} if found else dict(NO_THRESHOLD)


def load(spark: SparkSession, folder: str, **limits) -> Gateway:
    """The kept gateway.  No weights or no normalisation: no sequence model; no threshold: a limit
    of 1.0; no forest: none."""
    kept, stats = _read(spark, f"{folder}/sequence", "parquet"), _read(spark, f"{folder}/normalisation", "json")
    fitted = None
    if kept and stats:
        shape = json.loads(kept["shape"])
        shape = Shape(**(shape | {"decoder": tuple(shape["decoder"])}))
        model = KINDS[kept["kind"]](shape=shape)
        model.w = _unpacked(kept["weights"])
        limit = _read(spark, f"{folder}/threshold", "json")
        fitted = Fitted(model, np.array(stats["mean"], float), np.array(stats["std"], float), float(limit["threshold"]) if limit else NO_LIMIT, float(limit["mean"]) if limit else 0.0, float(limit["std"]) if limit else 0.0)
    trees = _read(spark, f"{folder}/forest", "parquet")
    forest = None
    if trees:
        arrays = _unpacked(trees["trees"])
        forest = Forest([arrays[k] for k in sorted(arrays)], int(trees["per_tree"]), float(trees["offset"]))
    return Gateway(fitted, forest, **limits)
