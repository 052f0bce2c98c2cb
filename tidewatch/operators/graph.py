"""The service dependency graph: bounded traversal, components, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staged import staged


def within_hops(edges: DataFrame, roots: DataFrame, hops: int = 2) -> DataFrame:
    """(root, node, depth): nodes at smallest depth 1 .. hops from each root over edges (src, dst);
    a root is never its own node."""
    level = roots.select(F.col("root"), F.col("root").alias("node"))
    found = None
    for depth in range(1, hops + 1):
        level = level.join(edges, level["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        here = level.withColumn("depth", F.lit(depth))
        found = here if found is None else found.unionByName(here)
    return found.where("root <> node").groupBy("root", "node").agg(F.min("depth").alias("depth"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (src, dst) either way.

    In each round a node takes the smallest label of its neighbours and then its label's label,
    so paths of any length need few rounds; each round is a table in the cluster's folder (see
    staged), and the last is the one that changes no label."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    both = staged(both, "graph-edges")
    labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "graph-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = staged(labels.join(near, "node").select("node", F.least("component", "near").alias("next"), "component"), "graph-step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        least = F.least("next", "far")
        new = staged(step.join(jump, "next").select("node", least.alias("component"), (least < F.col("component")).alias("moved")), "graph-labels")
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels


def cascades(anomalies: DataFrame, edges: DataFrame, p: float = 0.3, inject: float = 0.8, hops: int = 2, seed: int = 1) -> DataFrame:
    """Rows that cascade anomalies emit: for a share p of anomalies (service_id, span_id) each node
    within `hops`, tagged CASCADE and anomalous; `injected` marks the share that is changed."""
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1_000_000)) / 1e6
    hit = anomalies.where(unit("span_id", F.lit(seed)) < p)
    reach = within_hops(edges, hit.select(F.col("service_id").alias("root")).distinct(), hops)
    out = hit.join(reach, hit["service_id"] == reach["root"])
    return out.select(F.col("span_id").alias("cause_span_id"), F.col("node").alias("service_id"), "depth", F.lit("CASCADE").alias("anomaly_type"), F.lit(True).alias("is_anomaly"), (unit("span_id", "node", F.lit(seed + 1)) < inject).alias("injected"))
