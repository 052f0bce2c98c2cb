"""Nearest neighbours by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one node that stands for its smallest vec_ids, so copies can't crowd a
graph.  Nodes are dealt to shards by a hash of the vector; a shard's graph is a few flat
arrays (vectors, neighbours per layer padded with -1, levels), stored as one row of binary
columns.  Largest inner product becomes nearest by Euclidean distance after one more
dimension that gives all of a shard's vectors the same length.  Graphs are built and searched
in blocks: many nodes walk a graph in step, each with its own beam.  Every shard answers for
every query block; the shards' results are merged, scored again in double precision on the
original vectors, and ranked.

Defined results: vectors null, empty, zero or with null or non-finite components are left
out, as queries too; vectors of different lengths are never compared; rows of null vec_id
are left out; rows of equal vec_id are one, the one of the smallest vector hash; candidates of
equal score are ranked by vec_id; fewer candidates than k give fewer rows; an empty table
gives no row; other columns are ignored, whatever their names.

Cost: a query costs a walk in each shard, so work grows as queries times rows / shard_rows;
`shard_rows` may be as large as a task's memory holds (a row takes its vector as doubles, 128
bytes of neighbours, and a byte for each query of a block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

LINKS, BUILD_BEAM, SEARCH_BEAM, SHARD_ROWS, BLOCK = 16, 96, 192, 16_384, 256
CHUNK_BYTES = 16 << 20


def _chunks(n: int, row_bytes: int) -> Iterator[slice]:
    """Slices of 0 .. n whose rows take about CHUNK_BYTES at most, whatever the vectors' length."""
    step = max(1, CHUNK_BYTES // max(1, row_bytes))
    return (slice(lo, lo + step) for lo in range(0, n, step))


class Graph:
    """Flat arrays: x (n, d) double, near[layer] (n, width) int32 padded with -1, levels (n,)."""

    def __init__(self, x: np.ndarray, links: int = LINKS, seed: int = 5):
        length2 = (x * x).sum(axis=1)
        self.x = np.concatenate([x, np.sqrt(np.maximum(length2.max() - length2, 0))[:, None]], axis=1) if len(x) else x
        self.links = links
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(np.int32), 8)
        top = int(self.levels.max()) if n else 0
        self.near = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(top + 1)]
        self.entry = -1

    def _far(self, nodes: np.ndarray, q: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Squared distances of nodes to q[of], in double precision."""
        out = np.empty(len(nodes))
        for part in _chunks(len(nodes), 3 * 8 * self.x.shape[1]):
            delta = self.x[nodes[part]]
            delta -= q[of[part]]
            np.einsum("ij,ij->i", delta, delta, out=out[part])
        return out

    def _beam(self, q: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best `beam` nodes on a layer for each query, as (nodes, squared distances), padded
        with -1 and infinity.  In each step every walk opens its nearest unopened nodes."""
        near, m = self.near[layer], len(q)
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf)
        done = np.ones((m, beam), bool)
        seen = np.zeros((m, len(self.x)), bool)
        rows = np.arange(m)
        width = min(start.shape[1], beam)
        ids[:, :width] = start[:, :width]
        ok = ids >= 0
        first = self._far(np.maximum(ids[:, :width], 0).ravel(), q, np.repeat(rows, width)).reshape(m, width)
        dist[:, :width] = np.where(ok[:, :width], first, np.inf)
        done[:, :width] = ~ok[:, :width]
        seen[rows[:, None], np.maximum(ids[:, :width], 0)] |= ok[:, :width]
        live = rows
        opened = 4
        while len(live):
            open_ = np.where(done[live], np.inf, dist[live])
            pick = np.argpartition(open_, min(opened, beam) - 1, axis=1)[:, : min(opened, beam)]
            gap = np.take_along_axis(open_, pick, axis=1)
            some = np.isfinite(gap).any(axis=1)
            live, pick, gap = live[some], pick[some], gap[some]
            if not len(live):
                break
            chosen = np.where(np.isfinite(gap), ids[live[:, None], pick], -1)
            done[live[:, None], pick] = True
            new = near[np.maximum(chosen, 0)]
            new = np.where((chosen >= 0)[:, :, None], new, -1).reshape(len(live), -1).astype(np.int64)
            fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
            seen[live[:, None], np.where(fresh, new, np.maximum(ids[live, :1], 0))] = True
            r, c = np.nonzero(fresh)
            node = new[r, c]
            # The same node may come from two opened ones: keep the first of each walk.
            _, first = np.unique(r * len(self.x) + node, return_index=True)
            r, node = r[first], node[first]
            d = self._far(node, q, live[r])
            close = d < dist[live[r]].max(axis=1)
            r, node, d = r[close], node[close], d[close]
            if not len(r):
                continue
            count = np.bincount(r, minlength=len(live))
            at = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            got = np.flatnonzero(count)
            wide = int(count.max())
            more_i = np.full((len(live), wide), -1, np.int64)
            more_d = np.full((len(live), wide), np.inf)
            more_i[r, at], more_d[r, at] = node, d
            who = live[got]
            all_i = np.concatenate([ids[who], more_i[got]], axis=1)
            all_d = np.concatenate([dist[who], more_d[got]], axis=1)
            all_f = np.concatenate([done[who], more_i[got] < 0], axis=1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids[who] = np.take_along_axis(all_i, keep, axis=1)
            dist[who] = np.take_along_axis(all_d, keep, axis=1)
            done[who] = np.take_along_axis(all_f, keep, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)

    def _spread(self, base: np.ndarray, cand: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Neighbours chosen from candidates (nearest first) so that each is nearer to the node
        than to the ones already chosen; free places go to the nearest of the rest."""
        m, c = cand.shape
        among = np.empty((m, c, c), np.float32)
        for part in _chunks(m, 8 * c * (self.x.shape[1] + 2 * c)):
            vec = self.x[np.maximum(cand[part], 0)]
            length2 = np.einsum("ijk,ijk->ij", vec, vec)
            among[part] = length2[:, :, None] + length2[:, None, :] - 2 * (vec @ vec.transpose(0, 2, 1))
        taken = np.zeros((m, c), bool)
        valid = (cand >= 0) & np.isfinite(dist)
        for j in range(c):
            blocked = (taken & (among[:, :, j] < dist[:, j : j + 1])).any(axis=1)
            taken[:, j] = valid[:, j] & ~blocked & (taken.sum(axis=1) < most)
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(valid, cand, -1), order, axis=1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((m, most - out.shape[1]), -1, out.dtype)], axis=1)
        return out

    def build(self, beam: int = BUILD_BEAM, block: int = BLOCK) -> "Graph":
        """Insert nodes in blocks that double up to `block`: a block's nodes search the graph of
        the blocks before, and meet each other directly."""
        n, at = len(self.x), 0
        order = np.argsort(-self.levels, kind="stable")  # high nodes first: the entry stays
        while at < n:
            size = 1 if at == 0 else min(block, at, n - at)
            self._insert(order[at : at + size], beam)
            at += size
        return self

    def _insert(self, nodes: np.ndarray, beam: int) -> None:
        if self.entry < 0:
            self.entry = int(nodes[0])
            return
        q = self.x[nodes]
        length2 = np.einsum("ij,ij->i", q, q)
        inner = np.maximum(length2[:, None] + length2[None, :] - 2 * (q @ q.T), 0)
        np.fill_diagonal(inner, np.inf)
        start = np.full((len(nodes), 1), self.entry, np.int64)
        for layer in range(int(self.levels[self.entry]), -1, -1):
            mine = self.levels[nodes] >= layer
            wide = beam if mine.any() else 1
            ids, dist = self._beam(q, start, layer, wide)
            start = ids[:, : max(1, min(4, wide))]
            if not mine.any():
                continue
            peers = np.flatnonzero(mine)
            sub = np.where(mine[None, :], inner[mine], np.inf)
            few = min(12, len(nodes))
            near = np.argpartition(sub, few - 1, axis=1)[:, :few]
            nd = np.take_along_axis(sub, near, axis=1)
            cand = np.concatenate([ids[mine], np.where(np.isfinite(nd), nodes[near], -1)], axis=1)
            cd = np.concatenate([dist[mine], nd], axis=1)
            best = np.argsort(cd, axis=1, kind="stable")[:, :48]
            cand, cd = np.take_along_axis(cand, best, axis=1), np.take_along_axis(cd, best, axis=1)
            chosen = self._spread(nodes[peers], cand, cd, self.links)
            table_ = self.near[layer]
            table_[nodes[peers], : self.links] = chosen
            src = np.repeat(nodes[peers], self.links)
            dst = chosen.ravel()
            real = dst >= 0
            self._back(layer, dst[real], src[real])

    def _back(self, layer: int, at: np.ndarray, new: np.ndarray) -> None:
        """Add links at -> new; a full row is chosen anew from old and new neighbours."""
        near = self.near[layer]
        width = near.shape[1]
        order = np.argsort(at, kind="stable")
        at, new = at[order], new[order]
        nodes, first, count = np.unique(at, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(count.max())), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(at)) - np.repeat(first, count)] = new
        cand = np.concatenate([near[nodes].astype(np.int64), extra], axis=1)
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        dist = self._far(np.maximum(cand, 0).ravel(), self.x, np.repeat(nodes, cand.shape[1])).reshape(cand.shape)
        dist[cand < 0] = np.inf
        by = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, by, axis=1), np.take_along_axis(dist, by, axis=1)
        full = (cand >= 0).sum(axis=1) > width
        near[nodes[~full]] = cand[~full][:, :width] if cand.shape[1] >= width else np.pad(cand[~full], ((0, 0), (0, width - cand.shape[1])), constant_values=-1)
        over = np.flatnonzero(full)
        for lo in range(0, len(over), 128):
            part = over[lo : lo + 128]
            near[nodes[part]] = self._spread(nodes[part], cand[part][:, : width + 24], dist[part][:, : width + 24], width)

    def search(self, q: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> np.ndarray:
        """(len(q), k) nodes of largest inner product, padded with -1."""
        if not len(self.x):
            return np.full((len(q), k), -1, np.int64)
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        start = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(len(self.near) - 1, 0, -1):
            start = self._beam(q, start, layer, 4)[0]
        return self._beam(q, start, 0, max(beam, k))[0][:, :k]


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vector): usable vectors, one for each vec_id."""
    sound = ~F.exists("vector", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("vector", lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(F.size("vector") > 0).where(sound)
    # -0.0 and 0.0 are one number: adding 0.0 makes them the same.
    rows = rows.withColumn("vector", F.transform("vector", lambda e: e + F.lit(0.0)))
    rows = rows.withColumn("key", F.unhex(F.md5(F.array_join(F.transform("vector", lambda e: e.cast("string")), ","))))
    return rows.groupBy("vec_id").agg(F.min("key").alias("key"), F.min_by("vector", "key").alias("vector"))


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """(key, dim, vector, ids): distinct vectors with their k+1 smallest vec_ids.

    The rank filter is applied before rows are shuffled as well, so a vector that very many
    rows share sends k+1 of them from each task."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vector"))


def build_index(found: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard, staged: shard, dim, n, keys, vectors, near (layers' arrays), levels, entry."""
    dims = found.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("long"))
    dealt = found.join(F.broadcast(dims.select("dim", "shards")), "dim")  # a row for each vector length
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        g = Graph(np.stack(pdf["vector"].to_numpy()).astype(np.float64)).build()
        return pd.DataFrame({"shard": [int(pdf["shard"][0])], "dim": [int(pdf["dim"][0])], "n": [len(pdf)], "keys": [pdf["key"].tolist()], "vectors": [g.x.astype("<f8").tobytes()], "near": [[x.astype("<i4").tobytes() for x in g.near]], "levels": [g.levels.astype("<i4").tobytes()], "entry": [g.entry]})

    # A task for each shard: adaptive execution would put small ones together, one after another.
    shards = dims.agg(F.sum("shards")).first()[0] or 1
    dealt = dealt.select("shard", "dim", "key", "vector").repartition(int(shards), "dim", "shard")
    return stage(dealt.groupBy("dim", "shard").applyInPandas(build, "shard long, dim int, n long, keys array<binary>, vectors binary, near array<binary>, levels binary, entry long"), "hnsw-index")


def _restored(row: dict) -> Graph:
    g = Graph.__new__(Graph)
    n = row["n"]
    g.links = LINKS
    g.x = np.frombuffer(row["vectors"], "<f8").reshape(n, -1)
    g.near = [np.frombuffer(x, "<i4").reshape(n, -1) for x in row["near"]]
    g.levels, g.entry = np.frombuffer(row["levels"], "<i4"), row["entry"]
    return g


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_key, key, score) for queries (key, vector, dim): the best k+1 nodes of each shard.

    A task reads a shard's row, then streams query blocks through it; blocks are sent to
    every shard of their vector length."""
    shards = index.select("dim", "shard")
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(1 << 20)))
    asked = blocks.join(F.broadcast(shards), "dim")  # a row for each shard of thousands of nodes
    empty = {"n": "long", "keys": "array<binary>", "vectors": "binary", "near": "array<binary>", "levels": "binary", "entry": "long"}
    asked = asked.select("dim", "shard", F.lit(1).alias("kind"), F.col("key").alias("query_key"), "vector", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    held = index.select("dim", "shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("query_key"), F.lit(None).cast("array<double>").alias("vector"), *empty)
    dealt = held.unionByName(asked).repartition(max(1, index.count()), "dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, keys, wait = None, [], []

        def answer():
            q = np.array([v for _, v in wait], np.float64)
            got = graph.search(q, k + 1, beam)
            r, c = np.nonzero(got >= 0)
            node = got[r, c]
            score = np.einsum("ij,ij->i", q[r], graph.x[node, :-1])
            return pa.RecordBatch.from_arrays([pa.array([wait[i][0] for i in r], pa.binary()), pa.array([keys[i] for i in node], pa.binary()), pa.array(score)], names=["query_key", "key", "score"])

        for b in batches:
            for i in range(b.num_rows):
                if b.column("kind")[i].as_py() == 0:
                    if wait:
                        yield answer()
                    row = b.slice(i, 1).to_pylist()[0]
                    graph, keys, wait = _restored(row), row["keys"], []
                else:
                    wait.append((b.column("query_key")[i].as_py(), b.column("vector")[i].values.to_numpy(zero_copy_only=False)))
                    if len(wait) == BLOCK:
                        yield answer()
                        wait = []
        if wait:
            yield answer()

    return dealt.mapInArrow(run, "query_key binary, key binary, score double")


def nearest(vectors: DataFrame, is_query, k: int = 20, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose vec_id is_query
    holds for."""
    rows = stage(usable_rows(vectors), "hnsw-rows")
    found = stage(nodes(rows, k), "hnsw-nodes")
    index = build_index(found, shard_rows)
    wanted = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"))
    asked = found.join(wanted.select(F.col("query_key").alias("key")).distinct(), "key", "left_semi")
    best = search(index, asked.select("key", "vector", "dim"), k, beam)
    top = Window.partitionBy("query_key").orderBy(F.col("score").desc(), "key")
    best = stage(best.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1).drop("place"), "hnsw-best")
    pairs = wanted.join(best, "query_key").join(found.select("key", "ids"), "key")
    rows = pairs.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
