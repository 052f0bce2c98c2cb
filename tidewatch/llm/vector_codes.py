"""Product codes of vectors, by Lloyd's rounds that rescan only what may have changed.

Vectors are whole numbers, cut into consecutive parts; each part's place has a codebook.  A part
keeps its entry and one number: the distance to its second-nearest entry less that to its own (the
lower bound less the upper one).  When entries move, that slack shrinks by at most its own entry's
drift and the largest other drift, so it is kept in a heap of its entry under slack plus the
entry's cumulative drift at that time, and only the parts at the top whose number is no more than
the cumulative drift now are taken out, compared with all entries in whole numbers, and put back.

Rows are packed into blocks, which hold their vectors, entries and heaps as flat arrays and pass
from round to round as tables in the shared folder.  A round's sums come from the changes alone:
each task adds those of its blocks, and the driver gets one row for each number of a codebook.

Defined results: vectors that are null or hold null or non-finite components are left out; the
length is that of the first kept row by (vec_id, null ones last, then components), and vectors of
another length are left out; a length that the number of parts doesn't divide is cut at
p * length // parts; a component's floor(256 x) is cut to 2^24 in size; rows of equal or null
vec_id are coded each; fewer rows than entries give a smaller codebook; an empty table gives no
row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, table

ENTRIES, PARTS, ROUNDS, SCALE, LARGEST, BLOCK_BYTES = 64, 16, 2, 256, 1 << 24, 1 << 20
MARGIN = 1e-6  # distances are rounded; a part so close to its limit is rescanned

Codebook = list[np.ndarray]  # for each part's place, (entries, width) whole numbers


def whole(column: str = "embedding") -> Column:
    """Components as whole numbers, cut to LARGEST in size."""
    number = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    return F.transform(column, lambda x: number(x).cast("int"))


def usable(column: str = "embedding") -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(column).isNotNull() & F.forall(column, lambda x: fine(x.cast("double")))


def cuts(length: int, parts: int = PARTS) -> list[slice]:
    return [slice(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries)."""
    d = x[:, None, :] - entries[None, :, :]
    return np.einsum("nkw,nkw->nk", d, d)


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, the lower of equal ones; distance to the second less that to it)."""
    own, slack = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), 1024):
        d = _squares(x[lo : lo + 1024], entries)
        at = d.argmin(axis=1)
        rows = np.arange(len(d))
        least = np.sqrt(d[rows, at].astype(float))
        d[rows, at] = np.iinfo(np.int64).max
        own[lo : lo + 1024], slack[lo : lo + 1024] = at, np.sqrt(d.min(axis=1).astype(float)) - least
    return own, slack


class Block:
    """Vectors x (n, length), own (parts, n) and heaps[part][entry] of (slack + drift, row);
    `change` holds sums and counts to add for each part's place: (entries, width + 1)."""

    def __init__(self, x: np.ndarray, parts: int):
        self.x, self.cuts, self.rescanned = x.astype(np.int64), cuts(x.shape[1], parts), 0

    def first(self, book: Codebook) -> "Block":
        self.own, self.heaps, self.change = np.empty((len(book), len(self.x)), np.int64), [], []
        for p, (cut, entries) in enumerate(zip(self.cuts, book)):
            part = self.x[:, cut]
            self.own[p], slack = _nearest(part, entries)
            order = np.lexsort((slack, self.own[p]))  # a sorted list is a heap
            pairs = list(zip(slack[order].tolist(), order.tolist()))
            ends = np.searchsorted(self.own[p][order], np.arange(len(entries) + 1)).tolist()
            self.heaps.append([pairs[a:b] for a, b in zip(ends, ends[1:])])
            change = np.zeros((len(entries), part.shape[1] + 1), np.int64)
            np.add.at(change, self.own[p], np.column_stack([part, np.ones(len(part), np.int64)]))
            self.change.append(change)
        return self

    def again(self, book: Codebook, drift: np.ndarray) -> "Block":
        """Rescan what entries that moved by `drift` (parts, entries; cumulative) may have lost."""
        self.change = []
        for p, (cut, entries) in enumerate(zip(self.cuts, book)):
            rows: list[int] = []
            for heap, moved in zip(self.heaps[p], (drift[p] + MARGIN).tolist()):
                while heap and heap[0][0] <= moved:
                    rows.append(heappop(heap)[1])
            change = np.zeros((len(entries), self.x[:, cut].shape[1] + 1), np.int64)
            if rows:
                at = np.array(rows)
                part = np.column_stack([self.x[at, cut], np.ones(len(at), np.int64)])
                own, slack = _nearest(part[:, :-1], entries)
                for e, key, row in zip(own.tolist(), (slack + drift[p][own]).tolist(), rows):
                    heappush(self.heaps[p][e], (key, row))
                left = own != self.own[p][at]
                np.add.at(change, own[left], part[left])
                np.subtract.at(change, self.own[p][at[left]], part[left])
                self.own[p][at] = own
                self.rescanned += len(rows)
            self.change.append(change)
        return self

    def errors(self, book: Codebook) -> np.ndarray:
        d = np.concatenate([entries[own] - self.x[:, cut] for cut, entries, own in zip(self.cuts, book, self.own)], axis=1)
        return (d * d).sum(axis=1)

    def packed(self) -> dict[str, bytes | int]:
        flat = [pair for heaps in self.heaps for heap in heaps for pair in heap]
        sizes = [[len(heap) for heap in heaps] for heaps in self.heaps]
        return {
            "n": len(self.x),
            "x": self.x.astype(np.int32).tobytes(),
            "own": self.own.astype(np.uint8).tobytes(),
            "keys": np.array([k for k, _ in flat]).tobytes(),
            "rows": np.array([r for _, r in flat], np.int32).tobytes(),
            "sizes": np.array(sizes, np.int32).tobytes(),
            "change": np.concatenate([c.ravel() for c in self.change]).tobytes(),
            "rescanned": self.rescanned,
        }

    @classmethod
    def unpacked(cls, row: dict, parts: int, heaps: bool = True) -> "Block":
        found = cls(np.frombuffer(row["x"], np.int32).reshape(row["n"], -1), parts)
        found.own = np.frombuffer(row["own"], np.uint8).astype(np.int64).reshape(parts, row["n"])
        found.rescanned = row["rescanned"]
        if heaps:
            pairs = list(zip(np.frombuffer(row["keys"]).tolist(), np.frombuffer(row["rows"], np.int32).tolist()))
            sizes = np.frombuffer(row["sizes"], np.int32).reshape(parts, -1)
            ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            lists = [pairs[a:b] for a, b in zip(ends, ends[1:])]
            found.heaps = [lists[p * sizes.shape[1] : (p + 1) * sizes.shape[1]] for p in range(parts)]
        return found


_STATE = "n int, x binary, own binary, keys binary, rows binary, sizes binary, change binary, rescanned long"


def _state(block: Block, carried: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    own = block.packed()
    kinds = [pa.int32()] + [pa.binary()] * 6 + [pa.int64()]
    columns = [pa.array([v], k) for v, k in zip(own.values(), kinds)]
    return pa.RecordBatch.from_arrays([*carried, *columns], names=[*names, *own])


def _totals(blocks: DataFrame) -> np.ndarray:
    """All blocks' changes together: added in each task, then by place in the codebook."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0).to_pylist():
                one = np.frombuffer(v, np.int64)
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["change"])

    each = blocks.select("change").mapInArrow(add, "change array<long>").select(F.posexplode("change").alias("at", "x"))
    rows = each.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()  # a codebook's numbers
    return np.array([r.x for r in rows], np.int64)


def _moved(book: Codebook, totals: np.ndarray) -> tuple[Codebook, np.ndarray]:
    """The next codebook, and by how much each entry's slacks may have shrunk (parts, entries)."""
    new, drift, at = [], [], 0
    for entries in book:
        k, w = entries.shape
        part = totals[at : at + k * (w + 1)].reshape(k, w + 1)
        at += k * (w + 1)
        used = part[:, -1] > 0
        mean = entries.copy()
        mean[used] = part[used, :-1] // part[used, -1:]  # rounds down
        step = np.sqrt(((mean - entries) ** 2).sum(axis=1).astype(float))
        first = step.argmax()
        other = np.full(k, step[first])
        other[first] = np.delete(step, first).max() if k > 1 else 0.0
        new.append(mean)
        drift.append(step + other)
    return new, np.array(drift)


def compressed(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", carry: tuple[str, ...] = (), entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, Codebook]:
    """(key, carried columns, code, error, rescanned of its block) of every kept row, and the
    codebooks.  Entries start as the parts of the first rows by key; at most 256 of them."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    names = [key, *carry]
    rows = stage(vectors.where(usable(column)).select(*names, whole(column).alias("_x")), "vector-codes-rows")
    order = [F.col(key).asc_nulls_last(), F.col("_x").asc()]
    first = rows.orderBy(*order).limit(1).collect()
    length = len(first[0]["_x"]) if first else 0
    same = rows.where(F.size("_x") == length)
    found = [r["_x"] for r in same.orderBy(*order).limit(entries).collect()]
    seeds = np.array(found, np.int64).reshape(len(found), length)
    book: Codebook = [seeds[:, cut] for cut in cuts(length, parts)]
    types = {f.name: f.dataType for f in rows.schema.fields}
    plain = T.StructType([T.StructField(c, types[c]) for c in names])
    lists = T.StructType([T.StructField(f"_k{i}", T.ArrayType(types[c])) for i, c in enumerate(names)] + T._parse_datatype_string(_STATE).fields)
    keys = [f"_k{i}" for i in range(len(names))]
    step = max(1, BLOCK_BYTES // max(1, 4 * length))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                x = part.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, length)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield _state(Block(x, parts).first(book), [pa.ListArray.from_arrays(ends, part.column(i)) for i in range(len(names))], keys)

    blocks = stage(same.select(*names, "_x").mapInArrow(pack, lists), "vector-codes-0")
    drift, totals = np.zeros((parts, len(seeds))), 0
    for r in range(rounds if len(seeds) else 0):
        totals = totals + _totals(blocks)
        new, moved = _moved(book, totals)
        book, drift = new, drift + moved

        def rescan(batches: Iterator[pa.RecordBatch], book: Codebook = book, drift: np.ndarray = drift) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1)
                    state = {n: row.column(j + len(keys))[0].as_py() for j, n in enumerate(b.schema.names[len(keys) :])}
                    yield _state(Block.unpacked(state, parts).again(book, drift), [row.column(j) for j in range(len(keys))], keys)

        blocks = stage(blocks.mapInArrow(rescan, lists), f"vector-codes-{r + 1}")
    last = book

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(b.schema.names.index(n))[i].as_py() for n in ("n", "x", "own", "rescanned")}
                block = Block.unpacked(row, parts, heaps=False)
                code = [bytes(c).hex() for c in block.own.T.astype(np.uint8)]
                carried = [b.column(j).slice(i, 1).flatten() for j in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*carried, pa.array(code), pa.array(block.errors(last)), pa.array([row["rescanned"]] * row["n"], pa.int64())], names=[*names, "code", "error", "rescanned"])

    schema = T.StructType([*plain.fields, *T._parse_datatype_string("code string, error long, rescanned long").fields])
    return blocks.select(*keys, "n", "x", "own", "rescanned").mapInArrow(decode, schema), book


def digest(book: Codebook) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for entries in book for x in entries.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, book = compressed(table(spark, sf_dir, "embeddings"), carry=("label",))
    found = stage(found, "vector-codes")
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = found.alias("a").join(sums.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def _round_sql(r: int) -> str:
    return f"""
d{r} AS (SELECT v.i, v.p, e.e, list_sum(list_transform(list_zip(v.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d, v.x
         FROM pv v JOIN b{r} e USING (p)),
a{r} AS (SELECT i, p, arg_min(e, d * 64 + e) AS e, min(d) AS d, any_value(x) AS x FROM d{r} GROUP BY i, p)"""


def _move_sql(r: int) -> str:
    return f"""
s{r} AS (SELECT p, e, j, sum(x[j]) AS s, count(*) AS c FROM a{r}, range(1, 5) t(j) GROUP BY p, e, j),
m{r} AS (SELECT p, e, list(CAST((s - (((s % c) + c) % c)) // c AS BIGINT) ORDER BY j) AS x FROM s{r} GROUP BY p, e),
b{r + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, e))"""


OP11_SQL = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pv AS (SELECT i, p, v[p * 4 + 1 : p * 4 + 4] AS x FROM k, range(16) t(p)),
b0 AS (SELECT p, i - 1 AS e, x FROM pv WHERE i <= 64),{_round_sql(0)},{_move_sql(0)},{_round_sql(1)},{_move_sql(1)},{_round_sql(2)},
c AS (SELECT i, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY i),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM k JOIN c USING (i) CROSS JOIN h
"""
