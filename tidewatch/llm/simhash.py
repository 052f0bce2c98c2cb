"""SimHash near-duplicates by anchor-point covering.

A fingerprint's two halves (31 of 32 bits each) are covered by the codewords of the
[31,26] Hamming code: every 31-bit word lies within covering radius 1 of an anchor.  Two
fingerprints that differ in at most t bits differ in at most t/2 bits in one half, so one's
nearest anchor there lies within radius + t/2 of the other.  Each fingerprint is replicated
to every anchor within that distance (16 in a half for t = 2 or 3, 1 if it is an anchor
itself), and compared with the others at the anchor.  Only distinct fingerprints are
replicated, so exact copies never meet; links within an anchor are reduced to a spanning
forest before they leave the task.

At an anchor, up to SMALL fingerprints are compared pair by pair; more are compared through
their one-bit neighbours (two within 2 bits share one), which is linear in their number.  An
anchor of over LARGE fingerprints, more than a task should hold, is compared in the same way
by a join on one-bit neighbours, dealt over all tasks.  The links are the same all three ways.

Defined results: null or wordless text has fingerprint zero and is linked like any other;
rows of null doc_id are fingerprinted and take their component's smallest doc_id (null if
it has none); repeated rows appear each; an empty table gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, slices, stage, table, text_or_empty

SHINGLE, SEED, BITS = 3, 42, 2
SMALL, LARGE = 48, 20_000
_BIT = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of UTF-8 text as an unsigned 64-bit number: a bit is set if over half of the
    shingles' XXH64 have it.  bytes.lower() changes A-Z only, and bytes.split() cuts at
    exactly 0x20 and 0x09-0x0D."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)
    bytes_ = h.view(np.uint8).reshape(n, 8)
    if n < 64:
        ones = np.unpackbits(bytes_, axis=1, bitorder="little").sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(bytes_[:, k], minlength=256) @ _BIT for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """(row, doc_id, fp) with fp as a signed long; rows are numbered anew unless `row` numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(t.encode(), shingle, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(fp.view(np.int64))], names=["row", "doc_id", "fp"])

    number = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(number.alias("row"), F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, fp long")


def _syndromes() -> tuple[np.ndarray, list[np.ndarray]]:
    """Per byte place, the XOR of the (1-based) bit places set; per radius-2 syndrome, the
    changes of up to two bits that lead to a codeword."""
    place = np.zeros((4, 256), np.int64)
    for k in range(4):
        for b in range(8):
            if 8 * k + b < 31:
                place[k] ^= np.where((np.arange(256) >> b) & 1, 8 * k + b + 1, 0)
    changes = []
    for s in range(32):
        found = [0] if s == 0 else [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if 0 < (i ^ s) and i < (i ^ s)]
        changes.append(np.array(found, np.int64))
    return place, changes


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index into fp): all anchors of both halves within distance 2."""
    place, changes = _syndromes()
    out_a, out_i = [], []
    for half in (0, 1):
        x = ((fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        s = place[0][x & 255] ^ place[1][(x >> 8) & 255] ^ place[2][(x >> 16) & 255] ^ place[3][x >> 24]
        for k in range(32):
            at = np.flatnonzero(s == k)
            near = x[at][:, None] ^ changes[k][None, :]
            out_a.append((near | (half << 31)).ravel())
            out_i.append(np.repeat(at, len(changes[k])))
    return np.concatenate(out_a), np.concatenate(out_i)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between fingerprints: (member, root)."""
    if not len(a):
        return a, b
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[at], nodes[root[at]]


def _within(group: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links at `bits` or fewer between fingerprints of equal group (sorted by group): every
    pair of small groups, shared one-bit neighbours in large ones, so never m*m work."""
    first = np.concatenate([[True], group[1:] != group[:-1]])
    start = np.flatnonzero(first)
    size = np.diff(np.concatenate([start, [len(group)]]))
    a, b = [], []
    small = np.repeat(size <= SMALL, size)
    for lag in range(1, int(min(SMALL, size.max()))):
        at = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
        near = np.bitwise_count(fp[at] ^ fp[at + lag]) <= bits
        a.append(fp[at[near]])
        b.append(fp[at[near] + lag])
    masks = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for lo, n in zip(start[size > SMALL], size[size > SMALL]):
        own = fp[lo : lo + n]
        keys = (own[:, None] ^ masks[None, :]).ravel()
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        a.append(own[order[:-1][same] // 65])
        b.append(own[order[1:][same] // 65])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    return _forest(a, b)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints `fp` (distinct longs) linked at `bits` or fewer.

    An anchor with over LARGE distinct fingerprints is not held in one task: its members take
    the relational way, where two within 2 bits share a key one bit or none from both."""
    if bits != 2:
        raise ValueError("anchors are laid out for links at 2 bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(lo, 20_000).to_numpy().view(np.uint64)
                anchor, at = anchors(fp)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[at].view(np.int64))], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, hot):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

        held_g, held_f, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            g = np.concatenate([held_g, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            if large is not None:  # the rest of an anchor already found too large
                cut = int(np.searchsorted(g, large, side="right"))
                if cut:
                    yield out(f[:cut], f[:cut], True)
                g, f = g[cut:], f[cut:]
                if not len(g):
                    held_g, held_f = g, f
                    continue
                large = None
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1], side="left"))
            if cut:
                yield out(*_within(g[:cut], f[:cut], bits), False)
            held_g, held_f = g[cut:], f[cut:]
            if len(held_g) > LARGE:
                large = held_g[0]
                yield out(held_f, held_f, True)
                held_g, held_f = held_g[:0], held_f[:0]
        if len(held_g):
            yield out(*_within(held_g, held_f, bits), False)

    dealt = distinct.select("fp").mapInArrow(spread, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = stage(dealt.mapInArrow(compare, "a long, b long, hot boolean"), "simhash-links")
    edges = found.where("not hot").select("a", "b").distinct()
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
    shared = hot.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("key"))
    least = shared.groupBy("key").agg(F.min("fp").alias("b"))
    more = shared.join(least, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return edges.unionByName(more)


def fingerprint_roots(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, first, root) of each distinct fingerprint: its least doc_id, and the least fingerprint
    that links at `bits` or fewer reach."""
    least = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    linked = components(links(least, bits), "simhash")
    roots = least.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return stage(roots, "simhash-roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """(row, doc_id, fp, component_id) for every row of docs."""
    fps = stage(fingerprints(docs, shingle, seed), "simhash-fps")
    roots = fingerprint_roots(fps, bits)
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(roots.join(smallest, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(classes, "fp")


WIDE_SHINGLE, BITMAP, LEAST = 5, 4, 0.8
BLOCK, BLOCK_BYTES = 1_000, 32 << 20
PART = 1_000_000
HOT_SHARE, HOT_MOST = 64, 1 << 20
FOUR = ["f0", "f1", "f2", "f3"]
PREFIX = "token long, node long, size long, place long, f0 long, f1 long, f2 long, f3 long"


def shingle_set(raw: bytes, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct shingles' XXH3-64 in ascending order; that of the whole text if it has fewer
    words, none if it has none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())), np.uint64, n))


def set_node(h: np.ndarray) -> int:
    """A shingle set's number, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def parity_bitmap(h: np.ndarray) -> np.ndarray:
    """256 bits, as four unsigned longs, each flipped by the shingles of its slot: two sets'
    bitmaps differ in no more bits than the sets differ in shingles."""
    odd = np.bincount((h >> np.uint64(17)).astype(np.int64) & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _may_reach(least: float, n1: np.ndarray, n2: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False only where sets of sizes n1, n2 whose bitmaps differ in `bits` are below Jaccard `least`."""
    total = n1 + n2
    return (np.minimum(n1, n2) * (1 + least) >= least * total - 1e-6) & (bits * (1 + least) <= (1 - least) * total + 1e-6)


def _dealt_pairs(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """df with `i`, `j`: members of a group of over one block are dealt to blocks by node, and
    repeated so that any two of them share one (key, i, j)."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col(blocks))
    others = F.expr(f"CASE WHEN {blocks} = 1 THEN array(0L) ELSE filter(sequence(0L, {blocks} - 1), x -> x <> _own) END")
    out = df.withColumn("_own", own).withColumn("_other", F.explode(others))
    return out.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).drop("_own", "_other", blocks)


def _confirmed(node: np.ndarray, f: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs with Jaccard `least` or more: pairs that sizes and bitmaps
    allow, nearest first, are counted exactly unless a forest already joins them."""
    size = np.array([len(s) for s in sets], np.int64)
    n, far = len(node), []
    for lo in range(0, n, 256):
        part = f[lo : lo + 256, None, :] ^ f[None, lo:, :]
        bits = np.bitwise_count(part).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero(_may_reach(least, size[lo : lo + 256, None], size[None, lo:], bits))
        d = bits[i, j]
        i, j = i + lo, j + lo
        keep = i < j
        far.append(np.stack([d[keep], i[keep], j[keep]]).astype(np.int32))
    pairs = np.concatenate(far, axis=1)
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    a, b = [], []
    for i, j in zip(pairs[1].tolist(), pairs[2].tolist()):
        x, y = find(i), find(j)
        if x == y:
            continue
        both = np.concatenate([sets[i], sets[j]])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        if common * (1 + least) >= least * len(both) - 1e-9:
            top[max(x, y)] = min(x, y)
            a.append(int(node[i]))
            b.append(int(node[j]))
    return a, b


def _grouped(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each number in `part`, with the columns' values of it as bytes."""
    order = np.argsort(part, kind="stable")
    own, start = np.unique(part[order], return_index=True)
    cut = [*start.tolist(), len(part)]
    cells = [[c[order[a:b]].tobytes() for a, b in zip(cut, cut[1:])] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *[pa.array(c, pa.binary()) for c in cells]], names=names)


def _joined(group: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(column).to_pylist()), np.int64)


def frequent(rows: DataFrame) -> np.ndarray:
    """The shingles, ascending, that about PART rows or more have, judged by a hashed 1/HOT_SHARE
    of the rows; at most the HOT_MOST most frequent.  This only decides which way a shingle is
    counted (see prefixes): either way the count is exact and of all rows."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8_000_000):
            token, number = np.unique(np.concatenate([shingle_set(t.encode()) for t in b.column("text").to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(number.astype(np.int64))], names=["token", "number"])

    part = rows.where(F.pmod(F.xxhash64("row"), F.lit(HOT_SHARE)) == 0).select("text")
    counts = part.mapInArrow(tokens, "token long, number long").groupBy("token").agg(F.sum("number").alias("number"))
    top = counts.where(F.col("number") >= max(1, PART // HOT_SHARE)).orderBy(F.desc("number"), "token").limit(HOT_MOST)
    return np.sort(top.toArrow().column("token").to_numpy().astype(np.int64).view(np.uint64))


def prefixes(rows: DataFrame, distinct: DataFrame, least: float, hot: np.ndarray) -> DataFrame:
    """(token, node, size, place, f0..f3): the shingles of each set that another set has too and
    that lie among its first size - ceil(least * size) + 1, rarest first (then by hash).

    Sets of Jaccard `least` or more share one of these, as each has ceil(least * size) of its
    shingles in common with the other and all sets are put in the same order.  Shingles are
    dealt by hash in parts of about PART, counted there, and those of two sets or more dealt by
    node; both ways as bytes, a row for a part.  Those of `hot` are not dealt: a set carries
    them with it (column `hot` of distinct), they are counted by a grouping that adds up before
    it shuffles, and their counts, HOT_MOST at most, go to every task."""
    parts = 1 + int(distinct.agg(F.sum("size")).first()[0] or 0) // PART
    totals = distinct.select(F.explode("hot").alias("token")).groupBy("token").agg(F.count("*").alias("number"))
    totals = totals.orderBy("token").toArrow() if len(hot) else pa.table({"token": pa.array([], pa.int64()), "number": pa.array([], pa.int64())})
    hot_token, hot_number = (totals.column(c).to_numpy() for c in ("token", "number"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8_000_000):
            found = {}
            for t in b.column("text").to_pylist():
                h = shingle_set(t.encode())
                found[set_node(h)] = h[~np.isin(h, hot)] if len(hot) else h
            token = np.concatenate(list(found.values()))
            node = np.repeat(np.array(list(found), np.int64), [len(h) for h in found.values()])
            yield _grouped((token % np.uint64(parts)).astype(np.int64), [token.view(np.int64), node], ["part", "token", "node"])

    def count(group: pa.Table) -> pa.Table:
        token, node = _joined(group, "token"), _joined(group, "node")
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        once = np.ones(len(token), bool)  # a set that several rows have counts once
        once[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node = token[once], node[once]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(token)), bool), token[1:] != token[:-1]]))
        number = np.diff(np.concatenate([start, [len(token)]]))
        number = np.repeat(number, number)
        at = np.flatnonzero(number > 1)
        return pa.Table.from_batches([_grouped(node[at] % parts, [token[at], node[at], number[at]], ["bucket", "token", "node", "number"])])

    def choose(known: pa.Table, shared: pa.Table) -> pa.Table:
        ids = known.column("node").to_numpy()
        carried = pc.list_flatten(known.column("hot")).to_numpy()
        common = hot_number[np.searchsorted(hot_token, carried)]
        of = np.repeat(ids, pc.list_value_length(known.column("hot")).to_numpy())
        extra = [carried[common > 1], of[common > 1], common[common > 1]]
        token, node, number = (np.concatenate([_joined(shared, c), x]) for c, x in zip(("token", "node", "number"), extra))
        order = np.lexsort((token, number, node))
        token, node = token[order], node[order]
        rank = np.argsort(ids)
        at = rank[np.searchsorted(ids, node, sorter=rank)]
        size = known.column("size").to_numpy()[at]
        own, start, many = np.unique(node, return_index=True, return_counts=True)
        # Shingles that no other set has come first.
        place = size - np.repeat(many, many) + np.arange(len(node)) - np.repeat(start, many)
        keep = np.flatnonzero(place <= size - np.ceil(least * size - 1e-9))
        cols = {"token": token[keep], "node": node[keep], "size": size[keep], "place": place[keep]}
        return pa.table(cols | {f: known.column(f).to_numpy()[at[keep]] for f in FOUR})

    dealt = rows.select("text").mapInArrow(deal, "part long, token binary, node binary")
    shared = dealt.groupBy("part").applyInArrow(count, "bucket long, token binary, node binary, number binary")
    known = distinct.select("node", "size", "hot", *FOUR).withColumn("bucket", F.pmod("node", F.lit(parts)))
    return known.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(choose, PREFIX)


def similar_rows(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """row, doc_id, node, top for every row of `rows` (row, doc_id, text; read several times, so
    rows must keep their numbers): rows of one top are linked by Jaccard similarities of `least`
    or more, counted on their sets of five-word shingles.

    Texts of equal shingle sets are one node.  Candidates are complete: nodes that share a
    shingle of both prefixes (see above) and that sizes, places and bitmaps don't rule out by
    proof; a forest of them leaves the task.  Check: inside each tree's nodes, pairs that sizes
    and bitmaps allow are counted exactly.  Shingles of over LARGE prefixes, and trees of over
    BLOCK nodes or BLOCK_BYTES of shingles, are cut into blocks of which any two meet in a task,
    so no task holds a whole group."""
    large, block = LARGE, BLOCK
    hot_shingles = frequent(rows)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets_ = [shingle_set(t.encode()) for t in b.column("text").to_pylist()]
            f = np.stack([parity_bitmap(h) for h in sets_]).view(np.int64)
            node, size = [set_node(h) for h in sets_], [len(h) for h in sets_]
            own = [h[np.isin(h, hot_shingles)].view(np.int64) for h in sets_] if len(hot_shingles) else [[]] * len(sets_)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), *[pa.array(np.ascontiguousarray(f[:, k])) for k in range(BITMAP)], pa.array(own, pa.list_(pa.int64()))],
                names=["row", "doc_id", "node", "size", *FOUR, "hot"],
            )

    fps = stage(rows.select("row", "doc_id", "text").mapInArrow(sketch, "row long, doc_id long, node long, size long, f0 long, f1 long, f2 long, f3 long, hot array<long>"), "similar-fps")
    distinct = stage(fps.groupBy("node", "size", *FOUR, "hot").agg(F.min("row").alias("first")), "similar-distinct")

    def near(i: np.ndarray, j: np.ndarray, size: np.ndarray, place: np.ndarray, f: np.ndarray) -> np.ndarray:
        # At the first shingle that both have, no more than the rest of either can be common.
        rest = np.minimum(size[i] - place[i], size[j] - place[j])
        ok = rest * (1 + least) >= least * (size[i] + size[j]) - 1e-6
        return ok & _may_reach(least, size[i], size[j], np.bitwise_count(f[i] ^ f[j]).sum(axis=-1, dtype=np.int64))

    def crowded(node: np.ndarray, *of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A forest of the links of one large group: some nodes are compared with all others
        first, and then only nodes that no forest joins yet."""
        n, a, b = len(node), [], []
        left = np.ones(n, bool)
        for _ in range(32):
            if not left.any():
                break
            i = int(np.argmax(left))
            j = np.flatnonzero(near(np.array([i]), np.arange(n), *of))
            left[j] = left[i] = False
            a.append(np.full(len(j), node[i]))
            b.append(node[j])
        x, y = _forest(np.concatenate(a), np.concatenate(b))
        a, b, order = [x], [y], np.argsort(x)
        at = np.minimum(np.searchsorted(x[order], node), max(0, len(x) - 1))
        top = np.where(x[order][at] == node, y[order][at], node) if len(x) else node
        lines = max(1, 500_000 // n)  # pairs compared at once
        for base in range(0, n, lines):
            i = np.arange(base, min(base + lines, n))
            j = np.arange(base, n)
            if (top[base:] == top[base]).all():
                break
            r, c = np.nonzero(top[i][:, None] != top[j][None, :])
            ok = near(i[r], j[c], *of)
            x, y = _forest(node[i[r[ok]]], node[j[c[ok]]])
            a.append(x)
            b.append(y)
        return np.concatenate(a), np.concatenate(b)

    def linked(group, node, *of):
        """A spanning forest of the links inside each group of sorted rows."""
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([start, [len(group)]]))
        a, b = [], []
        small = np.repeat(size <= SMALL, size)
        for lag in range(1, int(min(SMALL, size.max()))):
            at = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
            at = at[near(at, at + lag, *of)]
            a.append(node[at])
            b.append(node[at + lag])
        for lo, n in zip(start[size > SMALL], size[size > SMALL]):
            x, y = crowded(node[lo : lo + n], *[c[lo : lo + n] for c in of])
            a.append(x)
            b.append(y)
        return _forest(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)))

    names = ["token", "node", "size", "place", *FOUR]

    def arrays(group: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
        """token, node, size, place, bitmaps"""
        token, node, size, place, *f = (group.column(c).to_numpy() for c in names)
        return [token, node, size, place, np.stack(f, axis=1).view(np.uint64)]

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), pa.int64())] * 7], names=["a", "b", *(c for c in names if c != "node")])

    def hot(cols: list[np.ndarray]) -> pa.RecordBatch:
        token, node, size, place, f = cols
        f = f.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (node, node, token, size, place, *(np.ascontiguousarray(f[:, k]) for k in range(BITMAP)))], names=["a", "b", *(c for c in names if c != "node")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, None
        for batch in batches:
            cols = arrays(batch)
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            if over is not None and len(cols[0]):  # the rest of a shingle already found too large
                cut = int(np.searchsorted(cols[0], over, side="right"))
                if cut:
                    yield hot([x[:cut] for x in cols])
                cols = [x[cut:] for x in cols]
                over = over if not len(cols[0]) else None
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left")) if len(cols[0]) else 0
            if cut:
                yield out(*linked(*[x[:cut] for x in cols]))
            held = [x[cut:] for x in cols]
            if len(held[0]) > large:
                over = held[0][0]
                yield hot(held)
                held = [x[:0] for x in held]
        if held is not None and len(held[0]):
            yield out(*linked(*held))

    dealt = prefixes(rows, distinct, least, hot_shingles).repartition("token").sortWithinPartitions("token", "node")
    found = stage(dealt.mapInArrow(compare, "a long, b long, token long, size long, place long, f0 long, f1 long, f2 long, f3 long"), "similar-found")
    edges = found.where("token is null").select("a", "b")

    def across(group: pa.Table) -> pa.Table:
        _, node, *of = arrays(group)
        a, b = linked(np.zeros(len(node), np.int64), node, *of)
        return pa.table({"a": a, "b": b})

    crowd = found.where("token is not null").drop("b").withColumnRenamed("a", "node")
    crowds = crowd.groupBy("token").agg(F.ceil(F.count("*") / F.lit(max(1, large // 2))).alias("blocks"))
    apart = _dealt_pairs(crowd.join(crowds, "token"), "token", "blocks")
    edges = edges.union(apart.groupBy("token", "i", "j").applyInArrow(across, "a long, b long"))
    trees = components(edges.distinct(), "similar-trees").withColumnRenamed("root", "tree")
    members = stage(distinct.drop("hot").join(trees, "node"), "similar-members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cells = [shingle_set(t.encode()).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(cells, pa.binary())], names=["first", "cells"])

    # One row of each member node is read again.
    again = rows.join(members.select(F.col("first").alias("row")), "row", "left_semi").select("row", "text")
    cells = again.mapInArrow(sets, "first long, cells binary")
    share = members.groupBy("tree").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("size") * 8 / F.lit(BLOCK_BYTES))).alias("blocks"))
    jobs = _dealt_pairs(members.select("node", "first", "tree", *FOUR).join(share, "tree"), "tree", "blocks").join(cells, "first")

    def check(group: pa.Table) -> pa.Table:
        f = np.stack([group.column(c).to_numpy() for c in FOUR], axis=1).view(np.uint64)
        held = [np.frombuffer(c, np.uint64) for c in group.column("cells").to_pylist()]
        a, b = _confirmed(group.column("node").to_numpy(), f, held, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links_ = stage(jobs.groupBy("tree", "i", "j").applyInArrow(check, "a long, b long"), "similar-links")
    roots = components(links_.distinct(), "similar").withColumnRenamed("root", "top")
    tops = distinct.select("node").join(roots, "node", "left").select("node", F.coalesce("top", "node").alias("top"))
    return fps.select("row", "doc_id", "node").join(tops, "node").select("row", "doc_id", "node", "top")


def linked_rows(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(row, doc_id, top) of every row of `rows` (as of similar_rows): rows of one top are linked by
    fingerprints at BITS or fewer differing bits, found by the anchors as in near_duplicates, or by
    an exact similarity of `least` or more, which fingerprints can't promise to find."""
    fps = stage(fingerprints(rows, row=F.col("row")), "simhash-fps")
    found = stage(similar_rows(rows, least).select("row", "doc_id", "top"), "similar-classes")
    near = fps.join(fingerprint_roots(fps).select("fp", "root"), "fp").select("row", "root")
    pairs = stage(found.join(near, "row").select("root", "top").distinct(), "similar-pairs")
    first = pairs.groupBy("root").agg(F.min("top").alias("b"), F.max("top").alias("last")).where("b <> last").select("root", "b")
    edges = pairs.join(first, "root").where("top <> b").select(F.col("top").alias("a"), "b").distinct()
    both = components(edges, "similar-both").withColumnRenamed("node", "top")
    return found.join(both, "top", "left").select("row", "doc_id", F.coalesce("root", "top").alias("top"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number `row`, staged so that rows keep it."""
    return stage(docs.withColumn("row", F.monotonically_increasing_id()), "similar-rows")


def similar_groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, component_id for every row: the groups of similar_rows by smallest doc_id.

    Wordless texts are one node; null doc_ids take their group's smallest doc_id."""
    found = stage(similar_rows(numbered(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))), least), "similar-classes")
    smallest = found.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    return found.join(smallest, "top").select("doc_id", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
