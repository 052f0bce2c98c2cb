"""Packing along a space-filling curve.

Every document becomes token ids.  Its hashed token vector is projected to a few
dimensions, the cell's Hilbert index is its place on the curve, and documents are
packed in curve order into sequences of fixed length, so neighbours in a sequence
are alike.  The token stream is cut at every multiple of the length: only the last
sequence is short.

Defined results: null text is empty (its end id alone is packed); equal keys are
ordered by doc_id, then by row; repeated rows are packed each; an empty table gives
no piece; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import running_offsets, slices, stage, table, text_or_empty

HASHED, DIMS, BITS = 256, 4, 12


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer cells (rows x dims), by Skilling's transpose algorithm."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, DIMS))


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Place on the curve of each id sequence; empty ones lie at the middle cell."""
    size = np.array([len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    mixed = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    slot = (mixed >> np.uint64(40)).astype(np.int64) % HASHED
    sign = np.where((mixed >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
    row = np.repeat(np.arange(len(ids)), size)
    vec = np.bincount(row * HASHED + slot, weights=sign, minlength=len(ids) * HASHED).reshape(len(ids), HASHED)
    vec = np.sign(vec) * np.log1p(np.abs(vec))
    norm = np.linalg.norm(vec, axis=1, keepdims=True)
    z = (vec / np.where(norm == 0, 1, norm)) @ _projection()
    unit = 1 / (1 + np.exp(-1.702 * z))
    return hilbert_index(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(row, doc_id, n, curve, ids): ids little-endian in the tokenizer's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.load(tokenizer)
        for b in slices(batches, "text"):
            ids = [np.append(x, t.dtype.type(end_id)) for x in t.encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(curve_keys(ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([t.dtype.itemsize] * len(ids), pa.int32())],
                names=["row", "doc_id", "n", "curve", "ids", "width"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, curve long, ids binary, width int")


def pack(docs: DataFrame, tokenizer: str = tokens.WORD_BPE, end_id: int = 1, length: int = 2048, emit: str = "ids") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, curve, and
    the piece's ids (emit="ids": array<long>) or their crc32 (emit="crc": ids_crc32).

    Ids are tokenized once and staged; offsets come from narrow columns alone, so the ids
    are shuffled once, by row.
    """
    staged = stage(tokenized(docs, tokenizer, end_id), "pack-ids")
    narrow = staged.select("row", "doc_id", "n", "curve")
    places = running_offsets(narrow, ["curve", "doc_id", "row"], "n", label="pack-order").select("row", "before")
    joined = staged.join(places, "row").select("doc_id", "n", "curve", "ids", "width", "before")
    what = "ids array<long>" if emit == "ids" else "ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids", 8_000_000):
            cols = {c: [] for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "curve", "what")}
            for doc_id, n, curve, raw, width, before in zip(*(b.column(i).to_pylist() for i in range(6))):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                at = 0
                while at < n:
                    seq, off = divmod(before + at, length)
                    take = min(length - off, n - at)
                    part = ids[at : at + take]
                    got = part.astype(np.int64) if emit == "ids" else zlib.crc32(part.tobytes())
                    for c, v in zip(cols, (doc_id, at, take, n, seq, off, curve, got)):
                        cols[c].append(v)
                    at += take
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64()) if emit == "ids" else pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds)], names=[*list(cols)[:-1], what.split()[0]])

    return joined.mapInArrow(cut, f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, curve long, {what}")


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), emit="crc")
