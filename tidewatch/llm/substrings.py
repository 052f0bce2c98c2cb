"""Removal of repeated passages with repeated-phrase automata.

A window is `window` consecutive words of a document.  Every window has a phrase: the
`phrase` consecutive words with the least hash in it, so equal windows have equal phrases.
Phrases are confirmed by their words: one recurs if different texts have just these words.
The words of recurring phrases go to the documents that may hold them; documents are streamed
in slices, and each slice has an Aho-Corasick automaton over word numbers, compiled from the
recurring phrases of all its documents: a shard of the corpus-wide set.  (A phrase that no
document of a slice has can't occur there, so it is the same as to stream every document
through every phrase, without work that grows with documents times phrases.)  The automaton
alone says where phrases occur; a window is a candidate if its own phrase is one of these
occurrences.  Candidates are hashed (95 bits) and matched between documents; one whose words
also start in a document with a smaller doc_id is removed.

Exact copies are settled by digest first: all words of a later copy are removed if it has a
window at all, and it takes no part in the matching.

Defined results: null text has no words; texts shorter than a window lose nothing; equal
texts in rows of equal doc_id are one document; a null doc_id is neither smaller nor larger
than any other; repeated rows appear each; an empty table gives no row; other columns are
kept by `deduplicated` whatever their names, but those named as a column that it adds, which
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import guarded, slices, stage, table, text_or_empty

WINDOW, PHRASE = 50, 10
SLICE = 500_000
_KEPT_POWERS = 1 << 17
_U = np.uint64
_TABLES = np.random.default_rng(2024).integers(0, 1 << 64, size=(2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int, inverse: bool) -> np.ndarray:
    """base**i, or its inverse, for i < n, modulo 2**64."""
    got = _POWERS.get((base, inverse))
    if got is None or len(got) < n:
        got = np.full(max(n, _KEPT_POWERS), pow(base, -1, 1 << 64) if inverse else base, _U)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= _KEPT_POWERS:  # those of longer texts are not kept
            _POWERS[base, inverse] = got
    return got[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _runs(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """A rolling polynomial hash of values[lo:hi] for each pair of bounds."""
    total = np.concatenate([[_U(0)], np.cumsum(values * _powers(base, len(values), False), dtype=_U)])
    return _mix((total[hi] - total[lo]) * _powers(base, len(values) + 1, True)[lo] + (hi - lo).astype(_U))


class Words:
    """The words of a slice of texts: byte bounds and 64-bit hashes, per kind of hash."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        self.raw, self.lo, self.hi = raw, edge[0::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.bounds = np.concatenate([[0], np.searchsorted(self.lo, ends)])  # words of text i: bounds[i]:bounds[i+1]
        self.begin = np.concatenate([[0], ends[:-1]])

    def hashes(self, kind: int) -> np.ndarray:
        return _runs(_TABLES[kind][self.raw], self.lo, self.hi, _BASES[kind])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of `width` values."""
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _grams(h: np.ndarray, size: int, base: int) -> np.ndarray:
    at = np.arange(len(h) - size + 1)
    return _runs(h, at, at + size, base)


def _chosen(g: np.ndarray, width: int) -> np.ndarray:
    """Places of the values that are the least of some run of `width` values, one for each value."""
    low = _least(g, width)
    # A value is some run's least if it is the largest of the least values of the runs it is in.
    wide = np.concatenate([np.zeros(width - 1, _U), low, np.zeros(width - 1, _U)])
    at = np.flatnonzero(~_least(~wide, width) == g)
    return at[np.unique(g[at], return_index=True)[1]]


def phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(phrase, digest, words): the phrases of all windows of every text, by hash and words,
    once for each text of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            texts = [t.encode() for t in b.column("text").to_pylist()]
            words = Words(texts)
            h, met = words.hashes(0), set()
            keys, of, named = [], [], []
            for i, (lo, hi, digest) in enumerate(zip(words.bounds[:-1], words.bounds[1:], b.column("digest").to_pylist())):
                if hi - lo >= window and digest not in met:
                    met.add(digest)
                    g = _grams(h[lo:hi], phrase, _BASES[0])
                    at = _chosen(g, window - phrase + 1)
                    split = texts[i].split()
                    keys.append(g[at])
                    of.append(np.full(len(at), i))
                    named += [b" ".join(split[p : p + phrase]) for p in at.tolist()]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), b.column("digest").take(pa.array(np.concatenate(of))), pa.array(named, pa.binary())], names=["phrase", "digest", "words"])

    return docs.select("digest", "text").mapInArrow(run, "phrase long, digest binary, words binary")


class Shard:
    """An automaton over word numbers that finds phrases (words joined by a blank)."""

    def __init__(self, wanted: set[bytes]):
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p in wanted:
            self.automaton.add_word(tuple([self.number.setdefault(w, len(self.number) + 1) for w in p.split(b" ")]), 1)
        self.automaton.make_automaton()

    def ends(self, words: list[bytes]) -> np.ndarray:
        """Places of the last words of all phrases that occur in a row of words."""
        if not len(self.automaton):
            return np.zeros(0, np.int64)
        get = self.number.get
        return np.fromiter((end for end, _ in self.automaton.iter(tuple([get(w, 0) for w in words]))), np.int64)


def _located(texts: list[bytes], shard: Shard, window: int, phrase: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text, starts and two hashes of the windows whose own phrase the shard finds."""
    words = Words(texts)
    h, h2 = words.hashes(0), words.hashes(1)
    out, none = [], np.zeros(0, np.int64)
    for text, lo, hi in zip(texts, words.bounds[:-1], words.bounds[1:]):
        ends = shard.ends(text.split()) if hi - lo >= window else none
        if not len(ends):
            out.append((none, none, none.astype(np.int64)))
            continue
        g = _grams(h[lo:hi], phrase, _BASES[0])
        found = np.full(len(g), ~_U(0))
        found[ends - phrase + 1] = g[ends - phrase + 1]
        at = np.flatnonzero(_least(found, window - phrase + 1) == _least(g, window - phrase + 1))
        w1 = _runs(h[lo:hi], at, at + window, _BASES[1])
        w2 = _runs(h2[lo:hi], at, at + window, _BASES[0]) >> _U(33)
        out.append((at, w1.view(np.int64), w2.astype(np.int64)))
    return out


def candidate_windows(held: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, digest, at, w1, w2) for documents with text and words of recurring phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            shard = Shard(set().union(*b.column("phrases").to_pylist()))
            found = _located([t.encode() for t in b.column("text").to_pylist()], shard, window, phrase)
            of = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            at, w1, w2 = (np.concatenate([x[k] for x in found]) for k in range(3))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("digest").take(of), pa.array(at.astype(np.int32)), pa.array(w1), pa.array(w2.astype(np.int32))], names=["doc_id", "digest", "at", "w1", "w2"])

    return held.select("doc_id", "digest", "text", "phrases").mapInArrow(run, "doc_id long, digest binary, at int, w1 long, w2 int")


def _cut(text: str, starts: list[int] | None, window: int) -> tuple[int, int, str, str]:
    """(words, removed words, kept words' SHA-256, text without the removed words)."""
    raw = text.encode()
    words = Words([raw])
    n = len(words.lo)
    step = np.zeros(n + 1, np.int64)
    if starts:
        at = np.array(starts)
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
    keep = np.cumsum(step)[:n] == 0
    split = raw.split()
    digest = hashlib.sha256(b" ".join([w for w, k in zip(split, keep.tolist()) if k])).hexdigest()
    if keep.all():
        return n, 0, digest, text
    # Each run of removed words goes with the white space after it.
    gone, at = [], 0
    flips = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
    for a, b in zip(flips[0::2], flips[1::2]):
        gone.append(raw[at : words.lo[a]])
        at = words.lo[b] if b < n else len(raw)
    gone.append(raw[at:])
    return n, int((~keep).sum()), digest, b"".join(gone).decode()


def deduplicated(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with `texts`, the kept text and all other
    columns of docs.  Without, texts are shuffled once, and those with a window to judge again."""
    docs, names = guarded(docs, ("doc_id", "text"))
    others = list(names) if texts else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *others)
    base = base.withColumn("digest", F.unhex(F.md5("text")))
    first = base.groupBy("digest").agg(F.min("doc_id").alias("first"))

    sketch = stage(phrases(base, window, phrase), "passages-sketch")
    recurring = sketch.groupBy("phrase", "words").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi")
    recurring = stage(recurring.select("phrase", "words"), "passages-recurring")
    wanted = sketch.select("phrase", "digest").distinct().join(recurring, "phrase").groupBy("digest").agg(F.collect_list("words").alias("phrases"))
    facts = stage(first.join(wanted, "digest", "left"), "passages-facts")

    # A later copy carries no phrases on; whether it loses its words depends on its length alone.
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    held = base.join(facts, "digest").withColumns({"later": later, "phrases": F.when(F.col("doc_id") == F.col("first"), F.col("phrases"))}).drop("first")

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    extra = "".join(f", `{c}` {kinds[c]}" for c in others)
    own = f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept string{extra}"
    carry = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *others]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Settles what has no window to judge; passes the rest on with its text."""
        for b in slices(batches, "text", SLICE):
            n, gone, digest, kept, todo = [], [], [], [], []
            for text, copy, open_ in zip(b.column("text").to_pylist(), b.column("later").to_pylist(), b.column("phrases").is_valid().to_pylist()):
                todo.append(open_)
                if open_:
                    a = (None, None, None, None)
                elif copy and len(text.encode().split()) >= window:
                    m = len(text.encode().split())
                    a = (m, m, hashlib.sha256(b"").hexdigest(), "")
                else:
                    words = text.encode().split()
                    a = (len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), text)
                for x, v in zip((n, gone, digest, kept), a):
                    x.append(v)
            open_ = pa.array(todo)
            nothing = pa.nulls(len(todo), pa.string())
            text = pc.if_else(open_, b.column("text"), nothing)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string()) if texts else nothing, *[b.column(c) for c in others], b.column("digest"), text, b.column("phrases")], names=[*carry, "digest", "text", "phrases"])

    settled = stage(held.select("doc_id", "digest", "text", "later", "phrases", *others).mapInArrow(settle, f"{own}, digest binary, text string, phrases array<binary>"), "passages-held")
    open_ = settled.where("phrases is not null")
    windows = stage(candidate_windows(open_, window, phrase), "passages-windows")
    repeated = stage(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "passages-repeated")
    spans = windows.join(repeated, ["w1", "w2"]).where("doc_id > least").groupBy("doc_id", "digest").agg(F.collect_set("at").alias("starts"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            done = [_cut(t, s, window) for t, s in zip(b.column("text").to_pylist(), b.column("starts").to_pylist())]
            n, gone, digest, kept = zip(*done)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(kept if texts else [None] * len(n), pa.string()), *[b.column(c) for c in others]], names=carry)

    judged = open_.select("doc_id", "digest", "text", *others).join(spans, ["doc_id", "digest"], "left").select("text", "starts", "doc_id", *others).mapInArrow(remove, own)
    out = settled.where("phrases is null").select(*carry).unionByName(judged)
    if not texts:
        return out.drop("kept")
    added = ["n_words", "n_removed", "kept_sha256"]
    back = [F.col(k).alias(c) for k, c in names.items() if c not in added]
    return out.select("doc_id", *added, F.col("kept").alias("text"), *back)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False)
