"""Log-likelihood of whole texts under a gated recurrent language model, beside a unigram base.

Tokens are a text's words in ASCII lower case, then one end.  Token counts cover all training
rows: counted in tasks, added by word, kept as a table.  The network's vocabulary is the most
frequent words that together number VOCABULARY at most; every other word is written by its last
byte as one of TAILS tail symbols, and has, within that symbol, the share of its count plus a
half.  So each text has a probability, whatever its words.

Network: an embedding, one GRU layer, and a softmax in two factors: the symbol's class, then the
symbol in its class (tail symbols are classes of their own).  Classes hold words of like
frequency.  State starts at zero at a text's start and is carried over all windows to its end;
training propagates back over the `window` steps of one window and passes on the state itself.

Training is spread over tasks: `learners` that each go over their own documents from the same
weights; then weights are averaged by tokens, in a tree of joins by chunk, and the next round
starts.  Every training row is learned from, whole, in one of the rounds, which a hash deals out;
its words are looked up once, and the rounds read symbols.

Counts reach the scoring pass two ways: those of the most frequent words (FREQUENT at most, none
over WORD_BYTES bytes) by a broadcast, all others by a join of (word, row) pairs.

Defined results: null text is empty and has one token, its end; a row of null doc_id is hashed as
the empty text, so it is learned from; repeated rows count and are scored each; without training
rows all counts are 0, base_score is 0, and the network gives every symbol of no vocabulary the
same chance; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stage, table, text_or_empty

VOCABULARY, FREQUENT, WORD_BYTES, TAILS = 1 << 12, 1 << 17, 64, 32
EMBED, HIDDEN, CLASSES = 12, 16, 48
ROUNDS, STREAMS, WINDOW, RATE, WARM = 4, 256, 16, 0.015, 64
SLOTS, SPAN, TOKENS = 256, 64, 1 << 22  # of a scoring pass
END = b" "  # no word has a blank
_FLUSH, _CHUNKS, _FAN = 200_000, 8, 32

Weights = dict[str, np.ndarray]


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all texts' words in a row, number of words of each): those of words_of, cut by Arrow."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, size = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # blanks at an end leave an empty word
    if not full.all():
        size = np.bincount(np.repeat(np.arange(len(size)), size)[full], minlength=len(size))
        flat = flat.filter(pa.array(full))
    return flat, size


def last_bytes(words: pa.Array) -> np.ndarray:
    """The last byte of each word (binary, none empty or null)."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, ends, data = words.buffers()
    return np.frombuffer(data, np.uint8)[np.frombuffer(ends, np.int32)[words.offset + 1 : words.offset + len(words) + 1] - 1].astype(np.int32)


def tail_of(word: bytes) -> int:
    return word[-1] % TAILS


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def token_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c) of all tokens of docs (doc_id, text); a task holds _FLUSH words at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ends, size = [], 0, 0

        def rows() -> pa.RecordBatch:
            words, n = pa.concat_arrays([f.field(0) for f in found]), pa.concat_arrays([f.field(1) for f in found])
            each = pa.table({"word": words, "n": n}).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            return pa.RecordBatch.from_arrays([each["word"].combine_chunks(), each["n_sum"].combine_chunks()], names=["word", "c"])

        for b in slices(batches, "text"):
            found.append(pc.value_counts(words_in(b.column(0))[0]))
            ends, size = ends + b.num_rows, size + len(found[-1])
            if size > _FLUSH:
                yield rows()
                found, size = [], 0
        if ends:
            found.append(pa.StructArray.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["values", "counts"]))
            yield rows()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What all tasks know of the counts: sizes are bounded by FREQUENT and WORD_BYTES."""

    words: dict[bytes, int]  # the most frequent words, most frequent first, with their counts
    tokens: int
    distinct: int
    tail_tokens: np.ndarray  # of each tail symbol, words outside the vocabulary alone
    tail_distinct: np.ndarray
    vocabulary: list[bytes]


def lexicon(counts: DataFrame, vocabulary: int = VOCABULARY, frequent: int = FREQUENT) -> Lexicon:
    """Words of the highest counts: whole levels of equal rounded logarithm, while they fit.  The
    end is of the vocabulary whatever its count."""
    level = F.floor(F.log2("c") * 32).cast("int")  # at most 2048 levels
    known = counts.where((F.length("word") <= WORD_BYTES) & (F.col("word") != F.lit(bytearray(END)))).withColumn("level", level)
    sizes = known.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()

    def least(most: int) -> int:
        total, found = 0, 1 << 30
        for r in sizes:
            total += r.n
            if total > most:
                break
            found = r.level
        return found

    cut = least(vocabulary)
    got = known.where(F.col("level") >= least(frequent)).select("word", "c", (F.col("level") >= cut).alias("own")).toArrow()  # FREQUENT rows at most
    rows = sorted(zip(got["word"].to_pylist(), got["c"].to_pylist(), got["own"].to_pylist()), key=lambda r: (-r[1], r[0]))
    end = counts.where(F.col("word") == F.lit(bytearray(END))).collect()
    ends = end[0].c if end else 0
    inner = (F.length("word") <= WORD_BYTES) & (level >= cut)
    tail = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int") % TAILS
    outer = counts.where(~inner & (F.col("word") != F.lit(bytearray(END)))).groupBy(tail.alias("tail")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, distinct = np.zeros(TAILS), np.zeros(TAILS)
    for r in outer.collect():
        tokens[r.tail], distinct[r.tail] = r.n, r.v
    return Lexicon({END: ends} | {w: c for w, c, _ in rows}, totals[0] or 0, totals[1], tokens, distinct, [END] + [w for w, _, own in rows if own])


class Network:
    """Symbols: 0 begins a text, 1 .. V are the vocabulary, then come the tails."""

    def __init__(self, lex: Lexicon, seed: int = 11):
        self.place = {w: k + 1 for k, w in enumerate(lex.vocabulary)}
        v = len(lex.vocabulary)
        self.symbols = v + 1 + TAILS
        count = np.array([0.5, *(lex.words[w] + 0.5 for w in lex.vocabulary), *(lex.tail_tokens + 0.5)])
        # Words from frequent to rare, cut where the sum of roots passes equal shares; the end alone.
        root = np.cumsum(np.sqrt(count[2 : v + 1]))
        share = np.minimum((root * CLASSES / root[-1]).astype(int), CLASSES - 1) if v > 1 else np.zeros(0, int)
        share = np.unique(share, return_inverse=True)[1] + 1 if v > 1 else share
        own = int(share.max()) + 1 if v > 1 else 1
        self.class_of = np.concatenate([[0, 0], share, own + np.arange(TAILS)]).astype(np.int32)
        self.classes, self.inner = own + TAILS, own
        # Vocabulary symbols lie in order of class: class k's are first[k] : first[k + 1].
        self.first = 1 + np.searchsorted(self.class_of[1 : v + 1], np.arange(own + 1))
        r = np.random.default_rng(seed)
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        mass = np.bincount(self.class_of[1:], count[1:], self.classes)
        self.p: Weights = {
            "embed": f(self.symbols, EMBED, by=0.1),
            "in": f(EMBED, 3 * HIDDEN, by=0.3),
            "bias": np.zeros(3 * HIDDEN, np.float32),
            "state": f(HIDDEN, 3 * HIDDEN, by=0.2),
            # Factors of the output, a class or word a row; the last column is its bias.
            "class": np.column_stack([f(HIDDEN, self.classes, by=0.02).T, np.log(mass / mass.sum())]).astype(np.float32),
            "word": np.column_stack([f(v + 1, HIDDEN, by=0.02), np.log(count[: v + 1])]).astype(np.float32),
        }
        self.lone = np.concatenate([[0], self.first[:-1][np.diff(self.first) == 1]])  # words alone in their class

    def symbols_of(self, words: list[bytes]) -> np.ndarray:
        """Symbols of a text's words and its end."""
        v = self.symbols - TAILS
        get = self.place.get
        return np.array([get(w) or v + w[-1] % TAILS for w in words] + [1], np.int32)

    def symbols_in(self, texts: pa.Array) -> pa.Array:
        """symbols_of each text as binary, two bytes a symbol, found by Arrow."""
        flat, size = words_in(texts)
        place = pc.index_in(flat, pa.array(self.place, pa.binary()))
        far = place.is_null().to_numpy(zero_copy_only=False)
        found = pc.fill_null(place, 0).to_numpy(zero_copy_only=False) + 1
        found[far] = self.symbols - TAILS + last_bytes(flat)[far] % TAILS
        ends = np.cumsum(size + 1)
        out = np.ones(len(flat) + len(size), np.uint16)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = False
        out[inner] = found
        at = np.concatenate([[0], 2 * ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(out)])

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """New state from projected inputs x and state h, and what its gradient needs."""
        a = h @ self.p["state"]
        zr = 0.5 * np.tanh(0.5 * (x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])) + np.float32(0.5)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        return h + z * (c - h), (h, z, r, c, a[:, 2 * HIDDEN :])

    def unroll(self, inputs: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple:
        """(states after each step, last state, and with `keep` what their gradients need) of
        inputs (steps, streams) that start from states h (streams, HIDDEN); an input of 0 begins a
        text, with a state of zero.  Same as step by step; within a step, values lie unit by unit,
        each unit's streams side by side."""
        p, (n, streams) = self.p, inputs.shape
        kind = p["state"].dtype
        half = np.repeat(np.array([0.5, 0.5, 1], kind), HIDDEN)  # a gate is (1 + tanh(a / 2)) / 2
        seen = np.column_stack([p["embed"], np.ones(self.symbols, kind)]).take(inputs, axis=0).transpose(0, 2, 1)
        x = np.matmul((np.vstack([p["in"], p["bias"]]) * half).T, seen)
        turn = np.ascontiguousarray((p["state"] * half).T)
        live = (inputs != 0).astype(kind)
        own = n if keep else 1
        before, c, a = (np.empty((own, HIDDEN, streams), kind) for _ in range(3))
        zr, states = np.empty((own, 2 * HIDDEN, streams), kind), np.empty((n, streams, HIDDEN), kind)
        h = np.ascontiguousarray(h.T, kind)
        for t in range(n):
            i = t if keep else 0
            was, gate, new = before[i], zr[i], c[i]
            np.multiply(h, live[t], out=was)
            y = turn @ was
            np.add(x[t, : 2 * HIDDEN], y[: 2 * HIDDEN], out=gate)
            np.tanh(gate, out=gate)
            gate *= kind.type(0.5)
            gate += kind.type(0.5)
            a[i] = y[2 * HIDDEN :]
            np.multiply(gate[HIDDEN:], a[i], out=new)
            new += x[t, 2 * HIDDEN :]
            np.tanh(new, out=new)
            h = new - was
            h *= gate[:HIDDEN]
            h += was
            states[t] = h.T
        return states, h.T, (seen, live, before, zr, c, a)

    def state_after(self, inputs: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The state after inputs (steps, streams) that start from states h."""
        return self.unroll(inputs, h)[1]

    def large(self) -> bool:
        """May an exponential of the output, or a sum of these, be out of range?"""
        return max(float(np.abs(self.p[k]).sum(axis=1).max()) for k in ("class", "word")) > 60

    def output(self, h: np.ndarray, target: np.ndarray, grads: Weights | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target after state h; with `grads`, those of the mean
        of its negative are put there, and the gradient by h is the second result.

        All is done in order of target, in which each class's rows lie side by side.  No
        exponential is divided by its row's sum: what it is multiplied with is, being narrower."""
        p, n, large = self.p, len(target), self.large()
        order = np.argsort(target.astype(np.uint16), kind="stable")
        target = target.take(order).astype(np.int32)
        kind, first = self.class_of.take(target), self.first
        own = np.empty((n, HIDDEN + 1), np.result_type(h, p["word"]))
        own[:, :HIDDEN], own[:, HIDDEN] = h.take(order, axis=0), 1
        ends = np.searchsorted(target, first).tolist()
        share = own / own.dtype.type(n) if grads is not None else own
        out, dh = np.zeros(n, own.dtype), np.zeros((n, HIDDEN), own.dtype)

        def factor(weights: np.ndarray, sums: np.ndarray, lo: int, hi: int, picked: np.ndarray, grad: np.ndarray | None) -> np.ndarray:
            """Of a softmax over `weights` of rows lo .. hi: its sums and, before these, its mean weights times them."""
            e = own[lo:hi] @ weights.T
            if large:
                most = e.max(axis=1)
                e -= most[:, None]
                picked[lo:hi] -= most
            np.exp(e, out=e)
            got = e @ sums
            if grad is not None:
                np.matmul(e.T, share[lo:hi] / got[:, -1:], out=grad)
            return got

        def add(rows: np.ndarray, got: np.ndarray, picked: np.ndarray) -> None:
            m = len(got)
            out[:m] += picked - np.log(got[:, -1])
            if grads is not None:
                got[:, :-1] /= got[:, -1:]
                got[:, :-1] -= rows[:, :-1]
                dh[:m] += got[:, :-1]

        def sums_of(weights: np.ndarray) -> np.ndarray:
            """Columns that a row of exponentials is summed by."""
            if grads is None:
                return np.ones((len(weights), 1), weights.dtype)
            return np.column_stack([weights[:, :-1], np.ones(len(weights), weights.dtype)])

        rows = p["class"].take(kind, axis=0)
        picked = np.einsum("ij,ij->i", own, rows)
        add(rows, factor(p["class"], sums_of(p["class"]), 0, n, picked, None if grads is None else grads["class"]), picked)
        rows = p["word"].take(target[: ends[-1]], axis=0)
        picked = np.einsum("ij,ij->i", own[: ends[-1]], rows)
        sums = sums_of(p["word"])
        got = np.ones((ends[-1], sums.shape[1]), own.dtype)
        for lo, hi, a, b in zip(ends, ends[1:], first.tolist(), first[1:].tolist()):
            if lo == hi:
                continue
            if b - a == 1:  # sure within its class
                picked[lo:hi], rows[lo:hi], got[lo:hi, :-1] = 0, 0, 0
            else:
                got[lo:hi] = factor(p["word"][a:b], sums[a:b], lo, hi, picked, None if grads is None else grads["word"][a:b])
        add(rows, got, picked)
        if grads is not None:
            at = np.flatnonzero(np.diff(kind, prepend=-1))
            grads["class"][kind[at]] -= np.add.reduceat(share, at, axis=0)
            at = np.flatnonzero(np.diff(target, prepend=-1))
            at = at[: np.searchsorted(target[at], first[-1])]
            if len(at):
                grads["word"][target[at]] -= np.add.reduceat(share[: ends[-1]], at, axis=0)
            grads["word"][self.lone] = 0
            dh /= own.dtype.type(n)
        back = np.empty_like(order)
        back[order] = np.arange(n)
        return out.take(back), dh.take(back, axis=0) if grads is not None else None

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[float, Weights, np.ndarray]:
        """(mean loss, gradients, last state) of one window: (steps, streams) of symbols; a text
        starts where the input is 0, with a state of zero."""
        p, n, g = self.p, len(inputs), {k: np.zeros_like(v) for k, v in self.p.items()}
        states, h, (seen, live, before, zr, c, a) = self.unroll(inputs, h, keep=True)
        scores, ds = self.output(states.reshape(-1, HIDDEN), targets.ravel(), g)
        ds = np.ascontiguousarray(ds.reshape(states.shape).transpose(0, 2, 1))
        # Of all steps at once: what a gradient by the new state is multiplied with.
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        stay = 1 - z
        by_z, by_c, by_r = (c - before) * z * stay, z * (1 - c * c), a * r * (1 - r)
        dx, da, back = *np.empty((2, n, 3 * HIDDEN, inputs.shape[1]), c.dtype), np.zeros_like(c[0])
        for t in range(n - 1, -1, -1):
            d = ds[t]
            d += back
            np.multiply(d, by_z[t], out=dx[t, :HIDDEN])
            dc = np.multiply(d, by_c[t], out=dx[t, 2 * HIDDEN :])
            np.multiply(dc, by_r[t], out=dx[t, HIDDEN : 2 * HIDDEN])
            da[t, : 2 * HIDDEN] = dx[t, : 2 * HIDDEN]
            np.multiply(dc, r[t], out=da[t, 2 * HIDDEN :])
            back = p["state"] @ da[t]
            d *= stay[t]
            back += d
            back *= live[t]
        g["state"] = np.matmul(before, da.transpose(0, 2, 1)).sum(axis=0)
        both = np.matmul(seen, dx.transpose(0, 2, 1)).sum(axis=0)
        g["in"], g["bias"] = both[:-1], both[-1]
        by = np.matmul(dx.transpose(0, 2, 1), p["in"].T).reshape(-1, EMBED)
        ids = inputs.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids.take(order)
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        g["embed"][ids[first]] = np.add.reduceat(by.take(order, axis=0), first, axis=0)
        return -float(scores.mean()), g, h

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n


class Learner:
    """Goes over streams of texts: each of STREAMS slots reads one text after another, so a slot's
    state passes from window to window and starts anew with each text."""

    def __init__(self, net: Network, streams: int = STREAMS, window: int = WINDOW, rate: float = RATE):
        self.net, self.window, self.rate, self.steps, self.tokens = net, window, rate, 0, 0
        self.h = np.zeros((streams, HIDDEN), np.float32)
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(streams)]
        self.length = np.zeros(streams, np.int64)
        self.heads: list[np.ndarray] = [np.zeros((2, 0), np.int32)] * streams  # of a slot's last text
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}

    def read(self, symbols: np.ndarray) -> None:
        """Give the shortest slot a text; windows that all slots have whole are learned."""
        slot = int(self.length.argmin())
        pair = np.zeros((2, len(symbols)), np.int32)
        pair[0, 1:], pair[1] = symbols[:-1], symbols
        self.waiting[slot].append(pair)
        self.heads[slot] = pair[:, : self.window]
        self.length[slot] += len(symbols)
        if self.length.min() >= 16 * self.window:
            n = int(self.length.min()) // self.window * self.window
            self._learn(np.arange(len(self.waiting)), n, self.window)

    def finish(self) -> None:
        """What is left, once.  It is cut into pieces of like length, read side by side: a piece
        that doesn't start its slot's rest has the state that the WARM symbols before it lead to.
        A piece's last window is filled up from its slot's last text, uncounted."""
        rest = {k: np.concatenate(self.waiting[k], axis=1) for k in np.flatnonzero(self.length)}
        size = max(16, -(-WARM // self.window), -(-sum(r.shape[1] for r in rest.values()) // (len(self.waiting) * self.window))) * self.window
        cuts = [(k, at) for k, r in rest.items() for at in range(0, r.shape[1], size)]
        states = np.stack([self.h[k] * (at == 0) for k, at in cuts]) if cuts else self.h
        warm = [i for i, (_, at) in enumerate(cuts) if at]
        if warm:
            before = np.stack([rest[cuts[i][0]][0, max(0, cuts[i][1] - WARM) : cuts[i][1]] for i in warm], axis=1)
            states[warm] = self.net.state_after(before, states[warm])
        pieces = [rest[k][:, at : at + size] for k, at in cuts]
        self.waiting, self.length, self.h = [[p] for p in pieces], np.array([p.shape[1] for p in pieces], np.int64), states
        while len(live := np.flatnonzero(self.length)):
            for i in live:
                more = self.window - int(self.length[i])
                if more > 0:
                    head = self.heads[cuts[i][0]]
                    self.waiting[i].append(np.tile(head, -(-self.window // head.shape[1]))[:, :more])
                    self.tokens -= more
                    self.length[i] = self.window
            self._learn(live, int(self.length[live].min()) // self.window * self.window, self.window)

    def _learn(self, slots: np.ndarray, n: int, window: int) -> None:
        """The next n symbols of each of the slots."""
        rows = [np.concatenate(self.waiting[k], axis=1) for k in slots]
        for k, r in zip(slots, rows):
            self.waiting[k] = [r[:, n:]] if r.shape[1] > n else []
        self.length[slots] -= n
        block = np.stack([r[:, :n] for r in rows], axis=2)
        self.tokens += n * len(rows)
        h = self.h[slots]
        for k in range(0, n, window):
            _, g, h = self.net.gradients(block[0, k : k + window], block[1, k : k + window], h)
            self._move(g)
        self.h[slots] = h

    def _move(self, g: Weights) -> None:
        """Adam with a clipped norm; rows of a table that no gradient reached stay."""
        self.steps += 1
        norm = math.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        rate, one, two = np.float32(self.rate), np.float32(1 - 0.9**self.steps), np.float32(1 - 0.99**self.steps)
        for k, v in g.items():
            m, q, at = *self.moment[k], None
            if k == "embed":
                at = np.flatnonzero(np.abs(v) @ np.ones(EMBED, v.dtype))
                v, m, q = (x.take(at, axis=0) for x in (v, m, q))
            d = v * scale
            s = d - m
            s *= np.float32(0.1)
            m += s
            d *= d
            d -= q
            d *= np.float32(0.01)
            q += d
            np.sqrt(q, out=d)
            d *= 1 / np.sqrt(two)
            d += np.float32(1e-6)
            np.divide(m, d, out=d)
            d *= rate / one
            if at is None:
                self.net.p[k] -= d
            else:
                self.net.p[k][at] -= d
                self.moment[k][0][at], self.moment[k][1][at] = m, q


_UPDATE = "chunk int, learner long, tokens double, total binary"


def _update(rows: list[tuple[int, int, float, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]), pa.array([r[3].tobytes() for r in rows], pa.binary())], names=["chunk", "learner", "tokens", "total"])


def _added(updates: DataFrame) -> DataFrame:
    """Updates of each chunk and group of _FAN learners as one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for b in batches:
            for chunk, learner, tokens, total in zip(*(c.to_pylist() for c in b.columns)):
                own = found.setdefault((chunk, learner), [0.0, 0.0])
                own[0] += tokens
                own[1] = own[1] + np.frombuffer(total)
        for (chunk, learner), (tokens, total) in sorted(found.items()):
            yield _update([(chunk, learner, tokens, total)])

    grouped = updates.withColumn("learner", F.floor(F.col("learner") / _FAN).cast("long"))
    return grouped.repartition("chunk", "learner").mapInArrow(add, _UPDATE)


def train(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Network:
    """Learn from all docs (doc_id, text), each text in one of the rounds, by a hash."""
    net = Network(lex)
    if not lex.tokens:
        return net
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(rounds)).cast("int")
    held = docs.sparkSession.sparkContext
    known = held.broadcast(net)  # fixed size

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), known.value.symbols_in(b.column(1))], names=["round", "symbols"])

    learn = docs.select(turn.alias("round"), text_or_empty().alias("text")).mapInArrow(symbols, "round int, symbols binary")
    learn = stage(learn, "language-model-learn")  # words are looked up once, not in each round
    for r in range(rounds):
        start = held.broadcast((net, net.flat()))  # fixed size: the network's parameters

        def run(batches: Iterator[pa.RecordBatch], start=start, rate: float = RATE / (1 + r)) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, flat = start.value
            own.load(flat.copy())
            learner = Learner(own, rate=rate)
            for b in slices(batches, "symbols"):
                for found in b.column(0).to_pylist():
                    learner.read(np.frombuffer(found, np.uint16))
            learner.finish()
            if learner.tokens:
                number = TaskContext.get().partitionId()
                for k, piece in enumerate(np.array_split(own.flat().astype(float), _CHUNKS)):
                    yield _update([(k, number, float(learner.tokens), piece * learner.tokens)])

        updates = learn.where(F.col("round") == r).select("symbols").mapInArrow(run, _UPDATE)
        width = updates.rdd.getNumPartitions()
        updates = stage(updates, f"language-model-{r}")
        while width > 1:
            updates, width = _added(updates), -(-width // _FAN)
        got = sorted(updates.collect(), key=lambda x: x.chunk)  # the network's size
        if got:
            net.load(np.concatenate([np.frombuffer(x.total) / x.tokens for x in got]))
    return net


class Scorer:
    """Scores texts in slots; states are carried from a text's start to its end."""

    def __init__(self, net: Network, lex: Lexicon):
        self.net, self.v = net, net.symbols - TAILS
        self.tail = np.log10(lex.tail_tokens + 0.5 * (lex.tail_distinct + 1))
        # Places of known words: the end, the others, and one after all for any other word.
        self.set = pa.array(lex.words, pa.binary())
        self.symbol = np.array([*(net.place.get(w) or self.v + tail_of(w) for w in lex.words), 0], np.int32)
        self.half = np.log10(np.array([*(c + 0.5 for c in lex.words.values()), 1.0]))
        self.end_known = lex.words[END] > 0

    def logs(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each text's symbols."""
        length = np.array([len(t) for t in texts])
        slots: list[list[int]] = [[] for _ in range(min(SLOTS, len(texts)))]
        filled = [(0, k) for k in range(len(slots))]
        for i in np.argsort(-length, kind="stable").tolist():  # longest first, to the emptiest slot
            n, k = filled[0]
            heapq.heapreplace(filled, (n + int(length[i]), k))
            slots[k].append(i)
        size = np.array([sum(int(length[i]) for i in s) for s in slots])
        slots = [slots[k] for k in np.argsort(-size, kind="stable")]
        size = -np.sort(-size)
        # Longest first: the slots that still read at a step are the first ones.
        target = np.zeros((len(slots), int(size[0])), np.uint16)
        owner = np.zeros(target.shape, np.int32)
        inputs = np.zeros_like(target)
        for k, s in enumerate(slots):
            target[k, : size[k]] = np.concatenate([texts[i] for i in s])
            owner[k, : size[k]] = np.repeat(s, length[s])
            inputs[k, 1 : size[k]] = target[k, : size[k] - 1]
            inputs[k, np.cumsum([0, *length[s[:-1]]])] = 0
        out, h = np.zeros(len(texts)), np.zeros((len(slots), HIDDEN), np.float32)
        live = np.searchsorted(-size, -np.arange(target.shape[1]), side="left")
        lo = 0
        while lo < len(live):  # a span has about as many tokens, however few slots still read
            n = int(live[lo])
            hi = min(len(live), lo + max(SPAN, SPAN * SLOTS // (2 * n)))
            states, h, _ = self.net.unroll(inputs[:n, lo:hi].T, h[:n])
            reads = np.arange(n) < live[lo:hi, None]
            found, _ = self.net.output(states[reads], target[:n, lo:hi].T[reads])
            out += np.bincount(owner[:n, lo:hi].T[reads], found, len(texts))
            lo = hi
        return out / math.log(10)

    def read(self, texts: pa.Array) -> list[tuple[np.ndarray, int, float, float, pa.Array]]:
        """Of each text: symbols, tokens of known count, sum of log10(c + 0.5) over these, log10 of
        the shares of tail words in their symbols but for the others' numerators, the others."""
        flat, size = words_in(texts)
        other = len(self.set)
        place = pc.fill_null(pc.index_in(flat, self.set), other).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        symbols = self.symbol[place]
        missing = np.flatnonzero(place == other)
        rest = flat.take(pa.array(missing))
        symbols[missing] = self.v + last_bytes(rest) % TAILS
        half = self.half[place]
        far = symbols >= self.v
        tails = np.zeros(len(place))
        tails[far] = half[far] - self.tail[symbols[far] - self.v]
        upto = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]]))
        base, tails, left = upto(half) + self.half[0], upto(tails), np.searchsorted(missing, ends)
        lost = np.diff(left, prepend=0)
        known = size + self.end_known - lost
        texts_ = [np.append(x, np.int32(1)) for x in np.split(symbols, ends[:-1])]
        return list(zip(texts_, known.tolist(), base.tolist(), tails.tolist(), (rest.slice(a - n, n) for a, n in zip(left.tolist(), lost.tolist()))))


def scored(docs: DataFrame, net: Network, lex: Lexicon, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast((net, lex))  # bounded: see Lexicon
    keep = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, waiting, size = Scorer(*held.value), [], 0

        def done() -> pa.RecordBatch:
            rows, ids, found = zip(*waiting)
            symbols, known, base, tails, rest = zip(*found)
            net = scorer.logs(list(symbols)) + np.array(tails)
            pairs = pa.table({"at": np.repeat(np.arange(len(rest)), list(map(len, rest))), "word": pa.concat_arrays(rest)})
            pairs = pairs.group_by(["at", "word"]).aggregate([([], "count_all")]).sort_by("at").combine_chunks()
            ends = pa.array(np.searchsorted(pairs["at"].to_numpy(), np.arange(len(rest) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(pairs[c].chunks) if pairs.num_rows else pa.array([], pairs[c].type)) for c in ("word", "count_all")]
            plain = [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array([len(x) for x in symbols], pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(net)]
            return pa.RecordBatch.from_arrays([*plain, *lists], names=["row", "doc_id", "n_tokens", "known", "base", "net", "words", "times"])

        for b in slices(batches, "text"):
            for row, doc_id, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), scorer.read(b.column(2))):
                waiting.append((row, doc_id, found))
                size += len(waiting[-1][2][0])
                if size > TOKENS:  # many texts at once, so that a long one has company
                    yield done()
                    waiting, size = [], 0
        if waiting:
            yield done()

    schema = "row long, doc_id long, n_tokens long, known long, base double, net double, words array<binary>, times array<long>"
    local = stage(keep.mapInArrow(run, schema), "language-model-scores")
    rare = local.select("row", F.inline(F.arrays_zip("words", "times")).alias("word", "n"))
    c = F.coalesce("c", F.lit(0))
    found = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("far"), F.sum(F.when(c > 0, F.col("n"))).alias("met"))
    far = F.coalesce("far", F.lit(0.0))
    base = F.col("base") + far - F.col("n_tokens") * F.lit(math.log10(lex.tokens + 0.5 * (lex.distinct + 1)))
    out = local.drop("words", "times").join(found, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).cast("long").alias("n_known"), base.alias("base_score"), (F.col("net") + far).alias("score"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    learned = docs.where(~held_out())
    counts = stage(token_counts(learned), "language-model-counts")
    lex = lexicon(counts)
    found = scored(docs, train(learned, lex), lex, counts)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(lex.tokens).cast("long").alias("train_tokens"), "base_score", "score")
