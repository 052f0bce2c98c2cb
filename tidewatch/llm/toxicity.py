"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Inputs are words; one of over 64 bytes (scripts without blanks, joined words) is cut into
pieces of 64 that overlap by two, words of their own, so that every trigram of a text is in
some window.  Each word's vector is its embedding, if it is of the vocabulary (words of
some training texts), plus the mean of embeddings of its hashed character trigrams, so unseen
spellings still say something.  A window of
`length` words goes through a forward and a backward GRU; attention pools the states to one
vector, and a logistic unit scores it.  Windows start every `length // 2` words, so all words
are scored, most in two windows.  A document's score is that of its highest window.

The network is trained in numpy on the driver, from a bounded sample of the labelled rows
(`train_docs`, the rows whose hash is least, half from each label as far as there are so
many).  A label says nothing of where in a text its reason lies, so training takes any window
of a text first, and then mostly the one that scores highest.  Scores use the text alone.

Defined results: null and wordless texts have one empty window and a score; equal texts have
equal scores; a null doc_id is hashed as the empty text; repeated rows are scored each; with
no usable labels of both kinds every score is the base rate, or 0; an empty table gives no
row; other columns are kept by `scored` whatever their names, but one named `score`, which is
replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import guarded, slices, table, text_or_empty

PIECE = 64
VOCABULARY, LEAST_DOCS, GRAM_SLOTS, EMBED, HIDDEN, LENGTH = 1 << 13, 3, 1 << 12, 12, 12, 48
TRAIN_DOCS, STEPS = 3000, 480
_CLEAN = bytes.maketrans(b".,;:!?\"'()[]{}<>|*_#", b" " * 20)


def words_of(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode().translate(_CLEAN).split()
    if words and len(max(words, key=len)) > PIECE:
        return [w[k : k + PIECE] for w in words for k in range(0, max(1, len(w) - 2), PIECE - 2)]
    return words


def _features(words: list[bytes], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, gram slots of all words in a row, number of grams of each word)."""
    padded = [b"^" + w + b"$" for w in words]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    raw = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    mixed = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    last = np.cumsum(size) - 1
    inside = np.ones(len(mixed), bool)
    cross = np.concatenate([last - 1, last])
    inside[cross[cross < len(mixed)]] = False
    numbers = np.fromiter((vocab.get(w, 0) for w in words), np.int64, len(words))
    return numbers, ((mixed >> np.uint32(12)) % np.uint32(GRAM_SLOTS))[inside].astype(np.int64), size - 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """Parameters and passes.  A batch is (m, length) word rows; row 0 pads."""

    def __init__(self, vocab: dict[bytes, int] | None = None, seed: int = 3):
        self.vocab = vocab or {}
        r = np.random.default_rng(seed)
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"word": f(len(self.vocab) + 1, EMBED, by=0.1), "gram": f(GRAM_SLOTS, EMBED, by=0.1), "out": f(2 * HIDDEN, by=0.2), "bias": np.zeros(1, np.float32), "attend": f(2 * HIDDEN, HIDDEN, by=0.3), "query": f(HIDDEN, by=0.3)}
        for d in ("f", "b"):
            self.p |= {f"w{d}": f(EMBED, 3 * HIDDEN, by=0.4), f"u{d}": f(HIDDEN, 3 * HIDDEN, by=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p["word"][0] = 0  # words out of the vocabulary have their trigrams alone
        self.base = 0.5

    def vectors(self, feats: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Input vectors of words, after a row of zeros for padding."""
        word, gram, size = feats
        out = np.zeros((len(word) + 1, EMBED), np.float32)
        if len(word):
            out[1:] = self.p["word"][word] + np.add.reduceat(self.p["gram"][gram], np.cumsum(size) - size, axis=0) / size[:, None].astype(np.float32)
        return out

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """GRU states (length, m, hidden) from projected inputs x (length, m, 3*hidden)."""
        n, m, _ = x.shape
        h = np.zeros((m, HIDDEN), np.float32)
        states, saved = np.empty((n, m, HIDDEN), np.float32), []
        u, H = self.p[f"u{d}"], HIDDEN
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            a = h @ u
            zr = _sigmoid(x[t, :, : 2 * H] + a[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[t, :, 2 * H :] + r * a[:, 2 * H :])
            on = mask[t][:, None]
            new = h + on * z * (c - h)
            if keep:
                saved.append((t, h, z, r, c, a[:, 2 * H :]))
            h = states[t] = new
        return states, saved

    def projected(self, vec: np.ndarray) -> dict[str, np.ndarray]:
        return {d: vec @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in ("f", "b")}

    def forward(self, inputs: dict[str, np.ndarray], rows: np.ndarray, keep: bool = False):
        """Scores (before the sigmoid) of windows of word rows into projected inputs."""
        mask = (rows > 0).T.astype(np.float32)
        parts, saved = [], {}
        for d in ("f", "b"):
            states, saved[d] = self._direction(inputs[d][rows.T], mask, d, keep)
            parts.append(states)
        s = np.concatenate(parts, axis=2)
        k = np.tanh(s @ self.p["attend"])
        e = k @ self.p["query"]
        e = np.where(mask > 0, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[:, :, None] * s).sum(axis=0)
        score = pooled @ self.p["out"] + self.p["bias"][0]
        return (score, (mask, saved, s, k, weight, pooled)) if keep else score

    def gradients(self, vec: np.ndarray, rows: np.ndarray, target: np.ndarray, weigh: np.ndarray):
        """Gradients of the weighed log loss by parameter, and by vec."""
        score, (mask, saved, s, k, weight, pooled) = self.forward(self.projected(vec), rows, keep=True)
        g = {}
        ds = ((_sigmoid(score) - target) * weigh / len(target)).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ ds, np.array([ds.sum()], np.float32)
        dp = ds[:, None] * self.p["out"]
        dstate = weight[:, :, None] * dp
        dw = (s * dp).sum(axis=2)
        de = weight * (dw - (weight * dw).sum(axis=0)) * mask
        dk = de[:, :, None] * self.p["query"] * (1 - k * k)
        g["query"] = np.einsum("tm,tmh->h", de, k)
        g["attend"] = s.reshape(-1, s.shape[2]).T @ dk.reshape(-1, HIDDEN)
        dstate = dstate + dk @ self.p["attend"].T
        dvec, H = np.zeros_like(vec), HIDDEN
        for j, d in enumerate(("f", "b")):
            u = self.p[f"u{d}"]
            dx = np.zeros((len(mask), len(target), 3 * H), np.float32)
            dh, du = np.zeros((len(target), H), np.float32), np.zeros_like(u)
            for t, h, z, r, c, a in reversed(saved[d]):
                dh = dh + dstate[t, :, j * H : (j + 1) * H]
                on = mask[t][:, None]
                dz, dc = dh * on * (c - h), dh * on * z
                dcand = dc * (1 - c * c)
                da = np.concatenate([dz * z * (1 - z), dcand * a * r * (1 - r), dcand * r], axis=1)
                dx[t] = np.concatenate([da[:, : 2 * H], dcand], axis=1)
                du += h.T @ da
                dh = dh * (1 - on * z) + da @ u.T
            g[f"u{d}"], g[f"c{d}"] = du, dx.sum(axis=(0, 1))
            flat = dx.reshape(-1, 3 * H)
            per = np.zeros((len(vec), 3 * H), np.float32)
            np.add.at(per, rows.T.ravel(), flat)
            g[f"w{d}"] = vec.T @ per
            dvec += per @ self.p[f"w{d}"].T
        return g, dvec


def windows(n: int, length: int = LENGTH) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; one for none."""
    step = length // 2
    return np.arange(0, max(1, n - step), step)


class _Words:
    """Word -> row in a table of inputs; rows of new words are handed out in order."""

    def __init__(self):
        self.place: dict[bytes, int] = {}

    def rows(self, words: list[bytes], length: int) -> np.ndarray:
        place = self.place
        at = np.zeros(len(words) + 2 * length, np.int32)
        at[: len(words)] = [place.setdefault(w, len(place) + 1) for w in words]
        return np.lib.stride_tricks.sliding_window_view(at, length)[windows(len(words), length)]


class _Held:
    """Texts not trained on: their weighed log loss, by the highest window of each."""

    def __init__(self, samples: list[tuple[str, int]], vocab: dict[bytes, int], length: int, prior: float):
        words = _Words()
        each = [words.rows(words_of(t), length) for t, _ in samples]
        self.feats = _features(list(words.place), vocab)
        self.rows, self.count = np.concatenate(each), np.array([len(x) for x in each])
        self.label = np.array([y for _, y in samples], np.float32)
        base = float(self.label.mean())
        self.weigh = np.where(self.label > 0, prior / base, (1 - prior) / (1 - base))

    def loss(self, net: "Network") -> float:
        inputs = net.projected(net.vectors(self.feats))
        got = np.concatenate([net.forward(inputs, self.rows[lo : lo + 4096]) for lo in range(0, len(self.rows), 4096)])
        score = np.maximum.reduceat(got, np.cumsum(self.count) - self.count)
        return float(np.mean(self.weigh * (np.logaddexp(0, score) - self.label * score)))


def _fit(samples: list[tuple[str, int]], held: list[tuple[str, int]], steps: int = STEPS, length: int = LENGTH, seed: int = 3, batch: int = 48, prior: float = 0.25) -> Network:
    """Fit on (text, label).  The first steps take any window of a text; then, a few times over,
    windows are scored and the highest of each text is taken.  Labels are weighed as if `prior`
    of the texts were toxic.  Of the states at every twelfth of the steps, that of the least
    loss on the held-back texts is given out."""
    found = Counter(w for t, _ in samples for w in set(words_of(t)))
    common_ = sorted((w for w, n in found.items() if n >= LEAST_DOCS), key=lambda w: (-found[w], w))[:VOCABULARY]
    net = Network({w: k + 1 for k, w in enumerate(common_)}, seed)
    label = np.array([y for _, y in samples], np.float32)
    net.base = float(label.mean()) if len(label) else 0.0
    if len(set(label.tolist())) < 2:
        net.p["out"][:] = 0
        net.p["bias"][:] = -20 if net.base == 0 else 20
        return net
    table_ = _Words()
    each = [table_.rows(words_of(t), length) for t, _ in samples]
    feats = _features(list(table_.place), net.vocab)
    word, gram, size = feats
    start = np.cumsum(size) - size
    usable = len({y for _, y in held}) == 2
    other = _Held(held, net.vocab, length, prior) if usable else None
    least, kept = np.inf, None
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    rng = np.random.default_rng(seed)
    weigh_all = np.where(label > 0, prior / net.base, (1 - prior) / (1 - net.base)).astype(np.float32)
    groups = [np.flatnonzero(label == y) for y in (0, 1)]
    best: list[np.ndarray] | None = None
    net.p["bias"][:] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, round(batch * share))) for g, share in zip(groups, (1 - max(net.base, 0.3), max(net.base, 0.3)))])
        if step >= steps // 2 and (step - steps // 2) % (steps // 6 or 1) == 0:
            inputs = net.projected(net.vectors(feats))
            flat, count = np.concatenate(each), np.array([len(x) for x in each])
            score = np.concatenate([net.forward(inputs, flat[lo : lo + 4096]) for lo in range(0, len(flat), 4096)])
            ends = np.cumsum(count)
            best = [x[int(np.argmax(score[e - c : e]))] for x, c, e in zip(each, count, ends)]
        rows = np.stack([best[i] if best is not None and rng.random() < 0.7 else each[i][rng.integers(len(each[i]))] for i in pick])
        used, inner = np.unique(rows, return_inverse=True)
        inner = inner.reshape(rows.shape)
        if used[0] != 0:
            used, inner = np.concatenate([[0], used]), inner + 1
        own = used[1:] - 1
        index = np.concatenate([gram[a : a + n] for a, n in zip(start[own], size[own])]) if len(own) else np.zeros(0, np.int64)
        small = net.vectors((word[own], index, size[own]))
        g, dvec = net.gradients(small, inner, label[pick], weigh_all[pick])
        dense_w, dense_g = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
        np.add.at(dense_w, word[own], dvec[1:])
        dense_w[0] = 0
        np.add.at(dense_g, index, np.repeat(dvec[1:] / size[own][:, None].astype(np.float32), size[own], axis=0))
        g |= {"word": dense_w, "gram": dense_g}
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            m, q = moment[k]
            if k in ("word", "gram"):
                v += 2e-5 * net.p[k]
            m += 0.1 * (v - m)
            q += 0.01 * (v * v - q)
            net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-5)).astype(np.float32)
        if other is not None and (step % max(1, steps // 12) == 0 or step == steps):
            loss = other.loss(net)
            if loss < least:
                least, kept = loss, {k: v.copy() for k, v in net.p.items()}
    net.p = kept or net.p
    return net


def train(samples: list[tuple[str, int]], steps: int = STEPS, length: int = LENGTH, seed: int = 3) -> Network:
    """Fit on four fifths of (text, label); the rest says when to stop and sets the bias: 0.5
    becomes the score that parts the labels of texts not trained on with the fewest errors."""
    rest = samples[::5]
    net = _fit([x for k, x in enumerate(samples) if k % 5], rest, steps, length, seed)
    label = np.array([y for _, y in rest])
    if len(set(label.tolist())) < 2 or not net.vocab:
        return net
    logit = Scorer(net, length).logits([t for t, _ in rest])
    order = np.argsort(logit)
    missed = np.concatenate([[0], np.cumsum(label[order] == 1)])
    false = (label == 0).sum() - np.concatenate([[0], np.cumsum(label[order] == 0)])
    errors = missed + false
    edge = np.concatenate([[logit.min() - 1], (logit[order][1:] + logit[order][:-1]) / 2, [logit.max() + 1]])
    least = np.flatnonzero(errors == errors.min())
    net.p["bias"] -= np.float32(edge[least[len(least) // 2]])
    return net


class Scorer:
    """Scores texts with a network, remembering the inputs of up to `memo` words."""

    def __init__(self, net: Network, length: int = LENGTH, memo: int = 150_000):
        self.net, self.length, self.memo = net, length, memo
        self._clear()

    def _clear(self) -> None:
        self.words, self.known = _Words(), 0
        first = self.net.projected(np.zeros((1, EMBED), np.float32))
        self.inputs = {d: np.concatenate([x, np.empty((1 << 14, x.shape[1]), np.float32)]) for d, x in first.items()}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Score (0 to 1) of each text: that of its highest window."""
        return _sigmoid(self.logits(texts)).astype(np.float64)

    def logits(self, texts: list[str | None], block: int = 2048) -> np.ndarray:
        if len(self.words.place) > self.memo:
            self._clear()
        each = [self.words.rows(words_of(t), self.length) for t in texts]
        n = len(self.words.place)
        if n > self.known:
            new = self.net.projected(self.net.vectors(_features(list(self.words.place)[self.known :], self.net.vocab))[1:])
            for d, x in new.items():
                if n + 1 > len(self.inputs[d]):
                    self.inputs[d] = np.concatenate([self.inputs[d], np.empty((n + 1, x.shape[1]), np.float32)])
                self.inputs[d][self.known + 1 : n + 1] = x
            self.known = n
        rows, count = np.concatenate(each), np.array([len(x) for x in each])
        got = np.concatenate([self.net.forward(self.inputs, rows[lo : lo + block]) for lo in range(0, len(rows), block)])
        return np.maximum.reduceat(got, np.cumsum(count) - count)


def held_out() -> F.col:
    """True for rows that labels are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> list[tuple[str, int]]:
    """At most train_docs (text, toxic) of labelled rows that aren't held out: the rows of least
    hash, half from each label."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    order = F.xxhash64("doc_id", F.lit(17))
    picked = [marked.where(F.col("toxic") == y).select(F.col("doc_id").cast("long"), "toxic").orderBy(order, "doc_id").limit(train_docs // 2) for y in (0, 1)]
    # Broadcast: train_docs rows of two numbers at most.
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    rows = chosen.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(train_docs).collect()
    return [(r.text, r.toxic) for r in rows]


def scored(docs: DataFrame, net: Network, length: int = LENGTH) -> DataFrame:
    """docs with a column `score` added (one of that name is replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: the network's parameters
    given = [c for c in docs.columns if c != "score"]
    docs, names = guarded(docs, ("text",))
    keep = ["text", *names]
    clear = docs.select(*keep, text_or_empty().alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value, length)
        for b in slices(batches, "_text", 1_000_000):
            score = scorer.score(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(score)], names=[*keep, "_score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    out = clear.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", _score double")
    back = {c: k for k, c in names.items()} | {"text": "text"}
    return out.select(*[F.col(back[c]).alias(c) for c in given], F.col("_score").alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(training_sample(docs, table(spark, sf_dir, "labels")))
    found = scored(docs.select(F.col("doc_id").cast("long"), "text"), net)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
