"""The language model's counts and scores against one text at a time, its gradients, its gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import language_model as lm

DOCS = "doc_id long, text string, lang string, word string, c long, row long"


def corpus(n=400, seed=5):
    r = random.Random(seed)
    names = [[f"{a}{b}" for b in "aeiou" for a in s] for s in ("bcdfg", "hjklm", "npqrs")]
    texts = []
    for i in range(n):
        own = names[i % 3]
        texts.append(" ".join(r.choice(own) + (f"#{r.randrange(900)}" if r.random() < 0.1 else "") for _ in range(r.randint(1, 120))))
    texts += ["", None, "   ", "\x0b \x1c\x85 A b", "É é ÉA éa", "x" * 9000, "Word\t\n\rWORD\fword ", " ".join("far%d" % (k % 7) for k in range(3000)), texts[0], texts[0], texts[3].upper()]
    rows = [(i, t, "en", "clash", 1, 1) for i, t in enumerate(texts)]
    return rows + [rows[1], (None, texts[2], "en", None, None, None), (None, "only here", None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def split(rows):
    """Is each row learned from?"""
    return [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 != 1 for r in rows]


def words(t):
    return (t or "").encode().lower().split()


def test_arrow_words_equal_plain_ones(rows):
    texts = [r[1] or "" for r in rows] + [" a", "a ", "  ", "\ta  b\x0b\x0c", "\x00 \x1f z"]
    flat, size = lm.words_in(pa.array(texts))
    assert size.tolist() == [len(words(t)) for t in texts]
    assert flat.to_pylist() == [w for t in texts for w in words(t)]


@pytest.fixture(scope="module")
def scored(spark, rows):
    """(rows of the query, network, lexicon) with a small vocabulary and few broadcast words."""
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("doc_id", "coalesce(text, '') text")
    learned = docs.where(~lm.held_out())
    counts = lm.stage(lm.token_counts(learned), "counts")
    lex = lm.lexicon(counts, vocabulary=60, frequent=150)
    net = lm.train(learned, lex)
    return lm.scored(docs, net, lex, counts).collect(), net, lex


def test_counts_and_base_equal_brute_force(scored, rows):
    got, _, lex = scored
    counts = Counter()
    for r, known in zip(rows, split(rows)):
        if known:
            counts.update([*words(r[1]), lm.END])
    n, v = sum(counts.values()), len(counts)
    assert (lex.tokens, lex.distinct) == (n, v) and len(lex.words) <= 151 and len(lex.vocabulary) <= 61
    assert all(counts[w] == c for w, c in lex.words.items())
    want = []
    for r in rows:
        tokens = [*words(r[1]), lm.END]
        want.append((str(r[0]), len(tokens), sum(counts[w] > 0 for w in tokens), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(want)


def test_scores_equal_one_text_at_a_time(scored, rows):
    got, net, lex = scored
    counts = Counter()
    for r, known in zip(rows, split(rows)):
        if known:
            counts.update([*words(r[1]), lm.END])
    v = len(lex.vocabulary) + 1

    def plain(text):
        h, last, total = np.zeros((1, lm.HIDDEN), np.float32), 0, 0.0
        for w, s in zip([*words(text), lm.END], net.symbols_of(words(text)).tolist()):
            x = net.p["embed"][[last]] @ net.p["in"] + net.p["bias"]
            h, _ = net.step(x, h)
            total += float(net.output(h, np.array([s]))[0][0]) / math.log(10)
            if s >= v:
                total += math.log10((counts[w] + 0.5) / (lex.tail_tokens[s - v] + 0.5 * (lex.tail_distinct[s - v] + 1)))
            last = s
        return total

    want = sorted((str(r[0]), plain(r[1])) for r in rows[-60:])
    ids = {w[0] for w in want}
    mine = sorted((str(r.doc_id), r.score) for r in got if str(r.doc_id) in ids)
    mine = [m for m in mine if m[0] != "1"]  # stands twice, once outside of the sixty
    want = [w for w in want if w[0] != "1"]
    assert [m[0] for m in mine] == [w[0] for w in want]
    assert np.allclose([m[1] for m in mine], [w[1] for w in want], rtol=2e-4, atol=1e-3)


def test_symbols_have_shares_that_add_to_one(scored):
    _, net, _ = scored
    h = np.random.default_rng(0).uniform(-1, 1, (1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(1, net.symbols)
    assert abs(np.exp(net.output(np.repeat(h, len(every), axis=0), every)[0].astype(float)).sum() - 1) < 1e-4


def test_held_out_texts_gain_over_base(scored):
    got = [r for r in scored[0] if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert len(got) > 50
    tokens = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / tokens > sum(r.base_score for r in got) / tokens + 0.2


def lexicon(words_):
    return lm.Lexicon({lm.END: 9} | {w: 40 - k for k, w in enumerate(words_)}, 900, 99, np.ones(lm.TAILS), np.ones(lm.TAILS), [lm.END, *words_])


def test_gradients_equal_differences():
    net = lm.Network(lexicon([b"w%d" % k for k in range(30)]))
    r = np.random.default_rng(2)
    net.p = {k: (v + 0.2 * r.standard_normal(v.shape)).astype(np.float64) for k, v in net.p.items()}
    inputs, targets = r.integers(0, net.symbols, (5, 3)), r.integers(1, net.symbols, (5, 3))
    inputs[2, 1] = 0
    h = r.uniform(-1, 1, (3, lm.HIDDEN))
    _, g, _ = net.gradients(inputs, targets, h)
    for k, v in net.p.items():
        for at in r.choice(v.size, 6):
            flat, step = v.reshape(-1), 1e-5
            flat[at] += step
            up = net.gradients(inputs, targets, h)[0]
            flat[at] -= 2 * step
            down = net.gradients(inputs, targets, h)[0]
            flat[at] += step
            assert abs((up - down) / (2 * step) - g[k].reshape(-1)[at]) < 2e-4, k


def test_learner_carries_state_and_counts_tokens():
    net = lm.Network(lexicon([b"a", b"b"]))
    learner = lm.Learner(net, streams=2, window=4)
    r = np.random.default_rng(1)
    texts = [r.integers(1, 4, n).astype(np.int32) for n in (200, 3, 90, 1, 300, 7)]
    for t in texts:
        learner.read(t)
    learner.finish()
    assert learner.tokens == sum(map(len, texts)) and learner.steps > 40


def test_updates_are_averaged_by_tokens_in_a_tree(spark):
    r = np.random.default_rng(4)
    given = [(int(c), k, float(t), bytearray((r.standard_normal(6) * t).tobytes())) for k in range(70) for t in [r.integers(1, 9)] for c in range(2)]
    df, width = spark.createDataFrame(given, lm._UPDATE).repartition(5), 70
    while width > 1:
        df, width = lm._added(df), -(-width // lm._FAN)
    got = {x.chunk: (x.tokens, np.frombuffer(x.total)) for x in df.collect()}
    for c in range(2):
        assert got[c][0] == sum(t for k, _, t, _ in given if k == c)
        assert np.allclose(got[c][1], sum(np.frombuffer(bytes(b)) for k, _, _, b in given if k == c))


def test_nothing_to_learn_or_score(spark, rows):
    docs = spark.createDataFrame(rows[-14:], DOCS).selectExpr("doc_id", "coalesce(text, '') text")
    none = docs.where("false")
    counts = lm.stage(lm.token_counts(none), "counts")
    lex = lm.lexicon(counts)
    got = lm.scored(docs, lm.train(none, lex), lex, counts).collect()
    assert len(got) == 14 and all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.scored(none, lm.train(none, lex), lex, counts).collect() == []


def test_every_training_row_is_learned_from_however_large_the_corpus(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} w{k % 3}") for k in range(200)], "doc_id long, text string").repartition(2)
    counts = lm.stage(lm.token_counts(docs), "counts")
    lex = lm.lexicon(counts)
    lex.tokens = 10**9
    seen, stage = [], lm.stage
    monkeypatch.setattr(lm, "stage", lambda df, label: seen.append((label, stage(df, label))) or seen[-1][1])
    lm.train(docs, lex)
    learned = [df for label, df in seen if label == "language-model-learn"]
    assert [df.count() for df in learned] == [200]


def test_learner_reads_every_symbol_once(monkeypatch):
    """Texts of very unlike lengths: all symbols are targets, and few are read a second time."""
    net = lm.Network(lexicon([b"w%d" % k for k in range(20)]))
    r = np.random.default_rng(5)
    texts = [r.integers(2, net.symbols, n).astype(np.int32) for n in (3000, 5, 40, 1, 900, 17, 64, 333)]
    learner, seen, gradients = lm.Learner(net, streams=4, window=8), [], net.gradients
    monkeypatch.setattr(net, "gradients", lambda i, t, h: seen.append((i.copy(), t.copy())) or gradients(i, t, h))
    for t in texts:
        learner.read(t)
    learner.finish()
    assert learner.tokens == sum(map(len, texts))
    pairs = lambda i, t: zip(i.ravel().tolist(), t.ravel().tolist())
    got = Counter(p for i, t in seen for p in pairs(i, t))
    want = Counter(p for t in texts for p in pairs(np.concatenate([[0], t[:-1]]), t))
    assert not want - got and (got - want).total() < 0.1 * want.total()


def test_pieces_of_a_long_text_start_from_a_state_of_their_own(monkeypatch):
    net = lm.Network(lexicon([b"a", b"b", b"c"]))
    text = np.random.default_rng(6).integers(1, 5, 2000).astype(np.int32)
    learner, starts = lm.Learner(net, streams=4, window=8, rate=0.0), []
    monkeypatch.setattr(learner, "_learn", lambda slots, n, window: starts.append(learner.h.copy()) or learner.length.fill(0))
    learner.read(text)
    learner.finish()
    inputs = np.concatenate([[0], text[:-1]])[:, None]
    size = -(-2000 // 32) * 8
    for k, h in enumerate(starts[0]):
        assert np.allclose(h, net.state_after(inputs[: k * size], np.zeros((1, lm.HIDDEN), np.float32))[0], atol=1e-3)


def test_arrow_symbols_equal_plain_ones(rows):
    net = lm.Network(lexicon([b"ba", b"ca", b"da", b"word", b"\xc3\xa9a"]))
    texts = [r[1] or "" for r in rows] + [" a", "\ta  ba\x0b\x0c", "\x00 \x1f ba"]
    for given in (texts, texts[-1:], ["", ""], []):
        got = net.symbols_in(pa.array(["zz", *given]).slice(1).cast(pa.string())).to_pylist()
        assert [np.frombuffer(g, np.uint16).tolist() for g in got] == [net.symbols_of(words(t)).tolist() for t in given]


def test_rounds_read_symbols_not_texts(spark, rows, monkeypatch):
    """Words are looked up once: what the rounds read has two bytes a token and no text."""
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text")
    counts = lm.stage(lm.token_counts(docs.selectExpr("coalesce(text, '') text")), "counts")
    seen, stage = {}, lm.stage
    monkeypatch.setattr(lm, "stage", lambda df, label: seen.setdefault(label, stage(df, label)))
    lm.train(docs, lm.lexicon(counts))
    got = seen["language-model-learn"]
    assert got.columns == ["round", "symbols"]
    tokens = sum(len(words(r[1])) + 1 for r in rows)
    assert got.selectExpr("sum(length(symbols))", "count(*)", "count(distinct round)").first()[:] == (2 * tokens, len(rows), lm.ROUNDS)
    assert sum(r.tokens for k in range(lm.ROUNDS) for r in seen[f"language-model-{k}"].where("chunk = 0").collect()) == tokens


def test_unrolled_states_equal_single_steps():
    net, r = lm.Network(lexicon([b"a", b"b", b"c"])), np.random.default_rng(8)
    inputs = r.integers(0, 5, (9, 6)).astype(np.uint16)
    h = first = r.uniform(-1, 1, (6, lm.HIDDEN)).astype(np.float32)
    states, last, _ = net.unroll(inputs, first)
    for t in range(9):
        h, _ = net.step(net.p["embed"][inputs[t]] @ net.p["in"] + net.p["bias"], h * (inputs[t] != 0)[:, None])
        assert np.allclose(states[t], h, atol=1e-6)
    assert np.allclose(last, h, atol=1e-6)


@pytest.mark.parametrize("raised", [0, 30, 200])
def test_output_holds_for_weights_of_any_size(raised):
    """Probabilities and gradients are those of plain double precision, exponentials out of range or not."""
    net, r = lm.Network(lexicon([b"w%d" % k for k in range(39)])), np.random.default_rng(9)
    for k in ("class", "word"):
        net.p[k][:, -1] += raised * r.choice([-1, 1], len(net.p[k]))
    h, target = r.uniform(-1, 1, (500, lm.HIDDEN)).astype(np.float32), r.integers(1, net.symbols, 500)
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    got, dh = net.output(h, target, grads)
    assert net.large() == (raised > 30) and np.allclose(got, net.output(h, target)[0], atol=1e-4)
    own = np.column_stack([h, np.ones(500)])
    want, by = np.zeros(500), np.zeros((500, lm.HIDDEN))
    total = {k: np.zeros(net.p[k].shape) for k in ("class", "word")}

    def softmax(name, lo, hi, i, at):
        e = net.p[name][lo:hi].astype(float) @ own[i]
        e -= e.max()
        want[i] += e[at - lo] - np.log(np.exp(e).sum())
        e = np.exp(e) / np.exp(e).sum()
        e[at - lo] -= 1
        by[i] += e @ net.p[name][lo:hi, :-1] / 500
        total[name][lo:hi] += np.outer(e, own[i]) / 500

    for i, s in enumerate(target.tolist()):
        k = int(net.class_of[s])
        softmax("class", 0, net.classes, i, k)
        if k < net.inner:
            softmax("word", int(net.first[k]), int(net.first[k + 1]), i, s)
    assert np.allclose(got, want, atol=1e-3, rtol=1e-5) and np.allclose(dh, by, atol=1e-5)
    assert all(np.allclose(grads[k], v, atol=1e-5) for k, v in total.items())
