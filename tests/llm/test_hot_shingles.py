"""Shingles that very many rows have are counted apart, with the same groups as a result."""

import random

import pytest

from tidewatch.llm import simhash

WORDS = [f"w{k}" for k in range(400)]


def _texts():
    r = random.Random(3)
    make = lambda n: [r.choice(WORDS) for _ in range(n)]
    line = make(30)
    texts = [" ".join([*line, *make(40)]) for _ in range(80)]  # a common passage, else unlike
    base = make(120)
    texts += [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(60)]  # near copies
    texts += [" ".join(line)] * 50 + [" ".join([*line, "end"])] * 40  # exact copies of only that passage
    return texts + ["", None, "two words", "two words"]


def _classes(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if top[i] != top[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0):
                lo, hi = sorted((top[i], top[j]))
                top = [lo if x == hi else x for x in top]
    return dict(enumerate(top))


@pytest.mark.parametrize("part, most, large", [(40, 1 << 20, 20_000), (2, 1 << 20, 3), (40, 5, 20_000), (1_000_000, 1 << 20, 20_000)])
def test_groups_do_not_depend_on_which_shingles_are_hot(spark, monkeypatch, part, most, large):
    texts = _texts()
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "HOT_SHARE", 1)
    monkeypatch.setattr(simhash, "HOT_MOST", most)
    monkeypatch.setattr(simhash, "LARGE", large)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs).collect()}
    assert got == _classes(texts)


def test_frequent_shingles(spark, monkeypatch):
    texts = [t for t in _texts() if t]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    counts = {}
    for t in texts:
        for h in simhash.shingle_set(t.encode()).tolist():
            counts[h] = counts.get(h, 0) + 1
    monkeypatch.setattr(simhash, "HOT_SHARE", 1)
    monkeypatch.setattr(simhash, "PART", 50)
    assert simhash.frequent(rows).tolist() == sorted(h for h, n in counts.items() if n >= 50)
    monkeypatch.setattr(simhash, "HOT_MOST", 7)
    assert len(simhash.frequent(rows)) == 7
    assert len(simhash.frequent(rows.limit(0))) == 0
