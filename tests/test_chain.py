"""The anchor chain of a key that is split over many tasks, against one task and plain Python."""

import random

import numpy as np
import pytest

from tidewatch.operators import chain

ROWS = "k string, seq long, ms long, note string"


def rows(seed, n=900):
    r = random.Random(seed)
    made = []
    for key, rate in (("hot", 4), ("warm", 60), (None, 9), ("one", 1)):
        t, size = 1000, {"one": 1, "warm": 80}.get(key, n)
        for _ in range(size):
            t += r.choice([0, 0, 1, rate, rate, 40 * rate])
            made.append((key, r.randrange(1 << 40), None if r.random() < 0.03 else t - r.choice([0, 0, 0, 30, 400]), "x"))
    made.append(("blank", 5, None, "x"))
    return list({m[1]: m for m in made}.values())


def plain(given, gap, strict):
    out, state = {}, {}
    for key, seq, ms, _ in sorted(given, key=lambda m: m[1]):
        anchor, number = state.get(key, (None, 0))
        if anchor is None:
            out[seq] = (True, None, number)
            state[key] = (ms, 0)
        else:
            over = ms is not None and (ms - anchor > gap if strict else ms - anchor >= gap)
            out[seq] = (over, anchor, number)
            state[key] = (ms, number + 1) if over else (anchor, number)
    return out


@pytest.mark.parametrize("gap,strict,width,records", [(50, False, 1 << 34, 16), (50, True, 1 << 36, 64), (3000, False, 1 << 33, 8), (1, False, 1 << 38, 1000), (10**7, True, 1 << 35, 5)])
def test_split_chain_equals_plain_chain(spark, gap, strict, width, records):
    given = rows(gap)
    df = spark.createDataFrame(given, ROWS).repartition(5)
    got = chain.greedy_chain(df, "k", "seq", "ms", gap, strict, most=70, width=width, records=records)
    assert got.columns == ["k", "seq", "ms", "note", "fired", "fired_anchor", "fired_no"]
    assert {r.seq: (r.fired, r.fired_anchor, r.fired_no) for r in got.collect()} == plain(given, gap, strict)
    every = chain.greedy_chain(df, "k", "seq", "ms", gap, strict)
    assert {r.seq: (r.fired, r.fired_anchor, r.fired_no) for r in every.collect()} == plain(given, gap, strict)


def test_no_key_is_hot_without_rows_or_beside_null(spark):
    none = spark.createDataFrame([], ROWS)
    assert chain.greedy_chain(none, "k", "seq", "ms", 5, most=0).collect() == []
    given = [m for m in rows(3) if m[0] is None]
    got = chain.greedy_chain(spark.createDataFrame(given, ROWS), "k", "seq", "ms", 200, most=10, width=1 << 36, records=9)
    assert {r.seq: (r.fired, r.fired_anchor, r.fired_no) for r in got.collect()} == plain(given, 200, False)


def test_block_maps_follow_jumps():
    v = np.sort(np.random.default_rng(1).choice(5000, 700, replace=False))
    for gap in (1, 13, 400, 9000):
        jump = chain._jumps(v, gap, "left")
        last, count = chain._ends(jump, 200)
        for e in range(200):
            at, n = e, 1
            while jump[at] < len(v):
                at, n = jump[at], n + 1
            assert (last[e], count[e]) == (at, n)


def test_operators_over_a_split_service_are_unchanged(spark, data, monkeypatch):
    from tidewatch.plans import catalog

    names = ["tumbling_anchored", "slide_throttle", "detect_full", "dedup_ttl"]
    one = {n: sorted(map(str, catalog.QUERIES[n](spark, f"{data}/sf0.001").collect())) for n in names}
    split = chain.greedy_chain.__defaults__
    monkeypatch.setattr(chain.greedy_chain, "__defaults__", (*split[:2], 0, 50, 20))
    for n in names:
        assert sorted(map(str, catalog.QUERIES[n](spark, f"{data}/sf0.001").collect())) == one[n], n
