"""Incidents and exact quantiles against brute force."""

import random

import numpy as np
import pytest

from tidewatch.operators import incidents, quantiles, sequence

EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("d", "d")]
ROWS = "service_id string, span_id long, detected_at long, note int"


def plain(rows, band, hops):
    """Union-find over all pairs."""
    near = {(s, s) for s, *_ in rows}
    reach = {(a, b) for a, b in EDGES}
    for _ in range(hops):
        near |= {(a, b) for a, b in reach} | {(b, a) for a, b in reach}
        reach |= {(a, d) for a, b in reach for c, d in EDGES if b == c} if hops > 1 else set()
        hops -= 1
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if None not in (a[0], a[2], b[0], b[2]) and abs(a[2] - b[2]) <= band and (a[0], b[0]) in near:
                up[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    return {r[1]: (r[1] if None in (r[0], r[2]) else min((x[2], x[1]) for x in g)[1]) for g in groups.values() for r in g}


@pytest.mark.parametrize("band,hops", [(7, 1), (7, 2), (40, 2), (1, 1)])
def test_incidents_equal_all_pairs(spark, band, hops):
    r = random.Random(band)
    rows = [(r.choice("abcdxq"), i, r.randrange(-300, 900), 1) for i in range(150)]
    rows += [("a", 500 + i, 100 + i % 3, 1) for i in range(40)] + [(None, 900, 5, 1), ("a", 901, None, 1)]
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    got = incidents.correlated(spark.createDataFrame(rows, ROWS).repartition(3), edges, band, hops)
    assert got.columns == ["service_id", "span_id", "detected_at", "note", "correlated_incident_id"]
    assert {x.span_id: x.correlated_incident_id for x in got.collect()} == plain(rows, band, hops)


def test_incident_summary_and_nothing(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    rows = spark.createDataFrame([("a", 3, 10, 1), ("b", 1, 12, 1), ("a", 2, 12, 1), ("q", 9, 11, 1)], ROWS)
    found = incidents.correlated(rows, edges, 5)
    got = {x.correlated_incident_id: tuple(x)[1:] for x in incidents.summary(found).collect()}
    assert got == {3: (10, 12, 3, 2, "a"), 9: (11, 11, 1, 1, "q")}
    assert incidents.correlated(rows.where("false"), edges, 5).collect() == []
    assert incidents.correlated(rows, edges.where("false"), 5).count() == 4


def test_quantiles_equal_percentile(spark):
    r = np.random.default_rng(3)
    rows = [("hot", float(round(v, 1))) for v in r.normal(size=3000)] + [("flat", 2.0)] * 500 + [("one", 7.5), ("none", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = {"low": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0}
    got = {x.k: tuple(x)[1:] for x in quantiles.quantiles(df, ["k"], "v", shares).collect()}
    want = {x.k: tuple(x)[1:] for x in df.groupBy("k").agg(*[sequence.F.percentile("v", q).alias(n) for n, q in shares.items()]).collect()}
    assert got == want
    assert quantiles.quantiles(df.where("false"), ["k"], "v", shares).collect() == []


def test_summary_of_unbounded_groups_is_the_same(spark):
    r = np.random.default_rng(4)
    rows = [(k, *map(float, r.normal(size=4))) for k in ("a", "b", None) for _ in range(200)]
    df = spark.createDataFrame(rows, "service_id string, cpu_percent double, latency_p99 double, error_rate double, request_rate double").repartition(3)
    one, many = (sorted(map(tuple, sequence.summary(df, ["service_id"], bounded=b).collect()), key=str) for b in (True, False))
    assert [x[0] for x in one] == [x[0] for x in many]
    assert np.allclose([x[1:] for x in one], [x[1:] for x in many])
