import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.models import autodiff as ad
from tidewatch.models import autoencoders as ae
from tidewatch.models import artefacts, evaluation, forest, gateway
from tidewatch.operators import granger, sequence
from tidewatch.plans import catalog
from tidewatch.sources import generator
from tidewatch.streaming import stateful

SMALL = ae.Shape(length=6, features=4, width=8, heads=2, layers=2, feed=10, decoder=(9, 11), hidden=5, latent=3)


@pytest.mark.parametrize("make", [ae.Transformer, ae.Recurrent])
def test_gradients_equal_differences(make):
    r = np.random.default_rng(1)
    net, x = make(SMALL, 3), r.standard_normal((3, 6, 4))
    _, grads = net.loss(x)
    for name, w in net.w.items():
        for at in [tuple(r.integers(0, n) for n in w.shape) for _ in range(2)]:
            kept, step = w[at], 1e-5
            w[at] = kept + step
            up = net.loss(x)[0]
            w[at] = kept - step
            down = net.loss(x)[0]
            w[at] = kept
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-6, (name, at)


def test_sizes_and_training():
    assert ae.Transformer().size() == 116_176
    assert ae.Recurrent().size() == 106_852
    x = np.random.default_rng(0).standard_normal((64, 6, 1)) * np.ones((1, 1, 4))
    net = ae.Transformer(SMALL)
    before = net.errors(x).mean()
    assert net.fit(x, epochs=20, batch=16).errors(x).mean() < before


def test_linear_is_exact_in_its_subspace():
    r = np.random.default_rng(2)
    x = (r.standard_normal((50, 3)) @ r.standard_normal((3, 240))).reshape(50, 60, 4)
    assert ae.Linear(3).fit(x).errors(x).max() < 1e-20
    assert ae.Linear(2).fit(x).errors(x).max() > 1e-3


def test_forest_finds_outliers(spark):
    r = np.random.default_rng(3)
    rows = [(i, *map(float, r.standard_normal(2))) for i in range(400)] + [(1000, 9.0, 9.0), (1001, -9.0, 8.0), (1002, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {x.id: x.decision for x in forest.with_decision(df, forest.train(df, ["a", "b"]), ["a", "b"]).collect()}
    assert got.pop(1002) is None
    assert set(sorted(got, key=got.get)[:2]) == {1000, 1001}
    assert 0.03 < sum(v < 0 for v in got.values()) / len(got) < 0.06
    with pytest.raises(ValueError):
        forest.train(df.where("false"), ["a", "b"])


def _replayed(rows, g):
    """One request at a time."""
    out, held = [], {}
    for r in rows:
        buf, flags = held.setdefault(r.service_id, ([], []))
        x = [r.cpu_percent, r.latency_p99, r.error_rate, r.request_rate]
        if None not in x:
            buf.append(np.array(x, np.float32))
        last = buf[-60:]
        if len(last) == 60:
            e = float(g.sequence.errors(np.array([last]))[0])
            flags.append(e > g.sequence.threshold)
            out.append((min(1.0, e / g.sequence.threshold), len(flags) > 1 and all(flags[-2:])))
        elif last:
            d = float(g.forest.decisions(gateway.summaries(np.array(last, float))[None])[0])
            s = 1 / (1 + np.exp(5 * d))
            out.append((s, s > 0.7))
        else:
            out.append((0.0, False))
    return out


def test_gateway_equals_replay_and_stream(spark, tmp_path):
    rows = generator.series(spark, 2, 220).withColumn("cpu_percent", F.when(F.col("step") % 50 != 0, F.col("cpu_percent")))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    rows = spark.read.parquet(f"{tmp_path}/in/0")
    clean = rows.where("not is_anomaly")
    fitted = ae.fit(ae.Linear(), clean, None, "service_id", "step", most=200)
    model = forest.train(clean.na.drop(), ["cpu_percent", "latency_p99", "cpu_percent", "latency_p99", "cpu_percent", "error_rate", "request_rate"], trees=20)
    g = gateway.Gateway(fitted, model)
    got = gateway.score(rows, g, "service_id", "step").orderBy("service_id", "step").collect()
    want = _replayed(rows.orderBy("service_id", "step").collect(), g)
    assert len(got) == len(want) == 440
    assert all(abs(a.anomaly_score - b[0]) < 1e-6 and a.is_anomaly == b[1] for a, b in zip(got, want))
    assert {a.model_used for a in got} == {"NONE", "ISOLATION_FOREST", "LINEAR"}
    ticks = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/0")
    query = gateway.score_stream(ticks, g, order="step").writeStream.format("memory").queryName("gateway_out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = spark.table("gateway_out").orderBy("service_id", "step").collect()
    assert [(r.step, r.model_used, r.is_anomaly, r.anomaly_type) for r in streamed] == [(r.step, r.model_used, r.is_anomaly, r.anomaly_type) for r in got]


def test_gateway_on_nothing(spark):
    empty = generator.series(spark, 1, 5).where("false")
    assert gateway.score(empty, gateway.Gateway(None, None), "service_id", "step").count() == 0


def test_granger_equals_least_squares(spark):
    r = np.random.default_rng(5)
    n, lag = 200, 2
    x, y = r.standard_normal(n), np.zeros(n)
    for t in range(1, n):
        y[t] = 0.3 * y[t - 1] + 0.5 * x[t - 1] + r.standard_normal()
    df = spark.createDataFrame([(k, t, float(v[t])) for k, v in (("x", x), ("y", y), ("flat", np.ones(n))) for t in range(n)], "k string, t long, v double")
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "flat")], "src string, dst string")
    got = {(r.src, r.dst, r.lag): r for r in granger.tests(df, pairs, "k", "t", "v", maxlag=lag).collect()}
    assert got["x", "y", 1].causes and not got["y", "x", 1].causes
    assert got["x", "flat", 1].f_stat is None
    target = y[lag:]
    own = np.column_stack([np.ones(n - lag), y[1:-1], y[:-2]])
    both = np.column_stack([own, x[1:-1], x[:-2]])
    rss = [((target - a @ np.linalg.lstsq(a, target, rcond=None)[0]) ** 2).sum() for a in (own, both)]
    f = (rss[0] - rss[1]) / 2 / (rss[1] / (n - lag - 5))
    assert abs(got["x", "y", 2].f_stat - f) < 1e-6


@pytest.mark.parametrize("a, b, x", [(2.5, 1.5, 0.3), (40.0, 2.5, 0.9), (1.0, 1.0, 0.25)])
def test_beta_share(a, b, x):
    t = (np.arange(400_000) + 0.5) / 400_000
    density = t ** (a - 1) * (1 - t) ** (b - 1)
    assert abs(granger.beta_share(x, a, b) - density[t < x].sum() / density.sum()) < 1e-5


def test_ar1_stream_repeats_the_recurrence(spark, tmp_path):
    ticks = spark.range(600).select((F.col("id") % 3).alias("service_id"), F.expr("id div 3").alias("step"))
    for k in range(2):
        ticks.where(f"step div 100 = {k}").coalesce(1).write.parquet(f"{tmp_path}/{k}")
    live = spark.readStream.schema(ticks.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = stateful.ar1(live).writeStream.format("memory").queryName("ar1_out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("ar1_out").toPandas().sort_values(["service_id", "step"])
    noise = ticks.select("service_id", "step", stateful.hashed_normal("service_id", "step").alias("e")).toPandas().sort_values(["service_id", "step"])
    for k in range(3):
        want = generator.ar1(noise[noise.service_id == k].e.to_numpy() * np.sqrt(1 - 0.81), 0.9)
        assert np.allclose(got[got.service_id == k].x, want)
    assert abs(noise.e.std() - 1) < 0.1


@pytest.mark.parametrize("name", ["iforest_scores", "autoencoder_windows", "gateway_scores", "granger_pairs"])
def test_model_queries_give_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, f"{data}/sf0.001").count() > 0


def test_granger_pairs_are_all_tested(spark, data):
    kinds = {r.event_type for r in spark.read.parquet(f"{data}/sf0.01/events.parquet").select("event_type").distinct().collect()}
    got = {(r.src, r.dst) for r in catalog.granger_pairs(spark, f"{data}/sf0.01").collect()}
    assert sorted(got) == sorted((a, b) for a in kinds for b in kinds if a != b)


def test_threshold_covers_all_training_windows(spark):
    r = np.random.default_rng(4)
    raw = r.standard_normal((400, 4)) * 3 + 50
    raw[200:260] += 40
    rows = spark.createDataFrame([("a", k, *map(float, x)) for k, x in enumerate(raw)], "service_id string, step long, " + ", ".join(f"{m} double" for m in ae.METRICS))
    fitted = ae.fit(ae.Linear(2), rows, None, "service_id", "step", most=20)
    errors = fitted.errors(np.stack([raw[k : k + 60] for k in range(340)]))
    assert fitted.mean_error == pytest.approx(errors.mean()) and fitted.threshold == pytest.approx(errors.mean() + 3 * errors.std())


def test_autoencoder_query_trains_with_the_operators_parameters(spark, data, monkeypatch):
    asked = {}

    def fit(*given, **how):
        asked.update(how)
        raise InterruptedError

    monkeypatch.setattr(ae, "fit", fit)
    with pytest.raises(InterruptedError):
        catalog.autoencoder_windows(spark, f"{data}/sf0.001")
    assert asked == {}


def test_gateway_kept_and_loaded(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 60, 4))
    fitted = ae.Fitted(ae.Linear().fit(x), np.zeros(4), np.ones(4), 0.7, 0.1, 0.2)
    small = ae.Shape(length=60, width=8, heads=2, layers=1, feed=8, decoder=(8, 8))
    deep = ae.Fitted(ae.Transformer(small), np.zeros(4), np.ones(4), 0.7, 0.1, 0.2)
    grown = forest.train(spark.createDataFrame([(float(v),) for v in r.normal(size=200)], "x double"), ["x"], trees=5, per_tree=32)
    for i, model in enumerate((fitted, deep)):
        artefacts.save(spark, f"{tmp_path}/{i}", gateway.Gateway(model, grown))
        got = artefacts.load(spark, f"{tmp_path}/{i}")
        assert np.array_equal(got.sequence.errors(x), model.errors(x))
        assert (got.sequence.threshold, got.sequence.mean_error, got.sequence.std_error) == (0.7, 0.1, 0.2)
        points = r.normal(size=(50, 1))
        assert np.array_equal(got.forest.decisions(points), grown.decisions(points))
    assert artefacts.threshold(spark, f"{tmp_path}/0") == {"mean": 0.1, "std": 0.2, "threshold": 0.7}


def test_missing_artefacts_have_defaults(spark, tmp_path):
    fitted = ae.Fitted(ae.Linear().fit(np.random.default_rng(0).normal(size=(20, 60, 4))), np.zeros(4), np.ones(4), 0.7, 0.1, 0.2)
    artefacts.save(spark, str(tmp_path), gateway.Gateway(fitted, None))
    assert artefacts.load(spark, str(tmp_path)).forest is None
    shutil.rmtree(tmp_path / "threshold")
    assert artefacts.load(spark, str(tmp_path)).sequence.threshold == 1.0
    assert artefacts.threshold(spark, str(tmp_path)) == {"mean": 0.05, "std": 0.02, "threshold": 0.11}
    shutil.rmtree(tmp_path / "normalisation")
    assert artefacts.load(spark, str(tmp_path)).sequence is None


def test_replay_and_sweep_against_one_at_a_time(spark):
    length, n = 60, 90
    r = np.random.default_rng(1)
    x = r.normal(size=(2, n, 4))
    fitted = ae.Fitted(ae.Linear(components=3).fit(r.normal(size=(30, length, 4))), np.zeros(4), np.ones(4), 1.0, 0.0, 0.0)
    rows = [(f"s{k}", i, *map(float, x[k, i]), i == 70) for k in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "service_id string, step long, cpu_percent double, latency_p99 double, error_rate double, request_rate double, is_anomaly boolean")
    want = {(f"s{k}", i): (fitted.errors(x[k][None, i : i + length])[0], i <= 70 < i + length) for k in range(2) for i in range(n - length)}
    trace = evaluation.replay(df, fitted, "service_id", "step", "is_anomaly")
    got = {(r.service_id, r.start): (r.error, r.truth) for r in trace.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    limit = float(np.median([e for e, _ in want.values()]))
    for row in evaluation.sweep(trace, "service_id", "start", "error", "truth", limit, (1, 3)).collect():
        counts = dict.fromkeys(("tp", "fp", "fn", "tn"), 0)
        for k in range(2):
            streak = 0
            for i in range(n - length):
                e, truth = want[(f"s{k}", i)]
                streak = streak + 1 if e > limit else 0
                counts[("tp" if truth else "fp") if streak >= row.persistence else ("fn" if truth else "tn")] += 1
        assert {c: row[c] for c in counts} == counts


def test_evaluation_replay_counts_every_window_for_each_persistence(spark, data):
    """The later fifth of a service's rows (400 or so on sf0.01) gives rows - 60 windows."""
    rows = sequence.chronological_split(catalog._events(spark, f"{data}/sf0.01"), "service_id", "arrival_seq").where("part = 'val'")
    windows = sum(max(0, r["count"] - 60) for r in rows.groupBy("service_id").count().collect())
    got = catalog.evaluation_replay(spark, f"{data}/sf0.01").orderBy("persistence").collect()
    assert [r.persistence for r in got] == [1, 2, 3, 4, 5]
    assert all(r.tp + r.fp + r.fn + r.tn == windows > 0 for r in got)
    assert all(a.tp + a.fp >= b.tp + b.fp for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("scale", [1, 40])  # 40: scores beyond the exponential's range
def test_transformer_by_hand_equals_its_graph_and_builds_none(scale, monkeypatch):
    shape = ae.Shape(length=7, features=4, width=8, heads=2, layers=2, feed=10, decoder=(9, 11))
    net = ae.Transformer(shape)
    net.w = {k: v * scale if ".q." in k or ".k." in k else v for k, v in net.w.items()}
    x = np.random.default_rng(3).standard_normal((5, 7, 4))
    loss, grads = ae._Network.loss(net, x)
    errors = ae._Network.errors(net, x)

    def none(*_):
        raise AssertionError("a graph was built")

    monkeypatch.setattr(ae.ad, "softmax", none)
    got, mine = net.loss(x)
    assert got == pytest.approx(loss) and np.allclose(net.errors(x, batch=2), errors)
    assert mine.keys() == grads.keys() and all(np.allclose(mine[k], grads[k], atol=1e-9) for k in grads)
