"""The pipeline's stages against brute force."""

import hashlib

import corpus_pipeline
from tidewatch.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_keep_one_row_of_each_group(spark):
    make = lambda k, n=12: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [(None, make(0)), (None, make(1)), (None, make(1).upper()), (4, make(2)), (4, make(2)), (4, make(2)), (None, make(3)), (9, make(3)), (7, make(3)), (7, make(3) + " z"), (7, make(4)), (None, None), (None, "  "), (12, make(5, 40)), (11, make(5, 40) + " tail"), (None, make(5, 41))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    sets = [shingles(t) for _, t in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                top = [min(top[i], top[j]) if x in (top[i], top[j]) else x for x in top]
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    want = [min((r for r, t in zip(rows, top) if t == g), key=key) for g in set(top)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len(got) == len(want) and corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_run_keeps_rows_without_an_id(spark, tmp_path):
    make = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(i, make(i), "en", "s", 0) for i in range(40)] + [(None, make(99), "en", "s", 0), (5, make(5), "en", "s", 0), (5, make(5), "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    want = sorted({(i is None, i or 0, t) for i, t, *_ in rows})
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect()) == want
    names = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert None in names and 5 in names


CLASH = ["kept", "later", "starts", "digest", "n_words", "n_removed", "score", "_id", "row", "top", "times", "_c0", "a.b"]


def odd_rows():
    make = lambda k, n=70: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [(1, make(1)), (2, make(2)), (3, make(3) + " " + make(1)), (3, make(3) + " " + make(1)), (4, None), (5, ""), (None, make(6)), (None, None), (6, make(7, 20_000)), (7, make(8, 3)), (8, make(8, 3) + " é")]
    return [(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), *[f"{c}{k}" for c in CLASH]) for k, (i, t) in enumerate(texts)]


def test_stages_keep_columns_of_any_name_and_odd_rows(spark, tmp_path):
    rows = odd_rows()
    schema = SCHEMA + "".join(f", `{c}` string" for c in CLASH)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    others = lambda r: tuple(r)[5:]
    by = {r[5:]: r for r in rows}
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = sorted(out.collect(), key=key)
        for r in got:
            assert others(r) in by and tuple(r)[:1] + tuple(r)[2:4] == by[others(r)][:1] + by[others(r)][2:4], name
        if name == "toxicity":  # no toxic label: nothing goes
            assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in rows)
        if name == "near_duplicates":  # the copies of 3, and two of the three wordless rows
            assert [r.doc_id for r in got] == [1, 2, 3, 4, 6, 7, 8, None]
        if name == "repeated_passages":
            three = [r.text for r in got if r.doc_id == 3]
            assert three == [rows[2][1].split(" w1x")[0] + " "] * 2 and len(got) == len(rows)
            assert all(r.n_chars == len(r.text or "") for r in got)
        if name == "mixing":
            assert all((r.text or "").split() for r in got) and len({r.doc_id for r in got}) > 3
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.where("start = 0").count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_duplicates_go_by_fingerprints_and_by_shingles(spark):
    """Fingerprints count repeats, sets of shingles don't; groups take the links of both."""
    make = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    often = "one two three " * 300
    texts = [often + make(1, 8), often + make(2, 8), make(3), make(3) + " tail", make(4), often + make(2, 8) + " end", "", make(5), "four five six " * 300 + make(1, 8), None]
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    sets = [shingles(t) for t in texts]
    by = {"fingerprint": 0, "shingles": 0}
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 2
            like = sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0
            by["fingerprint"] += near and not like
            by["shingles"] += like and not near
            if near or like:
                top = [min(top[i], top[j]) if x in (top[i], top[j]) else x for x in top]
    assert min(by.values()) > 0
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == set(top) and 1 not in got
