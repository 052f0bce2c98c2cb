"""Operators of tidewatch.llm against brute force on small rows, and their odd cases."""

import hashlib
import io
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import hnsw, licences, mixing, packing, simhash, substrings, token_files, tokens, toxicity, warc, winnowing

WORDS = [f"w{i}x" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long"


def corpus():
    r = random.Random(4)
    make = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = make(70)
    texts = [make(r.randint(1, 200)) for _ in range(40)]
    texts += [texts[3], texts[3], make(30) + " " + shared + "\n" + make(20), shared + "  " + make(9), make(60) + "\t" + shared]
    texts += [None, "", "   ", "One", "The the\n\nthe. THE,  É'S I'll 12  <|endoftext|> \x00 x", make(9000), texts[5].replace("w1x", "w2x")]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, None, 7, 8) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[7], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def library(name):
    return Tokenizer.from_file(tokens.tokenizer_path(name))


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_memo_tokenizer_equals_library(name):
    t, lib = tokens.MemoTokenizer(name, memo=50), library(name)
    texts = [x[1] or "" for x in corpus()] + ["a  b   c", " \n x", "a \nb  \n c", "x.\ny z\n\nw", "it\n b", "q\n", "İ ﬃ Å á ́b ΑΣ", "a  b  c", "word%%% x''s a_b (y)", "a\u2028 b\u00a0", "\x01 \x1c b", "é\nÀ B\u2028c"]
    texts += ["a <|endoftext|> b", "<|startoftext|>A<|endoftext|>", "<|endoftext", "tab\t", " "]
    for _ in range(2):
        for text, got in zip(texts, t.encode(texts)):
            assert got.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert {tokens.BYTE_BPE: 50256, tokens.WORD_BPE: 49407}[name] in t.encode(["a <|endoftext|> b"])[0]


def test_packing_places_each_id_once(docs, empty):
    lib = library(tokens.WORD_BPE)
    pieces = packing.pack(docs, length=64).collect()
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = 0
    for seq, off, n in places:
        assert seq * 64 + off == at and off + n <= 64
        at += n
    want = sorted([*lib.encode(x[1] or "", add_special_tokens=False).ids, 1] for x in corpus())
    by = {}
    for p in sorted(pieces, key=lambda p: p.sequence_id * 64 + p.offset):
        if p.start == 0:
            by.setdefault(p.doc_id, []).append([])
        by[p.doc_id][-1] += p.ids
    assert sorted(x for v in by.values() for x in v) == want
    assert packing.pack(empty).count() == 0
    # The query's digest columns say the same.
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    digests = packing.pack(docs.withColumnRenamed("size", "before").withColumnRenamed("row", "ids"), length=64, emit="crc").collect()
    assert sorted((p.doc_id or -1, p.start, p.length, p.doc_tokens, p.ids_crc32) for p in digests) == sorted((p.doc_id or -1, p.start, p.length, p.doc_tokens, crc(p.ids)) for p in pieces)
    assert sorted((p.sequence_id, p.offset, p.length) for p in digests) == places
    assert {(p.doc_id, p.doc_tokens) for p in pieces} == {(x[0], len(lib.encode(x[1] or "", add_special_tokens=False).ids) + 1) for x in corpus()}


def test_hilbert_neighbours_touch():
    side = 4
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    key = packing.hilbert_index(cells, 2)
    assert sorted(key) == list(range(side**3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    lib = library(tokens.BYTE_BPE)
    path = f"file://{tmp_path}/t"
    clash = docs.withColumnRenamed("size", "ids").withColumnRenamed("row", "tie").withColumn("raw", F.lit(1)).withColumn("part", F.lit(1))
    token_files.write_tokens(clash, path)
    got = token_files.read_tokens(spark, path).collect()
    got.sort(key=lambda r: r.start)
    want = sorted([*lib.encode(x[1] or "", add_special_tokens=False).ids, 0] for x in corpus())
    assert sorted(r.ids for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i))
    sums = sorted(token_files.checksums(token_files.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in sums] == [(r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got]
    token_files.write_tokens(empty, f"{path}0")
    assert token_files.checksums(token_files.read_tokens(spark, f"{path}0")).count() == 0


def test_token_files_are_laid_out_for_selective_reads(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(40))) for i in range(6000)]
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    files = list(tmp_path.glob("t/*.parquet"))
    for f in files:
        meta = pq.ParquetFile(f).metadata
        cols = {meta.row_group(0).column(i).path_in_schema.split(".")[0]: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        assert "RLE_DICTIONARY" in cols["ids"].encodings and cols["ids"].has_offset_index and cols["doc_id"].has_column_index
        assert any(e.startswith(("DELTA", "RLE_DICTIONARY")) for e in cols["doc_id"].encodings)
    few = token_files.read_tokens(spark, path, F.col("doc_id").between(100, 102))
    assert sorted(r.doc_id for r in few.collect()) == [100, 101, 102]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan
    narrow = token_files.read_tokens(spark, path, columns=("doc_id", "start", "n_tokens"))
    assert "ids" not in narrow._jdf.queryExecution().executedPlan().toString()


def test_simhash_components(docs, empty):
    def fp(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, fp(t)) for i, t, *_ in corpus()]
    clash = docs.withColumnsRenamed({"size": "fp", "row": "component_id", "lang": "node", "n_chars": "root"})
    found = simhash.near_duplicates(clash.withColumn("row", F.lit(1))).collect()
    assert len(found) == len(rows)
    got = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in found}
    assert set(got) == set(rows)
    reach = {r: {r} for r in rows}
    for r in rows:
        todo = [r]
        while todo:
            x = todo.pop()
            new = {y for y in rows if (x[1] ^ y[1]).bit_count() <= 2} - reach[r]
            reach[r] |= new
            todo += new
        assert got[r] == min(i for i, _ in reach[r] if i is not None)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_of_dense_and_sparse_fingerprints(spark, monkeypatch):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(12)} | {base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}

    def sets(pairs):
        top = {x: x for x in fps}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            top[find(a)] = find(b)
        return sorted(sorted(y for y in fps if find(y) == x) for x in fps if find(x) == x)

    for large in (20_000, 20):
        monkeypatch.setattr(simhash, "LARGE", large)
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
        assert sets([(e.a % (1 << 64), e.b % (1 << 64)) for e in found.collect()]) == sets([tuple(p) for p in want])


def test_repeated_passages(docs, empty):
    rows = corpus()
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    key = lambda r: (r[0] is None, r)
    got = [tuple(r) for r in substrings.deduplicated(docs, texts=False).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    full = substrings.deduplicated(docs).collect()
    for r in full:
        assert hashlib.sha256(b" ".join(words(r.text))).hexdigest() == r.kept_sha256 and r.size in (7, None)
    assert substrings.deduplicated(empty).count() == 0


def test_passages_are_found_by_the_automaton_alone(spark, monkeypatch):
    r = random.Random(9)
    make = lambda n: [r.choice(WORDS) for _ in range(n)]
    shared = [make(60) for _ in range(6)]
    texts = [make(40) + shared[k % 6] + make(k) for k in range(24)]
    raw = [" ".join(t).encode() for t in texts]
    known = {b" ".join(s[k : k + 10]) for s in ([w.encode() for w in x] for x in shared) for k in range(51)}
    found = substrings._located(raw, substrings.Shard(known), 50, 10)
    whole = substrings._located(raw, substrings.Shard({b" ".join(t.split()[k : k + 10]) for t in raw for k in range(len(t.split()) - 9)}), 50, 10)
    for k, (at, *_) in enumerate(found):  # all windows inside the shared passage, at least
        assert set(range(40, 51)) <= set(at.tolist()) <= set(whole[k][0].tolist()) == set(range(len(texts[k]) - 49))
    assert all(len(at) == 0 for at, *_ in substrings._located(raw, substrings.Shard(set()), 50, 10))
    docs = spark.createDataFrame(list(enumerate(t.decode() for t in raw)), "doc_id long, text string")
    assert substrings.deduplicated(docs, texts=False).where("n_removed >= 60").count() == 18
    monkeypatch.setattr(substrings, "candidate_windows", lambda *a, whole=substrings.candidate_windows: whole(*a).where("false"))
    assert substrings.deduplicated(docs, texts=False).where("n_removed > 0").count() == 0


def test_passages_keep_columns_of_any_name(docs):
    clash = docs.withColumnsRenamed({"size": "kept", "row": "starts", "lang": "later", "n_chars": "digest"}).selectExpr("*", "1 as phrases", "2 as first", "3 as n_words", "4 as `a.b`")
    got = substrings.deduplicated(clash)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "text", "later", "source", "digest", "kept", "starts", "phrases", "first", "a.b"]
    assert {(r.kept, r.starts, r.phrases, r.first, r["a.b"]) for r in got.collect()} == {(7, 8, 1, 2, 4), (None, None, 1, 2, 4)}


def test_mixing_against_brute_force(docs, empty):
    shown = docs.select("*", F.lit("x").alias("source_no"), F.lit(1).alias("before"))
    documents, pieces, slots = mixing.mixture(shown, shard_slots=50, block=16)
    got = {r.row: r for r in mixing.taken_words(documents, pieces, slots).collect()}
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got.values()) == sorted((i is None, i, len(words(t))) for i, t, *_ in corpus())
    by = {}
    for r in sorted(got.values(), key=lambda r: (r.doc_id is None, r.doc_id, r.tie, r.row)):
        by.setdefault(r.source_no, []).extend([r.row] * r.size)  # the source's words, by their rows
    rows = sorted((r.source_no, r.slot, r.block_no, r.words, r.shard) for r in slots.collect())
    taken, seen = dict.fromkeys(got, 0), {}
    for source, slot, block, limit, _ in rows:
        for row in by[source][block * 16 : block * 16 + 16][:limit]:
            taken[row] += 1
        epoch = slot // -(-len(by[source]) // 16)
        assert block not in seen.setdefault((source, epoch), set())  # a permutation in each epoch
        seen[source, epoch].add(block)
    assert {k: r.taken for k, r in got.items()} == taken and len({x[4] for x in rows}) > 1
    total = sum(map(len, by.values()))
    target = {r.source_no: (r.target, r.source_size) for r in got.values()}
    assert abs(sum(t for t, _ in target.values()) - 1.5 * total) < 1e-6
    for source, (t, size) in target.items():
        assert size == len(by[source]) and t <= 2 * size + 1e-9
        assert sum(r.taken for r in got.values() if r.source_no == source) == int(t)
    assert all(r.taken <= 2 * r.size for r in got.values())
    again = mixing.taken_words(*mixing.mixture(docs, shard_slots=50, block=16)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in got.values())
    assert mixing.taken_words(*mixing.mixture(empty)).count() == 0


def test_output_shards_follow_the_draw(spark, docs, monkeypatch):
    documents, pieces, slots = mixing.mixture(docs, shard_slots=50, block=16)
    held = mixing.output_shards(pieces, slots).collect()
    dealt = mixing.taken_words(documents, pieces, slots, mixing.output_shards(pieces, slots)).collect()
    by = {}
    for r in held:
        by.setdefault(r.shard, []).append(r)
    for shard in by.values():  # words numbered without gaps, slots whole
        at = 0
        for r in sorted(shard, key=lambda r: r.offset):
            assert r.offset == at and r.words > 0
            at += r.words
    for r in dealt:
        own = [h for h in held if h.row == r.row]
        assert (r.taken, r.shards) == (sum(h.words for h in own), len({h.shard for h in own}))
        assert r.first_shard == min((h.shard for h in own), default=None)
    # Every source's counts by shard are its multinomial draw's.
    quota, n_shards = {}, max(8, -(-len({(s.source_no, s.slot) for s in slots.collect()}) // 50))
    for s in slots.collect():
        quota.setdefault(s.source_no, []).append(s.shard)
    for no, drawn in quota.items():
        rng = np.random.default_rng([11, no])
        want = np.bincount(rng.integers(n_shards, size=len(drawn)), minlength=n_shards) if len(drawn) < n_shards else rng.multinomial(len(drawn), np.full(n_shards, 1 / n_shards))
        assert np.bincount(drawn, minlength=n_shards).tolist() == want.tolist()
    one = lambda quotas, shards, seed: quotas.where("quota > 0").selectExpr("0L shard", "source_no", "0L first", "quota n")
    monkeypatch.setattr(mixing, "dealt_slots", one)
    flat = mixing.taken_words(*mixing.mixture(docs, shard_slots=50, block=16)).collect()
    assert {r.shards for r in flat} <= {0, 1} and max(r.shards for r in dealt) > 1


def test_resampled_shares_what_is_taken_among_repeated_rows(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10)), "a", 0) for i in range(300)]
    rows += [(7000 + i % 3, " ".join(["copy"] * 20), "a", i) for i in range(240)]
    rows += [(i, " ".join(["other"] * 30), "b", 0) for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int").repartition(3)
    target = {r.source: r.target for r in mixing.mixture(docs)[0].select("source", "target").distinct().collect()}
    out = mixing.resampled(docs).collect()
    for source, want in target.items():
        assert abs(sum(len(words(r.text)) for r in out if r.source == source) - want) < 0.06 * want
    again = mixing.resampled(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_resampled_keeps_columns_of_any_name(docs, empty):
    clash = docs.withColumnsRenamed({"size": "_id", "row": "taken", "lang": "times", "n_chars": "_tie"})
    got = mixing.resampled(clash.withColumn("a.b", F.lit(1)))
    assert got.columns == [*clash.columns, "a.b"]
    assert got.count() > 0 and {(r._id, r.taken) for r in got.collect()} <= {(7, 8), (None, None)}
    assert mixing.resampled(empty).count() == 0


def test_toxicity_learns_from_no_held_out_label(spark, tmp_path):
    docs = [(i, f"text {i} " + ("foul vile" if i % 3 == 0 else "calm kind")) for i in range(120)]
    held = {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert 10 < len(held) < 50
    tables = lambda flip: [(i, 1, int(i % 3 == 0) ^ int(flip and i in held)) for i in range(120)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    marked = [spark.createDataFrame(tables(flip), "doc_id long, quality int, toxic int") for flip in (False, True)]
    given, flipped = (toxicity.training_sample(d, x) for x in marked)
    assert given == flipped
    assert sorted(given) == sorted((t, int(i % 3 == 0)) for i, t in docs if i not in held)
    # A null label, one out of range and a null id teach nothing; a repeated label no more than its rows.
    odd = spark.createDataFrame([(1, 1, None), (2, 1, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.training_sample(d, odd) == []
    d.withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    marked[0].write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    net = toxicity.Network.__new__(toxicity.Network)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "train", lambda sample: seen.append(sample) or net)
        m.setattr(toxicity, "scored", lambda x, _: x.withColumn("score", F.col("doc_id") / 200))
        out = {r.doc_id: r for r in toxicity.op9_toxicity(spark, str(tmp_path)).collect()}
    assert seen == [given] and set(out) == set(range(120))
    assert all(r.held_out == (i in held) and r.predicted == int(r.score >= 0.5) for i, r in out.items())


def test_targets_by_water_filling(spark):
    rows = [("a", 100), ("b", 100), ("c", 1000), ("d", 10)]
    got = {r.source_key: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source_key string, source_size long")).collect()}
    left, open_, want = 1815.0, {"a": 5, "b": 2, "c": 1, "d": 5}, {}
    size = dict(rows)
    while True:
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = [k for k in open_ if share[k] > 2 * size[k]]
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 2.0 * size[k]
            left -= want[k]
            del open_[k]
    assert got == pytest.approx(want)


def winnowed(t):
    """[(position, hash)] in plain Python."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
    one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    turn = lambda h, k: (h << k | h >> 64 - k) & (1 << 64) - 1 if k else h
    grams = [turn(a, 2) ^ turn(b, 1) ^ c for a, b, c in zip(one, [*one[1:], 0], [*one[2:], 0, 0])][: max(1, len(w) - 2)]
    out = set()
    for lo in range(max(1, len(grams) - 7)) if grams else ():
        out.add(min(range(lo, min(lo + 8, len(grams))), key=lambda p: (grams[p] >> 28, -p)))
    return [(p, grams[p]) for p in sorted(out)]


def test_winnowing_brute_force(spark, docs, empty, tmp_path):
    clash = docs.withColumnsRenamed({"size": "tie", "row": "chosen", "lang": "doc_key", "n_chars": "edited"}).withColumn("_words", F.lit(1))
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    got = winnowing.op6_winnowing(spark, str(tmp_path)).collect()
    rows = [(i, t or "") for i, t, *_ in corpus()]
    assert len(got) == len(rows)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    after = dict(zip(order, [*order[1:], order[0]]))

    def digest(found):
        return hashlib.sha256(",".join(f"{p}:{h:X}" for p, h in found).encode()).hexdigest()

    def near(a, b):
        a, b = {h for _, h in a}, {h for _, h in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    want = []
    for i, t in rows:
        j, other = after[i, t]
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        a, b, c = winnowed(t), winnowed(edited), winnowed(other)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(a), digest(b), near(a, b), near(a, c), j, len(other)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert winnowing.with_edited(empty).count() == 0
    chosen = winnowing.fingerprints(docs.select("text"), "text", "chosen").collect()
    assert all([(s.position, s.hash % (1 << 64)) for s in r.chosen] == winnowed(r.text) for r in chosen if r.text)


def test_winnowing_takes_the_rightmost_of_equal_hashes(spark):
    df = winnowing.fingerprints(spark.createDataFrame([("a " * 20,)], "text string"), "text", "chosen")
    assert [s.position for s in df.first().chosen] == list(range(7, 18))


def test_licences(spark, empty):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "released under  the MIT licence!"), (3, None), (4, ""), (5, "Licensed under the Apache License, Version 2.0.\r\nLicensed under CC BY-NC 4.0."), (5, "word")]
    got = sorted((r.doc_id, r.licence, r.licence_lines) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.licence)
    assert got == [(1, "MIT", 1), (2, "MIT", 1), (5, "Apache-2.0", 2)]
    assert licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).count() == 6
    assert licences.scan(empty).count() == 0


def test_hnsw_recall_and_odd_vectors(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((900, 24))
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in x[i].astype(np.float32)]) for i in range(900)] + [(900, None), (920, [0.0] * 24), (940, [float("nan")] + [1.0] * 23), (960, [1.0, 2.0]), (980, []), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for q in hnsw.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=250).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    y = np.array([v for _, v in rows[:900]], np.float64)
    hit = total = 0
    assert set(got) == set(range(0, 900, 20))
    for i, found in got.items():
        s = y @ y[i]
        want = sorted((-s[j], j) for j in range(900) if j != i)[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s[j] - v) < 1e-9 for _, j, v in found)
        hit += len({j for _, j in want} & {j for _, j, _ in found})
        total += 20
    assert hit / total >= 0.95
    assert hnsw.nearest(df.where("vec_id < 0"), F.lit(True)).count() == 0


def test_hnsw_repeated_ids_ties_and_clashing_columns(spark):
    unit = [[float(i == j) for j in range(8)] for i in range(8)]
    rows = [(i, unit[i % 8]) for i in range(40)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    twice = plain.union(plain).union(spark.createDataFrame([(5, [9.0] * 8), (5, unit[5])], plain.schema))
    clash = twice.select("*", F.lit(1).alias("key"), F.lit(2).alias("rank"), F.lit(3).alias("dim"), F.lit(4).alias("shard"))
    got = {}
    for r in hnsw.nearest(clash, F.col("vec_id") % 20 == 0, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    five = {r.vec_id: r.score for r in hnsw.nearest(clash, F.col("vec_id") == 5, k=39).collect()}
    big = five[0] == 9.0  # of the two vectors of row 5 one is kept, whichever has the smaller hash
    for q in (0, 20):
        like = [(i, 1.0) for i in range(q % 8, 40, 8) if i != q]
        rest = [(i, 0.0) for i in range(40) if i % 8 != q % 8 and not (big and i == 5)]
        assert got[q] == ([(5, 9.0)] * big + like + rest)[:6]
    assert sorted(five) == [i for i in range(40) if i != 5]


def test_hnsw_memory_is_bounded_for_wide_vectors():
    x = np.random.default_rng(1).standard_normal((1500, 768))
    tracemalloc.start()
    hnsw.Graph(x).build()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6


def test_warc_salvage():
    records = [warc.record(i, f"http://h/{i}", f"<p>{i}</p>".encode() * 50, 9, i % 3 == 2) for i in range(12)]
    for pack in (lambda b: b, lambda b: zlib.compress(b, 3, 31)):
        parts = [pack(r) for r in records]
        whole = b"".join(parts)
        assert [x["page_id"] for x in warc.salvage(io.BytesIO(whole))] == list(range(12))
        hurt = bytearray(whole)
        at = sum(map(len, parts[:4])) + len(parts[4]) // 2
        hurt[at : at + 6] = b"\xff" * 6
        found = list(warc.salvage(io.BytesIO(b"junk" + bytes(hurt)[: -len(parts[11]) // 2])))
        assert [x["page_id"] for x in found if x["gap"] is None] == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]
        gaps = [x for x in found if x["gap"]]
        assert [x["at"] for x in gaps] == [0, 4 + sum(map(len, parts[:4])), 4 + sum(map(len, parts[:11]))]
        assert gaps[1]["bytes"] == len(parts[4])


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "u", big), (2, "u", big), (7, None, big), (3, "u", "s"), (4, "u", "s"), (5, "u", None), (None, "u", "t" * 2000), (8, "u v", "é" * 800)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    folder = f"file://{tmp_path}/w"
    got = warc.read_archives(warc.write_archives(warc.with_revisits(pages), folder), folder).collect()
    assert not [r for r in got if r.gap]
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(0, 2000, "response", None), (1, 1500, "revisit", 7), (2, 1500, "revisit", 7), (3, 1, "response", None), (4, 1, "response", None), (5, 0, "response", None), (7, 1500, "response", None), (8, 1600, "response", None)]
    assert all(r.payload_digest == hashlib.sha1((dict((a, c) for a, _, c in rows)[r.page_id] or "").encode()).hexdigest() for r in got)


def test_warc_query_on_odd_tables(spark, tmp_path):
    big = "y" * 2000
    rows = [(3, "u", big, 1), (3, "u", big, 1), (2, "u", big, 1), (2, "u", big, 1), (1, None, None, 1), (1, None, None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").select("*", F.lit(1).alias("payload"), F.lit(2).alias("revisit"), F.lit(3).alias("refers_to"))
    pages.write.parquet(f"{tmp_path}/some/pages.parquet")
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op10_warc_salvage(spark, f"{tmp_path}/some").collect())
    assert got == [(1, 0, "response", None)] * 2 + [(2, 2000, "revisit", 3)] * 2 + [(3, 2000, "response", None)] * 2
    assert warc.op10_warc_salvage(spark, f"{tmp_path}/none").count() == 0


def test_warc_query_fails_if_a_record_is_lost(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(9)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    whole = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a: whole(*a).where("page_id is null or page_id <> 4"))
    with pytest.raises(ValueError, match="8 of 9"):
        warc.op10_warc_salvage(spark, str(tmp_path))


def test_toxicity_learns_and_its_gradients_are_right(docs, empty):
    r = random.Random(3)
    samples = []
    for i in range(400):
        t = [r.choice(WORDS) for _ in range(r.randint(20, 150))]
        if i % 3 == 0:
            for _ in range(6):
                t[r.randrange(len(t))] = r.choice(["vile", "nasty", "awful"])
        samples.append((" ".join(t), int(i % 3 == 0)))
    net = toxicity.train(samples[:320])
    score = toxicity.Scorer(net).score([t for t, _ in samples[320:]])
    assert np.mean((score >= 0.5) == np.array([y for _, y in samples[320:]])) >= 0.9
    got = toxicity.scored(docs, net).collect()
    assert len(got) == len(corpus()) and all(0 <= x.score <= 1 and x.size in (7, None) for x in got)
    assert toxicity.scored(empty, net).count() == 0 and toxicity.train([]).base == 0

    small = toxicity.Network({b"a": 1}, 1)
    vec = np.random.default_rng(1).standard_normal((5, toxicity.EMBED)).astype(np.float32)
    vec[0] = 0
    rows, y, w = np.array([[1, 2, 3], [4, 1, 0]]), np.array([1.0, 0.0], np.float32), np.ones(2, np.float32)
    g, _ = small.gradients(vec, rows, y, w)

    def loss():
        s = small.forward(small.projected(vec), rows)
        return float(np.mean(np.logaddexp(0, s) - y * s))

    for k in ("uf", "wb", "attend", "query", "out"):
        at = tuple(0 for _ in small.p[k].shape)
        old = small.p[k][at]
        small.p[k][at] = old + 1e-2
        up = loss()
        small.p[k][at] = old - 1e-2
        down = loss()
        small.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3


@pytest.mark.parametrize("large, block", [(20_000, 1_000), (3, 2)])
def test_similar_groups_against_brute_force(spark, empty, monkeypatch, large, block):
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(11)
    texts = []
    for k in range(24):
        base = [r.choice(WORDS) for _ in range(r.randint(60, 300))]
        texts.append(" ".join(base))
        for edits in (1, 2, 9, 12)[: k % 5]:  # some likenesses above the limit, some below
            copy = list(base)
            for at in r.sample(range(len(base)), edits):
                copy[at] = "new"
            texts.append(" \n".join(copy).upper())
    line = "same words again and again here " * 40
    texts += [line + "one tail", line + "another end of a text", None, "", " ", "two words", "Two WORDS", "a " * 3000]
    rows = [(i, t, None, None, None, 7, 8) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None, 1, 1), (None, texts[5], None, None, None, 1, 1)]
    got = simhash.similar_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]

    def classes(least):
        top = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) > 0:
                    top = [min(top[i], top[j]) if x in (top[i], top[j]) else x for x in top]
        return top

    # No link below the limit; every link well above it (at the limit, some pairs never meet).
    loose, tight, found = classes(0.8), classes(0.9), {}
    for x in got:
        found.setdefault(x.component_id, set()).add(5 if x.doc_id is None else x.doc_id)
    own = {i: c for c, members in found.items() for i in members}
    assert sorted(own) == list(range(len(texts))) and len(got) == len(texts) + 2
    assert all(c == min(members) for c, members in found.items())
    assert all(len({loose[i] for i in members}) == 1 for members in found.values())
    assert all(own[i] == own[tight[i]] for i in own)
    assert sum(own[i] != loose[i] for i in own) <= 2
    assert simhash.similar_groups(empty).count() == 0


@pytest.mark.parametrize("large, block, part", [(20_000, 1_000, 1_000_000), (3, 2, 300)])
def test_similar_groups_find_every_link_at_the_limit(spark, monkeypatch, large, block, part):
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PART", part, raising=False)
    r = random.Random(5)
    make = lambda n: [r.choice(WORDS) for _ in range(n)]
    pairs = []
    for k in range(60):  # prefixes of 8 of 9 words share 4 of 5 shingles; and longer texts at 0.8
        pairs.append((k_ := make(9), k_[:8]))
        pairs.append((k_ := make(14), k_[:12]))
        pairs.append((k_ := make(94), k_[:76]))
    for _ in range(60):  # one word changed in the middle: 5 shingles of each are its own
        base = make(49)
        pairs.append((base, [*base[:20], "new", *base[21:]]))
    pairs += [(k_ := make(9), k_[:7]) for _ in range(20)]  # 3 of 5: below the limit
    crowd = make(120)
    texts = [" ".join(t) for p in pairs for t in p] + [" ".join([*crowd[:k], "x", *crowd[k + 1 :]]) for k in range(60)]
    got = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    want = {i: i - i % 2 for i in range(480)} | {i: i for i in range(480, 520)} | {i: 520 for i in range(520, 580)}
    assert {x.doc_id: x.component_id for x in got} == want


def test_toxicity_reads_long_words_whole():
    r = random.Random(2)
    base = "".join(r.choice("abcdefghij") for _ in range(400))
    net = toxicity.Network({b"a": 1}, 1)
    for n in (3, 63, 64, 65, 66, 67, 126, 127, 400):
        pieces = toxicity.words_of(f"x {base[:n]} y")[1:-1]
        assert max(map(len, pieces)) <= 64 and b"".join(p[2 * (k > 0) :] for k, p in enumerate(pieces)) == base[:n].encode()
        inside = {p[k : k + 3] for p in pieces for k in range(len(p) - 2)}
        assert {base[k : k + 3].encode() for k in range(n - 2)} <= inside
    got = toxicity.Scorer(net).logits([base, base[:100] + "vile" + base[104:], base[:390] + "vile" + base[394:], "語" * 90, "語" * 89 + "毒"])
    assert len(set(got.tolist())) == 5 and toxicity.words_of("a " * 70) == [b"a"] * 70


def test_licence_passages_against_every_window(spark):
    """The best coefficient over all windows, those before a template's first bigram too."""
    rng = random.Random(5)
    plain = lambda x: re.sub(r"[^a-z0-9]+", " ", re.sub("[0-9]+", "0", x.lower())).split()
    header = licences.TEMPLATES["GPL-3.0-header"].split()
    texts = ["z " * 40 + " ".join(header[:n]) + " some other words follow here" for n in (13, 14, 15, 16, 18)]
    for _ in range(20):
        wording = rng.choice(sorted(licences.TEMPLATES.values())).split()
        cut = rng.randrange(len(wording))
        texts.append(" ".join(rng.choices(["a", "b", "the"], k=30) + wording[cut // 3 :] + rng.choices(["a", "z z z", "of the"], k=20)))
    got = licences.passages(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), 0.6, licences.TEMPLATES)
    got = {(r.row, r.licence): r.dice for r in got.collect()}
    want = {}
    for row, text in enumerate(texts):
        w = plain(text)
        g = list(zip(w, w[1:]))
        for name, wording in licences.TEMPLATES.items():
            x = plain(wording)
            t, n = set(zip(x, x[1:])), len(x) - 1
            best = max(2 * len(set(g[k : k + n]) & t) / (len(set(g[k : k + n])) + len(t)) for k in range(len(g)))
            if best >= 0.6:
                want[row, name] = best
    assert got == pytest.approx(want) and (0, "GPL-3.0-header") in got


def test_licences_ties_long_texts_and_clashing_columns(spark):
    filler = " ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20_000))
    rows = [(1, f"{filler}\nReleased under the MIT License.\n{filler}"), (2, "Released under the BSD License.\nReleased under the MIT License."), (2, "Released under the BSD License.\nReleased under the MIT License."), (3, f"{filler} Licensed under CC BY-SA 4.0. {filler}"), (None, "Licensed under CC BY-NC 4.0.\n" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("row"), F.lit("x").alias("licence"), F.lit(2.0).alias("dice"), F.lit(3).alias("line"))
    got = sorted(((r.doc_id, r.licence, r.dice, r.licence_lines) for r in licences.scan(docs).collect()), key=str)
    assert got == [(1, "MIT", 1.0, 1), (2, "BSD-notice", 1.0, 2), (2, "BSD-notice", 1.0, 2), (3, "CC-BY-SA-4.0", 1.0, 0), (None, "CC-BY-NC-4.0", 1.0, 3)]


def test_licences_inside_lines_and_over_line_breaks(spark):
    filler = " ".join(f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    gpl = "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n"
    rows = [
        (1, "Released under the MIT License. See the LICENSE file for more details."),
        (2, f"{filler} licensed under the Apache License, Version 2.0. {filler}"),
        (3, gpl + filler),
        (4, f"{filler}\nReleased under the\r\nMIT License."),
        (5, f"Licensed under CC BY-NC 4.0.\nand released\nunder the MIT License.\n{filler}"),
        (6, f"a license of {filler} version {filler}"),
        (7, "Licensed under CC BY-NC 4.0 now."),
        (8, "under the License\nReleased under the MIT License.\nunder the MIT"),
    ]
    got = {r.doc_id: (r.licence, r.dice, r.licence_lines) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MIT", 1.0, 0) and got[4][:2] == ("MIT", 1.0) and got[2] == ("Apache-2.0", 1.0, 0)
    assert got[3][0] == "GPL-3.0-header" and got[3][1] == 1.0  # its second line alone reaches 0.6
    assert got[5][:2] == ("CC-BY-NC-4.0", 1.0) and got[6] == (None, None, 0)
    assert got[7] == ("CC-BY-NC-4.0", 1.0, 1) and got[8][:2] == ("MIT", 1.0)
