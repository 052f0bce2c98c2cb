"""Vector codes and the filter audit against brute force, and their odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidewatch.llm import filter_audit, vector_codes

VECTORS = "vec_id long, embedding array<double>, label string, x int, own int"


def vector_rows(n=300, length=32, seed=7):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, length))
    rows = [(i * 3, [float(v) for v in centres[i % 9] + r.normal(size=length) * 0.3], f"l{i % 4}" if i % 7 else None, 1, 2) for i in range(n)]
    rows += [(rows[i][0] + 1, rows[i][1], "copy", 1, 2) for i in range(0, n, 5)]
    rows += [(5, None, "a", 1, 2), (None, rows[3][1], "a", 1, 2), (8, [1.0, None] * (length // 2), "a", 1, 2), (11, [float("nan")] * length, "a", 1, 2), (14, [float("inf")] * length, "a", 1, 2)]
    return rows + [(17, [1.0, 2.0], "short", 1, 2), (20, [], None, 1, 2), (23, [1e30] * length, "far", 1, 2), rows[0]]


def lloyd(rows, entries, parts, rounds):
    """Whole-number Lloyd's rounds over all rows, one part at a time."""
    fine = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    big = 1 << 24
    x = lambda r: [int(np.floor(max(-big, min(big, v * 256)))) for v in r[1]]
    fine = sorted(((r[0] is None, r[0] or 0, x(r), r[0], r[2]) for r in fine), key=lambda r: r[:3])
    fine = [r for r in fine if len(r[2]) == len(fine[0][2])]
    length, books, codes, errors = len(fine[0][2]), [], [], []
    for p in range(parts):
        lo, hi = p * length // parts, (p + 1) * length // parts
        part = [r[2][lo:hi] for r in fine]
        book = part[:entries]
        near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            own = [near(v)[1] for v in part]
            groups = {k: [v for v, o in zip(part, own) if o == k] for k in range(len(book))}
            book = [[sum(c) // len(g) for c in zip(*g)] if (g := groups[k]) else e for k, e in enumerate(book)]
        found = [near(v) for v in part]
        books.append(book)
        codes.append([k for _, k in found])
        errors.append([d for d, _ in found])
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(r[3]), bytes(c).hex(), sum(e)) for r, c, e in zip(fine, zip(*codes), zip(*errors))), digest


@pytest.mark.parametrize("length,parts,entries,rounds", [(32, 16, 64, 2), (32, 5, 9, 4), (6, 16, 3, 3)])
def test_codes_equal_plain_lloyd(spark, length, parts, entries, rounds, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 4 * length * 37)
    rows = vector_rows(length=length)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got, book = vector_codes.compressed(df, carry=("label",), entries=entries, parts=parts, rounds=rounds)
    want, digest = lloyd(rows, entries, parts, rounds)
    assert sorted((str(r.vec_id), r.code, r.error) for r in got.collect()) == want
    assert vector_codes.digest(book) == digest


def test_few_or_no_vectors(spark):
    rows = vector_rows(n=5)[:5]
    got, book = vector_codes.compressed(spark.createDataFrame(rows, VECTORS))
    assert sorted((str(r.vec_id), r.code, r.error) for r in got.collect()) == lloyd(rows, 64, 16, 2)[0]
    assert all(len(b) == 5 for b in book)
    none, book = vector_codes.compressed(spark.createDataFrame([], VECTORS), carry=("label",))
    assert none.collect() == [] and none.columns == ["vec_id", "label", "code", "error", "rescanned"]


def test_heaps_give_out_only_violated_parts():
    r = np.random.default_rng(1)
    centres = r.integers(-9000, 9000, (8, 4))
    x = (centres[np.arange(4000) % 8] + r.integers(-40, 40, (4000, 4))).astype(np.int64)
    book = [x[:8]]
    block = vector_codes.Block(x, 1).first(book)
    drift, totals = np.zeros((1, 8)), 0
    for _ in range(3):
        totals = totals + np.concatenate([c.ravel() for c in block.change])
        book, moved = vector_codes._moved(book, totals)
        drift = drift + moved
        block = vector_codes.Block.unpacked(block.packed(), 1).again(book, drift)
        assert (block.own[0] == vector_codes._nearest(x, book[0])[0]).all()
        assert sum(map(len, block.heaps[0])) == 4000
    assert block.rescanned < 400  # of 12,000 in full scans


def test_label_errors_sum_null_labels_together(spark, tmp_path):
    rows = vector_rows(n=60)
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()
    kinds = {str(r[0]): r[2] for r in rows}
    by = {}
    for r in got:
        by.setdefault(kinds[str(r.vec_id)], set()).add(r.label_error)
    total = {}
    for r in got:
        total[kinds[str(r.vec_id)]] = total.get(kinds[str(r.vec_id)], 0) + r.error
    plain = {k for k in total if k not in ("a", "copy")}  # ids that stand once
    assert {k: by[k] for k in plain} == {k: {total[k]} for k in plain}


DOCS = "doc_id long, text string, lang string, source string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int, good int"


def audit_rows():
    r = random.Random(3)
    make = lambda n, v=900: " ".join(r.choice("abcdeFghij") + str(r.randrange(v)) for _ in range(n))
    texts = [make(r.randint(1, 400), r.choice([20, 900])) + r.choice(["", " #", " ÉÀ", "\t\x0b\x0c|"]) for _ in range(90)]
    texts += [make(240).upper(), "", None, "   ", "\xa0", make(20000)]
    rows = [(i, t, r.choice(["en", "de", None, ""]), "s", "clash", 1) for i, t in enumerate(texts)]
    copies = [(r.randrange(-50, 200), r.choice(texts[:20] + ["", None]), r.choice(["en", "fr"]), "s", "clash", 1) for _ in range(120)]
    rows += copies + [rows[4], rows[4], copies[7], (None, texts[4], "en", "s", "c", 1), (None, "only without an id", "en", "s", "c", 1), (None, "only without an id", "fr", "s", "c", 1)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1]), 5) for i in range(0, 95, 2)] + [(4, 1, None, 5), (4, 0, 0, 5), (None, 1, 1, 5)]
    return rows, labels


def brute(rows, labels):
    good, toxic = {d for d, q, _, _ in labels if q == 1 and d is not None}, {d for d, _, t, _ in labels if t == 1 and d is not None}
    rank = lambda d: (d is None, d or 0)
    least = {}
    for d, t, *_ in rows:
        least[t or ""] = min(least.get(t or "", (True, 1 << 70)), rank(d))
    docs = []
    for d, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": rank(d) > least[t] and least[t] != (True, 0)}
        docs.append((lang or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                early = [d for d in own if f in d[1] and d[1] & set(order[: step - 1])]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(early), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("chain", [1 << 24, 2000])
def test_audit_equals_brute_force(spark, chain, monkeypatch):
    monkeypatch.setattr(filter_audit, "CHAIN_BYTES", chain)
    rows, labels = audit_rows()
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(rows, labels)
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want and len(got) == len(want)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).collect() == []


def test_collision_chain_compares_texts():
    chains = filter_audit.Chains()
    assert chains.add(1, b"a", 5, "en", 0) == []
    assert chains.add(1, b"b", 9, "en", 1) == []  # the same hash, another text
    assert chains.add(1, b"a", 3, "de", 0) == [(5, "en", 16, 1)]
    assert chains.add(1, b"b", 9, "fr", 1) == []
    assert chains.add(1, b"b", None, "fr", 1) == [(None, "fr", 17, 1)]
    assert sorted(x[1:] for x in chains.least()) == [(b"a", 3, "de", 0, 1), (b"b", 9, "en", 1, 1), (b"b", 9, "fr", 1, 1)]
