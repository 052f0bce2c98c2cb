"""What long values may cost: the tokenizer's memo in bytes, the archive reader in time."""

import gzip
import io
import random
import time
import tracemalloc

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import tokens, warc


def runs(n, length, seed=1):
    """Texts without blanks: letters of many scripts, base64, punctuation."""
    r = random.Random(seed)
    kinds = ["".join(map(chr, range(0x4E00, 0x5800))), "abcdefghijklmnopqrstuvwxyzABC0123+/", "abcdefghijklmnopqrstuvwxyz", "!?.,;:-"]
    return ["".join(r.choices(kinds[k % 4], k=length)) for k in range(n)]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_memo_keeps_no_long_cuts(name):
    t, lib = tokens.MemoTokenizer(name), Tokenizer.from_file(tokens.tokenizer_path(name))
    for text, got in zip(runs(8, 3000), t.encode(runs(8, 3000))):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert max(map(len, t.memo), default=0) <= tokens.LONGEST and max(map(len, t.memo.ends), default=0) <= tokens.LONGEST
    tracemalloc.start()
    for k in range(5):
        t.encode(runs(40, 20_000, k))
    grown = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert grown < 1_000_000  # of 8 million bytes and more


def test_memo_starts_anew_at_its_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 40_000)
    t, lib = tokens.MemoTokenizer(tokens.BYTE_BPE), Tokenizer.from_file(tokens.tokenizer_path(tokens.BYTE_BPE))
    texts = [" ".join(f"w{k}x{j}" for j in range(50)) for k in range(60)]
    for text, got in zip(texts, t.encode(texts)):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids
        assert t.memo.held < 40_000 + 50 * 200 and len(t.memo) < 500


@pytest.mark.parametrize("packed", [False, True])
def test_reader_takes_time_in_proportion(packed):
    took = []
    for mb in (8, 64):
        payload = random.Random(3).randbytes(1 << 20) * mb
        raw = warc.record(7, "http://a", payload, None, False)
        raw = gzip.compress(raw, 1) if packed else raw
        raw = b"damaged" + raw + raw
        began = time.process_time()
        got = list(warc.salvage(io.BytesIO(raw)))
        took.append(time.process_time() - began)
        assert [g["gap"] is None for g in got] == [False, True, True] and got[0]["bytes"] == 7
        assert all(g["payload_bytes"] == mb << 20 for g in got[1:])
    assert took[1] < 8 * max(took[0], 0.15) * 2


def test_reader_on_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 50)
    r = random.Random(5)
    records = [warc.record(k, f"http://{k}", r.randbytes(r.randrange(0, 900)), None, False) for k in range(40)]
    for packed in (False, True):
        parts = [gzip.compress(x) if packed else x for x in records]
        parts[9] = parts[9][:-30]
        parts[20] = b"\0" * 77
        got = list(warc.salvage(io.BytesIO(b"".join(parts))))
        assert [g["page_id"] for g in got if g["gap"] is None] == [k for k in range(40) if k not in (9, 20)]
        assert sum(g["bytes"] for g in got) == sum(map(len, parts))
        assert np.all(np.diff([g["at"] for g in got]) > 0)
