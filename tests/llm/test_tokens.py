from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm import packing, token_records
from cuewright.llm.common import work_dir
from cuewright.llm.tokens import ChunkEncoder, encoder


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab Z.,'\n\t\r  é漢🙂<|endoftext|>0 1", max_size=60), max_size=5))
def test_chunks_encode_as_whole_texts(texts):
    e = encoder()
    assert e.encode(texts) == [e.whole(t) for t in texts]


def test_encoder_forgets_but_stays_exact():
    e = ChunkEncoder(keep=20)
    for k in range(30):
        texts = [f"alpha beta{k} gamma{k % 3}, delta", None, "x  y", " lead", "a\n \nb"]
        assert e.encode(texts) == [e.whole(t or "") for t in texts]


def _slow_crc(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = int(token_records._TABLE[(r ^ b) & 0xFF]) ^ (r >> 8)
    return r ^ 0xFFFFFFFF


def test_crc32c():
    assert token_records.crc32c([b"123456789"])[0] == 0xE3069283
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 3, 4, 5, 63, 64, 65, 128, 191, 193, 1000, 4097)]
    assert token_records.crc32c(parts).tolist() == [_slow_crc(p) for p in parts]


def _ids(text, end):
    e = encoder()
    return np.append(np.frombuffer(e.whole(text or ""), e.dtype).astype("<u4"), np.uint32(end))


def test_token_records(spark, awkward, nothing):
    rows = sorted(token_records.token_record_digests(awkward).collect(), key=lambda r: r["start"])
    given_rows = awkward.select("doc_id", "text").collect()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in given_rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    want = Counter((r["doc_id"], zlib.crc32(_ids(r["text"], 2).tobytes())) for r in given_rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == want
    assert token_records.token_record_digests(nothing).count() == 0


def test_records_by_number_and_damage(spark, awkward, tmp_path):
    folder = work_dir(spark, "records-test")
    files = token_records.write_token_records(awkward, folder).collect()
    fs, _ = token_records.open_fs(folder)
    name, n = max(((f["name"], f["records"]) for f in files), key=lambda x: x[1])
    every = list(token_records.read_records(fs, name))
    picked = list(token_records.read_records(fs, name, numbers=[n - 1, 0]))
    assert len(every) == n
    assert picked[0][0] == every[-1][0] and np.array_equal(picked[1][1], every[0][1])
    with open(name + ".records", "r+b") as f:
        f.seek(13)
        b = f.read(1)
        f.seek(13)
        f.write(bytes((b[0] ^ 1,)))
    with pytest.raises(ValueError, match="checksum"):
        list(token_records.read_records(fs, name))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), min_size=1, max_size=20))
def test_plan_holds_every_piece_once(counts):
    plan = packing.best_two_fit(counts, 40)
    held = Counter()
    for often, pieces in plan:
        assert often > 0 and sum(n * m for n, m in pieces) <= 40
        for n, m in pieces:
            held[n] += often * m
    assert held == Counter(counts)


def test_plan_prefers_the_tighter_pair():
    plan = packing.best_two_fit({60: 1, 30: 1, 22: 1, 17: 1}, 100)  # greedy 60+30 leaves 10; 60+22+17 leaves 1
    assert plan[0] == (1, [(60, 1), (22, 1), (17, 1)])


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, awkward, nothing, capacity):
    rows = packing.pack_documents(awkward, capacity=capacity).collect()
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    want = Counter()
    for r in awkward.collect():
        ids = _ids(r["text"], 0)
        cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert len(at) <= -(-sum(r["length"] for r in rows) // capacity) + 3
    assert packing.pack_documents(nothing).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(k, f"some words {'x ' * k}") for k in range(30)], "doc_id long, text string")
    rows = packing.packed_sequences(docs, capacity=32).collect()
    ids = Counter(i for r in rows for i in r["ids"])
    want = Counter(int(i) for k in range(30) for i in _ids(f"some words {'x ' * k}", 0))
    assert ids == want and all(len(r["ids"]) <= 32 for r in rows)
