import zlib
from collections import defaultdict

import numpy as np

from flowsift.llm.sharding import jump_hash, shard_documents, shard_rows


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_plain_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    for shards in (1, 2, 24, 25, 1000):
        assert jump_hash(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def check(rows, source):
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (d.doc_id is None, d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in source
    )
    slots = defaultdict(list)
    by_key = defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        by_key[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_key.values())


def test_documents(documents):
    rows = shard_documents(documents, 24).collect()
    check(rows, documents.collect())
    assert len({r.shard for r in rows}) == 24


def test_odd_documents(odd_documents):
    check(shard_documents(odd_documents, 24).collect(), odd_documents.collect())


def test_empty(empty_documents):
    assert shard_documents(empty_documents, 24).count() == 0


def test_rows_keep_their_columns_and_clashing_ones_are_replaced(odd_documents):
    out = shard_rows(odd_documents, ["doc_id"], 7)
    assert [c for c in odd_documents.columns if c != "shard"] == out.columns[:-2] and out.columns[-2:] == ["shard", "grown_shard"]
    assert dict(out.dtypes)["shard"] == "int"
