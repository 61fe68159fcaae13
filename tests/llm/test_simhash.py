import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from flowsift.llm import simhash
from flowsift.llm.components import components
from flowsift.llm.simhash import BITS, RADIUS, covering_masks, free_places, keep_one, simhash_classes
from tests.llm.conftest import WORD, lowered


def plain_fingerprint(text):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = np.zeros(64, dtype=np.int64)
    for s, n in Counter(shingles).items():
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones += n * np.array([h >> k & 1 for k in range(64)])
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def plain_classes(rows):
    prints = np.array([plain_fingerprint(r.text) for r in rows], dtype=np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= RADIUS):
            root[find(i)] = find(int(j))
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    return [(r.doc_id, f"{int(p):016x}", low.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints))]


def test_every_pair_within_the_radius_agrees_under_a_mask():
    pick = random.Random(3)
    masks = covering_masks(list(range(BITS)), RADIUS)
    assert len(masks) == 15
    for outer in (0, *masks):
        places = free_places(outer)
        inner = covering_masks(places, RADIUS)
        assert all(not m & outer for m in inner) and max(len(free_places(m | outer)) for m in inner) <= (16 if outer else 33)
        for _ in range(2000):
            change = sum(1 << p for p in pick.sample(places, pick.randrange(RADIUS + 1)))
            assert any(not change & m for m in inner)


def test_documents(documents):
    assert Counter(tuple(r) for r in simhash_classes(documents).collect()) == Counter(plain_classes(documents.collect()))


def test_odd_documents(odd_documents):
    wanted = plain_classes(odd_documents.collect())
    assert Counter(tuple(r) for r in simhash_classes(odd_documents).collect()) == Counter(wanted)
    kept = keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == len({(c, None if c is not None else p) for _, p, c in wanted})


def test_crowded_buckets_are_dealt_out_again(documents, monkeypatch):
    wanted = Counter(plain_classes(documents.collect()))
    monkeypatch.setattr(simhash, "BUCKET", 2)
    assert Counter(tuple(r) for r in simhash_classes(documents).collect()) == wanted


def test_one_of_each_class_stays(documents):
    wanted = {c for _, _, c in plain_classes(documents.collect())}
    kept = keep_one(documents).collect()
    assert sorted(r.doc_id for r in kept) == sorted(wanted)


def test_empty(empty_documents):
    assert simhash_classes(empty_documents).count() == 0 and keep_one(empty_documents).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(-60, 60), pick.randrange(-60, 60)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)] + [(300, k) for k in range(301, 340)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    low = {x: x for e in edges for x in e}
    while any(low[a] != low[b] for a, b in edges):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: low[x] for x in linked}
