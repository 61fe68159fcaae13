import math

import numpy as np
import pytest

from flowsift.llm import topk
from flowsift.llm.topk import add_bitmaps, at_least, kth_largest, search_embeddings, sliced

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=10):
    fit = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in rows
           if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    out = []
    for q, v in fit:
        if q % 100 == 0:
            scores = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in fit if i != q and len(w) == len(v)))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in search_embeddings(df, **options).collect())


@pytest.mark.parametrize("seed", range(4))
def test_bitmap_sums(seed):
    random = np.random.default_rng(seed)
    matrix, weights = random.integers(-50, 60, (150, 5)), random.integers(0, 9, 5)
    lows, left_out, slices = sliced(matrix)
    assert left_out == 0
    columns = {}
    for shift in range(4):
        dims = np.flatnonzero(weights >> shift & 1)
        for j in range(len(slices) if dims.size else 0):
            columns.setdefault(shift + j, []).append(slices[j, dims])
    total = add_bitmaps(columns, slices.shape[2])
    sums = (matrix - lows) @ weights
    bits = [np.unpackbits(t.view(np.uint8), bitorder="little")[:150] for t in total]
    assert (sum((b.astype(np.int64) << n for n, b in enumerate(bits)), np.zeros(150, np.int64)) == sums).all()
    everyone = np.packbits(np.r_[np.ones(150, np.uint8), np.zeros(42, np.uint8)], bitorder="little").view(np.uint64)
    for k in (1, 10, 150):
        assert kth_largest(total, everyone, k) == np.sort(sums)[-k]
    bound = int(np.median(sums))
    assert int(np.bitwise_count(at_least(total, bound, everyone)).sum()) == int((sums >= bound).sum())


def test_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert found(df) == plain(df.collect())


def test_many_blocks_and_batches(spark, monkeypatch):
    random = np.random.default_rng(5)
    rows = [(i, (random.integers(-3, 4, 8) / 1024).tolist(), 0) for i in range(700)]  # many ties
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 90)
    monkeypatch.setattr(topk, "BATCH_QUERIES", 3)
    assert found(df) == plain(df.collect())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.25], 1), (100, [0.5, -0.25], None), (200, [], 0), (300, None, 0), (400, [nan, 1.0], 0), (500, [inf, 1.0], 0), (600, [None, 1.0], 0),
        (700, [1.0, 2.0, 3.0], 0), (1, [0.0, 0.0], 0), (2, [0.5, -0.25], 0), (2, [0.5, -0.25], 0), (None, [9.0, -9.0], 0), (3, [-0.001, 0.999], 0), (900, [0.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == plain(df.collect())
    assert search_embeddings(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [[20_000.0, 1e6], [3e7, -4e12], [1e30, -3e38]])
def test_large_components(spark, sizes):
    random = np.random.default_rng(7)
    rows = [(i, random.normal(size=6).astype(np.float32).tolist(), 0) for i in range(250)]
    for i in (0, 17, 100, 101, 200):
        rows[i][1][i % 6] = sizes[i % 2]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], f"{SCHEMA}, `row` string, key int").repartition(3)
    assert found(df) == plain(df.collect())


def test_columns_that_clash(spark):
    rows = [(i, [float(i % 7), 1.0], 0, "a", "b", 1, None) for i in range(120)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, parts string, score string, dim int, wide boolean")
    assert found(df) == plain(df.collect())
