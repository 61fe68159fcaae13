"""Partial aggregates over Arrow batches: each task hands on one row, or a few, whatever the number of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Fold = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

MOMENTS_TYPE = "n bigint, means array<double>, products array<double>"
MOMENTS_SCHEMA = pa.schema([("n", pa.int64()), ("means", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])


def co_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, means and centred cross products (row by row of the square) of the rows that have every value.

    A batch is shifted by its first row before it is centred, so constant columns give exact zeros and large means cost no digits.
    Batches are merged by their means.
    """
    n, means, products = 0, None, None
    for batch in batches:
        matrix = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)
        matrix = matrix[~np.isnan(matrix).any(axis=1)]
        if not len(matrix):
            continue
        shifted = matrix - matrix[0]
        centre = shifted.mean(axis=0)
        own = shifted - centre
        m, mean, product = len(matrix), matrix[0] + centre, own.T @ own
        if n:
            step = mean - means
            products = products + product + np.outer(step, step) * (n * m / (n + m))
            means, n = means + step * (m / (n + m)), n + m
        else:
            n, means, products = m, mean, product
    if n:
        yield pa.RecordBatch.from_pylist([{"n": n, "means": means.tolist(), "products": products.ravel().tolist()}], MOMENTS_SCHEMA)


def smallest_values(k: int) -> Fold:
    """Up to ``k`` rows: the ``k`` smallest distinct values of every column, each sorted for itself; nulls fill up."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Array] | None = None
        schema = None
        for batch in batches:
            schema = batch.schema
            found = []
            for i, column in enumerate(batch.columns):
                values = column.drop_null() if best is None else pa.concat_arrays([best[i], column.drop_null()])
                values = pc.unique(values)
                found.append(values.take(pc.array_sort_indices(values)[:k]))
            best = found
        if best is not None:
            rows = max(map(len, best))
            full = [v if len(v) == rows else pa.concat_arrays([v, pa.nulls(rows - len(v), v.type)]) for v in best]
            yield pa.RecordBatch.from_arrays(full, schema=schema)

    return fold
