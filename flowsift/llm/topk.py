"""Exact top-k by inner product on a bit-sliced index.

The vectors of a block are stored attribute by attribute as bit slices: bitmap j of an attribute has the j-th bit of
every row's quantised value. The score of all rows of a block for one query is then a sum of bitmaps with weights
that are powers of two, added by bitmap arithmetic (three bitmaps of one weight make a sum and a carry). The k-th
largest sum is read off from the most significant slice downward. Rows that could still reach it, given what the
quantisation has left out, are resolved by the exact product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.session import materialise

#: Rows of an index block and queries of a batch: the memory of one step.
BLOCK_ROWS = 16_384
BATCH_QUERIES = 256
#: Most significant bits of each attribute that are sliced.
SLICE_BITS = 7
#: Scores of vectors whose components are at most sqrt(2^62 / dimension) are exact in 64 bits; others are worked out in whole Python numbers,
#: a portion of rows at a time.
EXACT = float(1 << 62)
WIDE_ROWS = 1_000

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)

INDEX_SCHEMA = "block int, dim int, ids binary, vectors binary, lows binary, left_out int, slices binary, n int"
BATCH_SCHEMA = "batch int, dim int, query_rows binary, query_ids binary, queries binary"
HITS_SCHEMA = "query_row long, query_id long, vec_id long, score long"


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(row, key, parts, dim, wide) of the rows that take part: a key, no null and no non-finite component, also when scaled.

    ``parts`` are whole numbers, as doubles; ``wide`` rows have one that is too large for exact scores in 64 bits.
    """
    parts = F.transform(F.col(vector), lambda x: _floor(x.cast("double") * scale))
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), parts.alias("parts"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("parts").isNotNull() & F.forall("parts", fit))
    largest = F.coalesce(F.array_max(F.transform("parts", F.abs)), F.lit(0.0))
    dim = F.size("parts")
    return rows.withColumn("dim", dim).withColumn("wide", largest * largest * F.greatest(dim, F.lit(1)) >= EXACT)


def _floor(x: Column) -> Column:
    """The largest whole number not above ``x``, as a double: those of 2^53 and more are whole already."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _matrices(batches: Iterator[pa.RecordBatch], rows_each: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, rows, ids, matrix) of the vectors of a task (row, key, parts, dim), in portions of one dimension."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def joined(dim: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return (dim, *[np.concatenate(p) for p in zip(*held.pop(dim))])

    for batch in batches:
        rows, ids, dims = (batch.column(n).to_numpy() for n in ("row", "key", "dim"))
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            matrix = batch.column("parts").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
            held.setdefault(dim, []).append((rows[at], ids[at], matrix))
            if sum(len(r) for r, _, _ in held[dim]) >= rows_each:
                yield joined(dim)
    for dim in list(held):
        yield joined(dim)


def sliced(matrix: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(lows, bits left out, slices): slices[j, d] is the bitmap of bit j of the quantised attribute d."""
    rows, dim = matrix.shape
    lows = matrix.min(axis=0)
    raised = (matrix - lows).astype(np.int64)
    bits = max(1, int(raised.max(initial=0)).bit_length())
    left_out = max(0, bits - SLICE_BITS)
    kept = raised >> left_out
    words = -(-rows // 64)
    slices = np.zeros((bits - left_out, dim, words * 8), dtype=np.uint8)
    for j in range(bits - left_out):
        packed = np.packbits((kept >> j & 1).astype(np.uint8).T, axis=1, bitorder="little")
        slices[j, :, : packed.shape[1]] = packed
    return lows, left_out, slices.view(np.uint64)


def add_bitmaps(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Slices of the sum of bitmaps: ``columns`` has stacks of bitmaps by the power of two that they count for."""
    total, power = [], 0
    while columns:
        stacks, carries = columns.pop(power, []), []
        level = np.concatenate(stacks) if stacks else np.zeros((1, words), np.uint64)
        while len(level) > 1:
            third = len(level) // 3
            if third:
                a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                level = np.concatenate([half ^ c, level[3 * third :]])
            else:
                carries.append(level[:1] & level[1:])
                level = level[:1] ^ level[1:]
        total.append(level[0])
        power += 1
        if carries:
            columns.setdefault(power, []).extend(carries)
    return total


def kth_largest(total: list[np.ndarray], among: np.ndarray, k: int) -> int:
    """The k-th largest sum among the rows of a bitmap, zero if there are fewer; from the most significant slice down."""
    value, above, level = 0, 0, among
    for power in range(len(total) - 1, -1, -1):
        ones = level & total[power]
        count = int(np.bitwise_count(ones).sum())
        if above + count >= k:
            value |= 1 << power
            level = ones
        else:
            above += count
            level = level & ~total[power]
    return value


def at_least(total: list[np.ndarray], bound: int, among: np.ndarray) -> np.ndarray:
    """Bitmap of the rows whose sum is ``bound`` or more."""
    if bound.bit_length() > len(total):
        return np.zeros_like(among)
    more, equal = np.zeros_like(among), among
    for power in range(len(total) - 1, -1, -1):
        if bound >> power & 1:
            equal = equal & total[power]
        else:
            more = more | (equal & total[power])
            equal = equal & ~total[power]
    return more | equal


def stored_numbers(matrix: np.ndarray) -> bytes:
    """Whole numbers in 32 bits each if they fit, else in 64."""
    small = np.abs(matrix).max(initial=0) < 1 << 31
    return matrix.astype(np.int32 if small else np.int64).tobytes()


def whole_numbers(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * rows * dim else np.int64).reshape(rows, dim)


class Block:
    """A block of the index, as stored."""

    def __init__(self, row: dict):
        self.dim, self.left_out = row["dim"], row["left_out"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = whole_numbers(row["vectors"], len(self.ids), self.dim)
        self.words = -(-len(self.ids) // 64)
        bits = len(row["slices"]) // max(1, 8 * self.dim * self.words)
        self.slices = np.frombuffer(row["slices"], np.uint64).reshape(bits, self.dim, self.words)
        self.rows = self.bitmap(np.arange(len(self.ids)))

    def bitmap(self, at: np.ndarray) -> np.ndarray:
        flags = np.zeros(self.words * 64, np.uint8)
        flags[at] = 1
        return np.packbits(flags, bitorder="little").view(np.uint64)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the k best for a query, without its own id; ties to the smaller id.

        Negative weights use the complement of the slices, so that every sum is one of non-negative terms.
        """
        among = self.rows & ~self.bitmap(np.flatnonzero(self.ids == own))
        weights = np.abs(query.astype(np.int64))
        flips = np.where(query < 0, ONES, np.uint64(0))[:, None]
        columns: dict[int, list[np.ndarray]] = {}
        for shift in range(int(weights.max(initial=0)).bit_length()):
            dims = np.flatnonzero(weights >> shift & 1)
            for j in range(len(self.slices) if dims.size else 0):
                columns.setdefault(shift + j, []).append(self.slices[j, dims] ^ flips[dims])
        total = add_bitmaps(columns, self.words)
        slack = int(weights.sum()) * ((1 << self.left_out) - 1) >> self.left_out
        reach = at_least(total, max(0, kth_largest(total, among, k) - slack), among)
        at = np.flatnonzero(np.unpackbits(reach.view(np.uint8), bitorder="little"))
        scores = self.vectors[at].astype(np.int64) @ query.astype(np.int64)
        best = np.lexsort((self.ids[at], -scores))[:k]
        return at[best], scores[best]


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """The index: vectors are dealt evenly to blocks, and each block is sliced where it lands."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for dim, _, ids, floats in _matrices(batches, BLOCK_ROWS):
            matrix = floats.astype(np.int64)
            lows, left_out, slices = sliced(matrix)
            row = {
                "block": TaskContext.get().partitionId(), "dim": dim, "ids": ids.astype(np.int64).tobytes(),
                "vectors": stored_numbers(matrix), "lows": lows.astype(np.int64).tobytes(),
                "left_out": left_out, "slices": slices.tobytes(), "n": len(ids),
            }
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))

    return vectors.repartition(blocks).mapInArrow(build, INDEX_SCHEMA)


def query_batches(queries: DataFrame, batches: int) -> DataFrame:
    """Queries packed for transport, some hundreds to a row."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for number, (dim, own, ids, matrix) in enumerate(_matrices(rows, BATCH_QUERIES)):
            blobs = [own.astype(np.int64).tobytes(), ids.astype(np.int64).tobytes(), stored_numbers(matrix.astype(np.int64))]
            values = [(TaskContext.get().partitionId() << 10) + number, dim, *blobs]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["batch", "dim", "query_rows", "query_ids", "queries"])

    return queries.repartition(batches).mapInArrow(pack, BATCH_SCHEMA)


HITS = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def indexed_hits(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each index block for each query. Every batch of queries meets every block once."""
    blocks = max(1, math.ceil(vectors.count() / BLOCK_ROWS))
    index = materialise(build_index(vectors, blocks), "index")
    batches = materialise(query_batches(queries, max(1, math.ceil(queries.count() / BATCH_QUERIES))), "batches")

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                block = Block(row)
                own, ids = (np.frombuffer(row[c], np.int64) for c in ("query_rows", "query_ids"))
                asked = whole_numbers(row["queries"], len(ids), row["dim"])
                out: list[list[np.ndarray]] = [[], [], [], []]
                for number, key, query in zip(own.tolist(), ids.tolist(), asked):
                    at, scores = block.top(key, query, k)
                    for column, values in zip(out, (np.full(len(at), number), np.full(len(at), key), block.ids[at], scores)):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], schema=HITS)

    everywhere = batches.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return everywhere.join(index, ["block", "dim"]).mapInArrow(search, HITS_SCHEMA)


def portions(vectors: DataFrame, side: str) -> DataFrame:
    """Vectors packed as they are, some hundreds to a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows, ids, matrix in _matrices(batches, WIDE_ROWS):
            values = [dim, *[x.tobytes() for x in (rows.astype(np.int64), ids.astype(np.int64), matrix.astype(np.float64))]]
            names = ["dim", *[f"{side}_{n}" for n in ("rows", "ids", "parts")]]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), *[pa.binary()] * 3])], names=names)

    return vectors.mapInArrow(pack, f"dim int, {side}_rows binary, {side}_ids binary, {side}_parts binary")


def wide_hits(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each portion of vectors for each query, in whole numbers of any size. Scores beyond 64 bits count as the last one that fits."""
    least, most = -(1 << 63), (1 << 63) - 1

    def numbers(data: bytes, dim: int, rows: int) -> np.ndarray:
        return np.array([int(x) for x in np.frombuffer(data, np.float64)], dtype=object).reshape(rows, dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row, found = batch.slice(n, 1).to_pylist()[0], []
                own, keys, ids = (np.frombuffer(row[c], np.int64) for c in ("q_rows", "q_ids", "v_ids"))
                matrix = numbers(row["v_parts"], row["dim"], len(ids))
                for number, key, query in zip(own.tolist(), keys.tolist(), numbers(row["q_parts"], row["dim"], len(own))):
                    scores = [min(most, max(least, int(s))) for s in matrix @ query] if row["dim"] else [0] * len(ids)
                    best = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != key)[:k]
                    found += [(number, key, i, -s) for s, i in best]
                yield pa.RecordBatch.from_pylist([dict(zip(HITS.names, f)) for f in found], HITS)

    return portions(queries, "q").join(portions(vectors, "v"), "dim").mapInArrow(search, HITS_SCHEMA)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``vectors`` for each of ``queries`` (both row, key, parts, dim, wide): query_id, rank, vec_id, score.

    What leaves a pair of a query batch and an index block is k rows per query. A row of a query's own id is no candidate for it, vectors
    of other dimensions neither. Equal queries are answered each. Vectors with very large components are compared apart, exactly.
    """
    plain = vectors.filter("not wide")
    hits = indexed_hits(plain, queries.filter("not wide"), k)
    wide = vectors.filter("wide")
    if not wide.isEmpty():
        hits = hits.unionAll(wide_hits(wide, queries, k)).unionAll(wide_hits(plain, queries.filter("wide"), k))
    best = F.row_number().over(Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(table: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """Top ``k`` for the rows whose vec_id is divisible by ``every``, against all rows, by integer inner product.

    Null vectors and vectors with null or non-finite components take no part, nor do rows without an id. A
    vector without components has score 0. Repeated ids are rows of their own, but never found by their own id. Other columns take no part.
    """
    rows = materialise(quantised(table, "vec_id", "embedding", scale), "vectors")
    return top_k(rows, rows.filter(F.col("key") % every == 0), k)
