"""Regression trees grown on counts of binned rows.

The splits, gains and leaves are those of MLlib's tree learner. Rows that share bins, class and side are one row with a count, and what is stored of
them is a few bytes each, packed into blobs. A level of a tree is one pass in which each task adds up its rows per node, feature and bin. The
tasks' sums are added up by Spark, or, as long as there are few, where they arrive. The driver sees sums only: nodes of a level x features x bins.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.session import materialise

FEATURES = "features"
SCORE = "score"
MAX_BINS = 32
CELLS_PER_TASK = 8192  # that one task adds up over all others
DRIVER_SUMS = 1 << 18  # sums of tasks that may reach the driver before they are added up
FOLDED_ROWS = 1 << 19
SAMPLED_ROWS = 10_000  # rows that thresholds are read from, as in MLlib
CHUNK_ROWS = 32_768
FIXED_BITS = 60
EPSILON = 2.0**-52
NOISE = 1e-13
STATS = 4  # rows, and over rows: weight, weight x value, weight x value squared
BINNED = "side string, id bigint, n bigint, bins binary, attack binary, rows binary, margin binary"
BINNED_SCHEMA = pa.schema([("side", pa.string()), ("id", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("bins", "attack", "rows", "margin")]])

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first; rows with a larger bin than ``bin`` go to ``left + 1``. A leaf's ``left`` is the leaf itself."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    stats: np.ndarray

    @property
    def values(self) -> np.ndarray:
        weight = self.stats[:, 1]
        return np.divide(self.stats[:, 2], weight, out=np.zeros(len(weight)), where=weight > 0)


@dataclass(frozen=True)
class Growth:
    """What one tree is grown by."""

    max_depth: int
    min_rows: int
    row_share: float
    feature_share: float
    seed: int
    first: bool  # fitted to the classes, not to residuals


@dataclass(frozen=True)
class BinnedRows:
    """Chunks of binned rows with their margins, and what is known of all of them. ``tasks``: how many read the chunks."""

    chunks: DataFrame
    tasks: int
    thresholds: list[np.ndarray]
    attack_weight: float
    scale: float


def split_points(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """MLlib's thresholds of a feature: midpoints of values, all or those nearest to equal weights."""
    distinct, which = np.unique(values, return_inverse=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) < MAX_BINS:
        return middles
    upto = np.cumsum(np.bincount(which, weights))
    stride = upto[-1] / MAX_BINS
    wanted, chosen = stride, []
    for k, middle in enumerate(middles):
        if abs(upto[k] - wanted) < abs(upto[k + 1] - wanted):
            chosen.append(middle)
            wanted += stride
    return np.array(chosen)


def thresholds_of(rows: DataFrame, n: int, attack_weight: float, target: str, seed: int) -> list[np.ndarray]:
    """Thresholds per feature from about ``SAMPLED_ROWS`` rows, which reach the driver; every row is then binned."""
    drawn = rows if n <= SAMPLED_ROWS else rows.sample(False, SAMPLED_ROWS / n, seed)
    told = drawn.select(F.coalesce((F.col(target) == 1), F.lit(False)).alias("attack"), vector_to_array(FEATURES).alias("x")).toArrow()
    weights = np.where(told["attack"].to_numpy(), attack_weight, 1.0)
    values = np.array(told["x"].to_pylist(), dtype=float).reshape(len(weights), -1)
    return [split_points(values[:, j], weights) for j in range(values.shape[1])]


def binaries(data: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix of bytes."""
    n, width = data.shape
    ends = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def folded(bins: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows for each distinct combination of bins and mark, in order of first appearance."""
    n, width = bins.shape
    padded = np.zeros((n, (width + 4 + 7) // 8 * 8), np.uint8)
    padded[:, :width] = bins
    padded[:, width : width + 4] = marks.astype(np.uint32).view(np.uint8).reshape(n, 4)
    words = padded.view(np.uint64)
    order = np.argsort(words[:, 0], kind="stable") if words.shape[1] == 1 else np.lexsort(words.T)
    ranked = words[order]
    starts = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)]))
    rows = np.diff(np.append(starts, n))
    first = order[starts]  # stable sorts leave the earliest row of a run in front
    appeared = np.argsort(first)
    return first[appeared], rows[appeared]


def keyed(thresholds: Sequence[np.ndarray]):
    """Rows with their features -> rows with the bins as one binary key, like rows of a stretch of ``FOLDED_ROWS`` as one with their number."""

    def flush(names: dict, held: list[tuple]) -> pa.RecordBatch:
        bins, marks = (np.concatenate(p) for p in zip(*held))
        first, rows = folded(bins, marks)
        sides = pa.array(list(names), pa.string()).take(pa.array(marks[first] >> 1))
        return pa.RecordBatch.from_arrays([sides, pa.array(marks[first] % 2 == 1), binaries(bins[first]), pa.array(rows)], ["side", "attack", "bins", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, waiting = {}, [], 0
        for batch in batches:
            if batch.num_rows:
                values = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                bins = np.empty(values.shape, np.uint8)
                for j, points in enumerate(thresholds):
                    bins[:, j] = np.searchsorted(points, values[:, j])
                coded = batch.column("side").dictionary_encode(null_encoding="encode")
                numbers = np.array([names.setdefault(s, len(names)) for s in coded.dictionary.to_pylist()], np.int64)
                attack = batch.column("attack").to_numpy(zero_copy_only=False)
                held.append((bins, numbers[coded.indices.to_numpy()] * 2 + attack))
                waiting += batch.num_rows
                if waiting >= FOLDED_ROWS:
                    yield flush(names, held)
                    held, waiting = [], 0
        if held:
            yield flush(names, held)

    return run


def packed(n_features: int):
    """Counted rows -> chunks of one side each: bins feature by feature, classes, counts and margins of zero as blobs."""

    def chunk(side, parts: list[tuple]) -> pa.RecordBatch:
        bins, attack, rows = (np.concatenate(p) for p in zip(*parts))
        blob = bins.tobytes()
        cells = [side, zlib.crc32(attack.tobytes(), zlib.crc32(blob)), len(rows), bins.T.tobytes(), attack.tobytes(), rows.tobytes(), bytes(8 * len(rows))]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, BINNED_SCHEMA)], schema=BINNED_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            sides = np.array(batch.column("side").to_pylist(), dtype=object)
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
            attack = batch.column("attack").to_numpy(zero_copy_only=False).astype(np.uint8)
            rows = batch.column("rows").to_numpy()
            for side in dict.fromkeys(sides):
                own = np.array([s is None for s in sides]) if side is None else sides == side
                parts = held.setdefault(side, [])
                parts.append((bins[own], attack[own], rows[own]))
                if sum(len(p[2]) for p in parts) >= CHUNK_ROWS:
                    yield chunk(side, held.pop(side))
        yield from (chunk(side, parts) for side, parts in held.items())

    return run


def bin_rows(table: DataFrame, fitted: DataFrame, attack_weight: float, target: str, seed: int, side: str | None = None) -> BinnedRows:
    """All rows of ``table`` by the thresholds of the ``fitted`` ones, counted and stored. Chunks hold the same rows in any run over the same table."""
    n, attacks = fitted.agg(F.count("*"), F.count_if(F.col(target) == 1)).first()
    if not n:
        raise ValueError("no rows to fit")
    points = thresholds_of(fitted, n, attack_weight, target, seed)
    named = F.lit(None).cast("string") if side is None else F.col(side).cast("string")
    slim = table.select(named.alias("side"), F.coalesce(F.col(target) == 1, F.lit(False)).alias("attack"), vector_to_array(FEATURES).alias("x"))
    bins = slim.mapInArrow(keyed(points), "side string, attack boolean, bins binary, rows bigint")
    counted = bins.groupBy("side", "bins", "attack").agg(F.sum("rows").alias("rows")).sortWithinPartitions("side", "bins", "attack")
    chunks = materialise(counted.mapInArrow(packed(len(points)), BINNED), "binned", block_mb=16)
    weight = (n - attacks) + attacks * attack_weight
    return BinnedRows(chunks, chunks.rdd.getNumPartitions(), points, attack_weight, 2.0 ** (FIXED_BITS - np.ceil(np.log2(16.0 * max(weight, 1.0)))))


def leaves(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node that each row reaches: bottom-up, every split chooses between what its two sides reach, by sums and products of bytes where they do."""
    n_nodes = len(tree.left)
    kind = np.uint8 if n_nodes <= 256 else np.uint16 if n_nodes <= 1 << 16 else np.uint32
    reached: list = list(np.arange(n_nodes, dtype=kind))
    for k in range(n_nodes - 1, -1, -1):  # children have larger numbers than their parent
        low = tree.left[k]
        if low != k:
            gap = np.subtract(reached[low + 1], reached[low], dtype=kind) if np.ndim(reached[low + 1]) or np.ndim(reached[low]) else kind(1)
            reached[k] = (bins[tree.feature[k]] > tree.bin[k]).astype(kind) * gap
            reached[k] += reached[low]  # whole numbers wrap, so the gap may be negative
            reached[low] = reached[low + 1] = None
    return np.broadcast_to(reached[0], bins.shape[1])


def depth_of(tree: Tree) -> int:
    level, depth = [0], -1
    while level:
        level, depth = [c for k in level if tree.left[k] != k for c in (tree.left[k], tree.left[k] + 1)], depth + 1
    return depth


def opened(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Side, id, bins, classes, counts and margins of each chunk of a batch."""
    return (opened_chunk(*r.values()) for r in batch.to_pylist())


def opened_chunk(side: str | None, own: int, n: int, bins: bytes, attack: bytes, rows: bytes, margin: bytes) -> tuple:
    arrays = np.frombuffer(bins, np.uint8).reshape(-1, n), np.frombuffer(attack, np.uint8), np.frombuffer(rows, np.int64), np.frombuffer(margin)
    return side, own, *arrays


def holding(binned: BinnedRows, chunks: DataFrame, max_depth: int) -> DataFrame | RDD:
    """The chunks kept by the executors, so a level is a job without a plan or a scan; as they are where a level has too many sums to bring together on the driver."""
    if binned.tasks * len(binned.thresholds) * MAX_BINS << max(max_depth - 1, 0) > DRIVER_SUMS:
        return chunks
    return chunks.select(*BINNED_SCHEMA.names).rdd.map(lambda r: (*r[:3], *map(bytes, r[3:]))).persist(StorageLevel.MEMORY_AND_DISK)


def let_go(chunks: DataFrame | RDD) -> None:
    if isinstance(chunks, RDD):
        chunks.unpersist()


def stages(margin: np.ndarray, bins: np.ndarray, trees: Sequence[Tree], steps: Sequence[float]) -> Iterator[np.ndarray]:
    """The margins after each of the trees."""
    for tree, step in zip(trees, steps):
        margin = margin + step * tree.values[leaves(tree, bins)]
        yield margin


def probabilities(margin: np.ndarray) -> np.ndarray:
    """MLlib's link from a boosted margin to P(attack)."""
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-2.0 * margin))


def level_sums(binned: BinnedRows, trees: Sequence[Tree], steps: Sequence[float], growing: Tree, open_nodes: Sequence[int], by: Growth):
    """Chunks -> this task's sums per open node, feature and bin: rows, attacks, and the two sums over values in whole multiples of ``1 / scale``."""
    slots = np.full(len(growing.left), len(open_nodes), np.int64)
    slots[list(open_nodes)] = np.arange(len(open_nodes))
    n_features, attack_weight, scale = len(binned.thresholds), binned.attack_weight, binned.scale
    width = (len(open_nodes) + 1) * MAX_BINS

    def run(chunks: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sums = np.zeros((STATS, n_features, width), np.int64)
        for _, own, bins, attack, rows, margin in chunks:
            y = np.where(attack == 1, 1.0, -1.0)
            value = y
            if not by.first:
                for margin in stages(margin, bins, trees, steps):
                    pass
                with np.errstate(over="ignore"):
                    value = 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
            if by.row_share < 1.0:
                draw = np.random.default_rng([by.seed, own])
                rows = (draw.random(len(rows)) < by.row_share).astype(float) if rows.max() == 1 else draw.binomial(rows, by.row_share).astype(float)
            else:
                rows = rows.astype(float)
            weight = np.where(attack == 1, attack_weight, 1.0) * rows
            attacks, first, second = rows * attack, weight * value, weight * value * value
            slot = slots[leaves(growing, bins)] * MAX_BINS
            for j in range(n_features):
                cell = slot + bins[j]
                sums[0, j] += np.bincount(cell, rows, width).astype(np.int64)
                sums[1, j] += np.bincount(cell, attacks, width).astype(np.int64)
                sums[2, j] += np.rint(np.bincount(cell, first, width) * scale).astype(np.int64)
                sums[3, j] += np.rint(np.bincount(cell, second, width) * scale).astype(np.int64)
        used = sums[:, :, : width - MAX_BINS].reshape(STATS, -1)
        cells = np.flatnonzero(used[0])
        if len(cells):
            yield cells, used[:, cells]

    return run


def of_batches(run):
    """What ``run`` makes of chunks, made of Arrow batches of them."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, used in run(chunk for batch in batches for chunk in opened(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(cells), *[pa.array(used[k]) for k in range(STATS)]], ["cell", "s0", "s1", "s2", "s3"])

    return told


def of_held(run):
    return lambda held: run(opened_chunk(*chunk) for chunk in held)


def impurities(stats: np.ndarray) -> np.ndarray:
    """Variance, from sums in the last axis."""
    weight = np.maximum(stats[..., 1], np.finfo(float).tiny)
    return (stats[..., 3] - stats[..., 2] * stats[..., 2] / weight) / weight


def best_split(cells: np.ndarray, thresholds: Sequence[np.ndarray], allowed: np.ndarray, min_rows: int):
    """Feature, bin, gain and both children's sums of a node's best split, the first of equals; None if no split gains."""
    upto = np.cumsum(cells, axis=1)
    left, whole = upto[:, :-1], upto[:, -1:]
    right = whole - left
    bins = np.arange(MAX_BINS - 1)
    valid = np.array([bins < len(t) for t in thresholds]) & allowed[:, None] & (left[..., 0] >= min_rows) & (right[..., 0] >= min_rows)
    if not valid.any():
        return None
    gains = impurities(whole) - left[..., 1] / whole[..., 1] * impurities(left) - right[..., 1] / whole[..., 1] * impurities(right)
    feature, at = np.unravel_index(np.argmax(np.where(valid, gains, -1.0)), gains.shape)
    floor = NOISE * whole[feature, 0, 3] / whole[feature, 0, 1]  # what rounding alone brings
    if not valid[feature, at] or gains[feature, at] <= floor:
        return None
    return feature, at, gains[feature, at], left[feature, at], right[feature, at]


def grow_tree(binned: BinnedRows, chunks: DataFrame | RDD, trees: Sequence[Tree], steps: Sequence[float], by: Growth) -> Tree:
    """The next regression tree over margins that are those stored plus ``trees``; a pass over the chunks per level."""
    n_features = len(binned.thresholds)
    feature, bin_, left, gain, stats, open_nodes = [0], [255], [0], [0.0], [np.zeros(STATS)], [0]
    made = lambda: Tree(np.array(feature), np.array(bin_), np.array(left), np.array(gain), np.array(stats))
    for level in range(max(1, by.max_depth)):
        n_cells = n_features * len(open_nodes) * MAX_BINS
        totals, run = np.zeros((STATS, n_cells), np.int64), level_sums(binned, trees, steps, made(), open_nodes, by)
        if isinstance(chunks, RDD):
            for cells, used in chunks.mapPartitions(of_held(run)).collect():
                totals[:, cells] += used
        else:
            sums = chunks.mapInArrow(of_batches(run), "cell bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
            if binned.tasks * n_cells > DRIVER_SUMS:  # a task has one row per cell, so there is nothing to fold before the shuffle
                whole = sums.repartition(-(-n_cells // CELLS_PER_TASK), "cell").groupBy("cell")
                sums = whole.agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATS)])
            found = sums.toArrow()
            for k in range(STATS):
                np.add.at(totals[k], found["cell"].to_numpy(), found[f"s{k}"].to_numpy())
        rows, attacks, first, second = totals
        cells = np.stack([rows, (rows - attacks) + attacks * binned.attack_weight, first / binned.scale, second / binned.scale], axis=1)
        cells = cells.reshape(n_features, len(open_nodes), MAX_BINS, STATS)
        if level == 0:
            stats[0] = cells[0, 0].sum(axis=0)
        following = []
        for slot, node in enumerate(open_nodes):
            taken = max(1, int(np.ceil(by.feature_share * n_features)))
            allowed = np.ones(n_features, bool)
            if taken < n_features:
                allowed[np.random.default_rng([by.seed, node]).permutation(n_features)[taken:]] = False
            split = best_split(cells[:, slot], binned.thresholds, allowed, by.min_rows) if by.max_depth else None
            if split is None:
                continue
            feature[node], bin_[node], gain[node], left[node] = int(split[0]), int(split[1]), float(split[2]), len(left)
            for part in split[3:]:
                if level + 1 < by.max_depth and impurities(part) > EPSILON:
                    following.append(len(left))
                feature.append(0), bin_.append(255), gain.append(0.0), left.append(len(left)), stats.append(part)
        open_nodes = following
        if not open_nodes:
            break
    return made()


def advanced(binned: BinnedRows, trees: Sequence[Tree], steps: Sequence[float]) -> BinnedRows:
    """The chunks with the margins after ``trees``, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for _, _, bins, _, _, margin in opened(batch):
                for margin in stages(margin, bins, trees, steps):
                    pass
                margins.append(margin.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margins, pa.binary())], schema=BINNED_SCHEMA)

    chunks = materialise(binned.chunks.mapInArrow(run, BINNED), "binned", block_mb=16)
    return replace(binned, chunks=chunks, tasks=chunks.rdd.getNumPartitions())


def staged_scores(binned: BinnedRows, trees: Sequence[Tree], steps: Sequence[float], start: int, side: str) -> DataFrame:
    """Positives and negatives of each (side, tree count, score) among the rows of a chunk, after each of ``trees``."""
    schema = pa.schema([(side, pa.string()), ("n_trees", pa.int32()), (SCORE, pa.float64()), ("pos", pa.int64()), ("neg", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, _, bins, attack, rows, margin in opened(batch):
                for k, staged in enumerate(stages(margin, bins, trees, steps), start + 1):
                    values, which = np.unique(probabilities(staged), return_inverse=True)
                    whole = np.bincount(which, rows, len(values)).astype(np.int64)
                    pos = np.bincount(which, rows * attack, len(values)).astype(np.int64)
                    columns = [[name] * len(values), np.full(len(values), k), values, pos, whole - pos]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return binned.chunks.mapInArrow(run, f"`{side}` string, n_trees int, {SCORE} double, pos bigint, neg bigint")


def regression_tree(spark: SparkSession, tree: Tree, thresholds: Sequence[np.ndarray]) -> DecisionTreeRegressionModel:
    """The MLlib model of a tree."""
    jvm, gateway, ml = spark._jvm, spark.sparkContext._gateway, spark._jvm.org.apache.spark.ml
    values, impurity = tree.values, impurities(tree.stats)

    def node(k: int):
        sums = gateway.new_array(jvm.double, 3)
        for i in range(3):
            sums[i] = float(tree.stats[k, i + 1])
        told = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(sums, int(tree.stats[k, 0]))
        if tree.left[k] == k:
            return ml.tree.LeafNode(float(values[k]), float(impurity[k]), told)
        j = int(tree.feature[k])
        split = ml.tree.ContinuousSplit(j, float(thresholds[j][tree.bin[k]]))
        return ml.tree.InternalNode(float(values[k]), float(impurity[k]), float(tree.gain[k]), node(tree.left[k]), node(tree.left[k] + 1), split, told)

    return DecisionTreeRegressionModel(ml.regression.DecisionTreeRegressionModel(f"dtr_{uuid4().hex[:12]}", node(0), len(thresholds)))
