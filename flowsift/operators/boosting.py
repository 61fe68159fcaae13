"""Gradient-boosted trees as MLlib's, on binned rows: fitting, staged evaluation, scoring, importance.

The workflow is early stopping on validation average precision, then a refit with the tree count found. MLlib
trees differ from other boosting libraries in leaf weights and sampling, so the scores do too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.operators.curves import SCORE, cumulate, range_edges, ranking_metrics, score_counts
from flowsift.operators.trees import FEATURES, Growth, advanced, bin_rows, grow_tree, holding, let_go, regression_tree, staged_scores
from flowsift.schema import TARGET
from flowsift.session import materialise, scratch_path
from flowsift.sources.tables import ensemble_nodes

MARGINS = "_margins"
LOSS_FLOOR = 1e-16


@dataclass(frozen=True)
class BoostingParams:
    """Fixed values of the training set-up; ``block_trees``: trees between two looks at the learning curve."""

    max_trees: int = 5000
    learning_rate: float = 0.05
    max_depth: int = 6
    row_share: float = 0.8
    feature_share: float = 0.8
    min_rows: int = 5
    patience: int = 50
    block_trees: int = 10
    seed: int = 42


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector beside the kept columns; a missing value is an error."""
    assembler = VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="error")
    return assembler.transform(df).select(*keep, FEATURES)


def growth(params: BoostingParams, number: int) -> Growth:
    """What the tree of a number, from 0, is grown by. Draws differ from tree to tree."""
    return Growth(params.max_depth, params.min_rows, params.row_share, params.feature_share, params.seed + number, number == 0)


def fit(
    assembled: DataFrame, weight: float, n_trees: int, params: BoostingParams = BoostingParams(), target: str = TARGET
) -> GBTClassificationModel:
    """Fit ``n_trees`` trees, as MLlib's boosted classifier does, on rows that are binned and counted once.

    Margins are stored every ``block_trees`` trees. The rows are read a few times before they are binned, so pass a written table, not a long
    plan. This is the refit with a known number of trees; ``grow`` finds that number.
    """
    spark = assembled.sparkSession
    binned = bin_rows(assembled, assembled, weight, target, params.seed)
    trees, steps, stored = [], [], 0
    held = holding(binned, binned.chunks, params.max_depth)
    for number in range(n_trees):
        if number - stored == params.block_trees:
            binned, stored = advanced(binned, trees[stored:], steps[stored:]), number
            let_go(held)
            held = holding(binned, binned.chunks, params.max_depth)
        trees.append(grow_tree(binned, held, trees[stored:], steps[stored:], growth(params, number)))
        steps.append(params.learning_rate if steps else 1.0)
    let_go(held)
    return boosted([regression_tree(spark, t, binned.thresholds) for t in trees], steps, len(binned.thresholds), spark)


def score_rows(model: GBTClassificationModel, assembled: DataFrame) -> DataFrame:
    """Probability of an attack per row, in place of the vector."""
    kept = [c for c in assembled.columns if c != FEATURES]
    return model.transform(assembled).select(*kept, vector_to_array("probability")[1].alias(SCORE))


def probability(margin: Column) -> Column:
    """MLlib's link from a boosted margin to P(attack)."""
    return 1.0 / (1.0 + F.exp(-2.0 * margin))


def add_tree(rows: DataFrame, tree: DecisionTreeRegressionModel, weight: float, margin: str, name: str) -> DataFrame:
    """Rows with one more margin, in a map-only projection."""
    scored = tree.copy().setPredictionCol("_tree").setFeaturesCol(FEATURES).transform(rows)
    return scored.withColumn(name, F.col(margin) + F.lit(float(weight)) * F.col("_tree")).drop("_tree")


def boosted(trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float], n_features: int, spark) -> GBTClassificationModel:
    """MLlib's boosted model over trees that were fitted one by one."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    held, shares = gateway.new_array(kind, len(trees)), gateway.new_array(jvm.double, len(trees))
    for k, (tree, weight) in enumerate(zip(trees, weights)):
        held[k], shares[k] = tree._java_obj, float(weight)
    uid = f"GBTClassifier_{trees[0].uid.split('_')[-1]}"
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, held, shares, n_features, 2))


def folded_counts(side: str, target: str, start: int):
    """Rows with the margins of a block -> positives and negatives of each (side, tree count, score) among the rows of a batch."""
    schema = pa.schema([(side, pa.string()), ("n_trees", pa.int32()), (SCORE, pa.float64()), ("pos", pa.int64()), ("neg", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            margins = batch.column(MARGINS).flatten().to_numpy().reshape(batch.num_rows, -1)
            attacks = batch.column(target).to_numpy(zero_copy_only=False) == 1
            sides = np.array(batch.column(side).to_pylist(), dtype=object)
            for name in set(sides):
                own = sides == name
                for stage in range(margins.shape[1]):
                    values, which = np.unique(1.0 / (1.0 + np.exp(-2.0 * margins[own, stage])), return_inverse=True)
                    pos = np.bincount(which[attacks[own]], minlength=len(values))
                    neg = np.bincount(which, minlength=len(values)) - pos
                    columns = [[name] * len(values), np.full(len(values), start + stage + 1), values, pos, neg]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return fold


def staged_counts(staged: DataFrame, start: int, side: str = "side", target: str = TARGET) -> DataFrame:
    """Positive and negative rows per side, tree count and distinct score of a block of trees, written once.

    A batch's rows are folded to its distinct scores, tree by tree, before anything is spread or shuffled.
    """
    slim = staged.select(F.col(side).cast("string").alias(side), target, MARGINS)
    return summed(slim.mapInArrow(folded_counts(side, target, start), f"`{side}` string, n_trees int, {SCORE} double, pos bigint, neg bigint"), side)


def summed(folded: DataFrame, side: str) -> DataFrame:
    counts = folded.groupBy(side, "n_trees", SCORE).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return materialise(counts, "staged_counts")


@dataclass(frozen=True)
class Grown:
    """What early stopping found: the curve as far as it went, the best tree count, the counts per score at it, and the trees up to it."""

    curve: DataFrame
    n_trees: int
    validation: DataFrame
    model: GBTClassificationModel


def grow(carved: DataFrame, weight: float, params: BoostingParams, side: str = "side", watched: str = "validation", target: str = TARGET) -> Grown:
    """Boost one tree at a time until ``patience`` trees bring no gain on the watched side, or ``max_trees``.

    Trees are fitted to the residuals of the margin so far, with the draws that ``fit`` makes for them, so no tree is fitted twice. All rows are
    binned by the thresholds of the fitted ones and counted once; margins are stored once a block, and until then follow from at most ``block_trees``
    trees, so plans do not grow with the number of trees. Both sides are scored in one pass a block. The curve has two rows per tree and passes
    through the driver.
    """
    spark = carved.sparkSession
    binned = bin_rows(carved, carved.filter(F.col(side) != watched), weight, target, params.seed, side)
    trees, steps, points, blocks = [], [], [], []
    while True:
        start = len(trees)
        fitted = holding(binned, binned.chunks.filter(F.col("side") != watched), params.max_depth)
        for number in range(start, min(start + params.block_trees, params.max_trees)):
            trees.append(grow_tree(binned, fitted, trees[start:], steps[start:], growth(params, number)))
            steps.append(params.learning_rate if steps else 1.0)
        let_go(fitted)
        blocks.append(summed(staged_scores(binned, trees[start:], steps[start:], start, side), side))
        points += [tuple(r) for r in learning_curve(blocks[-1], side).select(side, "n_trees", "average_precision", "log_loss").collect()]
        curve = spark.createDataFrame(points, f"{side} string, n_trees int, average_precision double, log_loss double")
        marked = mark_best(curve, params.patience, side, watched)
        best = best_tree_count(marked)
        if len(trees) >= params.max_trees or best + params.patience <= len(trees):
            break
        binned = advanced(binned, trees[start:], steps[start:])
    counts = blocks[(best - 1) // params.block_trees]
    chosen = counts.filter((F.col(side) == watched) & (F.col("n_trees") == best)).drop(side, "n_trees")
    model = boosted([regression_tree(spark, t, binned.thresholds) for t in trees[:best]], steps[:best], len(binned.thresholds), spark)
    return Grown(marked, best, chosen, model)


def learning_curve(counts: DataFrame, side: str = "side", rows_per_range: int = 2_000_000) -> DataFrame:
    """Average precision and mean log loss per side and tree count."""
    by = [side, "n_trees"]
    cumulative = cumulate(counts, range_edges(counts, SCORE, rows_per_range), SCORE, by)
    precision = ranking_metrics(cumulative, by).select(*by, "average_precision")
    p = F.greatest(F.lit(LOSS_FLOOR), F.least(F.lit(1.0 - LOSS_FLOOR), F.col(SCORE)))
    loss = F.sum(-(F.col("pos") * F.log(p) + F.col("neg") * F.log(1.0 - p)))
    losses = counts.groupBy(*by).agg((loss / F.sum(F.col("pos") + F.col("neg"))).alias("log_loss"))
    return precision.join(losses, by)


def mark_best(curve: DataFrame, patience: int, side: str = "side", watched: str = "validation") -> DataFrame:
    """Flag the tree count early stopping returns: the first maximum of validation average precision.

    Tree counts later than ``patience`` rounds without a gain are not looked at. One row per tree and side.
    """
    earlier = Window.partitionBy(side).orderBy("n_trees").rowsBetween(Window.unboundedPreceding, -1)
    gained = F.col("average_precision") > F.coalesce(F.max("average_precision").over(earlier), F.lit(-1.0))
    upto = Window.partitionBy(side).orderBy("n_trees").rowsBetween(Window.unboundedPreceding, 0)
    rounds = curve.withColumn("_gain", F.when(gained, F.col("n_trees")))
    rounds = rounds.withColumn("_last_gain", F.max("_gain").over(upto))
    stale = (F.col("n_trees") - F.col("_last_gain") >= patience).cast("int")
    rounds = rounds.withColumn("_stopped", F.coalesce(F.max(stale).over(earlier), F.lit(0)))
    best = F.max(F.when(F.col("_stopped") == 0, F.col("_gain"))).over(Window.partitionBy(side))
    return rounds.withColumn(
        "is_best", (F.col(side) == watched) & (F.col("n_trees") == best)
    ).drop("_gain", "_last_gain", "_stopped")


def best_tree_count(marked: DataFrame) -> int:
    return int(marked.filter("is_best").first()["n_trees"])


def split_gains(nodes: DataFrame) -> DataFrame:
    """Splits, total and mean gain per feature, from a saved ensemble's table of nodes.

    A split's gain is the drop in squared error that it brings: its node's drop in variance times the weight of the node's rows.
    """
    split = nodes.filter(F.col("nodeData.leftChild") >= 0).select(
        F.col("nodeData.split.featureIndex").alias("pos"), (F.col("nodeData.gain") * F.element_at("nodeData.impurityStats", 1)).alias("gain")
    )
    return split.groupBy("pos").agg(F.count("*").alias("splits"), F.sum("gain").alias("total_gain"), F.avg("gain").alias("mean_gain"))


def feature_importance(model: GBTClassificationModel, features: Sequence[str], spark, k: int = 15) -> DataFrame:
    """The ``k`` features with the largest mean gain per split, as shares of the sum over all features. A feature never split on has 0."""
    path = scratch_path(spark, "importance")
    model.write().save(path)
    named = spark.createDataFrame(list(enumerate(features)), "pos int, feature string")
    table = named.join(split_gains(ensemble_nodes(spark, path)), "pos", "left").fillna(0)
    share = F.col("mean_gain") / F.nullif(table.agg(F.sum("mean_gain")).scalar(), F.lit(0.0))
    return table.select("feature", F.coalesce(share, F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "feature").limit(k)
