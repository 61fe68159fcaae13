"""Precision-recall and ROC curves over every distinct score, without a single-task window.

Scores are counted per distinct value, placed in value ranges, and summed inside their range; what
lies above a range comes from the totals of the higher ranges. The range edges are quantiles of the
distinct scores, so a range holds about a fixed number of them however they cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from flowsift.functions.scalars import safe_ratio
from flowsift.schema import TARGET
from flowsift.session import materialise

SCORE = "score"
PREFIX_BITS = 12
ROWS_PER_RANGE = 2_000_000


def range_edges(counts: DataFrame, score: str = SCORE, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Inner edges that cut distinct scores, one row each, into ranges of about ``rows_per_range``.

    Scores are counted by sign, power of two and ``PREFIX_BITS`` bits below it, which is a table of bounded size whatever
    the number of scores; edges are the lowest scores of some of its rows. Their number follows that of the scores.
    """
    size = F.abs(F.col(score))
    power = F.when(size > 0, F.floor(F.log2(size)))
    digits = F.floor((size / F.pow(F.lit(2.0), power) - 1.0) * (1 << PREFIX_BITS))
    prefix = [F.signum(score).alias("_sign"), power.alias("_power"), digits.alias("_digits")]
    sized = counts.filter(F.col(score).isNotNull()).groupBy(*prefix).agg(F.count("*").alias("_n"), F.min(score).alias("_low"))
    before = Window.partitionBy(F.lit(0)).orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
    slot = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows_per_range)
    lows = sized.select("_low", slot.alias("_slot")).filter("_slot > 0").groupBy("_slot").agg(F.min("_low").alias("_low"))
    return sorted(float(r["_low"]) for r in lows.collect())


def place_in_ranges(df: DataFrame, edges: Sequence[float], score: str = SCORE, output: str = "range") -> DataFrame:
    """Number of edges at or below the score, found by binary search in the JVM."""
    if not edges:
        return df.withColumn(output, F.lit(0))
    bucketizer = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol=score, outputCol=output, handleInvalid="error"
    )
    return bucketizer.transform(df).withColumn(output, F.col(output).cast("int"))


def score_counts(df: DataFrame, score: str = SCORE, target: str = TARGET, by: Sequence[str] = ()) -> DataFrame:
    """Positive and negative rows per distinct score."""
    positive = F.col(target) == 1
    return df.groupBy(*by, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def cumulative_counts(
    df: DataFrame,
    score: str = SCORE,
    target: str = TARGET,
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Per distinct score: its own ``pos`` and ``neg``, and ``tp`` and ``fp`` at ``score`` and above.

    ``total_pos`` and ``total_neg`` count the whole group; ``next_pos`` and ``next_neg`` belong to the next
    lower score. The rows are counted once and the counts stored. The per-range totals join on the same columns the
    running sum is partitioned by, so both use one exchange.
    """
    counts = materialise(score_counts(df, score, target, by), "score_counts")
    return cumulate(counts, range_edges(counts, score, rows_per_range), score, by)


def cumulate(counts: DataFrame, edges: Sequence[float], score: str = SCORE, by: Sequence[str] = ()) -> DataFrame:
    """``cumulative_counts`` from counts per distinct score and ready range edges."""
    by = list(by)
    counts = place_in_ranges(counts, edges, score)
    place = [*by, "range"]
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    totals = counts.groupBy(*place).agg(
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
        F.max(F.struct(score, "pos", "neg")).alias("_head"),
    )
    higher = group.orderBy(F.desc("range"))
    above = higher.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *place,
        F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("above_pos"),
        F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("above_neg"),
        F.sum("_pos").over(group).alias("total_pos"),
        F.sum("_neg").over(group).alias("total_neg"),
        F.lead("_head").over(higher).alias("_below"),
    )
    inside = Window.partitionBy(*place).orderBy(F.desc(score))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(offsets, place).select(
        *by,
        F.col(score).alias("threshold"),
        "pos",
        "neg",
        (F.col("above_pos") + F.sum("pos").over(upto)).alias("tp"),
        (F.col("above_neg") + F.sum("neg").over(upto)).alias("fp"),
        "total_pos",
        "total_neg",
        F.coalesce(F.lead("pos").over(inside), F.col("_below.pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(inside), F.col("_below.neg")).alias("next_neg"),
    )


def with_precision_recall(cumulative: DataFrame) -> DataFrame:
    """Add precision and recall; without any positive row recall counts as 1."""
    return cumulative.withColumns(
        {
            "precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": safe_ratio(F.col("tp"), F.col("total_pos"), empty=1.0),
        }
    )


def pr_curve(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score, plus the end point (precision 1, recall 0) without a threshold."""
    columns = [*by, "threshold", "precision", "recall"]
    points = with_precision_recall(cumulative).select(*columns)
    groups = cumulative.select(*by).distinct() if by else cumulative.sparkSession.range(1)
    ends = groups.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(ends)


def roc_curve(cumulative: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """False and true positive rate per distinct score, starting at (0, 0) above all scores.

    By default points inside a straight segment are dropped: those whose score and the next lower one
    bring in the same numbers of positives and negatives. The first and the last score are always kept.
    """
    last = F.col("next_pos").isNull() | ((F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg")))
    bend = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
    kept = cumulative.filter(last | bend) if drop_intermediate else cumulative
    points = kept.select(
        F.col("threshold").cast("double").alias("threshold"),
        safe_ratio(F.col("fp"), F.col("total_neg")).alias("fpr"),
        safe_ratio(F.col("tp"), F.col("total_pos")).alias("tpr"),
    )
    start = cumulative.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def ranking_metrics(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision by the step rule and the area under the ROC curve by trapezoids, in one pass."""
    step = safe_ratio(F.col("pos"), F.col("total_pos")) * F.col("precision")
    slab = F.col("neg").cast("double") * (F.col("tp").cast("double") - F.col("pos").cast("double") / 2.0)
    area = F.col("total_pos").cast("double") * F.col("total_neg").cast("double")
    return (
        with_precision_recall(cumulative)
        .groupBy(*by)
        .agg(
            F.sum(step).alias("average_precision"),
            (F.sum(slab) / F.nullif(F.max(area), F.lit(0.0))).alias("roc_auc"),
            F.max("total_pos").alias("positives"),
            F.max("total_neg").alias("negatives"),
        )
    )


def operating_threshold(cumulative: DataFrame) -> DataFrame:
    """The smallest score with the highest F1; the end point has no score and takes no part."""
    p, r = F.col("precision"), F.col("recall")
    return (
        with_precision_recall(cumulative)
        .select("threshold", "precision", "recall", (2 * p * r / (p + r + F.lit(1e-9))).alias("f1"))
        .orderBy(F.desc("f1"), F.asc("threshold"))
        .limit(1)
    )
