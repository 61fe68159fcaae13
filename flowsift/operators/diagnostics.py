"""Confusion counts, reports, threshold sweeps, histograms and calibration of scored rows.

Each takes one row per scored row, or rows that stand for several: then ``rows`` names the column that says for how many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.functions.scalars import safe_ratio
from flowsift.operators.curves import SCORE, place_in_ranges
from flowsift.schema import TARGET


def total(rows: str | None, where: Column | None = None) -> Column:
    """How many scored rows there are, or those that meet a condition."""
    weight = F.lit(1).cast("long") if rows is None else F.col(rows)
    return F.coalesce(F.sum(weight if where is None else F.when(where, weight)), F.lit(0).cast("long"))


def rows_of_counts(counts: DataFrame, score: str = SCORE, target: str = TARGET, rows: str = "rows") -> DataFrame:
    """Counts per distinct score (``pos``, ``neg``) as rows of score, target and number."""
    sides = F.array(*[F.struct(F.lit(k).alias(target), F.col(c).alias(rows)) for k, c in ((1, "pos"), (0, "neg"))])
    return counts.select(score, F.inline(sides)).filter(F.col(rows) > 0)


def predict(df: DataFrame, threshold: float, score: str = SCORE) -> DataFrame:
    """Add the 0/1 decision: score at or above the threshold."""
    return df.withColumn("prediction", (F.col(score) >= F.lit(threshold)).cast("int"))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """The three measures, 0 where a denominator is empty."""
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return precision, recall, safe_ratio(2.0 * precision * recall, precision + recall)


def confusion(
    df: DataFrame, threshold: float, score: str = SCORE, target: str = TARGET, rows: str | None = None
) -> DataFrame:
    """Confusion counts at a threshold with precision, recall and F1 of the attack class."""
    flagged, attack = F.col(score) >= F.lit(threshold), F.col(target) == 1
    counts = df.agg(
        total(rows, flagged & attack).alias("tp"),
        total(rows, flagged & ~attack).alias("fp"),
        total(rows, ~flagged & attack).alias("fn"),
        total(rows, ~flagged & ~attack).alias("tn"),
    )
    measures = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns(dict(zip(("precision", "recall", "f1"), measures)))


def confusion_matrix(
    df: DataFrame, threshold: float, score: str = SCORE, target: str = TARGET, rows: str | None = None
) -> DataFrame:
    """Four cells (actual, predicted, n), empty ones included."""
    counts = confusion(df, threshold, score, target, rows)
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
        for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ]
    return counts.select(F.inline(F.array(*cells)))


def classification_report(
    df: DataFrame, threshold: float, score: str = SCORE, target: str = TARGET, digits: int = 4
) -> DataFrame:
    """Measures and support per class, accuracy, and their plain and support-weighted means."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    counts = confusion(df, threshold, score, target).select("tp", "fp", "fn", "tn")
    attack, benign = precision_recall_f1(tp, fp, fn), precision_recall_f1(tn, fn, fp)
    attacks, benigns = tp + fn, tn + fp
    total = attacks + benigns
    rows = [("Benign (0)", benign, benigns), ("Attack (1)", attack, attacks)]
    accuracy = safe_ratio(tp + tn, total)
    rows.append(("accuracy", (F.lit(None), F.lit(None), accuracy), total))
    rows.append(("macro avg", tuple((b + a) / 2.0 for b, a in zip(benign, attack)), total))
    weighted = tuple(safe_ratio(b * benigns + a * attacks, total) for b, a in zip(benign, attack))
    rows.append(("weighted avg", weighted, total))
    entries = [
        F.struct(
            F.lit(name).alias("row"),
            *[F.round(m.cast("double"), digits).alias(n) for n, m in zip(("precision", "recall", "f1"), measures)],
            support.alias("support"),
        )
        for name, measures, support in rows
    ]
    return counts.select(F.inline(F.array(*entries)))


def sweep_grid(threshold: float) -> list[float]:
    """0.01 to 0.99 by 0.01, and the operating threshold at six decimals."""
    return sorted({i / 100 for i in range(1, 100)} | {round(float(threshold), 6)})


def threshold_sweep(
    df: DataFrame, threshold: float, score: str = SCORE, target: str = TARGET, rows: str | None = None
) -> DataFrame:
    """Confusion counts and measures at every threshold of the grid, from one pass over the scores.

    Each row is placed between two thresholds by binary search, counts per place are at most 101 rows,
    and a running sum from the top gives what lies at or above each threshold.
    """
    grid = sweep_grid(threshold)
    positive = F.col(target) == 1
    placed = place_in_ranges(df, grid, score, "place")
    counts = placed.groupBy("place").agg(total(rows, positive).alias("pos"), total(rows, ~positive).alias("neg"))
    slots = df.sparkSession.createDataFrame([(0, None)] + list(enumerate(grid, start=1)), "place int, threshold double")
    filled = slots.join(counts, "place", "left").na.fill(0, ["pos", "neg"])
    all_rows = Window.partitionBy(F.lit(0))
    at_least = all_rows.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    tp, fp = F.sum("pos").over(at_least), F.sum("neg").over(at_least)
    swept = filled.select(
        "threshold",
        tp.alias("tp"),
        fp.alias("fp"),
        (F.sum("pos").over(all_rows) - tp).alias("fn"),
        (F.sum("neg").over(all_rows) - fp).alias("tn"),
    ).filter("threshold IS NOT NULL")
    p, r, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    near = F.abs(F.col("threshold") - threshold) <= F.lit(1e-8 + 1e-5 * abs(threshold))
    return swept.select(
        F.round("threshold", 6).alias("threshold"),
        "tp",
        "fp",
        "fn",
        "tn",
        F.round(p, 6).alias("precision"),
        F.round(r, 6).alias("recall"),
        F.round(f1, 6).alias("f1"),
        near.alias("is_operating_point"),
    )


def confidence_histogram(
    df: DataFrame, score: str = SCORE, target: str = TARGET, bins: int = 50, rows: str | None = None
) -> DataFrame:
    """Rows per equal-width bin and true class, empty bins included; each class spans its own scores.

    The last bin is closed on the right, and a class with one distinct score gets a unit-wide range around it.
    """
    spans = df.filter(F.col(target).isin(0, 1)).groupBy(target).agg(F.min(score).alias("low"), F.max(score).alias("high"))
    flat = F.col("low") == F.col("high")
    spans = spans.select(
        target,
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("high")).otherwise(F.col("low") + i * width)

    guess = F.least(F.floor((F.col(score) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int")
    # Division can land one bin off an edge; the edges themselves decide.
    settled = (
        F.when(F.col(score) < edge(F.col("_guess")), F.col("_guess") - 1)
        .when((F.col("_guess") < bins - 1) & (F.col(score) >= edge(F.col("_guess") + 1)), F.col("_guess") + 1)
        .otherwise(F.col("_guess"))
    )
    counts = (
        df.select(target, score, *([rows] if rows else []))
        .join(F.broadcast(spans), target)  # two rows: one per class
        .withColumn("_guess", guess)
        .groupBy(target, settled.alias("bin"))
        .agg(total(rows).alias("n"))
    )
    slots = spans.select(target, "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return slots.join(counts, [target, "bin"], "left").select(
        target,
        "bin",
        edge(F.col("bin")).alias("bin_low"),
        edge(F.col("bin") + 1).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def calibration_curve(
    df: DataFrame, score: str = SCORE, target: str = TARGET, bins: int = 10, rows: str | None = None
) -> DataFrame:
    """Mean score and observed attack rate per uniform bin; a score on an edge belongs to the lower bin."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    slot = sum(((F.col(score) > F.lit(e)).cast("int") for e in edges), F.lit(0))
    weight = F.lit(1) if rows is None else F.col(rows)
    return df.groupBy(slot.alias("bin")).agg(
        (F.sum(F.col(score) * weight) / total(rows)).alias("mean_score"),
        (F.sum(F.col(target).cast("double") * weight) / total(rows)).alias("attack_rate"),
        total(rows).alias("n"),
    )
