"""Train-and-evaluate job: validation carve, early stopping, threshold, refit, held-out evaluation."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.operators.boosting import (
    BoostingParams,
    assemble,
    feature_importance,
    fit,
    grow,
    score_rows,
)
from flowsift.operators.curves import cumulate, cumulative_counts, operating_threshold, range_edges, ranking_metrics
from flowsift.operators.diagnostics import classification_report, confusion_matrix
from flowsift.operators.gates import required_names
from flowsift.operators.split import SEED, class_weight, feature_columns, stratified_split, tail_split
from flowsift.plans.preparation import PLACE
from flowsift.schema import ROW_KEY, SOURCE_DAY, TARGET, TIME_BASED, check_strategy
from flowsift.session import materialise, scratch_tables
from flowsift.sources.tables import read_parquet, save_model, save_threshold, write_parquet

log = logging.getLogger(__name__)

TRAIN, VALIDATION, TEST = "train", "validation", "test"
SAVED = ("curve", "scores", "metrics", "report", "confusion", "importance")


@dataclass(frozen=True)
class TrainedRun:
    model: GBTClassificationModel
    features: list[str]
    threshold: float
    n_trees: int
    curve: DataFrame
    scores: DataFrame
    metrics: DataFrame
    report: DataFrame
    confusion: DataFrame
    importance: DataFrame


def carve_stratified(key: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Validation by class quota, as for the test side."""
    return lambda train: stratified_split(train, key, names=(TRAIN, VALIDATION), side="phase", seed=SEED)


def carve_tail(order: Sequence[str], bucket) -> Callable[[DataFrame], DataFrame]:
    """Validation from the latest rows, mimicking the time gap between train and test."""
    return lambda train: tail_split(train, order, bucket, names=(TRAIN, VALIDATION), side="phase")


def weight_of(df: DataFrame) -> float:
    row = class_weight(df).first()
    if row["weight"] is None:
        raise ValueError("cannot weigh the classes: no attack among the training rows")
    return row["weight"]


def train_and_evaluate(
    split: DataFrame,
    features: Sequence[str],
    carve: Callable[[DataFrame], DataFrame] | None,
    params: BoostingParams = BoostingParams(),
    run_dir: str | None = None,
) -> TrainedRun:
    """The two-phase training run on a table with ``side`` (train, test), target and features, and with ``phase`` if nothing carves it.

    Phase 1 fits on the training rows outside validation and keeps the tree count and threshold that
    validation prefers. Phase 2 refits on all training rows. Only the test side is reported.
    """
    spark = split.sparkSession
    absent = required_names(split.columns, [*features, TARGET, "side", *([] if carve else ["phase"])])
    if absent:
        raise ValueError(f"the split table lacks {absent}")
    train = split.filter(F.col("side") == TRAIN)
    phases = (carve(train) if carve else train).drop("side").withColumnRenamed("phase", "side")
    plain = materialise(phases.select(*features, TARGET, "side"), "phase1")  # written and read in less time than vectors
    carved = assemble(plain, features, [TARGET, "side"])
    inner = carved.filter(F.col("side") == TRAIN)
    if carved.filter((F.col("side") == VALIDATION) & (F.col(TARGET) == 1)).isEmpty():
        log.warning("no validation row is an attack, so neither the number of trees nor the threshold means much")

    grown = grow(carved, weight_of(inner), params)
    curve, n_trees = materialise(grown.curve, "learning_curve"), grown.n_trees
    edges = range_edges(grown.validation)
    threshold = operating_threshold(cumulate(grown.validation, edges)).first()["threshold"]

    everything = carved.drop("side")
    model = fit(everything, weight_of(everything), n_trees, params)

    kept = [TARGET] + [c for c in split.columns if c not in {*features, TARGET, "side", *([] if carve else ["phase"])}]
    test = assemble(split.filter(F.col("side") == TEST), features, kept)
    scores = materialise(score_rows(model, test), "scores")
    run = TrainedRun(
        model,
        list(features),
        threshold,
        n_trees,
        curve,
        scores,
        ranking_metrics(cumulative_counts(scores)),
        classification_report(scores, threshold),
        confusion_matrix(scores, threshold),
        feature_importance(model, features, spark),
    )
    if run_dir is not None:
        save_run(run, run_dir)
    return run


def save_run(run: TrainedRun, run_dir: str) -> None:
    """Model with its feature names, threshold and result tables below ``run_dir``."""
    spark = run.scores.sparkSession
    save_model(run.model, f"{run_dir}/model")
    write_parquet(spark.createDataFrame(list(enumerate(run.features)), "pos int, feature string"), f"{run_dir}/features")
    save_threshold(spark, f"{run_dir}/threshold", run.threshold)
    for name in SAVED:
        write_parquet(getattr(run, name), f"{run_dir}/{name}")


def train_job(spark: SparkSession, split: str, run_dir: str, strategy: str, params: BoostingParams = BoostingParams()) -> TrainedRun:
    """Train from a table that ``split_job`` wrote; the strategy says how validation rows are carved.

    Stratified rows are drawn by their row key, time-based ones are the last in the order of days, files and rows.
    The run's tables are read back from ``run_dir``; its intermediate tables are deleted.
    """
    check_strategy(strategy)
    table = read_parquet(spark, split)
    if strategy == TIME_BASED:
        table = table.withColumn(SOURCE_DAY, F.col(SOURCE_DAY).cast("string"))
        bucket = F.struct(*PLACE[:-1], F.floor(F.col(PLACE[-1]) / 1_000_000).alias("block"))
        key, carve = PLACE, carve_tail(PLACE, bucket)
    else:
        key, carve = [ROW_KEY], carve_stratified([ROW_KEY])
    with scratch_tables(spark):
        run = train_and_evaluate(table, feature_columns(table, key), carve, params, run_dir)
    return replace(run, **{name: read_parquet(spark, f"{run_dir}/{name}") for name in SAVED})
