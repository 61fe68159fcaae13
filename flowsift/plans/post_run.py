"""Diagnostics of a saved run: score the test side again and tabulate every curve."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowsift.operators import gates
from flowsift.operators.boosting import assemble, score_rows
from flowsift.operators.curves import SCORE, cumulate, pr_curve, range_edges, ranking_metrics, roc_curve, score_counts
from flowsift.operators.diagnostics import (
    calibration_curve,
    confidence_histogram,
    confusion,
    confusion_matrix,
    rows_of_counts,
    threshold_sweep,
)
from flowsift.schema import TARGET
from flowsift.session import materialise
from flowsift.sources.tables import load_model, load_threshold, write_csv, write_parquet

log = logging.getLogger(__name__)


def diagnose(scores: DataFrame, threshold: float) -> dict[str, DataFrame]:
    """All diagnostic tables of scored rows. Scores are counted once; every table follows from the counts."""
    counts = materialise(score_counts(scores), "score_counts")
    cumulative, rows = cumulate(counts, range_edges(counts)), rows_of_counts(counts)
    return {
        "metrics": ranking_metrics(cumulative),
        "operating_point": confusion(rows, threshold, rows="rows"),
        "confusion": confusion_matrix(rows, threshold, rows="rows"),
        "pr_curve": pr_curve(cumulative),
        "roc_curve": roc_curve(cumulative),
        "histogram": confidence_histogram(rows, rows="rows"),
        "calibration": calibration_curve(rows, rows="rows"),
        "sweep": threshold_sweep(rows, threshold, rows="rows"),
    }


def post_run_analysis(test: DataFrame, features: Sequence[str], run_dir: str) -> dict[str, DataFrame]:
    """Load model and threshold from ``run_dir``, score ``test`` and write the tables beside them."""
    spark = test.sparkSession
    model = load_model(f"{run_dir}/model")
    if model.numFeatures != len(features):
        raise gates.GateError(f"the model has {model.numFeatures} features, the table {len(features)}")
    trained_on = [r["feature"] for r in spark.read.parquet(f"{run_dir}/features").collect()]
    if gates.enforce(gates.feature_gate(trained_on, test.select(*features))):
        log.warning("the table has other columns than the model knows")
    threshold = load_threshold(spark, f"{run_dir}/threshold")
    scores = materialise(score_rows(model, assemble(test, features, [TARGET])).select(TARGET, F.col(SCORE)), "scores")
    tables = diagnose(scores, threshold)
    out = f"{run_dir}/post_run_analysis"
    for name, table in tables.items():
        if name != "sweep":
            write_parquet(table, f"{out}/{name}")
    write_csv(tables["sweep"].orderBy("threshold"), f"{out}/threshold_sweep")
    return tables
