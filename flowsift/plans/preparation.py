"""Jobs from landing folder to split table. Each reads a table, checks it, and writes a table."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.operators import gates
from flowsift.operators.clean import clean
from flowsift.operators.encode import encode
from flowsift.operators.split import (
    assign_days,
    day_sides,
    day_table,
    stratified_split,
    to_matrix,
)
from flowsift.schema import DRIFTED_WIDTH, LABEL, RAW_WIDTH, ROW_KEY, SOURCE_DAY, SOURCE_ORDER, STRATIFIED, TARGET, TIME_BASED, check_strategy
from flowsift.sources.csv_days import day_slices, list_sources, merge_reconciliation, merge_sources
from flowsift.sources.tables import read_parquet, write_parquet

# Where a time-based row lies: days by their start, then the order of files and rows; needed to carve the temporal tail later.
PLACE = ["day_start", SOURCE_DAY, *SOURCE_ORDER]
# Fixed value: percentage points by which the attack share of train and test may differ.
MAX_DRIFT = 0.01
ANY_DRIFT = 101.0

log = logging.getLogger(__name__)


def passed(report: DataFrame, stage: str) -> None:
    for name in gates.enforce(report):
        log.warning("%s: check %s failed", stage, name)


def write_gated(df: DataFrame, gate: gates.Gate, stage: str, out: str, by: Sequence[str] = ()) -> None:
    """Write a table and check what the gate's aggregates saw of it on the way: the rows are not scanned again."""
    watched, seen = gate.watched(df)
    write_parquet(watched, out, list(by))
    passed(gate.told(df, seen), stage)


def merge_job(
    spark: SparkSession,
    folder: str,
    out: str,
    strategy: str = STRATIFIED,
    action: str = "drop",
    manifest: str | None = None,
    rows: int | None = None,
    widths: tuple[int, int] | None = None,
) -> None:
    """Merge the CSV sources: one table for ``8020_stratified``, one partition per day for ``time_based``.

    Fails if a source has other rows in the table than in its files, if not all columns are texts, if the table is not near the expected number of
    ``rows`` (None: not empty), or if its width is none of ``widths``, the usual and the drifted one (None: those of the capture's files).
    ``manifest`` is a path where headers of known sources are kept.
    """
    check_strategy(strategy)
    sources = list_sources(spark, folder, manifest)
    if not sources:
        raise ValueError(f"no CSV sources in {folder}")
    merged = day_slices(spark, sources) if strategy == TIME_BASED else merge_sources(spark, sources, action)
    usual, drifted = widths or (RAW_WIDTH, DRIFTED_WIDTH)
    gate = gates.merged_checks(merged, rows, width=usual, drifted_width=drifted)
    write_gated(merged, gate, "merge", out, [SOURCE_DAY] if strategy == TIME_BASED else [])
    differing = merge_reconciliation(spark, sources, read_parquet(spark, out)).filter("NOT passed").limit(20).collect()
    if differing:
        raise gates.GateError(f"rows lost or added while merging: {[tuple(r) for r in differing]}")


def clean_job(
    spark: SparkSession, merged: str, out: str, strategy: str, width: int | None = None, labels: int = gates.LABEL_COUNT
) -> None:
    """Clean a merged table and gate the result by its expected ``width`` and number of ``labels``. A stratified set needs no row order: every column is in the dedup key.

    Dedup scatters each day over all tasks. Rebalancing by day before the write gives few files per day, and
    AQE splits a day that holds far more rows than the others.
    """
    raw = read_parquet(spark, merged)
    if strategy == TIME_BASED:
        cleaned = clean(raw.withColumn(SOURCE_DAY, F.col(SOURCE_DAY).cast("string")), strategy, SOURCE_ORDER)
        cleaned, by = cleaned.hint("rebalance", SOURCE_DAY), [SOURCE_DAY]
    else:
        cleaned, by = clean(raw, strategy, row_key=ROW_KEY), []
    write_gated(cleaned, gates.health_checks(cleaned, strategy, width), "clean", out, by)
    passed(gates.label_gate(read_parquet(spark, out, [LABEL]), labels), "clean")


def encode_job(spark: SparkSession, cleaned: str, out: str, strategy: str) -> None:
    """Encode a cleaned table after its input gate, and gate the result."""
    df = read_parquet(spark, cleaned)
    passed(gates.encode_input_gate(df, strategy), "encode")
    encoded = encode(df, strategy)
    write_gated(encoded, gates.encoded_checks(encoded), "encoded", out, [SOURCE_DAY] if strategy == TIME_BASED else [])


def split_job(
    spark: SparkSession,
    encoded: str,
    out: str,
    strategy: str,
    test_days: int | None = None,
) -> None:
    """Assign sides and write the matrix, one folder per side.

    A stratified split fails if the attack shares differ by more than ``MAX_DRIFT`` percentage points or one row. Whole
    days may differ by any amount.

    Stratified rows are drawn by their row key and keep it. Time-based rows keep day, timestamp and place
    for the later temporal carve of the training side.
    """
    check_strategy(strategy)
    df = read_parquet(spark, encoded)
    if TARGET not in df.columns:
        raise gates.GateError(f"column {TARGET} is missing")
    if strategy == TIME_BASED:
        df = df.withColumn(SOURCE_DAY, F.col(SOURCE_DAY).cast("string"))
        sides = day_sides(day_table(df), test_days=test_days)
        split = assign_days(df, sides)
        matrix = to_matrix(split, key=PLACE)
    else:
        split = stratified_split(df, [ROW_KEY])
        matrix = to_matrix(split, key=[ROW_KEY])
    write_gated(matrix, gates.side_checks("side", TARGET, MAX_DRIFT if strategy == STRATIFIED else ANY_DRIFT), "split", out, ["side"])
