"""Quality gates: one row per check, computed in one aggregate over the checked table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from flowsift.functions.scalars import INFINITY, any_of, epoch_seconds, strip
from flowsift.operators.clean import interval_names
from flowsift.operators.profile import quoted
from flowsift.schema import (
    CLEAN_WIDTH,
    DRIFTED_WIDTH,
    DURATION,
    EXPECTED_ROWS,
    LABEL,
    LABEL_COUNT,
    LEAKAGE,
    NEAR_CONSTANT,
    NOT_DATA,
    PROTOCOL,
    PROTOCOLS,
    RAW_WIDTH,
    REDUNDANT_PAIRS,
    ROW_TOLERANCE,
    TIME_BASED,
    TIMESTAMP,
    check_strategy,
    clean_name,
)

ERROR, WARNING = "error", "warning"


class GateError(RuntimeError):
    """Raised when a check of severity error fails."""


def check(name: str, observed, expected: str, passed, severity: str = ERROR) -> Column:
    """One gate row; ``observed`` and ``passed`` are columns of the aggregate row or plain values."""
    observed = observed if isinstance(observed, Column) else F.lit(observed)
    passed = passed if isinstance(passed, Column) else F.lit(bool(passed))
    return F.struct(
        F.lit(name).alias("check"),
        observed.cast("double").alias("observed"),
        F.lit(expected).alias("expected"),
        F.lit(severity).alias("severity"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def report(aggregate: DataFrame, checks: Sequence[Column]) -> DataFrame:
    return aggregate.select(F.inline(F.array(*checks)))


def enforce(gates: DataFrame) -> list[str]:
    """Raise on failed errors; return the names of failed warnings. A report holds a few dozen rows."""
    failed = gates.filter(~F.col("passed")).collect()
    errors = [f"{r['check']}: observed {r['observed']}, expected {r['expected']}" for r in failed if r["severity"] == ERROR]
    if errors:
        raise GateError("; ".join(errors))
    return [r["check"] for r in failed]


@dataclass(frozen=True)
class Gate:
    """Checks over aggregates of a table. ``over`` scans it; ``watched`` has the aggregates gathered while it is written."""

    aggregates: list[Column]
    checks: list[Column]

    def over(self, df: DataFrame) -> DataFrame:
        return report(df.agg(*self.aggregates), self.checks)

    def watched(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        """The table to write, and what will have seen its rows."""
        seen = Observation()
        return df.observe(seen, *self.aggregates), seen

    def told(self, df: DataFrame, seen: Observation) -> DataFrame:
        """The report on a table that has been written. Retried tasks of the write are counted once."""
        kinds = df.limit(0).agg(*self.aggregates).schema
        return report(df.sparkSession.createDataFrame([tuple(seen.get[c] for c in kinds.names)], kinds), self.checks)


def data_columns(df: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c not in NOT_DATA and c not in extra]


def merged_gate(
    df: DataFrame,
    rows: int = EXPECTED_ROWS,
    tolerance: int = ROW_TOLERANCE,
    width: int = RAW_WIDTH,
    drifted_width: int = DRIFTED_WIDTH,
    extra: Sequence[str] = (),
) -> DataFrame:
    return merged_checks(df, rows, tolerance, width, drifted_width, extra).over(df)


def merged_checks(
    df: DataFrame,
    rows: int | None = EXPECTED_ROWS,
    tolerance: int = ROW_TOLERANCE,
    width: int = RAW_WIDTH,
    drifted_width: int = DRIFTED_WIDTH,
    extra: Sequence[str] = (),
) -> Gate:
    """Row count near the expected one (any, if that is None), a known width, and text columns only."""
    columns = data_columns(df, extra)
    types = dict(df.dtypes)
    other = [c for c in columns if types[c] != "string"]
    n = F.col("n")
    counted = check("row_count", n, "> 0", n > 0) if rows is None else check("row_count", n, f"{rows} within {tolerance}", F.abs(n - rows) < tolerance)
    return Gate(
        [F.count("*").alias("n")],
        [
            counted,
            check("known_width", len(columns), f"{width} or {drifted_width}", len(columns) in (width, drifted_width)),
            check("base_width", len(columns), str(width), len(columns) == width, WARNING),
            check("text_columns", len(other), "0 other columns", not other),
        ],
    )


def cleaned_schema_checks(df: DataFrame, strategy: str, width: int | None, extra: Sequence[str]) -> list[Column]:
    check_strategy(strategy)
    columns = data_columns(df, extra)
    width = CLEAN_WIDTH[strategy] if width is None else width
    forbidden = NEAR_CONSTANT + [dropped for dropped, _ in REDUNDANT_PAIRS] + LEAKAGE
    survivors = set(map(clean_name, forbidden)) & set(columns)
    malformed = [c for c in columns if " " in c or "/" in c]
    has_time = TIMESTAMP in columns
    wanted = strategy == TIME_BASED
    return [
        check("width", len(columns), str(width), len(columns) == width),
        check("dropped_columns", len(survivors), "0 survivors", not survivors),
        check("timestamp_presence", int(has_time), str(int(wanted)), has_time == wanted),
        check("column_names", len(malformed), "0 malformed", not malformed),
    ]


def health_counts(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Missing and infinite cells, and the minima of duration and inter-arrival columns."""
    return df.agg(*_health(df, extra))


def is_missing(value: Column) -> Column:
    return value.isNull() | F.coalesce(F.isnan(value), F.lit(False))


def double_array(columns: Sequence[str]) -> Column:
    return F.array(*[quoted(c).cast("double") for c in columns]) if columns else F.array().cast("array<double>")


def _health(df: DataFrame, extra: Sequence[str]) -> list[Column]:
    types = dict(df.dtypes)
    columns = data_columns(df, extra)
    texts = [c for c in columns if types[c] == "string"]
    cells = double_array([c for c in columns if c not in texts])
    absent = sum((quoted(c).isNull().cast("int") for c in texts), F.lit(0))
    missing = F.size(F.filter(cells, is_missing)) + absent
    infinite = F.size(F.filter(cells, lambda v: F.coalesce(F.abs(v) == INFINITY, F.lit(False))))
    return [
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(infinite), F.lit(0)).alias("infinite_cells"),
        F.min(DURATION).alias("min_duration"),
        F.min(F.array_min(double_array(interval_names(df)))).alias("min_interval"),
    ]


def cleaned_gate(
    df: DataFrame,
    strategy: str,
    width: int | None = None,
    labels: int = LABEL_COUNT,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Schema, health and label checks on a cleaned table.

    Labels are counted first; everything else rides on the same partial aggregate per label.
    """
    checks = health_checks(df, strategy, width, extra).checks
    counts = [F.col("missing_cells"), F.col("infinite_cells")]
    per_label = df.groupBy(LABEL).agg(*_health(df, extra))
    aggregate = per_label.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in zip(counts, ["missing_cells", "infinite_cells"])],
        F.min("min_duration").alias("min_duration"),
        F.min("min_interval").alias("min_interval"),
        F.count(LABEL).alias("labels"),
        F.count_if(F.col(LABEL) != strip(F.col(LABEL))).alias("padded"),
    )
    return report(aggregate, checks + label_checks(labels))


def health_checks(df: DataFrame, strategy: str, width: int | None = None, extra: Sequence[str] = ()) -> Gate:
    """Schema and health of a cleaned table, without its labels."""
    checks = cleaned_schema_checks(df, strategy, width, extra) + [
        check("missing_cells", F.col("missing_cells"), "0", F.col("missing_cells") == 0),
        check("infinite_cells", F.col("infinite_cells"), "0", F.col("infinite_cells") == 0),
        check("min_duration", F.col("min_duration"), ">= 0", F.col("min_duration") >= 0),
    ]
    if interval_names(df):
        checks.append(check("min_interval", F.col("min_interval"), ">= 0", F.col("min_interval") >= 0))
    return Gate(_health(df, extra), checks)


def label_checks(labels: int) -> list[Column]:
    return [
        check("label_count", F.col("labels"), str(labels), F.col("labels") == labels),
        check("padded_labels", F.col("padded"), "0", F.col("padded") == 0),
    ]


def label_gate(df: DataFrame, labels: int = LABEL_COUNT) -> DataFrame:
    """Number of labels and their padding, from the label column alone."""
    distinct = df.groupBy(LABEL).agg(F.count("*").alias("n"))
    padded = F.count_if(F.col(LABEL) != strip(F.col(LABEL))).alias("padded")
    return report(distinct.agg(F.count(LABEL).alias("labels"), padded), label_checks(labels))


def encode_input_gate(df: DataFrame, strategy: str) -> DataFrame:
    """What encoding requires: no leaking column, protocol and label present, readable timestamps."""
    check_strategy(strategy)
    leaked = [c for c in map(clean_name, LEAKAGE) if c in df.columns]
    absent = [c for c in (PROTOCOL, LABEL) if c not in df.columns]
    has_time = TIMESTAMP in df.columns
    wanted = strategy == TIME_BASED
    checks = [
        check("leaking_columns", len(leaked), "0", not leaked),
        check("required_columns", len(absent), "0 absent", not absent),
        check("timestamp_presence", int(has_time), str(int(wanted)), has_time == wanted),
    ]
    aggregates = [F.count("*").alias("n")]
    if PROTOCOL in df.columns:
        protocol = F.col(PROTOCOL).try_cast("int")
        aggregates.append(F.count_if(F.col(PROTOCOL).isNotNull() & ~F.coalesce(protocol.isin(PROTOCOLS), F.lit(False))).alias("unknown"))
        checks.append(check("unknown_protocols", F.col("unknown"), "0 rows", F.col("unknown") == 0, WARNING))
    if has_time and wanted:
        aggregates.append(F.count_if(epoch_seconds(F.col(TIMESTAMP)).isNull()).alias("bad_times"))
        checks.append(check("unreadable_timestamps", F.col("bad_times"), "0", F.col("bad_times") == 0))
    return report(df.agg(*aggregates), checks)


def encoded_gate(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return encoded_checks(df, extra).over(df)


def encoded_checks(df: DataFrame, extra: Sequence[str] = ()) -> Gate:
    """Only numeric columns and no missing cell."""
    types = dict(df.dtypes)
    columns = data_columns(df, extra)
    other = [c for c in columns if types[c] not in ("double", "float", "tinyint", "smallint", "int", "bigint")]
    texts = [c for c in columns if types[c] == "string"]
    bad = F.exists(double_array([c for c in columns if c not in texts]), is_missing) | any_of(
        quoted(c).isNull() for c in texts
    )
    return Gate(
        [F.count_if(bad).alias("bad_rows")],
        [
            check("numeric_columns", len(other), "0 other columns", not other),
            check("rows_with_missing_cells", F.col("bad_rows"), "0", F.col("bad_rows") == 0),
        ],
    )


def required_names(present: Sequence[str], required: Sequence[str]) -> list[str]:
    """Names that are required but absent."""
    return [c for c in required if c not in present]


def feature_gate(model_features: Sequence[str], df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Warn when a model was trained on other columns than the table offers."""
    columns = set(df.columns) - set(extra)
    differing = set(model_features) ^ columns
    return report(
        df.sparkSession.range(1),
        [check("model_features", len(differing), "0 differing columns", not differing, WARNING)],
    )


def side_gate(df: DataFrame, side: str, target: str, tolerance: float = 0.01) -> DataFrame:
    return side_checks(side, target, tolerance).over(df)


def side_checks(side: str, target: str, tolerance: float = 0.01) -> Gate:
    """Both sides non-empty and with attacks; the attack shares differ by under ``tolerance`` points.

    A single row of the smaller side may move its share by more than that; then its weight is the tolerance.
    """
    def rows(name: str) -> Column:
        return F.count_if(F.col(side) == name)

    def attacks(name: str) -> Column:
        return F.count_if((F.col(side) == name) & (F.col(target) == 1))

    aggregates = [f(name).alias(f"{kind}_{name}") for name in ("train", "test") for kind, f in (("rows", rows), ("attacks", attacks))]
    share = {s: F.col(f"attacks_{s}") * 100.0 / F.nullif(F.col(f"rows_{s}").cast("double"), F.lit(0.0)) for s in ("train", "test")}
    drift = F.abs(share["train"] - share["test"])
    checks = [check(f"{s}_rows", F.col(f"rows_{s}"), "> 0", F.col(f"rows_{s}") > 0) for s in ("train", "test")]
    checks += [check(f"{s}_attacks", F.col(f"attacks_{s}"), "> 0", F.col(f"attacks_{s}") > 0, WARNING) for s in ("train", "test")]
    one_row = 100.0 / F.nullif(F.least(F.col("rows_train"), F.col("rows_test")).cast("double"), F.lit(0.0))
    limit = F.greatest(F.lit(tolerance), one_row)
    checks.append(check("attack_share_drift", F.round(drift, 6), f"< {tolerance} points", drift < limit))
    return Gate(aggregates, checks)
