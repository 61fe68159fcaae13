"""Cleaning of merged, all-string flow records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.functions.scalars import (
    clip_lower,
    is_empty_label,
    is_finite,
    is_stray_header,
    numbers,
    parse_number,
    row_fingerprint,
    strip,
)
from flowsift.operators.dedup import keep_first
from flowsift.schema import (
    DURATION,
    LABEL,
    NOT_DATA,
    PROTOCOL,
    SOURCE_DAY,
    STRATIFIED,
    TIME_BASED,
    TIMESTAMP,
    check_strategy,
    clean_name,
    unused_columns,
)

# The parsed features of a row while it is judged and deduplicated.
VALUES = "_values"


def drop_unused(df: DataFrame, strategy: str) -> DataFrame:
    """Drop the columns a strategy does not need; names that are absent are ignored."""
    return df.drop(*unused_columns(strategy))


def normalise_names(df: DataFrame) -> DataFrame:
    """Blanks and slashes in column names become underscores."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def feature_names(df: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    """Every column that is neither label, timestamp nor provenance."""
    other = {LABEL, TIMESTAMP, *NOT_DATA, *extra}
    return [c for c in df.columns if c not in other]


def is_ghost() -> Column:
    """Stray header rows and rows without a label."""
    return is_stray_header(F.col(PROTOCOL)) | is_empty_label(F.col(LABEL))


def drop_ghosts(df: DataFrame) -> DataFrame:
    return df.filter(~is_ghost()).withColumn(LABEL, strip(F.col(LABEL)))


def pack_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and all features, parsed to double, as one array."""
    return df.select(*keep, numbers((F.col(c) for c in features), parse_number).alias(VALUES))


def unpack_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The inverse: one double column per feature, then the other columns."""
    others = [c for c in df.columns if c != VALUES]
    return df.select(*[F.col(VALUES)[i].alias(c) for i, c in enumerate(features)], *others)


def type_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Parse feature texts to double; other columns stay as they are."""
    others = [c for c in df.columns if c not in features]
    return unpack_features(pack_features(df, features, others), features)


def all_finite() -> Column:
    """Whether every packed feature is there and finite."""
    return F.forall(VALUES, lambda v: F.coalesce(is_finite(v), F.lit(False)))


def keep_usable(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Packed rows whose every feature is finite.

    Exploding an array of one or no element filters and parses in one go. A filter on the parsed
    array would be pushed below the projection and parse every cell a second time.
    """
    parsed = F.array(numbers((F.col(c) for c in features), parse_number))
    whole = F.filter(parsed, lambda values: F.forall(values, lambda v: F.coalesce(is_finite(v), F.lit(False))))
    return df.select(*keep, F.explode(whole).alias(VALUES))


def packed(features: Sequence[str], name: str) -> Column:
    return F.col(VALUES)[list(features).index(name)]


def interval_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "IAT" in c]


def clip_intervals(df: DataFrame) -> DataFrame:
    """Negative inter-arrival times become 0; other sentinels such as window size -1 are data."""
    names = interval_names(df)
    return df.withColumns({c: clip_lower(F.col(c)) for c in names}) if names else df


def clean(df: DataFrame, strategy: str, order: Sequence[str] = (), row_key: str | None = None) -> DataFrame:
    """The whole cleaning chain.

    ``8020_stratified`` removes copies across all sources and forgets where a row came from,
    except for the ``order`` columns. ``time_based`` removes copies within a source day and keeps
    the first row's timestamp. Clipping follows dedup: rows alike only after clipping both stay.
    ``row_key`` names a column that tells kept rows apart even when later steps make them alike.
    """
    check_strategy(strategy)
    named = normalise_names(drop_unused(df, strategy))
    features = feature_names(named, order)
    day = [SOURCE_DAY] if strategy == TIME_BASED else []
    time = [TIMESTAMP] if strategy == TIME_BASED else []
    if time and not order:
        raise ValueError("time_based keeps the first timestamp of each group and needs an order")
    lasting = drop_ghosts(named).filter(parse_number(F.col(DURATION)) >= 0)
    usable = keep_usable(lasting, features, [LABEL, *day, *time, *order])
    keys = [VALUES, LABEL, *day]
    kept = keep_first(usable, keys, order)
    if row_key is not None:
        kept = kept.withColumn(row_key, row_fingerprint(keys))
    return clip_intervals(unpack_features(kept, features))


def cleaning_funnel(df: DataFrame, strategy: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows in, dropped and left for every cleaning step (per source day when time based).

    One pass and one wide shuffle: each row is tagged with the first rule that rejects it. Rejected rows
    blank their key, so they fold to one row per rule inside each task; kept rows group by the dedup key.
    """
    check_strategy(strategy)
    day = [SOURCE_DAY] if strategy == TIME_BASED else []
    named = normalise_names(drop_unused(df, strategy))
    features = feature_names(named, order)
    tagged = pack_features(named.withColumn("_ghost", is_ghost()), features, [*day, LABEL, "_ghost"]).withColumn(
        "_rule",
        F.when(F.col("_ghost"), 1)
        .when(~all_finite(), 2)
        .when(packed(features, DURATION) < 0, 3)
        .otherwise(4),
    )
    keyed = tagged.select(
        *day,
        "_rule",
        F.when(F.col("_rule") == 4, F.col(VALUES)).alias(VALUES),
        F.when(F.col("_rule") == 4, strip(F.col(LABEL))).alias(LABEL),
    )
    groups = keyed.groupBy(*day, "_rule", VALUES, LABEL).agg(F.count("*").alias("_n"))
    n = F.col("_n")
    rule = F.col("_rule")
    totals = groups.groupBy(*day).agg(
        F.sum(n).alias("all"),
        *[F.coalesce(F.sum(F.when(rule == i, n)), F.lit(0)).alias(f"rule_{i}") for i in (1, 2, 3)],
        F.coalesce(F.sum(F.when(rule == 4, n - 1)), F.lit(0)).alias("rule_4"),
    )
    steps = ["ghost_rows", "unusable_numbers", "negative_duration", "duplicates"]
    entries, before = [], F.col("all")
    for i, step in enumerate(steps, start=1):
        dropped = F.col(f"rule_{i}")
        entries.append(
            F.struct(
                F.lit(i).alias("step_no"),
                F.lit(step).alias("step"),
                before.alias("rows_in"),
                dropped.alias("rows_dropped"),
                (before - dropped).alias("rows_out"),
            )
        )
        before = before - dropped
    return totals.select(*day, F.inline(F.array(*entries)))


def shrinkage(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows before and after cleaning and the share removed, in percent."""
    raw_rows = raw.agg(F.count("*").alias("raw_rows"))
    rows = raw_rows.withColumn("clean_rows", cleaned.agg(F.count("*")).scalar())
    purged = F.col("raw_rows") - F.col("clean_rows")
    return rows.withColumns(
        {
            "purged_rows": purged,
            "purged_pct": F.when(F.col("raw_rows") > 0, purged * 100.0 / F.col("raw_rows")),
        }
    )
