"""Profiling: evidence about raw and cleaned records, one row per finding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.functions.folds import MOMENTS_TYPE, co_moments, smallest_values
from flowsift.functions.scalars import finite, is_stray_header, numbers, strip, to_number
from flowsift.operators.clean import interval_names
from flowsift.operators.ranks import smallest_rows
from flowsift.schema import EMPTY_LABELS, LABEL, PROTOCOL, REDUNDANT_PAIRS, TARGET
from flowsift.session import materialise


def quoted(name: str) -> Column:
    """A column by its exact name, even if that holds dots or blanks."""
    return F.col(f"`{name}`")


def cell(df: DataFrame, name: str) -> tuple[Column, Callable[[Column], Column]]:
    """A column and how to read it as a finite double."""
    if dict(df.dtypes)[name] == "string":
        return quoted(name), to_number
    return quoted(name).cast("double"), finite


def number_array(df: DataFrame, columns: Sequence[str]) -> Column:
    """``columns`` as an array of finite doubles; all are texts or all are numbers."""
    readers = [cell(df, c) for c in columns]
    if len({convert for _, convert in readers}) > 1:
        return F.array(*[convert(value) for value, convert in readers])
    return numbers([value for value, _ in readers], readers[0][1])


def long_cells(df: DataFrame, cells: Column) -> DataFrame:
    """One row (pos, value) per array entry of every row."""
    return df.select(F.posexplode(cells).alias("pos", "value"))


def name_of(columns: Sequence[str]) -> Column:
    """The column name at position ``pos``."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("pos") + 1).alias("column")


def label_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows and share per label, most frequent first, with a flag for padded labels."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        F.col(label),
        "n",
        (F.col("n") * 100.0 / total).alias("pct"),
        (F.col(label) != strip(F.col(label))).alias("padded"),
    ).orderBy(F.desc("n"), label)


def ghost_counts(df: DataFrame) -> DataFrame:
    """Stray header rows and rows with an empty-like label."""
    label = F.col(LABEL)
    return df.agg(
        F.count_if(is_stray_header(F.col(PROTOCOL))).alias("stray_headers"),
        F.count_if(label.isNull() | label.isin(EMPTY_LABELS)).alias("empty_labels"),
    )


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per column; unusable texts are left out.

    Cells are grouped by column position, which folds to one row per column inside each task. A wide
    aggregate of five measures per column outgrows the JIT compiler at a few dozen columns.
    """
    columns = list(columns)
    stats = (
        long_cells(df, number_array(df, columns))
        .groupBy("pos")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    return stats.select(name_of(columns), "n", "mean", "std", "min", "max")


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value and its frequency per text column.

    Values are counted before they are compared, so a value held by most rows is one row per task;
    ties for the top go to the smallest value.
    """
    columns = list(columns)
    cells = long_cells(df, F.array(*[quoted(c).cast("string") for c in columns])).filter("value IS NOT NULL")
    values = cells.groupBy("pos", "value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value")))
    found = values.groupBy("pos").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), best.alias("best"))
    return found.select(
        name_of(columns), "count", "unique", F.col("best.value").alias("top"), (-F.col("best.rank")).alias("freq")
    )


def negative_summary(df: DataFrame, column: str) -> DataFrame:
    """Rows with a negative value and their share of all rows."""
    negative = F.count_if(F.col("value") < 0)
    total = F.count("*")
    return df.select(to_number(quoted(column)).alias("value")).agg(
        total.alias("rows"),
        negative.alias("negative_rows"),
        F.when(total > 0, negative * 100.0 / total).alias("negative_pct"),
    )


def negative_labels(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The ``k`` labels with most negative values."""
    return (
        df.filter(to_number(quoted(column)) < 0)
        .groupBy(LABEL)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), LABEL)
        .limit(k)
    )


def negative_intervals(df: DataFrame) -> DataFrame:
    """Negative rows and the minimum of every inter-arrival column."""
    columns = interval_names(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, negative_rows bigint, min_value double")
    found = (
        long_cells(df, number_array(df, columns))
        .groupBy("pos")
        .agg(F.count_if(F.col("value") < 0).alias("negative_rows"), F.min("value").alias("min_value"))
    )
    return found.select(name_of(columns), "negative_rows", "min_value")


def near_constant(df: DataFrame, candidates: Sequence[str], most: int = 3, zero_pct: float = 99.0) -> DataFrame:
    """Evidence that a column hardly varies: at most ``most`` values and over ``zero_pct`` percent zeros.

    Long form needs one distinct aggregate; a wide ``count(DISTINCT ..)`` per column would copy
    every row once per column. Zeros fold together inside each task before the exchange.
    """
    columns = [c for c in candidates if c in df.columns]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, distinct_values bigint, zero_pct double, std double, droppable boolean"
        )
    found = (
        long_cells(df, number_array(df, columns))
        .groupBy("pos")
        .agg(
            F.count_distinct("value").alias("distinct_values"),
            (F.count_if(F.col("value") == 0) * 100.0 / F.count("*")).alias("zero_pct"),
            F.stddev_samp("value").alias("std"),
        )
    )
    return found.select(name_of(columns), "distinct_values", "zero_pct", "std").withColumn(
        "droppable", (F.col("distinct_values") <= most) & (F.col("zero_pct") > zero_pct)
    )


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows that have both values; NULL for a constant column, where ``corr`` divides by zero."""
    spread = F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b))
    return F.regr_sxy(a, b) / F.nullif(spread, F.lit(0.0))


def redundant_pairs(
    df: DataFrame, pairs: Sequence[tuple[str, str]] = REDUNDANT_PAIRS, threshold: float = 0.9999
) -> DataFrame:
    """Pearson correlation of candidate duplicate columns; pairs with an absent column are skipped."""
    present = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "dropped string, kept string, corr double, droppable boolean")
    columns = list(dict.fromkeys(c for pair in present for c in pair))
    cells = df.select(number_array(df, columns).alias("cells"))

    def value(name: str) -> Column:
        return F.col("cells")[columns.index(name)]

    wide = cells.agg(*[pearson(value(a), value(b)).alias(f"corr__{i}") for i, (a, b) in enumerate(present)])
    entries = [
        F.struct(
            F.lit(a).alias("dropped"),
            F.lit(b).alias("kept"),
            F.col(f"corr__{i}").alias("corr"),
            F.coalesce(F.col(f"corr__{i}") > threshold, F.lit(False)).alias("droppable"),
        )
        for i, (a, b) in enumerate(present)
    ]
    return wide.select(F.inline(F.array(*entries)))


#: Buckets per unit of the logarithm, those a bucket is cut into, rows that one task may rank, and the quartiles.
LOG_BUCKETS = 4096
FINER_BUCKETS = 4096
RANKED_ROWS = 1_000_000
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def cross_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, product) over the columns' positions, i <= j: centred sums of products over the rows that have every value.

    Each task folds its rows into one, of numbers, means and products; only these few rows are spread by pair. Parts are put together by
    their distance from the common means. A table without complete rows gives null products.
    """
    width = len(columns)
    cells = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = materialise(cells.mapInArrow(co_moments, MOMENTS_TYPE), "co_moments")
    at = parts.select("n", F.posexplode("means").alias("i", "mean"))
    common = at.groupBy("i").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    centre = F.array_sort(F.collect_list(F.struct("i", "mean")))["mean"]
    shifted = parts.crossJoin(F.broadcast(common.agg(centre.alias("common"))))  # one row of as many numbers as columns
    spread = shifted.select("n", F.zip_with("means", "common", lambda a, b: a - b).alias("step"), F.posexplode("products").alias("place", "product"))
    i, j = F.expr(f"place div {width}"), F.expr(f"place % {width}")
    whole = F.col("product") + F.col("n") * F.get("step", i) * F.get("step", j)
    sums = spread.filter(i <= j).groupBy(i.cast("int").alias("i"), j.cast("int").alias("j")).agg(F.sum(whole).alias("product"))
    every = df.sparkSession.range(width * width).select(F.expr(f"int(id div {width})").alias("i"), F.expr(f"int(id % {width})").alias("j"))
    return every.filter("i <= j").join(F.broadcast(sums), ["i", "j"], "left")  # a row per pair of columns


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, corr) over the columns' positions, i <= j: Pearson correlations of complete rows, 1 on the diagonal; a constant column gives null."""
    products = materialise(cross_products(df, columns), "cross_products")
    own = products.filter("i = j")
    both = products.join(F.broadcast(own.select("i", F.col("product").alias("_x"))), "i").join(F.broadcast(own.select("j", F.col("product").alias("_y"))), "j")
    spread = F.nullif(F.sqrt("_x") * F.sqrt("_y"), F.lit(0.0))
    return both.select("i", "j", F.when(F.col("i") == F.col("j"), F.when(F.col("_x") > 0, 1.0)).otherwise(F.col("product") / spread).alias("corr"))


def _names(columns: Sequence[str]) -> Column:
    return F.array(*map(F.lit, columns))


def target_correlations(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """Pearson correlation of every feature with the target."""
    last = len(features)
    found = correlations(df, [*features, target]).filter((F.col("j") == last) & (F.col("i") < last))
    return found.select(F.get(_names(features), F.col("i")).alias("feature"), "corr")


def top_correlated(df: DataFrame, features: Sequence[str], target: str = TARGET, k: int = 15) -> DataFrame:
    """The ``k`` features with the strongest correlation of either sign."""
    return (
        target_correlations(df, features, target)
        .orderBy(F.desc_nulls_last(F.abs("corr")), "feature")
        .limit(k)
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise Pearson correlations in long form, 1 on the diagonal unless the column is constant."""
    columns = list(columns)
    found = correlations(df, columns)
    both = found.union(found.filter("i < j").select("j", "i", "corr"))
    name = lambda at: F.get(_names(columns), F.col(at))
    return both.select(name("i").alias("feature_a"), name("j").alias("feature_b"), "corr")


def column_profile(df: DataFrame, k: int = 3) -> DataFrame:
    """Type and the ``k`` smallest distinct values, as text, of every column.

    One scan: a task hands on no more than ``k`` rows, the smallest values of each column side by side. These are folded in groups of tasks, then in all.
    """
    columns, types = df.columns, dict(df.dtypes)
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    kinds = ", ".join(f"{c} {kind}" for c, kind in plain.dtypes)  # all may be null here
    kept = plain.mapInArrow(smallest_values(k), kinds).withColumn("_part", F.spark_partition_id() % 1000)

    def few(name: str) -> Column:
        return F.slice(F.array_sort(F.collect_set(name)), 1, k)

    groups = kept.groupBy("_part").agg(*[few(c).alias(c) for c in plain.columns])
    whole = groups.agg(*[F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k).cast("array<string>").alias(c) for c in plain.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"c{i}").alias("values")) for i, c in enumerate(columns)])
    long = whole.select(F.inline(entries)).select("column", "type", F.posexplode("values").alias("rank", "value"))
    return long.select("column", "type", (F.col("rank") + 1).alias("rank"), "value")


def head_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), chosen reproducibly by key. Target and features stay in one row."""
    return smallest_rows(df, n, key, seed)


def log_quartiles(df: DataFrame, features: Sequence[str], target: str = TARGET, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Size, extremes and quartiles of ``log1p(feature)`` per class, exact and over all rows.

    Rows are counted per value bucket; a double has no logarithm beyond 710, so there is a bounded number of buckets. The
    running count names the few buckets that hold a wanted rank. Each is cut between its smallest and largest value, again and again, until it
    holds no more than ``ranked_rows`` rows or a single value; only then are its values counted one by one. Quartiles between two ranks are
    interpolated. Values at or below -1 have no logarithm.
    """
    logs = df.select(target, *[F.log1p(quoted(c).cast("double")).alias(c) for c in features])
    long = logs.unpivot([target], list(features), "feature", "value").filter("value IS NOT NULL AND NOT isnan(value)")
    group = ["feature", target]
    inside = long.select(*group, "value", F.array().cast("array<bigint>").alias("_outer"), F.floor(F.col("value") * LOG_BUCKETS).alias("_bucket"))
    before, sizes, ranks = F.lit(0).cast("long"), None, None
    while True:
        path = F.concat("_outer", F.array("_bucket")).alias("_path")
        counted = inside.groupBy(*group, "_outer", path).agg(F.count("*").alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high"))
        counts = materialise(counted, "buckets")
        if sizes is None:
            sizes = counts.groupBy(*group).agg(F.sum("_n").alias("n"), F.min("_low").alias("low"), F.max("_high").alias("high"))
            ranks = wanted_ranks(sizes, group).withColumn("_outer", F.array().cast("array<bigint>")).withColumn("_before", before)
        upto = Window.partitionBy(*group, "_outer").orderBy("_path").rowsBetween(Window.unboundedPreceding, 0)
        running = counts.withColumn("_upto", F.sum("_n").over(upto)).join(F.broadcast(ranks), [*group, "_outer"])  # six ranks a group at most
        first = F.col("_before") + F.col("_upto") - F.col("_n")
        hit = (F.col("_rank") >= first) & (F.col("_rank") < F.col("_before") + F.col("_upto"))
        found = running.filter(hit).select(*group, "_name", "_part", "_first", "_rank", first.alias("_before"), F.col("_path").alias("_outer"), "_n", "_low", "_high")
        ranks = materialise(found, "ranks")
        kept = ranks.select(*group, "_outer", "_low", "_high").distinct()
        rows = inside.withColumn("_outer", F.concat("_outer", F.array("_bucket"))).drop("_bucket").join(F.broadcast(kept), [*group, "_outer"])
        if ranks.filter((F.col("_n") > ranked_rows) & (F.col("_low") < F.col("_high"))).isEmpty():
            break
        part = (F.col("value") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
        inside = rows.withColumn("_bucket", F.coalesce(F.floor(part * FINER_BUCKETS), F.lit(0))).drop("_low", "_high")
        ranks = ranks.drop("_n", "_low", "_high")
    values = rows.groupBy(*group, "_outer", "value").agg(F.count("*").alias("_m"))
    within = Window.partitionBy(*group, "_outer").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("_to", F.sum("_m").over(within)).join(F.broadcast(ranks), [*group, "_outer"])
    place = F.col("_rank") - F.col("_before")
    found = placed.filter((place < F.col("_to")) & (place >= F.col("_to") - F.col("_m")))
    low, high = (F.max(F.when(c, F.col("value"))) for c in (F.col("_rank") == F.col("_first"), F.col("_rank") > F.col("_first")))
    quartile = found.groupBy(*group, "_name").agg(low.alias("_a"), high.alias("_b"), F.max("_part").alias("_part"))
    point = F.col("_a") + F.coalesce((F.col("_b") - F.col("_a")) * F.col("_part"), F.lit(0.0))
    wide = quartile.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == name, point)).alias(name) for name in QUARTILES])
    return sizes.join(wide, group).select(*group, "n", "low", *QUARTILES, "high")


def wanted_ranks(sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    """The one or two ranks (from 0) next to each quartile of a group, and the quartile's place between them."""
    shares = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in QUARTILES.items()])
    place = (F.col("n") - 1) * F.col("_q.p")
    return sizes.select(*group, "n", F.explode(shares).alias("_q")).select(
        *group, F.col("_q.name").alias("_name"), (place - F.floor(place)).alias("_part"), F.floor(place).alias("_first"),
        F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_rank"),
    )


def log_histogram(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """Rows per unit-width bin of ``log1p(feature)`` and class; doubles have fewer than 800 such bins."""
    logs = df.select(target, *[F.log1p(quoted(c).cast("double")).alias(c) for c in features])
    long = logs.unpivot([target], list(features), "feature", "value").filter("value IS NOT NULL AND abs(value) < 1e300")
    return long.groupBy("feature", target, F.floor("value").cast("int").alias("bin")).agg(F.count("*").alias("n"))


def explore(df: DataFrame, features: Sequence[str], target: str = TARGET, k: int = 15, drawn: int = 3) -> dict[str, DataFrame]:
    """Correlations with the target, the matrix of the ``k`` strongest with it, and the distributions of the first ``drawn``.

    All rows are read for each table; the driver sees the names of the chosen features.
    """
    strongest = top_correlated(df, features, target, k)
    names = [r["feature"] for r in strongest.filter("corr IS NOT NULL").orderBy(F.desc(F.abs("corr")), "feature").collect()]
    tables = {"strongest": strongest, "matrix": correlation_matrix(df, [*names, target])}
    if names:
        tables |= {"quartiles": log_quartiles(df, names[:drawn], target), "histogram": log_histogram(df, names[:drawn], target)}
    return tables
