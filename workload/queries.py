"""Every registered query: an operator of the library bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.functions.scalars import epoch_seconds, strategy_in
from flowsift.operators import boosting, clean as cleaning, curves, diagnostics, encode, gates, profile, split
from flowsift.operators.boosting import BoostingParams
from flowsift.plans import post_run, preparation, training
from flowsift.schema import (
    LABEL,
    NEAR_CONSTANT,
    REDUNDANT_PAIRS,
    SAMPLED_FEATURES,
    STRATIFIED,
    TARGET,
    TIME_BASED,
    clean_name,
)
from flowsift.session import materialise, scratch_path
from flowsift.sources import csv_days, tables
from workload.flows import (
    IDENTIFIER_SQL,
    LINE_FEATURES,
    LINE_KEY,
    ORDER,
    RAW_COLUMNS,
    flows_raw,
    lines,
    read,
    scored,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RAW_WIDTH = len(RAW_COLUMNS)
LANDED = (RAW_WIDTH, RAW_WIDTH + len(IDENTIFIER_SQL))  # columns of the usual weeks, and with those of the drifted week
WEEKS = [f"week-{k}" for k in range(5)]
DRIFTED_WEEK = "week-2"
PADDED = ["Protocol", "Flow Duration"]
CLEAN_STATS = [clean_name(c) for c in SAMPLED_FEATURES if c not in dict(REDUNDANT_PAIRS)]
LINE_COLUMNS = [*LINE_FEATURES, TARGET]
LOGGED = ["l_extendedprice", "l_quantity", "l_discount"]
SMALL_FIT = BoostingParams(max_trees=40, max_depth=4, learning_rate=0.3, patience=10)
PLAIN_TREES = 30  # of the model that is only scored, listed and stored


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six decimals, so that engines that add in another order agree."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles}) if doubles else df


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(flows_raw(spark, sf_dir), STRATIFIED, ORDER)


def cleaned_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(flows_raw(spark, sf_dir), TIME_BASED, ORDER)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(cleaned(spark, sf_dir), STRATIFIED)


def encoded_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(cleaned_by_day(spark, sf_dir), TIME_BASED)


# --- cleaning ----------------------------------------------------------------------------------------
@query
def clean_label_mix(spark, sf_dir):
    return rounded(profile.label_distribution(cleaned(spark, sf_dir)))


@query
def clean_rows_stratified(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query
def clean_rows_by_day(spark, sf_dir):
    return cleaned_by_day(spark, sf_dir)


@query
def cleaning_funnel(spark, sf_dir):
    return cleaning.cleaning_funnel(flows_raw(spark, sf_dir), STRATIFIED, ORDER)


@query
def cleaning_funnel_by_day(spark, sf_dir):
    return cleaning.cleaning_funnel(flows_raw(spark, sf_dir), TIME_BASED, ORDER)


@query
def shrinkage(spark, sf_dir):
    return rounded(cleaning.shrinkage(flows_raw(spark, sf_dir), cleaned(spark, sf_dir)))


# --- profiling ---------------------------------------------------------------------------------------
@query
def raw_label_distribution(spark, sf_dir):
    return rounded(profile.label_distribution(flows_raw(spark, sf_dir)))


@query
def ghost_rows(spark, sf_dir):
    return profile.ghost_counts(flows_raw(spark, sf_dir))


@query
def raw_feature_stats(spark, sf_dir):
    return rounded(profile.feature_stats(flows_raw(spark, sf_dir), SAMPLED_FEATURES))


@query
def clean_feature_stats(spark, sf_dir):
    return rounded(profile.feature_stats(cleaned(spark, sf_dir), CLEAN_STATS))


@query
def text_description(spark, sf_dir):
    return profile.describe_text(flows_raw(spark, sf_dir), RAW_COLUMNS)


@query
def negative_duration(spark, sf_dir):
    return rounded(profile.negative_summary(flows_raw(spark, sf_dir), "Flow Duration"))


@query
def negative_duration_labels(spark, sf_dir):
    return profile.negative_labels(flows_raw(spark, sf_dir), "Flow Duration")


@query
def negative_intervals(spark, sf_dir):
    return rounded(profile.negative_intervals(flows_raw(spark, sf_dir)))


@query
def near_constant_columns(spark, sf_dir):
    return rounded(profile.near_constant(flows_raw(spark, sf_dir), NEAR_CONSTANT))


@query
def near_constant_line_columns(spark, sf_dir):
    return rounded(profile.near_constant(read(spark, sf_dir, "lineitem"), LINE_FEATURES))


@query
def redundant_columns(spark, sf_dir):
    return rounded(profile.redundant_pairs(flows_raw(spark, sf_dir)))


@query
def column_profile(spark, sf_dir):
    return profile.column_profile(flows_raw(spark, sf_dir).select(*RAW_COLUMNS))


@query
def first_raw_rows(spark, sf_dir):
    return profile.head_rows(flows_raw(spark, sf_dir), ORDER)


@query
def first_encoded_rows(spark, sf_dir):
    return profile.head_rows(encoded(spark, sf_dir), ORDER)


@query
def target_correlations(spark, sf_dir):
    return rounded(profile.top_correlated(lines(spark, sf_dir), LINE_FEATURES))


@query
def correlation_matrix(spark, sf_dir):
    return rounded(profile.correlation_matrix(lines(spark, sf_dir), LINE_COLUMNS))


@query
def sampled_rows(spark, sf_dir):
    n_rows = 2_000
    return profile.sample_rows(lines(spark, sf_dir).select(*LINE_KEY, TARGET), n_rows, LINE_KEY)


@query
def log_feature_quartiles(spark, sf_dir):
    return rounded(profile.log_quartiles(lines(spark, sf_dir), LOGGED))


@query
def log_feature_histogram(spark, sf_dir):
    return profile.log_histogram(lines(spark, sf_dir), LOGGED)


def _explored(spark, sf_dir):
    return profile.explore(lines(spark, sf_dir), LINE_FEATURES)


@query
def explored_matrix(spark, sf_dir):
    return rounded(_explored(spark, sf_dir)["matrix"])


@query
def explored_quartiles(spark, sf_dir):
    return rounded(_explored(spark, sf_dir)["quartiles"])


@query
def explored_histogram(spark, sf_dir):
    return _explored(spark, sf_dir)["histogram"]


# --- gates -------------------------------------------------------------------------------------------
@query
def merged_gate(spark, sf_dir):
    flows = flows_raw(spark, sf_dir)
    return gates.merged_gate(flows, width=RAW_WIDTH, drifted_width=RAW_WIDTH + 4)


@query
def cleaned_gate(spark, sf_dir):
    return gates.cleaned_gate(cleaned(spark, sf_dir), STRATIFIED, width=13, labels=5)


@query
def cleaned_by_day_gate(spark, sf_dir):
    return gates.cleaned_gate(cleaned_by_day(spark, sf_dir), TIME_BASED, width=14)


@query
def health_counts(spark, sf_dir):
    raw = cleaning.normalise_names(flows_raw(spark, sf_dir))
    return rounded(gates.health_counts(cleaning.type_features(raw, cleaning.feature_names(raw, ORDER))))


@query
def encode_input_gate(spark, sf_dir):
    return gates.encode_input_gate(cleaned_by_day(spark, sf_dir), TIME_BASED)


@query
def encoded_gate(spark, sf_dir):
    return gates.encoded_gate(encoded(spark, sf_dir))


@query
def split_gate(spark, sf_dir):
    rows = split.stratified_split(encoded(spark, sf_dir), ORDER)
    return gates.side_gate(rows, "side", TARGET)


# --- encoding ----------------------------------------------------------------------------------------
@query
def encoded_rows_stratified(spark, sf_dir):
    return encoded(spark, sf_dir)


@query
def encoded_rows_by_day(spark, sf_dir):
    return encoded_by_day(spark, sf_dir)


@query
def one_hot_totals(spark, sf_dir):
    return encode.one_hot_totals(encoded(spark, sf_dir))


@query
def protocol_values(spark, sf_dir):
    return encode.protocol_values(cleaned(spark, sf_dir))


@query
def class_balance(spark, sf_dir):
    return rounded(encode.class_balance(encoded(spark, sf_dir)))


@query
def raw_epoch_seconds(spark, sf_dir):
    return flows_raw(spark, sf_dir).select("row_no", epoch_seconds(F.col("Timestamp")).alias("epoch_s"))


# --- splits ------------------------------------------------------------------------------------------
@query
def stratified_sides(spark, sf_dir):
    return split.stratified_split(encoded(spark, sf_dir), ORDER).select("row_no", TARGET, "side")


@query
def stratified_line_sides(spark, sf_dir):
    rows = lines(spark, sf_dir).select(*LINE_KEY, TARGET)
    return split.stratified_split(rows, LINE_KEY)


@query
def stratified_matrix(spark, sf_dir):
    return split.to_matrix(split.stratified_split(encoded(spark, sf_dir), ORDER), ORDER)


@query
def rejoined_matrix(spark, sf_dir):
    rows = encoded(spark, sf_dir)
    features = split.to_matrix(rows, ORDER, side=None).drop(TARGET)
    return split.pair_features_and_target(features, rows.select(*ORDER, TARGET), ORDER).select(
        *ORDER, "Flow_Duration", TARGET
    )


@query
def side_class_balance(spark, sf_dir):
    rows = split.stratified_split(encoded(spark, sf_dir), ORDER)
    return rounded(encode.class_balance(rows, by=("side",)))


@query
def split_drift(spark, sf_dir):
    return rounded(split.split_drift(split.stratified_split(encoded(spark, sf_dir), ORDER)))


@query
def day_balance(spark, sf_dir):
    return rounded(split.day_table(encoded_by_day(spark, sf_dir)).orderBy("first_ts"))


@query
def day_sides_by_share(spark, sf_dir):
    days = split.day_table(encoded_by_day(spark, sf_dir))
    return split.day_sides(days).select("source_day", "rows", "side")


@query
def day_sides_fixed(spark, sf_dir):
    days = split.day_table(encoded_by_day(spark, sf_dir))
    return split.day_sides(days, test_days=3).select("source_day", "rows", "side")


@query
def day_split_matrix(spark, sf_dir):
    rows = materialise(encoded_by_day(spark, sf_dir), "rows")
    sides = split.day_sides(split.day_table(rows))
    return split.to_matrix(split.assign_days(rows, sides).drop("day_start"), ORDER)


@query
def temporal_tail(spark, sf_dir):
    rows = materialise(encoded_by_day(spark, sf_dir).select("source_day", "row_no", "Timestamp", TARGET), "rows")
    starts = rows.groupBy("source_day").agg(F.min("Timestamp").alias("day_start"))
    placed = rows.drop("Timestamp").join(starts, "source_day")
    return split.tail_split(placed, ["day_start", "source_day", "row_no"], split.day_bucket()).drop("day_start")


@query
def stacked_day_slices(spark, sf_dir):
    rows = encoded_by_day(spark, sf_dir)
    out = scratch_path(spark, "days")
    tables.write_parquet(rows, out, ["source_day"])
    stored = spark.read.option("basePath", out)
    days = sorted(r["source_day"] for r in spark.read.parquet(out).select(F.col("source_day").cast("string")).distinct().collect())
    halves = [days[: len(days) // 2], days[len(days) // 2 :]]
    slices = [stored.parquet(*[f"{out}/source_day={d}" for d in half]) for half in halves if half]
    return split.union_days(slices).withColumn("source_day", F.col("source_day").cast("string")).select(*rows.columns)


@query
def class_weight(spark, sf_dir):
    return rounded(split.class_weight(encoded(spark, sf_dir)))


@query
def validation_carve(spark, sf_dir):
    rows = split.stratified_split(encoded(spark, sf_dir), ORDER).filter("side = 'train'")
    carve = training.carve_stratified(ORDER)
    return carve(rows).groupBy("phase", TARGET).agg(F.count("*").alias("n"))


# --- evaluation --------------------------------------------------------------------------------------
def _cumulative(spark, sf_dir):
    return curves.cumulative_counts(scored(spark, sf_dir), rows_per_range=500)


def _threshold(spark, sf_dir) -> float:
    return curves.operating_threshold(_cumulative(spark, sf_dir)).first()["threshold"]


@query
def score_counts(spark, sf_dir):
    return curves.score_counts(scored(spark, sf_dir))


@query
def cumulative_counts(spark, sf_dir):
    return _cumulative(spark, sf_dir).select("threshold", "tp", "fp", "total_pos", "total_neg")


@query
def cumulative_counts_in_ranges(spark, sf_dir):
    ranged = curves.cumulative_counts(scored(spark, sf_dir), rows_per_range=500)
    return ranged.select("threshold", "tp", "fp", "next_pos", "next_neg")


@query
def pr_curve(spark, sf_dir):
    return rounded(curves.pr_curve(_cumulative(spark, sf_dir)))


@query
def roc_curve(spark, sf_dir):
    return rounded(curves.roc_curve(_cumulative(spark, sf_dir)))


@query
def roc_curve_all_points(spark, sf_dir):
    return rounded(curves.roc_curve(_cumulative(spark, sf_dir), drop_intermediate=False))


@query
def ranking_metrics(spark, sf_dir):
    return rounded(curves.ranking_metrics(_cumulative(spark, sf_dir)))


@query
def operating_threshold(spark, sf_dir):
    return rounded(curves.operating_threshold(_cumulative(spark, sf_dir)))


@query
def decisions(spark, sf_dir):
    rows = diagnostics.predict(scored(spark, sf_dir), 0.1)
    return rows.groupBy(TARGET, "prediction").agg(F.count("*").alias("n"))


@query
def confusion_at_threshold(spark, sf_dir):
    return rounded(diagnostics.confusion(scored(spark, sf_dir), 0.1))


@query
def confusion_matrix(spark, sf_dir):
    return diagnostics.confusion_matrix(scored(spark, sf_dir), 0.1)


@query
def classification_report(spark, sf_dir):
    return diagnostics.classification_report(scored(spark, sf_dir), 0.1)


@query
def threshold_sweep(spark, sf_dir):
    return diagnostics.threshold_sweep(scored(spark, sf_dir), 0.1234567)


@query
def threshold_sweep_at_best(spark, sf_dir):
    return diagnostics.threshold_sweep(scored(spark, sf_dir), _threshold(spark, sf_dir))


@query
def confidence_histogram(spark, sf_dir):
    return rounded(diagnostics.confidence_histogram(scored(spark, sf_dir)))


@query
def calibration_curve(spark, sf_dir):
    return rounded(diagnostics.calibration_curve(scored(spark, sf_dir)))


# --- sources and sinks -------------------------------------------------------------------------------
@cache
def _landing(spark: SparkSession, sf_dir: str) -> str:
    """All flows as CSV, one folder per week; one week has four more columns in front and padded names."""
    folder = scratch_path(spark, "landing")
    for k, week in enumerate(WEEKS):
        drifted = week == DRIFTED_WEEK
        rows = flows_raw(spark, sf_dir, identifiers=drifted, week=k).drop("row_no", "source_day")
        if drifted:
            rows = rows.toDF(*[f" {c}" if c in PADDED else c for c in rows.columns])
        tables.write_csv(rows, f"{folder}/{week}.csv")
    return folder


def _sources(spark, sf_dir):
    return csv_days.list_sources(spark, _landing(spark, sf_dir))


@query
def header_manifest(spark, sf_dir):
    return csv_days.header_manifest(spark, _sources(spark, sf_dir))


@query
def source_inventory(spark, sf_dir):
    return csv_days.inventory(spark, _landing(spark, sf_dir), _sources(spark, sf_dir))


@query
def source_preview(spark, sf_dir):
    return csv_days.preview_table(spark, _sources(spark, sf_dir), ["Timestamp", "Protocol", "Flow Duration", LABEL])


@query
def header_drift(spark, sf_dir):
    return csv_days.header_drift(csv_days.header_manifest(spark, _sources(spark, sf_dir))).drop("pos")


@query
def merged_rows_drop(spark, sf_dir):
    merged = csv_days.merge_sources(spark, _sources(spark, sf_dir), "drop")
    return merged.drop("source_file", "source_block", "row_no")


@query
def merged_rows_keep(spark, sf_dir):
    merged = csv_days.merge_sources(spark, _sources(spark, sf_dir), "keep")
    return merged.drop("source_file", "source_block", "row_no")


@query
def day_slice_rows(spark, sf_dir):
    out = scratch_path(spark, "day_slices")
    preparation.merge_job(spark, _landing(spark, sf_dir), out, TIME_BASED, widths=LANDED)
    return (
        tables.read_parquet(spark, out)
        .groupBy(F.col("source_day").cast("string").alias("source_day"))
        .agg(F.count("*").alias("rows"), F.count("Flow ID").alias("with_flow_id"))
    )


@query
def merge_reconciliation(spark, sf_dir):
    out, sources = scratch_path(spark, "merged"), _sources(spark, sf_dir)
    tables.write_parquet(csv_days.merge_sources(spark, sources), out)
    return csv_days.merge_reconciliation(spark, sources, tables.read_parquet(spark, out))


@query
def stored_strategies(spark, sf_dir):
    out = f"{scratch_path(spark, 'flows')}_{STRATIFIED}_binary"
    tables.write_parquet(flows_raw(spark, sf_dir), out, ["source_day"])
    files = spark.read.parquet(out).select(strategy_in(F.col("_metadata.file_path")).alias("strategy"))
    return files.groupBy("strategy").agg(F.count("*").alias("n"))


@query
def merged_size_ratio(spark, sf_dir):
    out = scratch_path(spark, "merged")
    preparation.merge_job(spark, _landing(spark, sf_dir), out, widths=LANDED)
    return csv_days.size_comparison(spark, _landing(spark, sf_dir), out)


@query
def landing_label_mix(spark, sf_dir):
    merged = csv_days.merge_sources(spark, _sources(spark, sf_dir), "keep")
    return rounded(profile.label_distribution(cleaning.clean(merged, STRATIFIED)))


@query
def parquet_round_trip(spark, sf_dir):
    out = scratch_path(spark, "flows")
    tables.write_parquet(flows_raw(spark, sf_dir), out, ["source_day"])
    return tables.read_parquet(spark, out, ["row_no", "Protocol", LABEL])


@query
def flow_schema(spark, sf_dir):
    return tables.schema_table(cleaned_by_day(spark, sf_dir))


@query
def flow_row_count(spark, sf_dir):
    return tables.row_count(read(spark, sf_dir, "events"))


@query
def sweep_csv_round_trip(spark, sf_dir):
    out = scratch_path(spark, "sweep")
    sweep = diagnostics.threshold_sweep(scored(spark, sf_dir), 0.1234567)
    tables.write_csv(sweep, out)
    kinds = ", ".join(f"{name} {kind}" for name, kind in sweep.dtypes)
    return tables.read_csv(spark, out, kinds)


@query
def stored_threshold(spark, sf_dir):
    path = scratch_path(spark, "threshold")
    tables.save_threshold(spark, path, _threshold(spark, sf_dir))
    stored = tables.load_threshold(spark, path)
    absent = tables.load_threshold(spark, scratch_path(spark, "absent"))
    return scored(spark, sf_dir).agg(
        F.lit(stored).alias("threshold"),
        F.lit(absent).alias("default_threshold"),
        F.count_if(F.col("score") >= stored).alias("flagged"),
    )


# --- jobs over several stages ------------------------------------------------------------------------
def _prepared(spark, sf_dir, strategy) -> str:
    """Landing folder to split table by the library's jobs."""
    folder = _landing(spark, sf_dir)
    merged, clean_out, encoded_out, out = (scratch_path(spark, n) for n in ("merged", "cleaned", "encoded", "split"))
    preparation.merge_job(spark, folder, merged, strategy, widths=LANDED)
    preparation.clean_job(spark, merged, clean_out, strategy, width=13 if strategy == STRATIFIED else 14, labels=5)
    preparation.encode_job(spark, clean_out, encoded_out, strategy)
    preparation.split_job(spark, encoded_out, out, strategy)
    return out


@query
def prepared_stratified_balance(spark, sf_dir):
    rows = tables.read_parquet(spark, _prepared(spark, sf_dir, STRATIFIED))
    return rows.groupBy("side", TARGET).agg(F.count("*").alias("n"))


@query
def prepared_day_balance(spark, sf_dir):
    rows = tables.read_parquet(spark, _prepared(spark, sf_dir, TIME_BASED))
    return rows.groupBy("side", F.col("source_day").cast("string").alias("source_day"), TARGET).agg(
        F.count("*").alias("n")
    )


# --- model -------------------------------------------------------------------------------------------
@cache
def _line_split(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir).select(*LINE_KEY, *[c for c in LINE_FEATURES if c not in LINE_KEY], TARGET)
    return split.nested_split(rows, LINE_KEY)


@cache
def _small_model(spark, sf_dir):
    assembled = materialise(boosting.assemble(lines(spark, sf_dir), LINE_FEATURES, [*LINE_KEY, TARGET]), "lines")
    weight = split.class_weight(assembled).first()["weight"]
    return boosting.fit(assembled, weight, PLAIN_TREES, SMALL_FIT), assembled


@query
def model_scores(spark, sf_dir):
    model, assembled = _small_model(spark, sf_dir)
    return boosting.score_rows(model, assembled)


@query
def feature_importance(spark, sf_dir):
    model, _ = _small_model(spark, sf_dir)
    return boosting.feature_importance(model, LINE_FEATURES, spark)


@query
def model_round_trip(spark, sf_dir):
    model, assembled = _small_model(spark, sf_dir)
    path = scratch_path(spark, "model")
    tables.save_model(model, path)
    before = boosting.score_rows(model, assembled)
    after = boosting.score_rows(tables.load_model(path), assembled).withColumnRenamed("score", "again")
    both = before.join(after.drop(TARGET), LINE_KEY)
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("score") == F.col("again")).alias("same_scores"))


@query
def learning_curve(spark, sf_dir):
    train = _line_split(spark, sf_dir).filter("side = 'train'")
    phases = materialise(train.select(*LINE_FEATURES, TARGET, F.col("phase").alias("side")), "phases")
    assembled = boosting.assemble(phases, LINE_FEATURES, [TARGET, "side"])
    return boosting.grow(assembled, training.weight_of(assembled.filter("side = 'train'")), SMALL_FIT).curve


@cache
def _trained(spark, sf_dir):
    """A run on the order lines, saved; its tables are stored, so several queries can read the same one."""
    return training.train_and_evaluate(_line_split(spark, sf_dir), LINE_FEATURES, None, SMALL_FIT, _run_dir(spark, sf_dir))


@cache
def _run_dir(spark, sf_dir) -> str:
    return scratch_path(spark, "run")


@cache
def _trained_on_days(spark, sf_dir):
    rows = materialise(encoded_by_day(spark, sf_dir), "rows")
    sided = split.assign_days(rows, split.day_sides(split.day_table(rows)))
    features = split.feature_columns(sided, [*ORDER, "day_start"])
    place = ["day_start", "source_day", *ORDER]
    matrix = materialise(split.to_matrix(sided, key=place), "matrix")
    return training.train_and_evaluate(matrix, features, training.carve_tail(place, split.day_bucket()), SMALL_FIT)


@query
def train_and_evaluate(spark, sf_dir):
    run = _trained(spark, sf_dir)
    return run.metrics.withColumns({"threshold": F.lit(run.threshold), "n_trees": F.lit(run.n_trees)})


@query
def train_on_days(spark, sf_dir):
    return _trained_on_days(spark, sf_dir).report


@query
def post_run_analysis(spark, sf_dir):
    _trained(spark, sf_dir)
    test = _line_split(spark, sf_dir).filter("side = 'test'")
    found = post_run.post_run_analysis(test, LINE_FEATURES, _run_dir(spark, sf_dir))
    return found["sweep"]


# --- what SQL can state about the model queries without the trees ------------------------------------
@query
def scored_row_counts(spark, sf_dir):
    scores = model_scores(spark, sf_dir)
    inside = F.count_if(F.col("score").between(0.0, 1.0))
    return scores.groupBy(TARGET).agg(F.count("*").alias("n"), inside.alias("probabilities"))


@query
def reloaded_scores_agree(spark, sf_dir):
    return model_round_trip(spark, sf_dir)


@query
def importance_total(spark, sf_dir):
    return rounded(feature_importance(spark, sf_dir).agg(F.count("*").alias("features"), F.sum("importance").alias("total")))


@query
def curve_summary(spark, sf_dir):
    sides = _trained(spark, sf_dir).curve.groupBy("side").agg(F.countDistinct("n_trees").alias("points"), F.count_if("is_best").alias("best"))
    return sides.agg(F.countDistinct("points").alias("lengths"), F.sum("best").alias("best"), F.max(F.when(F.col("best") > 0, F.col("side"))).alias("best_side"))


@query
def evaluated_class_sizes(spark, sf_dir):
    return _trained(spark, sf_dir).metrics.select("positives", "negatives")


@query
def sweep_class_sizes(spark, sf_dir):
    sweep = post_run_analysis(spark, sf_dir)
    return sweep.select((F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives")).distinct()


@query
def day_model_support(spark, sf_dir):
    return train_on_days(spark, sf_dir).select("row", "support")


@query
def prepared_model_support(spark, sf_dir):
    run_dir = scratch_path(spark, "run")
    run = training.train_job(spark, _prepared(spark, sf_dir, STRATIFIED), run_dir, STRATIFIED, SMALL_FIT)
    return run.report.select("row", "support")


@query
def model_feature_gate(spark, sf_dir):
    rows = lines(spark, sf_dir)
    report = gates.feature_gate([*LINE_FEATURES, "gone"], rows.select(*LINE_FEATURES, "l_partkey"))
    return report.withColumn("rows", rows.agg(F.count("*")).scalar())


@query
def inventory_widths(spark, sf_dir):
    return source_inventory(spark, sf_dir).select("source", "columns", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


@query
def merged_is_smaller(spark, sf_dir):
    return merged_size_ratio(spark, sf_dir).select((F.col("ratio") > 1).alias("smaller"))
