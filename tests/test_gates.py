import pytest
from pyspark.sql import functions as F

from flowsift.operators import gates as g
from flowsift.schema import STRATIFIED, TIME_BASED


def failed(report):
    return {r["check"] for r in report.collect() if not r["passed"]}


def cleaned(spark, rows=((1.0, 0.0, 0.0, "Benign"), (2.0, 1.0, 6.0, "Bot"))):
    return spark.createDataFrame(list(rows), "Flow_Duration double, Flow_IAT_Min double, Protocol double, Label string")


def test_clean_table_passes(spark):
    report = g.cleaned_gate(cleaned(spark), STRATIFIED, width=4, labels=2)
    assert failed(report) == set() and g.enforce(report) == []


@pytest.mark.parametrize(
    "row, check",
    [
        ((-1.0, 0.0, 0.0, "Benign"), "min_duration"),
        ((1.0, -2.0, 0.0, "Benign"), "min_interval"),
        ((float("inf"), 0.0, 0.0, "Benign"), "infinite_cells"),
        ((float("nan"), 0.0, 0.0, "Benign"), "missing_cells"),
        ((1.0, None, 0.0, "Benign"), "missing_cells"),
        ((1.0, 0.0, 0.0, " Benign"), "padded_labels"),
        ((1.0, 0.0, 0.0, "Other"), "label_count"),
    ],
)
def test_bad_rows_fail(spark, row, check):
    df = cleaned(spark, [(1.0, 0.0, 0.0, "Benign"), (2.0, 1.0, 6.0, "Bot"), row])
    report = g.cleaned_gate(df, STRATIFIED, width=4, labels=2)
    assert check in failed(report)
    with pytest.raises(g.GateError, match=check):
        g.enforce(report)


def test_schema_checks(spark):
    df = cleaned(spark).withColumn("Dst_Port", F.lit(1.0)).withColumn("a b", F.lit(1.0))
    assert failed(g.cleaned_gate(df, TIME_BASED, width=63, labels=2)) == {"width", "dropped_columns", "timestamp_presence", "column_names"}


def test_merged_gate(spark):
    df = spark.range(10).select(F.lit("x").alias("a"), F.lit("y").alias("b"))
    assert failed(g.merged_gate(df, rows=12, tolerance=3, width=2)) == set()
    assert failed(g.merged_gate(df, rows=100, tolerance=3, width=2)) == {"row_count"}
    drifted = g.merged_gate(df, rows=10, tolerance=1, width=1, drifted_width=2)
    assert g.enforce(drifted) == ["base_width"]
    assert "text_columns" in failed(g.merged_gate(df.withColumn("c", F.lit(1)), rows=10, tolerance=1, width=3))
    assert "known_width" in failed(g.merged_gate(df, rows=10, tolerance=1))


def test_encode_input_gate(spark):
    df = cleaned(spark).withColumn("Timestamp", F.lit("01/03/2018 08:00:00"))
    assert failed(g.encode_input_gate(df, TIME_BASED)) == set()
    assert failed(g.encode_input_gate(df, STRATIFIED)) == {"timestamp_presence"}
    unknown = df.withColumn("Protocol", F.lit(1.0))
    assert g.enforce(g.encode_input_gate(unknown, TIME_BASED)) == ["unknown_protocols"]
    bad = df.withColumn("Timestamp", F.lit("2018-03-01 08:00:00"))
    assert failed(g.encode_input_gate(bad, TIME_BASED)) == {"unreadable_timestamps"}
    assert failed(g.encode_input_gate(df.withColumn("Dst_Port", F.lit(1)), TIME_BASED)) == {"leaking_columns"}
    assert failed(g.encode_input_gate(df.drop("Label"), TIME_BASED)) == {"required_columns"}


def test_encoded_gate(spark):
    df = cleaned(spark)
    assert failed(g.encoded_gate(df.drop("Label"))) == set()
    assert failed(g.encoded_gate(df)) == {"numeric_columns"}
    assert failed(g.encoded_gate(df.drop("Label").withColumn("x", F.lit(None).cast("double")))) == {"rows_with_missing_cells"}


def test_side_gate(spark):
    even = spark.range(100).select((F.col("id") % 2).alias("Target"), F.when(F.col("id") < 80, "train").otherwise("test").alias("side"))
    assert failed(g.side_gate(even, "side", "Target")) == set()
    no_attack = even.withColumn("Target", F.when(F.col("side") == "test", 0).otherwise(F.col("Target")))
    assert failed(g.side_gate(no_attack, "side", "Target")) == {"test_attacks", "attack_share_drift"}
    no_train = even.withColumn("side", F.lit("test"))
    assert {"train_rows", "attack_share_drift"} <= failed(g.side_gate(no_train, "side", "Target"))


def test_feature_gate_and_required_names(spark):
    df = spark.createDataFrame([(1, 2, 0)], "a int, b int, Target int")
    assert failed(g.feature_gate(["a", "b"], df, ["Target"])) == set()
    assert failed(g.feature_gate(["a", "c"], df, ["Target"])) == {"model_features"}
    assert g.required_names(["train"], ["train", "test"]) == ["test"]
