import math

import pytest
from pyspark.sql import functions as F

from flowsift.functions import scalars
from flowsift.schema import unused_columns


def evaluate(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_to_number_accepts_decimal_notation_only(spark):
    good = {" 1 ": 1.0, "1e3": 1000.0, "-0.0": 0.0, "+3": 3.0, ".5": 0.5, "5.": 5.0, "\t2\n": 2.0, "-1E-2": -0.01}
    bad = ["abc", "", " ", "Infinity", "-inf", "nan", "NaN", "1d", "1f", "0x1p3", "1_000", ".", "1e400", "-1e400", None, "1 2"]
    assert evaluate(spark, list(good), scalars.to_number) == list(good.values())
    assert evaluate(spark, bad, scalars.to_number) == [None] * len(bad)


def test_negative_zero_becomes_zero(spark):
    (zero,) = evaluate(spark, ["-0.0"], scalars.parse_number)
    assert math.copysign(1.0, zero) == 1.0


def test_finite_drops_nan_and_infinities(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert evaluate(spark, values, scalars.finite, "double") == [1.0, None, None, None, None]


def test_empty_labels(spark):
    empty = [None, "", "  ", "nan", "NaN", "null", "Null", " nan "]
    assert evaluate(spark, empty, scalars.is_empty_label) == [True] * len(empty)
    assert evaluate(spark, ["Benign", "Bot "], scalars.is_empty_label) == [False, False]


def test_stray_header(spark):
    assert evaluate(spark, [" Protocol ", "Protocol", "6", None], scalars.is_stray_header) == [True, True, False, False]


def test_clip_keeps_null(spark):
    assert evaluate(spark, [-5.0, 0.0, 2.0, None], scalars.clip_lower, "double") == [0.0, 0.0, 2.0, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_epoch_seconds_ignore_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        values = ["01/03/2018 8:2:3", "28/02/2018 23:59:59", "11/03/2018 02:30:00", "30/02/2018 00:00:00", "2018-02-28 01:01:01", None]
        assert evaluate(spark, values, scalars.epoch_seconds) == [1519891323, 1519862399, 1520735400, None, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_missing_tokens(spark):
    assert evaluate(spark, ["NA", "", "None", "0", " NA"], scalars.missing_to_null) == [None, None, None, "0", " NA"]


def test_digest_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a")], "x string, y string")
    assert df.select(scalars.content_digest(["x", "y"], 42).alias("d")).distinct().count() == 3


def test_fingerprint_is_unique_per_row(spark):
    df = spark.range(20000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).alias("b"))
    assert df.select(scalars.row_fingerprint(["a", "b"]).alias("k")).distinct().count() == 20000


def test_strategy_names(spark):
    paths = ["file:/x_8020_stratified_binary_1.parquet", "/flows_time_based_binary/part-0", "flows.parquet", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    found = [r[0] for r in df.select(scalars.strategy_in(F.col("p"))).collect()]
    assert found == ["8020_stratified", "time_based", None, None]
    assert len(unused_columns("8020_stratified")) == 22 and "Timestamp" in unused_columns("8020_stratified")
    assert len(unused_columns("time_based")) == 21 and "Timestamp" not in unused_columns("time_based")
    with pytest.raises(ValueError):
        unused_columns("multiclass")
