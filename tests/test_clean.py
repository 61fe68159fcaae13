import pytest
from pyspark.sql import functions as F

from flowsift.operators import clean as c
from flowsift.operators.dedup import keep_first
from flowsift.schema import STRATIFIED, TIME_BASED
from tests.plans import plan_of, rows

COLUMNS = ["Protocol", "Timestamp", "Flow Duration", "Flow IAT Min", "Init Fwd Win Byts", "Flow Byts/s", "Dst Port", "Label"]


def flows(spark, *overrides):
    """Rows that differ from a good one by the given values; ``day`` and ``row_no`` count up."""
    base = dict(zip(COLUMNS, ["6", "01/03/2018 08:00:00", "10", "1", "5", "2", "80", "Benign"]))
    data = []
    for i, change in enumerate(overrides):
        row = {**base, **change}
        data.append((row.get("day", "d1"), i, *[row[k] for k in COLUMNS]))
    kinds = ", ".join(f"`{k}` string" for k in COLUMNS)
    return spark.createDataFrame(data, f"source_day string, row_no bigint, {kinds}")


def cleaned(spark, *overrides, strategy=STRATIFIED):
    return c.clean(flows(spark, *overrides), strategy, ["row_no"]).orderBy("row_no").collect()


def unique(i):
    return {"Flow Byts/s": str(100 + i)}


def test_ghost_rows_go_and_labels_are_trimmed(spark):
    bad = [{"Protocol": " Protocol "}] + [{"Label": v} for v in (None, "", "  ", "nan", "NaN", "null", "Null")]
    kept = cleaned(spark, *bad, {"Label": "Bot "}, {"Label": "Bot", **unique(1)})
    assert [r["Label"] for r in kept] == ["Bot", "Bot"]


def test_unusable_numbers_go(spark):
    bad = [{"Flow Byts/s": v} for v in ("abc", "", None, "Infinity", "-inf", "nan", "1d", "0x1p3", "1_000", "1e400")]
    kept = cleaned(spark, *bad, {"Flow Byts/s": " 1 "}, {"Flow Byts/s": "1e3"}, {"Flow Byts/s": "-0.0"})
    assert [r["Flow_Byts_s"] for r in kept] == [1.0, 1000.0, 0.0]


def test_negative_durations_go(spark):
    assert [r["Flow_Duration"] for r in cleaned(spark, {"Flow Duration": "-1"}, {"Flow Duration": "0"})] == [0.0]


def test_first_copy_keeps_its_timestamp(spark):
    kept = cleaned(spark, {"Timestamp": "02/03/2018 00:00:00"}, {"Timestamp": "01/03/2018 00:00:00"}, strategy=TIME_BASED)
    assert [(r["row_no"], r["Timestamp"]) for r in kept] == [(0, "02/03/2018 00:00:00")]


def test_copies_on_two_days(spark):
    assert len(cleaned(spark, {"day": "d1"}, {"day": "d2"})) == 1
    assert len(cleaned(spark, {"day": "d1"}, {"day": "d2"}, strategy=TIME_BASED)) == 2


def test_clipping_follows_dedup(spark):
    kept = cleaned(spark, {"Flow IAT Min": "-5"}, {"Flow IAT Min": "0"})
    assert [r["Flow_IAT_Min"] for r in kept] == [0.0, 0.0]


def test_rows_made_alike_by_clipping_have_their_own_key(spark):
    raw = flows(spark, {"Flow IAT Min": "-5"}, {"Flow IAT Min": "0"}).drop("row_no")
    out = c.clean(raw, STRATIFIED, row_key="row_key")
    assert out.select("row_key").distinct().count() == 2 and out.drop("row_key").distinct().count() == 1


def test_window_sentinel_stays(spark):
    assert cleaned(spark, {"Init Fwd Win Byts": "-1"})[0]["Init_Fwd_Win_Byts"] == -1.0


def test_columns(spark):
    raw = flows(spark, {})
    assert c.clean(raw, STRATIFIED).columns == ["Protocol", "Flow_Duration", "Flow_IAT_Min", "Init_Fwd_Win_Byts", "Flow_Byts_s", "Label"]
    assert "Timestamp" in c.clean(raw, TIME_BASED, ["row_no"]).columns
    with pytest.raises(ValueError):
        c.clean(raw, TIME_BASED)
    with pytest.raises(ValueError):
        c.clean(raw, "multiclass")


def test_funnel_matches_the_steps(spark):
    raw = flows(
        spark,
        {"Protocol": "Protocol"},
        {"Label": " "},
        {"Flow Byts/s": "x"},
        {"Flow Duration": "-3"},
        {},
        {},
        {"day": "d2"},
        unique(1),
    )
    got = [(r["step"], r["rows_in"], r["rows_dropped"], r["rows_out"]) for r in c.cleaning_funnel(raw, STRATIFIED, ["row_no"]).orderBy("step_no").collect()]
    assert got == [
        ("ghost_rows", 8, 2, 6),
        ("unusable_numbers", 6, 1, 5),
        ("negative_duration", 5, 1, 4),
        ("duplicates", 4, 2, 2),
    ]
    by_day = c.cleaning_funnel(raw, TIME_BASED, ["row_no"]).filter("step = 'duplicates'").orderBy("source_day").collect()
    assert [(r["source_day"], r["rows_dropped"], r["rows_out"]) for r in by_day] == [("d1", 1, 2), ("d2", 0, 1)]
    assert c.clean(raw, STRATIFIED, ["row_no"]).count() == 2


def test_shrinkage(spark):
    raw = flows(spark, {}, {}, unique(1), {"Label": ""})
    row = c.shrinkage(raw, c.clean(raw, STRATIFIED, ["row_no"])).first()
    assert tuple(row) == (4, 2, 2, 50.0)


def hot_copies(spark, n=30_000):
    """A third of the rows are copies of one row."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    return spark.range(0, n, 1, 16).select(key.cast("double").alias("a"), (key % 5).alias("b"), F.col("id").alias("row_no"), F.concat(F.lit("t"), "id").alias("note"))


def test_keep_first_plans_agree_under_a_hot_group(spark):
    df = hot_copies(spark)
    expected = rows(df.groupBy("a", "b").agg(F.min("row_no").alias("row_no")))
    slim = keep_first(df.select("a", "b", "row_no"), ["a", "b"], ["row_no"])
    wide = keep_first(df, ["a", "b"], ["row_no"])
    assert rows(slim) == expected
    assert rows(wide.select("a", "b", "row_no")) == expected
    assert wide.filter("note <> concat('t', row_no)").isEmpty()
    assert keep_first(df.select("a", "b"), ["a", "b"]).count() == len(expected)
    with pytest.raises(ValueError):
        keep_first(df, ["a", "b"])


def test_copies_fold_before_the_shuffle(spark):
    df = hot_copies(spark)
    wide = plan_of(keep_first(df, ["a", "b"], ["row_no"]))
    assert "Partial" in wide[wide.index("Exchange"):] and wide.count("WindowGroupLimit") == 2
    slim = plan_of(keep_first(df.select("a", "b", "row_no"), ["a", "b"], ["row_no"]))
    assert "partial_min" in slim and "Window" not in slim and "Sort" not in slim
