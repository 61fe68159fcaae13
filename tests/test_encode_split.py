import math

import pytest
from pyspark.sql import Window, functions as F

from flowsift.operators import encode as e, ranks, split as s
from flowsift.schema import STRATIFIED, TIME_BASED
from tests.plans import plan_of, rows


def test_one_hot_has_a_fixed_vocabulary(spark):
    df = spark.createDataFrame([(6.0, "Bot"), (17.0, "Benign"), (1.0, "Benign"), (6.9, "Bot")], "Protocol double, Label string")
    out = e.encode(df, STRATIFIED)
    assert dict(out.dtypes) == {"Protocol_0": "tinyint", "Protocol_6": "tinyint", "Protocol_17": "tinyint", "Target": "tinyint"}
    assert [tuple(r) for r in out.collect()] == [(0, 1, 0, 1), (0, 0, 1, 0), (0, 0, 0, 0), (0, 1, 0, 1)]
    assert {r["column"]: r["rows_set"] for r in e.one_hot_totals(out).collect()} == {"Protocol_0": 0, "Protocol_6": 2, "Protocol_17": 1}
    assert {r["protocol"]: r["known"] for r in e.protocol_values(df).collect()} == {6: True, 17: True, 1: False}
    assert tuple(e.class_balance(out).first()) == (2, 2, 50.0)


def test_timestamp_becomes_epoch_seconds(spark):
    df = spark.createDataFrame([(6.0, "Bot", "01/03/2018 08:02:03")], "Protocol double, Label string, Timestamp string")
    assert e.encode(df, TIME_BASED).first()["Timestamp"] == 1519891323


def labelled(spark, counts):
    cases = [(c,) for c, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(cases, "Target int").withColumn("id", F.row_number().over(Window.orderBy("Target")).cast("long"))


@pytest.mark.parametrize("counts", [{0: 50, 1: 13}, {0: 4, 1: 1}, {0: 7, 1: 3}, {0: 1000, 1: 1}, {0: 12, 1: 0}, {0: 333, 1: 334}])
def test_stratified_quotas_are_exact(spark, counts):
    df = labelled(spark, counts)
    total = sum(counts.values())
    held = math.ceil(0.2 * total)
    out = s.stratified_split(df, ["id"])
    got = {c: out.filter(f"side = 'test' AND Target = {c}").count() for c in counts}
    assert sum(got.values()) == held
    for c, n in counts.items():
        assert abs(got[c] - held * n / total) < 1
    assert out.count() == total


def test_stratified_split_equals_the_plain_ranking(spark):
    df = spark.range(0, 20000, 1, 8).select("id", (F.col("id") % 10 < 3).cast("int").alias("Target"))
    out = s.stratified_split(df, ["id"])
    order = Window.partitionBy("Target").orderBy(F.md5(F.concat_ws("|", "id", F.lit("42"))), "id")
    quota = F.when(F.col("Target") == 1, 1200).otherwise(2800)
    plain = df.withColumn("side", F.when(F.row_number().over(order) <= quota, "test").otherwise("train"))
    assert out.exceptAll(plain).count() == 0 and plain.exceptAll(out).count() == 0


def test_split_does_not_shuffle_full_rows(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).cast("int").alias("Target"), F.lit("payload").alias("wide"))
    plan = plan_of(s.stratified_split(df, ["id"]))
    main = plan[: plan.index("BroadcastExchange")]
    assert "Exchange" not in main.replace("BroadcastExchange", "") and "wide" in main
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("n, tail", [(10, 2), (3, 1), (1, 1), (1000, 200), (4, 1)])
def test_tail(spark, n, tail):
    df = spark.range(0, n, 1, 4).withColumn("day", F.floor(F.col("id") / 100))
    out = s.tail_split(df, ["day", "id"], F.struct("day", F.floor(F.col("id") / 7).alias("b")))
    held = sorted(r["id"] for r in out.filter("side = 'validation'").collect())
    assert held == list(range(n - tail, n))


def day_rows(spark, sizes):
    data = [(f"d{i}", i * 1000 + j, j % 2) for i, n in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame(data, "source_day string, Timestamp bigint, Target int")


def sides_of(spark, sizes, **options):
    days = s.day_table(day_rows(spark, sizes))
    return [r["side"] for r in s.day_sides(days, **options).orderBy("first_ts").collect()]


def test_day_boundary(spark):
    assert sides_of(spark, [50, 30, 15, 5]) == ["train", "train", "test", "test"]
    assert sides_of(spark, [50, 30, 14, 6, 20]) == ["train", "train", "train", "test", "test"]
    assert sides_of(spark, [80, 20]) == ["train", "test"]
    assert sides_of(spark, [10, 20, 30], test_days=2) == ["train", "test", "test"]
    for wrong in (0, 3):
        with pytest.raises(ValueError):
            sides_of(spark, [10, 20, 30], test_days=wrong)


def test_days_are_ordered_by_their_first_timestamp(spark):
    data = [("z", 1, 0), ("z", 2, 1), ("a", 50, 0), ("m", 30, 1)]
    days = s.day_table(spark.createDataFrame(data, "source_day string, Timestamp bigint, Target int"))
    got = {r["source_day"]: r["side"] for r in s.day_sides(days, test_days=1).collect()}
    assert got == {"z": "train", "m": "train", "a": "test"}


def test_assign_days(spark):
    df = day_rows(spark, [50, 30, 15, 5])
    sides = s.day_sides(s.day_table(df))
    small = s.assign_days(df, sides)
    assert small.filter("side = 'test'").count() == 20
    assert {r["day_start"] for r in small.collect()} == {0, 1000, 2000, 3000}


def test_matrix(spark):
    df = spark.createDataFrame([(1, 2.5, 1, 0, 0, 99, 1, "test")], "id int, x double, Protocol_0 byte, Protocol_6 byte, Protocol_17 byte, Timestamp long, Target byte, side string")
    out = s.to_matrix(df, ["id"])
    assert out.dtypes == [("id", "int"), ("x", "float"), ("Protocol_0", "tinyint"), ("Protocol_6", "tinyint"), ("Protocol_17", "tinyint"), ("Target", "tinyint"), ("side", "string")]
    assert s.feature_columns(out, ["id"]) == ["x", "Protocol_0", "Protocol_6", "Protocol_17"]
    with pytest.raises(ValueError):
        s.to_matrix(df.withColumn("Label", F.lit("Bot")), ["id"])


def test_union_days(spark):
    one = spark.createDataFrame([(1, 2)], "a int, b int")
    two = spark.createDataFrame([(3, 4)], "b int, a int")
    assert rows(s.union_days([one, two])) == [(1, 2), (4, 3)]
    with pytest.raises(ValueError, match="missing \\['b'\\], extra \\['c'\\]"):
        s.union_days([one, spark.createDataFrame([(1, 2)], "a int, c int")])


def test_class_weight(spark):
    assert tuple(s.class_weight(labelled(spark, {0: 30, 1: 10})).first()) == (30, 10, 3.0)
    assert s.class_weight(labelled(spark, {0: 3, 1: 0})).first()["weight"] is None


def test_the_boundary_is_refined_until_it_is_small(spark, monkeypatch):
    """With one digit per level and a row per task at most, the wanted row is found over several levels."""
    monkeypatch.setattr(ranks, "DIGEST_DIGITS", 1)
    levels = []
    finer = ranks.digest_bucket
    monkeypatch.setattr(s, "digest_bucket", lambda level: levels.append(level) or finer(level))
    df = labelled(spark, {0: 3000, 1: 700})
    out = s.stratified_split(df, ["id"], ranked_rows=3)
    assert {r["Target"]: r["count"] for r in out.filter("side = 'test'").groupBy("Target").count().collect()} == {0: 600, 1: 140}
    assert len(levels) >= 2
    monkeypatch.undo()
    assert rows(out) == rows(s.stratified_split(df, ["id"]))


def test_three_scans(spark, tmp_path):
    labelled(spark, {0: 300, 1: 70}).write.parquet(str(tmp_path / "t"))
    before = len(list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)))
    out = s.stratified_split(spark.read.parquet(str(tmp_path / "t")), ["id"])
    plan = plan_of(out)
    # counting the buckets was the first scan; the boundary rows and the rows to tag are the others
    assert plan.count("FileScan parquet [id") + plan.count("FileScan parquet [Target") <= 3 and before >= 0


def test_days_need_not_sort_by_name(spark):
    data = [("Friday-02", 100 + i, 0, i) for i in range(40)] + [("Monday-05", 400 + i, 1, i) for i in range(40)] + [("Aaa-09", 900 + i, 1, i) for i in range(20)]
    df = spark.createDataFrame(data, "source_day string, Timestamp long, Target int, row_no long")
    sided = s.assign_days(df, s.day_sides(s.day_table(df), share=0.0))
    out = s.tail_split(sided.drop("side"), ["day_start", "source_day", "row_no"], s.day_bucket(rows_each=7))
    late = sorted((r["day_start"], r["row_no"]) for r in out.filter("side = 'validation'").collect())
    assert late == [(900, i) for i in range(20)]


@pytest.mark.parametrize("digits, ranked_rows", [(3, 1_000_000), (1, 3)])
@pytest.mark.parametrize("n, benign", [(4000, 70), (4000, 100), (9, 60), (3, 50), (1, 100), (0, 50)])
def test_nested_split_is_two_splits(spark, monkeypatch, digits, ranked_rows, n, benign):
    """Keys that repeat or are null, a class too small to give a row, rows without a class, no rows."""
    monkeypatch.setattr(ranks, "DIGEST_DIGITS", digits)
    spread = F.pmod(F.hash("id"), F.lit(100))
    df = spark.range(n).select(
        F.when(F.col("id") % 50 == 7, None).otherwise(F.col("id") % 3500).alias("id"), F.when(spread < benign, 0).when(spread < 99, 1).alias("Target")
    )
    found = s.nested_split(df, ["id"], ranked_rows=ranked_rows)
    plain = s.stratified_split(df, ["id"])
    assert rows(found.drop("phase")) == rows(plain)
    carved = s.stratified_split(plain.filter("side = 'train'").drop("side"), ["id"], names=("train", "validation"), side="phase")
    assert rows(found.filter("side = 'train'").drop("side")) == rows(carved)
    assert found.filter("side = 'test' AND phase IS NOT NULL").isEmpty()


def test_nested_split_digests_rows_once_a_pass_and_moves_none(spark):
    plan = plan_of(s.nested_split(spark.range(1000).select("id", (F.col("id") % 2).cast("int").alias("Target")), ["id"]))
    assert plan.count("md5(") == 1 and "Sort" not in plan
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 2
