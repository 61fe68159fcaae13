import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsift.operators import profile as p
from tests.plans import plan_of


def text_rows(spark):
    data = [
        ("6", "Benign", "1", "0", "-1"),
        (" Protocol ", "Bot ", "x", "0", "-2"),
        ("17", "Bot", "Infinity", "0", "5"),
        ("0", "nan", "3", "7", "abc"),
        ("0", None, "4", "0", "-1"),
    ]
    return spark.createDataFrame(data, "Protocol string, Label string, a string, z string, `Flow IAT Min` string")


def test_labels(spark):
    got = [tuple(r) for r in p.label_distribution(text_rows(spark)).collect()]
    assert got == [("Benign", 1, 25.0, False), ("Bot", 1, 25.0, False), ("Bot ", 1, 25.0, True), ("nan", 1, 25.0, False)]


def test_ghosts(spark):
    assert tuple(p.ghost_counts(text_rows(spark)).first()) == (1, 2)


def test_stats_leave_out_unusable_values(spark):
    row = p.feature_stats(text_rows(spark), ["a"]).first()
    values = np.array([1.0, 3.0, 4.0])
    assert (row["n"], row["min"], row["max"]) == (3, 1.0, 4.0)
    assert row["mean"] == pytest.approx(values.mean()) and row["std"] == pytest.approx(values.std(ddof=1))


def test_describe_text(spark):
    got = {r["column"]: tuple(r)[1:] for r in p.describe_text(text_rows(spark), ["Protocol", "Label", "z"]).collect()}
    assert got["z"] == (5, 2, "0", 4)
    assert got["Protocol"] == (5, 4, "0", 2)
    assert got["Label"] == (4, 4, "Benign", 1)


def test_negatives(spark):
    df = text_rows(spark)
    assert tuple(p.negative_summary(df, "Flow IAT Min").first()) == (5, 3, 60.0)
    assert [tuple(r) for r in p.negative_intervals(df).collect()] == [("Flow IAT Min", 3, -2.0)]
    assert p.negative_intervals(df.drop("Flow IAT Min")).count() == 0
    assert [r["n"] for r in p.negative_labels(df, "Flow IAT Min", 2).collect()] == [1, 1]


def test_near_constant(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 5, "1").otherwise("0").alias("flat"), (F.col("id") % 4).cast("string").alias("varied")
    )
    got = {r["column"]: r for r in p.near_constant(df, ["flat", "varied", "absent"]).collect()}
    assert set(got) == {"flat", "varied"}
    assert got["flat"]["droppable"] and got["flat"]["distinct_values"] == 2 and got["flat"]["zero_pct"] == 99.5
    assert not got["varied"]["droppable"]
    assert "Expand" not in plan_of(p.near_constant(df, ["flat", "varied"]))
    assert p.near_constant(df, ["absent"]).count() == 0


def test_redundant_pairs(spark):
    df = spark.range(100).select(
        F.col("id").cast("string").alias("a"), (F.col("id") * 2).cast("string").alias("b"), (F.col("id") % 3).cast("string").alias("c")
    )
    got = {(r["dropped"], r["kept"]): r["droppable"] for r in p.redundant_pairs(df, [("a", "b"), ("a", "c"), ("a", "x")]).collect()}
    assert got == {("a", "b"): True, ("a", "c"): False}
    assert p.redundant_pairs(df, [("x", "y")]).count() == 0


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.normal(size=(200, 3)), columns=["x", "y", "z"]).assign(Target=rng.integers(0, 2, 200), flat=1.0)
    frame["x"] += frame["Target"]
    df = spark.createDataFrame(frame)
    names = ["x", "y", "z", "flat", "Target"]
    expected = frame[names].corr()
    for r in p.correlation_matrix(df, names).collect():
        value = expected.loc[r["feature_a"], r["feature_b"]]
        assert r["corr"] is None if np.isnan(value) else r["corr"] == pytest.approx(value)
    top = [r["feature"] for r in p.top_correlated(df, ["x", "y", "z", "flat"], k=2).collect()]
    assert top == list(expected["Target"].drop("Target").abs().sort_values(ascending=False).index[:2])


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (2, None), (5, "b"), (9, "b")], "n int, s string")
    got = [tuple(r) for r in p.column_profile(df).collect()]
    assert got == [("n", "int", 1, "1"), ("n", "int", 2, "2"), ("n", "int", 3, "5"), ("s", "string", 1, "a"), ("s", "string", 2, "b")]


def test_sample_is_exact_and_reproducible(spark):
    df = spark.range(0, 5000, 1, 8).withColumn("v", F.col("id") % 11)
    once = p.sample_rows(df, 777, ["id"])
    again = p.sample_rows(df.repartition(3), 777, ["id"])
    assert once.count() == 777 and once.exceptAll(again).count() == 0
    assert p.sample_rows(df, 9999, ["id"]).count() == 5000
    assert p.sample_rows(df, 777, ["id"], seed=1).exceptAll(once).count() > 0


def test_log_quartiles(spark):
    frame = pd.DataFrame({"v": [0.0, 1.0, 5.0, 9.0, -1.0, 2.0], "Target": [0, 0, 0, 0, 0, 1]})
    row = p.log_quartiles(spark.createDataFrame(frame), ["v"]).filter("Target = 0").first()
    logs = np.log1p([0.0, 1.0, 5.0, 9.0])
    assert row["n"] == 4
    assert [row["q1"], row["median"], row["q3"]] == pytest.approx(list(np.percentile(logs, [25, 50, 75])))


@pytest.mark.parametrize("seed", range(3))
def test_log_quartiles_over_all_rows(spark, seed):
    random = np.random.default_rng(seed)
    frame = pd.DataFrame({"v": np.r_[np.exp(random.normal(0, 4, 4000)), np.full(3000, 2.5), np.zeros(10)], "Target": random.integers(0, 2, 7010)})
    for row in p.log_quartiles(spark.createDataFrame(frame), ["v"]).collect():
        logs = np.log1p(frame[frame.Target == row["Target"]].v)
        assert row["n"] == len(logs) and row["low"] == pytest.approx(logs.min()) and row["high"] == pytest.approx(logs.max())
        assert [row["q1"], row["median"], row["q3"]] == pytest.approx(list(np.percentile(logs, [25, 50, 75])))


def test_log_bins_have_no_pool(spark):
    df = spark.createDataFrame([(float(np.expm1(x)), 0) for x in (0.5, 25.5, 30.5, -1.5, 600.5)], "v double, Target int")
    assert sorted(r["bin"] for r in p.log_histogram(df, ["v"]).collect()) == [-2, 0, 25, 30, 600]


def test_explore(spark):
    random = np.random.default_rng(4)
    y = random.integers(0, 2, 500)
    frame = pd.DataFrame({"strong": y * 2.0 + random.random(500), "weak": y * 0.2 + random.random(500), "none": random.random(500), "flat": 1.0, "Target": y})
    found = p.explore(spark.createDataFrame(frame), ["none", "flat", "weak", "strong"], k=2, drawn=1)
    assert [r["feature"] for r in found["strongest"].collect()] == ["strong", "weak"]
    assert {r["feature_a"] for r in found["matrix"].collect()} == {"strong", "weak", "Target"}
    assert {r["feature"] for r in found["quartiles"].collect()} == {"strong"}
    corr = {(r["feature_a"], r["feature_b"]): r["corr"] for r in p.correlation_matrix(spark.createDataFrame(frame), ["strong", "flat", "Target"]).collect()}
    assert corr["strong", "Target"] == pytest.approx(np.corrcoef(frame.strong, y)[0, 1]) and corr["strong", "strong"] == 1.0
    assert corr["flat", "flat"] is None and corr["flat", "Target"] is None


def quartiles_of(df, **options):
    rows = p.log_quartiles(df, ["v"], **options).collect()
    return {r["Target"]: [r["n"], r["low"], r["q1"], r["median"], r["q3"], r["high"]] for r in rows}


def test_quartiles_of_a_crowded_bucket(spark):
    near = F.pmod(F.hash("id"), F.lit(1_000_003)) * 1e-16 + 5.0  # all in one bucket, and in one of its parts
    df = spark.range(0, 60_000, 1, 4).select((F.col("id") % 2).cast("int").alias("Target"), F.when(F.col("id") % 7 == 0, 5.0).when(F.col("id") < 40, F.col("id") * 1e9).otherwise(near).alias("v"))
    plain = df.toPandas()
    found = quartiles_of(df, ranked_rows=50)
    for target, values in plain.groupby("Target")["v"]:
        logs = np.log1p(values.to_numpy())
        assert found[target] == pytest.approx([len(logs), logs.min(), *np.quantile(logs, [0.25, 0.5, 0.75]), logs.max()], rel=1e-12)
    assert quartiles_of(df) == found


def test_a_million_values_in_one_bucket(spark):
    df = spark.range(0, 1_200_000, 1, 8).select(F.lit(1).alias("Target"), (F.col("id") * 1e-12 + 1.0).alias("v"))
    found = quartiles_of(df, ranked_rows=20_000)[1]
    logs = np.log1p(np.arange(1_200_000) * 1e-12 + 1.0)
    assert found == pytest.approx([len(logs), logs.min(), *np.quantile(logs, [0.25, 0.5, 0.75]), logs.max()], rel=1e-14)


def test_correlations_spread_no_rows_and_keep_digits(spark):
    pick = np.random.default_rng(5)
    x = pick.normal(size=3000)
    frame = pd.DataFrame({"a": 1e9 + x, "b": 1e9 - 2 * x + pick.normal(size=3000), "flat": 1e9, "c": x**2})
    frame.loc[::11, "c"] = np.nan
    found = {(r["feature_a"], r["feature_b"]): r["corr"] for r in p.correlation_matrix(spark.createDataFrame(frame).repartition(5), list(frame)).collect()}
    wanted = frame.dropna()[["a", "b", "c"]].corr()
    for a in "abc":
        for b in "abc":
            assert found[a, b] == pytest.approx(wanted.loc[a, b], abs=1e-6)
        assert found[a, "flat"] is found["flat", a] is None
    assert found["flat", "flat"] is None and len(found) == 16
    empty = p.correlation_matrix(spark.createDataFrame(frame).limit(0), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r["corr"] is None for r in empty)


def test_column_profile_of_many_types_and_tasks(spark):
    df = spark.range(0, 500, 1, 7).selectExpr(
        "cast(id as int) n", "date_add(date'2020-01-01', cast(id % 4 as int)) d", "if(id % 2 = 0, null, concat('t', id % 5)) t", "cast(null as double) none", "id % 2 = 0 flag", "cast(id % 3 as decimal(5,1)) dec",
    )
    found = {}
    for r in p.column_profile(df).orderBy("column", "rank").collect():
        found.setdefault(r["column"], []).append(r["value"])
    assert found == {"n": ["0", "1", "2"], "d": ["2020-01-01", "2020-01-02", "2020-01-03"], "t": ["t0", "t1", "t2"], "flag": ["false", "true"], "dec": ["0.0", "1.0", "2.0"]}
    assert p.column_profile(df.limit(0)).count() == 0
