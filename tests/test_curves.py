import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import curves as c
from tests.plans import plan_of, rows

SIX = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.4, 1), (0.1, 0)]


def scored(spark, data):
    return spark.createDataFrame([(float(x), int(y)) for x, y in data], "score double, Target int")


def brute(data):
    """(threshold, tp, fp) per distinct score, from the definition."""
    return [
        (t, sum(y for x, y in data if x >= t), sum(1 - y for x, y in data if x >= t))
        for t in sorted({x for x, _ in data}, reverse=True)
    ]


def test_metrics_of_the_known_case(spark):
    row = c.ranking_metrics(c.cumulative_counts(scored(spark, SIX))).first()
    assert row["average_precision"] == pytest.approx(0.7)
    assert row["roc_auc"] == pytest.approx(0.6111, abs=1e-4)


def random_scores(seed, n, levels):
    rng = np.random.default_rng(seed)
    return [(float(x) / levels, int(y)) for x, y in zip(rng.integers(0, levels + 1, n), rng.integers(0, 2, n))]


@pytest.mark.parametrize("per_range", [1, 7, 100, 10**6])
def test_ranges_do_not_change_the_counts(spark, per_range):
    # two fifths of the rows share one score, and most of the rest lie close together
    data = random_scores(1, 300, 1000) + [(0.5, i % 2) for i in range(400)] + [(0.9 + x / 100, y) for x, y in random_scores(2, 300, 500)]
    got = c.cumulative_counts(scored(spark, data), rows_per_range=per_range)
    found = sorted(((r["threshold"], r["tp"], r["fp"]) for r in got.collect()), reverse=True)
    assert found == brute(data)
    after = {r["threshold"]: (r["next_pos"], r["next_neg"]) for r in got.collect()}
    own = {r["threshold"]: (r["pos"], r["neg"]) for r in got.collect()}
    ordered = sorted(own, reverse=True)
    assert [after[t] for t in ordered] == [own[t] for t in ordered[1:]] + [(None, None)]


def test_ranges_hold_a_bounded_share(spark):
    df = spark.range(20000).select((F.pow(F.col("id") / 20000.0, 30)).alias("score"), F.lit(1).alias("Target"))
    counts = c.score_counts(df)
    edges = c.range_edges(counts, rows_per_range=1000)
    assert len(edges) > 10 and c.range_edges(counts, rows_per_range=100_000) == []
    placed = c.place_in_ranges(counts, edges)
    assert placed.groupBy("range").count().agg(F.max("count")).first()[0] < 1500


def test_no_window_over_the_whole_table(spark):
    df = spark.range(20000).select((F.col("id") / 20000.0).alias("score"), F.lit(1).alias("Target"))
    plan = plan_of(c.cumulative_counts(df, rows_per_range=1000))
    inner = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(inner) <= 1  # the running totals of the ranges
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_pr_curve(spark):
    points = {r["threshold"]: (r["precision"], r["recall"]) for r in c.pr_curve(c.cumulative_counts(scored(spark, SIX))).collect()}
    assert points[None] == (1.0, 0.0)
    assert points[0.9] == (1.0, pytest.approx(1 / 3)) and points[0.7] == (0.5, pytest.approx(2 / 3))
    assert len(points) == 6


def test_roc_curve(spark):
    cumulative = c.cumulative_counts(scored(spark, SIX))
    full = sorted((r["fpr"], r["tpr"]) for r in c.roc_curve(cumulative, drop_intermediate=False).collect())
    third = pytest.approx(1 / 3)
    assert len(full) == 6 and full[0] == (0.0, 0.0) and full[-1] == (1.0, 1.0) and full[1] == (0.0, third)
    straight = scored(spark, [(0.9, 1), (0.8, 1), (0.7, 1), (0.3, 0), (0.2, 0)])
    kept = sorted((r["fpr"], r["tpr"]) for r in c.roc_curve(c.cumulative_counts(straight)).collect())
    assert kept == [(0.0, 0.0), (0.0, third), (0.0, 1.0), (1.0, 1.0)]
    twins = scored(spark, [(0.9, 1), (0.9, 0), (0.8, 1), (0.8, 0), (0.7, 1), (0.3, 0)])
    assert {r["threshold"] for r in c.roc_curve(c.cumulative_counts(twins)).collect()} == {float("inf"), 0.9, 0.8, 0.7, 0.3}


def test_edges_for_scores_of_any_sign_and_size(spark):
    values = [0.0, -1.5, -1e-300, 1e-300, 1e300, -1e300, 0.1, 0.2, 0.25, 7.0]
    counts = c.score_counts(scored(spark, [(v, 1) for v in values]))
    assert c.range_edges(counts, rows_per_range=1) == sorted(values)[1:]


@pytest.mark.parametrize("seed", range(3))
def test_threshold_is_the_first_maximum(spark, seed):
    data = random_scores(seed, 200, 20)
    positives = sum(y for _, y in data)
    best = max(
        ((2 * (tp / (tp + fp)) * (tp / positives)) / (tp / (tp + fp) + tp / positives + 1e-9), -t) for t, tp, fp in brute(data)
    )
    row = c.operating_threshold(c.cumulative_counts(scored(spark, data))).first()
    assert row["threshold"] == -best[1] and row["f1"] == pytest.approx(best[0])


def test_groups_are_independent(spark):
    a, b = random_scores(5, 100, 30), random_scores(6, 150, 30)
    both = scored(spark, a).withColumn("g", F.lit("a")).unionByName(scored(spark, b).withColumn("g", F.lit("b")))
    grouped = c.cumulative_counts(both, by=["g"], rows_per_range=10)
    metrics = {r["g"]: r["average_precision"] for r in c.ranking_metrics(grouped, ["g"]).collect()}
    for name, data in (("a", a), ("b", b)):
        alone = c.ranking_metrics(c.cumulative_counts(scored(spark, data))).first()["average_precision"]
        assert metrics[name] == pytest.approx(alone)
    assert c.pr_curve(grouped, ["g"]).filter("threshold IS NULL").count() == 2


def test_one_class_only(spark):
    row = c.ranking_metrics(c.cumulative_counts(scored(spark, [(0.3, 0), (0.6, 0)]))).first()
    assert row["roc_auc"] is None and row["positives"] == 0
