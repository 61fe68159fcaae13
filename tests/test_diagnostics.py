import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import diagnostics as d
from tests.test_curves import SIX, random_scores, scored


def counts(data, t):
    tp = sum(1 for x, y in data if x >= t and y == 1)
    fp = sum(1 for x, y in data if x >= t and y == 0)
    fn = sum(1 for x, y in data if x < t and y == 1)
    return tp, fp, fn, len(data) - tp - fp - fn


def test_confusion(spark):
    row = d.confusion(scored(spark, SIX), 0.7).first()
    assert tuple(row)[:4] == (2, 2, 1, 1)
    assert (row["precision"], row["recall"]) == (0.5, pytest.approx(2 / 3))
    empty = d.confusion(scored(spark, SIX), 2.0).first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (0.0, 0.0, 0.0)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in d.confusion_matrix(scored(spark, SIX), 2.0).collect()}
    assert cells == {(0, 0): 3, (0, 1): 0, (1, 0): 3, (1, 1): 0}
    assert d.predict(scored(spark, SIX), 0.7).agg(F.sum("prediction")).first()[0] == 4


def test_report(spark):
    got = {r["row"]: r for r in d.classification_report(scored(spark, SIX), 0.7).collect()}
    assert got["Attack (1)"]["support"] == 3 and got["Attack (1)"]["recall"] == 0.6667
    assert got["Benign (0)"]["precision"] == 0.5 and got["Benign (0)"]["recall"] == 0.3333
    assert got["accuracy"]["f1"] == 0.5 and got["accuracy"]["precision"] is None
    assert got["macro avg"]["recall"] == 0.5 and got["weighted avg"]["support"] == 6


@pytest.mark.parametrize("threshold", [0.25, 0.1234567, 0.3000001, 0.999999])
def test_sweep(spark, threshold):
    data = random_scores(4, 400, 200)
    table = d.threshold_sweep(scored(spark, data), threshold).orderBy("threshold").collect()
    grid = np.unique(np.append(np.round(np.linspace(0.01, 0.99, 99), 4), round(threshold, 6)))
    assert [r["threshold"] for r in table] == [round(float(t), 6) for t in grid]
    for r, t in zip(table, grid):
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == counts(data, t)
        assert r["is_operating_point"] == bool(np.isclose(t, threshold))


def test_histogram_matches_numpy(spark):
    data = random_scores(7, 500, 97) + [(0.42, 1)]
    got = d.confidence_histogram(scored(spark, data)).orderBy("Target", "bin").collect()
    assert len(got) == 100
    for y in (0, 1):
        n, edges = np.histogram([x for x, t in data if t == y], bins=50)
        mine = [r for r in got if r["Target"] == y]
        assert [r["n"] for r in mine] == list(n)
        assert [r["bin_low"] for r in mine] == list(edges[:-1])
        assert mine[-1]["bin_high"] == edges[-1]


def test_histogram_of_one_score(spark):
    got = d.confidence_histogram(scored(spark, [(0.5, 0)] * 4)).filter("n > 0").collect()
    n, edges = np.histogram([0.5] * 4, bins=50)
    assert [(r["bin"], r["n"]) for r in got] == [(int(np.argmax(n)), 4)]


def test_calibration_edges_go_down(spark):
    data = [(0.2, 1), (0.5, 0), (0.0, 0), (1.0, 1), (0.55, 1)]
    got = {r["bin"]: (r["mean_score"], r["attack_rate"], r["n"]) for r in d.calibration_curve(scored(spark, data)).collect()}
    assert got == {0: (0.0, 0.0, 1), 1: (0.2, 1.0, 1), 4: (0.5, 0.0, 1), 5: (0.55, 1.0, 1), 9: (1.0, 1.0, 1)}
    more = random_scores(8, 300, 50)
    bins = np.searchsorted(np.linspace(0, 1, 11)[1:-1], [x for x, _ in more])
    mine = {r["bin"]: r["n"] for r in d.calibration_curve(scored(spark, more)).collect()}
    assert mine == {int(b): int(n) for b, n in zip(*np.unique(bins, return_counts=True))}


def test_counts_give_the_same_tables_as_rows(spark):
    from flowsift.operators.curves import score_counts

    df = scored(spark, random_scores(9, 400, 25))
    rows = d.rows_of_counts(score_counts(df))
    for table in (
        lambda x, **w: d.confusion(x, 0.4, **w),
        lambda x, **w: d.confusion_matrix(x, 0.4, **w),
        lambda x, **w: d.threshold_sweep(x, 0.4, **w),
        lambda x, **w: d.confidence_histogram(x, **w),
        lambda x, **w: d.calibration_curve(x, **w).select("bin", F.round("mean_score", 9), F.round("attack_rate", 9), "n"),
    ):
        assert sorted(map(repr, table(df).collect())) == sorted(map(repr, table(rows, rows="rows").collect()))
