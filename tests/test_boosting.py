import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import boosting as b, split
from flowsift.operators.boosting import BoostingParams
from flowsift.operators.gates import GateError
from flowsift.plans import post_run, training
from flowsift.sources import tables

FEATURES = ["x", "y", "noise"]
PARAMS = BoostingParams(max_trees=6, max_depth=3, learning_rate=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(0, 3000, 1, 4).select(
        "id",
        (F.pmod(F.hash("id"), F.lit(1000)) / 1000.0).alias("x"),
        (F.pmod(F.hash(F.col("id") + 7), F.lit(1000)) / 1000.0).alias("y"),
        (F.pmod(F.hash(F.col("id") + 13), F.lit(1000)) / 1000.0).alias("noise"),
    )
    return df.withColumn("Target", ((F.col("x") > 0.6) & (F.col("y") > 0.4)).cast("int"))


@pytest.fixture(scope="module")
def fitted(spark, rows):
    assembled = b.assemble(rows, FEATURES, ["id", "Target"])
    return b.fit(assembled, training.weight_of(rows), PARAMS.max_trees, PARAMS), assembled


def staged_rows(model, assembled):
    """Rows with the margins after each tree of a model."""
    staged, margin = assembled.withColumn("m0", F.lit(0.0)), "m0"
    for k, (tree, weight) in enumerate(zip(model.trees, model.treeWeights), 1):
        staged, margin = b.add_tree(staged, tree, weight, margin, f"m{k}"), f"m{k}"
    names = [f"m{k}" for k in range(1, len(model.trees) + 1)]
    return staged.withColumn(b.MARGINS, F.array(*names)).drop("m0", *names)


def test_last_stage_is_the_model(fitted):
    model, assembled = fitted
    last = staged_rows(model, assembled).select("id", b.probability(F.element_at(b.MARGINS, -1)).alias("staged"))
    gap = b.score_rows(model, assembled).join(last, "id").agg(F.max(F.abs(F.col("score") - F.col("staged")))).first()[0]
    assert gap < 1e-12


def test_learning_curve_matches_the_definition(fitted):
    model, assembled = fitted
    sided = assembled.withColumn("side", F.when(F.col("id") % 5 == 0, "validation").otherwise("train"))
    margins = staged_rows(model, sided)
    curve = b.learning_curve(b.staged_counts(margins, 0), rows_per_range=5).collect()
    assert len(curve) == 2 * len(model.trees)
    long = margins.select("side", "Target", F.posexplode(b.MARGINS).alias("n", "m"))
    staged = long.select("side", "Target", (F.col("n") + 1).alias("n_trees"), b.probability(F.col("m")).alias("score")).toPandas()
    for r in curve:
        part = staged[(staged.side == r["side"]) & (staged.n_trees == r["n_trees"])]
        y, p = part.Target.to_numpy(), part.score.to_numpy()
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        assert r["log_loss"] == pytest.approx(loss)
        ap, before = 0.0, 0.0
        for t in sorted(set(p), reverse=True):
            recall, precision = y[p >= t].sum() / y.sum(), y[p >= t].mean()
            ap, before = ap + (recall - before) * precision, recall
        assert r["average_precision"] == pytest.approx(ap)


def test_staged_counts_fold_batches_of_odd_rows(spark):
    data = [("validation", 1, [0.5, 1.0]), ("validation", 0, [0.5, 2.0]), ("train", 1, [0.5, 0.5]), (None, 0, [1.0, 1.0])] * 3
    rows = spark.createDataFrame(data, f"side string, Target int, {b.MARGINS} array<double>").repartition(3)
    found = b.staged_counts(rows, 10).collect()
    assert sorted((r.side or "", r.n_trees, r.pos, r.neg) for r in found) == [
        ("", 11, 0, 3), ("", 12, 0, 3), ("train", 11, 3, 0), ("train", 12, 3, 0), ("validation", 11, 3, 3), ("validation", 12, 0, 3), ("validation", 12, 3, 0),
    ]
    assert b.staged_counts(rows.limit(0), 0).count() == 0


@pytest.mark.parametrize(
    "values, patience, best",
    [
        ([0.1, 0.3, 0.3, 0.2], 50, 2),
        ([0.1, 0.3, 0.2, 0.2, 0.9], 2, 2),
        ([0.1, 0.3, 0.2, 0.2, 0.9], 3, 5),
        ([0.5], 1, 1),
    ],
)
def test_early_stopping(spark, values, patience, best):
    data = [("validation", i, v, 0.0) for i, v in enumerate(values, 1)] + [("train", i, 1.0 - v, 0.0) for i, v in enumerate(values, 1)]
    curve = spark.createDataFrame(data, "side string, n_trees int, average_precision double, log_loss double")
    marked = b.mark_best(curve, patience)
    assert marked.filter("is_best").count() == 1 and b.best_tree_count(marked) == best


def splits_of(node):
    if node.subtreeDepth() == 0:
        return []
    own = (node.split().featureIndex(), node.gain() * node.impurityStats().stats()[0])
    return [own, *splits_of(node.leftChild()), *splits_of(node.rightChild())]


def test_importance_is_the_mean_gain_per_split(spark, fitted):
    model, _ = fitted
    gains = {}
    for tree in model.trees:
        for pos, gain in splits_of(tree._call_java("rootNode")):
            gains.setdefault(FEATURES[pos], []).append(gain)
    means = {f: float(np.mean(g)) for f, g in gains.items()}
    found = {r["feature"]: r["importance"] for r in b.feature_importance(model, [*FEATURES, "unused"], spark).collect()}
    assert set(found) == {*FEATURES, "unused"} and found["unused"] == 0.0
    assert all(found[f] == pytest.approx(m / sum(means.values())) for f, m in means.items())
    assert {r["feature"] for r in b.feature_importance(model, FEATURES, spark, k=2).collect()} == {"x", "y"}


def test_missing_feature_is_an_error(spark):
    df = spark.createDataFrame([(1.0, None)], "x double, y double")
    with pytest.raises(Exception):
        b.assemble(df, ["x", "y"]).collect()


def test_run_and_post_run(spark, rows, tmp_path):
    run_dir = str(tmp_path / "run")
    sided = split.stratified_split(rows, ["id"])
    run = training.train_and_evaluate(sided, FEATURES, training.carve_stratified(["id"]), PARAMS, run_dir)
    assert 1 <= run.n_trees <= PARAMS.max_trees and 0.0 < run.threshold < 1.0
    metrics = run.metrics.first()
    assert metrics["average_precision"] > 0.9 and metrics["positives"] + metrics["negatives"] == 600
    assert run.confusion.agg(F.sum("n")).first()[0] == 600 == run.scores.count()
    assert len(run.model.trees) == run.n_trees

    found = post_run.post_run_analysis(sided.filter("side = 'test'"), FEATURES, run_dir)
    assert found["metrics"].first()["average_precision"] == pytest.approx(metrics["average_precision"])
    assert found["operating_point"].first()["tp"] == run.confusion.filter("actual = 1 AND predicted = 1").first()["n"]
    written = spark.read.option("header", True).csv(f"{run_dir}/post_run_analysis/threshold_sweep")
    assert written.filter("is_operating_point = 'true'").count() >= 1 and written.count() in (99, 100)
    assert tables.load_model(f"{run_dir}/model").numFeatures == 3
    with pytest.raises(GateError):
        post_run.post_run_analysis(sided.filter("side = 'test'"), FEATURES[:2], run_dir)


def test_tail_carve(spark, rows):
    order = ["id"]
    sided = rows.withColumn("side", F.when(F.col("id") < 2400, "train").otherwise("test"))
    run = training.train_and_evaluate(sided, FEATURES, training.carve_tail(order, F.floor(F.col("id") / 100)), PARAMS)
    assert run.scores.count() == 600


def test_no_attack_to_learn_from(spark, rows):
    with pytest.raises(ValueError, match="no attack"):
        training.weight_of(rows.filter("Target = 0"))


def trees_of(model, n):
    return [model.trees[i].toDebugString.split("\n", 1)[1] for i in range(n)]


def carved_rows(rows):
    carved = b.materialise(split.stratified_split(rows, ["id"], names=("train", "validation")))
    return b.materialise(b.assemble(carved, FEATURES, ["Target", "side"]))


def test_growing_gives_the_trees_of_one_boosted_fit(spark, rows):
    carved, weight = carved_rows(rows), training.weight_of(rows)
    params = BoostingParams(max_trees=7, block_trees=3, patience=50, max_depth=3, learning_rate=0.3, row_share=1.0, feature_share=1.0)
    grown = b.grow(carved, weight, params)
    once = b.fit(carved.filter("side = 'train'"), weight, 7, params)  # draws depend on the parts of a table, so all rows and features are taken
    n = grown.n_trees
    assert list(grown.model.treeWeights) == list(once.treeWeights)[:n]
    for mine, theirs in zip(grown.model.trees, once.trees):
        pairs = list(zip(splits_of(mine._call_java("rootNode")), splits_of(theirs._call_java("rootNode")), strict=True))
        assert all(a[0] == c[0] and a[1] == pytest.approx(c[1]) for a, c in pairs)


def test_growing_stops_before_the_budget_and_in_blocks_as_in_one(spark, rows, tmp_path):
    carved, weight = carved_rows(rows), training.weight_of(rows)
    stopped = b.grow(carved, weight, BoostingParams(max_trees=400, block_trees=4, patience=3, max_depth=3, learning_rate=0.9))
    trained = stopped.curve.agg(F.max("n_trees")).first()[0]
    assert trained < stopped.n_trees + 3 + 4 and stopped.n_trees + 3 <= trained < 400
    params = dict(max_trees=8, patience=50, max_depth=3, learning_rate=0.3)
    blocks = b.grow(carved, weight, BoostingParams(block_trees=3, **params))
    once = b.grow(carved, weight, BoostingParams(block_trees=8, **params))
    table = lambda g: {(r["side"], r["n_trees"]): (round(r["average_precision"], 9), round(r["log_loss"], 9), r["is_best"]) for r in g.curve.collect()}
    assert table(blocks) == table(once) and blocks.n_trees == once.n_trees
    assert sorted(map(tuple, blocks.validation.collect())) == sorted(map(tuple, once.validation.collect()))

    scores = b.score_rows(blocks.model, carved.filter("side = 'validation'"))
    counts = {(round(r.score, 12), r.pos, r.neg) for r in b.score_counts(scores).collect()}
    assert counts == {(round(r.score, 12), r.pos, r.neg) for r in blocks.validation.collect()}
    tables.save_model(blocks.model, str(tmp_path / "grown"))
    again = tables.load_model(str(tmp_path / "grown"))
    assert again.numFeatures == 3 and len(again.trees) == blocks.n_trees


def test_fit_gives_the_trees_of_mllib(spark, rows):
    from pyspark.ml.classification import GBTClassifier

    rows = rows.withColumns({"x": F.round("x", 1), "y": F.round("y", 1), "noise": F.round("noise", 1)})
    assembled, weight = b.materialise(b.assemble(rows, FEATURES, ["Target"])), 2.0
    params = BoostingParams(max_trees=5, block_trees=2, max_depth=3, learning_rate=0.3, row_share=1.0, feature_share=1.0)
    mine = b.fit(assembled, weight, 5, params)
    weighed = assembled.withColumn("weight", F.when(F.col("Target") == 1, weight).otherwise(1.0)).withColumn("Target", F.col("Target").cast("double"))
    theirs = GBTClassifier(labelCol="Target", weightCol="weight", maxIter=5, stepSize=0.3, maxDepth=3, minInstancesPerNode=5).fit(weighed)
    for one, other in zip(mine.trees, theirs.trees, strict=True):
        pairs = list(zip(splits_of(one._call_java("rootNode")), splits_of(other._call_java("rootNode"))))
        assert pairs and all(a[0] == c[0] and a[1] == pytest.approx(c[1]) for a, c in pairs[:3])
    same = b.score_rows(mine, assembled.select("features")).agg(F.avg("score"), F.stddev("score")).first()
    assert tuple(same) == pytest.approx(tuple(b.score_rows(theirs, assembled.select("features")).agg(F.avg("score"), F.stddev("score")).first()))


def test_like_rows_are_stored_once(spark, rows):
    from flowsift.operators import trees

    rows = rows.withColumns({"x": F.round("x", 1), "y": F.round("y", 1), "noise": F.lit(0.5)})
    few = b.assemble(rows, FEATURES, ["Target"])
    stored = lambda df: trees.bin_rows(df, df, 1.0, "Target", 0).chunks.agg(F.sum("n"), F.sum(F.length("rows"))).first()
    assert tuple(stored(few)) == tuple(stored(few.unionAll(few))) and stored(few)[0] == rows.select("x", "y", "Target").distinct().count()


def binned_and_growth(rows):
    from flowsift.operators import trees

    assembled = b.materialise(b.assemble(rows, FEATURES, ["Target"]))
    return trees, trees.bin_rows(assembled, assembled, 2.0, "Target", 0), trees.Growth(3, 5, 0.8, 1.0, 7, True)


def test_a_level_of_a_tree_is_one_job_without_shuffle(spark, rows):
    trees, binned, by = binned_and_growth(rows)
    jobs = lambda: set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    tree = trees.grow_tree(binned, binned.chunks, [], [], by)
    assert 0 < len(jobs() - before) <= trees.depth_of(tree) <= 3


def test_sums_added_by_spark_give_the_same_tree(spark, rows, monkeypatch):
    trees, binned, by = binned_and_growth(rows)
    near = trees.grow_tree(binned, binned.chunks, [], [], by)
    monkeypatch.setattr(trees, "DRIVER_SUMS", 0)
    monkeypatch.setattr(trees, "CELLS_PER_TASK", 50)
    far = trees.grow_tree(binned, binned.chunks, [], [], by)
    assert all((getattr(near, c) == getattr(far, c)).all() for c in ("feature", "bin", "left", "gain", "stats"))


@pytest.mark.parametrize("width", [1, 3, 4, 5, 12, 80])
def test_like_rows_are_folded_before_they_leave_their_task(width, monkeypatch):
    import random
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from flowsift.operators import trees

    pick = random.Random(width)
    kinds = [[float(pick.randrange(3)) for _ in range(width)] for _ in range(20)]
    told = [{"side": pick.choice(["train", "validation", None]), "attack": pick.random() < 0.3, "x": pick.choice(kinds)} for _ in range(900)]
    schema = pa.schema([("side", pa.string()), ("attack", pa.bool_()), ("x", pa.list_(pa.float64()))])
    batches = [pa.RecordBatch.from_pylist(told[k : k + 300], schema=schema) for k in (0, 300, 600)]
    wanted = Counter((r["side"], r["attack"], bytes(int(v) for v in r["x"])) for r in told)
    for limit, parts in ((1 << 19, 1), (300, 3)):
        monkeypatch.setattr(trees, "FOLDED_ROWS", limit)
        found = [o.to_pylist() for o in trees.keyed([np.array([0.5, 1.5])] * width)(iter(batches))]
        assert len(found) == parts
        keys = [[(r["side"], r["attack"], r["bins"]) for r in part] for part in found]
        assert all(len(set(part)) == len(part) for part in keys)
        counted = Counter()
        for part, own in zip(keys, found):
            for key, r in zip(part, own):
                counted[key] += r["rows"]
        assert counted == wanted
        if parts == 1:
            assert keys[0] == list(wanted)


def test_held_chunks_give_the_same_trees_and_are_let_go(spark, rows):
    from pyspark import RDD

    trees, binned, by = binned_and_growth(rows)
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = kept()
    held = trees.holding(binned, binned.chunks, 3)
    near, far = trees.grow_tree(binned, held, [], [], by), trees.grow_tree(binned, binned.chunks, [], [], by)
    assert isinstance(held, RDD) and kept() == before + 1
    assert all((getattr(near, c) == getattr(far, c)).all() for c in ("feature", "bin", "left", "gain", "stats"))
    trees.let_go(held)
    assert kept() == before
    assert trees.holding(binned, binned.chunks, 30) is binned.chunks  # too many sums for the driver


@pytest.mark.parametrize("depth", [0, 1, 4, 9])
def test_leaves_are_those_of_each_rows_path(depth):
    from flowsift.operators import trees

    pick = np.random.default_rng(depth)
    feature, bin_, left, level = [0], [255], [0], [0]
    for _ in range(depth):
        following = []
        for k in level:
            if pick.random() < 0.9:
                feature[k], bin_[k], left[k] = int(pick.integers(3)), int(pick.integers(31)), len(left)
                following += [len(left), len(left) + 1]
                for _ in range(2):
                    feature.append(0), bin_.append(255), left.append(len(left))
        level = following
    tree = trees.Tree(np.array(feature), np.array(bin_), np.array(left), np.zeros(len(left)), np.ones((len(left), 4)))
    bins = pick.integers(0, 32, (3, 500)).astype(np.uint8)

    def path(row):
        node = 0
        while left[node] != node:
            node = left[node] + int(row[feature[node]] > bin_[node])
        return node

    assert trees.leaves(tree, bins).tolist() == [path(row) for row in bins.T]


def test_phases_of_the_table_stand_for_a_carve(spark, rows):
    sided = split.nested_split(rows, ["id"])
    assert sided.filter("side = 'train'").groupBy("phase").count().count() == 2
    params = BoostingParams(max_trees=2, max_depth=2, learning_rate=0.3)
    mine = training.train_and_evaluate(sided, FEATURES, None, params)
    theirs = training.train_and_evaluate(sided.drop("phase"), FEATURES, training.carve_stratified(["id"]), params)
    assert mine.scores.columns == theirs.scores.columns and sorted(mine.scores.collect()) == sorted(theirs.scores.collect())
    with pytest.raises(ValueError, match="phase"):
        training.train_and_evaluate(sided.drop("phase"), FEATURES, None, params)
    with pytest.raises(Exception, match="null"):
        training.train_and_evaluate(sided.withColumn("x", F.when(F.col("id") != 5, F.col("x"))), FEATURES, None, params)
