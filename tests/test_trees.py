"""Trees grown in few jobs: against MLlib's own, across the bounds of subtrees and tasks, and by the jobs they take."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.operators import models, trees
from fettle.operators.tree_shapley import node_table
from fettle.plans.queries_models import leaf_gap


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 100, (900, len(P.MODEL_INPUTS)))
    x[:, 2] = rng.integers(0, 4, 900)
    y = 0.5 * x[:, 0] + 20 * (x[:, 2] > 1) + rng.normal(0, 2, 900)
    cols = ", ".join(f"{c} double" for c in P.MODEL_INPUTS)
    data = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, f"i int, {cols}, label double").cache()


def told(model, rows):
    return np.array([r[0] for r in model.transform(rows).orderBy("i").select("prediction").collect()])


def test_boosting_takes_the_splits_of_mllib(rows):
    ours = models.histogram_boosting(rounds=6)
    plain = GBTRegressor(featuresCol=models.FEATURES, labelCol="label", maxIter=6, maxDepth=4, maxBins=256, stepSize=0.05, seed=P.SEED)
    theirs = models.Candidate("plain", "", True, (ours.stages[0], plain))
    assert np.allclose(told(models.fit(rows, ours)[0], rows), told(models.fit(rows, theirs)[0], rows), atol=1e-9)


def test_barrier_tasks_agree_with_one_task(rows, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    one = told(models.fit(rows.repartition(3), models.histogram_boosting(rounds=4))[0], rows)
    monkeypatch.setattr(trees, "BOOSTING_ROWS", 300)
    assert np.allclose(told(models.fit(rows.repartition(3), models.histogram_boosting(rounds=4))[0], rows), one, atol=1e-9)


def test_a_boosting_run_takes_few_jobs(spark, rows):
    sc = spark.sparkContext
    sc.setJobGroup("boosting", "")
    models.fit(rows, models.boosting(rounds=30))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("boosting")) < 30


@pytest.mark.parametrize("bound", [1 << 17, 60])
def test_forest_keeps_its_limits_on_both_sides_of_the_subtree_bound(rows, monkeypatch, bound):
    monkeypatch.setattr(trees, "SUBTREE_ROWS", bound)
    model = models.fit(rows, models.forest(trees=9))[0]
    forest = model.stages[-1]
    assert leaf_gap(model, rows) < 1e-9 and len(forest.trees) == 9
    assert max(t.depth for t in forest.trees) <= 14
    assert np.corrcoef(told(model, rows), [r.label for r in rows.orderBy("i").collect()])[0, 1] > 0.95
    nodes = node_table(forest)
    assert nodes.groupBy("tree").agg(F.count_if(F.col("left") < 0).alias("leaves"), F.count("*").alias("n")).filter("n <> 2 * leaves - 1").isEmpty()


def test_a_subtree_holds_enough_rows_per_leaf_and_splits_best():
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 8, (200, 3)).astype(np.uint8), rng.normal(size=200), rng.integers(1, 4, 200).astype(float)
    heap, n, total, squares, gain, feature, cut = trees.grow(x, y, w, 1, 8, 6, 5, 3, [0])
    assert n[feature < 0].min() >= 5 and n[feature < 0].sum() == w.sum() and heap.max() < 1 << 7
    spread = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() if m.any() else 0.0
    every = [spread(x[:, f] <= c) + spread(x[:, f] > c) for f in range(3) for c in range(7)
             if min(w[x[:, f] <= c].sum(), w[x[:, f] > c].sum()) >= 5]
    first = x[:, int(feature[0])] <= cut[0]
    assert np.isclose(spread(first) + spread(~first), min(every))
    assert np.isclose(gain[0] * w.sum(), spread(np.ones(200, bool)) - min(every))


def test_null_labels_are_refused(rows):
    with pytest.raises(ValueError):
        models.fit(rows.withColumn("label", F.when(F.col("i") > 3, F.col("label"))), models.forest(trees=2))


@pytest.mark.parametrize("value", [float("nan"), float("inf"), None])
def test_inputs_without_a_number_are_refused(rows, value):
    gap = rows.withColumn(P.SIGNALS[0], F.when(F.col("i") > 3, F.col(P.SIGNALS[0])).otherwise(F.lit(value)))
    with pytest.raises(ValueError, match="inputs"):
        models.fit(gap, models.boosting(rounds=2))


def test_constant_inputs_leave_the_mean(rows):
    flat = rows.select("i", "label", *[F.lit(1.0).alias(c) for c in P.MODEL_INPUTS])
    mean = rows.agg(F.avg("label")).first()[0]
    assert np.allclose(told(models.fit(flat, models.boosting(rounds=1))[0], flat), mean, atol=1.5)
    assert len(set(told(models.fit(flat, models.forest(trees=2))[0], flat))) == 1


def test_a_forest_is_never_loaded_on_the_driver(spark, rows, monkeypatch, tmp_path):
    plain = trees.RandomForestRegressionModel.load
    monkeypatch.setattr(trees.RandomForestRegressionModel, "load", lambda path: pytest.fail("all nodes on the driver"))
    monkeypatch.setattr(trees, "SENT_NODES", 100)  # many parts
    model = models.fit(rows, models.forest(trees=5))[0]
    got = told(model, rows)
    model.write().save(f"{tmp_path}/kept")
    again = models.PipelineModel.load(f"{tmp_path}/kept")
    assert np.array_equal(told(again, rows), got) and again.stages[-1].trees == model.stages[-1].trees
    assert leaf_gap(again, rows) < 1e-9
    monkeypatch.setattr(trees.RandomForestRegressionModel, "load", plain)
    assert np.allclose(told(models.PipelineModel([again.stages[0], again.stages[-1].mllib()]), rows), got, atol=1e-12)
    odd = rows.limit(30).withColumn(P.SIGNALS[0], F.when(F.col("i") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
    assert np.allclose(told(models.PipelineModel([again.stages[0], again.stages[-1].mllib()]), odd), told(again, odd), atol=1e-12)


@pytest.mark.parametrize("rate", [1.0, 0.7])
def test_boosting_exchanges_once_a_level_and_counts_inputs_together(monkeypatch, rate):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (9_000, 5)).astype(np.uint8)
    x[:, 4] = 0  # constant
    y = x[:, 0] * 1.5 + 7.0 * (x[:, 1] > 4) * (x[:, 2] > 2) + rng.normal(size=9_000)
    calls = []

    def grown(cells):
        monkeypatch.setattr(trees, "CELLS", cells)
        calls.clear()
        return [c for _, c in trees.boost(x, y, [9, 9, 9, 9, 1], [1.0, *[0.3] * 5], 3, 20, rate, [7, 0], lambda a: calls.append(1) or a)]

    assert len(trees.joined_inputs(x, [9, 9, 9, 9, 1])) < 5
    together = grown(1 << 16)
    assert len(calls) <= 6 * 3 + 1
    score = np.zeros(len(y))
    drawn = np.random.default_rng([7, 0])
    for tree, (a, b) in enumerate(zip(together, grown(1))):
        for one, other in zip(a, b):
            assert np.allclose(one, other, atol=1e-8)
        # nodes against the rows that fall into them
        heap, n, total, squares, _, feature, cut = a
        used = drawn.random(len(y)) < rate if rate < 1 else np.ones(len(y), bool)
        target, at, value = 2 * (y - score) if tree else y, np.ones(len(y), np.int64), np.zeros(16)
        for h, count, amount, square, f, c in zip(heap.astype(int), n, total, squares, feature.astype(int), cut):
            mine = at == h
            assert (mine & used).sum() == count and np.isclose(target[mine & used].sum(), amount) and np.isclose((target[mine & used] ** 2).sum(), square)
            value[h] = amount / count
            if f >= 0:
                at[mine] = 2 * h + (x[mine, f] > c)
        score += (0.3 if tree else 1.0) * value[at]


def test_a_boosting_task_holds_what_six_times_the_driver_table_needs():
    assert trees.BOOSTING_ROWS >= 2_600_000  # 2,000 exchanges of most of a second each otherwise
