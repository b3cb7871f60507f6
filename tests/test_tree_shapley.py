"""Exact Shapley values of fitted trees against coalition enumeration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fettle.operators import explain, models, tree_shapley

INPUTS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 100, (300, 4)).round(1)
    y = np.clip(0.4 * x[:, 0] + 0.3 * np.abs(x[:, 1] - 50) + 0.002 * x[:, 2] * x[:, 0] + rng.normal(0, 1, 300), 1, 99)
    return spark.createDataFrame([(f"p{i}", *map(float, x[i]), float(y[i])) for i in range(300)],
                                 "pseudonym_id string, a double, b double, c double, d double, label double").cache()


def by_coalitions(spark, model, cases, reference):
    raw = lambda d: model.transform(d.fillna(0.0, subset=INPUTS)).withColumn("s", F.col("prediction")).drop("prediction", models.FEATURES)
    return {r["pseudonym_id"]: r for r in explain.shapley_by_model(cases, reference, raw, "s", INPUTS).collect()}


@pytest.mark.parametrize("kind", ["boosting", "forest", "linear"])
def test_values_equal_coalition_enumeration(spark, rows, kind):
    candidate = {"boosting": lambda: models.boosting(INPUTS, rounds=12), "forest": lambda: models.forest(INPUTS, trees=7),
                 "linear": lambda: models.linear(INPUTS)}[kind]()
    model, _ = models.fit(rows, candidate)
    cases, reference = rows.orderBy("pseudonym_id").limit(6), rows.orderBy(F.desc("pseudonym_id")).limit(9)
    # values on a threshold and repeated reference rows
    if kind != "linear":
        nodes = tree_shapley.node_table(model.stages[-1])
        edge = nodes.filter("feature = 0").agg(F.min("threshold")).first()[0]
        cases = cases.unionByName(rows.limit(1).withColumns({"pseudonym_id": F.lit("edge"), "a": F.lit(edge)}))
    reference = reference.unionByName(reference.limit(2))
    got = {r["pseudonym_id"]: r for r in tree_shapley.model_shapley(cases, reference, model, INPUTS).collect()}
    want = by_coalitions(spark, model, cases, reference)
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c in ("base_value", "prediction", *INPUTS):
            assert got[k][c] == pytest.approx(w[c], abs=1e-8), (k, c)


def test_leaves_are_boxes_that_cover_everything_once(spark, rows):
    model, _ = models.fit(rows, models.forest(INPUTS, trees=3))
    leaves = tree_shapley.leaf_boxes(tree_shapley.node_table(model.stages[-1]), 4)
    inside = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.get("x", i) > F.get("low", i)) & (F.get("x", i) <= F.get("high", i)))
    hits = rows.select("pseudonym_id", F.array(*INPUTS).alias("x")).join(leaves, inside).groupBy("pseudonym_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"))
    predicted = model.transform(rows).select("pseudonym_id", "prediction").join(hits, "pseudonym_id").collect()
    assert len(predicted) == 300 and all(r["n"] == 3 and r["sum"] == pytest.approx(r["prediction"]) for r in predicted)


def test_walks_through_exported_nodes_give_the_predictions(spark, rows):
    for candidate in (models.forest(INPUTS, trees=4), models.boosting(INPUTS, rounds=6)):
        model, _ = models.fit(rows, candidate)
        got = tree_shapley.walked(model.transform(rows), model.stages[-1], INPUTS, "prediction").collect()
        assert len(got) == 300 and all(r["walked"] == pytest.approx(r["prediction"]) for r in got)


def test_linear_fits_lie_at_their_optimum(spark, rows):
    sd = rows.agg(F.stddev_samp("label")).first()[0]
    for l1, make, factor in ((False, models.ridge, sd), (True, models.lasso, 1.0)):
        model, _ = models.fit(rows, make(INPUTS, alpha=0.5 * factor))
        assert models.optimality_gap(rows, model, 0.5, l1, INPUTS) < 0.005
        assert models.optimality_gap(rows, model, 5.0, l1, INPUTS) > 0.02
    model, _ = models.fit(rows, models.linear(INPUTS))
    assert models.optimality_gap(rows, model, inputs=INPUTS) < 1e-9


def test_missing_inputs_count_as_zero(spark, rows):
    model, _ = models.fit(rows, models.boosting(INPUTS, rounds=3))
    gap = rows.limit(1).withColumn("a", F.lit(None).cast("double"))
    zero = gap.withColumn("a", F.lit(0.0))
    one, two = (tree_shapley.model_shapley(x, rows.limit(5), model, INPUTS).drop("pseudonym_id").first() for x in (gap, zero))
    assert one == two


@pytest.mark.parametrize("kind", ["boosting", "forest"])
def test_nodes_leaves_and_cases_in_many_pieces_stay_off_the_driver(spark, rows, monkeypatch, kind):
    model, _ = models.fit(rows, getattr(models, kind)(INPUTS, **({"rounds": 4} if kind == "boosting" else {"trees": 3})))
    cases, reference = rows.orderBy("pseudonym_id").limit(9), rows.orderBy(F.desc("pseudonym_id")).limit(7)
    cases = cases.unionByName(cases.limit(2)).withColumn("pseudonym_id", F.when(F.col("pseudonym_id") != "p1", F.col("pseudonym_id")))
    for name, size in (("CASES_PER_TASK", 2), ("CHUNK_LEAVES", 5), ("CHUNK_NODES", 20), ("WALKED_ROWS", 40), ("REFERENCE_ROWS", 3)):
        monkeypatch.setattr(tree_shapley, name, size)
    plain = type(rows).toPandas
    monkeypatch.setattr(type(rows), "toPandas", lambda self: plain(self) if self.count() <= 7 else pytest.fail("more than the reference rows on the driver"))
    got = tree_shapley.model_shapley(cases, reference, model, INPUTS).collect()
    assert len(got) == 11 and sum(r["pseudonym_id"] is None for r in got) == cases.filter("pseudonym_id is null").count() > 0
    own = sorted(r["prediction"] for r in model.transform(cases).collect())
    assert sorted(r["prediction"] for r in got) == pytest.approx(own)
    assert all(sum(r[c] for c in INPUTS) == pytest.approx(r["prediction"] - r["base_value"]) for r in got)
    walks = tree_shapley.walked(model.transform(rows), model.stages[-1], INPUTS, "prediction").collect()
    assert len(walks) == 300 and all(r["walked"] == pytest.approx(r["prediction"]) for r in walks)
