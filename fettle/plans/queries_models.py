"""Fitted models: every candidate at full size, the selected one deployed.

The oracle engine has no regressors, so it states what must hold of them: which rows they
were fitted and measured on, that linear fits meet the conditions of their optimum, that
trees predict what their exported leaves add up to, and that each beats the label's mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.operators import explain, models, scoring, tree_shapley
from fettle.plans.catalog import query
from fettle.plans.queries_data import scratch

ROW = "model_name is_tree train_rows# test_rows# sound exact learned"


def measured_sql(name: str, tree: bool) -> str:
    return f"""
SELECT '{name}' AS model_name, {tree} AS is_tree, count(*) FILTER (split <> 'test') AS train_rows,
       count(*) FILTER (split = 'test') AS test_rows, true AS sound, true AS exact, true AS learned FROM v_model"""


def measured(w, names=None) -> DataFrame:
    """Measured rows of the training run, and whether each metric and fit is what it must be."""
    share = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    sound = (~F.isnan("r2") & (F.col("r2") <= 1) & (F.col("mae") >= 0) & (F.col("mae") <= F.col("rmse"))
             & share("band_accuracy") & share("high_recall") & share("high_precision") & share("escalation_recall"))
    run = w.comparison
    names = list(names or run.options)
    rows = run.measured(names)
    sizes = run.rows.agg(F.count_if(F.col("split") != "test").alias("train_rows"), F.count_if(F.col("split") == "test").alias("test_rows"))
    exact = w.spark.createDataFrame([(n, fitted_exactly(w, n)) for n in names], "model_name string, exact boolean")
    return (rows.withColumn("sound", sound).withColumn("learned", F.col("r2") > 0)
            .join(F.broadcast(exact), "model_name").crossJoin(F.broadcast(sizes)))


def fitted_exactly(w, name: str) -> bool:
    """Linear fits lie at their optimum, tree predictions are the sums of the leaves they fall into."""
    model, rows = w.comparison.fitted(name), w.comparison.rows.filter("split <> 'test'")
    if not hasattr(model.stages[-1], "treeWeights"):
        l1 = name == "lasso_regression"
        penalty = 0.0 if name == "linear_regression" else models.choose_penalty(rows, l1)[0]
        return models.optimality_gap(rows, model, penalty, l1) < 0.01
    return leaf_gap(model, rows) < 1e-6


def leaf_gap(model, rows: DataFrame, inputs=P.MODEL_INPUTS) -> float:
    """Largest difference between a prediction and the sum of the leaves that a walk through the exported nodes ends in."""
    told = model.transform(rows.fillna(0.0, subset=list(inputs)))
    walked = tree_shapley.walked(told, model.stages[-1], inputs, "prediction")
    return walked.agg(F.max(F.abs(F.col("walked") - F.col("prediction")))).first()[0] or 0.0


NAMES = {"m05": ("least_squares_m05", "linear_regression", False), "m06": ("ridge_penalty_chosen_m06", "ridge_regression", False),
         "m07": ("lasso_penalty_chosen_m07", "lasso_regression", False), "m08": ("random_forest_m08", "random_forest", True),
         "m09": ("gradient_boosting_m09", "gradient_boosting", True),
         "m10": ("histogram_boosting_m10", "hist_gradient_boosting", True)}


def _one(key: str, name: str, tree: bool) -> None:
    @query(key, ROW, measured_sql(name, tree))
    def plan(w):
        return measured(w, [name]).filter(F.col("model_name") == name)


for _key, _name, _tree in NAMES.values():
    _one(_key, _name, _tree)


@query("candidates_compared_m11", ROW, " UNION ALL ".join(measured_sql(n, t) for _, n, t in NAMES.values()))
def m11(w):
    return measured(w)


@query("grouped_cross_validation_m04", "model_name sound", "SELECT 'linear_regression' AS model_name, true AS sound FROM (SELECT count(*) FROM v_model)")
def m04(w):
    mean, sd = models.grouped_cv_r2(w.modelling.filter("split <> 'test'"), models.linear())
    row = w.spark.createDataFrame([("linear_regression", mean, sd)], "model_name string, cv_r2 double, cv_r2_sd double")
    return row.withColumn("sound", (F.col("cv_r2") <= 1) & (F.col("cv_r2_sd") >= 0))


@query("deployed_fit_m15", "calibration_rows# calibration_people# quantile_rank# sound",
       "SELECT calibration_rows, calibration_people, quantile_rank, true AS sound FROM v_cal")
def m15(w):
    return w.training.calibration.withColumn("sound", F.col("half_width") >= 0)


@query("refit_on_all_rows_m15", "fitted_rows# exact", "SELECT count(*) AS fitted_rows, true AS exact FROM v_model")
def m15_all(w):
    """A refit on every labelled row: the rows that the solver saw, and whether the fit is the optimum of all of them."""
    rows = w.modelling
    model = models.refit_on_all(rows, models.linear())
    seen, exact = int(model.stages[-1].summary.numInstances), models.optimality_gap(rows, model) < 1e-6
    return w.spark.createDataFrame([(seen, exact)], "fitted_rows bigint, exact boolean")


@query("fitted_trees_shapley_m24", "pseudonym_id inputs# prediction_met base_met additive", """
SELECT pseudonym_id, 11 AS inputs, true AS prediction_met, true AS base_met, true AS additive FROM v_latest""")
def m24_trees(w):
    """Exact values of all eleven inputs for the best fitted trees, held against the model's own predictions."""
    trees = [c.name for c in w.comparison.options.values() if c.is_tree]
    best = w.comparison.measured(trees).orderBy(F.desc("r2"), "model_name").first()["model_name"]
    model, inputs = w.comparison.fitted(best), list(P.MODEL_INPUTS)
    cases, reference = w.latest_signals, explain.background(w.behaviour, inputs=P.MODEL_INPUTS)
    phi = tree_shapley.model_shapley(cases, reference, model)
    own = model.transform(cases.fillna(0.0, subset=inputs)).select("pseudonym_id", F.col("prediction").alias("told"))
    mean = model.transform(reference.fillna(0.0, subset=inputs)).agg(F.avg("prediction").alias("mean"))
    near = lambda a, b: F.abs(a - b) < 1e-6
    return phi.join(own, "pseudonym_id").crossJoin(F.broadcast(mean)).select(
        "pseudonym_id", F.lit(len(inputs)).alias("inputs"), near(F.col("prediction"), F.col("told")).alias("prediction_met"),
        near(F.col("base_value"), F.col("mean")).alias("base_met"),
        near(sum((F.col(c) for c in inputs), F.lit(0.0)), F.col("prediction") - F.col("base_value")).alias("additive"))


@query("versioned_model_m19", "version_count# rolled_back predictions#",
       "SELECT 2 AS version_count, true AS rolled_back, count(*) AS predictions FROM v_model")
def m19(w):
    """Two versions of the selected model stored, the newer one marked and the older one marked again."""
    folder = scratch(w, "registry")
    meta = {"label_provenance": "composite index of the features", "model_name": w.training.selected}
    first = models.save(w.training.model, folder, meta)
    models.save(w.training.model, folder, meta)
    models.mark(folder, first)
    loaded, info = models.load(folder)
    return models.predict(loaded, w.modelling).agg(F.count("predicted").alias("predictions")).withColumn(
        "version_count", F.lit(len(models.versions(folder)))).withColumn("rolled_back", F.lit(info["version"] == first))


def _sound(scored: DataFrame) -> DataFrame:
    """Whether a prediction lies on the scale and inside its interval."""
    held = F.col("predicted").between(F.col("interval_low"), F.col("interval_high"))
    return scored.withColumn("sound", held & F.col("interval_low").between(0, 100) & F.col("interval_high").between(0, 100))


@query("frame_scored_by_model_m20", "pseudonym_id snapshot_date sound",
       "SELECT pseudonym_id, snapshot_date, true AS sound FROM v_signals")
def m20(w):
    run = w.training
    return _sound(scoring.with_interval(models.predict(run.model, w.behaviour), run.calibration, "predicted"))


@query("rows_scored_with_missing_inputs_m21", "pseudonym_id sound", "SELECT pseudonym_id, true AS sound FROM v_latest")
def m21(w):
    run = w.training
    gaps = w.latest_signals.withColumn(
        "training_load_signal", F.when(F.col("training_load_signal") > 50, F.col("training_load_signal")))
    return _sound(scoring.with_interval(models.predict(run.model, gaps), run.calibration, "predicted"))


@query("run_scored_by_selected_model_m20", "pseudonym_id risk_level_sound interval_sound has_voice_signal", """
SELECT pseudonym_id, true AS risk_level_sound, true AS interval_sound, has_voice_signal FROM v_cases""")
def m20_run(w):
    """Cases of the run scored by the selected model: bands and intervals follow its scores."""
    cases = w.deployed.cases
    score = F.col(scoring.SCORE)
    level = F.when(score >= 65, "High").when(score >= 40, "Moderate").otherwise("Normal")
    return cases.select("pseudonym_id", (F.col("risk_level") == level).alias("risk_level_sound"),
                        score.between(F.col("interval_low"), F.col("interval_high")).alias("interval_sound"), "has_voice_signal")
