"""The composite index, splits, metrics and split-conformal calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions.scales import clip, hash_bucket
from fettle.operators import spread

SCORE = "welfare_risk_score"
W = P.INDEX_WEIGHTS


def _combine(terms: dict, sqrt=F.sqrt):
    """Weighted sum + overwork-without-recovery term + saturating deployment term; terms are Columns, or arrays with ``sqrt`` of arrays."""
    linear = 0.0
    for name, weight in W.items():
        linear = linear + terms[name] * weight
    interaction = terms["overwork"] * P.INDEX_INTERACTION * terms["recovery_deficit"]
    saturating = sqrt(terms["deployment"] * (terms["irregularity"] + 1.0)) * P.INDEX_SATURATING
    return linear + interaction + saturating


def composite_index() -> Column:
    """Noise-free index over the point-in-time features (labels for fitting and checks)."""
    c = F.col
    terms = {
        "overwork": clip(c("workload_deviation_pct") / F.lit(100.0), 0.0, 1.0),
        "recovery_deficit": clip(c("days_since_last_leave") / F.lit(P.RECOVERY_SATURATION_DAYS), 0.0, 1.0),
        "leave_deficit": clip(F.lit(1.0) - c("leave_entitlement_used_pct") / F.lit(100.0), 0.0, 1.0),
        "deployment": clip(
            c("current_deployment_length_months") / F.lit(P.DEPLOYMENT_SATURATION_MONTHS), 0.0, 1.0),
        "irregularity": clip(c("schedule_irregularity_sd") / F.lit(P.IRREGULARITY_SATURATION_HOURS), 0.0, 1.0),
        "churn": clip(c("transfer_count_past_2yrs") / F.lit(P.TRANSFER_COUNT_SATURATION), 0.0, 1.0),
        "training": clip(c("training_hours_last_3months") / F.lit(P.TRAINING_SATURATION_HOURS), 0.0, 1.0),
        "no_offs": clip(F.lit(1.0) - c("holiday_weekly_off_availed_pct") / F.lit(100.0), 0.0, 1.0),
        "hard_area": F.when(c("posting_type") == "hard_area", F.lit(1.0)).otherwise(F.lit(0.0)),
        "family_separated": F.when(F.coalesce(c("family_separated"), F.lit(False)), F.lit(1.0))
        .otherwise(F.lit(0.0)),
        "exposure": F.lit(0.5),
    }
    return clip(_combine(terms) * F.lit(100.0), 0.0, 100.0)


def signal_index(columns: dict[str, Column] | None = None) -> Column:
    """The same index read off the nine signals: a scorer that needs no fitted model.

    Any ``DataFrame -> DataFrame`` that adds a score can replace it; explanation
    and counterfactual operators take the scorer as an argument.
    """
    s = {name: (columns or {}).get(name, F.col(name)) / F.lit(100.0) for name in P.SIGNALS}
    return clip(_combine({**_signal_terms(s), "exposure": F.lit(0.5)}) * F.lit(100.0), 0.0, 100.0)


def signal_index_arrays(columns: dict[str, np.ndarray]) -> np.ndarray:
    """``signal_index`` of arrays without nulls or NaN, for work inside a task."""
    s = {name: columns[name] / 100.0 for name in P.SIGNALS}
    return np.clip(_combine({**_signal_terms(s), "exposure": 0.5}, np.sqrt) * 100.0, 0.0, 100.0)


def _signal_terms(s: dict) -> dict:
    return {
        "overwork": s["workload_deviation_signal"],
        "recovery_deficit": s["recovery_pattern_signal"],
        "leave_deficit": s["leave_deficit_signal"],
        "deployment": s["deployment_stability_signal"],
        "irregularity": s["schedule_irregularity_signal"],
        "churn": s["transfer_churn_signal"],
        "training": s["training_load_signal"],
        "no_offs": s["recovery_pattern_signal"],
        "hard_area": s["posting_hardship_signal"],
        "family_separated": s["family_separation_signal"],
    }


def labels(features: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Composite index per (person, snapshot); a documented benign profile dampens it."""
    out = features.select("pseudonym_id", "snapshot_date", composite_index().alias("label"))
    if profiles is None:
        return out
    flag = profiles.select("pseudonym_id", (F.coalesce(F.trim("benign_profile"), F.lit("")) != "").alias("_gray"))
    factor = F.when(F.col("_gray"), F.lit(P.GRAY_DAMPENING)).otherwise(F.lit(1.0))
    return out.join(flag, "pseudonym_id").withColumn("label", F.col("label") * factor).drop("_gray")


def modelling_set(signals: DataFrame, label_rows: DataFrame) -> DataFrame:
    """Signals joined 1:1 to labels."""
    return signals.join(label_rows, ["pseudonym_id", "snapshot_date"])


def person_code(person: Column) -> Column:
    """Integer code of a roster key; independent of the pseudonym key and of row order."""
    return F.conv(F.substring(F.md5(person.cast("string")), 1, 12), 16, 10).cast("long")


def with_split(df: DataFrame, person: str, seed: int = P.SEED) -> DataFrame:
    """Person-disjoint test / calibration / fit slices, decided row by row from a hash."""
    test = hash_bucket(F.col(person), seed) < P.TEST_PERCENT
    calibration = hash_bucket(F.col(person), seed + 1) < P.CALIBRATION_PERCENT
    return df.withColumn("split", F.when(test, "test").when(calibration, "calibration").otherwise("fit"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R2 from one pass of sums."""
    y, e = F.col(truth), F.col(truth) - F.col(predicted)
    sums = df.agg(
        F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("var_y")
    )
    return sums.select(
        "n", "mae", F.sqrt("mse").alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("var_y"))).alias("r2"),
    )


def band(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score >= P.HIGH_MIN, P.LEVELS[2]).when(score >= P.MODERATE_MIN, P.LEVELS[1]).otherwise(P.LEVELS[0])
    )


def band_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth), F.col(predicted)
    high_t, high_p = t >= P.HIGH_MIN, p >= P.HIGH_MIN
    any_t, any_p = t >= P.MODERATE_MIN, p >= P.MODERATE_MIN

    def share(hits: Column, base: Column) -> Column:
        return F.try_divide(F.count_if(hits).cast("double"), F.count_if(base).cast("double"))

    return df.agg(
        F.avg((band(t) == band(p)).cast("double")).alias("band_accuracy"),
        share(high_t & high_p, high_t).alias("high_recall"),
        share(high_t & high_p, high_p).alias("high_precision"),
        share(any_t & any_p, any_t).alias("escalation_recall"),
    )


def quantile_rank(n: Column, coverage: float = P.COVERAGE) -> Column:
    """ceil((n + 1)·coverage), at most n."""
    return F.least(n, F.ceil((n + 1) * F.lit(coverage)))


def calibrate(df: DataFrame, truth: str, predicted: str, person: str, coverage: float = P.COVERAGE) -> DataFrame:
    """Half-width = that order statistic of the absolute residuals.

    The rank is found by counting over range slices, so no task sorts the whole
    calibration set.
    """
    rows = df.select(person, F.abs(F.col(truth) - F.col(predicted)).alias("half_width"))
    size = rows.agg(
        F.count("half_width").alias("calibration_rows"), F.countDistinct(person).alias("calibration_people")
    ).withColumn("quantile_rank", quantile_rank(F.col("calibration_rows"), coverage))
    return spread.kth_smallest(rows, "half_width", F.col("quantile_rank"), size)


def with_interval(df: DataFrame, half_width: DataFrame, score: str = SCORE) -> DataFrame:
    """Score ± half-width (a one-row frame, used as a scalar), clipped to the scale."""
    s, q = F.col(score), half_width.select("half_width").scalar()
    return (
        df.withColumn("interval_low", F.when(s.isNotNull(), F.greatest(F.lit(0.0), s - q)))
        .withColumn("interval_high", F.when(s.isNotNull(), F.least(F.lit(100.0), s + q)))
    )


def empirical_coverage(df: DataFrame, truth: str, predicted: str, half_width: DataFrame) -> DataFrame:
    inside = F.abs(F.col(truth) - F.col(predicted)) <= half_width.select("half_width").scalar()
    return df.withColumn("_inside", inside).agg(
        F.avg(F.col("_inside").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def select_model(measured: DataFrame, margin: float = P.NON_TREE_MARGIN) -> DataFrame:
    """Best tree unless the best non-tree leads by more than ``margin`` (model_name, is_tree, r2)."""
    best = measured.filter(F.col("r2").isNotNull()).agg(
        F.max_by("model_name", F.when(F.col("is_tree"), F.struct("r2", "model_name"))).alias("best_tree"),
        F.max(F.when(F.col("is_tree"), F.col("r2"))).alias("tree_r2"),
        F.max_by("model_name", F.when(~F.col("is_tree"), F.struct("r2", "model_name"))).alias("best_other"),
        F.max(F.when(~F.col("is_tree"), F.col("r2"))).alias("other_r2"),
    )
    gap = F.col("other_r2") - F.col("tree_r2")
    take_other = F.col("best_tree").isNull() | (F.col("best_other").isNotNull() & (gap > margin))
    return best.withColumn("gap", gap).withColumn(
        "selected", F.when(take_other, F.col("best_other")).otherwise(F.col("best_tree"))
    ).withColumn("selected_is_tree", ~F.coalesce(take_other, F.lit(False)))
