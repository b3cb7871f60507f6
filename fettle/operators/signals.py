"""Nine 0-100 signals, each a Column expression over the feature matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions.scales import blend, lookup, positive_z, saturate, saturate_inverse
from fettle.operators.features import ID, KEYS, SNAP

CARRIED = ["unit_id", "posting_type", "is_jawan_rank"]


def workload() -> Column:
    return blend(
        (saturate(F.col("workload_deviation_pct"), P.WORKLOAD_SATURATION_PCT), 0.70),
        (positive_z(F.col("duty_hours_personal_deviation_z")), 0.30),
    )


def recovery() -> Column:
    return blend(
        (saturate(F.col("days_since_last_leave"), P.RECOVERY_SATURATION_DAYS), 0.60),
        (saturate_inverse(F.col("holiday_weekly_off_availed_pct"), 100.0), 0.40),
    )


def deployment() -> Column:
    return blend(
        (saturate(F.col("current_deployment_length_months"), P.DEPLOYMENT_SATURATION_MONTHS), 0.75),
        (saturate(F.col("deployment_count_past_2yrs"), P.DEPLOYMENT_COUNT_SATURATION), 0.25),
    )


def irregularity() -> Column:
    return blend(
        (saturate(F.col("schedule_irregularity_sd"), P.IRREGULARITY_SATURATION_HOURS), 0.65),
        (positive_z(F.col("night_shifts_personal_deviation_z")), 0.35),
    )


def hardship() -> Column:
    severity = F.coalesce(lookup(F.col("posting_type"), P.POSTING_SEVERITY), F.lit(0.0)) * F.lit(P.SIGNAL_MAX)
    months = F.col("time_in_current_posting_months")
    over = F.when(
        F.coalesce(F.col("posting_type") == "hard_area", F.lit(False)),
        F.when(months.isNotNull(), F.greatest(F.lit(0.0), months - F.lit(P.HARD_AREA_TENURE_MONTHS))),
    ).otherwise(F.lit(0.0))
    return blend((severity, 0.55), (saturate(over, P.TENURE_OVERRUN_SATURATION), 0.45))


def churn() -> Column:
    return blend(
        (saturate(F.col("transfer_count_past_2yrs"), P.TRANSFER_COUNT_SATURATION), 0.70),
        (saturate_inverse(F.col("time_since_last_transfer_days"), P.TRANSFER_RECENCY_DAYS), 0.30),
    )


def training() -> Column:
    return saturate(F.col("training_hours_last_3months"), P.TRAINING_SATURATION_HOURS)


def leave_deficit() -> Column:
    return saturate_inverse(F.col("leave_entitlement_used_pct"), 100.0)


def family_separation() -> Column:
    apart = F.coalesce(F.col("family_separated"), F.lit(False))
    fact = F.when(apart, F.lit(P.SIGNAL_MAX)).otherwise(F.lit(0.0))
    duration = F.when(
        apart, saturate(F.col("time_in_current_posting_months"), P.FAMILY_SATURATION_MONTHS)
    ).otherwise(F.lit(0.0))
    return blend((fact, 0.65), (duration, 0.35))


REGISTRY = {
    "workload_deviation_signal": (workload, ["workload_deviation_pct", "duty_hours_personal_deviation_z"]),
    "recovery_pattern_signal": (recovery, ["days_since_last_leave", "holiday_weekly_off_availed_pct"]),
    "deployment_stability_signal": (
        deployment, ["current_deployment_length_months", "deployment_count_past_2yrs"]),
    "schedule_irregularity_signal": (
        irregularity, ["schedule_irregularity_sd", "night_shifts_personal_deviation_z"]),
    "posting_hardship_signal": (hardship, ["posting_type", "time_in_current_posting_months"]),
    "transfer_churn_signal": (churn, ["transfer_count_past_2yrs", "time_since_last_transfer_days"]),
    "training_load_signal": (training, ["training_hours_last_3months"]),
    "leave_deficit_signal": (leave_deficit, ["leave_entitlement_used_pct"]),
    "family_separation_signal": (family_separation, ["family_separated", "time_in_current_posting_months"]),
}


def behavioral_signals(features: DataFrame, voice: DataFrame | None = None) -> DataFrame:
    """Keys, context, nine signals and the neutral-filled voice pair."""
    needed = {c for _, columns in REGISTRY.values() for c in columns}
    missing = sorted(needed - set(features.columns))
    if missing:
        raise KeyError(f"feature columns missing: {missing}")
    carried = [c for c in CARRIED if c in features.columns]
    out = features.select(*KEYS, *carried, *[build().alias(name) for name, (build, _) in REGISTRY.items()])
    if voice is None:
        return out.withColumn(P.VOICE_SIGNAL, F.lit(0.0)).withColumn(P.VOICE_FLAG, F.lit(0.0))
    return with_voice(out, voice)


def with_voice(rows: DataFrame, voice: DataFrame) -> DataFrame:
    """The aligned voice signal beside each row, and whether there was one."""
    incoming = voice.select(ID, SNAP, F.col(P.VOICE_SIGNAL).alias("_voice"))
    return (
        rows.join(incoming, KEYS, "left")
        .withColumn(P.VOICE_SIGNAL, F.coalesce("_voice", F.lit(0.0)))
        .withColumn(P.VOICE_FLAG, F.col("_voice").isNotNull().cast("double"))
        .drop("_voice")
    )


def voice_coverage(signals: DataFrame) -> DataFrame:
    return signals.agg(
        F.avg(P.VOICE_FLAG).alias("voice_coverage"), F.count(F.lit(1)).alias("row_count")
    )
