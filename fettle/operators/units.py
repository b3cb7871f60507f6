"""Unit-level near-miss detection: high demand, little recovery, thin staffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle import texts

DEMAND, RECOVERY = "workload_deviation_signal", "recovery_pattern_signal"


def evaluate_conditions(signals: DataFrame, capacity: DataFrame) -> DataFrame:
    """The three measurements per unit and snapshot; units below the minimum are left out."""
    staffing = capacity.filter(F.col("sanctioned_strength") > 0).select(
        "unit_id", (F.col("on_strength").cast("double") / F.col("sanctioned_strength")).alias("staffing_ratio"))
    measured = signals.groupBy("unit_id", "snapshot_date").agg(
        F.count(F.lit(1)).alias("personnel_count"), F.avg(DEMAND).alias("mean_demand"),
        F.avg(RECOVERY).alias("mean_recovery_deficit"),
    ).filter(F.col("personnel_count") >= P.MIN_UNIT_SIZE)
    met = (
        (F.col("mean_demand") >= P.DEMAND_MIN) & (F.col("mean_recovery_deficit") >= P.RECOVERY_MIN)
        & (F.col("staffing_ratio") <= P.STAFFING_MAX)
    )
    return measured.join(staffing, "unit_id", "left").withColumn("conditions_met", F.coalesce(met, F.lit(False)))


def summary_text() -> Column:
    return F.format_string(
        texts.NEAR_MISS, F.col("unit_id"), F.col("mean_demand"), F.col("mean_recovery_deficit"),
        F.col("staffing_ratio") * F.lit(100.0), F.col("consecutive_snapshots"))


def latest_condition(conditions: DataFrame) -> DataFrame:
    """Newest measurement per unit."""
    day = F.col("snapshot_date")
    return conditions.groupBy("unit_id").agg(
        F.max(day).alias("snapshot_date"),
        *[F.max_by(c, day).alias(c) for c in (
            "mean_demand", "mean_recovery_deficit", "staffing_ratio", "personnel_count", "conditions_met")])


def detect(conditions: DataFrame, min_consecutive: int = P.MIN_CONSECUTIVE) -> DataFrame:
    """Units whose qualifying run reaches the newest snapshot.

    A run is the qualifying dates after the unit's last failing one; one group
    per unit, no ordering window.
    """
    day = F.col("snapshot_date")
    latest = latest_condition(conditions).drop("conditions_met")
    runs = conditions.groupBy("unit_id").agg(
        F.max(F.when(~F.col("conditions_met"), day)).alias("_fail"),
        F.collect_set(F.when(F.col("conditions_met"), day)).alias("_met"))
    after = F.filter("_met", lambda d: F.col("_fail").isNull() | (d > F.col("_fail")))
    found = runs.withColumn("_run", F.sort_array(after)).filter(F.size("_run") >= min_consecutive)
    return found.join(latest, "unit_id").select(
        "unit_id", F.element_at("_run", 1).alias("first_detected"), F.col("snapshot_date").alias("last_detected"),
        F.size("_run").alias("consecutive_snapshots"), "mean_demand", "mean_recovery_deficit", "staffing_ratio",
        "personnel_count").withColumn("summary", summary_text())


def pressure(conditions: DataFrame) -> DataFrame:
    """Newest measurements, thresholds crossed and signed margins (positive = over the line)."""
    d, r, s = F.col("mean_demand"), F.col("mean_recovery_deficit"), F.col("staffing_ratio")
    crossed = (
        (d >= P.DEMAND_MIN).cast("int") + (r >= P.RECOVERY_MIN).cast("int")
        + F.coalesce(s <= P.STAFFING_MAX, F.lit(False)).cast("int"))
    return latest_condition(conditions).select(
        "unit_id", "snapshot_date", "mean_demand", "mean_recovery_deficit", "staffing_ratio", "personnel_count",
        crossed.alias("thresholds_crossed"), (d - F.lit(P.DEMAND_MIN)).alias("margin_demand"),
        (r - F.lit(P.RECOVERY_MIN)).alias("margin_recovery_deficit"),
        (F.lit(P.STAFFING_MAX) - s).alias("margin_staffing"))


def published_pressure(pressed: DataFrame) -> DataFrame:
    """Rounded as shown on screens; ``closest`` ranks these published margins."""
    return (
        pressed.withColumn("margin_demand", F.bround("margin_demand", 1))
        .withColumn("margin_recovery_deficit", F.bround("margin_recovery_deficit", 1))
        .withColumn("margin_staffing", F.bround("margin_staffing", 3)))


def closest(pressed: DataFrame, limit: int = P.CLOSEST_UNITS) -> DataFrame:
    """Most thresholds crossed, then the smallest worst shortfall."""
    names = ("demand", "recovery_deficit", "staffing")
    short = F.filter(F.array(*[
        F.struct(F.col(f"margin_{n}").alias("by"), F.lit(i).alias("at"), F.lit(n).alias("name"))
        for i, n in enumerate(names)]), lambda m: m["by"] < 0)
    worst = F.array_min(short)
    return pressed.select(
        "unit_id", "thresholds_crossed", "personnel_count", worst["name"].alias("shortfall_condition"),
        F.abs(worst["by"]).alias("shortfall_amount"),
    ).orderBy(F.col("thresholds_crossed").desc(), F.coalesce("shortfall_amount", F.lit(0.0)), "unit_id").limit(limit)
