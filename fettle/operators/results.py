"""Queries the applications ask of the scored data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fettle import policy as P
from fettle import texts
from fettle.functions.scales import lookup
from fettle.operators import analytics
from fettle.operators.privacy import assert_unit_level

def assemble_cases(latest: DataFrame, trends: DataFrame, findings: DataFrame) -> DataFrame:
    """Flat case rows of the newest snapshot: scored columns, trend, near-miss and visibility."""
    near = findings.select("unit_id", F.lit(True).alias("_near"))
    trend = trends.drop("first_score", "latest_score")
    visible = analytics.officer_visible(F.col("risk_level"), F.col("is_persistent"), F.col("trend_direction"))
    return (
        latest.join(trend, "pseudonym_id", "left").join(near, "unit_id", "left")
        .withColumn("unit_near_miss", F.coalesce("_near", F.lit(False))).drop("_near")
        .withColumn("is_officer_visible", visible)
        .withColumn("has_voice_signal", F.col(P.VOICE_FLAG) > 0)
    )


def nested_cases(cases: DataFrame, factors: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """One document per case, values rounded the way they are published."""
    r1 = lambda c: F.bround(F.col(c), 1)
    out = cases.select(
        "pseudonym_id", "unit_id", "posting_type", "snapshot_date",
        F.struct(
            r1("welfare_risk_score").alias("score"), F.col("risk_level").alias("level"),
            lookup(F.col("risk_level"), texts.LEVEL_DESCRIPTIONS).alias("description"),
            r1("interval_low").alias("interval_low"), r1("interval_high").alias("interval_high"),
            "bands_plausible", "band_certainty",
            F.when(F.col("band_certainty") == "borderline", F.lit(texts.BORDERLINE_NOTE)).alias("borderline_note"),
            "barely_over_cutoff", "barely_under_next_band", "proximity_note",
        ).alias("risk"),
        F.struct(
            F.col("risk_attribution").alias("classification"), r1("unit_mean").alias("unit_mean"),
            r1("points_above_unit").alias("points_above_unit"),
            F.col("attribution_explanation").alias("explanation")).alias("attribution"),
        F.struct(F.bround("confidence", 3).alias("score"), F.col("confidence_level").alias("level")).alias("confidence"),
        F.struct(
            F.col("trend_direction").alias("direction"), F.bround("slope_per_30_days", 2).alias("slope_per_30_days"),
            "persistence_snapshots", "is_persistent").alias("trend"),
        F.create_map(*[x for c in P.MODEL_INPUTS for x in (F.lit(c), r1(c))]).alias("signals"),
        "has_voice_signal", "unit_near_miss", "is_officer_visible",
    )
    if factors is not None:
        per = factors.groupBy("pseudonym_id").agg(F.array_sort(F.collect_list(F.struct(
            "position", "signal_name", F.bround("contribution", 2).alias("contribution"),
            F.bround("signal_value", 2).alias("signal_value")))).alias("contributing_factors"))
        out = out.join(per, "pseudonym_id", "left")
    if actions is not None:
        per = actions.groupBy("pseudonym_id").agg(F.array_sort(F.collect_list(F.struct(
            "rank", "id", "title", "action_owner", "priority", "low_confidence"))).alias("recommendations"))
        out = out.join(per, "pseudonym_id", "left")
    return out


def history(scored: DataFrame) -> DataFrame:
    """Score history per person (one entry per snapshot), oldest first."""
    return scored.groupBy("pseudonym_id").agg(F.array_sort(F.collect_list(F.struct(
        "snapshot_date", F.bround("welfare_risk_score", 1).alias("score"), F.col("risk_level").alias("level")
    ))).alias("points"))


def priority_score(score: str = "welfare_risk_score") -> Column:
    bonus = F.coalesce(lookup(F.col("trend_direction"), P.TREND_BONUS), F.lit(0.0))
    penalty = F.when(F.col("confidence_level") == "Low", F.lit(P.LOW_CONFIDENCE_PENALTY)).otherwise(F.lit(0.0))
    return F.col(score) + bonus - penalty


QUEUE_COLUMNS = [
    "pseudonym_id", "unit_id", "posting_type", "risk_level", "welfare_risk_score", "band_certainty",
    "barely_over_cutoff", "trend_direction", "persistence_snapshots", "confidence_level", "risk_attribution",
    "unit_near_miss", "priority",
]


def queue(cases: DataFrame) -> DataFrame:
    """Every case the escalation rule admits, highest priority first (ties: score, then id)."""
    return cases.filter("is_officer_visible").withColumn("priority", priority_score()).select(*QUEUE_COLUMNS).orderBy(
        F.col("priority").desc(), F.col("welfare_risk_score").desc(), "pseudonym_id")


def capped_queue(cases: DataFrame, capacity: int = P.QUEUE_CAPACITY, show_all: bool = False) -> DataFrame:
    """The shown part of the queue: a bounded top-n, merged from per-task top-n lists."""
    ordered = queue(cases)
    return ordered if show_all else ordered.limit(capacity)


def queue_counts(cases: DataFrame, capacity: int = P.QUEUE_CAPACITY, show_all: bool = False) -> DataFrame:
    """Eligible, shown and held-back totals beside the shown list."""
    totals = cases.agg(F.count_if("is_officer_visible").alias("total_eligible"), F.count(F.lit(1)).alias("population"))
    shown = capped_queue(cases, capacity, show_all).agg(
        F.count(F.lit(1)).alias("visible_count"),
        F.count_if(F.col("band_certainty") == "borderline").alias("borderline_count"))
    return totals.crossJoin(F.broadcast(shown)).withColumn(
        "held_back_count", F.col("total_eligible") - F.col("visible_count"))


def case_detail(cases: DataFrame, factors: DataFrame, units: DataFrame, findings: DataFrame, scored: DataFrame,
                actions: DataFrame, diverging: DataFrame, alerts: DataFrame) -> DataFrame:
    """Everything an officer opens with a visible case, one row per case.

    Each side is reduced to one row per key before it is joined.
    """
    key = "pseudonym_id"
    f = factors.groupBy(key).agg(F.concat_ws(",", F.transform(
        F.array_sort(F.collect_list(F.struct("position", "signal_name"))), lambda x: x["signal_name"]
    )).alias("factor_names"))
    h = scored.groupBy(key).agg(F.count(F.lit(1)).alias("history_points"))
    a = actions.groupBy(key).agg(F.count(F.lit(1)).alias("action_count"), F.max("at").alias("last_action_at"))
    d = diverging.groupBy(key).agg(F.count(F.lit(1)).alias("divergence_count"))
    al = alerts.filter(F.col("recipient_role") == P.ROLE_OFFICER).groupBy(key).agg(
        F.count(F.lit(1)).alias("alert_count"))
    u = units.select("unit_id", F.col("mean_risk").alias("unit_mean_risk"),
                     F.col("personnel_count").alias("unit_people"),
                     F.col("is_systemically_strained").alias("unit_strained"))
    n = findings.select("unit_id", F.col("consecutive_snapshots").alias("unit_near_miss_run"))
    out = cases.filter("is_officer_visible").select(
        key, "unit_id", "posting_type", "snapshot_date", "welfare_risk_score", "risk_level", "band_certainty",
        "trend_direction", "confidence_level", "risk_attribution", "has_voice_signal")
    for side in (f, h, a, d, al):
        out = out.join(side, key, "left")
    out = out.join(u, "unit_id", "left").join(n, "unit_id", "left")
    counts = ("history_points", "action_count", "divergence_count", "alert_count")
    for c in counts:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out


def unit_payload(units: DataFrame, pressed: DataFrame, findings: DataFrame) -> DataFrame:
    near = findings.select("unit_id", F.lit(True).alias("_near"))
    side = pressed.drop("snapshot_date", "personnel_count")
    return assert_unit_level(
        units.join(side, "unit_id", "left").join(near, "unit_id", "left")
        .withColumn("is_near_miss", F.coalesce("_near", F.lit(False))).drop("_near"))


def unit_overview(payload: DataFrame) -> DataFrame:
    """Units by mean risk; a suppressed unit shows a reason and nothing else."""
    keep = ["personnel_count", "mean_risk", "median_risk", "elevated_share", "high_share", "is_systemically_strained",
            "is_near_miss", "thresholds_crossed"]
    shown = ~F.col("is_suppressed")
    return assert_unit_level(payload.select(
        "unit_id", "is_suppressed", F.when(F.col("is_suppressed"), F.lit(texts.SMALL_UNIT % P.MIN_UNIT_SIZE)).alias("suppression_reason"),
        *[F.when(shown, F.col(c)).alias(c) for c in keep],
    ).orderBy(F.coalesce("mean_risk", F.lit(-1.0)).desc(), "unit_id"))


def near_miss_view(findings: DataFrame, close: DataFrame) -> DataFrame:
    """Confirmed findings and the units nearest the line in one list."""
    a = findings.select(F.lit("finding").alias("kind"), "unit_id", "consecutive_snapshots",
                        F.lit(None).cast("int").alias("thresholds_crossed"),
                        F.lit(None).cast("string").alias("shortfall_condition"),
                        F.lit(None).cast("double").alias("shortfall_amount"), "personnel_count")
    b = close.select(F.lit("closest").alias("kind"), "unit_id",
                     F.lit(None).cast("int").alias("consecutive_snapshots"), "thresholds_crossed",
                     "shortfall_condition", "shortfall_amount", "personnel_count")
    return assert_unit_level(a.unionByName(b))


def personal_summary(cases: DataFrame, factors: DataFrame, compared: DataFrame) -> DataFrame:
    """A person's own view; a missing explanation is said, not hidden."""
    f = factors.groupBy("pseudonym_id").agg(F.concat_ws(",", F.transform(
        F.array_sort(F.collect_list(F.struct("position", "signal_name"))), lambda x: x["signal_name"]
    )).alias("factor_names"))
    c = compared.groupBy("pseudonym_id").agg(
        F.count(F.lit(1)).alias("answered_signals"),
        F.count_if(F.col("classification") != "aligned").alias("diverging_signals"))
    return (
        cases.select("pseudonym_id", "snapshot_date", "welfare_risk_score", "risk_level", "trend_direction",
                     "confidence_level", "is_officer_visible", "has_voice_signal")
        .join(f, "pseudonym_id", "left").join(c, "pseudonym_id", "left")
        .withColumn("explanation_available", F.col("factor_names").isNotNull())
        .withColumn("answered_signals", F.coalesce("answered_signals", F.lit(0)))
        .withColumn("diverging_signals", F.coalesce("diverging_signals", F.lit(0)))
    )


def tailored_questions(factors: DataFrame, questions: DataFrame, limit: int = P.MAX_TAILORED) -> DataFrame:
    """Up to three questions from the person's top factors, in factor then bank order."""
    rank = F.row_number().over(Window.partitionBy("pseudonym_id").orderBy("factor_position", "position"))
    bank = questions.filter(F.col("group_signal") != "").select(
        "question_id", "text", "position", F.col("group_signal").alias("signal_name"))
    return (
        factors.select("pseudonym_id", "signal_name", F.col("position").alias("factor_position"))
        .join(F.broadcast(bank), "signal_name").withColumn("rank", rank).filter(F.col("rank") <= limit)
        .select("pseudonym_id", "rank", "question_id", F.col("signal_name").alias("tailored_to"), "text")
    )


def checkin_history(checkins: DataFrame, questions: DataFrame, pseudonym_id: str | None = None) -> DataFrame:
    """Answers with the wording asked; of one person newest first, of all people in no order."""
    rows = checkins if pseudonym_id is None else checkins.filter(F.col("pseudonym_id") == pseudonym_id)
    flat = rows.select("pseudonym_id", "submission_id", "submitted_at", F.inline("answers"))
    text = F.broadcast(questions.select("question_id", F.col("text").alias("text_asked")))
    out = flat.join(text, "question_id", "left").withColumn("text_asked", F.coalesce("text_asked", F.lit("")))
    return out if pseudonym_id is None else out.orderBy(F.col("submitted_at").desc(), "submission_id")


def notifications(alerts: DataFrame, pseudonym_id: str | None = None) -> DataFrame:
    own = alerts.filter(F.col("recipient_role") == P.ROLE_PERSONNEL)
    return own if pseudonym_id is None else own.filter(F.col("pseudonym_id") == pseudonym_id)


def run_metadata(scored: DataFrame, cases: DataFrame, medians: DataFrame) -> DataFrame:
    """One row describing the run."""
    level, certainty = F.col("risk_level"), F.col("band_certainty")
    base = cases.agg(
        F.count(F.lit(1)).alias("population"), F.max("snapshot_date").alias("latest_snapshot"),
        *[F.count_if(level == v).alias(f"band_{v.lower()}") for v in P.LEVELS],
        F.count_if(certainty == "certain").alias("certain"), F.count_if(certainty == "borderline").alias("borderline"),
        F.count_if("is_officer_visible").alias("officer_visible_count"),
    )
    span = scored.agg(F.countDistinct("snapshot_date").alias("snapshot_count"),
                      F.avg(P.VOICE_FLAG).alias("voice_coverage"))
    med = medians.groupBy().pivot("signal_name", list(P.SIGNALS)).agg(F.first("median")).select(
        *[F.col(c).alias(f"median_{c}") for c in P.SIGNALS])
    return base.crossJoin(F.broadcast(span)).crossJoin(F.broadcast(med)).withColumn(
        "risk_moderate_min", F.lit(P.MODERATE_MIN)).withColumn("risk_high_min", F.lit(P.HIGH_MIN)).withColumn(
        "min_unit_size", F.lit(P.MIN_UNIT_SIZE)).withColumn("escalation_rule", F.lit(analytics.visibility_rule()))


def sample_per_band(cases: DataFrame, per_band: int = 2) -> DataFrame:
    """Two highest-scored cases per band (pushed below the shuffle as a group limit)."""
    rank = F.row_number().over(
        Window.partitionBy("risk_level").orderBy(F.col("welfare_risk_score").desc(), "pseudonym_id"))
    return cases.withColumn("rank", rank).filter(F.col("rank") <= per_band).select(
        "pseudonym_id", "risk_level", "unit_id", "has_voice_signal")
