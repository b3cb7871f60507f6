"""Bands, trends, completeness confidence, attribution, escalation, self-report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fettle import policy as P
from fettle import texts
from fettle.functions.scales import lookup
from fettle.operators import spread
from fettle.operators.scoring import SCORE, band


def with_level(df: DataFrame, score: str = SCORE) -> DataFrame:
    return df.withColumn("risk_level", band(F.col(score)))


def band_index(score: Column) -> Column:
    return F.when(score >= P.HIGH_MIN, 3).when(score >= P.MODERATE_MIN, 2).otherwise(1)


def bands_spanned(low: Column, high: Column) -> Column:
    levels = F.array(*[F.lit(v) for v in P.LEVELS])
    return F.slice(levels, band_index(low), band_index(high) - band_index(low) + 1)


def with_certainty(df: DataFrame) -> DataFrame:
    """Bands an interval touches; certain when it is one."""
    spanned = bands_spanned(F.col("interval_low"), F.col("interval_high"))
    return df.withColumn("bands_plausible", spanned).withColumn(
        "band_certainty",
        F.when(F.col("interval_low").isNull(), F.lit(None).cast("string"))
        .when(F.size(spanned) == 1, "certain").otherwise("borderline"))


def with_proximity(df: DataFrame, score: str = SCORE) -> DataFrame:
    """Distance to the cutoffs on either side and the sentence about it."""
    s, level = F.col(score), band(F.col(score))
    to_next = F.when(level == "Moderate", F.lit(P.HIGH_MIN) - s).when(level == "Normal", F.lit(P.MODERATE_MIN) - s)
    to_below = F.when(level == "High", s - F.lit(P.HIGH_MIN)).when(level == "Moderate", s - F.lit(P.MODERATE_MIN))
    over = F.coalesce(to_below <= P.BAND_MARGIN, F.lit(False))
    under = F.coalesce(to_next <= P.BAND_MARGIN, F.lit(False))
    note = F.when(over, F.format_string(texts.BARELY_OVER, F.bround(to_below, 1), level)).when(
        under, F.format_string(texts.BARELY_UNDER, F.bround(to_next, 1), level))
    return (
        df.withColumn("distance_to_next_band", to_next).withColumn("distance_to_band_below", to_below)
        .withColumn("barely_over_cutoff", over).withColumn("barely_under_next_band", under)
        .withColumn("proximity_note", note)
    )


def band_distribution(df: DataFrame, column: str = "risk_level", values: tuple[str, ...] = P.LEVELS) -> DataFrame:
    """Rows per value, every declared value present."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string").join(
        counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def slope_per_30_days(score: Column, day: Column) -> Column:
    return F.regr_slope(score, F.datediff(day, F.lit(P.REFERENCE_DATE.isoformat()).cast("date"))) * F.lit(30.0)


def direction(slope: Column, points: Column) -> Column:
    return (
        F.when((points < P.TREND_MIN_POINTS) | slope.isNull() | F.isnan(slope), "Insufficient data")
        .when(slope > P.TREND_STABLE_BAND, "Rising").when(slope < -P.TREND_STABLE_BAND, "Improving")
        .otherwise("Stable")
    )


def trends(scored: DataFrame, score: str = SCORE) -> DataFrame:
    """One row per person; the trailing run counts dates after the last Normal one.

    Two partial-aggregated passes, no per-person ordering: first the last Normal
    date and the regression sums, then the run length.
    """
    day, s = F.col("snapshot_date"), F.col(score)
    elevated = F.coalesce(F.col("risk_level").isin(*P.LEVELS[1:]), F.lit(False))
    base = scored.groupBy("pseudonym_id").agg(
        slope_per_30_days(s, day).alias("_slope"), F.count(s).alias("points_used"),
        F.min_by(s, day).alias("first_score"), F.max_by(s, day).alias("latest_score"),
        F.max(F.when(~elevated, day)).alias("_last_normal"),
        F.sort_array(F.collect_set(F.when(elevated, day))).alias("_elevated"),
    )
    run = F.size(F.filter("_elevated", lambda d: F.col("_last_normal").isNull() | (d > F.col("_last_normal"))))
    enough = F.col("points_used") >= P.TREND_MIN_POINTS
    return base.select(
        "pseudonym_id", direction(F.col("_slope"), F.col("points_used")).alias("trend_direction"),
        F.when(enough, F.col("_slope")).alias("slope_per_30_days"), "points_used",
        run.alias("persistence_snapshots"), (run >= P.PERSISTENCE_SNAPSHOTS).alias("is_persistent"),
        "first_score", "latest_score",
    )


def recency(age_days: Column) -> Column:
    full, zero = P.RECENCY_FULL_DAYS, P.RECENCY_ZERO_DAYS
    return (
        F.when(age_days.isNull(), F.lit(0.0)).when(age_days <= full, F.lit(1.0)).when(age_days >= zero, F.lit(0.0))
        .otherwise(F.lit(1.0) - (age_days - full) / F.lit(float(zero - full)))
    )


def confidence_score(snapshots_available: Column, age_days: Column) -> Column:
    present = sum((F.col(c).isNotNull().cast("int") for c in P.SIGNALS), F.lit(0))
    w = P.CONFIDENCE_WEIGHTS
    depth = F.least(F.lit(1.0), snapshots_available / F.lit(float(P.CONFIDENCE_FULL_SNAPSHOTS)))
    return (
        F.lit(w["feature_completeness"]) * (present / F.lit(float(len(P.SIGNALS))))
        + F.lit(w["history_depth"]) * depth + F.lit(w["recency"]) * recency(age_days)
    )


def confidence_level(score: Column) -> Column:
    return F.when(score >= P.CONFIDENCE_HIGH_MIN, "High").when(score >= P.CONFIDENCE_MEDIUM_MIN, "Medium") \
        .otherwise("Low")


def with_confidence(signals: DataFrame, ages: DataFrame | None = None) -> DataFrame:
    """Completeness heuristic per row; people without a known age count as fresh."""
    depth = signals.groupBy("pseudonym_id").agg(F.count("snapshot_date").alias("_snapshots"))
    out = signals.join(depth, "pseudonym_id")
    if ages is None:
        age = F.lit(0.0)
    else:
        out = out.join(ages.select("pseudonym_id", F.col("data_age_days").alias("_age")), "pseudonym_id", "left")
        age = F.coalesce(F.col("_age").cast("double"), F.lit(0.0))
    score = confidence_score(F.col("_snapshots"), age)
    return out.withColumn("confidence", score).withColumn("confidence_level", confidence_level(score)).drop(
        "_snapshots", "_age")


def latest_rows(scored: DataFrame) -> DataFrame:
    """Rows of the newest snapshot, by a scalar subquery."""
    return scored.filter(F.col("snapshot_date") == scored.agg(F.max("snapshot_date")).scalar())


def unit_aggregates(scored: DataFrame, score: str = SCORE) -> DataFrame:
    """Newest-snapshot unit statistics; units below the minimum size show only that they exist.

    The median is exact and counted over range slices, because a unit may hold
    a large part of the population.
    """
    latest = latest_rows(scored)
    stats = latest.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("personnel_count"), F.avg(score).alias("mean_risk"),
        F.avg(F.coalesce(F.col("risk_level").isin(*P.LEVELS[1:]), F.lit(False)).cast("double")).alias("elevated_share"),
        F.avg(F.coalesce(F.col("risk_level") == "High", F.lit(False)).cast("double")).alias("high_share"),
    )
    medians = spread.exact_quantiles(latest, ["unit_id"], score, {"median_risk": 0.5})
    shown = F.col("personnel_count") >= P.MIN_UNIT_SIZE
    return stats.join(medians, "unit_id", "left").select(
        "unit_id", "personnel_count", *[F.when(shown, F.col(c)).alias(c) for c in (
            "mean_risk", "median_risk", "elevated_share", "high_share")],
        (shown & (F.col("mean_risk") >= P.UNIT_STRAINED_MIN)).alias("is_systemically_strained"),
        (~shown).alias("is_suppressed"),
    )


def with_attribution(scored: DataFrame, units: DataFrame, score: str = SCORE) -> DataFrame:
    """Individual / Systemic / Mixed against the unit's newest mean, with the reason."""
    unit = units.select("unit_id", F.col("mean_risk").alias("unit_mean"),
                        F.col("is_systemically_strained").alias("_strained"))
    mean, gap = F.col("unit_mean"), F.col(score) - F.col("unit_mean")
    strained, above = F.col("_strained"), gap > P.SYSTEMIC_GAP
    label = (
        F.when(mean.isNull(), "Individual").when(strained & above, "Mixed").when(strained, "Systemic")
        .when(above, "Individual").otherwise("Systemic")
    )
    why = (
        F.when(mean.isNull(), F.lit(texts.NO_UNIT))
        .when(strained & above, F.format_string(texts.MIXED, F.bround(mean), F.bround(gap)))
        .when(strained, F.format_string(texts.STRAINED_UNIT, F.bround(mean)))
        .when(above, F.format_string(texts.ABOVE_UNIT, F.bround(gap), F.bround(mean)))
        .otherwise(F.format_string(texts.LIKE_UNIT, F.bround(mean)))
    )
    return (
        scored.join(unit, "unit_id", "left").withColumn("points_above_unit", gap)
        .withColumn("risk_attribution", label).withColumn("attribution_explanation", why).drop("_strained")
    )


def officer_visible(level: Column, persistent: Column, trend: Column) -> Column:
    """High, or Moderate that is both persistent and rising; anything missing is not escalated."""
    rising = F.coalesce(persistent, F.lit(False)) & F.coalesce(trend == "Rising", F.lit(False))
    return F.coalesce(level == "High", F.lit(False)) | (F.coalesce(level == "Moderate", F.lit(False)) & rising)


def visibility_rule() -> str:
    """The escalation rule in force, as one sentence."""
    return texts.VISIBILITY_RULE % P.PERSISTENCE_SNAPSHOTS


def answer_strain(value: Column, reverse: Column) -> Column:
    bounded = F.when(value.isNotNull(), F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(float(P.ANSWER_MAX))))
    share = bounded / F.lit(float(P.ANSWER_MAX))
    return F.when(reverse, F.lit(1.0) - share).otherwise(share) * F.lit(P.SIGNAL_MAX)


def difference_class(difference: Column) -> Column:
    return (
        F.when(difference < -P.DIVERGENCE_POINTS, "self_report_below_record")
        .when(difference > P.DIVERGENCE_POINTS, "self_report_above_record").otherwise("aligned")
    )


def latest_submission(checkins: DataFrame) -> DataFrame:
    """Newest submission per person by a partial-aggregated maximum."""
    return checkins.groupBy("pseudonym_id").agg(
        F.max(F.struct("submitted_at", "submission_id", "answers")).alias("s")
    ).select("pseudonym_id", "s.submitted_at", "s.submission_id", "s.answers")


def self_report(checkins: DataFrame, questions: DataFrame, case_signals: DataFrame) -> DataFrame:
    """Newest answers per signal against the recorded value."""
    answers = latest_submission(checkins).select("pseudonym_id", "submitted_at", F.inline("answers"))
    scale = questions.filter((F.col("kind") == "scale") & (F.col("signal_name") != ""))
    reported = (
        answers.join(F.broadcast(scale.select("question_id", "signal_name", "reverse_scored")), "question_id")
        .filter(F.col("value").isNotNull())
        .groupBy("pseudonym_id", "submitted_at", "signal_name")
        .agg(F.avg(answer_strain(F.col("value"), F.col("reverse_scored"))).alias("self_reported_strain"),
             F.concat_ws(",", F.array_sort(F.collect_list("question_id"))).alias("question_ids"))
    )
    recorded = case_signals.select("pseudonym_id", *P.MODEL_INPUTS).unpivot(
        ["pseudonym_id"], list(P.MODEL_INPUTS), "signal_name", "recorded_value")
    gap = F.col("self_reported_strain") - F.col("recorded_value")
    return reported.join(recorded, ["pseudonym_id", "signal_name"]).withColumn("difference", gap).withColumn(
        "classification", difference_class(gap)).withColumn("label", lookup(F.col("signal_name"), P.SIGNAL_LABELS))


def divergences(compared: DataFrame) -> DataFrame:
    position = F.row_number().over(
        Window.partitionBy("pseudonym_id").orderBy(F.abs("difference").desc(), "signal_name"))
    return compared.filter(F.col("classification") != "aligned").withColumn("position", position)


def self_report_notes(compared: DataFrame) -> DataFrame:
    """One sentence for the person and one for the officer (which names up to three signals, no numbers)."""
    worst = divergences(compared)
    lowered = F.lower("label")
    first = worst.filter(F.col("position") == 1).select(
        "pseudonym_id", F.col("classification").alias("_way"),
        F.concat(F.lower(F.substring("label", 1, 1)), F.expr("substring(label, 2)")).alias("_subject"))
    named = worst.filter(F.col("position") <= 3).withColumn("_l", lowered).groupBy("pseudonym_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_l"))), lambda x: x["_l"]), ", ")
        .alias("_names"))
    everyone = compared.groupBy("pseudonym_id").agg(F.count(F.lit(1)).alias("answered_signal_count"))
    personal = (
        F.when(F.col("_way").isNull(), F.lit(texts.ANSWERS_ALIGNED))
        .when(F.col("_way") == "self_report_below_record", F.format_string(texts.ANSWERS_BELOW, F.col("_subject")))
        .otherwise(F.format_string(texts.ANSWERS_ABOVE, F.col("_subject"))))
    officer = F.when(F.col("_names").isNotNull(), F.format_string(texts.OFFICER_DIVERGENCE, F.col("_names")))
    return everyone.join(first, "pseudonym_id", "left").join(named, "pseudonym_id", "left").select(
        "pseudonym_id", "answered_signal_count", personal.alias("personal_note"), officer.alias("officer_note"))


def personal_view(compared: DataFrame) -> DataFrame:
    return compared.select("pseudonym_id", "signal_name", "label", "self_reported_strain", "recorded_value",
                           "difference", "classification", "question_ids")


def officer_view(diverging: DataFrame) -> DataFrame:
    """Which signal and which way; no answers, no numbers."""
    return diverging.select("pseudonym_id", "position", "signal_name", "label", "classification")


def answer_problem(kind: Column, question_id: Column | None = None, value: Column | None = None,
                   text: Column | None = None) -> Column:
    """Reject reason of one raw answer (question_id, value text, free text), NULL when acceptable."""
    qid = F.trim(F.coalesce(F.col("question_id") if question_id is None else question_id, F.lit("")))
    text = F.trim(F.coalesce(F.col("text") if text is None else text, F.lit("")))
    raw = F.col("value") if value is None else value
    whole = F.trim(raw).rlike(r"^[+-]?[0-9]+$")
    number = F.when(whole, F.trim(raw).try_cast("int"))
    return (
        F.when(qid == "", "no question id").when(kind.isNull(), "unknown question")
        .when(F.length(text) > P.MAX_FREE_TEXT, "text too long")
        .when(raw.isNotNull() & number.isNull(), "not a whole number")
        .when(number.isNotNull() & ~number.between(0, P.ANSWER_MAX), "off the scale")
        .when(raw.isNull() & (text == ""), "empty")
        .when((kind == "scale") & raw.isNull(), "needs a number")
        .when((kind == "free_text") & (text == ""), "needs text")
    )


def validate_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Per answer: reject reason, then per submission: size and duplicate rules."""
    kinds = F.broadcast(questions.select("question_id", "kind"))
    qid = F.trim("question_id")
    checked = answers.withColumn("question_id", qid).join(kinds, "question_id", "left").withColumn(
        "answer_problem", answer_problem(F.col("kind")))
    per = checked.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("_answers"), F.countDistinct("question_id").alias("_questions"),
        F.count_if(F.col("answer_problem").isNotNull()).alias("bad_answers"))
    reason = (
        F.when(F.col("_answers") > P.MAX_ANSWERS, "too many answers").when(F.col("bad_answers") > 0, "bad answer")
        .when(F.col("_questions") < F.col("_answers"), "answered twice")
    )
    return checked.join(per.withColumn("submission_problem", reason).select(
        "submission_id", "submission_problem"), "submission_id")


def gray_area_check(cases: DataFrame, profiles: DataFrame, held_out: DataFrame) -> DataFrame:
    """High and visible rates of flagged people and the rest: overall, held out, per profile."""
    profile = F.coalesce(F.trim("benign_profile"), F.lit(""))
    rows = (
        cases.join(profiles.select("pseudonym_id", profile.alias("profile")), "pseudonym_id")
        .join(held_out.select("pseudonym_id", "held_out"), "pseudonym_id")
        .select(
            F.when(F.col("profile") != "", "benign").otherwise("rest").alias("grp"),
            F.when(F.col("profile") != "", F.col("profile")).alias("profile"), "held_out",
            (F.col("risk_level") == "High").cast("int").alias("high"),
            F.col("is_officer_visible").cast("int").alias("visible"))
    )
    grp, held, prof = F.col("grp"), F.col("held_out"), F.col("profile")
    grouped = rows.groupingSets([[grp], [grp, held], [prof]], grp, held, prof).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("high").alias("high"),
        F.sum("visible").alias("visible"))
    scope = F.when(F.col("profile").isNotNull(), F.concat(F.lit("profile:"), F.col("profile"))) \
        .when(F.col("held_out"), F.concat(F.col("grp"), F.lit("_held_out"))).otherwise(F.col("grp"))
    keep = ((F.col("g") == 3) | ((F.col("g") == 1) & F.col("held_out"))
            | ((F.col("g") == 6) & F.col("profile").isNotNull()))
    return grouped.filter(keep).select(
        scope.alias("scope"), "n", "high", "visible",
        (F.col("high") / F.col("n")).alias("high_rate"), (F.col("visible") / F.col("n")).alias("visible_rate"))
