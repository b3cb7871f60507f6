"""Hand-computed values of scales, features and signals."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions import scales as N
from fettle.functions.keyed_hash import pseudonym
from fettle.operators import analytics, explain, features, scoring, signals


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(
        f"{n} {'string' if isinstance(v, str) else 'double'}" for n, v in cols.items())) if names else spark.range(1)
    return df.select(expr.alias("v")).first().v


def test_saturate_keeps_null_and_clips(spark):
    rows = spark.createDataFrame([(None,), (-5.0,), (0.0,), (50.0,), (500.0,)], "x double")
    got = [r.v for r in rows.select(N.saturate(F.col("x"), 100.0).alias("v")).collect()]
    assert got == [None, 0.0, 0.0, 50.0, 100.0]
    with pytest.raises(ValueError):
        N.saturate(F.col("x"), 1.0, 1.0)


def test_blend_renormalises(spark):
    assert one(spark, N.blend((F.col("a"), 0.7), (F.lit(None).cast("double"), 0.3)), a=80.0) == pytest.approx(80.0)
    null = F.lit(None).cast("double")
    assert one(spark, N.blend((null, 0.7), (null, 0.3))) is None
    with pytest.raises(ValueError):
        N.blend((F.lit(1.0), 0.7), (F.lit(1.0), 0.4))


def test_percent_default_only_for_bad_denominator(spark):
    assert one(spark, N.percent(F.lit(5.0), F.lit(0.0), 7.0)) == 7.0
    assert one(spark, N.percent(F.lit(5.0), F.lit(20.0), 7.0)) == 25.0
    assert one(spark, N.percent(F.lit(None).cast("double"), F.lit(20.0), 7.0)) is None


def test_pseudonym_equals_hmac(spark):
    import hashlib
    import hmac

    key = b"k" * 80  # longer than one block
    want = "PSN" + hmac.new(key, b"P00012", hashlib.sha256).hexdigest()[:16]
    assert one(spark, pseudonym(F.col("p"), key), p="P00012") == want


def test_family_separation_levels(spark):
    rows = spark.createDataFrame(
        [(False, 30.0), (True, 0.0), (True, 24.0), (True, 60.0), (None, 5.0)],
        "family_separated boolean, time_in_current_posting_months double")
    got = [r.v for r in rows.select(signals.family_separation().alias("v")).collect()]
    assert got == pytest.approx([0.0, 65.0, 100.0, 100.0, 0.0])


def test_change_ratio_cases(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (10.0, 10.0), (None, 3.0), (1.0, 0.001)], "s double, l double")
    got = [r.v for r in rows.select(features.change_ratio(F.col("s"), F.col("l")).alias("v")).collect()]
    assert got == [1.0, 3.0, None, 5.0]


def test_proration_of_half_a_month(spark):
    snap = date(2026, 9, 1)
    duty = spark.createDataFrame([("a", date(2026, 8, 17), 300.0, 2, 4, 1.0, 3)], features.EVENT_DDL["duty_logs"])
    row = features.duty_aggregates(duty, [snap]).first()
    assert row.duty_hours_30d == pytest.approx(15 / 30.44 * 300)
    assert row.now_hours == 300.0


def test_duty_only_after_snapshot_is_zero_hours_but_no_newest_month(spark):
    duty = spark.createDataFrame([("a", date(2026, 9, 15), 300.0, 2, 4, 1.0, 3)], features.EVENT_DDL["duty_logs"])
    row = features.duty_aggregates(duty, [date(2026, 9, 1)]).first()
    assert row.duty_hours_30d == 0.0 and row.now_hours is None and row.now_month is None


def test_missing_tables_use_documented_defaults(spark):
    roster = spark.createDataFrame(
        [("a", "U1", "field", True, False, date(2026, 1, 1))],
        "pseudonym_id string, unit_id string, posting_type string, is_jawan_rank boolean, family_separated boolean, "
        "current_posting_start_date date")
    row = features.feature_matrix({"personnel": roster}, [date(2026, 9, 1)]).first()
    assert row.days_since_last_leave == pytest.approx(730.56)
    assert row.duty_hours_last_month is None and row.duty_hours_7d is None
    assert row.current_deployment_length_months == row.time_in_current_posting_months
    assert row.baseline_observations == 0.0 and row.baseline_is_reliable is False


def test_leave_year_edge_is_inclusive_and_windows_are_not(spark):
    snap = date(2026, 9, 1)
    leave = spark.createDataFrame([("a", date(2025, 9, 1), 4.0), ("a", date(2026, 8, 2), 2.0)],
                                  features.EVENT_DDL["leave_records"])
    row = features.leave_aggregates(leave, [snap]).first()
    assert row.leave_days_year == 6.0 and row.leave_days_30d == 0.0


def test_missing_signal_input_is_an_error(spark):
    with pytest.raises(KeyError):
        signals.behavioral_signals(spark.createDataFrame([("a", date(2026, 9, 1))], "pseudonym_id string, snapshot_date date"))


def history(spark, *scores, gap=30):
    from datetime import timedelta

    rows = [("a", date(2026, 1, 1) + timedelta(days=gap * i), float(s)) for i, s in enumerate(scores)]
    return analytics.with_level(
        spark.createDataFrame(rows, "pseudonym_id string, snapshot_date date, welfare_risk_score double"))


def test_trend_slope_and_short_history(spark):
    row = analytics.trends(history(spark, 40, 45, 50)).first()
    assert row.slope_per_30_days == pytest.approx(5.0) and row.trend_direction == "Rising"
    assert row.persistence_snapshots == 3 and row.is_persistent
    assert analytics.trends(history(spark, 40, 45)).first().trend_direction == "Insufficient data"
    assert analytics.trends(history(spark, 40, 45, 50, gap=0)).first().trend_direction == "Insufficient data"


def test_trailing_run(spark):
    row = analytics.trends(history(spark, 50, 20, 70, 50)).first()
    assert row.persistence_snapshots == 2 and not row.is_persistent


def test_escalation_truth_table(spark):
    cases = [("High", None, None, True), ("Moderate", True, "Stable", False), ("Moderate", True, "Rising", True),
             ("Moderate", False, "Rising", False), ("Normal", True, "Rising", False), (None, True, "Rising", False)]
    df = spark.createDataFrame(cases, "l string, p boolean, t string, want boolean")
    got = df.select(analytics.officer_visible(F.col("l"), F.col("p"), F.col("t")).alias("v"), "want").collect()
    assert all(r.v == r.want for r in got)


def test_interval_bands_and_proximity(spark):
    df = spark.createDataFrame([(66.0, 10.0), (84.0, 10.0), (66.2, 0.0)], "welfare_risk_score double, q double")
    half = spark.createDataFrame([(10.0,)], "half_width double")
    rows = analytics.with_proximity(analytics.with_certainty(scoring.with_interval(df, half))).collect()
    assert rows[0].bands_plausible == ["Moderate", "High"] and rows[0].band_certainty == "borderline"
    assert rows[1].band_certainty == "certain" and not rows[1].barely_over_cutoff
    assert rows[2].barely_over_cutoff


def test_quantile_rank(spark):
    assert one(spark, scoring.quantile_rank(F.lit(768))) == 693
    assert one(spark, scoring.quantile_rank(F.lit(3))) == 3


def test_answer_strain(spark):
    assert one(spark, analytics.answer_strain(F.lit(1), F.lit(False))) == 25.0
    assert one(spark, analytics.answer_strain(F.lit(1), F.lit(True))) == 75.0
    assert one(spark, analytics.answer_strain(F.lit(9), F.lit(False))) == 100.0


def test_adjustments_refused(spark):
    df = spark.createDataFrame(
        [(P.SIGNALS[0], 50.0, None), (P.VOICE_SIGNAL, 50.0, "not adjustable"), (P.SIGNALS[0], 101.0, "out of range"),
         (P.SIGNALS[0], None, "not a number")], "signal_name string, new_value double, want string")
    assert all(r.p == r.want for r in df.select(explain.adjustment_problem().alias("p"), "want").collect())


def test_weights_are_whole():
    assert sum(P.ACOUSTIC_WEIGHTS.values()) == pytest.approx(1.0)
    assert set(P.ACOUSTIC_WEIGHTS) == set(P.ACOUSTIC_FEATURES) == set(P.ACOUSTIC_DIRECTIONS)
    assert set(signals.REGISTRY) == set(P.SIGNALS)
