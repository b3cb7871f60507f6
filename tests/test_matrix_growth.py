"""What the feature matrix moves between tasks, and which stages are written once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from fettle import policy as P
from fettle.operators import features
from fettle.plans.workload import Workload

SNAPS = [date(2026, 6, 1), date(2026, 7, 1), date(2026, 8, 1)]
DUTY = ("pseudonym_id string, month_start date, total_duty_hours double, weekly_offs_availed int, weekly_offs_entitled int, "
        "daily_duty_hours_sd double, night_shifts int")


def test_duty_months_meet_by_person_before_they_are_offered(spark):
    """F16 F18: one narrow shuffle of the months, none of half-done aggregates per snapshot."""
    rows = [(f"a{i % 3}", date(2026, 1 + i % 7, 1), 150.0 + i, 2, 4, 0.5, 1) for i in range(21)]
    found = features.duty_aggregates(spark.createDataFrame(rows, DUTY), SNAPS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "snapshot_date" not in moved[0]
    assert plan.index("Generate") < plan.index("Exchange")  # printed from the top: offered after the shuffle
    assert {(r["pseudonym_id"], r["snapshot_date"]) for r in found.collect()} == {(f"a{i}", s) for i in range(3) for s in SNAPS}
    assert all(r["now_hours"] is not None for r in found.collect())


def test_training_is_offered_only_where_a_window_holds_it(spark):
    """F16 F18: no row for a snapshot without training; the features still read 0 there."""
    rows = [("a", date(2025, 1, 1), 7.0), ("a", date(2026, 6, 20), 3.0), ("a", date(2026, 6, 25), None), ("b", None, 5.0),
            ("b", date(2026, 3, 3), 2.0), ("b", date(2026, 3, 4), 4.0), ("c", date(2026, 8, 2), 9.0)]
    training = spark.createDataFrame(rows, "pseudonym_id string, end_date date, training_hours double")
    found = features.training_aggregates(training, SNAPS)
    got = {(r["pseudonym_id"], r["snapshot_date"]): (r["training_hours_7d"], r["training_hours_30d"], r["training_hours_90d"])
           for r in found.collect()}
    assert got == {("a", SNAPS[1]): (0.0, 3.0, 3.0), ("a", SNAPS[2]): (0.0, 0.0, 3.0), ("b", SNAPS[0]): (0.0, 0.0, 4.0)}
    roster = spark.createDataFrame(
        [(p, "U001", "field", True, False, date(2025, 1, 1)) for p in "abc"],
        "pseudonym_id string, unit_id string, posting_type string, is_jawan_rank boolean, family_separated boolean, "
        "current_posting_start_date date")
    wide = features.feature_matrix({"personnel": roster, "training_records": training}, SNAPS)
    hours = {(r[0], r[1]): (r[2], r[3]) for r in wide.select(
        "pseudonym_id", "snapshot_date", "training_hours_last_3months", "training_hours_30d").collect()}
    assert hours == {(p, s): (got.get((p, s), (0.0,) * 3)[2], got.get((p, s), (0.0,) * 3)[1]) for p in "abc" for s in SNAPS}


def test_scored_rows_are_written_once(spark):
    """F16: the queries behind a case read the scored rows, they do not derive them again."""
    run = Workload(spark, "unused", b"k", settled=True)
    run.__dict__["matrix"] = spark.createDataFrame(
        [("a", SNAPS[0], "U001", "field", True, *[10.0] * 9, 50.0), ("a", SNAPS[1], "U001", "field", True, *[10.0] * 9, None)],
        "pseudonym_id string, snapshot_date date, unit_id string, posting_type string, is_jawan_rank boolean, "
        + ", ".join(f"{s} double" for s in P.SIGNALS) + ", welfare_risk_score double")
    run.__dict__["voice"] = spark.createDataFrame([], "pseudonym_id string, snapshot_date date, voice_stress_signal double")
    plan = run.scored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FileScan parquet" in plan
    assert run.scored.count() == 2 and run.scored.filter(F.col("risk_level").isNull()).count() == 1
