"""Ingest, quality, cleaning, privacy, units, recommendations and alerts on tiny tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from fettle import policy as P
from fettle import texts
from fettle.operators import alerts, analytics, booking, cleaning, explain, logs, privacy, quality, recommend, results, units
from fettle.sources import ingest, library, schemas, sinks


def test_mixed_dates_and_booleans(spark):
    df = spark.createDataFrame(
        [("2026-01-02",), ("02/01/2026",), ("Jan 2, 2026",), ("20260102",), ("2026-13-40",), ("soon",), (None,)], "t string")
    got = [r.d for r in df.select(ingest.parse_date(F.col("t")).alias("d")).collect()]
    assert got == [date(2026, 1, 2)] * 4 + [None] * 3
    b = spark.createDataFrame([(" Yes",), ("0",), (None,)], "t string")
    assert [r.v for r in b.select(ingest.parse_boolean(F.col("t")).alias("v")).collect()] == [True, False, False]
    n = spark.createDataFrame([("NaN",), ("3.5",), ("3",), ("x",)], "t string")
    assert [r.v for r in n.select(ingest.typed(F.col("t"), "integer").alias("v")).collect()] == [None, None, 3, None]


def test_strict_load_refuses_and_lenient_reports(spark, tmp_path):
    (tmp_path / "leave_records.csv").write_text(
        "leave_id,personnel_id,leave_type,start_date,end_date,days_availed\n"
        "L1,P1,earned,2026-01-01,2026-01-05,4\nL1,P1,earned,2026-01-05,2026-01-01,-4\nL2,,x,soon,2026-01-01,2\n")
    with pytest.raises(ingest.InvalidTables):
        ingest.load_tables(spark, str(tmp_path), ["leave_records"])
    tables, report = ingest.load_tables(spark, str(tmp_path), ["leave_records"], strict=False)
    row = report.first()
    assert row.row_count == 3 and not row.is_valid
    for part in ("duplicate_key:leave_id:1", "negative:days_availed:1", "inverted:end_date:1", "unreadable:start_date:1",
                 "empty:personnel_id:1"):
        assert part in row.findings
    assert tables["leave_records"].schema["start_date"].dataType.typeName() == "date"


def test_unknown_columns_warn_and_missing_ones_fail(spark):
    df = spark.createDataFrame([("U1", "x")], "unit_id string, stray string")
    rows = {(r.severity, r.column_name) for r in quality.column_set_report(df, schemas.TABLES["unit_capacity"]).collect()}
    assert ("warning", "stray") in rows and ("error", "on_strength") in rows


def test_schema_document_lists_every_table():
    import json

    doc = json.loads(schemas.schema_document())
    assert len(doc) == 9 and doc["duty_logs"]["primary_key"] == ["personnel_id", "month_start"]
    field = schemas.TABLES["personnel"].struct()["rank"]
    assert field.metadata["allowed_values"] == list(P.RANKS)


def test_truncated_checkin_line_costs_only_itself(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(
        '{"pseudonym_id": "a", "submitted_at": "1", "answers": [{"question_id": "WRK01", "value": 3}]}\n{"pseudonym_id": "b", "ans')
    assert [r.pseudonym_id for r in ingest.read_checkins(spark, str(tmp_path)).collect()] == ["a"]


def test_clean_leave_per_row(spark):
    df = spark.createDataFrame(
        [("L1", "p", date(2026, 1, 1), date(2026, 1, 11), 10.0), ("L2", "p", date(2026, 1, 1), date(2026, 1, 11), 30.0),
         ("L3", "p", date(2026, 1, 5), date(2026, 1, 1), 1.0), ("L4", "p", date(2025, 1, 1), date(2026, 1, 1), 1.0),
         (None, "p", date(2026, 1, 1), date(2026, 1, 2), 1.0)],
        "leave_id string, personnel_id string, start_date date, end_date date, days_availed double")
    got = {r.leave_id: r.days_availed for r in cleaning.clean_leave(df).collect()}
    assert got == {"L1": 10.0, "L2": 10.0, "L4": 100.0}
    log = {(r.action, r.detail): r.affected for r in cleaning.cleaning_log({"leave_records": df}).collect()}
    assert log[("drop", "null key")] == 1 and log[("recompute", "days_availed")] == 2 and log[("cap", "days_availed")] == 1


def test_identifier_may_not_cross(spark):
    df = spark.createDataFrame([("P00001", "n", 1)], "personnel_id string, name string, x int")
    out = privacy.pseudonymise(df, b"k")
    assert set(out.columns) == {"pseudonym_id", "x"}
    with pytest.raises(privacy.IndividualDataLeak):
        privacy.pseudonymise_all({"t": spark.createDataFrame([("n",)], "name string")}, b"k")


def test_leak_guard_walks_nested_schemas(spark):
    nested = spark.createDataFrame([("U1", [{"risk_level": "High"}])], "unit_id string, d array<struct<risk_level:string>>")
    with pytest.raises(privacy.IndividualDataLeak):
        privacy.assert_unit_level(nested)
    safe = spark.createDataFrame([("U1", 1.0)], "unit_id string, mean_risk double")
    assert privacy.assert_unit_level(safe) is safe
    with pytest.raises(privacy.IndividualDataLeak):
        privacy.assert_absent(spark.createDataFrame([("x",)], "benign_profile string"))


def test_namespaces(spark):
    df = spark.createDataFrame([("PSN" + "0" * 16, "pseudonym"), ("P00123", "service_identity"), ("P123", "unknown"), (" ", "blank")],
                               "s string, want string")
    assert all(r.k == r.want for r in df.select(privacy.namespace(F.col("s")).alias("k"), "want").collect())


def conditions(spark, *met):
    rows = [("U1", date(2026, 1 + i, 1), 12, 60.0, 40.0, 0.8, m) for i, m in enumerate(met)]
    return spark.createDataFrame(rows, (
        "unit_id string, snapshot_date date, personnel_count long, mean_demand double, mean_recovery_deficit double, "
        "staffing_ratio double, conditions_met boolean"))


def test_near_miss_runs(spark):
    found = units.detect(conditions(spark, False, True, True)).first()
    assert found.consecutive_snapshots == 2 and found.first_detected == date(2026, 2, 1)
    assert "80% of sanctioned" in found.summary
    assert units.detect(conditions(spark, True, True, False)).isEmpty()
    assert units.detect(conditions(spark, True, False, True)).isEmpty()


def test_closest_units_order(spark):
    rows = [("A", 2, 20, 5.0, 1.0, -0.05), ("B", 2, 20, -0.3, 1.0, 0.1), ("C", 3, 20, 1.0, 1.0, 0.1), ("D", 0, 20, -9.0, -9.0, None)]
    df = spark.createDataFrame(rows, (
        "unit_id string, thresholds_crossed int, personnel_count int, margin_demand double, margin_recovery_deficit double, "
        "margin_staffing double"))
    got = [(r.unit_id, r.shortfall_condition) for r in units.closest(df).collect()]
    assert got == [("C", None), ("A", "staffing"), ("B", "demand")]


def cases(spark, *rows):
    return spark.createDataFrame(list(rows), (
        "pseudonym_id string, risk_level string, risk_attribution string, confidence_level string, top_signals array<string>"))


def test_recommendation_rules(spark):
    lib = library.interventions(spark)
    df = cases(spark, ("a", "High", "Systemic", "Low", [P.SIGNALS[0]]), ("b", "Normal", "Individual", "High", list(P.SIGNALS)),
               ("c", "Moderate", "Individual", "High", ["family_separation_signal"]))
    got = recommend.recommend(df, lib).collect()
    a = [r.id for r in sorted(got, key=lambda r: r.rank) if r.pseudonym_id == "a"]
    assert a == ["workload_review", "commander_escalation", "peer_support_referral"]
    assert all(r.low_confidence for r in got if r.pseudonym_id == "a")
    assert not [r for r in got if r.pseudonym_id == "b"]
    assert [r.id for r in got if r.pseudonym_id == "c"] == ["family_contact_support"]


def test_every_signal_is_covered(spark):
    names = spark.createDataFrame([(s,) for s in P.SIGNALS], "signal_name string")
    assert recommend.uncovered_signals(names, library.interventions(spark), library.questions(spark)).filter(
        "not has_intervention or not has_question").isEmpty()


def alert_cases(spark, *rows):
    return spark.createDataFrame(list(rows), (
        "pseudonym_id string, risk_level string, welfare_risk_score double, trend_direction string, is_persistent boolean, "
        "persistence_snapshots int, confidence_level string, band_certainty string, snapshot_date date"))


def test_alert_rules(spark):
    d = date(2026, 9, 1)
    df = alert_cases(
        spark, ("a", "High", 70.0, "Rising", True, 4, "High", "borderline", d), ("b", "High", 70.0, "Rising", True, 4, "Low", "certain", d),
        ("c", "Moderate", 50.0, "Rising", True, 3, "Medium", "certain", d), ("d", "Moderate", 50.0, "Stable", True, 3, "High", "certain", d),
        ("e", "Normal", 10.0, "Rising", True, 3, "High", "certain", d), ("f", "High", 70.0, "Stable", False, 1, None, "certain", d))
    got = {}
    for r in alerts.case_alerts(df).collect():
        got.setdefault(r.pseudonym_id, set()).add(r.rule_id)
        if r.rule_id == "officer_alert_high":
            assert texts.BORDERLINE_NOTE in r.body
    assert got == {
        "a": {"personal_notification", "officer_alert_high", "officer_alert_rising_high"}, "b": {"personal_notification"},
        "c": {"personal_notification", "officer_alert_persistent"}, "d": {"personal_notification"}, "f": {"personal_notification"}}


def test_attribution_rules(spark):
    scored = spark.createDataFrame(
        [("a", "S", 70.0), ("b", "S", 60.0), ("c", "Q", 60.0), ("d", "Q", 45.0), ("e", "Z", 99.0)],
        "pseudonym_id string, unit_id string, welfare_risk_score double")
    stats = spark.createDataFrame([("S", 58.0, True), ("Q", 44.0, False), ("Z", None, False)],
                                  "unit_id string, mean_risk double, is_systemically_strained boolean")
    got = {r.pseudonym_id: r.risk_attribution for r in analytics.with_attribution(scored, stats).collect()}
    assert got == {"a": "Mixed", "b": "Systemic", "c": "Individual", "d": "Systemic", "e": "Individual"}


def test_small_unit_shows_only_a_reason(spark):
    rows = [(f"p{i}", date(2026, 9, 1), "big" if i < 12 else "tiny", float(i * 5), "Moderate") for i in range(15)]
    scored = spark.createDataFrame(rows, "pseudonym_id string, snapshot_date date, unit_id string, welfare_risk_score double, risk_level string")
    stats = analytics.unit_aggregates(scored)
    got = {r.unit_id: r for r in stats.collect()}
    assert got["big"].median_risk == 27.5 and not got["big"].is_suppressed
    assert got["tiny"].mean_risk is None and got["tiny"].is_suppressed
    pressed = spark.createDataFrame([], "unit_id string, snapshot_date date, personnel_count long, thresholds_crossed int")
    none = spark.createDataFrame([], "unit_id string")
    shown = {r.unit_id: r for r in results.unit_overview(results.unit_payload(stats, pressed, none)).collect()}
    assert shown["tiny"].personnel_count is None and shown["tiny"].suppression_reason


def test_priority_and_cap(spark):
    df = spark.createDataFrame(
        [("a", 66.0, "Rising", "High"), ("b", 70.0, "Improving", "High"), ("c", 70.0, "Stable", "Low")],
        "pseudonym_id string, welfare_risk_score double, trend_direction string, confidence_level string")
    got = {r.pseudonym_id: r.p for r in df.select("pseudonym_id", results.priority_score().alias("p")).collect()}
    assert got == {"a": 74.0, "b": 64.0, "c": 65.0}


def test_answers_rejected_for_the_right_reason(spark):
    q = library.questions(spark)
    rows = [(1, "WRK01", "3", None), (2, "WRK01", "5", None), (3, "GEN03", None, "words"), (4, "GEN03", "2", None),
            (5, "NOPE", "1", None), (6, "WRK01", "3", None), (6, "WRK01", "2", None), (7, "WRK01", "1.5", None), (8, "WRK01", None, "x"),
            (9, "GEN03", None, "x" * 2001)]
    got = {}
    for r in analytics.validate_answers(spark.createDataFrame(rows, "submission_id long, question_id string, value string, text string"), q).collect():
        got[r.submission_id] = (r.answer_problem, r.submission_problem)
    assert got[1] == (None, None) and got[3] == (None, None)
    assert got[2] == ("off the scale", "bad answer") and got[4] == ("needs text", "bad answer")
    assert got[5] == ("unknown question", "bad answer") and got[6] == (None, "answered twice")
    assert got[7][0] == "not a whole number" and got[8][0] == "needs a number" and got[9][0] == "text too long"


def test_access_summary_excludes_own_reads(spark):
    df = spark.createDataFrame(
        [("p", 1, "personnel", "granted"), ("p", 2, "welfare_officer", "granted"), ("p", 3, "welfare_officer", "refused"), ("p", 4, "commander", "granted")],
        "pseudonym_id string, at int, actor_role string, outcome string")
    r = logs.access_summary(df).first()
    assert (r.total_granted, r.total_refused) == (3, 1)
    assert r.by_role == {"welfare_officer": 1, "commander": 1} and (r.first_accessed_at, r.last_accessed_at) == (2, 4)


def test_visit_status(spark):
    appts = spark.createDataFrame([("APT-1", "p", "d", "s1"), ("APT-2", "p", "d", "s2"), ("APT-3", "p", "d", "s3")],
                                  "appointment_id string, personnel_id string, doctor_id string, slot_id string")
    cancels = spark.createDataFrame([("APT-1", "p", 5), ("APT-2", "other", 5), ("APT-3", "p", 5)],
                                    "appointment_id string, personnel_id string, cancelled_at int")
    notes = spark.createDataFrame([("APT-3", 4)], "appointment_id string, issued_at int")
    got = {r.appointment_id: r.status for r in booking.with_status(appts, cancels, notes).collect()}
    assert got == {"APT-1": "cancelled", "APT-2": "booked", "APT-3": "completed"}


def test_medians_odd_even_and_missing(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (10.04, None), (7.0, None)], "a double, b double")
    got = {r.signal_name: r.median for r in explain.population_medians(df, ["a", "b"]).collect()}
    assert got == {"a": 5.0, "b": 0.0}


def test_results_need_all_seven(spark, tmp_path):
    with pytest.raises(KeyError):
        sinks.write_results({"cases": spark.range(1)}, str(tmp_path))


def test_a_run_starts_from_valid_tables_only(spark, tmp_path):
    from fettle.operators import quality
    from fettle.plans.workload import RAW_TABLES, Workload
    from fettle.sources import ingest, sinks
    from fettle.sources.schemas import TABLES

    given = Workload(spark, "/root/testdata/sf0.001", b"k", settled=True)
    folder = str(tmp_path / "bad")
    for name, frame in given.raw.items():
        sinks.write_csv(frame, f"{folder}/{name}.csv")
    with pytest.raises(ingest.InvalidTables):
        Workload.loaded(spark, folder, b"k")
    lenient = Workload.loaded(spark, folder, b"k", strict=False)
    assert {r["table_name"] for r in lenient.reports.collect()} == set(RAW_TABLES)
    assert lenient.clean["leave_records"].count() == given.clean["leave_records"].count()
    # complete and consistent tables pass, and the run derives the same features from them
    good = str(tmp_path / "good")
    for name, frame in given.raw.items():
        for c in TABLES[name].columns:
            if c.name not in frame.columns:
                frame = frame.withColumn(c.name, F.lit("hard_area" if c.kind == "string" else 1.0))
        if name in ("leave_records", "deployment_history"):
            frame = frame.filter("end_date IS NULL OR end_date >= start_date")
        sinks.write_csv(frame, f"{good}/{name}.csv")
    run = Workload.loaded(spark, good, b"k")
    assert run.features.count() == given.features.count()
    # a unit nobody knows is an error of the table that names it
    tables = {n: ingest.read_text_csv(spark, f"{good}/{n}.csv", ingest.header_of(spark, f"{good}/{n}.csv")) for n in ("unit_capacity", "personnel")}
    tables["personnel"] = tables["personnel"].withColumn("unit_id", F.lit("U999"))
    found = {r["table_name"]: r for r in quality.table_reports(tables, TABLES).collect()}
    assert found["unit_capacity"]["is_valid"] and found["personnel"]["error_count"] == 1 and "orphan:unit_id:1" in found["personnel"]["findings"]
