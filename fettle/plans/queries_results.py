"""Unit findings, recommendations, alerts, result queries, logs, booking and ratings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle import texts
from fettle.functions.scales import code
from fettle.operators import alerts, booking, logs, ratings as rate, recommend, results, units
from fettle.plans.catalog import query
from fettle.plans.oracle_views import SIG, VIEWS, values
from fettle.plans.queries_data import ratings

UNIT = "unit_id snapshot_date personnel_count# mean_demand* mean_recovery_deficit* staffing_ratio* "


# --- U ------------------------------------------------------------------------
@query("unit_conditions_u01", UNIT + "conditions_met", "SELECT * FROM v_cond")
def u01(w):
    return w.conditions


@query("near_miss_findings_u02", "unit_id first_detected last_detected consecutive_snapshots# mean_demand* "
       "mean_recovery_deficit* staffing_ratio* personnel_count#", "SELECT * FROM v_find")
def u02(w):
    return w.findings


@query("finding_sentence_u03", "unit_id summary", "SELECT * FROM v_find_text")
def u03(w):
    return w.findings


@query("near_miss_pressure_u04", UNIT + "thresholds_crossed# margin_demand* margin_recovery_deficit* margin_staffing*",
       "SELECT * FROM v_press0")
def u04(w):
    return units.pressure(w.conditions)


@query("closest_units_u05", "unit_id thresholds_crossed# personnel_count# shortfall_condition shortfall_amount*",
       "SELECT * FROM v_close")
def u05(w):
    return units.closest(w.pressure)


# --- K ------------------------------------------------------------------------
REC = "pseudonym_id rank# id title description action_owner recipient priority# low_confidence"


@query("recommendations_k01", REC, "SELECT * FROM v_rec")
def k01(w):
    return w.recommendations


VIEWS["v_rec_all"] = """
SELECT * FROM (
  SELECT c.pseudonym_id, l.id, l.title, l.description, l.action_owner, l.recipient, l.priority,
         c.confidence_level = 'Low' AS low_confidence,
         row_number() OVER (PARTITION BY c.pseudonym_id ORDER BY l.priority, l.position) AS rank
  FROM v_cases c JOIN v_library l ON list_contains(l.levels, c.risk_level)
    AND list_contains(l.attributions, c.risk_attribution)
    AND EXISTS (SELECT 1 FROM v_latest_long t WHERE t.pseudonym_id = c.pseudonym_id AND t.signal_value > 0
                AND list_contains(l.signals, t.signal_name))
  WHERE c.risk_level <> 'Normal') WHERE rank <= 3"""


@query("recommendations_without_factors_k02", REC, "SELECT * FROM v_rec_all")
def k02(w):
    named = recommend.top_signals(F.lit(None).cast("array<string>"))
    return recommend.recommend(w.cases.withColumn("top_signals", named), w.interventions)


@query("signal_coverage_k03", "signal_name people# has_intervention has_question", """
SELECT signal_name, count(*) AS people,
       signal_name IN (SELECT unnest(signals) FROM v_library) AS has_intervention,
       signal_name IN (SELECT signal_name FROM v_questions) AS has_question
FROM v_latest_long WHERE signal_value > 0 GROUP BY signal_name""")
def k03(w):
    used = w.latest_signals.unpivot(["pseudonym_id"], list(P.SIGNALS), "signal_name", "v").filter(
        F.col("v") > 0).groupBy("signal_name").agg(F.count(F.lit(1)).alias("people"))
    return recommend.uncovered_signals(used, w.interventions, w.questions)


ALERT = "alert_id rule_id recipient_role priority pseudonym_id snapshot_date"


def text_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BODIES = {
    "personal_notification": text_sql(texts.PERSONAL_BODY),
    "officer_alert_high": f"""printf({text_sql(texts.HIGH_BODY)}, c.welfare_risk_score)
        || CASE WHEN c.band_certainty = 'borderline' THEN {text_sql(' ' + texts.BORDERLINE_NOTE)} ELSE '' END""",
    "officer_alert_persistent": f"""printf({text_sql(texts.PERSISTENT_BODY)}, c.persistence_snapshots,
        CASE WHEN c.trend_direction = 'Rising' THEN ' and is rising' ELSE '' END)""",
    "officer_alert_rising_high": f"printf({text_sql(texts.RISING_BODY)}, c.welfare_risk_score)",
    "commander_near_miss": f"replace({text_sql(texts.UNIT_BODY)}, '%s', f.summary)",
}


def _rule(key: str, rule: str, build) -> None:
    @query(key, ALERT + " title body", f"""
SELECT a.*, {alerts_title(rule)} AS title, {BODIES[rule]} AS body FROM v_alerts a
LEFT JOIN v_cases c ON c.pseudonym_id = a.pseudonym_id LEFT JOIN v_find_text f ON f.unit_id = a.unit_id
WHERE rule_id = '{rule}'""")
    def plan(w):
        return build(w)


def alerts_title(rule: str) -> str:
    title = {"personal_notification": texts.PERSONAL_TITLE, "officer_alert_high": texts.HIGH_TITLE,
             "officer_alert_persistent": texts.PERSISTENT_TITLE,
             "officer_alert_rising_high": texts.RISING_TITLE}.get(rule)
    return f"'{title}'" if title else "'Unit welfare near-miss: ' || a.unit_id"


_rule("personal_notification_k04", "personal_notification", lambda w: alerts.personal_notifications(w.cases))
_rule("officer_alert_high_k05", "officer_alert_high", lambda w: alerts.high_alerts(w.cases))
_rule("officer_alert_persistent_k06", "officer_alert_persistent", lambda w: alerts.persistent_alerts(w.cases))
_rule("officer_alert_rising_k07", "officer_alert_rising_high", lambda w: alerts.rising_high_alerts(w.cases))
_rule("unit_alert_k08", "commander_near_miss", lambda w: alerts.unit_alerts(w.findings))


@query("alert_batch_k09", "feed recipient_role rule_id alert_id pseudonym_id unit_id", """
SELECT *, CASE recipient_role WHEN 'personnel' THEN 'by_person' WHEN 'welfare_officer' THEN 'officer_by_person'
  ELSE 'by_role_only' END AS feed FROM v_alerts""")
def k09(w):
    return alerts.feeds(w.alerts)


@query("alert_totals_k09", "recipient_role rule_id feed n#", """
SELECT recipient_role, rule_id, CASE recipient_role WHEN 'personnel' THEN 'by_person' WHEN 'welfare_officer'
  THEN 'officer_by_person' ELSE 'by_role_only' END AS feed, count(*) AS n FROM v_alerts GROUP BY ALL""")
def k09_totals(w):
    return alerts.totals(w.alerts)


# --- Q ------------------------------------------------------------------------
VIEWS["v_queue"] = """
SELECT *, welfare_risk_score + CASE trend_direction WHEN 'Rising' THEN 8e0 WHEN 'Improving' THEN -6e0 ELSE 0e0 END
  - CASE WHEN confidence_level = 'Low' THEN 5e0 ELSE 0e0 END AS priority FROM v_cases WHERE is_officer_visible"""


@query("officer_queue_q01", "pseudonym_id unit_id posting_type risk_level welfare_risk_score* band_certainty "
       "barely_over_cutoff trend_direction persistence_snapshots# confidence_level risk_attribution unit_near_miss "
       "priority*", "SELECT * FROM v_queue")
def q01(w):
    return results.queue(w.cases)


SHOWN = "(SELECT * FROM v_queue ORDER BY priority DESC, welfare_risk_score DESC, pseudonym_id LIMIT 60)"


@query("capped_queue_q02", "pseudonym_id priority* total_eligible# population# visible_count# borderline_count# held_back_count#", f"""
SELECT pseudonym_id, priority, (SELECT count(*) FROM v_queue) AS total_eligible, (SELECT count(*) FROM v_cases) AS population,
       count(*) OVER () AS visible_count, count(*) FILTER (band_certainty = 'borderline') OVER () AS borderline_count,
       (SELECT count(*) FROM v_queue) - count(*) OVER () AS held_back_count FROM {SHOWN}""")
def q02(w):
    """The shown list beside its totals."""
    return results.capped_queue(w.cases).select("pseudonym_id", "priority").crossJoin(F.broadcast(results.queue_counts(w.cases)))


@query("case_detail_q03", "pseudonym_id unit_id welfare_risk_score* risk_level trend_direction factor_names "
       "history_points# action_count# last_action_at divergence_count# alert_count# unit_mean_risk* unit_people# "
       "unit_strained unit_near_miss_run#", """
SELECT c.pseudonym_id, c.unit_id, c.welfare_risk_score, c.risk_level, c.trend_direction,
       (SELECT string_agg(signal_name, ',' ORDER BY position) FROM v_factors f WHERE f.pseudonym_id = c.pseudonym_id)
         AS factor_names,
       (SELECT count(*) FROM v_scored s WHERE s.pseudonym_id = c.pseudonym_id) AS history_points,
       (SELECT count(*) FROM v_actions a WHERE a.pseudonym_id = c.pseudonym_id) AS action_count,
       (SELECT max("at") FROM v_actions a WHERE a.pseudonym_id = c.pseudonym_id) AS last_action_at,
       (SELECT count(*) FROM v_compared d WHERE d.pseudonym_id = c.pseudonym_id AND classification <> 'aligned')
         AS divergence_count,
       (SELECT count(*) FROM v_alerts a WHERE a.pseudonym_id = c.pseudonym_id AND recipient_role = 'welfare_officer')
         AS alert_count, u.mean_risk AS unit_mean_risk, u.personnel_count AS unit_people,
       u.is_systemically_strained AS unit_strained, f.consecutive_snapshots AS unit_near_miss_run
FROM v_cases c LEFT JOIN v_units u USING (unit_id) LEFT JOIN v_find f USING (unit_id) WHERE c.is_officer_visible""")
def q03(w):
    from fettle.operators import analytics
    return results.case_detail(w.cases, w.factors, w.unit_stats, w.findings, w.scored, w.actions,
                               analytics.divergences(w.compared), w.alerts)


@query("unit_overview_q04", "unit_id is_suppressed suppression_reason personnel_count# mean_risk* median_risk* "
       "elevated_share* high_share* is_systemically_strained is_near_miss thresholds_crossed#", """
SELECT u.unit_id, is_suppressed, CASE WHEN is_suppressed THEN 'Unit has fewer than 10 personnel; aggregates are withheld '
         || 'so individuals cannot be identified from them.' END AS suppression_reason,
       CASE WHEN NOT is_suppressed THEN u.personnel_count END AS personnel_count, mean_risk, median_risk, elevated_share,
       high_share, CASE WHEN NOT is_suppressed THEN is_systemically_strained END AS is_systemically_strained,
       CASE WHEN NOT is_suppressed THEN f.unit_id IS NOT NULL END AS is_near_miss,
       CASE WHEN NOT is_suppressed THEN thresholds_crossed END AS thresholds_crossed
FROM v_units u LEFT JOIN v_press p ON p.unit_id = u.unit_id LEFT JOIN v_find f ON f.unit_id = u.unit_id""")
def q04(w):
    return results.unit_overview(results.unit_payload(w.unit_stats, w.pressure, w.findings))


@query("near_miss_view_q05", "kind unit_id consecutive_snapshots# thresholds_crossed# shortfall_condition "
       "shortfall_amount* personnel_count#", """
SELECT 'finding' AS kind, unit_id, consecutive_snapshots, NULL AS thresholds_crossed, NULL AS shortfall_condition,
       NULL AS shortfall_amount, personnel_count FROM v_find UNION ALL
SELECT 'closest', unit_id, NULL, thresholds_crossed, shortfall_condition, shortfall_amount, personnel_count FROM v_close""")
def q05(w):
    return results.near_miss_view(w.findings, units.closest(w.pressure))


@query("personal_summary_q06", "pseudonym_id welfare_risk_score* risk_level trend_direction confidence_level "
       "is_officer_visible factor_names explanation_available answered_signals# diverging_signals#", """
SELECT c.pseudonym_id, c.welfare_risk_score, c.risk_level, c.trend_direction, c.confidence_level, c.is_officer_visible,
       f.names AS factor_names, f.names IS NOT NULL AS explanation_available, coalesce(d.n, 0) AS answered_signals,
       coalesce(d.m, 0) AS diverging_signals
FROM v_cases c LEFT JOIN (SELECT pseudonym_id, string_agg(signal_name, ',' ORDER BY position) AS names FROM v_factors
                          GROUP BY pseudonym_id) f USING (pseudonym_id)
LEFT JOIN (SELECT pseudonym_id, count(*) AS n, count(*) FILTER (classification <> 'aligned') AS m FROM v_compared
           GROUP BY pseudonym_id) d USING (pseudonym_id)""")
def q06(w):
    return results.personal_summary(w.cases, w.factors, w.compared)


@query("score_history_q06", "pseudonym_id points", """
SELECT pseudonym_id, string_agg(strftime(snapshot_date, '%Y-%m-%d') || ':' || risk_level, ',' ORDER BY snapshot_date)
  AS points FROM v_scored GROUP BY pseudonym_id""")
def q06b(w):
    joined = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["snapshot_date"], p["level"])), ",")
    return results.history(w.classified).withColumn("points", joined)


@query("tailored_questions_q07", "pseudonym_id rank# question_id tailored_to text", """
SELECT * FROM (SELECT f.pseudonym_id, q.question_id, f.signal_name AS tailored_to, q.text,
  row_number() OVER (PARTITION BY f.pseudonym_id ORDER BY f.position, q.position) AS rank
FROM v_factors f JOIN v_questions q ON q.group_signal = f.signal_name) WHERE rank <= 3""")
def q07(w):
    return results.tailored_questions(w.factors, w.questions)


@query("checkin_history_q08", "pseudonym_id submission_id# submitted_at question_id value# text_asked", """
SELECT c.pseudonym_id, c.submission_id, c.submitted_at, c.question_id, c.value, q.text AS text_asked
FROM v_checkins c JOIN v_questions q USING (question_id)""")
def q08(w):
    return results.checkin_history(w.checkins, w.questions)


@query("own_notifications_q09", ALERT, "SELECT * FROM v_alerts WHERE recipient_role = 'personnel'")
def q09(w):
    return results.notifications(w.alerts)


@query("run_metadata_q10", "population# latest_snapshot band_normal# band_moderate# band_high# certain# borderline# "
       "officer_visible_count# snapshot_count# voice_coverage* risk_moderate_min* risk_high_min* min_unit_size# "
       + " ".join(f"median_{s}*" for s in SIG), """
SELECT count(*) AS population, max(snapshot_date) AS latest_snapshot,
       count(*) FILTER (risk_level = 'Normal') AS band_normal, count(*) FILTER (risk_level = 'Moderate') AS band_moderate,
       count(*) FILTER (risk_level = 'High') AS band_high, count(*) FILTER (band_certainty = 'certain') AS certain,
       count(*) FILTER (band_certainty = 'borderline') AS borderline,
       count(*) FILTER (is_officer_visible) AS officer_visible_count, (SELECT count(DISTINCT snapshot_date) FROM v_scored) AS snapshot_count,
       (SELECT avg(voice_signal_present) FROM v_scored) AS voice_coverage,
       40e0 AS risk_moderate_min, 65e0 AS risk_high_min, 10 AS min_unit_size, """ + ", ".join(
    f"(SELECT median FROM v_medians WHERE signal_name = '{s}') AS median_{s}" for s in SIG) + " FROM v_cases")
def q10(w):
    return results.run_metadata(w.classified, w.cases, w.medians)


@query("unit_payload_q11", "unit_id is_suppressed personnel_count# mean_risk* thresholds_crossed# margin_demand* "
       "margin_recovery_deficit* margin_staffing* is_near_miss", """
SELECT u.unit_id, is_suppressed, u.personnel_count, mean_risk, thresholds_crossed, margin_demand,
       margin_recovery_deficit, margin_staffing, f.unit_id IS NOT NULL AS is_near_miss
FROM v_units u LEFT JOIN v_press p ON p.unit_id = u.unit_id LEFT JOIN v_find f ON f.unit_id = u.unit_id""")
def q11(w):
    return results.unit_payload(w.unit_stats, w.pressure, w.findings)


@query("two_cases_per_band_q12", "pseudonym_id risk_level unit_id has_voice_signal", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY risk_level ORDER BY welfare_risk_score DESC, pseudonym_id) AS rn
FROM v_cases) WHERE rn <= 2""")
def q12(w):
    return results.sample_per_band(w.cases)


@query("assembled_cases_q13", "pseudonym_id unit_id posting_type snapshot_date score* level interval_low* interval_high* "
       "classification confidence* direction persistence# workload* unit_near_miss is_officer_visible factors# "
       "recommended#", """
SELECT c.pseudonym_id, c.unit_id, c.posting_type, c.snapshot_date, round_even(welfare_risk_score, 1) AS score,
       risk_level AS level, round_even(interval_low, 1) AS interval_low, round_even(interval_high, 1) AS interval_high,
       risk_attribution AS classification, round_even(confidence, 3) AS confidence, trend_direction AS direction,
       persistence_snapshots AS persistence, round_even(workload_deviation_signal, 1) AS workload, unit_near_miss,
       is_officer_visible, coalesce(f.n, 0) AS factors, coalesce(r.n, 0) AS recommended
FROM v_cases c LEFT JOIN (SELECT pseudonym_id, count(*) AS n FROM v_factors GROUP BY pseudonym_id) f USING (pseudonym_id)
LEFT JOIN (SELECT pseudonym_id, count(*) AS n FROM v_rec GROUP BY pseudonym_id) r USING (pseudonym_id)""")
def q13(w):
    doc = results.nested_cases(w.cases, w.factors, w.recommendations)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return doc.select(
        "pseudonym_id", "unit_id", "posting_type", "snapshot_date", "risk.score", "risk.level", "risk.interval_low",
        "risk.interval_high", "attribution.classification", F.col("confidence.score").alias("confidence"),
        "trend.direction", F.col("trend.persistence_snapshots").alias("persistence"),
        F.col("signals")[SIG[0]].alias("workload"), "unit_near_miss", "is_officer_visible",
        F.greatest(F.lit(0), size("contributing_factors")).alias("factors"),
        F.greatest(F.lit(0), size("recommendations")).alias("recommended"))


# --- L ------------------------------------------------------------------------
NOW = datetime(2024, 1, 31)
LATER = datetime(2025, 1, 21)


@query("access_decisions_appended_l01", "day n#", "SELECT CAST(\"at\" AS DATE) AS day, count(*) AS n FROM v_access GROUP BY 1")
def l01(w):
    from fettle.plans.queries_data import scratch
    path = scratch(w, "access")
    good, _ = logs.validated(w.access_log, logs.access_problem())
    logs.append_by_day(good, path)
    return w.spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("access_summary_l02", "pseudonym_id total_granted# total_refused# officer_reads# commander_reads# "
       "first_accessed_at last_accessed_at", """
SELECT pseudonym_id, count(*) FILTER (outcome = 'granted') AS total_granted,
       count(*) FILTER (outcome = 'refused') AS total_refused,
       count(*) FILTER (outcome = 'granted' AND actor_role = 'welfare_officer') AS officer_reads,
       count(*) FILTER (outcome = 'granted' AND actor_role = 'commander') AS commander_reads,
       min("at") FILTER (outcome = 'granted' AND actor_role <> 'personnel') AS first_accessed_at,
       max("at") FILTER (outcome = 'granted' AND actor_role <> 'personnel') AS last_accessed_at
FROM v_access GROUP BY pseudonym_id""")
def l02(w):
    reads = lambda role: F.coalesce(F.col("by_role")[role], F.lit(0))
    return logs.access_summary(w.access_log).withColumn("officer_reads", reads(P.ROLE_OFFICER)).withColumn(
        "commander_reads", reads(P.ROLE_COMMANDER))


@query("retention_purge_l03", "id# at outcome", """
SELECT id, "at", outcome FROM v_access WHERE "at" >= TIMESTAMP '2025-01-21' - INTERVAL 365 DAY""")
def l03(w):
    """What the purge of a later day leaves, at the policy's age."""
    return logs.retained(w.access_log, LATER)


@query("retention_counts_l03", "purged# kept#", """
SELECT count(*) FILTER ("at" < TIMESTAMP '2025-01-21' - INTERVAL 365 DAY) AS purged,
       count(*) FILTER ("at" >= TIMESTAMP '2025-01-21' - INTERVAL 365 DAY) AS kept FROM v_access""")
def l03_counts(w):
    return logs.purge_counts(w.access_log, LATER)


@query("log_row_counts_l04", "log n#", """
SELECT 'access' AS log, count(*) AS n FROM v_access UNION ALL SELECT 'actions', count(*) FROM v_actions""")
def l04(w):
    return logs.row_count(w.access_log).withColumn("log", F.lit("access")).unionByName(
        logs.row_count(w.actions).withColumn("log", F.lit("actions")))


@query("welfare_actions_checked_l05", "id# intervention_id status problem", "SELECT * FROM v_action_checked")
def l05(w):
    return logs.check_actions(w.action_log, w.interventions)


_meanings = values([(k, v) for k, v in P.STATUS_MEANINGS.items()], "status, status_meaning")


@query("actions_newest_first_l06", "id# at pseudonym_id intervention_id status status_meaning",
       f"SELECT * FROM v_actions JOIN ({_meanings}) USING (status)")
def l06(w):
    return logs.actions_for(w.actions)


@query("action_summary_l06", "pseudonym_id total# n_offered# n_arranged# n_completed# n_not_pursued# last_recorded_at", """
SELECT pseudonym_id, count(*) AS total, count(*) FILTER (status = 'offered') AS n_offered,
       count(*) FILTER (status = 'arranged') AS n_arranged, count(*) FILTER (status = 'completed') AS n_completed,
       count(*) FILTER (status = 'not_pursued') AS n_not_pursued, arg_max("at", id) AS last_recorded_at
FROM v_actions GROUP BY pseudonym_id""")
def l06b(w):
    return logs.action_summary(w.actions)


# --- B: doctors = suppliers, slots = parts, requests = line items ---------------
def b_changes(w) -> DataFrame:
    s = w.table("supplier").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).filter(
        (F.col("i") == 0) | (F.col("s_acctbal") < 2000))
    return s.select(
        code("DOC", F.col("s_suppkey"), 5).alias("doctor_id"),
        F.when(F.col("i") == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit(" MD"))).alias("name"),
        code("specialty_", F.col("s_nationkey") % 3 + F.col("i")).alias("specialty"),
        code("U", F.col("s_nationkey") % 5, 3).alias("unit_id"),
        code("doc-", F.col("s_suppkey")).alias("subject"), F.col("i").alias("changed_at"),
        F.col("i").alias("change_id"))


def b_offers(w) -> DataFrame:
    key = F.col("p_partkey")
    return w.table("part").select(
        code("SL", key).alias("slot_id"),
        code("DOC", F.col("p_size"), 5).alias("doctor_id"),
        F.expr("timestamp_ntz'2026-09-01' + make_interval(0, 0, 0, 0, cast(p_partkey % 40 as int))").alias("starts_at"),
        F.lit(15).alias("minutes"), key.alias("offered_at"))


def b_requests(w) -> DataFrame:
    c = F.col
    return w.table("lineitem").select(
        F.concat_ws("-", c("l_shipdate").cast("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .alias("request_id"),
        F.when(c("l_partkey") % 37 == 0, "SLX").otherwise(code("SL", c("l_partkey"))).alias("slot_id"),
        code("P", c("l_orderkey") % 1000, 5).alias("personnel_id"), c("l_shipdate").alias("requested_at"),
        F.repeat(F.lit("r"), (c("l_quantity") * 12).cast("int")).alias("reason"),
        (c("l_tax") > 0.04).alias("shared_context"), F.concat(F.lit("note "), c("l_returnflag")).alias("context_note"),
        "l_discount", "l_returnflag", "l_tax")


VIEWS["v_doctors"] = """
SELECT printf('DOC%05d', s_suppkey) AS doctor_id, s_name || CASE WHEN s_acctbal < 2000 THEN ' MD' ELSE '' END AS name,
       printf('specialty_%d', s_nationkey % 3 + CASE WHEN s_acctbal < 2000 THEN 1 ELSE 0 END) AS specialty,
       printf('U%03d', s_nationkey % 5) AS unit_id, printf('doc-%d', s_suppkey) AS subject FROM supplier"""
VIEWS["v_offers"] = """
SELECT printf('SL%d', p_partkey) AS slot_id, printf('DOC%05d', p_size) AS doctor_id,
       TIMESTAMP '2026-09-01' + to_hours(CAST(p_partkey % 40 AS INT)) AS starts_at, p_partkey FROM part"""
VIEWS["v_slots"] = """
SELECT * FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY doctor_id, starts_at) - 1
  AS conflicting_offers FROM v_offers WINDOW w AS (PARTITION BY doctor_id, starts_at ORDER BY p_partkey)) WHERE rn = 1"""
VIEWS["v_breq"] = """
SELECT CAST(l_shipdate AS DATE) || '-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
         AS request_id, CASE WHEN l_partkey % 37 = 0 THEN 'SLX' ELSE 'SL' || l_partkey END AS slot_id,
       printf('P%05d', l_orderkey % 1000) AS personnel_id, l_shipdate AS requested_at, l_tax > 0.04 AS shared_context,
       'note ' || l_returnflag AS context_note, CAST(l_quantity * 12 AS INT) AS reason_length, l_discount, l_returnflag,
       l_tax FROM lineitem"""
VIEWS["v_win"] = """
SELECT * FROM (SELECT r.*, s.doctor_id, s.starts_at, row_number() OVER (PARTITION BY r.slot_id
  ORDER BY requested_at, request_id) AS k FROM v_breq r JOIN v_slots s USING (slot_id) WHERE reason_length <= 500)
WHERE k = 1"""
VIEWS["v_bcancel"] = """
SELECT 'APT-' || slot_id AS appointment_id, CASE WHEN l_discount > 0.09 THEN 'P99999' ELSE personnel_id END
  AS personnel_id, requested_at + INTERVAL 5 DAY AS cancelled_at FROM v_breq WHERE l_discount > 0.07"""
VIEWS["v_bnotes"] = """
SELECT 'APT-' || slot_id AS appointment_id, CASE WHEN l_tax = 0 THEN '  ' ELSE 'note for ' || slot_id END AS note_text,
       coalesce(CASE WHEN l_discount < 0.05 THEN d.subject END, 'doc-x') AS issued_by,
       requested_at + INTERVAL 3 DAY AS issued_at
FROM v_breq LEFT JOIN (SELECT slot_id, subject FROM v_slots JOIN v_doctors USING (doctor_id)) d USING (slot_id)
WHERE l_returnflag = 'R'"""
VIEWS["v_rx"] = """
SELECT 'RX-' || n.appointment_id AS prescription_id, n.appointment_id, any_value(n.note_text) AS note_text,
       any_value(n.issued_by) AS issued_by, min(n.issued_at) AS issued_at
FROM v_bnotes n JOIN v_win a ON n.appointment_id = 'APT-' || a.slot_id
JOIN v_doctors d ON d.doctor_id = a.doctor_id AND d.subject = n.issued_by WHERE trim(n.note_text) <> ''
GROUP BY n.appointment_id"""
VIEWS["v_appt"] = """
SELECT 'APT-' || a.slot_id AS appointment_id, a.personnel_id, a.doctor_id, a.slot_id, a.starts_at, a.shared_context,
       CASE WHEN a.shared_context THEN a.context_note ELSE '' END AS context_note, a.requested_at AS created_at,
       CASE WHEN x.issued_at IS NOT NULL AND (c.c IS NULL OR x.issued_at <= c.c) THEN 'completed'
            WHEN c.c IS NOT NULL THEN 'cancelled' ELSE 'booked' END AS status
FROM v_win a LEFT JOIN v_rx x ON x.appointment_id = 'APT-' || a.slot_id
LEFT JOIN (SELECT appointment_id, personnel_id, min(cancelled_at) AS c FROM v_bcancel GROUP BY ALL) c
  ON c.appointment_id = 'APT-' || a.slot_id AND c.personnel_id = a.personnel_id"""


def b_all(w):
    roster = booking.current_roster(b_changes(w))
    slots = booking.publish_slots(b_offers(w))
    requests = b_requests(w)
    won = booking.winners(requests, slots)
    cancels = requests.filter(F.col("l_discount") > 0.07).select(
        F.concat(F.lit("APT-"), "slot_id").alias("appointment_id"),
        F.when(F.col("l_discount") > 0.09, "P99999").otherwise(F.col("personnel_id")).alias("personnel_id"),
        (F.col("requested_at") + F.expr("interval 5 days")).alias("cancelled_at"))
    owner = slots.join(roster, "doctor_id").select("slot_id", "subject")
    raw_notes = requests.filter(F.col("l_returnflag") == "R").join(owner, "slot_id", "left").select(
        F.concat(F.lit("APT-"), "slot_id").alias("appointment_id"),
        F.when(F.col("l_tax") == 0, "  ").otherwise(F.concat(F.lit("note for "), "slot_id")).alias("note_text"),
        F.coalesce(F.when(F.col("l_discount") < 0.05, F.col("subject")), F.lit("doc-x")).alias("issued_by"),
        (F.col("requested_at") + F.expr("interval 3 days")).alias("issued_at"))
    notes = booking.accept_notes(raw_notes, won, roster)
    return roster, slots, requests, booking.with_status(won, cancels, notes), cancels, notes


@query("active_doctors_b01", "doctor_id name specialty unit_id",
       "SELECT doctor_id, name, specialty, unit_id FROM v_doctors")
def b01(w):
    return booking.active_doctors(booking.current_roster(b_changes(w)))


@query("published_slots_b02", "slot_id doctor_id starts_at conflicting_offers#", "SELECT * FROM v_slots")
def b02(w):
    return booking.publish_slots(b_offers(w))


@query("open_slots_b03", "slot_id doctor_id starts_at doctor_name specialty unit_id", """
SELECT s.slot_id, s.doctor_id, s.starts_at, d.name AS doctor_name, d.specialty, d.unit_id
FROM v_slots s JOIN v_doctors d USING (doctor_id) WHERE s.slot_id NOT IN (
  SELECT slot_id FROM v_appt WHERE status <> 'cancelled') ORDER BY s.starts_at, s.slot_id LIMIT 200""")
def b03(w):
    roster, slots, _, appointments, _, _ = b_all(w)
    return booking.open_slots(slots, roster, appointments)


@query("claims_resolved_b04", "request_id slot_id personnel_id outcome", """
SELECT r.request_id, r.slot_id, r.personnel_id, CASE WHEN reason_length > 500 THEN 'refused'
       WHEN s.slot_id IS NULL THEN 'unknown slot' WHEN r.request_id = a.request_id THEN 'booked' ELSE 'taken' END AS outcome
FROM v_breq r LEFT JOIN v_slots s USING (slot_id) LEFT JOIN (SELECT slot_id, request_id FROM v_win) a USING (slot_id)""")
def b04(w):
    _, slots, requests, _, _, _ = b_all(w)
    return booking.claim_outcomes(requests, slots)


@query("cancellations_b05", "appointment_id personnel_id cancelled_at outcome", """
SELECT c.appointment_id, c.personnel_id, c.cancelled_at, CASE WHEN a.personnel_id IS NULL
  OR a.personnel_id <> c.personnel_id THEN 'no such appointment' WHEN a.status = 'completed' THEN 'already completed'
  ELSE 'cancelled' END AS outcome FROM v_bcancel c LEFT JOIN v_appt a USING (appointment_id)""")
def b05(w):
    _, _, _, appointments, cancels, _ = b_all(w)
    return booking.cancel_outcomes(cancels, appointments)


@query("appointments_of_people_b06", "personnel_id appointment_id doctor_id status context_note starts_at doctor_name "
       "specialty prescription_id note_text issued_at", """
SELECT a.*, d.name AS doctor_name, d.specialty, x.prescription_id, x.note_text, x.issued_at
FROM v_appt a JOIN v_doctors d USING (doctor_id) LEFT JOIN v_rx x USING (appointment_id)""")
def b06(w):
    roster, slots, _, appointments, _, notes = b_all(w)
    return booking.for_person(appointments, slots, roster, notes)


@query("schedules_of_doctors_b07", "subject appointment_id personnel_id status shared_context context_note starts_at "
       "prescription_id", """
SELECT d.subject, a.appointment_id, a.personnel_id, a.status, a.shared_context,
       CASE WHEN a.shared_context THEN a.context_note END AS context_note, a.starts_at, x.prescription_id
FROM v_appt a JOIN v_doctors d USING (doctor_id) LEFT JOIN v_rx x USING (appointment_id) WHERE a.status <> 'cancelled'""")
def b07(w):
    roster, slots, _, appointments, _, notes = b_all(w)
    return booking.for_doctor(appointments, slots, roster, notes)


@query("visit_notes_b08", "prescription_id appointment_id note_text issued_by issued_at", "SELECT * FROM v_rx")
def b08(w):
    return b_all(w)[5]


@query("note_for_its_patient_b09", "prescription_id note_text doctor_name starts_at", """
SELECT x.prescription_id, x.note_text, d.name AS doctor_name, a.starts_at FROM v_rx x JOIN v_appt a USING (appointment_id)
JOIN v_doctors d USING (doctor_id) WHERE EXISTS (SELECT 1 FROM v_breq r WHERE r.l_returnflag = 'R'
  AND 'RX-APT-' || r.slot_id = x.prescription_id AND r.personnel_id = a.personnel_id)""")
def b09(w):
    roster, _, requests, appointments, _, notes = b_all(w)
    asks = requests.filter(F.col("l_returnflag") == "R").select(
        F.concat(F.lit("RX-APT-"), "slot_id").alias("prescription_id"), "personnel_id")
    return booking.note_for_patient(notes, appointments, roster, asks)


@query("booking_counts_b10", "table_name n#", """
SELECT 'doctors' AS table_name, count(*) AS n FROM v_doctors UNION ALL
SELECT 'availability_slots', count(*) FROM v_slots UNION ALL SELECT 'appointments', count(*) FROM v_appt UNION ALL
SELECT 'prescriptions', count(*) FROM v_rx""")
def b10(w):
    roster, slots, _, appointments, _, notes = b_all(w)
    return booking.table_counts(doctors=roster, availability_slots=slots, appointments=appointments, prescriptions=notes)


# --- E ------------------------------------------------------------------------
@query("systematic_sample_e01", "profile_id pseudonym_id welfare_risk_score*", """
SELECT printf('R%03d', i + 1) AS profile_id, pseudonym_id, welfare_risk_score
FROM (SELECT *, row_number() OVER (ORDER BY welfare_risk_score, pseudonym_id) - 1 AS place, count(*) OVER () AS n FROM v_cases)
JOIN range(50) t(i) ON place = CASE WHEN n <= 50 THEN i ELSE CAST(floor(i * (n / 50e0)) AS BIGINT) END""")
def e01(w):
    return rate.systematic_sample(w.cases, 50)


_sentence = " UNION ALL ".join(
    f"SELECT pseudonym_id, {i} AS place, {s} AS v, '{t}' AS t FROM v_latest"
    for i, (s, t) in enumerate(rate.PHRASES.items()))


@query("profiles_in_words_e02", "pseudonym_id description", f"""
SELECT pseudonym_id, 'Posting: ' || replace(any_value(posting_type), '_', ' ') || '. '
  || string_agg(replace(t, '%s', CASE WHEN v >= 75 THEN 'far above' WHEN v >= 55 THEN 'well above' WHEN v >= 35
     THEN 'somewhat above' WHEN v >= 15 THEN 'around' ELSE 'below' END), ' ' ORDER BY v DESC, place) AS description
FROM (SELECT *, row_number() OVER (PARTITION BY pseudonym_id ORDER BY v DESC, place) AS rn FROM ({_sentence}))
JOIN (SELECT pseudonym_id, posting_type FROM v_latest) USING (pseudonym_id) WHERE rn <= 4 GROUP BY pseudonym_id""")
def e02(w):
    return rate.describe(w.latest_signals)


VIEWS["v_cons"] = "SELECT profile_id, avg(rating) AS consensus, count(*) AS raters FROM v_ratings GROUP BY profile_id"
_rank = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0"


@query("spearman_e03", "n# rho*", f"""
SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT {_rank.format(c='round_even(value, 0)')} AS rx,
  {_rank.format(c='k')} AS ry FROM v_ev)""")
def e03(w):
    return rate.spearman(w.events.select(F.bround("value", 0).alias("x"), F.col("k").alias("y")), "x", "y")


@query("inter_rater_agreement_e04", "rater_a rater_b n# rho*", """
SELECT rater_a, rater_b, count(*) AS n, corr(rx, ry) AS rho FROM (
  SELECT a.rater_id AS rater_a, b.rater_id AS rater_b,
         rank() OVER (PARTITION BY a.rater_id, b.rater_id ORDER BY a.rating)
           + (count(*) OVER (PARTITION BY a.rater_id, b.rater_id, a.rating) - 1) / 2e0 AS rx,
         rank() OVER (PARTITION BY a.rater_id, b.rater_id ORDER BY b.rating)
           + (count(*) OVER (PARTITION BY a.rater_id, b.rater_id, b.rating) - 1) / 2e0 AS ry
  FROM v_ratings a JOIN v_ratings b ON a.profile_id = b.profile_id AND a.rater_id < b.rater_id)
GROUP BY rater_a, rater_b HAVING count(*) >= 3 AND min(rx) < max(rx) AND min(ry) < max(ry)""")
def e04(w):
    return rate.inter_rater(ratings(w))


@query("model_against_consensus_e05", "n# rho*", """
SELECT count(*) AS n, corr(rx, ry) AS rho FROM (
  SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS rx,
         rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2e0 AS ry
  FROM (SELECT round(welfare_risk_score, 6) AS s, round(consensus, 6) AS c FROM v_cases
        JOIN (SELECT pseudonym_id, personnel_id FROM v_roster) USING (pseudonym_id)
        JOIN v_cons ON profile_id = personnel_id))""")
def e05(w):
    scores = w.cases.join(w.roster_keys, "pseudonym_id").select(
        F.col("personnel_id").alias("profile_id"), F.round("welfare_risk_score", 6).alias("model_score"))
    return rate.model_agreement(ratings(w), scores)
