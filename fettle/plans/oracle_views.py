"""The same chain as DuckDB SQL, written independently of the Spark operators.

``compose`` prepends the views a query mentions, in dependency order.
"""

from __future__ import annotations

import re

from fettle import policy as P
from fettle.functions.keyed_hash import _pads
from fettle.plans.workload import DEVELOPMENT_KEY

INNER, OUTER = _pads(DEVELOPMENT_KEY)
SIG = P.SIGNALS


def hmac(message: str) -> str:
    return (
        f"('PSN' || substr(sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode({message})))), 1, 16))")


def clip(x: str, lo: str = "0e0", hi: str = "1e0") -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END)"


def sat(x: str, top: float, floor: float = 0.0) -> str:
    return "(" + clip(f"(({x}) - {floor}e0) / {top - floor}e0") + " * 100e0)"


def inv(x: str, top: float) -> str:
    return f"(100e0 - {sat(x, top)})"


def blend(*parts: tuple[str, float]) -> str:
    num = " + ".join(f"coalesce({x}, 0e0) * {w}e0" for x, w in parts)
    den = " + ".join(f"CASE WHEN {x} IS NULL THEN 0e0 ELSE {w}e0 END" for x, w in parts)
    ratio = f"(({num}) / nullif({den}, 0e0))"
    return clip(ratio, "0e0", "100e0")


def bucket(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT % 100)"


def index_sql(t: dict[str, str]) -> str:
    linear = " + ".join(f"{w}e0 * {t[n]}" for n, w in P.INDEX_WEIGHTS.items())
    return clip(
        f"({linear} + {P.INDEX_INTERACTION}e0 * {t['overwork']} * {t['recovery_deficit']}"
        f" + {P.INDEX_SATURATING}e0 * sqrt({t['deployment']} * (1e0 + {t['irregularity']}))) * 100e0", "0e0", "100e0")


def signal_index(s: dict[str, str]) -> str:
    d = {n: f"({s[n]} / 100e0)" for n in SIG}
    return index_sql({
        "overwork": d[SIG[0]], "recovery_deficit": d[SIG[1]], "leave_deficit": d[SIG[7]], "deployment": d[SIG[2]],
        "irregularity": d[SIG[3]], "churn": d[SIG[5]], "training": d[SIG[6]], "no_offs": d[SIG[1]],
        "hard_area": d[SIG[4]], "family_separated": d[SIG[8]], "exposure": "0.5e0"})


FEATURE_INDEX = index_sql({
    "overwork": clip("workload_deviation_pct / 100e0"),
    "recovery_deficit": clip("days_since_last_leave / 365e0"),
    "leave_deficit": clip("1e0 - leave_entitlement_used_pct / 100e0"),
    "deployment": clip("current_deployment_length_months / 30e0"),
    "irregularity": clip("schedule_irregularity_sd / 4e0"),
    "churn": clip("transfer_count_past_2yrs / 4e0"),
    "training": clip("training_hours_last_3months / 120e0"),
    "no_offs": clip("1e0 - holiday_weekly_off_availed_pct / 100e0"),
    "hard_area": "(CASE WHEN posting_type = 'hard_area' THEN 1e0 ELSE 0e0 END)",
    "family_separated": "(CASE WHEN family_separated THEN 1e0 ELSE 0e0 END)",
    "exposure": "0.5e0",
})


def band(s: str) -> str:
    return (f"(CASE WHEN {s} IS NULL THEN NULL WHEN {s} >= 65e0 THEN 'High' WHEN {s} >= 40e0 THEN 'Moderate' "
            "ELSE 'Normal' END)")


REF = "DATE '2026-09-01'"
RANKS = "[" + ", ".join(f"'{r}'" for r in P.RANKS) + "]"
GRAY = "[" + ", ".join(f"'{g}'" for g in P.GRAY_PROFILES) + "]"
VIEWS: dict[str, str] = {}

VIEWS["v_ev"] = f"""
SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
       CAST(day(ts) AS INT) AS d, printf('P%05d', user_id) AS personnel_id,
       {REF} - CAST(floor((31 - day(ts)) * 30.44e0 - (event_id % 30)) AS INT) AS ed
FROM events"""


def roster_sql(unit: str) -> str:
    return f"""
SELECT p.user_id, printf('P%05d', p.user_id) AS personnel_id, printf('SN%07d', p.user_id) AS service_number,
       c_name AS name, {RANKS}[CAST(p.user_id % 8 + 1 AS INT)] AS rank, p.user_id % 8 < 3 AS is_jawan_rank,
       printf('U%03d', {unit}) AS unit_id, lower(r_name) AS region_type,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'hard_area' WHEN 'MACHINERY' THEN 'hard_area'
            WHEN 'HOUSEHOLD' THEN 'static_station' ELSE 'field' END AS posting_type,
       DATE '1990-01-01' - CAST((p.user_id * 13) % 5000 AS INT) AS date_of_birth,
       {REF} - CAST((p.user_id * 37) % 1200 AS INT) AS current_posting_start_date,
       CASE WHEN p.user_id % 50 = 7 THEN {REF} - CAST((p.user_id * 37) % 1200 AS INT) + 10
            ELSE {REF} - CAST((p.user_id * 37) % 1200 AS INT) - CAST(p.user_id % 1000 + 400 AS INT) END
         AS date_of_joining,
       c_acctbal < 2000 AS family_separated, 1e0 + n_regionkey * 0.1e0 AS unit_operational_tempo,
       0.5e0 AS exposure_propensity,
       CASE WHEN p.user_id % 20 = 0 THEN {GRAY}[CAST((p.user_id // 20) % 5 + 1 AS INT)] END AS benign_profile
FROM (SELECT DISTINCT user_id FROM events) p JOIN customer ON c_custkey = p.user_id
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""


VIEWS["v_roster_raw"] = roster_sql("n_regionkey")
VIEWS["v_roster_small"] = roster_sql("n_nationkey")
VIEWS["v_roster"] = f"""
SELECT *, {hmac('personnel_id')} AS pseudonym_id FROM v_roster_raw
WHERE NOT coalesce(current_posting_start_date < date_of_joining, false)"""
VIEWS["v_capacity"] = """
SELECT unit_id, on_strength,
       CAST(ceil(on_strength * (1e0 + (CAST(substr(unit_id, 2) AS INT) % 5) * 0.1e0)) AS INT) AS sanctioned_strength
FROM (SELECT unit_id, CAST(count(*) AS INT) AS on_strength FROM v_roster_raw GROUP BY unit_id)"""
VIEWS["v_duty_raw"] = f"""
SELECT personnel_id, {REF} - CAST(ceil((31 - d) * 30.44e0) AS INT) AS month_start,
       CAST(20 + 2 * n AS INT) AS days_on_duty,
       m * (20 + 2 * n) + CASE WHEN d % 3 = 0 THEN 2e0 ELSE 0e0 END AS total_duty_hours,
       m AS mean_daily_duty_hours, daily_duty_hours_sd, night_shifts, 4 AS weekly_offs_entitled, weekly_offs_availed
FROM (SELECT personnel_id, d, count(*) AS n, 12e0 + avg(value) / 20e0 AS m,
             coalesce(least(6e0, stddev_samp(value) / 20e0), 0.2e0) AS daily_duty_hours_sd,
             CAST(2 * count(*) FILTER (event_type = 'error') AS INT) AS night_shifts,
             CAST(count(*) FILTER (event_type = 'view') AS INT) AS weekly_offs_availed
      FROM v_ev GROUP BY personnel_id, d)"""
VIEWS["v_duty"] = """
SELECT r.pseudonym_id, d.personnel_id, d.month_start, least(d.days_on_duty, 31) AS days_on_duty,
       least(d.mean_daily_duty_hours, 20e0) AS mean_daily_duty_hours,
       least(d.mean_daily_duty_hours, 20e0) * least(d.days_on_duty, 31) AS total_duty_hours, d.daily_duty_hours_sd,
       d.night_shifts, d.weekly_offs_entitled, least(d.weekly_offs_availed, d.weekly_offs_entitled)
         AS weekly_offs_availed
FROM v_duty_raw d JOIN v_roster r USING (personnel_id)"""
VIEWS["v_leave_raw"] = """
SELECT printf('L%d', event_id) AS leave_id, personnel_id, ['earned', 'casual', 'medical'][k % 3 + 1] AS leave_type,
       ed AS start_date, CASE WHEN event_id % 17 = 0 THEN ed - 2 ELSE ed + (k % 15 + 1) END AS end_date,
       CAST(k % 15 + 1 + CASE WHEN event_id % 11 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS days_availed
FROM v_ev WHERE event_type = 'purchase'"""
VIEWS["v_leave"] = """
SELECT r.pseudonym_id, l.leave_id, l.start_date, l.end_date,
       least(100e0, CASE WHEN abs(l.end_date - l.start_date - l.days_availed) > 1
             THEN CAST(l.end_date - l.start_date AS DOUBLE) ELSE l.days_availed END) AS days_availed
FROM v_leave_raw l JOIN v_roster r USING (personnel_id) WHERE l.end_date >= l.start_date"""
VIEWS["v_training"] = """
SELECT r.pseudonym_id, printf('T%d', event_id) AS training_id, ed AS start_date,
       ed + CAST(ceil(value / 40e0) AS INT) AS end_date, value / 5e0 AS training_hours
FROM v_ev JOIN v_roster r USING (personnel_id) WHERE event_type = 'click'"""
VIEWS["v_transfer"] = """
SELECT r.pseudonym_id, printf('X%d', event_id) AS transfer_id, ed AS transfer_date
FROM v_ev JOIN v_roster r USING (personnel_id) WHERE event_type = 'signup' AND k % 5 = 0"""
VIEWS["v_deploy_raw"] = """
SELECT printf('D%d', event_id) AS deployment_id, personnel_id, printf('U%03d', k % 5) AS unit_id, ed AS start_date,
       lead(ed) OVER (PARTITION BY user_id ORDER BY ed, event_id) - 1 AS end_date
FROM v_ev WHERE event_type = 'error' AND k % 4 = 0"""
VIEWS["v_deploy"] = """
SELECT r.pseudonym_id, d.deployment_id, d.start_date, d.end_date
FROM v_deploy_raw d JOIN v_roster r USING (personnel_id)"""
VIEWS["v_snaps"] = f"SELECT {REF} - CAST(30 * i AS INT) AS s FROM range(6) t(i)"
VIEWS["v_grid"] = """
SELECT pseudonym_id, s AS snapshot_date, unit_id, posting_type, is_jawan_rank, family_separated,
       current_posting_start_date FROM v_roster CROSS JOIN v_snaps"""
VIEWS["v_f_leave"] = """
SELECT g.pseudonym_id, g.snapshot_date,
       coalesce(CAST(g.snapshot_date - max(l.end_date) AS DOUBLE), 730.56e0) AS days_since_last_leave,
       coalesce(sum(l.days_availed) FILTER (l.end_date >= g.snapshot_date - 365), 0e0) AS total_leave_days_past_year,
       coalesce(sum(l.days_availed) FILTER (l.end_date > g.snapshot_date - 7), 0e0) AS leave_days_7d,
       coalesce(sum(l.days_availed) FILTER (l.end_date > g.snapshot_date - 30), 0e0) AS leave_days_30d,
       coalesce(sum(l.days_availed) FILTER (l.end_date > g.snapshot_date - 90), 0e0) AS leave_days_90d
FROM v_grid g LEFT JOIN v_leave l ON l.pseudonym_id = g.pseudonym_id AND l.end_date <= g.snapshot_date
GROUP BY g.pseudonym_id, g.snapshot_date"""
VIEWS["v_f_deploy"] = """
SELECT g.pseudonym_id, g.snapshot_date,
       greatest(0e0, (g.snapshot_date - any_value(g.current_posting_start_date)) / 30.44e0)
         AS time_in_current_posting_months,
       coalesce(greatest(0e0, (g.snapshot_date - coalesce(
           max(d.start_date) FILTER (d.end_date IS NULL OR d.end_date > g.snapshot_date), max(d.start_date)))
           / 30.44e0),
         greatest(0e0, (g.snapshot_date - any_value(g.current_posting_start_date)) / 30.44e0))
         AS current_deployment_length_months,
       CAST(count(d.start_date) FILTER (d.start_date > g.snapshot_date - 730) AS DOUBLE) AS deployment_count_past_2yrs,
       max(d.start_date) AS any_start
FROM v_grid g LEFT JOIN v_deploy d ON d.pseudonym_id = g.pseudonym_id AND d.start_date <= g.snapshot_date
GROUP BY g.pseudonym_id, g.snapshot_date"""
VIEWS["v_f_deploy_fix"] = """
SELECT pseudonym_id, snapshot_date, time_in_current_posting_months, deployment_count_past_2yrs,
       CASE WHEN any_start IS NULL THEN time_in_current_posting_months ELSE current_deployment_length_months END
         AS current_deployment_length_months FROM v_f_deploy"""
VIEWS["v_f_transfer"] = """
SELECT g.pseudonym_id, g.snapshot_date,
       CAST(count(t.transfer_date) FILTER (t.transfer_date > g.snapshot_date - 730) AS DOUBLE)
         AS transfer_count_past_2yrs,
       coalesce(CAST(g.snapshot_date - max(t.transfer_date) AS DOUBLE), 730.56e0) AS time_since_last_transfer_days
FROM v_grid g LEFT JOIN v_transfer t ON t.pseudonym_id = g.pseudonym_id AND t.transfer_date <= g.snapshot_date
GROUP BY g.pseudonym_id, g.snapshot_date"""
VIEWS["v_newest_duty"] = """
SELECT * FROM (
  SELECT g.snapshot_date, d.*, row_number() OVER (PARTITION BY d.pseudonym_id, g.snapshot_date
                                                 ORDER BY d.month_start DESC) AS rn
  FROM v_grid g JOIN v_duty d ON d.pseudonym_id = g.pseudonym_id AND d.month_start <= g.snapshot_date) WHERE rn = 1"""
VIEWS["v_f_duty"] = """
SELECT g.pseudonym_id, g.snapshot_date, d.total_duty_hours AS duty_hours_last_month,
       100e0 * (d.total_duty_hours - 208e0) / 208e0 AS workload_deviation_pct,
       100e0 * d.weekly_offs_availed / nullif(d.weekly_offs_entitled, 0) AS holiday_weekly_off_availed_pct,
       d.daily_duty_hours_sd AS schedule_irregularity_sd, CAST(d.night_shifts AS DOUBLE) AS night_shifts_last_month,
       d.month_start
FROM v_grid g LEFT JOIN v_newest_duty d USING (pseudonym_id, snapshot_date)"""
VIEWS["v_f_training"] = """
SELECT g.pseudonym_id, g.snapshot_date,
       coalesce(sum(t.training_hours) FILTER (t.end_date > g.snapshot_date - 7), 0e0) AS training_hours_7d,
       coalesce(sum(t.training_hours) FILTER (t.end_date > g.snapshot_date - 30), 0e0) AS training_hours_30d,
       coalesce(sum(t.training_hours) FILTER (t.end_date > g.snapshot_date - 90), 0e0) AS training_hours_90d
FROM v_grid g LEFT JOIN v_training t ON t.pseudonym_id = g.pseudonym_id AND t.end_date <= g.snapshot_date
GROUP BY g.pseudonym_id, g.snapshot_date"""
VIEWS["v_f_prorated"] = """
SELECT g.pseudonym_id, g.snapshot_date, """ + ", ".join(f"""
       sum(d.total_duty_hours * least(1e0, greatest(0e0, (
           least(epoch(d.month_start) / 86400e0 + 30.44e0, epoch(g.snapshot_date) / 86400e0)
           - greatest(epoch(d.month_start) / 86400e0, epoch(g.snapshot_date) / 86400e0 - {n}e0)) / 30.44e0)))
         AS duty_hours_{n}d""" for n in P.WINDOW_DAYS) + """
FROM v_grid g LEFT JOIN v_duty d ON d.pseudonym_id = g.pseudonym_id GROUP BY g.pseudonym_id, g.snapshot_date"""


def ratio(q: str) -> str:
    s, l = f"({q}_30d / 30e0)", f"({q}_90d / 90e0)"
    return (f"CASE WHEN {q}_30d IS NULL OR {q}_90d IS NULL THEN NULL WHEN {l} < 0.0001e0 THEN "
            f"CASE WHEN {s} < 0.0001e0 THEN 1e0 ELSE 5e0 END ELSE least(5e0, greatest(0e0, {s} / {l})) END "
            f"AS {q}_change_ratio")


QTY = ("duty_hours", "leave_days", "training_hours")
VIEWS["v_windows"] = (
    "SELECT pseudonym_id, snapshot_date, " + ", ".join(f"{q}_{n}d" for q in QTY for n in P.WINDOW_DAYS) + ", "
    + ", ".join(ratio(q) for q in QTY)
    + " FROM v_f_prorated JOIN v_f_leave USING (pseudonym_id, snapshot_date) "
      "JOIN v_f_training USING (pseudonym_id, snapshot_date)")
VIEWS["v_base_stats"] = """
SELECT g.pseudonym_id, g.snapshot_date, count(d.month_start) AS n,
       avg(d.total_duty_hours) AS m1, coalesce(stddev_samp(d.total_duty_hours), 0e0) AS s1,
       avg(d.daily_duty_hours_sd) AS m2, coalesce(stddev_samp(d.daily_duty_hours_sd), 0e0) AS s2,
       avg(d.night_shifts) AS m3, coalesce(stddev_samp(d.night_shifts), 0e0) AS s3
FROM v_grid g LEFT JOIN v_duty d ON d.pseudonym_id = g.pseudonym_id
  AND d.month_start > g.snapshot_date - 180 AND d.month_start <= g.snapshot_date - 30
GROUP BY g.pseudonym_id, g.snapshot_date"""
VIEWS["v_baseline"] = """
SELECT b.pseudonym_id, b.snapshot_date,
       CASE WHEN f.month_start IS NULL THEN NULL ELSE m1 END AS baseline_duty_hours_mean,
       CASE WHEN f.month_start IS NULL OR n = 0 THEN NULL ELSE s1 END AS baseline_duty_hours_sd,
       CASE WHEN f.month_start IS NULL THEN 0e0 ELSE CAST(n AS DOUBLE) END AS baseline_observations,
       f.month_start IS NOT NULL AND n >= 3 AS baseline_is_reliable,
       (f.duty_hours_last_month - m1) / greatest(s1, 0.000001e0) AS duty_hours_personal_deviation_z,
       (f.schedule_irregularity_sd - m2) / greatest(s2, 0.000001e0) AS schedule_sd_personal_deviation_z,
       (f.night_shifts_last_month - m3) / greatest(s3, 0.000001e0) AS night_shifts_personal_deviation_z
FROM v_base_stats b JOIN v_f_duty f USING (pseudonym_id, snapshot_date)"""
VIEWS["v_hr"] = """
SELECT g.pseudonym_id, g.snapshot_date, g.unit_id, g.posting_type, g.is_jawan_rank, g.family_separated,
       l.days_since_last_leave, l.total_leave_days_past_year, l.total_leave_days_past_year AS leave_entitlement_used_pct,
       p.current_deployment_length_months, p.deployment_count_past_2yrs, p.time_in_current_posting_months,
       t.transfer_count_past_2yrs, t.time_since_last_transfer_days, d.duty_hours_last_month, d.workload_deviation_pct,
       d.holiday_weekly_off_availed_pct, d.schedule_irregularity_sd,
       tr.training_hours_90d AS training_hours_last_3months, d.night_shifts_last_month
FROM v_grid g JOIN v_f_leave l USING (pseudonym_id, snapshot_date)
JOIN v_f_deploy_fix p USING (pseudonym_id, snapshot_date) JOIN v_f_transfer t USING (pseudonym_id, snapshot_date)
JOIN v_f_duty d USING (pseudonym_id, snapshot_date) JOIN v_f_training tr USING (pseudonym_id, snapshot_date)"""
VIEWS["v_features"] = """
SELECT h.*, w.* EXCLUDE (pseudonym_id, snapshot_date), b.* EXCLUDE (pseudonym_id, snapshot_date)
FROM v_hr h JOIN v_windows w USING (pseudonym_id, snapshot_date) JOIN v_baseline b USING (pseudonym_id, snapshot_date)"""
_over = ("(CASE WHEN posting_type = 'hard_area' THEN greatest(0e0, time_in_current_posting_months - 24e0) "
         "ELSE 0e0 END)")
_sev = ("(CASE posting_type WHEN 'hard_area' THEN 100e0 WHEN 'field' THEN 50e0 WHEN 'static_station' THEN 10e0 "
        "ELSE 0e0 END)")
SIGNAL_SQL = {
    SIG[0]: blend((sat("workload_deviation_pct", 100.0), 0.7), (sat("duty_hours_personal_deviation_z", 2.5), 0.3)),
    SIG[1]: blend((sat("days_since_last_leave", 365.0), 0.6), (inv("holiday_weekly_off_availed_pct", 100.0), 0.4)),
    SIG[2]: blend((sat("current_deployment_length_months", 30.0), 0.75),
                  (sat("deployment_count_past_2yrs", 4.0), 0.25)),
    SIG[3]: blend((sat("schedule_irregularity_sd", 4.0), 0.65),
                  (sat("night_shifts_personal_deviation_z", 2.5), 0.35)),
    SIG[4]: blend((_sev, 0.55), (sat(_over, 18.0), 0.45)),
    SIG[5]: blend((sat("transfer_count_past_2yrs", 4.0), 0.7), (inv("time_since_last_transfer_days", 365.0), 0.3)),
    SIG[6]: sat("training_hours_last_3months", 120.0),
    SIG[7]: inv("leave_entitlement_used_pct", 100.0),
    SIG[8]: blend(("(CASE WHEN family_separated THEN 100e0 ELSE 0e0 END)", 0.65),
                  (f"(CASE WHEN family_separated THEN {sat('time_in_current_posting_months', 24.0)} ELSE 0e0 END)",
                   0.35)),
}
VIEWS["v_signals"] = (
    "SELECT pseudonym_id, snapshot_date, unit_id, posting_type, is_jawan_rank, "
    + ", ".join(f"{sql} AS {n}" for n, sql in SIGNAL_SQL.items())
    + ", 0e0 AS voice_stress_signal, 0e0 AS voice_signal_present FROM v_features")
_present = " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in SIG)
VIEWS["v_scored0"] = f"SELECT *, {signal_index({n: n for n in SIG})} AS welfare_risk_score FROM v_with_voice"
VIEWS["v_scored1"] = f"""
SELECT *, 0.4e0 * (({_present}) / 9e0)
       + 0.35e0 * least(1e0, count(*) OVER (PARTITION BY pseudonym_id) / 6e0) + 0.25e0 * 1e0 AS confidence
FROM v_scored0"""
VIEWS["v_scored"] = f"""
SELECT *, CASE WHEN confidence >= 0.75e0 THEN 'High' WHEN confidence >= 0.5e0 THEN 'Medium' ELSE 'Low' END
       AS confidence_level, {band('welfare_risk_score')} AS risk_level FROM v_scored1"""
VIEWS["v_label"] = f"""
SELECT f.pseudonym_id, f.snapshot_date,
       {FEATURE_INDEX} * CASE WHEN r.benign_profile IS NULL THEN 1e0 ELSE 0.55e0 END AS label
FROM (SELECT * FROM v_features) f JOIN (SELECT pseudonym_id, benign_profile FROM v_roster) r USING (pseudonym_id)"""
VIEWS["v_model"] = f"""
SELECT s.*, l.label, r.personnel_id,
       CASE WHEN {bucket('r.personnel_id', P.SEED)} < 20 THEN 'test'
            WHEN {bucket('r.personnel_id', P.SEED + 1)} < 20 THEN 'calibration' ELSE 'fit' END AS split
FROM v_scored s JOIN v_label l USING (pseudonym_id, snapshot_date)
JOIN (SELECT pseudonym_id, personnel_id FROM v_roster) r USING (pseudonym_id)"""
VIEWS["v_cal"] = """
SELECT calibration_rows, calibration_people, quantile_rank,
       (SELECT list_sort(list(abs(label - welfare_risk_score)))[quantile_rank] FROM v_model WHERE split = 'calibration')
         AS half_width
FROM (SELECT count(*) AS calibration_rows, count(DISTINCT pseudonym_id) AS calibration_people,
             least(count(*), CAST(ceil((count(*) + 1) * 0.9e0) AS BIGINT)) AS quantile_rank
      FROM v_model WHERE split = 'calibration')"""
VIEWS["v_latest"] = "SELECT * FROM v_scored WHERE snapshot_date = (SELECT max(snapshot_date) FROM v_scored)"
VIEWS["v_units"] = """
SELECT unit_id, personnel_count, CASE WHEN personnel_count >= 10 THEN a END AS mean_risk,
       CASE WHEN personnel_count >= 10 THEN m END AS median_risk, CASE WHEN personnel_count >= 10 THEN e END
         AS elevated_share, CASE WHEN personnel_count >= 10 THEN h END AS high_share,
       personnel_count >= 10 AND a >= 55e0 AS is_systemically_strained, personnel_count < 10 AS is_suppressed
FROM (SELECT unit_id, count(*) AS personnel_count, avg(welfare_risk_score) AS a, median(welfare_risk_score) AS m,
             avg(CASE WHEN risk_level IN ('Moderate', 'High') THEN 1e0 ELSE 0e0 END) AS e,
             avg(CASE WHEN risk_level = 'High' THEN 1e0 ELSE 0e0 END) AS h FROM v_latest GROUP BY unit_id)"""
VIEWS["v_class"] = f"""
SELECT s.*, u.mean_risk AS unit_mean, s.welfare_risk_score - u.mean_risk AS points_above_unit,
       CASE WHEN u.mean_risk IS NULL THEN 'Individual'
            WHEN u.is_systemically_strained AND s.welfare_risk_score - u.mean_risk > 8e0 THEN 'Mixed'
            WHEN u.is_systemically_strained THEN 'Systemic'
            WHEN s.welfare_risk_score - u.mean_risk > 8e0 THEN 'Individual' ELSE 'Systemic' END AS risk_attribution,
       greatest(0e0, s.welfare_risk_score - c.half_width) AS interval_low,
       least(100e0, s.welfare_risk_score + c.half_width) AS interval_high,
       CASE s.risk_level WHEN 'Moderate' THEN 65e0 - s.welfare_risk_score WHEN 'Normal'
            THEN 40e0 - s.welfare_risk_score END AS distance_to_next_band,
       CASE s.risk_level WHEN 'High' THEN s.welfare_risk_score - 65e0 WHEN 'Moderate'
            THEN s.welfare_risk_score - 40e0 END AS distance_to_band_below
FROM v_scored s LEFT JOIN v_units u USING (unit_id) CROSS JOIN v_cal c"""
VIEWS["v_classified"] = f"""
SELECT *, CASE WHEN {band('interval_low')} = {band('interval_high')} THEN 'certain' ELSE 'borderline' END
         AS band_certainty,
       coalesce(distance_to_band_below <= 3e0, false) AS barely_over_cutoff,
       coalesce(distance_to_next_band <= 3e0, false) AS barely_under_next_band FROM v_class"""
VIEWS["v_trend0"] = """
SELECT pseudonym_id, regr_slope(welfare_risk_score, CAST(snapshot_date - DATE '2026-01-01' AS DOUBLE)) * 30e0 AS slope,
       count(*) AS points_used, arg_min(welfare_risk_score, snapshot_date) AS first_score,
       arg_max(welfare_risk_score, snapshot_date) AS latest_score,
       max(snapshot_date) FILTER (risk_level = 'Normal') AS last_normal FROM v_scored GROUP BY pseudonym_id"""
VIEWS["v_trend"] = """
SELECT t.pseudonym_id, CASE WHEN any_value(points_used) < 3 OR any_value(slope) IS NULL THEN 'Insufficient data'
            WHEN any_value(slope) > 3e0 THEN 'Rising' WHEN any_value(slope) < -3e0 THEN 'Improving' ELSE 'Stable' END
         AS trend_direction,
       CASE WHEN any_value(points_used) >= 3 THEN any_value(slope) END AS slope_per_30_days,
       any_value(points_used) AS points_used,
       count(*) FILTER (s.risk_level <> 'Normal' AND (last_normal IS NULL OR s.snapshot_date > last_normal))
         AS persistence_snapshots,
       count(*) FILTER (s.risk_level <> 'Normal' AND (last_normal IS NULL OR s.snapshot_date > last_normal)) >= 3
         AS is_persistent, any_value(first_score) AS first_score, any_value(latest_score) AS latest_score
FROM v_trend0 t JOIN v_scored s USING (pseudonym_id) GROUP BY t.pseudonym_id"""
VIEWS["v_cond"] = """
SELECT m.unit_id, m.snapshot_date, personnel_count, mean_demand, mean_recovery_deficit,
       CASE WHEN sanctioned_strength > 0 THEN CAST(on_strength AS DOUBLE) / sanctioned_strength END AS staffing_ratio,
       coalesce(mean_demand >= 55e0 AND mean_recovery_deficit >= 35e0
                AND CAST(on_strength AS DOUBLE) / nullif(sanctioned_strength, 0) <= 0.85e0, false) AS conditions_met
FROM (SELECT unit_id, snapshot_date, count(*) AS personnel_count, avg(workload_deviation_signal) AS mean_demand,
             avg(recovery_pattern_signal) AS mean_recovery_deficit FROM v_signals GROUP BY unit_id, snapshot_date) m
LEFT JOIN v_capacity c USING (unit_id) WHERE personnel_count >= 10"""
VIEWS["v_cond_last"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY snapshot_date DESC) AS rn FROM v_cond)
WHERE rn = 1"""
VIEWS["v_find0"] = """
SELECT c.unit_id, min(c.snapshot_date) AS first_detected, count(*) AS consecutive_snapshots FROM v_cond c
WHERE c.conditions_met AND NOT EXISTS (SELECT 1 FROM v_cond f WHERE f.unit_id = c.unit_id AND NOT f.conditions_met
                                       AND f.snapshot_date >= c.snapshot_date)
GROUP BY c.unit_id HAVING count(*) >= 2"""
VIEWS["v_find"] = """
SELECT f.unit_id, f.first_detected, l.snapshot_date AS last_detected, f.consecutive_snapshots, l.mean_demand,
       l.mean_recovery_deficit, l.staffing_ratio, l.personnel_count FROM v_find0 f JOIN v_cond_last l USING (unit_id)"""
VIEWS["v_find_text"] = """
SELECT *, printf('Unit %s has held high duty demand (mean workload signal %.0f), limited recovery (mean recovery '
  || 'signal %.0f) and staffing at %.0f%% of sanctioned strength for %d consecutive snapshots. No individual is named '
  || 'in this finding: it describes the unit''s operating conditions and points to a roster, tasking or establishment '
  || 'review.', unit_id, mean_demand, mean_recovery_deficit, staffing_ratio * 100e0, consecutive_snapshots) AS summary
FROM v_find"""
VIEWS["v_press0"] = """
SELECT unit_id, snapshot_date, mean_demand, mean_recovery_deficit, staffing_ratio, personnel_count,
       CAST(mean_demand >= 55e0 AS INT) + CAST(mean_recovery_deficit >= 35e0 AS INT)
         + CAST(coalesce(staffing_ratio <= 0.85e0, false) AS INT) AS thresholds_crossed,
       mean_demand - 55e0 AS margin_demand, mean_recovery_deficit - 35e0 AS margin_recovery_deficit,
       0.85e0 - staffing_ratio AS margin_staffing FROM v_cond_last"""
VIEWS["v_press"] = """
SELECT * REPLACE (round_even(margin_demand, 1) AS margin_demand,
                  round_even(margin_recovery_deficit, 1) AS margin_recovery_deficit,
                  round_even(margin_staffing, 3) AS margin_staffing) FROM v_press0"""
VIEWS["v_close"] = """
SELECT unit_id, thresholds_crossed, personnel_count, w.name AS shortfall_condition, -w.by AS shortfall_amount
FROM (SELECT *, list_sort(list_filter([{'by': margin_demand, 'at': 0, 'name': 'demand'},
                {'by': margin_recovery_deficit, 'at': 1, 'name': 'recovery_deficit'},
                {'by': margin_staffing, 'at': 2, 'name': 'staffing'}], lambda x: x.by < 0))[1] AS w FROM v_press)
ORDER BY thresholds_crossed DESC, coalesce(-w.by, 0), unit_id LIMIT 3"""
VIEWS["v_cases"] = """
SELECT c.*, t.trend_direction, t.slope_per_30_days, t.points_used, t.persistence_snapshots, t.is_persistent,
       f.unit_id IS NOT NULL AS unit_near_miss, c.voice_signal_present > 0 AS has_voice_signal,
       c.risk_level = 'High' OR (c.risk_level = 'Moderate' AND coalesce(t.is_persistent, false)
                                 AND t.trend_direction = 'Rising') AS is_officer_visible
FROM (SELECT * FROM v_classified WHERE snapshot_date = (SELECT max(snapshot_date) FROM v_classified)) c
LEFT JOIN v_trend t USING (pseudonym_id) LEFT JOIN v_find f USING (unit_id)"""
VIEWS["v_bg"] = f"""
SELECT pseudonym_id AS bg_id, snapshot_date, {', '.join(f'{n} AS b{i}' for i, n in enumerate(SIG))} FROM v_signals
ORDER BY md5(pseudonym_id || ':' || CAST(snapshot_date AS VARCHAR) || ':{P.SEED}') LIMIT 100"""
_mix = {n: f"(CASE WHEN (m & {1 << i}) <> 0 THEN c.{n} ELSE b.b{i} END)" for i, n in enumerate(SIG)}
VIEWS["v_coalitions"] = f"""
SELECT c.pseudonym_id, m, avg({signal_index(_mix)}) AS v
FROM v_latest c CROSS JOIN v_bg b CROSS JOIN range(512) t(m) GROUP BY c.pseudonym_id, m"""
_fact = {s: __import__("math").factorial(s) * __import__("math").factorial(8 - s) / __import__("math").factorial(9)
         for s in range(9)}
_w = "CASE bit_count(a.m) " + " ".join(f"WHEN {s} THEN {w!r}::DOUBLE" for s, w in _fact.items()) + " END"
VIEWS["v_phi"] = f"""
SELECT a.pseudonym_id, p.bit, sum(({_w}) * (b.v - a.v)) AS phi
FROM range(9) p(bit) JOIN v_coalitions a ON (a.m & (1 << CAST(p.bit AS INT))) = 0
JOIN v_coalitions b ON b.pseudonym_id = a.pseudonym_id AND b.m = (a.m | (1 << CAST(p.bit AS INT)))
GROUP BY a.pseudonym_id, p.bit"""
_names = "[" + ", ".join(f"'{n}'" for n in SIG) + "]"
VIEWS["v_latest_long"] = "UNION ALL".join(
    f" SELECT pseudonym_id, '{n}' AS signal_name, {n} AS signal_value FROM v_latest " for n in SIG)
VIEWS["v_contrib"] = f"""
SELECT p.pseudonym_id, {_names}[CAST(bit AS INT) + 1] AS signal_name, phi AS contribution, signal_value,
       row_number() OVER (PARTITION BY p.pseudonym_id ORDER BY phi DESC, {_names}[CAST(bit AS INT) + 1]) AS position
FROM v_phi p JOIN v_latest_long l ON l.pseudonym_id = p.pseudonym_id
  AND l.signal_name = {_names}[CAST(bit AS INT) + 1]"""
VIEWS["v_factors"] = "SELECT * FROM v_contrib WHERE contribution > 0 AND position <= 3"
VIEWS["v_medians"] = """
SELECT signal_name, median(round_even(signal_value, 1)) AS median FROM v_latest_long GROUP BY signal_name"""


def values(rows: list[tuple], names: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return "'" + str(v).replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") t({names})"


def _library() -> None:
    from fettle.sources import library

    VIEWS["v_library"] = values(
        [(i, *r) for i, r in enumerate(library.INTERVENTIONS)],
        "position, id, title, signals, levels, attributions, priority, recipient, action_owner, description")
    VIEWS["v_questions"] = values(
        [(i, q[0], q[1], q[2], q[3], "free_text" if q[4] else "scale", q[5])
         for i, q in enumerate(library.QUESTIONS)],
        "position, question_id, group_signal, signal_name, reverse_scored, kind, text")


_library()
VIEWS["v_rec"] = """
SELECT * FROM (
  SELECT c.pseudonym_id, l.id, l.title, l.description, l.action_owner, l.recipient, l.priority,
         c.confidence_level = 'Low' AS low_confidence,
         row_number() OVER (PARTITION BY c.pseudonym_id ORDER BY l.priority, l.position) AS rank
  FROM v_cases c JOIN v_library l ON list_contains(l.levels, c.risk_level)
    AND list_contains(l.attributions, c.risk_attribution)
    AND EXISTS (SELECT 1 FROM v_top t WHERE t.pseudonym_id = c.pseudonym_id
                AND list_contains(l.signals, t.signal_name))
  WHERE c.risk_level <> 'Normal') WHERE rank <= 3"""
VIEWS["v_top"] = """
SELECT pseudonym_id, signal_name FROM v_factors UNION ALL
SELECT pseudonym_id, signal_name FROM v_latest_long
WHERE signal_value > 0 AND pseudonym_id NOT IN (SELECT pseudonym_id FROM v_factors)"""
VIEWS["v_alerts"] = """
SELECT 'personal_notification__' || pseudonym_id AS alert_id, 'personal_notification' AS rule_id,
       'personnel' AS recipient_role, CASE risk_level WHEN 'Moderate' THEN 'medium' ELSE 'high' END AS priority,
       pseudonym_id, NULL AS unit_id, snapshot_date FROM v_cases WHERE risk_level IN ('Moderate', 'High')
UNION ALL SELECT 'officer_alert_high__' || pseudonym_id, 'officer_alert_high', 'welfare_officer', 'high', pseudonym_id,
       NULL, snapshot_date FROM v_cases WHERE risk_level = 'High' AND confidence_level <> 'Low'
UNION ALL SELECT 'officer_alert_persistent__' || pseudonym_id, 'officer_alert_persistent', 'welfare_officer', 'medium',
       pseudonym_id, NULL, snapshot_date FROM v_cases
       WHERE risk_level <> 'High' AND is_officer_visible AND confidence_level <> 'Low'
UNION ALL SELECT 'officer_alert_rising_high__' || pseudonym_id, 'officer_alert_rising_high', 'welfare_officer',
       'urgent', pseudonym_id, NULL, snapshot_date FROM v_cases
       WHERE risk_level = 'High' AND trend_direction = 'Rising' AND confidence_level <> 'Low'
UNION ALL SELECT 'commander_near_miss__' || unit_id, 'commander_near_miss', 'commander', 'high', NULL, unit_id,
       last_detected FROM v_find"""
_n = len(VIEWS) and 21
VIEWS["v_checkins"] = f"""
SELECT r.pseudonym_id, e.event_id AS submission_id, e.ts AS submitted_at, q.question_id,
       CAST((e.k + i) % 5 AS INT) AS value, CASE WHEN q.question_id IN ('GEN03', 'LVE01') THEN 'note' END AS text
FROM v_ev e JOIN v_roster r USING (personnel_id) CROSS JOIN range(3) t(i)
JOIN v_questions q ON q.position = (e.event_id + 7 * i) % {_n} WHERE e.event_type = 'view'"""
VIEWS["v_last_sub"] = """
SELECT * FROM v_checkins c WHERE (submitted_at, submission_id) = (
  SELECT max((submitted_at, submission_id)) FROM v_checkins x WHERE x.pseudonym_id = c.pseudonym_id)"""
VIEWS["v_compared"] = """
SELECT a.pseudonym_id, a.signal_name, a.self_reported_strain, l.signal_value AS recorded_value, a.question_ids,
       a.self_reported_strain - l.signal_value AS difference,
       CASE WHEN a.self_reported_strain - l.signal_value < -30e0 THEN 'self_report_below_record'
            WHEN a.self_reported_strain - l.signal_value > 30e0 THEN 'self_report_above_record' ELSE 'aligned' END
         AS classification
FROM (SELECT c.pseudonym_id, q.signal_name,
             avg(CASE WHEN q.reverse_scored THEN (1e0 - c.value / 4e0) * 100e0 ELSE c.value / 4e0 * 100e0 END)
               AS self_reported_strain, string_agg(q.question_id, ',' ORDER BY q.question_id) AS question_ids
      FROM (SELECT c.* FROM v_checkins c JOIN (SELECT pseudonym_id, max(submitted_at) AS m FROM v_checkins
            GROUP BY pseudonym_id) x ON x.pseudonym_id = c.pseudonym_id AND x.m = c.submitted_at) c
      JOIN v_questions q ON q.question_id = c.question_id WHERE q.kind = 'scale' AND q.signal_name <> ''
      GROUP BY c.pseudonym_id, q.signal_name) a
JOIN (SELECT * FROM v_latest_long UNION ALL SELECT pseudonym_id, 'voice_stress_signal', voice_stress_signal FROM v_latest) l
  USING (pseudonym_id, signal_name)"""
VIEWS["v_access"] = f"""
SELECT event_id AS id, ts AS at, CASE event_type WHEN 'click' THEN 'personnel' WHEN 'error' THEN 'commander'
       ELSE 'welfare_officer' END AS actor_role, printf('S%03d', k) AS actor_subject, event_type AS action,
       {hmac('personnel_id')} AS pseudonym_id, CASE WHEN k < 80 THEN 'granted' ELSE 'refused' END AS outcome FROM v_ev"""
_ids = "[" + ", ".join(f"'{r[0]}'" for r in __import__("fettle.sources.library", fromlist=["x"]).INTERVENTIONS) \
    + ", 'not_in_library']"
VIEWS["v_action_log"] = f"""
SELECT event_id AS id, ts AS at, {hmac('personnel_id')} AS pseudonym_id, {_ids}[k % 11 + 1] AS intervention_id,
       ['offered', 'arranged', 'completed', 'not_pursued', 'unheard_of'][CAST(event_id % 5 + 1 AS INT)] AS status,
       'welfare_officer' AS actor_role, repeat('x', CAST(trunc(value * 5) AS INT)) AS note
FROM v_ev WHERE event_type IN ('purchase', 'signup')"""
VIEWS["v_action_checked"] = """
SELECT *, CASE WHEN intervention_id NOT IN (SELECT id FROM v_library) THEN 'unknown intervention'
               WHEN status NOT IN ('offered', 'arranged', 'completed', 'not_pursued') THEN 'unknown status'
               WHEN length(note) > 1000 THEN 'note too long' END AS problem FROM v_action_log"""
VIEWS["v_actions"] = "SELECT * EXCLUDE (problem) FROM v_action_checked WHERE problem IS NULL"


def compose(body: str) -> str:
    """``body`` with every view it needs, deepest first."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in dict.fromkeys(re.findall(r"\bv_\w+", VIEWS[name])):
            if other in VIEWS:
                visit(other)
        done.append(name)

    for name in dict.fromkeys(re.findall(r"\bv_\w+", body)):
        if name in VIEWS:
            visit(name)
    if not done:
        return body
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in done) + " " + body
