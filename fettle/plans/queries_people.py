"""Features, signals, acoustic baselines, models and person-level analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle import texts
from fettle.operators import acoustic, analytics, explain, scoring, signals
from fettle.operators import features as feat
from fettle.plans.catalog import query
from fettle.plans.oracle_views import FEATURE_INDEX, REF, SIG, VIEWS, bucket, hmac, signal_index, values
from fettle.sources import library

K = "pseudonym_id snapshot_date "


# --- F ------------------------------------------------------------------------
@query("snapshot_dates_f01", "c_custkey# snapshot_date", f"""
SELECT c_custkey, {REF} - CAST(c_custkey % 7 AS INT) - CAST(30 * i AS INT) AS snapshot_date
FROM customer CROSS JOIN range(6) t(i)""")
def f01(w):
    ref = F.date_sub(F.to_date(F.lit(P.REFERENCE_DATE.isoformat())), (F.col("c_custkey") % 7).cast("int"))
    return feat.snapshot_dates(w.table("customer").select("c_custkey"), ref)


@query("person_snapshot_grid_f02", K + "unit_id posting_type is_jawan_rank family_separated", "SELECT * FROM v_grid")
def f02(w):
    return feat.grid(w.private["personnel"], w.snapshots)


def _feature(name: str, spec: str, source: str = "v_features") -> None:
    @query(name, K + spec, f"SELECT * FROM {source}")
    def plan(w, _spec=spec):
        return w.features


_feature("days_since_last_leave_f03", "days_since_last_leave*", "v_hr")
_feature("leave_days_past_year_f04", "total_leave_days_past_year*", "v_hr")
_feature("leave_entitlement_used_f05", "leave_entitlement_used_pct*", "v_hr")
_feature("current_deployment_months_f06", "current_deployment_length_months*", "v_hr")
_feature("deployments_past_two_years_f07", "deployment_count_past_2yrs*", "v_hr")
_feature("months_in_posting_f08", "time_in_current_posting_months*", "v_hr")
_feature("transfers_past_two_years_f09", "transfer_count_past_2yrs*", "v_hr")
_feature("days_since_last_transfer_f10", "time_since_last_transfer_days*", "v_hr")
_feature("newest_duty_month_f11", "duty_hours_last_month* workload_deviation_pct* holiday_weekly_off_availed_pct* "
         "schedule_irregularity_sd* night_shifts_last_month*", "v_hr")
_feature("training_past_quarter_f12", "training_hours_last_3months*", "v_hr")
_feature("baseline_reliable_f18", "baseline_is_reliable", "v_baseline")
_feature("personal_deviation_f19", "duty_hours_personal_deviation_z* schedule_sd_personal_deviation_z* "
         "night_shifts_personal_deviation_z*", "v_baseline")
_feature("assembled_features_f21", "unit_id posting_type days_since_last_leave* duty_hours_30d* leave_days_change_ratio* "
         "baseline_observations* duty_hours_personal_deviation_z*")


@query("prorated_duty_hours_f13", K + "duty_hours_7d* duty_hours_30d* duty_hours_90d*", "SELECT * FROM v_f_prorated")
def f13(w):
    return feat.duty_aggregates(w.private["duty_logs"], w.snapshots)


@query("event_sums_in_windows_f14", K + "leave_days_7d* leave_days_30d* leave_days_90d* training_hours_7d* "
       "training_hours_30d* training_hours_90d*",
       "SELECT * FROM v_f_leave JOIN v_f_training USING (pseudonym_id, snapshot_date)")
def f14(w):
    return feat.temporal_windows(w.private, w.snapshots)


@query("change_ratios_f15", K + "duty_hours_change_ratio* leave_days_change_ratio* training_hours_change_ratio*",
       "SELECT * FROM v_windows")
def f15(w):
    return feat.temporal_windows(w.private, w.snapshots)


@query("window_matrix_f16", K + " ".join(c + "*" for c in feat.WINDOW_FEATURES), "SELECT * FROM v_windows")
def f16(w):
    return feat.temporal_windows(w.private, w.snapshots)


@query("personal_baseline_f17", K + "baseline_duty_hours_mean* baseline_duty_hours_sd* baseline_observations*",
       "SELECT * FROM v_baseline")
def f17(w):
    return feat.baselines(w.private, w.snapshots)


@query("baseline_matrix_f20", K + " ".join(c if c == "baseline_is_reliable" else c + "*" for c in feat.BASELINE_FEATURES),
       "SELECT * FROM v_baseline")
def f20(w):
    return feat.baselines(w.private, w.snapshots)


@query("assembly_row_check_f21", "row_count# distinct_keys# duplicate_rows#", """
SELECT count(*) AS row_count, count(DISTINCT (pseudonym_id, snapshot_date)) AS distinct_keys, 0 AS duplicate_rows
FROM v_features""")
def f21(w):
    three = feat.assemble(feat.hr_features(w.private, w.snapshots), feat.temporal_windows(w.private, w.snapshots),
                          feat.baselines(w.private, w.snapshots))
    return feat.key_check(three)


@query("modelling_set_f22", K + "welfare_risk_score* label* split", "SELECT * FROM v_model")
def f22(w):
    return w.modelling


# --- G ------------------------------------------------------------------------
def _signal(key: str, name: str) -> None:
    @query(key, K + name + "*", "SELECT * FROM v_signals")
    def plan(w):
        return w.features.select("pseudonym_id", "snapshot_date", signals.REGISTRY[name][0]().alias(name))


for _i, _key in enumerate(("workload_signal_g01", "recovery_signal_g02", "deployment_signal_g03",
                           "irregularity_signal_g04", "hardship_signal_g05", "churn_signal_g06",
                           "training_signal_g07", "leave_deficit_signal_g08", "family_separation_signal_g09")):
    _signal(_key, SIG[_i])

VIEWS["v_acoustic"] = f"""
SELECT {hmac("printf('P%05d', label)")} AS pseudonym_id, {REF} - CAST((vec_id * 7) % 170 AS INT) AS sample_date,
       printf('V%d', vec_id) AS sample_id, embedding
FROM embeddings WHERE vec_id % 23 <> 0"""
VIEWS["v_aseq"] = """
SELECT *, row_number() OVER (PARTITION BY pseudonym_id ORDER BY sample_date, sample_id) AS n FROM v_acoustic"""
_names = "[" + ", ".join(f"'{f}'" for f in P.ACOUSTIC_FEATURES) + "]"
VIEWS["v_along"] = f"""
SELECT pseudonym_id, sample_date, sample_id, n, {_names}[CAST(i AS INT)] AS feature, i,
       CAST(embedding[CAST(i AS INT)] AS DOUBLE) AS value FROM v_aseq CROSS JOIN range(1, 8) t(i)"""
VIEWS["v_abase"] = """
SELECT pseudonym_id, feature, c AS centre, greatest(iqr / 1.349e0, abs(c) * 0.02e0) AS scale, observations
FROM (SELECT pseudonym_id, feature, median(value) AS c, count(*) AS observations,
             quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
      FROM v_along WHERE n <= 3 GROUP BY pseudonym_id, feature)"""
VIEWS["v_abase_all"] = """
SELECT pseudonym_id, feature, c AS centre, greatest(iqr / 1.349e0, abs(c) * 0.02e0) AS scale, observations
FROM (SELECT pseudonym_id, feature, median(value) AS c, count(*) AS observations,
             quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
      FROM v_along GROUP BY pseudonym_id, feature)"""
FOLD_SQL = """
WITH RECURSIVE fold(pseudonym_id, feature, n, sample_id, sample_date, value, prior_centre, prior_scale, centre, scale) AS (
  SELECT pseudonym_id, feature, CAST(3 AS BIGINT), NULL::VARCHAR, NULL::DATE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE,
         centre, scale FROM v_abase
  UNION ALL
  SELECT f.pseudonym_id, f.feature, a.n, a.sample_id, a.sample_date, a.value, f.centre, f.scale,
         0.7e0 * f.centre + 0.3e0 * a.value,
         greatest((0.7e0 * (f.scale / 1.2533e0) + 0.3e0 * abs(a.value - f.centre)) * 1.2533e0,
                  abs(0.7e0 * f.centre + 0.3e0 * a.value) * 0.02e0)
  FROM fold f JOIN v_along a ON a.pseudonym_id = f.pseudonym_id AND a.feature = f.feature AND a.n = f.n + 1)
SELECT * FROM fold WHERE n > 3"""
VIEWS["v_fold"] = FOLD_SQL
_weights = "CASE feature " + " ".join(f"WHEN '{f}' THEN {v}e0" for f, v in P.ACOUSTIC_WEIGHTS.items()) + " END"
VIEWS["v_stress"] = f"""
SELECT s.pseudonym_id, s.sample_id, s.sample_date, s.n > 3 AS is_reliable,
       100e0 * sum(w * least(1e0, greatest(0e0, z) / 3e0)) / sum(w) AS voice_stress_signal
FROM v_aseq s LEFT JOIN (
  SELECT pseudonym_id, sample_id, {_weights} AS w, CASE WHEN feature = 'pause_ratio' THEN -1 ELSE 1 END
         * (value - prior_centre) / prior_scale AS z FROM v_fold) f USING (pseudonym_id, sample_id)
GROUP BY s.pseudonym_id, s.sample_id, s.sample_date, s.n"""
VIEWS["v_voice"] = """
SELECT pseudonym_id, s AS snapshot_date, arg_max(voice_stress_signal, (sample_date, sample_id)) AS voice_stress_signal
FROM v_stress JOIN v_snaps ON sample_date <= s AND sample_date >= s - 30 WHERE is_reliable
GROUP BY pseudonym_id, s"""
VIEWS["v_with_voice"] = """
SELECT s.* EXCLUDE (voice_stress_signal, voice_signal_present), coalesce(v.voice_stress_signal, 0e0)
  AS voice_stress_signal, CASE WHEN v.pseudonym_id IS NULL THEN 0e0 ELSE 1e0 END AS voice_signal_present
FROM v_signals s LEFT JOIN v_voice v USING (pseudonym_id, snapshot_date)"""
ALL_SIGNALS = " ".join(n + "*" for n in P.MODEL_INPUTS)


@query("all_signals_with_voice_g10", K + "unit_id " + ALL_SIGNALS, "SELECT * FROM v_with_voice")
def g10(w):
    return signals.behavioral_signals(w.features, w.voice)


@query("voice_coverage_g11", "voice_coverage* row_count#",
       "SELECT avg(voice_signal_present) AS voice_coverage, count(*) AS row_count FROM v_with_voice")
def g11(w):
    return signals.voice_coverage(g10(w))


# --- A ------------------------------------------------------------------------
LENGTH, HOP = 16, 4
VIEWS["v_wave"] = """
SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE - list_avg(list_transform(embedding, lambda y: y::DOUBLE)))
  AS wave FROM embeddings"""
VIEWS["v_frames"] = """
SELECT vec_id, CAST(i AS INT) AS i, sqrt(list_sum(list_transform(wave[CAST(i * 4 + 1 AS INT):CAST(i * 4 + 16 AS INT)],
  lambda x: x * x)) / 16e0) AS rms FROM v_wave CROSS JOIN range(13) t(i)"""
VIEWS["v_active"] = """
SELECT *, rms > 0.7e0 * max(rms) OVER (PARTITION BY vec_id) AS loud FROM v_frames"""


def frames(w) -> DataFrame:
    """Embeddings as short waveforms; a high threshold, since noise has no real silence."""
    emb = w.table("embeddings").select("vec_id", F.col("embedding").alias("waveform"))
    base = acoustic.with_frames(emb, LENGTH, HOP)
    return base.withColumn("active", acoustic.active_mask(F.col("rms"), 0.7))


@query("frame_energy_a01", "vec_id# i# rms*", "SELECT vec_id, i, rms FROM v_frames")
def a01(w):
    return frames(w).select("vec_id", F.posexplode("rms").alias("i", "rms"))


@query("silence_trimmed_a02", "vec_id# active_frames# kept_length#", """
SELECT vec_id, count(*) FILTER (loud) AS active_frames,
       least(64, max(i) FILTER (loud) * 4 + 16) - min(i) FILTER (loud) * 4 AS kept_length FROM v_active GROUP BY vec_id""")
def a02(w):
    kept = acoustic.trimmed(F.col("waveform"), F.col("active"), LENGTH, HOP)
    return frames(w).select("vec_id", F.size(F.filter("active", lambda a: a)).alias("active_frames"),
                            F.size(kept).alias("kept_length"))


@query("pauses_and_intensity_a03", "vec_id# pause_ratio* intensity_rms_mean* intensity_rms_sd* intensity_rms_cv*", """
SELECT vec_id, 1e0 - count(*) FILTER (loud) / count(*) AS pause_ratio, avg(rms) FILTER (loud) AS intensity_rms_mean,
       coalesce(stddev_samp(rms) FILTER (loud), 0e0) AS intensity_rms_sd,
       coalesce(stddev_samp(rms) FILTER (loud), 0e0) / avg(rms) FILTER (loud) AS intensity_rms_cv
FROM v_active GROUP BY vec_id""")
def a03(w):
    return acoustic.intensity(frames(w))


@query("active_runs_a04", "vec_id# run_start# run_end#", """
SELECT vec_id, min(i) AS run_start, max(i) + 1 AS run_end FROM (
  SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM v_active WHERE loud)
GROUP BY vec_id, island HAVING count(*) >= 3""")
def a04(w):
    return frames(w).select("vec_id", F.explode(acoustic.active_runs(F.col("active"))).alias("r")).select(
        "vec_id", F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"))


VIEWS["v_smooth"] = """
SELECT vec_id, i, (coalesce(lag(rms) OVER w, 0e0) + rms + coalesce(lead(rms) OVER w, 0e0)) / 3e0 AS e
FROM v_frames WINDOW w AS (PARTITION BY vec_id ORDER BY i)"""
VIEWS["v_tops"] = """
SELECT vec_id, i, e FROM (SELECT *, lag(e) OVER w AS l, lead(e) OVER w AS r FROM v_smooth
  WINDOW w AS (PARTITION BY vec_id ORDER BY i)) WHERE e > l AND e > r"""
VIEWS["v_greedy"] = """
SELECT vec_id, unnest(list_reduce(list([i] ORDER BY e DESC, i DESC),
  lambda acc, p: CASE WHEN len(list_filter(acc, lambda q: abs(q - p[1]) < 3)) > 0 THEN acc ELSE acc || p END)) AS i
FROM v_tops GROUP BY vec_id"""
VIEWS["v_prominent"] = """
SELECT g.vec_id, g.i, p.e - greatest(
  (SELECT min(s.e) FROM v_smooth s WHERE s.vec_id = g.vec_id AND s.i <= g.i AND s.i > coalesce(
     (SELECT max(h.i) FROM v_smooth h WHERE h.vec_id = g.vec_id AND h.i < g.i AND h.e > p.e), -1)),
  (SELECT min(s.e) FROM v_smooth s WHERE s.vec_id = g.vec_id AND s.i >= g.i AND s.i < coalesce(
     (SELECT min(h.i) FROM v_smooth h WHERE h.vec_id = g.vec_id AND h.i > g.i AND h.e > p.e), 999))) AS prominence
FROM v_greedy g JOIN v_smooth p ON p.vec_id = g.vec_id AND p.i = g.i"""


@query("syllable_rate_a05", "vec_id# syllables# speaking_rate*", """
SELECT s.vec_id, count(p.i) AS syllables, count(p.i) / 2e0 AS speaking_rate
FROM (SELECT vec_id, max(e) - min(e) AS span FROM v_smooth GROUP BY vec_id) s
LEFT JOIN v_prominent p ON p.vec_id = s.vec_id AND p.prominence >= s.span * 0.15e0 GROUP BY s.vec_id""")
def a05(w):
    return acoustic.speaking_rate(frames(w), F.lit(2.0), distance=3)


@query("early_baseline_a06", "pseudonym_id feature centre* scale* observations#", "SELECT * FROM v_abase")
def a06(w):
    return acoustic.early_baseline(w.samples)


@query("moving_baseline_a07", "pseudonym_id feature sample_id prior_centre* prior_scale* centre* scale*",
       "SELECT * FROM v_fold")
def a07(w):
    return acoustic.ema_fold(w.samples)


@query("stress_before_folding_a08", "pseudonym_id sample_id sample_date is_reliable voice_stress_signal*",
       "SELECT * FROM v_stress")
def a08(w):
    return acoustic.stress_signals(w.samples)


@query("sequential_processing_a09", "pseudonym_id results# reliable# final_checkin", """
SELECT pseudonym_id, count(*) AS results, count(*) FILTER (is_reliable) AS reliable, max(sample_date) AS final_checkin
FROM v_stress GROUP BY pseudonym_id""")
def a09(w):
    return acoustic.stress_signals(w.samples).groupBy("pseudonym_id").agg(
        F.count(F.lit(1)).alias("results"), F.count_if("is_reliable").alias("reliable"),
        F.max("sample_date").alias("final_checkin"))


@query("checkins_aligned_to_snapshots_a10", K + "voice_stress_signal*", "SELECT * FROM v_voice")
def a10(w):
    return w.voice


@query("baselines_of_everybody_a11", "pseudonym_id feature centre* scale* observations#", "SELECT * FROM v_abase_all")
def a11(w):
    return acoustic.full_baseline(w.samples)


# --- M ------------------------------------------------------------------------
@query("person_codes_m01", "personnel_id code#", """
SELECT DISTINCT personnel_id, ('0x' || substr(md5(personnel_id), 1, 12))::BIGINT AS code FROM v_roster""")
def m01(w):
    return w.roster_keys.select("personnel_id", scoring.person_code(F.col("personnel_id")).alias("code"))


@query("train_test_split_m02", "personnel_id is_test",
       f"SELECT personnel_id, {bucket('personnel_id', P.SEED)} < 20 AS is_test FROM v_roster")
def m02(w):
    return scoring.with_split(w.roster_keys, "personnel_id").withColumn("is_test", F.col("split") == "test")


@query("calibration_carve_m03", "split people# n#",
       "SELECT split, count(DISTINCT pseudonym_id) AS people, count(*) AS n FROM v_model GROUP BY split")
def m03(w):
    return w.modelling.groupBy("split").agg(F.countDistinct("pseudonym_id").alias("people"),
                                            F.count(F.lit(1)).alias("n"))


@query("regression_metrics_m12", "n# mae* rmse* r2*", """
SELECT count(*) AS n, avg(abs(label - welfare_risk_score)) AS mae, sqrt(avg((label - welfare_risk_score) ** 2)) AS rmse,
       1e0 - avg((label - welfare_risk_score) ** 2) / var_pop(label) AS r2 FROM v_model WHERE split = 'test'""")
def m12(w):
    return scoring.regression_metrics(w.modelling.filter(F.col("split") == "test"), "label", scoring.SCORE)


@query("band_metrics_m13", "band_accuracy* high_recall* high_precision* escalation_recall*", """
SELECT avg(CASE WHEN t = p THEN 1e0 ELSE 0e0 END) AS band_accuracy,
       count(*) FILTER (t = 'High' AND p = 'High') / nullif(count(*) FILTER (t = 'High'), 0) AS high_recall,
       count(*) FILTER (t = 'High' AND p = 'High') / nullif(count(*) FILTER (p = 'High'), 0) AS high_precision,
       count(*) FILTER (t <> 'Normal' AND p <> 'Normal') / nullif(count(*) FILTER (t <> 'Normal'), 0)
         AS escalation_recall
FROM (SELECT CASE WHEN label >= 65 THEN 'High' WHEN label >= 40 THEN 'Moderate' ELSE 'Normal' END AS t, risk_level AS p
      FROM v_model WHERE split = 'test')""")
def m13(w):
    return scoring.band_metrics(w.modelling.filter(F.col("split") == "test"), "label", scoring.SCORE)


@query("model_selection_m14", "best_tree best_other gap* selected selected_is_tree", """
SELECT best_tree, best_other, o - t AS gap, CASE WHEN o - t > 0.02 THEN best_other ELSE best_tree END AS selected,
       NOT o - t > 0.02 AS selected_is_tree
FROM (SELECT arg_max(m, r2) FILTER (tree) AS best_tree, max(r2) FILTER (tree) AS t,
             arg_max(m, r2) FILTER (NOT tree) AS best_other, max(r2) FILTER (NOT tree) AS o FROM (
  SELECT posting_type || '_tree' AS m, true AS tree, 1e0 - avg((label - welfare_risk_score) ** 2) / var_pop(label) AS r2
  FROM v_model GROUP BY posting_type UNION ALL
  SELECT unit_id || '_linear', false, 1e0 - avg((label - welfare_risk_score) ** 2) / var_pop(label)
  FROM v_model GROUP BY unit_id))""")
def m14(w):
    def measured(by, suffix, tree):
        e = F.col("label") - F.col(scoring.SCORE)
        return w.modelling.groupBy(by).agg(
            (F.lit(1.0) - F.avg(e * e) / F.var_pop("label")).alias("r2")).select(
            F.concat(F.col(by), F.lit(suffix)).alias("model_name"), F.lit(tree).alias("is_tree"), "r2")
    return scoring.select_model(measured("posting_type", "_tree", True).unionByName(
        measured("unit_id", "_linear", False)))


@query("conformal_half_width_m16", "calibration_rows# calibration_people# quantile_rank# half_width*",
       "SELECT * FROM v_cal")
def m16(w):
    return w.calibration


@query("conformal_interval_m17", K + "interval_low* interval_high*", "SELECT * FROM v_classified")
def m17(w):
    return scoring.with_interval(w.scored, w.calibration)


@query("empirical_coverage_m18", "coverage* n#", """
SELECT avg(CASE WHEN abs(label - welfare_risk_score) <= half_width THEN 1e0 ELSE 0e0 END) AS coverage, count(*) AS n
FROM v_model CROSS JOIN v_cal WHERE split = 'test'""")
def m18(w):
    return scoring.empirical_coverage(
        w.modelling.filter(F.col("split") == "test"), "label", scoring.SCORE, w.calibration)


@query("composite_index_m22", K + "score*",
       f"SELECT pseudonym_id, snapshot_date, {FEATURE_INDEX} AS score FROM v_features")
def m22(w):
    return w.features.withColumn("score", scoring.composite_index())


@query("background_sample_m23", "pseudonym_id snapshot_date workload_deviation_signal*",
       "SELECT bg_id AS pseudonym_id, snapshot_date, b0 AS workload_deviation_signal FROM v_bg")
def m23(w):
    return explain.background(w.behaviour)


@query("exact_shapley_m24", "pseudonym_id signal_name contribution* signal_value*", "SELECT * FROM v_contrib")
def m24(w):
    return explain.contributions(w.shapley, w.latest_signals)


@query("shapley_local_accuracy_m24", "cases# violations#", """
SELECT count(*) AS cases, count(*) FILTER (abs(s - (p - b)) > 0.000001 * greatest(1, abs(p))) AS violations FROM (
  SELECT pseudonym_id, sum(phi) AS s FROM v_phi GROUP BY pseudonym_id) JOIN (
  SELECT pseudonym_id, max(v) FILTER (m = 511) AS p, max(v) FILTER (m = 0) AS b FROM v_coalitions GROUP BY pseudonym_id)
USING (pseudonym_id)""")
def m24b(w):
    return explain.additivity(w.shapley)


@query("top_factors_m25", "pseudonym_id position# signal_name contribution*", "SELECT * FROM v_factors")
def m25(w):
    return w.factors


@query("population_medians_m26", "signal_name median*", "SELECT * FROM v_medians")
def m26(w):
    return w.medians


VIEWS["v_med_row"] = "SELECT " + ", ".join(
    f"max(median) FILTER (signal_name = '{n}') AS m{i}" for i, n in enumerate(SIG)) + " FROM v_medians"
VIEWS["v_published"] = ("SELECT pseudonym_id, welfare_risk_score, "
                        + ", ".join(f"round_even({n}, 1) AS {n}" for n in SIG) + " FROM v_latest")
VIEWS["v_sweep"] = " UNION ALL ".join(
    f"SELECT pseudonym_id, '{n}' AS signal_name, {n} AS current_value, m{i} AS reference_value, "
    f"round_even(welfare_risk_score, 1) AS cur, "
    + signal_index({s: (f"m{i}" if s == n else s) for s in SIG}) + " AS projected_score FROM v_published CROSS JOIN v_med_row"
    for i, n in enumerate(SIG))


def _published(w):
    """Signals and score as published: one decimal, ties to even."""
    return w.latest_signals.select(
        "pseudonym_id", F.bround(F.col(scoring.SCORE), 1).alias(scoring.SCORE),
        *[F.bround(F.col(c), 1).alias(c) for c in P.SIGNALS])


@query("counterfactual_sweep_m27", "pseudonym_id position# signal_name current_value* reference_value* projected_score* "
       "reduction* would_leave_high_band would_leave_officer_queue", """
SELECT *, row_number() OVER (PARTITION BY pseudonym_id ORDER BY reduction DESC, signal_name) AS position,
       cur >= 65 AND projected_score < 65 AS would_leave_high_band,
       cur >= 40 AND projected_score < 40 AS would_leave_officer_queue
FROM (SELECT *, cur - projected_score AS reduction FROM v_sweep) WHERE abs(reduction) >= 0.5""")
def m27(w):
    return explain.sweep(_published(w), w.medians)


@query("counterfactual_summary_m27", "pseudonym_id current_score* current_level entries# decisive_count# largest_lever", """
SELECT c.pseudonym_id, round_even(welfare_risk_score, 1) AS current_score,
       CASE WHEN round_even(welfare_risk_score, 1) >= 65 THEN 'High' WHEN round_even(welfare_risk_score, 1) >= 40
            THEN 'Moderate' ELSE 'Normal' END AS current_level,
       count(s.signal_name) AS entries, count(*) FILTER (cur >= 65 AND projected_score < 65) AS decisive_count,
       arg_min(s.signal_name, (-(cur - projected_score), s.signal_name)) AS largest_lever
FROM v_latest c LEFT JOIN v_sweep s ON s.pseudonym_id = c.pseudonym_id AND abs(cur - projected_score) >= 0.5
GROUP BY c.pseudonym_id, welfare_risk_score""")
def m27b(w):
    return explain.sweep_summary(_published(w), m27(w))


@query("what_if_m28", "pseudonym_id current_score* projected_score* change*", f"""
SELECT *, projected_score - current_score AS change FROM (
  SELECT pseudonym_id, {signal_index({n: n for n in SIG})} AS current_score,
         {signal_index({**{n: n for n in SIG}, SIG[0]: "coalesce(o0, " + SIG[0] + ")", SIG[1]: "coalesce(o1, " + SIG[1] + ")"})}
           AS projected_score
  FROM v_latest JOIN (
    SELECT pseudonym_id, max(v) FILTER (s = 0) AS o0, max(v) FILTER (s = 1) AS o1 FROM (
      SELECT pseudonym_id, event_id % 3 AS s, max(value) AS v FROM v_ev JOIN v_roster USING (personnel_id)
      WHERE event_type = 'error' AND value BETWEEN 0 AND 100 AND event_id % 3 < 2 GROUP BY ALL) GROUP BY pseudonym_id)
  USING (pseudonym_id))""")
def m28(w):
    name = F.element_at(F.array(F.lit(SIG[0]), F.lit(SIG[1]), F.lit("voice_stress_signal")),
                        (F.col("event_id") % 3 + 1).cast("int"))
    asked = w.access_log.filter(F.col("action") == "error").join(
        w.events.select(F.col("event_id"), "value"), F.col("id") == F.col("event_id")).select(
        "pseudonym_id", name.alias("signal_name"), F.col("value").alias("new_value"))
    return explain.what_if(w.latest_signals, asked)


# --- R ------------------------------------------------------------------------
@query("risk_bands_r01", K + "welfare_risk_score* risk_level", "SELECT * FROM v_scored")
def r01(w):
    return w.scored


@query("bands_spanned_r02", K + "band_certainty bands", """
SELECT pseudonym_id, snapshot_date, band_certainty, array_to_string(list_filter(['Normal', 'Moderate', 'High'],
  lambda b: CASE b WHEN 'Normal' THEN interval_low < 40 WHEN 'Moderate' THEN interval_high >= 40 AND interval_low < 65
            ELSE interval_high >= 65 END), ',') AS bands FROM v_classified""")
def r02(w):
    return w.classified.withColumn("bands", F.concat_ws(",", "bands_plausible"))


def said(text: str, *values: str) -> str:
    return f"""printf('{text.replace("'", "''")}', {', '.join(values)})"""


@query("cutoff_proximity_r03", K + "distance_to_next_band* distance_to_band_below* barely_over_cutoff "
       "barely_under_next_band proximity_note", f"""
SELECT *, CASE WHEN barely_over_cutoff THEN {said(texts.BARELY_OVER, 'distance_to_band_below', 'risk_level')}
               WHEN barely_under_next_band THEN {said(texts.BARELY_UNDER, 'distance_to_next_band', 'risk_level')} END
  AS proximity_note FROM v_classified""")
def r03(w):
    return w.classified


@query("band_distribution_r04", "kind value n#", """
SELECT 'level' AS kind, v AS value, (SELECT count(*) FROM v_cases WHERE risk_level = v) AS n
FROM (VALUES ('Normal'), ('Moderate'), ('High')) t(v) UNION ALL
SELECT 'certainty', v, (SELECT count(*) FROM v_cases WHERE band_certainty = v) FROM (VALUES ('certain'), ('borderline')) t(v)""")
def r04(w):
    a = analytics.band_distribution(w.cases).select(F.lit("level").alias("kind"), F.col("risk_level").alias("value"), "n")
    b = analytics.band_distribution(w.cases, "band_certainty", ("certain", "borderline")).select(
        F.lit("certainty").alias("kind"), F.col("band_certainty").alias("value"), "n")
    return a.unionByName(b)


@query("score_trend_r05", "pseudonym_id trend_direction slope_per_30_days* points_used# first_score* latest_score*",
       "SELECT * FROM v_trend")
def r05(w):
    return w.trends


@query("trailing_persistence_r06", "pseudonym_id persistence_snapshots# is_persistent", "SELECT * FROM v_trend")
def r06(w):
    return w.trends


@query("trends_by_direction_r07", "trend_direction is_persistent people#",
       "SELECT trend_direction, is_persistent, count(*) AS people FROM v_trend GROUP BY ALL")
def r07(w):
    return w.trends.groupBy("trend_direction", "is_persistent").agg(F.count(F.lit(1)).alias("people"))


@query("completeness_confidence_r08", K + "confidence* confidence_level", """
SELECT *, CASE WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_level
FROM (SELECT pseudonym_id, snapshot_date, 0.4e0 + 0.35e0 + 0.25e0 * CASE WHEN age <= 30 THEN 1e0 WHEN age >= 180 THEN 0e0
      ELSE 1e0 - (age - 30) / 150e0 END AS confidence
FROM v_signals JOIN (SELECT pseudonym_id, CAST(abs(user_id * 13) % 260 AS INT) AS age FROM v_roster) USING (pseudonym_id))""")
def r08(w):
    uid = F.substring("personnel_id", 2, 12).cast("long")
    ages = w.roster_keys.select("pseudonym_id", ((uid * 13) % 260).cast("int").alias("data_age_days"))
    return analytics.with_confidence(w.behaviour, ages)


@query("confidence_frame_r09", K + "confidence* confidence_level", "SELECT * FROM v_scored")
def r09(w):
    return w.scored


@query("unit_aggregates_r10", "unit_id personnel_count# mean_risk* median_risk* elevated_share* high_share* "
       "is_systemically_strained is_suppressed", "SELECT * FROM v_units")
def r10(w):
    return w.unit_stats


@query("attribution_r11", K + "unit_mean* points_above_unit* risk_attribution attribution_explanation", f"""
SELECT c.*, CASE WHEN c.unit_mean IS NULL THEN '{texts.NO_UNIT.replace("'", "''")}'
  WHEN u.is_systemically_strained AND points_above_unit > 8 THEN {said(texts.MIXED, 'c.unit_mean', 'points_above_unit')}
  WHEN u.is_systemically_strained THEN {said(texts.STRAINED_UNIT, 'c.unit_mean')}
  WHEN points_above_unit > 8 THEN {said(texts.ABOVE_UNIT, 'points_above_unit', 'c.unit_mean')}
  ELSE {said(texts.LIKE_UNIT, 'c.unit_mean')} END AS attribution_explanation
FROM v_classified c LEFT JOIN v_units u USING (unit_id)""")
def r11(w):
    return w.classified


@query("escalation_rule_r12", "pseudonym_id risk_level trend_direction is_persistent is_officer_visible",
       "SELECT * FROM v_cases")
def r12(w):
    return w.cases


@query("answers_as_strain_r13", "submission_id# question_id strain*", """
SELECT submission_id, question_id, CASE WHEN reverse_scored THEN (1e0 - value / 4e0) * 100e0 ELSE value / 4e0 * 100e0 END
  AS strain FROM v_checkins JOIN v_questions USING (question_id) WHERE kind = 'scale'""")
def r13(w):
    flat = w.checkins.select("submission_id", F.inline("answers"))
    scale = w.questions.filter(F.col("kind") == "scale").select("question_id", "reverse_scored")
    return flat.join(F.broadcast(scale), "question_id").withColumn(
        "strain", analytics.answer_strain(F.col("value"), F.col("reverse_scored")))


@query("self_report_comparison_r14", "pseudonym_id signal_name self_reported_strain* recorded_value* difference* "
       "classification question_ids", "SELECT * FROM v_compared")
def r14(w):
    return analytics.personal_view(w.compared)


@query("divergences_r15", "pseudonym_id position# signal_name classification", """
SELECT *, row_number() OVER (PARTITION BY pseudonym_id ORDER BY abs(difference) DESC, signal_name) AS position
FROM v_compared WHERE classification <> 'aligned'""")
def r15(w):
    return analytics.officer_view(analytics.divergences(w.compared))


@query("self_report_notes_r15", "pseudonym_id answered_signal_count# personal_note officer_note", f"""
WITH labelled AS (SELECT c.*, l.label, row_number() OVER (PARTITION BY pseudonym_id ORDER BY
    CASE WHEN classification = 'aligned' THEN 1 ELSE 0 END, abs(difference) DESC, signal_name) AS p
  FROM v_compared c JOIN ({values(list(P.SIGNAL_LABELS.items()), "signal_name, label")}) l USING (signal_name))
SELECT pseudonym_id, count(*) AS answered_signal_count,
  CASE max(classification) FILTER (p = 1) WHEN 'aligned' THEN '{texts.ANSWERS_ALIGNED}'
    WHEN 'self_report_below_record' THEN replace('{texts.ANSWERS_BELOW}', '%s', max(lower(label[1]) || label[2:]) FILTER (p = 1))
    ELSE replace('{texts.ANSWERS_ABOVE}', '%s', max(lower(label[1]) || label[2:]) FILTER (p = 1)) END AS personal_note,
  replace('{texts.OFFICER_DIVERGENCE}', '%s', string_agg(lower(label), ', ' ORDER BY p)
    FILTER (p <= 3 AND classification <> 'aligned')) AS officer_note
FROM labelled GROUP BY pseudonym_id""")
def r15b(w):
    return analytics.self_report_notes(w.compared)


@query("checkin_validation_r16", "submission_id# question_id answer_problem submission_problem", """
SELECT submission_id, question_id, answer_problem, CASE WHEN bool_or(answer_problem IS NOT NULL)
  OVER (PARTITION BY submission_id) THEN 'bad answer' END AS submission_problem
FROM (SELECT c.event_id AS submission_id, c.question_id,
             CASE WHEN c.question_id = '' THEN 'no question id' WHEN q.kind IS NULL THEN 'unknown question'
                  WHEN c.raw IS NOT NULL AND NOT regexp_full_match(c.raw, '[0-9]+') THEN 'not a whole number'
                  WHEN CAST(c.raw AS INT) > 4 THEN 'off the scale' WHEN c.raw IS NULL AND c.text IS NULL THEN 'empty'
                  WHEN q.kind = 'scale' AND c.raw IS NULL THEN 'needs a number'
                  WHEN q.kind = 'free_text' AND c.text IS NULL THEN 'needs text' END AS answer_problem
      FROM (SELECT event_id, CASE k % 24 WHEN 21 THEN '' WHEN 22 THEN 'ZZZ99' WHEN 23 THEN 'ZZZ98' ELSE b.question_id END
                     AS question_id,
                   CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'many'
                        ELSE CAST(event_id % 6 AS VARCHAR) END AS raw,
                   CASE WHEN event_id % 5 = 0 THEN 'words' END AS text
            FROM v_ev LEFT JOIN v_questions b ON b.position = k % 24 WHERE event_type = 'view') c
      LEFT JOIN v_questions q ON q.question_id = c.question_id)""")
def r16(w):
    bank = F.array(*[F.lit(q[0]) for q in library.QUESTIONS], F.lit(""), F.lit("ZZZ99"), F.lit("ZZZ98"))
    e = F.col("event_id")
    raw = w.events.filter(F.col("event_type") == "view").select(
        e.alias("submission_id"), F.element_at(bank, (F.col("k") % 24 + 1).cast("int")).alias("question_id"),
        F.when(e % 7 == 1, "many").when(e % 7 != 0, (e % 6).cast("string")).alias("value"),
        F.when(e % 5 == 0, "words").alias("text"))
    return analytics.validate_answers(raw, w.questions)


@query("gray_area_check_r17", "scope n# high# visible# high_rate* visible_rate*", f"""
SELECT scope, count(*) AS n, count(*) FILTER (risk_level = 'High') AS high, count(*) FILTER (is_officer_visible) AS visible,
       count(*) FILTER (risk_level = 'High') / count(*) AS high_rate,
       count(*) FILTER (is_officer_visible) / count(*) AS visible_rate
FROM (SELECT c.*, unnest(list_filter([grp, CASE WHEN held THEN grp || '_held_out' END, 'profile:' || benign_profile],
             lambda x: x IS NOT NULL)) AS scope
      FROM v_cases c JOIN (SELECT pseudonym_id, benign_profile, CASE WHEN benign_profile IS NULL THEN 'rest'
        ELSE 'benign' END AS grp, {bucket('personnel_id', P.SEED)} < 20 AS held FROM v_roster) r USING (pseudonym_id))
GROUP BY scope""")
def r17(w):
    held = scoring.with_split(w.roster_keys, "personnel_id").select(
        "pseudonym_id", (F.col("split") == "test").alias("held_out"))
    return analytics.gray_area_check(w.cases, w.private["personnel"], held)
