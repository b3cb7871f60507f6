"""Every threshold, weight and list the operators use.

The numbers and word lists below are fixed values: results depend on them
being exactly these, so they are written out plainly and kept together.
"""

from __future__ import annotations

from datetime import date, timedelta

# --- fixed values: time grid -------------------------------------------------
REFERENCE_DATE = date(2026, 9, 1)
SNAPSHOT_COUNT = 6
SNAPSHOT_INTERVAL_DAYS = 30
HISTORY_MONTHS = 24
DAYS_PER_MONTH = 30.44
NEVER_DAYS = HISTORY_MONTHS * DAYS_PER_MONTH
SEED = 26186

# --- fixed values: features --------------------------------------------------
STANDARD_MONTHLY_HOURS = 208.0
LEAVE_ENTITLEMENT_DAYS = 100.0
WINDOW_DAYS = (7, 30, 90)
CHANGE_SHORT_DAYS = 30
CHANGE_LONG_DAYS = 90
MIN_DAILY_RATE = 1e-4
MAX_CHANGE_RATIO = 5.0
BASELINE_LOOKBACK_DAYS = 180
BASELINE_EXCLUDE_DAYS = 30
BASELINE_MIN_OBSERVATIONS = 3
YEAR_DAYS = 365
TWO_YEARS_DAYS = 730
TRAINING_DAYS = 90

# --- fixed values: cleaning bounds -------------------------------------------
MAX_DAILY_DUTY_HOURS = 20.0
MAX_DUTY_DAYS = 31
MAX_LEAVE_SPELL_DAYS = 100.0

# --- fixed values: signals ---------------------------------------------------
SIGNAL_MIN = 0.0
SIGNAL_MAX = 100.0
SIGNALS = (
    "workload_deviation_signal",
    "recovery_pattern_signal",
    "deployment_stability_signal",
    "schedule_irregularity_signal",
    "posting_hardship_signal",
    "transfer_churn_signal",
    "training_load_signal",
    "leave_deficit_signal",
    "family_separation_signal",
)
VOICE_SIGNAL = "voice_stress_signal"
VOICE_FLAG = "voice_signal_present"
MODEL_INPUTS = SIGNALS + (VOICE_SIGNAL, VOICE_FLAG)
SIGNAL_LABELS = {
    "workload_deviation_signal": "Duty hours above the standard workload",
    "recovery_pattern_signal": "Limited recovery time since last leave",
    "deployment_stability_signal": "Length of continuous deployment",
    "schedule_irregularity_signal": "Irregular and unpredictable duty schedule",
    "posting_hardship_signal": "Extended posting in a hard-area location",
    "transfer_churn_signal": "Frequent transfers in a short period",
    "training_load_signal": "Training commitments on top of operational duty",
    "leave_deficit_signal": "Leave entitlement largely unused",
    "family_separation_signal": "Posted away from family",
    "voice_stress_signal": "Voluntary voice check-in differs from personal baseline",
    "voice_signal_present": "Voice check-in data availability",
}
WORKLOAD_SATURATION_PCT = 100.0
PERSONAL_Z_SATURATION = 2.5
RECOVERY_SATURATION_DAYS = 365.0
DEPLOYMENT_SATURATION_MONTHS = 30.0
DEPLOYMENT_COUNT_SATURATION = 4.0
IRREGULARITY_SATURATION_HOURS = 4.0
POSTING_SEVERITY = {"hard_area": 1.00, "field": 0.50, "static_station": 0.10}
HARD_AREA_TENURE_MONTHS = 24.0
TENURE_OVERRUN_SATURATION = 18.0
TRANSFER_COUNT_SATURATION = 4.0
TRANSFER_RECENCY_DAYS = 365.0
TRAINING_SATURATION_HOURS = 120.0
FAMILY_SATURATION_MONTHS = 24.0

# --- fixed values: roster vocabularies ---------------------------------------
RANKS = (
    "Constable",
    "Head Constable",
    "Assistant Sub-Inspector",
    "Sub-Inspector",
    "Inspector",
    "Assistant Commandant",
    "Deputy Commandant",
    "Commandant",
)
JAWAN_RANKS = ("Constable", "Head Constable", "Assistant Sub-Inspector")
POSTING_TYPES = ("hard_area", "field", "static_station")
GRAY_PROFILES = (
    "training_cadre",
    "course_attendee",
    "voluntary_hard_area",
    "planned_surge",
    "recent_return",
)
GENERATION_ONLY_COLUMNS = ("benign_profile", "latent_strain")
GRAY_DAMPENING = 0.55

# --- fixed values: privacy ---------------------------------------------------
DIRECT_IDENTIFIERS = ("personnel_id", "name", "service_number", "date_of_birth")
PSEUDONYM_PREFIX = "PSN"
PSEUDONYM_HEX = 16
REIDENTIFY_ROLES = ("welfare_officer",)
ROLE_PERSONNEL = "personnel"
ROLE_OFFICER = "welfare_officer"
ROLE_COMMANDER = "commander"
ROLE_MEDICAL = "medical_officer"
ROLE_ESTABLISHMENT = "establishment_admin"
INDIVIDUAL_FIELDS = (
    "personnel_id",
    "pseudonym_id",
    "name",
    "service_number",
    "rank",
    "date_of_birth",
    "welfare_risk_score",
    "risk_level",
    "contributing_factors",
    "voice_stress_signal",
    "recommendations",
    "case_id",
    "family_separated",
    "self_report_consistency",
    "self_reported_strain",
    "appointment_id",
    "prescription_id",
    "doctor_id",
)
MIN_UNIT_SIZE = 10
RETENTION_ACCESS_LOG_DAYS = 365

# --- fixed values: bands, trend, confidence ----------------------------------
LEVELS = ("Normal", "Moderate", "High")
MODERATE_MIN = 40.0
HIGH_MIN = 65.0
BAND_MARGIN = 3.0
TREND_MIN_POINTS = 3
TREND_STABLE_BAND = 3.0
PERSISTENCE_SNAPSHOTS = 3
CONFIDENCE_WEIGHTS = {"feature_completeness": 0.40, "history_depth": 0.35, "recency": 0.25}
CONFIDENCE_FULL_SNAPSHOTS = 6
RECENCY_FULL_DAYS = 30
RECENCY_ZERO_DAYS = 180
CONFIDENCE_MEDIUM_MIN = 0.50
CONFIDENCE_HIGH_MIN = 0.75
SYSTEMIC_GAP = 8.0
UNIT_STRAINED_MIN = 55.0
ANSWER_MAX = 4
DIVERGENCE_POINTS = 30.0

# --- fixed values: unit findings ---------------------------------------------
DEMAND_MIN = 55.0
RECOVERY_MIN = 35.0
STAFFING_MAX = 0.85
MIN_CONSECUTIVE = 2
CLOSEST_UNITS = 3

# --- fixed values: queue, recommendations, explanations ----------------------
QUEUE_CAPACITY = 60
TREND_BONUS = {"Rising": 8.0, "Stable": 0.0, "Improving": -6.0}
LOW_CONFIDENCE_PENALTY = 5.0
MAX_RECOMMENDATIONS = 3
TOP_FACTORS = 3
MAX_TAILORED = 3
BACKGROUND_ROWS = 100
MIN_REDUCTION = 0.5
MAX_EXACT_INPUTS = 14

# --- fixed values: model and calibration -------------------------------------
TEST_PERCENT = 20
CALIBRATION_PERCENT = 20
CV_FOLDS = 5
NON_TREE_MARGIN = 0.02
COVERAGE = 0.90
# weights of the composite index, over inputs scaled to 0-1
INDEX_WEIGHTS = {
    "overwork": 0.16,
    "recovery_deficit": 0.14,
    "leave_deficit": 0.10,
    "deployment": 0.13,
    "irregularity": 0.09,
    "churn": 0.05,
    "training": 0.04,
    "no_offs": 0.07,
    "hard_area": 0.08,
    "family_separated": 0.06,
    "exposure": 0.08,
}
INDEX_INTERACTION = 0.22
INDEX_SATURATING = 0.10

# --- fixed values: text length limits ----------------------------------------
MAX_FREE_TEXT = 2000
MAX_ANSWERS = 20
MAX_ACTION_NOTE = 1000
MAX_BOOKING_REASON = 500
MAX_SHARED_CONTEXT = 1000
MAX_VISIT_NOTE = 2000
OPEN_SLOT_LIMIT = 200
ACTION_STATUSES = ("offered", "arranged", "completed", "not_pursued")
STATUS_MEANINGS = {
    "offered": "The intervention was put to the person.",
    "arranged": "It has been set up and is scheduled or in progress.",
    "completed": "It happened.",
    "not_pursued": (
        "It was not taken forward. This records a decision of the welfare "
        "process, never a judgement about the individual."
    ),
}
OUTCOMES = ("granted", "refused")

# --- fixed values: acoustic check-ins ----------------------------------------
ACOUSTIC_FEATURES = (
    "f0_mean_hz",
    "f0_sd_hz",
    "speaking_rate_syllables_per_sec",
    "pause_ratio",
    "intensity_rms_cv",
    "jitter_local_pct",
    "shimmer_local_pct",
)
ACOUSTIC_WEIGHTS = {
    "f0_mean_hz": 0.18,
    "f0_sd_hz": 0.06,
    "speaking_rate_syllables_per_sec": 0.18,
    "pause_ratio": 0.12,
    "intensity_rms_cv": 0.08,
    "jitter_local_pct": 0.18,
    "shimmer_local_pct": 0.20,
}
ACOUSTIC_DIRECTIONS = {
    "f0_mean_hz": 1,
    "f0_sd_hz": 1,
    "speaking_rate_syllables_per_sec": 1,
    "pause_ratio": -1,
    "intensity_rms_cv": 1,
    "jitter_local_pct": 1,
    "shimmer_local_pct": 1,
}
ACOUSTIC_MIN_SAMPLES = 3
ACOUSTIC_ALPHA = 0.30
ACOUSTIC_SATURATION_SD = 3.0
ACOUSTIC_MIN_WEIGHT = 0.50
SCALE_FLOOR_FRACTION = 0.02
IQR_TO_SD = 1.349
MAD_TO_SD = 1.2533
SAMPLE_RATE = 16000
MIN_AUDIO_SECONDS = 3.0
MAX_AUDIO_SECONDS = 60.0
SILENCE_FRACTION = 0.10
MIN_VOICED_RUN = 3
SYLLABLE_PROMINENCE = 0.15
SYLLABLE_GAP_MS = 100
HOP_MS = 10


def snapshots(
    reference: date = REFERENCE_DATE,
    count: int = SNAPSHOT_COUNT,
    interval_days: int = SNAPSHOT_INTERVAL_DAYS,
) -> list[date]:
    """As-of dates, oldest first, ending at ``reference``."""
    return [reference - timedelta(days=interval_days * i) for i in range(count - 1, -1, -1)]
