"""Wording shown to people. Results carry these sentences as they stand."""

from __future__ import annotations

# --- fixed values: what a band means -------------------------------------------
LEVEL_DESCRIPTIONS = {
    "Normal": (
        "Your current duty, leave and posting pattern does not show indicators the system is designed to flag."
    ),
    "Moderate": (
        "Some indicators in your duty, leave or posting pattern are above the usual range. This is visible to you only."
    ),
    "High": (
        "Several indicators in your duty, leave or posting pattern are well above the usual range. A welfare officer "
        "can see this case so that support can be offered."
    ),
}
BARELY_OVER = (
    "This score is %.1f points above the cutoff that puts it in %s. It is at the bottom of the band, not in the middle "
    "of it."
)
BARELY_UNDER = "This score is %.1f points below the next band up. It is at the top of %s."
BORDERLINE_NOTE = (
    "The calibrated range for this score crosses a band boundary, so the band shown is provisional: the same duty and "
    "leave pattern could reasonably sit in the neighbouring band."
)

# --- fixed values: individual or unit -------------------------------------------
NO_UNIT = (
    "No comparable unit aggregate is available (the unit is below the minimum size for reporting), so this case cannot "
    "be compared against its unit and is treated individually."
)
MIXED = (
    "The unit as a whole is strained (mean %.0f), and this person sits %.0f points above even that. Both a unit-level "
    "workload review and individual support are indicated."
)
STRAINED_UNIT = (
    "This person is close to their unit's mean (%.0f), and that mean is itself high. The driver is the unit's "
    "conditions rather than anything specific to this person -- the appropriate response is a workload or roster "
    "review, not individual intervention."
)
ABOVE_UNIT = (
    "This person sits %.0f points above their unit's mean (%.0f), which is not itself elevated. The indicators are "
    "specific to this person's own duty and leave pattern."
)
LIKE_UNIT = "This person is close to their unit's mean (%.0f). Whatever is showing here is showing across the unit."
SMALL_UNIT = (
    "Unit has fewer than %d personnel; aggregates are withheld so individuals cannot be identified from them."
)
NEAR_MISS = (
    "Unit %s has held high duty demand (mean workload signal %.0f), limited recovery (mean recovery signal %.0f) and "
    "staffing at %.0f%% of sanctioned strength for %d consecutive snapshots. No individual is named in this finding: it "
    "describes the unit's operating conditions and points to a roster, tasking or establishment review."
)

# --- fixed values: who may see a case -------------------------------------------
VISIBILITY_RULE = (
    "A case is visible to a welfare officer only when it is currently High, or has been Moderate or above for %d "
    "consecutive snapshots with a rising trend. Everyone else is scored and can see their own result, but is not shown "
    "to an officer."
)

# --- fixed values: self-report ----------------------------------------------------
ANSWERS_ALIGNED = (
    "Your recent answers line up with what your duty and leave records show. Nothing here needs anything from you."
)
ANSWERS_BELOW = (
    "Your recent answers suggest things feel manageable, even though your records show %s has been above your usual "
    "range. Good to know — this changes nothing about your indicators, and support is there if that changes."
)
ANSWERS_ABOVE = (
    "Your recent answers show more concern than your duty and leave records on their own would suggest, around %s. "
    "Records only see rosters and dates, so this is worth a conversation with your welfare officer if you would like one."
)
OFFICER_DIVERGENCE = (
    "Self-report and duty data diverge on %s for this case. That is context for a conversation, not a finding: this "
    "comparison is not part of the score and has not affected it."
)

# --- fixed values: counterfactual ------------------------------------------------
NO_LEVER = (
    "No single indicator moves this score materially. The pattern is spread across several conditions at once."
)
DECISIVE_LEVER = (
    "Bringing %s to the force median would, on its own, take this score below the High cutoff in the model. That is how "
    "the model responds to that input, not a prediction about the person."
)
LARGEST_LEVER = (
    "The largest single lever is %s: at the force median the model returns %.0f instead of %.0f. No one indicator alone "
    "takes this case below the High cutoff."
)

# --- fixed values: alerts ---------------------------------------------------------
PERSONAL_TITLE = "Your wellbeing indicators have been noted"
PERSONAL_BODY = (
    "Your welfare monitoring indicators show signs that you may benefit from support. Please check your wellbeing "
    "summary in the app. This notification is private to you."
)
HIGH_TITLE = "High welfare risk case"
HIGH_BODY = (
    "A case in your assigned scope has reached the High risk band (score %.0f). This is a welfare indicator, not a "
    "disciplinary matter. Please review the case detail."
)
PERSISTENT_TITLE = "Persistent Moderate welfare concern"
PERSISTENT_BODY = (
    "A case has been at Moderate or above for %d consecutive snapshots%s. Persistent patterns may benefit from a "
    "welfare check-in."
)
RISING_TITLE = "Rising High welfare risk — early intervention recommended"
RISING_BODY = (
    "A High-risk case is showing a Rising trend (score %.0f and climbing). Early intervention is most effective before a "
    "situation worsens further."
)
UNIT_TITLE = "Unit welfare near-miss: "
UNIT_BODY = (
    "%s This is a unit-level finding based on aggregate indicators. No individual is identified in this alert."
)

# --- fixed values: signals in words -------------------------------------------------
SIGNAL_PHRASES = {
    "workload_deviation_signal": "Duty load is %s the usual standard.",
    "recovery_pattern_signal": "Recovery time since the last leave is %s.",
    "deployment_stability_signal": "Length of continuous deployment is %s.",
    "schedule_irregularity_signal": "Duty schedule predictability is %s strained.",
    "posting_hardship_signal": "Hardship of the current posting is %s.",
    "transfer_churn_signal": "Frequency of recent transfers is %s.",
    "training_load_signal": "Training commitments alongside duty are %s.",
    "leave_deficit_signal": "Unused leave entitlement is %s.",
    "family_separation_signal": "Separation from family is %s a factor.",
}
