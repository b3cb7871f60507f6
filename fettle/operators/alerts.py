"""Alert rules over cases and unit findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle import texts
from fettle.operators.analytics import officer_visible

COLUMNS = ["alert_id", "rule_id", "recipient_role", "priority", "title", "body", "pseudonym_id", "unit_id",
           "snapshot_date"]


def confident_enough() -> Column:
    """Medium or High; an unknown level counts as Low."""
    return F.coalesce(F.col("confidence_level").isin("Medium", "High"), F.lit(False))


def _case_alert(rows: DataFrame, rule: str, role: str, priority: Column, title: str, body: Column) -> DataFrame:
    return rows.select(
        F.concat(F.lit(f"{rule}__"), "pseudonym_id").alias("alert_id"), F.lit(rule).alias("rule_id"),
        F.lit(role).alias("recipient_role"), priority.alias("priority"), F.lit(title).alias("title"),
        body.alias("body"), "pseudonym_id", F.lit(None).cast("string").alias("unit_id"), "snapshot_date")


def personal_notifications(cases: DataFrame) -> DataFrame:
    """To the person, whatever the confidence."""
    rows = cases.filter(F.col("risk_level").isin("Moderate", "High"))
    priority = F.when(F.col("risk_level") == "Moderate", "medium").otherwise("high")
    return _case_alert(rows, "personal_notification", P.ROLE_PERSONNEL, priority, texts.PERSONAL_TITLE, F.lit(texts.PERSONAL_BODY))


def high_alerts(cases: DataFrame) -> DataFrame:
    rows = cases.filter((F.col("risk_level") == "High") & confident_enough())
    note = F.when(F.col("band_certainty") == "borderline", F.lit(" " + texts.BORDERLINE_NOTE)).otherwise(F.lit(""))
    body = F.concat(F.format_string(texts.HIGH_BODY, F.bround("welfare_risk_score")), note)
    return _case_alert(rows, "officer_alert_high", P.ROLE_OFFICER, F.lit("high"), texts.HIGH_TITLE, body)


def persistent_alerts(cases: DataFrame) -> DataFrame:
    """The persistence path of the escalation rule, the same one the queue uses."""
    visible = officer_visible(F.col("risk_level"), F.col("is_persistent"), F.col("trend_direction"))
    rows = cases.filter((F.col("risk_level") != "High") & visible & confident_enough())
    rising = F.when(F.col("trend_direction") == "Rising", F.lit(" and is rising")).otherwise(F.lit(""))
    body = F.format_string(texts.PERSISTENT_BODY, F.col("persistence_snapshots"), rising)
    return _case_alert(rows, "officer_alert_persistent", P.ROLE_OFFICER, F.lit("medium"), texts.PERSISTENT_TITLE, body)


def rising_high_alerts(cases: DataFrame) -> DataFrame:
    rows = cases.filter(
        (F.col("risk_level") == "High") & (F.col("trend_direction") == "Rising") & confident_enough())
    body = F.format_string(texts.RISING_BODY, F.bround("welfare_risk_score"))
    return _case_alert(rows, "officer_alert_rising_high", P.ROLE_OFFICER, F.lit("urgent"), texts.RISING_TITLE, body)


def unit_alerts(findings: DataFrame) -> DataFrame:
    return findings.select(
        F.concat(F.lit("commander_near_miss__"), "unit_id").alias("alert_id"),
        F.lit("commander_near_miss").alias("rule_id"), F.lit(P.ROLE_COMMANDER).alias("recipient_role"),
        F.lit("high").alias("priority"), F.concat(F.lit(texts.UNIT_TITLE), "unit_id").alias("title"),
        F.format_string(texts.UNIT_BODY, F.col("summary")).alias("body"), F.lit(None).cast("string").alias("pseudonym_id"),
        "unit_id", F.col("last_detected").alias("snapshot_date"))


def case_alerts(cases: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        personal_notifications(cases), high_alerts(cases), persistent_alerts(cases), rising_high_alerts(cases)])


def batch(cases: DataFrame, findings: DataFrame) -> DataFrame:
    return case_alerts(cases).unionByName(unit_alerts(findings))


def feeds(alerts: DataFrame) -> DataFrame:
    """Which feed an alert belongs to: the person's own, the officer's by person, or the unit's."""
    feed = (
        F.when((F.col("recipient_role") == P.ROLE_PERSONNEL) & F.col("pseudonym_id").isNotNull(), "by_person")
        .when((F.col("recipient_role") == P.ROLE_OFFICER) & F.col("pseudonym_id").isNotNull(), "officer_by_person")
        .otherwise("by_role_only"))
    return alerts.withColumn("feed", feed)


def totals(alerts: DataFrame) -> DataFrame:
    return feeds(alerts).groupBy("recipient_role", "rule_id", "feed").agg(F.count(F.lit(1)).alias("n"))
