"""Rule-based recommendations: cases against a ten-row library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fettle import policy as P


def top_signals(factors: Column) -> Column:
    """Signals of the top factors; without any, every signal above zero."""
    fallback = F.filter(F.array(*[
        F.when(F.col(c) > 0, F.lit(c)) for c in P.SIGNALS]), lambda s: s.isNotNull())
    named = F.filter(F.coalesce(factors, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))
    return F.when(F.size(named) > 0, named).otherwise(fallback)


def recommend(cases: DataFrame, library: DataFrame, limit: int = P.MAX_RECOMMENDATIONS) -> DataFrame:
    """Library entries that fit level, attribution and any top signal; best three per case.

    ``cases``: pseudonym_id, risk_level, risk_attribution, confidence_level, top_signals.
    The library is a fixed ten-row dimension, so the theta join is a broadcast.
    """
    fits = (
        (F.col("risk_level") != "Normal")
        & F.array_contains("applicable_risk_levels", F.col("risk_level"))
        & F.array_contains("applicable_attribution", F.col("risk_attribution"))
        & F.arrays_overlap("applicable_signals", "top_signals")
    )
    rank = F.row_number().over(Window.partitionBy("pseudonym_id").orderBy("priority", "position"))
    return (
        cases.select("pseudonym_id", "risk_level", "risk_attribution", "confidence_level", "top_signals")
        .join(F.broadcast(library), fits)
        .withColumn("rank", rank).filter(F.col("rank") <= limit)
        .select("pseudonym_id", "rank", "id", "title", "description", "action_owner", "recipient", "priority",
                (F.col("confidence_level") == "Low").alias("low_confidence"))
    )


def uncovered_signals(signal_names: DataFrame, library: DataFrame, questions: DataFrame) -> DataFrame:
    """Signals in use and whether any question and any intervention covers them."""
    acted = library.select(F.explode("applicable_signals").alias("signal_name")).distinct()
    asked = questions.filter(F.col("signal_name") != "").select("signal_name").distinct()
    return (
        signal_names.join(F.broadcast(acted.withColumn("_a", F.lit(True))), "signal_name", "left")
        .join(F.broadcast(asked.withColumn("_q", F.lit(True))), "signal_name", "left")
        .withColumn("has_intervention", F.coalesce("_a", F.lit(False)))
        .withColumn("has_question", F.coalesce("_q", F.lit(False))).drop("_a", "_q")
    )
