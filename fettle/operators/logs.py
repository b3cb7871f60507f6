"""Access and action logs: validated appends, summaries, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions.scales import lookup


def access_problem() -> Column:
    return (
        F.when(~F.coalesce(F.col("outcome").isin(*P.OUTCOMES), F.lit(False)), "unknown outcome")
        .when(F.trim(F.coalesce("pseudonym_id", F.lit(""))) == "", "no pseudonym"))


def validated(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and refused rows with the reason."""
    marked = df.withColumn("problem", problem)
    return marked.filter(F.col("problem").isNull()).drop("problem"), marked.filter(F.col("problem").isNotNull())


def append_by_day(df: DataFrame, path: str, at: str = "at") -> None:
    """Append-only parquet, one partition per day so that retention drops whole days.

    Rows are spread over a few files per day, so a busy day is not one task.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(16))
    days = df.withColumn("day", F.to_date(at)).withColumn("_s", salt)
    days.repartition("day", "_s").drop("_s").write.mode("append").partitionBy("day").parquet(path)


def access_summary(log: DataFrame) -> DataFrame:
    """Per person: granted, refused, third-party reads by role with first and last date."""
    granted = F.col("outcome") != "refused"
    third = granted & (F.col("actor_role") != P.ROLE_PERSONNEL)
    by_role = log.groupBy("pseudonym_id", "actor_role").agg(
        F.count_if(granted).alias("g"), F.count_if(~granted).alias("r"), F.count_if(third).alias("t"),
        F.min(F.when(third, F.col("at"))).alias("lo"), F.max(F.when(third, F.col("at"))).alias("hi"))
    roles = F.filter(
        F.collect_list(F.struct("actor_role", "t")), lambda x: x["t"] > 0)  # one entry per role
    return by_role.groupBy("pseudonym_id").agg(
        F.sum("g").alias("total_granted"), F.sum("r").alias("total_refused"),
        F.map_from_entries(roles).alias("by_role"),
        F.min("lo").alias("first_accessed_at"), F.max("hi").alias("last_accessed_at"))


def retained(log: DataFrame, now: datetime, days: int = P.RETENTION_ACCESS_LOG_DAYS, at: str = "at") -> DataFrame:
    return log.filter(F.col(at) >= F.lit(now - timedelta(days=days)))


def purge_counts(log: DataFrame, now: datetime, days: int = P.RETENTION_ACCESS_LOG_DAYS, at: str = "at") -> DataFrame:
    old = F.col(at) < F.lit(now - timedelta(days=days))
    return log.agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))


def row_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("n"))


def action_problem(known: Column) -> Column:
    note = F.trim(F.coalesce("note", F.lit("")))
    return (
        F.when(F.trim(F.coalesce("pseudonym_id", F.lit(""))) == "", "no case")
        .when(F.trim(F.coalesce("intervention_id", F.lit(""))) == "", "no intervention")
        .when(~F.coalesce(known, F.lit(False)), "unknown intervention")
        .when(~F.coalesce(F.col("status").isin(*P.ACTION_STATUSES), F.lit(False)), "unknown status")
        .when(F.length(note) > P.MAX_ACTION_NOTE, "note too long"))


def check_actions(actions: DataFrame, library: DataFrame) -> DataFrame:
    ids = F.broadcast(library.select(F.col("id").alias("intervention_id"), F.lit(True).alias("_known")))
    return actions.withColumn("intervention_id", F.trim("intervention_id")).join(
        ids, "intervention_id", "left").withColumn("problem", action_problem(F.col("_known"))).drop("_known")


def actions_for(actions: DataFrame, pseudonym_id: str | None = None) -> DataFrame:
    """Status meaning resolved; of one case newest first, of all cases in no order."""
    rows = actions if pseudonym_id is None else actions.filter(F.col("pseudonym_id") == pseudonym_id)
    meaning = F.coalesce(lookup(F.col("status"), P.STATUS_MEANINGS), F.lit(""))
    out = rows.select("id", "at", "pseudonym_id", "intervention_id", "status", "actor_role", "note", meaning.alias("status_meaning"))
    return out if pseudonym_id is None else out.orderBy(F.col("id").desc())


def action_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("pseudonym_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in P.ACTION_STATUSES],
        F.max_by("at", "id").alias("last_recorded_at"))
