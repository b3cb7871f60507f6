"""Cleaning: every change is counted, gaps are never filled in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fettle import policy as P

# fixed values: key columns of the tables that need nothing more
GENERIC_KEYS = {
    "unit_capacity": ["unit_id"],
    "deployment_history": ["deployment_id"],
    "transfer_records": ["transfer_id"],
    "training_records": ["training_id"],
}
LOG = "table_name string, action string, detail string, affected long"


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Plain predicates, so that they reach the scan."""
    for key in keys:
        if key in df.columns:
            df = df.filter(F.col(key).isNotNull())
    return df


def keep_first(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """First row per key in an explicit total order (all columns when not given).

    The ``= 1`` filter is pushed below the shuffle as a group limit, so many
    copies of one key leave each task as a single row.
    """
    by = [F.col(c) for c in (order or df.columns)]
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_position", position).filter(F.col("_position") == 1).drop("_position")


def cap(column: str, upper: float) -> Column:
    c = F.col(column)
    return F.when(c > upper, F.lit(upper)).otherwise(c)


def clean_duty(df: DataFrame) -> DataFrame:
    keys = ["personnel_id", "month_start"]
    out = keep_first(drop_null_keys(df, keys), keys)
    out = out.withColumn("mean_daily_duty_hours", cap("mean_daily_duty_hours", P.MAX_DAILY_DUTY_HOURS))
    out = out.withColumn("days_on_duty", cap("days_on_duty", P.MAX_DUTY_DAYS).cast("int"))
    out = out.withColumn("total_duty_hours", F.col("mean_daily_duty_hours") * F.col("days_on_duty"))
    return out.withColumn("weekly_offs_availed", F.least("weekly_offs_availed", "weekly_offs_entitled"))


def rederived_leave_days(start: str = "start_date", end: str = "end_date", days: str = "days_availed") -> Column:
    """Per row: the date range wins where it disagrees by more than a day."""
    derived = F.datediff(end, start).cast("double")
    return F.when(F.abs(derived - F.col(days)) > 1.0, derived).otherwise(F.col(days))


def drop_inverted(df: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    return df.filter(~F.coalesce(F.col(end) < F.col(start), F.lit(False)))


def clean_leave(df: DataFrame) -> DataFrame:
    out = keep_first(drop_null_keys(df, ["leave_id", "personnel_id", "start_date"]), ["leave_id"])
    out = drop_inverted(out).withColumn("days_availed", rederived_leave_days())
    return out.withColumn("days_availed", cap("days_availed", P.MAX_LEAVE_SPELL_DAYS))


def clean_roster(df: DataFrame) -> DataFrame:
    out = keep_first(drop_null_keys(df, ["personnel_id"]), ["personnel_id"])
    early = F.col("current_posting_start_date") < F.col("date_of_joining")
    return out.filter(~F.coalesce(early, F.lit(False)))


def clean_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return keep_first(drop_null_keys(df, keys), keys)


def on_roster(child: DataFrame, roster: DataFrame, key: str = "personnel_id") -> DataFrame:
    return child.join(roster.select(key), key, "left_semi")


def clean_all(tables: dict[str, DataFrame], roster: DataFrame | None = None) -> dict[str, DataFrame]:
    """Clean every table; ``roster`` may be an already cleaned (and written) roster."""
    special = {"personnel": clean_roster, "duty_logs": clean_duty, "leave_records": clean_leave}
    out = {}
    for name, df in tables.items():
        if name == "personnel" and roster is not None:
            out[name] = roster
        elif name in special:
            out[name] = special[name](df)
        elif name in GENERIC_KEYS:
            out[name] = clean_keys(df, GENERIC_KEYS[name])
        else:
            out[name] = df
    roster = out.get("personnel")
    if roster is not None:
        for name, df in out.items():
            if name != "personnel" and "personnel_id" in df.columns:
                out[name] = on_roster(df, roster)
    return out


def _entries(df: DataFrame, table: str, entries: list[tuple[str, str, Column]]) -> DataFrame:
    """Several counts of one table from one pass."""
    one = df.agg(*[F.coalesce(e.cast("long"), F.lit(0).cast("long")).alias(f"c{i}") for i, (_, _, e) in enumerate(entries)])
    rows = F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(a).alias("action"), F.lit(d).alias("detail"),
                 F.col(f"c{i}").alias("affected")) for i, (a, d, _) in enumerate(entries)])
    return one.select(F.inline(rows))


def _duplicates(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _entries(groups, table, [("drop", f"duplicate on {','.join(keys)}", F.sum(F.col("n") - 1))])


def _duty_changes() -> list[tuple[str, str, Column]]:
    hours = F.least(F.col("mean_daily_duty_hours"), F.lit(P.MAX_DAILY_DUTY_HOURS))
    days = F.least(F.col("days_on_duty"), F.lit(P.MAX_DUTY_DAYS))
    return [
        ("cap", "mean_daily_duty_hours", F.count_if(F.col("mean_daily_duty_hours") > P.MAX_DAILY_DUTY_HOURS)),
        ("cap", "days_on_duty", F.count_if(F.col("days_on_duty") > P.MAX_DUTY_DAYS)),
        ("recompute", "total_duty_hours", F.count_if(F.abs(hours * days - F.col("total_duty_hours")) > 1.0)),
        ("clamp", "weekly_offs_availed", F.count_if(F.col("weekly_offs_availed") > F.col("weekly_offs_entitled"))),
    ]


def _leave_changes() -> list[tuple[str, str, Column]]:
    inverted = F.coalesce(F.col("end_date") < F.col("start_date"), F.lit(False))
    derived = F.datediff("end_date", "start_date").cast("double")
    off = F.abs(derived - F.col("days_availed")) > 1.0
    return [
        ("drop", "end before start", F.count_if(inverted)),
        ("recompute", "days_availed", F.count_if(~inverted & off)),
        ("cap", "days_availed", F.count_if(~inverted & (rederived_leave_days() > P.MAX_LEAVE_SPELL_DAYS))),
    ]


def _roster_changes() -> list[tuple[str, str, Column]]:
    early = F.col("current_posting_start_date") < F.col("date_of_joining")
    return [("drop", "posting before joining", F.count_if(early))]


def cleaning_log(tables: dict[str, DataFrame]) -> DataFrame:
    """What ``clean_all`` does to each table, as counts (rows dropped, values capped)."""
    parts: list[DataFrame] = []
    keys = {**GENERIC_KEYS, "personnel": ["personnel_id"], "duty_logs": ["personnel_id", "month_start"],
            "leave_records": ["leave_id"]}
    for name, df in tables.items():
        if name not in keys:
            continue
        must = ["leave_id", "personnel_id", "start_date"] if name == "leave_records" else keys[name]
        any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in must])
        parts.append(_entries(df, name, [("drop", "null key", F.count_if(any_null))]))
        kept = drop_null_keys(df, must)
        parts.append(_duplicates(kept, name, keys[name]))
        changes = {"duty_logs": _duty_changes, "leave_records": _leave_changes, "personnel": _roster_changes}
        if name in changes:
            parts.append(_entries(keep_first(kept, keys[name]), name, changes[name]()))
    if "personnel" in tables:
        roster = clean_roster(tables["personnel"]).select("personnel_id")
        for name, df in tables.items():
            if name == "personnel" or "personnel_id" not in df.columns:
                continue
            cleaned = {"duty_logs": clean_duty, "leave_records": clean_leave}.get(
                name, lambda d, n=name: clean_keys(d, GENERIC_KEYS[n]) if n in GENERIC_KEYS else d)(df)
            # count per person first: a person missing from the roster may own many rows
            per_person = cleaned.groupBy("personnel_id").agg(F.count(F.lit(1)).alias("n"))
            lost = per_person.join(roster, "personnel_id", "left_anti")
            parts.append(_entries(lost, name, [("drop", "person not on roster", F.sum("n"))]))
    return reduce(DataFrame.unionByName, parts)
