"""Point-in-time features on the person x snapshot grid.

Each event table is read once: a row is offered to every snapshot (six
literals, ``explode``, no join) and folded straight into a (person, snapshot)
aggregate, so partial aggregation shrinks a busy person before the shuffle.
Training rows are offered only where a window holds them. Duty months, of which
a person has one a month, meet by person before they are offered: the many
columns of their aggregate are not shuffled half done.
All aggregates share the key (pseudonym_id, snapshot_date).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions.scales import percent, zscore

ID, SNAP = "pseudonym_id", "snapshot_date"
KEYS = [ID, SNAP]
CONTEXT = ["unit_id", "posting_type", "is_jawan_rank", "family_separated"]
HR_FEATURES = [
    "days_since_last_leave", "total_leave_days_past_year", "leave_entitlement_used_pct",
    "current_deployment_length_months", "deployment_count_past_2yrs", "time_in_current_posting_months",
    "transfer_count_past_2yrs", "time_since_last_transfer_days",
    "duty_hours_last_month", "workload_deviation_pct", "holiday_weekly_off_availed_pct",
    "schedule_irregularity_sd", "training_hours_last_3months", "night_shifts_last_month",
]
WINDOW_FEATURES = [
    f"{q}_{n}d" for q in ("duty_hours", "leave_days", "training_hours") for n in P.WINDOW_DAYS
] + [f"{q}_change_ratio" for q in ("duty_hours", "leave_days", "training_hours")]
BASELINE_FEATURES = [
    "baseline_duty_hours_mean", "baseline_duty_hours_sd", "baseline_observations", "baseline_is_reliable",
    "duty_hours_personal_deviation_z", "schedule_sd_personal_deviation_z", "night_shifts_personal_deviation_z",
]


def _snapshot_array(snapshots: Sequence[date]) -> Column:
    return F.array(*[F.to_date(F.lit(s.isoformat())) for s in snapshots])


def with_snapshots(rows: DataFrame, snapshots: Sequence[date]) -> DataFrame:
    return rows.withColumn(SNAP, F.explode(_snapshot_array(snapshots)))


def snapshot_dates(rows: DataFrame, reference: Column, count: int = P.SNAPSHOT_COUNT,
                   interval_days: int = P.SNAPSHOT_INTERVAL_DAYS) -> DataFrame:
    """The snapshot ladder below a per-row reference date."""
    return rows.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn(
        SNAP, F.date_sub(reference, F.col("_back") * interval_days)
    ).drop("_back")


def grid(roster: DataFrame, snapshots: Sequence[date]) -> DataFrame:
    kept = [ID, *CONTEXT, "current_posting_start_date"]
    return with_snapshots(roster.select(*kept), snapshots)


def _months(days: Column) -> Column:
    return days / F.lit(P.DAYS_PER_MONTH)


def _since(column: Column, n: int) -> Column:
    """``column`` lies in the half-open window (snapshot - n, snapshot]."""
    return (column > F.date_sub(SNAP, n)) & (column <= F.col(SNAP))


def leave_aggregates(leave: DataFrame, snapshots: Sequence[date]) -> DataFrame:
    end, days = F.col("end_date"), F.col("days_availed")
    in_year = (end >= F.date_sub(SNAP, P.YEAR_DAYS)) & (end <= F.col(SNAP))
    windows = [
        F.sum(F.when(_since(end, n), days).otherwise(F.lit(0.0))).alias(f"leave_days_{n}d")
        for n in P.WINDOW_DAYS
    ]
    return with_snapshots(leave.select(ID, "end_date", "days_availed"), snapshots).groupBy(*KEYS).agg(
        F.max(F.when(end <= F.col(SNAP), end)).alias("last_leave_end"),
        F.sum(F.when(in_year, days).otherwise(F.lit(0.0))).alias("leave_days_year"),
        *windows,
    )


def deployment_aggregates(deploy: DataFrame, snapshots: Sequence[date]) -> DataFrame:
    start, end, snap = F.col("start_date"), F.col("end_date"), F.col(SNAP)
    started = start <= snap
    is_open = started & (end.isNull() | (end > snap))
    return with_snapshots(deploy.select(ID, "start_date", "end_date"), snapshots).groupBy(*KEYS).agg(
        F.max(F.when(is_open, start)).alias("open_start"),
        F.max(F.when(started, start)).alias("latest_start"),
        F.count_if(_since(start, P.TWO_YEARS_DAYS)).alias("deployments_2y"),
    )


def transfer_aggregates(transfers: DataFrame, snapshots: Sequence[date]) -> DataFrame:
    at = F.col("transfer_date")
    return with_snapshots(transfers.select(ID, "transfer_date"), snapshots).groupBy(*KEYS).agg(
        F.max(F.when(at <= F.col(SNAP), at)).alias("last_transfer"),
        F.count_if(_since(at, P.TWO_YEARS_DAYS)).alias("transfers_2y"),
    )


def training_aggregates(training: DataFrame, snapshots: Sequence[date]) -> DataFrame:
    """Hours per window; no row where the widest one holds no training (the features read that as 0)."""
    end, hours = F.col("end_date"), F.col("training_hours")
    spans = sorted({*P.WINDOW_DAYS, P.TRAINING_DAYS})
    offered = with_snapshots(training.select(ID, "end_date", "training_hours"), snapshots).filter(_since(end, spans[-1]))
    return offered.groupBy(*KEYS).agg(*[
        F.sum(F.when(_since(end, n), hours).otherwise(F.lit(0.0))).alias(f"training_hours_{n}d")
        for n in spans
    ])


def overlap_share(month_start: Column, window_days: int) -> Column:
    """Share of a 30.44-day month lying inside (snapshot - n, snapshot]."""
    starts_before_end = F.datediff(F.col(SNAP), month_start).cast("double")
    # days from the month's start to each edge, so everything is relative to it
    upper = F.least(F.lit(P.DAYS_PER_MONTH), starts_before_end)
    lower = F.greatest(F.lit(0.0), starts_before_end - F.lit(float(window_days)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (upper - lower) / F.lit(P.DAYS_PER_MONTH)))


def duty_aggregates(duty: DataFrame, snapshots: Sequence[date], strict: bool = False) -> DataFrame:
    """Newest month (as-of), prorated hours and the personal baseline in one pass.

    ``strict`` ignores months that end after the snapshot, which the default
    as-of rule does not (a month counts from its first day).
    """
    month = F.col("month_start")
    known_from = F.date_add(month, 31) if strict else month
    past = known_from <= F.col(SNAP)
    in_baseline = (month > F.date_sub(SNAP, P.BASELINE_LOOKBACK_DAYS)) & (
        month <= F.date_sub(SNAP, P.BASELINE_EXCLUDE_DAYS)
    )
    newest = {
        "total_duty_hours": "hours", "weekly_offs_availed": "availed", "weekly_offs_entitled": "entitled",
        "daily_duty_hours_sd": "sd", "night_shifts": "nights",
    }
    picks = [
        F.max_by(F.col(src).cast("double"), F.when(past, month)).alias(f"now_{short}")
        for src, short in newest.items()
    ]
    base = []
    for src, short in (("total_duty_hours", "hours"), ("daily_duty_hours_sd", "sd"), ("night_shifts", "nights")):
        seen = F.when(in_baseline, F.col(src).cast("double"))
        base += [
            F.avg(seen).alias(f"base_{short}_mean"),
            F.stddev_samp(seen).alias(f"base_{short}_sd"),
            F.count(seen).alias(f"base_{short}_n"),
        ]
    prorated = [
        F.sum(F.col("total_duty_hours") * overlap_share(month, n)).alias(f"duty_hours_{n}d")
        for n in P.WINDOW_DAYS
    ]
    cols = [ID, "month_start", *newest]
    # a few narrow rows a person: cheaper to move than six partial aggregates of each
    met = duty.select(*cols).repartition(ID)
    return with_snapshots(met, snapshots).groupBy(*KEYS).agg(
        F.max(F.when(past, month)).alias("now_month"), *picks, *base, *prorated
    )


def change_ratio(short: Column, long: Column) -> Column:
    short_rate = short / F.lit(float(P.CHANGE_SHORT_DAYS))
    long_rate = long / F.lit(float(P.CHANGE_LONG_DAYS))
    quiet = F.when(short_rate < P.MIN_DAILY_RATE, F.lit(1.0)).otherwise(F.lit(P.MAX_CHANGE_RATIO))
    ratio = F.least(F.greatest(F.try_divide(short_rate, long_rate), F.lit(0.0)), F.lit(P.MAX_CHANGE_RATIO))
    return F.when(short.isNotNull() & long.isNotNull(), F.when(long_rate < P.MIN_DAILY_RATE, quiet).otherwise(ratio))


def leave_columns() -> dict[str, Column]:
    days_year = F.coalesce(F.col("leave_days_year"), F.lit(0.0))
    return {
        "days_since_last_leave": F.coalesce(
            F.datediff(SNAP, "last_leave_end").cast("double"), F.lit(P.NEVER_DAYS)),
        "total_leave_days_past_year": days_year,
        "leave_entitlement_used_pct": percent(days_year, F.lit(P.LEAVE_ENTITLEMENT_DAYS), 0.0),
    }


def deployment_columns() -> dict[str, Column]:
    posting = F.datediff(SNAP, "current_posting_start_date").cast("double")
    in_posting = F.when(posting.isNotNull(), F.greatest(F.lit(0.0), _months(posting)))
    spell = F.datediff(F.col(SNAP), F.coalesce(F.col("open_start"), F.col("latest_start"))).cast("double")
    current = F.when(spell.isNotNull(), F.greatest(F.lit(0.0), _months(spell))).otherwise(in_posting)
    return {
        "current_deployment_length_months": current,
        "deployment_count_past_2yrs": F.coalesce(F.col("deployments_2y").cast("double"), F.lit(0.0)),
        "time_in_current_posting_months": in_posting,
    }


def transfer_columns() -> dict[str, Column]:
    return {
        "transfer_count_past_2yrs": F.coalesce(F.col("transfers_2y").cast("double"), F.lit(0.0)),
        "time_since_last_transfer_days": F.coalesce(
            F.datediff(SNAP, "last_transfer").cast("double"), F.lit(P.NEVER_DAYS)),
    }


def duty_columns() -> dict[str, Column]:
    standard = F.lit(P.STANDARD_MONTHLY_HOURS)
    return {
        "duty_hours_last_month": F.col("now_hours"),
        "workload_deviation_pct": percent(F.col("now_hours") - standard, standard),
        "holiday_weekly_off_availed_pct": percent(F.col("now_availed"), F.col("now_entitled")),
        "schedule_irregularity_sd": F.col("now_sd"),
        "night_shifts_last_month": F.col("now_nights"),
    }


def training_columns() -> dict[str, Column]:
    return {
        "training_hours_last_3months": F.coalesce(F.col(f"training_hours_{P.TRAINING_DAYS}d"), F.lit(0.0))
    }


def window_columns() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for n in P.WINDOW_DAYS:
        out[f"duty_hours_{n}d"] = F.col(f"duty_hours_{n}d")
        for q in ("leave_days", "training_hours"):
            out[f"{q}_{n}d"] = F.coalesce(F.col(f"{q}_{n}d"), F.lit(0.0))
    for q in ("duty_hours", "leave_days", "training_hours"):
        out[f"{q}_change_ratio"] = change_ratio(
            out[f"{q}_{P.CHANGE_SHORT_DAYS}d"], out[f"{q}_{P.CHANGE_LONG_DAYS}d"])
    return {name: out[name] for name in WINDOW_FEATURES}


def baseline_columns() -> dict[str, Column]:
    """All NULL (and not reliable) when there is no month at or before the snapshot."""
    known = F.col("now_month").isNotNull()
    n = F.col("base_hours_n")
    out = {
        "baseline_duty_hours_mean": F.when(known, F.col("base_hours_mean")),
        "baseline_duty_hours_sd": F.when(known & (n > 0), F.coalesce(F.col("base_hours_sd"), F.lit(0.0))),
        "baseline_observations": F.when(known, n.cast("double")).otherwise(F.lit(0.0)),
        "baseline_is_reliable": F.coalesce(known & (n >= P.BASELINE_MIN_OBSERVATIONS), F.lit(False)),
    }
    for name, short in (("duty_hours", "hours"), ("schedule_sd", "sd"), ("night_shifts", "nights")):
        sd = F.coalesce(F.col(f"base_{short}_sd"), F.lit(0.0))
        z = zscore(F.col(f"now_{short}"), F.col(f"base_{short}_mean"), sd)
        out[f"{name}_personal_deviation_z"] = F.when(known, z)
    return out


def _on_grid(base: DataFrame, *aggregates: DataFrame) -> DataFrame:
    for agg in aggregates:
        base = base.join(agg, KEYS, "left")
    return base


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def optional(tables: dict[str, DataFrame], name: str, like: str) -> DataFrame:
    """A missing event table behaves as an empty one (``like`` is its DDL)."""
    if name in tables:
        return tables[name]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([], like)


EVENT_DDL = {
    "leave_records": f"{ID} string, end_date date, days_availed double",
    "deployment_history": f"{ID} string, start_date date, end_date date",
    "transfer_records": f"{ID} string, transfer_date date",
    "training_records": f"{ID} string, end_date date, training_hours double",
    "duty_logs": (
        f"{ID} string, month_start date, total_duty_hours double, weekly_offs_availed int, "
        "weekly_offs_entitled int, daily_duty_hours_sd double, night_shifts int"
    ),
}


def hr_features(tables: dict[str, DataFrame], snapshots: Sequence[date]) -> DataFrame:
    if "personnel" not in tables:
        raise KeyError("a personnel table is required")
    wide = _on_grid(
        grid(tables["personnel"], snapshots),
        leave_aggregates(optional(tables, "leave_records", EVENT_DDL["leave_records"]), snapshots),
        deployment_aggregates(optional(tables, "deployment_history", EVENT_DDL["deployment_history"]), snapshots),
        transfer_aggregates(optional(tables, "transfer_records", EVENT_DDL["transfer_records"]), snapshots),
        training_aggregates(optional(tables, "training_records", EVENT_DDL["training_records"]), snapshots),
        duty_aggregates(optional(tables, "duty_logs", EVENT_DDL["duty_logs"]), snapshots),
    )
    columns = {
        **leave_columns(), **deployment_columns(), **transfer_columns(), **duty_columns(), **training_columns()
    }
    return wide.select(*KEYS, *CONTEXT, *[columns[n].alias(n) for n in HR_FEATURES])


def temporal_windows(tables: dict[str, DataFrame], snapshots: Sequence[date]) -> DataFrame:
    wide = _on_grid(
        grid(tables["personnel"], snapshots),
        leave_aggregates(optional(tables, "leave_records", EVENT_DDL["leave_records"]), snapshots),
        training_aggregates(optional(tables, "training_records", EVENT_DDL["training_records"]), snapshots),
        duty_aggregates(optional(tables, "duty_logs", EVENT_DDL["duty_logs"]), snapshots),
    )
    return wide.select(*KEYS, *_named(window_columns()))


def baselines(tables: dict[str, DataFrame], snapshots: Sequence[date]) -> DataFrame:
    wide = _on_grid(
        grid(tables["personnel"], snapshots),
        duty_aggregates(optional(tables, "duty_logs", EVENT_DDL["duty_logs"]), snapshots),
    )
    return wide.select(*KEYS, *_named(baseline_columns()))


def feature_matrix(tables: dict[str, DataFrame], snapshots: Sequence[date]) -> DataFrame:
    """All three families in one pass: five aggregates joined once on the grid key."""
    wide = _on_grid(
        grid(tables["personnel"], snapshots),
        leave_aggregates(optional(tables, "leave_records", EVENT_DDL["leave_records"]), snapshots),
        deployment_aggregates(optional(tables, "deployment_history", EVENT_DDL["deployment_history"]), snapshots),
        transfer_aggregates(optional(tables, "transfer_records", EVENT_DDL["transfer_records"]), snapshots),
        training_aggregates(optional(tables, "training_records", EVENT_DDL["training_records"]), snapshots),
        duty_aggregates(optional(tables, "duty_logs", EVENT_DDL["duty_logs"]), snapshots),
    )
    hr = {
        **leave_columns(), **deployment_columns(), **transfer_columns(), **duty_columns(), **training_columns()
    }
    return wide.select(
        *KEYS, *CONTEXT, *[hr[n].alias(n) for n in HR_FEATURES],
        *_named(window_columns()), *_named(baseline_columns()),
    )


def assemble(features: DataFrame, windows: DataFrame, base: DataFrame) -> DataFrame:
    """1:1 inner join of the three families on (person, snapshot)."""
    return features.join(windows, KEYS).join(base, KEYS)


def key_check(frame: DataFrame) -> DataFrame:
    """Row count, distinct keys and duplicates of a (person, snapshot) frame."""
    counts = frame.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
