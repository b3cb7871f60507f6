"""HR-shaped tables derived from the driver tables.

One real day of ``events`` becomes one 30.44-day duty month, so 30 days of
events become about two and a half years of history ending at the reference
date. Every rule is a plain projection or a partial-aggregated group; the only
ordering (end of a deployment = day before the next one) runs over distinct
calendar days per person, whose number does not grow with the event volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fettle import policy as P
from fettle.functions.scales import code, lookup
from fettle.sources.tables import read_table


def _reference() -> Column:
    return F.to_date(F.lit(P.REFERENCE_DATE.isoformat()))


def person_key(user_id: Column) -> Column:
    return code("P", user_id, 5)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return shape_events(read_table(spark, folder, "events"))


def shape_events(raw: DataFrame) -> DataFrame:
    """Event columns plus the number in ``props``, the day and the stretched date (batch or stream)."""
    day = F.dayofmonth("ts")
    back = F.floor((F.lit(31) - day) * F.lit(P.DAYS_PER_MONTH) - F.col("event_id") % 30).cast("int")
    return raw.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        day.alias("d"),
        F.date_sub(_reference(), back).alias("ed"),
    )


def personnel(spark: SparkSession, folder: str, unit_from: str = "n_regionkey") -> DataFrame:
    people = read_table(spark, folder, "events").select("user_id").distinct()
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    uid = F.col("user_id")
    posting_start = F.date_sub(_reference(), ((uid * 37) % 1200).cast("int"))
    rank = F.element_at(F.array(*[F.lit(r) for r in P.RANKS]), (uid % 8 + 1).cast("int"))
    gray = F.element_at(
        F.array(*[F.lit(g) for g in P.GRAY_PROFILES]),
        (F.floor(uid / 20).cast("long") % 5 + 1).cast("int"),
    )
    return (
        people.join(customer, F.col("c_custkey") == uid)
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .withColumn("_start", posting_start)
        .select(
            person_key(uid).alias("personnel_id"),
            code("SN", uid, 7).alias("service_number"),
            F.col("c_name").alias("name"),
            rank.alias("rank"),
            (uid % 8 < 3).alias("is_jawan_rank"),
            code("U", F.col(unit_from), 3).alias("unit_id"),
            F.lower("r_name").alias("region_type"),
            lookup(
                F.col("c_mktsegment"),
                {"BUILDING": "hard_area", "MACHINERY": "hard_area", "HOUSEHOLD": "static_station"},
                "field",
            ).alias("posting_type"),
            F.date_sub(F.to_date(F.lit("1990-01-01")), ((uid * 13) % 5000).cast("int")).alias("date_of_birth"),
            F.when(uid % 50 == 7, F.date_add("_start", 10))
            .otherwise(F.date_sub("_start", (uid % 1000 + 400).cast("int"))).alias("date_of_joining"),
            F.col("_start").alias("current_posting_start_date"),
            (F.col("c_acctbal") < 2000).alias("family_separated"),
            (F.lit(1.0) + F.col("n_regionkey") * F.lit(0.1)).alias("unit_operational_tempo"),
            F.lit(0.5).alias("exposure_propensity"),
            F.when(uid % 20 == 0, gray).alias("benign_profile"),
        )
    )


def unit_capacity(roster: DataFrame) -> DataFrame:
    number = F.substring("unit_id", 2, 9).cast("int")
    return roster.groupBy("unit_id").agg(F.count(F.lit(1)).cast("int").alias("on_strength")).select(
        "unit_id",
        F.concat(F.lit("Unit "), F.col("unit_id")).alias("unit_name"),
        F.ceil(F.col("on_strength") * (F.lit(1.0) + (number % 5) * F.lit(0.1))).cast("int")
        .alias("sanctioned_strength"),
        "on_strength",
    )


def duty_logs(ev: DataFrame) -> DataFrame:
    """Raw duty months: uncapped days and offs, totals that sometimes disagree."""
    mean = F.lit(12.0) + F.avg("value") / F.lit(20.0)
    monthly = ev.groupBy("user_id", "d").agg(
        F.count(F.lit(1)).alias("n"),
        mean.alias("mean_daily_duty_hours"),
        F.coalesce(F.least(F.lit(6.0), F.stddev_samp("value") / F.lit(20.0)), F.lit(0.2))
        .alias("daily_duty_hours_sd"),
        (F.count_if(F.col("event_type") == "error") * 2).cast("int").alias("night_shifts"),
        F.count_if(F.col("event_type") == "view").cast("int").alias("weekly_offs_availed"),
    )
    days = F.lit(20) + F.col("n") * 2
    return monthly.select(
        person_key(F.col("user_id")).alias("personnel_id"),
        F.date_sub(_reference(), F.ceil((F.lit(31) - F.col("d")) * F.lit(P.DAYS_PER_MONTH)).cast("int"))
        .alias("month_start"),
        days.cast("int").alias("days_on_duty"),
        (F.col("mean_daily_duty_hours") * days
         + F.when(F.col("d") % 3 == 0, F.lit(2.0)).otherwise(F.lit(0.0))).alias("total_duty_hours"),
        "mean_daily_duty_hours", "daily_duty_hours_sd", "night_shifts",
        F.lit(4).alias("weekly_offs_entitled"), "weekly_offs_availed",
    )


def leave_records(ev: DataFrame) -> DataFrame:
    """Raw leave spells, some inverted, some with a stated length that is off."""
    span = (F.col("k") % 15 + 1).cast("int")
    return ev.filter(F.col("event_type") == "purchase").select(
        code("L", F.col("event_id")).alias("leave_id"),
        person_key(F.col("user_id")).alias("personnel_id"),
        F.element_at(F.array(F.lit("earned"), F.lit("casual"), F.lit("medical")), (F.col("k") % 3 + 1).cast("int"))
        .alias("leave_type"),
        F.col("ed").alias("start_date"),
        F.when(F.col("event_id") % 17 == 0, F.date_sub("ed", 2)).otherwise(F.date_add("ed", span)).alias("end_date"),
        (span + F.when(F.col("event_id") % 11 == 0, 5).otherwise(0)).cast("double").alias("days_availed"),
    )


def training_records(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_type") == "click").select(
        code("T", F.col("event_id")).alias("training_id"),
        person_key(F.col("user_id")).alias("personnel_id"),
        code("course_", F.col("k") % 7).alias("course_name"),
        F.col("ed").alias("start_date"),
        F.date_add("ed", F.ceil(F.col("value") / F.lit(40.0)).cast("int")).alias("end_date"),
        (F.col("value") / F.lit(5.0)).alias("training_hours"),
    )


def transfer_records(ev: DataFrame) -> DataFrame:
    return ev.filter((F.col("event_type") == "signup") & (F.col("k") % 5 == 0)).select(
        code("X", F.col("event_id")).alias("transfer_id"),
        person_key(F.col("user_id")).alias("personnel_id"),
        code("U", F.col("k") % 4, 3).alias("from_unit_id"),
        code("U", (F.col("k") + 1) % 4, 3).alias("to_unit_id"),
        F.col("ed").alias("transfer_date"),
        F.lit("administrative").alias("transfer_type"),
    )


def deployment_history(ev: DataFrame) -> DataFrame:
    """Spells ending the day before the person's next one; the last stays open.

    The look-ahead runs over distinct days (bounded by the calendar), so a
    person with a third of all events still costs one row per day there.
    """
    spells = ev.filter((F.col("event_type") == "error") & (F.col("k") % 4 == 0)).select(
        "event_id", "user_id", "ed", "k"
    )
    days = (
        spells.groupBy("user_id", "ed").agg(F.max("event_id").alias("last_of_day"))
        .withColumn("next_day", F.lead("ed").over(Window.partitionBy("user_id").orderBy("ed")))
    )
    is_last = F.col("event_id") == F.col("last_of_day")
    end = F.when(is_last, F.date_sub("next_day", 1)).otherwise(F.date_sub("ed", 1))
    location = F.element_at(F.array(*[F.lit(p) for p in P.POSTING_TYPES]), (F.col("k") % 3 + 1).cast("int"))
    return spells.join(days, ["user_id", "ed"]).select(
        code("D", F.col("event_id")).alias("deployment_id"),
        person_key(F.col("user_id")).alias("personnel_id"),
        code("U", F.col("k") % 5, 3).alias("unit_id"),
        location.alias("location_type"),
        F.lit("operational").alias("deployment_type"),
        F.col("ed").alias("start_date"),
        end.alias("end_date"),
        end.isNull().alias("is_current"),
    )


def acoustic_samples(spark: SparkSession, folder: str) -> DataFrame:
    return shape_samples(read_table(spark, folder, "embeddings"))


#: the 64 elements of a vector stand for 3.2 seconds
WAVEFORM_RATE = 20


def shape_samples(emb: DataFrame) -> DataFrame:
    """One check-in per embedding row: label = person, first seven elements = features."""
    age = ((F.col("vec_id") * 7) % 170).cast("int")
    features = [
        F.try_element_at("embedding", F.lit(i + 1)).cast("double").alias(name)
        for i, name in enumerate(P.ACOUSTIC_FEATURES)
    ]
    return emb.select(
        code("V", F.col("vec_id")).alias("sample_id"),
        F.col("vec_id"),
        person_key(F.col("label").cast("long")).alias("personnel_id"),
        F.date_sub(_reference(), age).alias("sample_date"),
        F.when(F.col("vec_id") % 23 == 0, F.lit(" ")).otherwise(F.lit("v1")).alias("consent_version"),
        *features,
        F.col("embedding").alias("waveform"),
    )


def raw_tables(ev: DataFrame, roster: DataFrame) -> dict[str, DataFrame]:
    return {
        "personnel": roster,
        "unit_capacity": unit_capacity(roster),
        "duty_logs": duty_logs(ev),
        "leave_records": leave_records(ev),
        "training_records": training_records(ev),
        "transfer_records": transfer_records(ev),
        "deployment_history": deployment_history(ev),
    }
