"""Medical booking resolved as table jobs over request logs.

Claims on one slot are settled by the smallest (requested_at, request_id): a
partial-aggregated minimum, so a slot everybody wants costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fettle import policy as P


def current_roster(changes: DataFrame) -> DataFrame:
    """Last write per doctor wins and reactivates."""
    fields = ["name", "specialty", "unit_id", "subject"]
    return changes.filter((F.trim("doctor_id") != "") & (F.trim("name") != "")).groupBy("doctor_id").agg(
        F.max(F.struct("changed_at", "change_id", *fields)).alias("s")
    ).select("doctor_id", *[F.col(f"s.{c}").alias(c) for c in fields], F.lit(True).alias("is_active"))


def active_doctors(roster: DataFrame) -> DataFrame:
    return roster.filter("is_active").select("doctor_id", "name", "specialty", "unit_id").orderBy("name", "doctor_id")


def publish_slots(offers: DataFrame) -> DataFrame:
    """First offer per (doctor, start) is published, later ones are conflicts (counted)."""
    first = F.min(F.struct("offered_at", "slot_id", "minutes")).alias("s")
    return offers.groupBy("doctor_id", "starts_at").agg(first, F.count(F.lit(1)).alias("_n")).select(
        F.col("s.slot_id").alias("slot_id"), "doctor_id", "starts_at", F.col("s.minutes").alias("minutes"),
        (F.col("_n") - 1).alias("conflicting_offers"))


def request_problem() -> Column:
    reason = F.trim(F.coalesce("reason", F.lit("")))
    note = F.when(F.col("shared_context"), F.trim(F.coalesce("context_note", F.lit("")))).otherwise(F.lit(""))
    return (
        F.when(F.trim(F.coalesce("personnel_id", F.lit(""))) == "", "no person")
        .when(F.trim(F.coalesce("slot_id", F.lit(""))) == "", "no slot")
        .when(F.length(reason) > P.MAX_BOOKING_REASON, "reason too long")
        .when(F.length(note) > P.MAX_SHARED_CONTEXT, "context too long"))


def winning_ids(requests: DataFrame) -> DataFrame:
    """The first valid request per slot; free text never enters the shuffle."""
    valid = requests.filter(request_problem().isNull())
    return valid.groupBy("slot_id").agg(F.min(F.struct("requested_at", "request_id")).alias("s")).select(
        "slot_id", F.col("s.request_id").alias("request_id"))


def winners(requests: DataFrame, slots: DataFrame) -> DataFrame:
    """One appointment per known slot; an unshared note is blanked."""
    best = winning_ids(requests).join(slots.select("slot_id", "doctor_id", "starts_at"), "slot_id")
    shared = F.coalesce("shared_context", F.lit(False))
    return requests.join(best, ["slot_id", "request_id"]).select(
        F.concat(F.lit("APT-"), "slot_id").alias("appointment_id"), "request_id", "personnel_id", "doctor_id",
        "slot_id", "starts_at", F.trim(F.coalesce("reason", F.lit(""))).alias("reason"),
        shared.alias("shared_context"),
        F.when(shared, F.trim(F.coalesce("context_note", F.lit("")))).otherwise(F.lit("")).alias("context_note"),
        F.col("requested_at").alias("created_at"))


def claim_outcomes(requests: DataFrame, slots: DataFrame) -> DataFrame:
    """Every request with its outcome: booked, taken, unknown slot, or refused."""
    won = winning_ids(requests).select("slot_id", F.col("request_id").alias("_winner"))
    known = slots.select("slot_id", F.lit(True).alias("_known"))
    judged = requests.select("request_id", "slot_id", "personnel_id", request_problem().alias("_problem"))
    outcome = (
        F.when(F.col("_problem").isNotNull(), "refused").when(F.col("_known").isNull(), "unknown slot")
        .when(F.col("request_id") == F.col("_winner"), "booked").otherwise("taken"))
    return judged.join(known, "slot_id", "left").join(won, "slot_id", "left").withColumn(
        "outcome", outcome).select("request_id", "slot_id", "personnel_id", "outcome")


def with_status(appointments: DataFrame, cancellations: DataFrame, notes: DataFrame) -> DataFrame:
    """Status after owner-only cancellations and the owning doctor's notes.

    A visit whose note precedes the cancellation is completed and stays so.
    """
    cancel = cancellations.groupBy("appointment_id", "personnel_id").agg(F.min("cancelled_at").alias("_cancelled"))
    note = notes.groupBy("appointment_id").agg(F.min("issued_at").alias("_issued"))
    done = F.col("_issued").isNotNull() & (F.col("_cancelled").isNull() | (F.col("_issued") <= F.col("_cancelled")))
    status = F.when(done, "completed").when(F.col("_cancelled").isNotNull(), "cancelled").otherwise("booked")
    return appointments.join(cancel, ["appointment_id", "personnel_id"], "left").join(
        note, "appointment_id", "left").withColumn("status", status).drop("_cancelled", "_issued")


def cancel_outcomes(cancellations: DataFrame, appointments: DataFrame) -> DataFrame:
    """Per cancellation: done, or why not (the answer never reveals another person's visit)."""
    a = appointments.select("appointment_id", F.col("personnel_id").alias("_owner"), F.col("status").alias("_status"))
    outcome = (
        F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col("personnel_id")), "no such appointment")
        .when(F.col("_status") == "completed", "already completed").otherwise("cancelled"))
    return cancellations.join(a, "appointment_id", "left").withColumn("outcome", outcome).drop("_owner", "_status")


def open_slots(slots: DataFrame, roster: DataFrame, appointments: DataFrame, doctor_id: str | None = None,
               limit: int = P.OPEN_SLOT_LIMIT) -> DataFrame:
    """Unbooked slots of active doctors, soonest first. Ordered by time and nothing else."""
    taken = appointments.filter(F.col("status") != "cancelled").select("slot_id")
    doctors = roster.filter("is_active").select("doctor_id", F.col("name").alias("doctor_name"), "specialty", "unit_id")
    free = slots.join(taken, "slot_id", "left_anti")
    if doctor_id is not None:
        free = free.filter(F.col("doctor_id") == doctor_id)
    return free.join(doctors, "doctor_id").select(
        "slot_id", "doctor_id", "starts_at", "minutes", "doctor_name", "specialty", "unit_id"
    ).orderBy("starts_at", "slot_id").limit(limit)


def accept_notes(notes: DataFrame, appointments: DataFrame, roster: DataFrame) -> DataFrame:
    """One note per visit, by the owning doctor: the first valid one."""
    owner = appointments.join(roster.select("doctor_id", "subject"), "doctor_id").select("appointment_id", "subject")
    text = F.trim(F.coalesce("note_text", F.lit("")))
    valid = notes.filter((text != "") & (F.length(text) <= P.MAX_VISIT_NOTE)).join(
        owner, "appointment_id").filter(F.col("subject") == F.col("issued_by"))
    return valid.groupBy("appointment_id").agg(F.min(F.struct("issued_at", "note_text", "issued_by")).alias("s")).select(
        F.concat(F.lit("RX-"), "appointment_id").alias("prescription_id"), "appointment_id",
        F.trim("s.note_text").alias("note_text"), F.col("s.issued_by").alias("issued_by"),
        F.col("s.issued_at").alias("issued_at"))


def for_person(appointments: DataFrame, slots: DataFrame, roster: DataFrame, notes: DataFrame,
               personnel_id: str | None = None) -> DataFrame:
    """Appointments with slot, doctor and note; of one person by time, of all people in no order."""
    rows = appointments if personnel_id is None else appointments.filter(F.col("personnel_id") == personnel_id)
    out = (
        rows.drop("starts_at").join(slots.select("slot_id", "starts_at", "minutes"), "slot_id")
        .join(roster.select("doctor_id", F.col("name").alias("doctor_name"), "specialty"), "doctor_id")
        .join(notes.select("appointment_id", "prescription_id", "note_text", "issued_at"), "appointment_id", "left")
        .select("personnel_id", "appointment_id", "doctor_id", "slot_id", "status", "reason", "shared_context",
                "context_note", "starts_at", "minutes", "doctor_name", "specialty", "prescription_id", "note_text",
                "issued_at"))
    return out if personnel_id is None else out.orderBy("starts_at", "appointment_id")


def for_doctor(appointments: DataFrame, slots: DataFrame, roster: DataFrame, notes: DataFrame,
               subject: str | None = None) -> DataFrame:
    """Schedule without cancelled visits, of one doctor by time; context only where the person shared it."""
    doctors = roster if subject is None else roster.filter(F.col("subject") == subject)
    shown = F.col("shared_context") & (F.col("context_note") != "")
    out = (
        appointments.filter(F.col("status") != "cancelled").drop("starts_at")
        .join(slots.select("slot_id", "starts_at", "minutes"), "slot_id")
        .join(doctors.select("doctor_id", "subject"), "doctor_id")
        .join(notes.select("appointment_id", "prescription_id", "issued_at"), "appointment_id", "left")
        .select("subject", "appointment_id", "personnel_id", "status", "reason", "shared_context",
                F.when(shown, F.col("context_note")).alias("context_note"), "starts_at", "minutes",
                "prescription_id", "issued_at"))
    return out if subject is None else out.orderBy("starts_at", "appointment_id")


def note_for_patient(notes: DataFrame, appointments: DataFrame, roster: DataFrame, asks: DataFrame) -> DataFrame:
    """A note only to the person it was issued to; ``asks`` holds (prescription_id, personnel_id)."""
    full = (
        notes.join(appointments.select("appointment_id", "personnel_id", "doctor_id", "starts_at"), "appointment_id")
        .join(roster.select("doctor_id", F.col("name").alias("doctor_name"), "specialty"), "doctor_id"))
    return full.join(asks, ["prescription_id", "personnel_id"], "left_semi").select(
        "prescription_id", "appointment_id", "note_text", "issued_at", "doctor_name", "specialty", "starts_at")


def table_counts(**tables: DataFrame) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()])
