"""Declared table schemas: kinds, nullability, keys. Never inferred."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

from fettle import policy as P

KIND_TYPES = {
    "string": T.StringType(), "integer": T.IntegerType(), "float": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(),
}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    required: bool = True
    nullable: bool = False
    non_negative: bool = False
    allowed: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)
    description: str = ""

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> T.StructType:
        """Spark schema with the extra rules in the field metadata."""
        return T.StructType([
            T.StructField(c.name, KIND_TYPES[c.kind], True, {
                "kind": c.kind, "required": c.required, "nullable": c.nullable,
                "non_negative": c.non_negative, "allowed_values": list(c.allowed) if c.allowed else [],
            })
            for c in self.columns
        ])


# fixed values: the declared tables
TABLES: dict[str, Table] = {t.name: t for t in (
    Table("unit_capacity", (
        Column("unit_id", "string"),
        Column("unit_name", "string"),
        Column("region_type", "string"),
        Column("operational_tempo", "float", non_negative=True),
        Column("sanctioned_strength", "integer", non_negative=True),
        Column("on_strength", "integer", non_negative=True),
        Column("staffing_ratio", "float", non_negative=True),
    ), ("unit_id",), {}, "Establishment strength and staffing per unit."),
    Table("personnel", (
        Column("personnel_id", "string"),
        Column("service_number", "string"),
        Column("name", "string"),
        Column("rank", "string", allowed=P.RANKS),
        Column("is_jawan_rank", "boolean"),
        Column("unit_id", "string"),
        Column("region_type", "string"),
        Column("posting_type", "string", allowed=P.POSTING_TYPES),
        Column("date_of_birth", "date"),
        Column("date_of_joining", "date"),
        Column("years_of_service", "float", non_negative=True),
        Column("current_posting_start_date", "date"),
        Column("family_separated", "boolean"),
        Column("unit_operational_tempo", "float", non_negative=True),
        Column("exposure_propensity", "float", non_negative=True),
        Column("benign_profile", "string", nullable=True, allowed=("", *P.GRAY_PROFILES)),
    ), ("personnel_id",), {"unit_id": ("unit_capacity", "unit_id")}, "The roster, one row per person."),
    Table("leave_records", (
        Column("leave_id", "string"),
        Column("personnel_id", "string"),
        Column("leave_type", "string"),
        Column("start_date", "date"),
        Column("end_date", "date"),
        Column("days_availed", "float", non_negative=True),
    ), ("leave_id",), {"personnel_id": ("personnel", "personnel_id")}, "Leave spells."),
    Table("deployment_history", (
        Column("deployment_id", "string"),
        Column("personnel_id", "string"),
        Column("unit_id", "string"),
        Column("location_type", "string", allowed=P.POSTING_TYPES),
        Column("deployment_type", "string"),
        Column("start_date", "date"),
        Column("end_date", "date", nullable=True),
        Column("is_current", "boolean"),
    ), ("deployment_id",), {"personnel_id": ("personnel", "personnel_id"), "unit_id": ("unit_capacity", "unit_id")}, "Deployment spells."),
    Table("duty_logs", (
        Column("personnel_id", "string"),
        Column("month_start", "date"),
        Column("days_on_duty", "integer", non_negative=True),
        Column("total_duty_hours", "float", non_negative=True),
        Column("mean_daily_duty_hours", "float", non_negative=True),
        Column("daily_duty_hours_sd", "float", non_negative=True),
        Column("night_shifts", "integer", non_negative=True),
        Column("weekly_offs_entitled", "integer", non_negative=True),
        Column("weekly_offs_availed", "integer", non_negative=True),
    ), ("personnel_id", "month_start"), {"personnel_id": ("personnel", "personnel_id")}, "Monthly duty summary."),
    Table("transfer_records", (
        Column("transfer_id", "string"),
        Column("personnel_id", "string"),
        Column("from_unit_id", "string"),
        Column("to_unit_id", "string"),
        Column("transfer_date", "date"),
        Column("transfer_type", "string"),
    ), ("transfer_id",), {"personnel_id": ("personnel", "personnel_id")}, "Transfers between units."),
    Table("training_records", (
        Column("training_id", "string"),
        Column("personnel_id", "string"),
        Column("course_name", "string"),
        Column("start_date", "date"),
        Column("end_date", "date"),
        Column("training_hours", "float", non_negative=True),
    ), ("training_id",), {"personnel_id": ("personnel", "personnel_id")}, "Training courses."),
    Table("voice_samples", (
        Column("sample_id", "string"),
        Column("personnel_id", "string"),
        Column("sample_date", "date"),
        Column("consent_version", "string"),
        Column("duration_sec", "float", non_negative=True),
        Column("audio_path", "string"),
        Column("latent_strain", "float", required=False, nullable=True),
    ), ("sample_id",), {"personnel_id": ("personnel", "personnel_id")}, "Voluntary check-in recordings."),
    Table("ground_truth_labels", (
        Column("personnel_id", "string"),
        Column("snapshot_date", "date"),
        Column("synthetic_welfare_risk_score", "float", non_negative=True),
    ), ("personnel_id", "snapshot_date"), {"personnel_id": ("personnel", "personnel_id")}, "Training labels, never read when scoring."),
)}


def schema_document(tables: dict[str, Table] = TABLES) -> str:
    """All schemas as one JSON document."""
    return json.dumps({
        name: {
            "description": t.description, "primary_key": list(t.primary_key),
            "foreign_keys": {c: parent for c, (parent, _) in t.foreign_keys.items()},
            "columns": [
                {"name": c.name, "kind": c.kind, "required": c.required, "nullable": c.nullable,
                 "non_negative": c.non_negative, "allowed_values": list(c.allowed) if c.allowed else None}
                for c in t.columns
            ],
        } for name, t in tables.items()
    }, indent=2)
