"""Pseudonyms, disclosure guards and re-identification requests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle import policy as P
from fettle.functions.keyed_hash import pseudonym

# fixed values: the two identifier namespaces
PSEUDONYM_PATTERN = r"^PSN[0-9a-f]{16}$"
SERVICE_PATTERN = r"^P\d{5,}$"


class IndividualDataLeak(ValueError):
    """A unit-level dataset carries an individual field."""


def strip_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*P.DIRECT_IDENTIFIERS)


def pseudonymise(df: DataFrame, key: bytes) -> DataFrame:
    if "personnel_id" not in df.columns:
        return df
    return strip_identifiers(df.withColumn("pseudonym_id", pseudonym(F.col("personnel_id"), key)))


def pseudonymise_all(tables: dict[str, DataFrame], key: bytes) -> dict[str, DataFrame]:
    """Every table without direct identifiers.

    A pseudonym is two digests, so it is taken once per person of the roster and met by
    the event rows; only rows of somebody not on it compute their own.
    """
    people = identity_map(tables["personnel"], key) if "personnel" in tables else None

    def known(name: str, df: DataFrame) -> DataFrame:
        if people is None or name == "personnel" or "personnel_id" not in df.columns:
            return pseudonymise(df, key)
        met = df.join(people.withColumnRenamed("pseudonym_id", "_known"), "personnel_id", "left")
        own = F.coalesce("_known", pseudonym(F.col("personnel_id"), key))
        return strip_identifiers(met.withColumn("pseudonym_id", own).drop("_known"))

    out = {name: known(name, df) for name, df in tables.items()}
    for name, df in out.items():
        left = set(df.columns) & set(P.DIRECT_IDENTIFIERS)
        if left:
            raise IndividualDataLeak(f"{name} still carries {sorted(left)}")
    return out


def identity_map(personnel: DataFrame, key: bytes) -> DataFrame:
    return personnel.select("personnel_id").distinct().withColumn(
        "pseudonym_id", pseudonym(F.col("personnel_id"), key))


def newly_registered(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Identities not yet in the map; registering twice adds nothing."""
    return incoming.join(known.select("pseudonym_id"), "pseudonym_id", "left_anti")


def resolve_requests(requests: DataFrame, identities: DataFrame) -> DataFrame:
    """Gate a batch of re-identification requests; every attempt is kept, granted or not."""
    role_ok = F.coalesce(F.col("requester_role").isin(*P.REIDENTIFY_ROLES), F.lit(False))
    purpose_ok = F.trim(F.coalesce("purpose", F.lit(""))) != ""
    found = F.col("_person").isNotNull()
    reason = (
        F.when(~role_ok, "role not permitted").when(~purpose_ok, "purpose required")
        .when(~found, "unknown pseudonym").otherwise("granted")
    )
    known = identities.select("pseudonym_id", F.col("personnel_id").alias("_person"))
    return (
        requests.join(known, "pseudonym_id", "left")
        .withColumn("granted", role_ok & purpose_ok & found)
        .withColumn("decision", reason)
        .withColumn("personnel_id", F.when(F.col("granted"), F.col("_person")))
        .drop("_person")
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    at = F.when(F.col("granted"), F.col("requested_at"))
    return audit.groupBy("pseudonym_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("granted").alias("granted"),
        F.count_if(~F.col("granted")).alias("refused"),
        F.min(at).alias("first_resolved_at"),
        F.max(at).alias("last_resolved_at"),
    )


def newest(log: DataFrame, limit: int, *order: str) -> DataFrame:
    """Newest rows; a per-task top-n followed by one merge."""
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def namespace(subject: Column) -> Column:
    s = F.trim(F.coalesce(subject.cast("string"), F.lit("")))
    return (
        F.when(s == "", "blank").when(s.rlike(PSEUDONYM_PATTERN), "pseudonym")
        .when(s.rlike(SERVICE_PATTERN), "service_identity").otherwise("unknown")
    )


def field_names(schema: T.DataType) -> Iterable[str]:
    """Every field name of a schema at any depth."""
    if isinstance(schema, T.StructType):
        for field in schema.fields:
            yield field.name
            yield from field_names(field.dataType)
    elif isinstance(schema, T.ArrayType):
        yield from field_names(schema.elementType)
    elif isinstance(schema, T.MapType):
        yield from field_names(schema.keyType)
        yield from field_names(schema.valueType)


def individual_fields(df: DataFrame) -> list[str]:
    return sorted(set(field_names(df.schema)) & set(P.INDIVIDUAL_FIELDS))


def assert_unit_level(df: DataFrame) -> DataFrame:
    """Refuse a dataset for commanders that carries an individual field anywhere."""
    leaked = individual_fields(df)
    if leaked:
        raise IndividualDataLeak(f"unit-level dataset carries {leaked}")
    return df


def assert_absent(df: DataFrame, columns: Iterable[str] = P.GENERATION_ONLY_COLUMNS) -> DataFrame:
    present = sorted(set(field_names(df.schema)) & set(columns))
    if present:
        raise IndividualDataLeak(f"generation-only columns present: {present}")
    return df


def suppress_small(df: DataFrame, count: str, columns: Iterable[str], least: int = P.MIN_UNIT_SIZE) -> DataFrame:
    shown = F.col(count) >= least
    for name in columns:
        df = df.withColumn(name, F.when(shown, F.col(name)))
    return df.withColumn("is_suppressed", ~shown)


def own_rows(df: DataFrame, pseudonym_id: str) -> DataFrame:
    return df.filter(F.col("pseudonym_id") == pseudonym_id)


def officer_rows(cases: DataFrame) -> DataFrame:
    return cases.filter(F.coalesce("is_officer_visible", F.lit(False)))
