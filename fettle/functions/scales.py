"""Null-preserving numeric scales as Column expressions.

Missing is always SQL NULL here. ``least``/``greatest`` skip NULLs, so every
clip is guarded: a missing input must never turn into a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from fettle import policy as P


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def saturate(value: Column, saturation: float, floor: float = 0.0,
             out_min: float = P.SIGNAL_MIN, out_max: float = P.SIGNAL_MAX) -> Column:
    """Linear from ``floor`` to ``saturation``, flat outside, NULL stays NULL."""
    if saturation <= floor:
        raise ValueError(f"saturation {saturation} must exceed floor {floor}")
    share = clip((value.cast("double") - F.lit(floor)) / F.lit(saturation - floor), 0.0, 1.0)
    return F.lit(out_min) + share * F.lit(out_max - out_min)


def saturate_inverse(value: Column, saturation: float, floor: float = 0.0,
                     out_min: float = P.SIGNAL_MIN, out_max: float = P.SIGNAL_MAX) -> Column:
    """Same scale with low values meaning concern."""
    return F.lit(out_max) - (saturate(value, saturation, floor, out_min, out_max) - F.lit(out_min))


def zscore(value: Column, mean: Column, sd: Column, min_sd: float = 1e-6) -> Column:
    floored = F.when(sd < min_sd, F.lit(min_sd)).otherwise(sd)
    return (value - mean) / floored


def robust_zscore(value: Column, median: Column, iqr: Column, min_scale: float = 1e-6) -> Column:
    scale = iqr / F.lit(P.IQR_TO_SD)
    return (value - median) / F.when(scale < min_scale, F.lit(min_scale)).otherwise(scale)


def to_signal_range(value: Column) -> Column:
    return clip(value, P.SIGNAL_MIN, P.SIGNAL_MAX)


def percent(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """100·n/d, with ``default`` only where the denominator is zero or missing."""
    bad = denominator.isNull() | (denominator == 0)
    return F.when(bad, F.lit(default).cast("double")).otherwise(
        F.try_divide(F.lit(100.0) * numerator, denominator.cast("double"))
    )


def completeness(available: list[str], expected: list[str]) -> Column:
    """Share of ``expected`` columns that are present and non-null in a row."""
    if not expected:
        return F.lit(1.0)
    filled = F.lit(0)
    for name in expected:
        if name in available:
            filled = filled + F.col(name).isNotNull().cast("int")
    return filled / F.lit(float(len(expected)))


def blend(*parts: tuple[Column, float]) -> Column:
    """Weighted mean over the non-null parts; all null gives NULL."""
    total = sum(weight for _, weight in parts)
    if abs(total - 1.0) > 1e-9:
        raise ValueError(f"weights sum to {total}")
    weighted, available = F.lit(0.0), F.lit(0.0)
    for value, weight in parts:
        weighted = weighted + F.coalesce(value, F.lit(0.0)) * F.lit(weight)
        available = available + F.when(value.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
    return to_signal_range(F.try_divide(weighted, available))


def positive_z(z: Column, saturation_sd: float = P.PERSONAL_Z_SATURATION) -> Column:
    return saturate(z, saturation_sd, 0.0)


def rank_ties_averaged(value: Column, *group: str) -> Column:
    """Average rank inside a group known to be small (for large ones see ``spread.tied_ranks``)."""
    ordered = Window.partitionBy(*group).orderBy(value)
    tied = Window.partitionBy(*group, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - F.lit(1)) / F.lit(2.0)


def lookup(value: Column, mapping: dict, default=None) -> Column:
    """CASE over a fixed mapping."""
    expr = F.lit(default)
    for key, mapped in mapping.items():
        expr = F.when(value == F.lit(key), F.lit(mapped)).otherwise(expr)
    return expr


def hash_bucket(key: Column, seed: int, buckets: int = 100) -> Column:
    """Stable bucket of a key: the first 8 hex digits of md5(key:seed), modulo."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def code(prefix: str, number: Column, width: int = 0) -> Column:
    """``prefix`` + zero-padded number, NULL for NULL; stays in codegen (no formatter per row)."""
    digits = number.cast("string")
    if width:
        digits = F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))
    return F.concat(F.lit(prefix), digits)
