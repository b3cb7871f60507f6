"""Where a pattern matches, as Column expressions.

Spark returns what a regular expression matched but not where. ``split`` with the
same pattern gives what lies between the matches, so the running sum of the two
lengths is the position, in code points.

The patterns given to it must match at least one character, and should be free of
nested greedy loops: Java's matcher recurses once per round of those, so long texts
need the possessive forms (``++``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<start:long,end:long,found:string>>"


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: ``array<struct<start, end, found>>``, end exclusive.

    Only texts that match at all are cut up. Null text gives an empty array.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(
        F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), hit.alias("found")))
    none = F.array().cast(EMPTY)
    state = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(steps, state, step, lambda acc: acc["spans"])).otherwise(none)


def labelled(spans: Column, kind: str, rank: int) -> Column:
    """Spans as ``array<struct<start, rank, end, kind>>``, the common form of all kinds."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span in the given order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def clear_of(span: Column, others: Column) -> Column:
    """True where ``span`` overlaps none of ``others``."""
    return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def normal_tail(z: Column) -> Column:
    """P(Z <= z) of the normal distribution, by the fixed five-term polynomial (error under 1e-7)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 0.3989422804014327 * F.exp(-z * z / 2.0) * poly
    return F.when(z < 0, upper).otherwise(1.0 - upper)
