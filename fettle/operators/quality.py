"""Data-quality checks: they report, they never repair.

All column checks of a table are one aggregate (one scan, partial sums). The
text of unexpected values is listed from distinct pairs, so a common bad value
costs one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fettle.operators.spread import settle
from fettle.sources.ingest import BOOLEAN_WORDS, parse_date, parse_number
from fettle.sources.schemas import Table

REPORT = "table_name string, severity string, check_name string, column_name string, problem_count long, detail string"


def readable(text: Expr, kind: str) -> Expr:
    """Whether a non-null cell can be read as ``kind``."""
    if kind == "string":
        return F.lit(True)
    if kind == "boolean":
        return F.lower(F.trim(text)).isin(*BOOLEAN_WORDS)
    if kind == "date":
        return parse_date(text).isNotNull()
    number = parse_number(text)
    if kind == "integer":
        return number.isNotNull() & (number % 1 == 0)
    return number.isNotNull()


def unreadable_count(name: str, kind: str) -> Expr:
    c = F.col(name)
    return F.count_if(c.isNotNull() & ~F.coalesce(readable(c, kind), F.lit(False)))


def empty_count(name: str, kind: str) -> Expr:
    c = F.col(name)
    blank = (F.trim(c) == "") if kind == "string" else F.lit(False)
    return F.count_if(c.isNull() | F.coalesce(blank, F.lit(False)))


def negative_count(name: str) -> Expr:
    return F.count_if(parse_number(F.col(name)) < 0)


def inverted_count(start: str = "start_date", end: str = "end_date") -> Expr:
    return F.count_if(parse_date(F.col(end)) < parse_date(F.col(start)))


def column_counts(df: DataFrame, table: Table) -> DataFrame:
    """(column, check, count) for every cell check, from one pass over the table."""
    have = set(df.columns)
    aggs: list[tuple[str, str, Expr]] = []
    for c in table.columns:
        if c.name not in have:
            continue
        aggs.append((c.name, "unreadable", unreadable_count(c.name, c.kind)))
        if not c.nullable:
            aggs.append((c.name, "empty", empty_count(c.name, c.kind)))
        if c.non_negative:
            aggs.append((c.name, "negative", negative_count(c.name)))
    if {"start_date", "end_date"} <= have:
        aggs.append(("end_date", "inverted", inverted_count()))
    one = df.agg(*[expr.alias(f"c{i}") for i, (_, _, expr) in enumerate(aggs)])
    entries = F.array(*[
        F.struct(F.lit(col).alias("column_name"), F.lit(check).alias("check_name"),
                 F.col(f"c{i}").alias("problem_count"))
        for i, (col, check, _) in enumerate(aggs)
    ])
    return one.select(F.inline(entries))


def unexpected_by_column(df: DataFrame, allowed: dict[str, tuple[str, ...]], show: int = 5) -> DataFrame:
    """Per column the distinct values outside its allowed set: how many, and the first few sorted.

    One pass for all columns; a value is shuffled once per task, the examples are a running
    minimum list of ``show`` entries, never the whole set.
    """
    odd = [F.when(~F.col(c).isin(*values), F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))) for c, values in allowed.items()]
    distinct = df.select(F.explode(F.array_compact(F.array(*odd))).alias("o")).select("o.*").distinct()
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    first = distinct.withColumn("_r", rank).filter(F.col("_r") <= show).groupBy("column_name").agg(
        F.concat_ws(",", F.array_sort(F.collect_list("value"))).alias("examples"))
    counts = distinct.groupBy("column_name").agg(F.count(F.lit(1)).alias("problem_count"))
    return counts.join(first, "column_name")


def unexpected_values(df: DataFrame, column: str, allowed: tuple[str, ...], show: int = 5) -> DataFrame:
    """The same for one column; always one row."""
    found = unexpected_by_column(df, {column: allowed}, show)
    return found.agg(F.coalesce(F.max("problem_count"), F.lit(0)).alias("problem_count"), F.coalesce(F.max("examples"), F.lit("")).alias("examples"))


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows after the first per key."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("problem_count"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str, show: int = 3) -> DataFrame:
    """Distinct child keys with no parent: how many, and the first few, from one anti join."""
    keys = child.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    known = parent.select(F.col(parent_key).cast("string").alias("value")).distinct()
    lost = settle(keys.join(known, "value", "left_anti"))
    first = lost.orderBy("value").limit(show).agg(
        F.concat_ws(",", F.array_sort(F.collect_list("value"))).alias("examples"))
    return lost.agg(F.count(F.lit(1)).alias("problem_count")).crossJoin(F.broadcast(first))


def column_set_report(df: DataFrame, table: Table) -> DataFrame:
    """Missing required columns (errors) and unknown ones (warnings)."""
    have, want = set(df.columns), {c.name: c for c in table.columns}
    rows = [(table.name, "error", "missing_column", n, 1, "") for n, c in want.items() if c.required and n not in have]
    rows += [(table.name, "warning", "unexpected_column", n, 1, "") for n in sorted(have - set(want))]
    return df.sparkSession.createDataFrame(rows, REPORT)


def problems(df: DataFrame, table: Table) -> DataFrame:
    """Every failed check of one table as rows, from three passes: cells, distinct values, keys."""
    parts = [column_set_report(df, table)]

    def report(rows: DataFrame, check: Expr, column: Expr, detail: Expr) -> DataFrame:
        return rows.select(F.lit(table.name).alias("table_name"), F.lit("error").alias("severity"), check.alias("check_name"),
                           column.alias("column_name"), "problem_count", detail.alias("detail"))

    if set(table.names) & set(df.columns):
        parts.append(report(column_counts(df, table), F.col("check_name"), F.col("column_name"), F.lit("")))
    if allowed := {c.name: c.allowed for c in table.columns if c.allowed and c.name in df.columns}:
        parts.append(report(unexpected_by_column(df, allowed), F.lit("unexpected_value"), F.col("column_name"), F.col("examples")))
    if table.primary_key and set(table.primary_key) <= set(df.columns):
        parts.append(report(duplicate_keys(df, table.primary_key), F.lit("duplicate_key"), F.lit(",".join(table.primary_key)), F.lit("")))
    return reduce(DataFrame.unionByName, parts).filter(F.col("problem_count") > 0)


def table_reports(tables: dict[str, DataFrame], specs: dict[str, Table]) -> DataFrame:
    """One row per table: row count, errors, warnings, verdict; foreign keys are checked between the tables given.

    Each table is derived once and written for its passes.
    """
    out, tables = [], {name: settle(given) for name, given in tables.items()}
    for name, df in tables.items():
        found = problems(df, specs[name]).unionByName(referential_report(tables, specs, [name])).agg(
            F.count_if(F.col("severity") == "error").alias("error_count"),
            F.count_if(F.col("severity") == "warning").alias("warning_count"),
            F.concat_ws("; ", F.array_sort(F.collect_list(
                F.concat_ws(":", "check_name", "column_name", F.col("problem_count").cast("string"))
            ))).alias("findings"),
        )
        rows = df.agg(F.count(F.lit(1)).alias("row_count"))
        out.append(rows.crossJoin(F.broadcast(found)).select(
            F.lit(name).alias("table_name"), "row_count", "error_count", "warning_count", "findings",
            (F.col("error_count") == 0).alias("is_valid")))
    return reduce(DataFrame.unionByName, out)


def referential_report(tables: dict[str, DataFrame], specs: dict[str, Table], names: list[str] | None = None) -> DataFrame:
    """Foreign keys of ``names`` (all by default) that do not resolve; tables not given are skipped."""
    parts = []
    for name in names or list(tables):
        df = tables[name]
        for column, (parent, key) in specs[name].foreign_keys.items():
            if parent in tables and column in df.columns and key in tables[parent].columns:
                parts.append(orphans(df, column, tables[parent], key).select(
                    F.lit(name).alias("table_name"), F.lit("error").alias("severity"),
                    F.lit("orphan").alias("check_name"), F.lit(column).alias("column_name"), "problem_count",
                    F.col("examples").alias("detail")))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], REPORT)
    return reduce(DataFrame.unionByName, parts).filter(F.col("problem_count") > 0)
