"""Carrying a caller's columns through an operator without name clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string


def named(column: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(docs: DataFrame, columns: list[str] | None = None, **extra: Column) -> DataFrame:
    """Columns (all by default) as one struct ``row``, next to the named expressions an operator works on."""
    chosen = [named(c) for c in (docs.columns if columns is None else columns)]
    row = F.struct(*chosen) if chosen else F.struct(F.lit(None).cast("int").alias("none"))
    return docs.select(row.alias("row"), *[v.alias(k) for k, v in extra.items()])


def unpacked(df: DataFrame, columns: list[str], beside: dict[str, Column] | None = None, **results: Column) -> DataFrame:
    """The caller's columns, then the results; a result replaces a column of its name.

    ``beside`` gives the columns that did not travel in ``row``.
    """
    mine, beside = {k.lower() for k in results}, beside or {}
    return df.select(*[(beside[c] if c in beside else F.col("row").getField(c)).alias(c) for c in columns if c.lower() not in mine],
                     *[v.alias(k) for k, v in results.items()])


def layout(df: DataFrame, **extra: str) -> StructType:
    """Schema of ``df`` and further columns given by type strings."""
    more = [StructField(k, _type(v)) for k, v in extra.items()]
    return StructType([*df.schema.fields, *more])


def _type(text: str) -> DataType:
    return _parse_datatype_string(text)
