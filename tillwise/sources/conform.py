"""From a file's own columns to the canonical table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.strings import strip
from tillwise.schemas import CANONICAL, RENAMES, REQUIRED_COLUMNS
from tillwise.sources.order import LOAD_NO


def conform(df: DataFrame, table: str, dialect: str = "pos", strict: bool = False) -> DataFrame:
    """Rename to canonical columns, cast to canonical types, add the columns this dialect lacks as NULL.

    A value that does not fit its type becomes NULL, or an error if ``strict``;
    ``ledger.audited`` does the same and marks what was lost.
    """
    named, columns = conform_columns(df, table, dialect, strict)
    return named.select(*columns)


def conform_columns(
    df: DataFrame, table: str, dialect: str = "pos", strict: bool = False
) -> tuple[DataFrame, list[Column]]:
    """``df`` under canonical names, and the canonical columns over it; the order of loading, where known, stays."""
    named = df.withColumnsRenamed(RENAMES.get(dialect, {}).get(table, {}))
    order = [F.col(LOAD_NO)] if LOAD_NO in named.columns else []
    return named, [
        (cast_value(named, field, strict) if field.name in named.columns else F.lit(None).cast(field.dataType)).alias(field.name)
        for field in CANONICAL[table].fields
    ] + order


def given_value(df: DataFrame, field: T.StructField) -> Column:
    """The value as the file has it; for a number or a date a blank text is none."""
    column = F.col(field.name)
    if isinstance(df.schema[field.name].dataType, T.StringType) and not isinstance(field.dataType, T.StringType):
        column = F.nullif(strip(column), F.lit(""))
    return column


def cast_value(df: DataFrame, field: T.StructField, strict: bool = False) -> Column:
    return cast_given(df, field, given_value(df, field), strict)


def cast_given(df: DataFrame, field: T.StructField, column: Column, strict: bool = False) -> Column:
    """``column``, which holds what ``given_value`` gives, in the field's type."""
    if isinstance(field.dataType, T.DateType) and isinstance(df.schema[field.name].dataType, T.StringType):
        # Dates may carry a time of day; the day is what counts.
        moment = F.to_timestamp(column) if strict else F.try_to_timestamp(column)
        return F.to_date(moment)
    return column.cast(field.dataType) if strict else column.try_cast(field.dataType)


def to_dialect(df: DataFrame, table: str, dialect: str = "pos") -> DataFrame:
    """The canonical table under the column names, and with the columns, of one dialect."""
    back = {canonical: own for own, canonical in RENAMES.get(dialect, {}).get(table, {}).items()}
    return df.withColumnsRenamed(back).select(*REQUIRED_COLUMNS[dialect][table])
