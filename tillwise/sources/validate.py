"""Checks on incoming tables: required columns, emptiness, row counts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.schemas import REQUIRED_COLUMNS, TABLES


class SchemaError(ValueError):
    """A table lacks required columns."""


def missing_columns(df: DataFrame, table: str, dialect: str = "pos") -> list[str]:
    return [c for c in REQUIRED_COLUMNS[dialect][table] if c not in df.columns]


def table_problems(df: DataFrame, table: str, dialect: str = "pos") -> list[str]:
    """What keeps ``df`` from being used as ``table``, in words; in the web dialect also that it is empty."""
    if dialect == "web" and df.isEmpty():
        return [f"{table}: file is empty"]
    missing = missing_columns(df, table, dialect)
    if not missing:
        return []
    return [f"{table}: missing required columns {', '.join(missing)}; available columns {', '.join(df.columns)}"]


def require_columns(df: DataFrame, table: str, dialect: str = "pos") -> DataFrame:
    """``df`` itself, or an error naming what is missing and what is there."""
    problems = table_problems(df, table, dialect)
    if problems:
        raise SchemaError(problems[0])
    return df


def schema_report(
    tables: Mapping[str, DataFrame],
    dialect: str = "pos",
    empty_is_error: bool | None = None,
    with_available: bool = False,
) -> DataFrame:
    """``file, n_rows, errors`` for every table given, all problems at once; no errors is an empty list.

    ``with_available`` adds ``available``: the columns that a table with missing ones has instead.

    That a file is empty is an error in the web dialect only, and then the only
    one reported, since an empty file shows no columns.
    """
    if empty_is_error is None:
        empty_is_error = dialect == "web"
    reports = []
    for table, df in tables.items():
        missing = missing_columns(df, table, dialect)
        found = F.array(*[F.lit(f"Missing required columns: {', '.join(missing)}")] if missing else []).cast(
            "array<string>"
        )
        there = F.array(*[F.lit(c) for c in df.columns if missing]).cast("array<string>")
        is_empty = (F.col("n_rows") == 0) & F.lit(empty_is_error)
        errors = F.when(is_empty, F.array(F.lit("File is empty"))).otherwise(found)
        reports.append(
            df.agg(F.count("*").alias("n_rows")).select(F.lit(table).alias("file"), "n_rows", errors.alias("errors"), there.alias("available"))
        )
    report = reduce(DataFrame.unionByName, reports)
    return report if with_available else report.drop("available")


def dataset_status(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``dataset, loaded, n_rows`` for each of the four expected tables, also those not there."""
    rows = []
    for table in TABLES:
        if table in tables:
            rows.append(
                tables[table].agg(F.count("*").alias("n_rows")).select(
                    F.lit(table).alias("dataset"), F.lit(True).alias("loaded"), "n_rows"
                )
            )
        else:
            rows.append(
                spark.range(1).select(
                    F.lit(table).alias("dataset"), F.lit(False).alias("loaded"), F.lit(0).cast("bigint").alias("n_rows")
                )
            )
    return reduce(DataFrame.unionByName, rows)
