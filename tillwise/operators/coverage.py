"""Which days the sales cover, and restricting a table to a period."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_coverage(transactions: DataFrame) -> DataFrame:
    """First and last day of sale and the days between them, both ends counted; one row.

    The span counts calendar days, also those without a sale.
    """
    return transactions.agg(F.min("sale_day").alias("first_day"), F.max("sale_day").alias("last_day")).withColumn(
        "n_days", (F.datediff("last_day", "first_day") + 1).cast("bigint")
    )


def days_of(transactions: DataFrame, coverage: DataFrame | None = None) -> Column:
    """The number of days as a scalar subquery: computed once, from the date column alone."""
    return (date_coverage(transactions) if coverage is None else coverage).select("n_days").scalar()


def filter_period(
    df: DataFrame, column: str, start: str | dt.date | None = None, end: str | dt.date | None = None
) -> DataFrame:
    """Rows whose ``column`` lies between ``start`` and ``end``, both included, both optional.

    Plain comparisons with date literals, so they reach the scan and, on a
    table partitioned by that column, prune partitions.
    """
    if start is not None:
        df = df.where(F.col(column) >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(str(end)).cast("date"))
    return df
