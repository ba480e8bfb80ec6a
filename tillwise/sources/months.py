"""Facts laid out by month, so that a period opens the files of its own months and no others."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.operators.coverage import filter_period

MONTH = "_month"


def _month(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def _month_of(day: str | dt.date) -> int:
    day = dt.date.fromisoformat(str(day))
    return day.year * 100 + day.month


def save_by_month(df: DataFrame, path: str, day: str = "sale_day") -> None:
    """Store ``df`` in a folder per month of ``day``; rows without a day have a folder of their own.

    A month with a third of all rows is many tasks' work: rows are dealt out by
    month and content, so only rows alike in every column stay together.
    """
    if MONTH in df.columns:
        raise ValueError(f"a column is already called {MONTH}")
    dealt = df.withColumn(MONTH, _month(F.col(day))).repartitionByRange(MONTH, F.xxhash64(*df.columns))
    dealt.write.partitionBy(MONTH).parquet(path)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema, T.StructField(MONTH, T.IntegerType())])).parquet(path)


def read_period(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    day: str = "sale_day",
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
) -> DataFrame:
    """The rows between two days, both included, both optional; without either also those that have no day."""
    df = _stored(spark, path, schema)
    if start is not None:
        df = df.where(F.col(MONTH) >= _month_of(start))
    if end is not None:
        df = df.where(F.col(MONTH) <= _month_of(end))
    return filter_period(df, day, start, end).drop(MONTH)


def read_periods(
    spark: SparkSession, path: str, schema: T.StructType, periods: DataFrame, day: str = "sale_day"
) -> DataFrame:
    """The rows of several periods (``period``, ``first_day``, ``last_day``), with the name of theirs.

    A row in two periods appears twice; a period that ends before it begins, or
    lacks a day, holds nothing. The periods' months prune the stored ones while
    the query runs, wherever the periods are small enough to broadcast.
    """
    months = F.sequence(F.trunc("first_day", "month"), F.col("last_day"), F.expr("interval 1 month"))
    named = periods.where("first_day <= last_day").select(
        "period", "first_day", "last_day", F.explode(F.transform(months, _month)).alias(MONTH)
    )
    inside = _stored(spark, path, schema).join(named, MONTH).where(F.col(day).between(F.col("first_day"), F.col("last_day")))
    return inside.select("period", *schema.names)
