"""Counts and date ranges of stored tables from the footers of their Parquet files, without reading a row.

Parquet keeps, for each row group, its number of rows and the least and the
greatest value of each column. Spark's newer Parquet reader answers ``count``,
``min`` and ``max`` over a whole table from those; this module uses it for the
tables that the library has written itself. A file whose days are all NULL has no
least one, at which that reader gives up; the table is then scanned instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tillwise.schemas import CANONICAL, TABLES
from tillwise.sources.tables import session_paths

# Settings under which Spark takes aggregates from footers.
_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def footers_answer(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def footer_aggregate(spark: SparkSession, path: str, table: str, *days: str) -> DataFrame:
    """One row: ``n_rows``, and ``first_…`` and ``last_…`` of each day column. To be planned inside ``footers_answer``."""
    bounds = [f(day).alias(f"{name}_{day}") for day in days for f, name in ((F.min, "first"), (F.max, "last"))]
    return spark.read.schema(CANONICAL[table]).parquet(path).agg(F.count("*").alias("n_rows"), *bounds)


def _answer(spark: SparkSession, path: str, table: str, *days: str) -> Row:
    try:
        with footers_answer(spark):
            row = footer_aggregate(spark, path, table, *days).first().asDict()
    except (PySparkException, Py4JJavaError) as missing:
        # The reader's own advice where a footer lacks a value; any other error stays one.
        if "spark.sql.parquet.aggregatePushdown" not in str(missing):
            raise
        row = footer_aggregate(spark, path, table, *days).first().asDict()
    # A table without files has no footer to count.
    return Row(**{**row, "n_rows": row["n_rows"] or 0})


def session_status(spark: SparkSession, folder: str, session_id: str) -> DataFrame:
    """``dataset, loaded, n_rows`` of a stored session's four tables; one without rows counts as not loaded."""
    rows = [(t, _answer(spark, path, t).n_rows) for t, path in session_paths(spark, folder, session_id).items()]
    return spark.createDataFrame([(t, n > 0, n) for t, n in rows], "dataset string, loaded boolean, n_rows bigint")


def session_coverage(spark: SparkSession, folder: str, session_id: str) -> DataFrame:
    """First and last day of sale of a stored session and the days between them, both ends counted; one row."""
    path = session_paths(spark, folder, session_id)[TABLES[0]]
    row = _answer(spark, path, TABLES[0], "sale_day")
    n_days = (row.last_sale_day - row.first_sale_day).days + 1 if row.first_sale_day else None
    return spark.createDataFrame(
        [(row.first_sale_day, row.last_sale_day, n_days)], "first_day date, last_day date, n_days bigint"
    )
