"""Facts laid out by month: whole results, and only the months asked for are read."""

from __future__ import annotations

import datetime as dt

import pytest
from data import dicts
from pyspark.sql import functions as F

from tillwise.sources import months

D = dt.date
ROWS = [
    (1, D(2024, 1, 31)), (2, D(2024, 2, 1)), (3, D(2024, 2, 29)), (4, D(2024, 3, 1)), (5, D(2025, 2, 14)),
    (6, None), (7, D(1999, 12, 31)), (7, D(1999, 12, 31)), (8, D(2024, 2, 15)),
]


@pytest.fixture(scope="module")
def stored_sales(spark, tmp_path_factory):
    sales = spark.createDataFrame(ROWS, "id int, sale_day date")
    path = str(tmp_path_factory.mktemp("months") / "sales")
    months.save_by_month(sales, path)
    return path, sales.schema


@pytest.mark.parametrize(
    ("start", "end"),
    [("2024-02-01", "2024-02-29"), ("2024-01-31", D(2024, 2, 1)), (None, "2024-02-15"), ("2024-03-01", None), ("2026-01-01", None)],
)
def test_periods_are_whole(spark, stored_sales, start, end):
    found = sorted(r["id"] for r in dicts(months.read_period(spark, *stored_sales, "sale_day", start, end)))
    low, high = D.fromisoformat(str(start or "0001-01-01")), D.fromisoformat(str(end or "9999-12-31"))
    assert found == sorted(i for i, day in ROWS if day and low <= day <= high)


def test_without_bounds_every_row_is_there(spark, stored_sales):
    assert sorted(tuple(r.values()) for r in dicts(months.read_period(spark, *stored_sales)) if r["sale_day"]) == sorted(
        r for r in ROWS if r[1]
    )
    assert [r["id"] for r in dicts(months.read_period(spark, *stored_sales)) if r["sale_day"] is None] == [6]


def test_other_months_stay_closed(spark, stored_sales):
    period = months.read_period(spark, *stored_sales, "sale_day", "2024-02-10", "2024-02-20")
    opened = {r[0] for r in period.withColumn("f", F.input_file_name()).select("f").collect()}
    assert opened and all("_month=202402" in f for f in opened)
    assert "PartitionFilters: [isnotnull(_month" in period._jdf.queryExecution().toString()


def test_several_periods_overlapping_empty_and_turned_round(spark, stored_sales, tmp_path):
    periods = [
        ("feb", D(2024, 2, 1), D(2024, 2, 29)), ("winter", D(2023, 12, 31), D(2024, 2, 1)), ("none", D(2030, 1, 1), D(2030, 1, 2)),
        ("back", D(2024, 3, 1), D(2024, 1, 1)), ("open", D(2024, 1, 1), None), ("century", D(1999, 12, 31), D(2000, 1, 1)),
    ]
    made = spark.createDataFrame(periods, "period string, first_day date, last_day date")
    made.write.parquet(str(tmp_path / "periods"))
    found = months.read_periods(spark, *stored_sales, spark.read.parquet(str(tmp_path / "periods")))
    assert sorted((r["period"], r["id"]) for r in dicts(found)) == sorted(
        (name, i) for name, a, b in periods for i, day in ROWS if day and b and a <= day <= b
    )
    assert "dynamicpruning" in found._jdf.queryExecution().toString()


def test_empty_tables_and_a_clashing_name(spark, tmp_path):
    none = spark.createDataFrame([], "id int, sale_day date")
    months.save_by_month(none, str(tmp_path / "none"))
    assert dicts(months.read_period(spark, str(tmp_path / "none"), none.schema, "sale_day", "2024-01-01")) == []
    with pytest.raises(ValueError, match="_month"):
        months.save_by_month(none.withColumn("_month", F.lit(1)), str(tmp_path / "clash"))
