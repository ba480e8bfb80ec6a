"""Snapshots merged from states against snapshots of the sales themselves."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from data import DAY, dicts, sale, table
from pyspark.errors import PySparkException

from tillwise.operators import snapshot, states
from tillwise.operators.coverage import filter_period
from tillwise.schemas import empty_tables

DAYS = [DAY + dt.timedelta(days=9 * i) for i in range(24)]


def shop(spark, text_ids=False):
    name = str if text_ids else int
    sales = [
        # Transaction 7 has lines on many days; ids lie in several ranges.
        sale(f"p{i % 5}", qty=i % 4 + 1, price=Decimal("1.25") * (i % 7 + 1), day=day, discount=Decimal("0.1"),
             transaction_id=str(name(i * 20_000 if i % 3 else 7)), payment_type=["CARD", "cash ", "VOUCHER"][i % 3])
        for i, day in enumerate(DAYS * 2)
    ]
    refunds = table(spark, "refunds", [
        {"refund_id": str(i), "original_transaction_id": "7", "refund_date": d, "refund_amount": Decimal("2.5")} for i, d in enumerate(DAYS)
    ])
    payouts = table(spark, "payouts", [
        {"covering_sales_date": d, "gross_card_volume": 10, "processor_fees": Decimal("0.25"), "net_payout_amount": Decimal("9.75"),
         "payout_date": d} for d in DAYS
    ])
    return table(spark, "transactions", sales), refunds, payouts


@pytest.mark.parametrize("grain", ["day", "month", "year"])
def test_merged_states_equal_the_snapshot(spark, grain):
    tables = shop(spark)
    made = states.snapshot_states(*tables, grain=grain)
    assert dicts(states.merged_snapshot(made)) == dicts(snapshot.executive_snapshot(*tables))


def test_a_period_is_a_merge_of_its_months(spark):
    tx, refunds, payouts = shop(spark, text_ids=True)
    made = states.snapshot_states(tx, refunds, payouts)
    first, last = "2024-04-01", "2024-06-30"
    part = snapshot.executive_snapshot(
        filter_period(tx, "sale_day", first, last), filter_period(refunds, "refund_date", first, last),
        filter_period(payouts, "covering_sales_date", first, last),
    )
    assert dicts(states.merged_snapshot(made, first, "2024-06-01")) == dicts(part)
    assert dicts(part)[0]["transactions"] < tx.count()


def test_missing_ids_days_and_tables(spark):
    nothing = empty_tables(spark)
    tx = table(spark, "transactions", [sale("A", transaction_id=None), sale("B", transaction_id="3"), sale("C", transaction_id="-3", day=None)])
    for sales in (tx, nothing["transactions"]):
        made = states.snapshot_states(sales, nothing["refunds"], nothing["payouts"])
        assert dicts(states.merged_snapshot(made)) == dicts(
            snapshot.executive_snapshot(sales, nothing["refunds"], nothing["payouts"])
        )
    bad = states.sales_states(table(spark, "transactions", [sale("A", transaction_id="T-1")]))
    with pytest.raises(PySparkException, match="not a whole number"):
        bad.collect()
    with pytest.raises(ValueError, match="grain"):
        states.sales_states(tx, "fortnight")


def test_the_sales_are_scanned_once(spark):
    plan = states.sales_states(shop(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
