"""Cost, margin, snapshot and leak results on edge cases."""

from __future__ import annotations

import datetime as dt

import pytest
from data import DAY, dicts, product, sale, table

from tillwise.operators import base, coverage, leaks, margins, snapshot, velocity
from tillwise.plans.dispatch import run_analysis
from tillwise.schemas import empty_tables


def test_missing_cost(spark):
    tx = table(spark, "transactions", [sale("A", 2, 10, 1), sale("X", 3, 10)])
    pm = table(spark, "products", [product("A", 4)])
    lines = {r["product_id"]: r for r in dicts(base.processed_transactions(tx, pm))}
    assert lines["A"]["gross_profit"] == 2 * (10 - 4) - 1 and lines["A"]["unit_margin"] == 6
    assert lines["X"]["gross_profit"] is None and lines["X"]["cogs"] is None
    net = {r["product_id"]: r for r in dicts(base.gross_profit_net(tx, pm))}
    assert net["X"]["gross_profit"] == net["X"]["net_sales"] == 30 and net["X"]["cogs"] == 0
    # An unlisted product stays in the margins, with profit 0, but cannot be ranked for reordering.
    by_margin = {r["product_id"]: r for r in dicts(margins.product_margins(tx, pm))}
    assert by_margin["X"]["gross_profit"] == 0 and by_margin["X"]["margin_pct"] == 0
    assert [r["product_id"] for r in dicts(velocity.sku_rates(tx, pm))] == ["A"]
    zero = {r["product_id"]: r for r in dicts(margins.product_margins(tx, pm, missing_cogs="zero"))}
    assert zero["X"]["gross_profit"] == 30


def test_given_cost_is_replaced(spark):
    tx = table(spark, "transactions", [sale("A", 2, 10, cogs=9, gross_profit=99)])
    pm = table(spark, "products", [product("A", 4)])
    assert dicts(base.processed_transactions(tx, pm))[0]["gross_profit"] == 12
    assert dicts(base.gross_profit_net(tx, pm))[0]["gross_profit"] == 12
    assert dicts(margins.product_margins(tx, definition="given"))[0]["gross_profit"] == 99


def test_duplicate_product(spark):
    tx = table(spark, "transactions", [sale("A", 2, 10)])
    pm = table(spark, "products", [product("A", 1), product("A", 2)])
    assert sorted(r["cogs"] for r in dicts(base.processed_transactions(tx, pm))) == [1, 2]
    last = dicts(base.gross_profit_net(tx, pm.coalesce(1)))
    assert [r["cogs"] for r in last] == [2]
    margin = dicts(margins.product_margins(tx, pm))
    assert margin[0]["revenue"] == 40 and margin[0]["gross_profit"] == 2 * 9 + 2 * 8
    rates = {float(r["cogs"]): r for r in dicts(velocity.sku_rates(tx, pm))}
    assert rates[1.0]["gross_profit"] == 18 and rates[2.0]["gross_profit"] == 16
    assert dicts(velocity.sku_quantities(tx, pm))[0]["qty"] == 4
    refunds, payouts = (empty_tables(spark)[t] for t in ("refunds", "payouts"))
    row = dicts(snapshot.executive_snapshot(tx, refunds, payouts, pm))[0]
    assert row["gross_sales"] == 40 and row["transactions"] == 1 and row["first_day"] == DAY
    assert dicts(leaks.cash_eaters(tx, refunds, payouts, pm))[0]["amount"] == 0


def test_equal_listings_count_twice(spark):
    tx = table(spark, "transactions", [sale("A", 2, 10, 1)])
    pm = table(spark, "products", [product("A", 4), product("A", 4)])
    joined = base.processed_transactions(tx, pm)
    assert joined.count() == 2
    margin = dicts(margins.product_margins(tx, pm))[0]
    assert margin["gross_profit"] == float(sum(r["gross_profit"] for r in dicts(joined)))


def test_nulls_in_a_line_skip_only_their_measure(spark):
    tx = table(
        spark,
        "transactions",
        [sale("A", 2, 10, 1), sale("A", 5, 0, 0, net=7, unit_price=None), {**sale("A", 1, 10), "discount": None}],
    )
    pm = table(spark, "products", [product("A", 4)])
    margin = dicts(margins.product_margins(tx, pm))[0]
    assert margin["gross_profit"] == 2 * 6 - 1 and margin["revenue"] == 19 + 7 + 10
    assert dicts(velocity.sku_rates(tx, pm))[0]["qty"] == 8


def test_zero_revenue(spark):
    tx = table(spark, "transactions", [sale("A", 1, 10), sale("Z", 1, 0)])
    pm = table(spark, "products", [product("A", 4), product("Z", 4)])
    kept = {r["product_id"]: r for r in dicts(margins.product_margins(tx, pm))}
    assert kept["Z"]["margin_pct"] == 0
    dropped = margins.product_margins(tx, pm, "net", by_name=False, positive_only=True)
    assert [r["product_id"] for r in dicts(dropped)] == ["A"]


def test_blank_keys(spark):
    tx = table(spark, "transactions", [sale("A"), sale(None), sale(""), sale("  ", product_name="x")])
    tables = empty_tables(spark) | {"transactions": tx, "products": table(spark, "products", [product("A")])}
    skus = margins.product_margins(tx, tables["products"])
    assert [r["product_id"] for r in dicts(skus)] == ["A"]
    row = dicts(snapshot.executive_snapshot(tx, tables["refunds"], tables["payouts"], tables["products"]))[0]
    assert row["gross_sales"] == 40 and row["items_sold"] == 4


def test_last_name_stands_for_the_product(spark):
    later = DAY + dt.timedelta(days=1)
    tx = table(
        spark, "transactions", [sale("A", product_name="old", day=DAY), sale("A", product_name="new", day=later)]
    )
    pm = table(spark, "products", [product("A", 4)])
    merged = dicts(margins.product_margins(tx, pm, "net", by_name=False))
    assert [(r["product_name"], r["revenue"]) for r in merged] == [("new", 20)]
    assert len(dicts(margins.product_margins(tx, pm))) == 2


def test_low_margin_ties(spark):
    tx = table(spark, "transactions", [sale(p, q, 10) for p, q in (("A", 3), ("B", 1), ("C", 2))])
    pm = table(spark, "products", [product(p, 9) for p in "ABC"])
    skus = margins.product_margins(tx, pm)
    assert [r["product_id"] for r in dicts(margins.low_margin_products(skus, 2))] == ["B", "C"]
    assert [r["product_id"] for r in dicts(margins.low_margin_products(skus, 2, tie_on_revenue=False))] == ["A", "B"]
    assert {r["margin_band"] for r in dicts(skus)} == {"low"}


def test_empty_tables(spark):
    tables = empty_tables(spark)
    row = dicts(run_analysis(tables, "none")["snapshot"])[0]
    assert row["transactions"] == 0 and row["gross_sales"] == 0 and row["first_day"] is None
    assert dicts(run_analysis(tables, "none", "web")["snapshot"])[0]["items_sold"] == 0
    results = run_analysis(tables, "cash_eaters", "web")
    assert {r["percentage"] for r in dicts(results["cash_eaters"])} == {0}
    assert dicts(results["low_margin_products"]) == []
    plan = run_analysis(tables, "reorder")
    assert dicts(plan["reorder_plan"]) == []
    assert dicts(plan["reorder_summary"])[0]["remaining"] == 500
    clearance = run_analysis(tables, "free_cash")
    assert dicts(clearance["free_up_cash"]) == [] and dicts(clearance["free_up_total"])[0]["total_extra_cash"] == 0
    summary = dicts(snapshot.business_summary(tables["transactions"], tables["refunds"]))[0]
    assert summary == {"total_transactions": 0, "total_revenue": 0, "total_refunds": 0}


def test_business_summary_without_columns(spark):
    tx = table(spark, "transactions", [sale("A"), sale("B")]).drop("line_total")
    row = dicts(snapshot.business_summary(tx, empty_tables(spark)["refunds"].drop("refund_amount")))[0]
    assert row == {"total_transactions": 2, "total_revenue": 0, "total_refunds": 0}


def test_payment_types_in_any_case(spark):
    tx = table(
        spark, "transactions", [sale(payment_type=p) for p in ("CARD", "card", " Card ", "cash", "VOUCHER", None)]
    )
    rows = {r["payment_type"]: r["net_sales"] for r in dicts(snapshot.sales_by_payment_type(tx))}
    assert rows == {"CARD": 30, "CASH": 10}


def test_days(spark):
    one = table(spark, "transactions", [sale(), sale()])
    assert dicts(coverage.date_coverage(one))[0]["n_days"] == 1
    gap = table(spark, "transactions", [sale(), sale(day=DAY + dt.timedelta(days=9))])
    assert dicts(coverage.date_coverage(gap))[0]["n_days"] == 10
    assert coverage.filter_period(gap, "sale_day", end=DAY).count() == 1
    assert coverage.filter_period(gap, "sale_day", DAY, DAY + dt.timedelta(days=9)).count() == 2


def test_transactions_are_counted_once(spark):
    tx = table(spark, "transactions", [sale(transaction_id=t) for t in ("a", "a", "b", None)])
    none = empty_tables(spark)
    for approximate in (False, True):
        row = dicts(snapshot.executive_snapshot(tx, none["refunds"], none["payouts"], approximate=approximate))[0]
        assert row["transactions"] == 2


def test_web_dialect_keeps_given_profit_without_a_master(spark):
    tables = empty_tables(spark)
    tables["transactions"] = table(spark, "transactions", [sale("A", 1, 10, cogs=3, gross_profit=7)])
    del tables["products"]
    low = dicts(run_analysis(tables, "cash_eaters", "web")["low_margin_products"])
    assert low[0]["gross_profit"] == 7
    plan = dicts(run_analysis(tables, "reorder", "web", budget=10)["reorder_plan"])
    assert plan[0]["suggested_qty"] == 3 and plan[0]["est_weekly_profit"] == 21


@pytest.mark.parametrize("bad", ["gross", ""])
def test_unknown_definition(spark, bad):
    with pytest.raises(ValueError, match="definition"):
        margins.product_margins(empty_tables(spark)["transactions"], definition=bad)
