"""Run a named analysis over the tables of a shop."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tillwise.operators import clearance, leaks, margins, reorder, snapshot, velocity

# The analysis names callers use.
ANALYSES = ("cash_eaters", "reorder", "free_cash")


def run_analysis(
    tables: Mapping[str, DataFrame],
    name: str,
    dialect: str = "pos",
    budget: float | None = None,
    load_order: str | None = None,
) -> dict[str, DataFrame]:
    """The snapshot, plus the results of one analysis; an unknown name gives the snapshot alone.

    ``pos`` works on list-price profit and repeats sales as the product master
    does; ``web`` on net profit with the product's last cost.
    """
    tx, refunds, payouts = tables["transactions"], tables["refunds"], tables["payouts"]
    products = tables.get("products")
    # Without a product master the web dialect keeps the profit its sales came with.
    web_profit = "given" if products is None else "net"
    if dialect == "web":
        results = {"snapshot": snapshot.executive_snapshot_net(tx, refunds, payouts)}
    else:
        results = {"snapshot": snapshot.executive_snapshot(tx, refunds, payouts, products)}
    if name == "cash_eaters":
        if dialect == "web":
            results["cash_eaters"] = leaks.cash_eaters(tx, refunds, payouts)
            skus = margins.product_margins(
                tx, products, web_profit, load_order=load_order, by_name=False, positive_only=True
            )
            results["low_margin_products"] = margins.low_margin_products(skus, tie_on_revenue=False)
        else:
            results["cash_eaters"] = leaks.cash_eaters(tx, refunds, payouts, products, with_share=False)
            results["low_margin_products"] = margins.low_margin_products(margins.product_margins(tx, products))
    elif name == "reorder":
        if dialect == "web":
            rates = velocity.sku_rates(tx, products, web_profit, load_order=load_order)
            bought = reorder.reorder_purchases(rates, budget, by_quantity=False)
            results["reorder_plan"] = reorder.web_plan(reorder.reorder_plan(bought, half_even=False))
        else:
            bought = reorder.reorder_purchases(velocity.sku_rates(tx, products), budget)
            results["reorder_plan"] = reorder.reorder_plan(bought)
        results["reorder_summary"] = reorder.reorder_summary(bought, budget)
    elif name == "free_cash":
        results["free_up_cash"] = clearance.free_up_cash(tx, products)
        results["free_up_total"] = clearance.free_up_total(results["free_up_cash"])
    return results
