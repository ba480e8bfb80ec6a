"""Products with the thinnest margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.numbers import as_double, guarded_ratio
from tillwise.operators.base import per_product_id, sku_profit

LOW_MARGIN = 0.2


def product_margins(
    transactions: DataFrame,
    products: DataFrame | None = None,
    definition: str = "list_price",
    missing_cogs: str | None = None,
    load_order: str | None = None,
    by_name: bool = True,
    positive_only: bool = False,
) -> DataFrame:
    """Revenue, gross profit, margin and margin band of every product.

    ``by_name`` keeps the names of one product id apart; otherwise they merge
    under the name sold last. A product without revenue has margin 0 and stays,
    unless ``positive_only``.
    """
    profit = sku_profit(transactions, products, definition, missing_cogs, load_order)
    if by_name:
        skus = profit.groupBy("product_id", "product_name").agg(
            F.sum("revenue").alias("revenue"), F.sum("gross_profit").alias("gross_profit")
        )
    else:
        skus = per_product_id(profit)
    if positive_only:
        skus = skus.where("revenue > 0")
    margin = guarded_ratio("gross_profit", "revenue")
    return skus.select(
        "product_id",
        "product_name",
        as_double("revenue").alias("revenue"),
        as_double("gross_profit").alias("gross_profit"),
        margin.alias("margin_pct"),
        F.when(margin < LOW_MARGIN, "low").otherwise("watch").alias("margin_band"),
    )


def low_margin_products(margins: DataFrame, limit: int = 5, tie_on_revenue: bool = True) -> DataFrame:
    """The ``limit`` products with the lowest margin (a top-k: each task keeps only ``limit`` rows)."""
    ties = ["revenue"] if tie_on_revenue else []
    return margins.orderBy("margin_pct", *ties, "product_id", "product_name").limit(limit)
