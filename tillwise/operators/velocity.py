"""How fast each product sells and earns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.numbers import as_double, exact_sum
from tillwise.operators.base import named_sales, per_product_id, sku_profit
from tillwise.operators.coverage import days_of
from tillwise.operators.lookup import lookup_join
from tillwise.schemas import QUANTITY


def sku_rates(
    transactions: DataFrame,
    products: DataFrame | None = None,
    definition: str = "list_price",
    load_order: str | None = None,
    coverage: DataFrame | None = None,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Quantity and profit per product, and per day of the covered period.

    ``list_price`` keeps (id, name, cost) apart and leaves out products of
    unknown cost; the other definitions have one row per product id.
    ``coverage`` may be given when the period is already known.
    """
    profit = sku_profit(transactions, products, definition, load_order=load_order, extra_keys=extra_keys)
    if definition == "list_price":
        skus = (
            profit.where(F.col("cogs").isNotNull())
            .groupBy(*extra_keys, "product_id", "product_name", "cogs")
            .agg(F.sum("qty").alias("qty"), F.sum("gross_profit").alias("gross_profit"))
        )
    else:
        skus = per_product_id(profit, extra_keys)
    return (
        skus.withColumn("n_days", days_of(transactions, coverage))
        .select(
            *extra_keys, "product_id", "product_name", "cogs",
            as_double("qty").alias("qty"), as_double("gross_profit").alias("gross_profit"), "n_days",
        )
        .withColumns(
            {"qty_per_day": F.col("qty") / F.col("n_days"), "gp_per_day": F.col("gross_profit") / F.col("n_days")}
        )
    )


def rank_order(by_quantity: bool = True) -> list[Column]:
    """Best earners first; the product id settles ties."""
    ties = [F.desc("qty_per_day")] if by_quantity else []
    return [F.desc("gp_per_day"), *ties, F.asc("product_id"), F.asc("product_name"), F.asc("cogs")]


def sku_velocity(rates: DataFrame, by_quantity: bool = True) -> DataFrame:
    return rates.orderBy(*rank_order(by_quantity))


def sku_quantities(
    transactions: DataFrame, products: DataFrame | None = None, coverage: DataFrame | None = None
) -> DataFrame:
    """Units sold per (product id, name), with or without known cost."""
    units = exact_sum(F.col("quantity"), QUANTITY)
    sold = named_sales(transactions).groupBy("product_id", "product_name").agg(units.alias("qty"))
    if products is not None:
        copies = products.groupBy("product_id").agg(F.count("*").cast("decimal(9,0)").alias("_copies"))
        sold = lookup_join(sold, copies, "product_id").withColumn(
            "qty", F.col("qty").cast("decimal(28,4)") * F.coalesce("_copies", F.lit(1))
        )
    units = F.coalesce(as_double("qty"), F.lit(0.0)).alias("qty")
    return (
        sold.select("product_id", "product_name", units)
        .withColumn("n_days", days_of(transactions, coverage))
        .withColumn("qty_per_day", F.col("qty") / F.col("n_days"))
    )
