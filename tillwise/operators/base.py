"""Transactions joined to product cost, per line and per product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.numbers import (
    cost_times_quantity,
    exact_sum,
    is_filled,
    less,
    money,
    price_times_quantity,
    quantity,
    total,
    unit_cost,
    unit_price,
)
from tillwise.operators.lookup import lookup_join
from tillwise.schemas import MONEY, QUANTITY
from tillwise.sources.order import LOAD_NO

DEFINITIONS = ("list_price", "net", "given")


def check_definition(definition: str) -> None:
    if definition not in DEFINITIONS:
        raise ValueError(f"definition must be one of {DEFINITIONS}, not {definition!r}")


def processed_transactions(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Each sale with its unit cost, unit margin and list-price gross profit.

    A product listed twice in the master yields the sale twice; a product that
    is not listed leaves cost, margin and profit NULL.
    """
    sales = transactions.drop("cogs", "gross_profit", "unit_margin")
    costs = products.select("product_id", unit_cost().alias("cogs"))
    priced = lookup_join(sales, costs, "product_id", scan=transactions)
    margin = unit_price() - unit_cost()
    return priced.withColumns(
        {
            "unit_margin": margin,
            "gross_profit": (quantity() * margin).cast("decimal(34,12)") - money("discount"),
        }
    )


def last_costs(products: DataFrame, load_order: str | None = None) -> DataFrame:
    """One cost per product: the row loaded last wins, by ``load_order``, by ``load_no`` if there is one, or by place."""
    if load_order is None and LOAD_NO in products.columns:
        load_order = LOAD_NO
    order = F.col(load_order) if load_order else F.monotonically_increasing_id()
    listed = products.select("product_id", unit_cost().alias("cogs"), order.alias("_order"))
    # The last loaded row wins even when its cost is empty, so the cost travels inside a struct.
    return listed.groupBy("product_id").agg(F.max(F.struct("_order", "cogs")).getField("cogs").alias("cogs"))


def gross_profit_net(transactions: DataFrame, products: DataFrame, load_order: str | None = None) -> DataFrame:
    """Each sale with cost and profit on net sales; unknown cost counts as zero, given values are replaced."""
    sales = transactions.drop("cogs", "gross_profit")
    costed = lookup_join(sales, last_costs(products, load_order), "product_id", scan=transactions)
    cost = F.coalesce("cogs", F.lit(0).cast("decimal(18,4)"))
    spent = (cost * total(quantity())).cast("decimal(34,8)")
    return costed.withColumns({"cogs": cost, "gross_profit": total(money("net_sales")) - spent})


def named_sales(sales: DataFrame) -> DataFrame:
    """Product results leave out sales that name no product; totals keep them."""
    return sales.where(is_filled(sales, "product_id") & is_filled(sales, "product_name"))


def sku_sales(
    transactions: DataFrame, definition: str = "list_price", extra_keys: Sequence[str] = ()
) -> DataFrame:
    """What the product analyses need, added up per (product id, product name).

    The facts are combined here, before any join: each map task sends one row
    per product, so neither a hot product nor the join to the master moves fact
    rows. Profit is linear in the cost, hence exact on these sums.
    """
    check_definition(definition)
    keys = [*extra_keys, "product_id", "product_name"]
    measures: dict[str, Column] = {
        "qty": exact_sum(F.col("quantity"), QUANTITY),
        "revenue": exact_sum(F.col("net_sales"), MONEY),
    }
    if "sale_day" in transactions.columns:
        measures["last_day"] = F.max("sale_day")
        if LOAD_NO in transactions.columns:
            measures["last_load"] = F.max(F.struct("sale_day", LOAD_NO))[LOAD_NO]
    if definition == "given":
        keys.append("cogs")
        transactions = transactions.withColumn("cogs", unit_cost())
        measures["given_profit"] = F.sum(F.col("gross_profit").cast("decimal(28,10)"))
    elif definition == "list_price":
        # A line with an empty price, quantity or discount has no list-price profit and is left out of it.
        usable = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("discount").isNotNull()
        measures["list_net"] = F.sum(F.when(usable, price_times_quantity() - money("discount")))
        measures["skipped_qty"] = F.sum(F.when(~usable, quantity()))
    return named_sales(transactions).groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])


def sku_profit(
    transactions: DataFrame,
    products: DataFrame | None = None,
    definition: str = "list_price",
    missing_cogs: str | None = None,
    load_order: str | None = None,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Quantity, revenue and gross profit per product id, name and cost.

    ``list_price``: quantity x (unit price - cost) - discount, one row per cost
    the master lists. ``net``: net sales - cost x quantity, last listed cost.
    ``given``: the profit and cost that the transactions already carry.
    ``missing_cogs`` says what an unlisted product costs: "null" (no profit, so
    it adds nothing) or "zero"; each definition has its own default.
    """
    sales = sku_sales(transactions, definition, extra_keys)
    if definition == "given":
        joined, copies, cost = sales, F.lit(1), F.col("cogs")
        profit = F.col("given_profit")
    elif definition == "net":
        joined, copies = lookup_join(sales, last_costs(products, load_order), "product_id"), F.lit(1)
        cost = _known_cost(missing_cogs or "zero")
        profit = less(total("revenue"), cost_times_quantity(cost, total("qty")))
    else:
        # A product listed n times multiplies its sales by n; equal costs collapse to one row first.
        costs = products.groupBy("product_id", unit_cost().alias("cogs")).agg(F.count("*").alias("_copies"))
        joined, copies = lookup_join(sales, costs, "product_id"), F.coalesce("_copies", F.lit(1))
        cost = _known_cost(missing_cogs or "null")
        used_qty = total("qty") - total("skipped_qty")
        profit = less(F.col("list_net"), cost_times_quantity(cost, used_qty))
    copies = copies.cast("decimal(9,0)")
    return joined.select(
        *extra_keys,
        "product_id",
        "product_name",
        cost.alias("cogs"),
        (total("qty").cast("decimal(26,4)") * copies).alias("qty"),
        (total("revenue").cast("decimal(28,6)") * copies).alias("revenue"),
        (total(profit).cast("decimal(28,10)") * copies).alias("gross_profit"),
        *[c for c in ("last_day", "last_load") if c in joined.columns],
    )


def _known_cost(missing_cogs: str) -> Column:
    if missing_cogs not in ("null", "zero"):
        raise ValueError(f"missing_cogs must be 'null' or 'zero', not {missing_cogs!r}")
    return F.coalesce("cogs", F.lit(0).cast("decimal(18,4)")) if missing_cogs == "zero" else F.col("cogs")


def per_product_id(profit: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Merge the names (and costs) of one product id; the name and cost sold last stand for it.

    "Last" is the latest day of sale, on that day the row loaded last where the
    sales carry ``load_no``; without it the greatest name, then the greatest
    cost, so that the result is repeatable.
    Works on product-level sums, so the struct maximum never sees the facts.
    """
    order = [c for c in ("last_day", "last_load") if c in profit.columns]
    latest = F.max(F.struct(*order, "product_name", "cogs"))
    return (
        profit.groupBy(*extra_keys, "product_id")
        .agg(
            latest.alias("_latest"),
            F.sum("qty").cast("decimal(36,4)").alias("qty"),
            F.sum("revenue").cast("decimal(38,6)").alias("revenue"),
            F.sum("gross_profit").cast("decimal(38,10)").alias("gross_profit"),
        )
        .select(
            *extra_keys,
            "product_id",
            F.col("_latest.product_name").alias("product_name"),
            F.col("_latest.cogs").alias("cogs"),
            "qty",
            "revenue",
            "gross_profit",
        )
    )
