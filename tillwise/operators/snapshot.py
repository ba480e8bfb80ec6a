"""Executive snapshot, sales by payment type and the short business summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.numbers import as_double, day_money, is_payment, money, quantity, total
from tillwise.operators.lookup import lookup_join


def beside(*one_row: DataFrame) -> DataFrame:
    """One-row frames side by side: stack them and take the only value of each column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def transaction_totals(
    transactions: DataFrame, sums: dict[str, Column], bounds: dict[str, Column], products: DataFrame | None = None
) -> DataFrame:
    """Sums and extremes over all sales, one row.

    Without ``products`` each map task sends a single row. With it, a sale
    counts as often as the master lists its product, as in the processed
    transactions: sums are taken per product first and then multiplied.
    """
    if products is None:
        return transactions.agg(*[c.alias(n) for n, c in {**sums, **bounds}.items()])
    listed = products.where(F.col("product_id").isNotNull()).groupBy("product_id")
    copies = listed.agg(F.count("*").cast("decimal(9,0)").alias("_copies"))
    # Extremes are the same for any positive number of copies.
    per_product = transactions.groupBy("product_id").agg(*[c.alias(n) for n, c in {**sums, **bounds}.items()])
    counted = lookup_join(per_product, copies, "product_id").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    repeated = {n: F.sum(F.col(n).cast("decimal(28,6)") * F.col("_copies")) for n in sums}
    again = {n: (F.min(n) if n.startswith("first") else F.max(n)) for n in bounds}
    return counted.agg(*[c.alias(n) for n, c in {**repeated, **again}.items()])


def _distinct_transactions(transactions: DataFrame, approximate: bool) -> DataFrame:
    if approximate:
        return transactions.agg(F.approx_count_distinct("transaction_id").alias("transactions"))
    # Apart from the sums: this shuffle then carries the ids and nothing else.
    return transactions.select("transaction_id").distinct().agg(F.count("transaction_id").alias("transactions"))


def _paid(kind: str, amount: str) -> Column:
    return F.sum(F.when(is_payment(kind), money(amount)))


def executive_snapshot(
    transactions: DataFrame,
    refunds: DataFrame,
    payouts: DataFrame,
    products: DataFrame | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Period, counts, sales, discounts, tax, tips, card and cash takings, fees, refunds and payouts; one row."""
    sums = {
        "items_sold": F.sum(quantity()),
        "gross_sales": F.sum(money("gross_sales")),
        "discounts": F.sum(money("discount")),
        "tax": F.sum(money("tax")),
        "tips": F.sum(money("tip_amount")),
        "card_sales": _paid("card", "line_total"),
        "cash_sales": _paid("cash", "line_total"),
    }
    bounds = {"first_day": F.min("sale_day"), "last_day": F.max("sale_day")}
    row = beside(
        transaction_totals(transactions, sums, bounds, products),
        _distinct_transactions(transactions, approximate),
        payouts.agg(
            F.sum(day_money("processor_fees")).alias("processor_fees"),
            F.sum(day_money("net_payout_amount")).alias("net_payouts"),
        ),
        refunds.agg(F.sum(money("refund_amount")).alias("refunds")),
    )
    amounts = [
        "gross_sales", "discounts", "tax", "tips", "card_sales", "cash_sales",
        "processor_fees", "refunds", "net_payouts",
    ]
    return row.select(
        "first_day",
        "last_day",
        total("transactions").alias("transactions"),
        total("items_sold").cast("bigint").alias("items_sold"),
        *[as_double(total(a)).alias(a) for a in amounts],
    )


def executive_snapshot_net(
    transactions: DataFrame, refunds: DataFrame, payouts: DataFrame, approximate: bool = False
) -> DataFrame:
    """The eight-number snapshot; card and cash takings are net sales."""
    sums = {
        "items_sold": F.sum(quantity()),
        "gross_sales": F.sum(money("gross_sales")),
        "discounts": F.sum(money("discount")),
        "card_sales": _paid("card", "net_sales"),
        "cash_sales": _paid("cash", "net_sales"),
    }
    row = beside(
        transaction_totals(transactions, sums, {}),
        _distinct_transactions(transactions, approximate),
        payouts.agg(F.sum(day_money("processor_fees")).alias("processor_fees")),
        refunds.agg(F.sum(money("refund_amount")).alias("refunds")),
    )
    amounts = ["items_sold", "gross_sales", "discounts", "card_sales", "cash_sales", "processor_fees", "refunds"]
    return row.select(total("transactions").alias("transactions"), *[as_double(total(a)).alias(a) for a in amounts])


def sales_by_payment_type(transactions: DataFrame) -> DataFrame:
    """Card and cash takings by both definitions (line total and net sales), one row each."""
    row = transactions.agg(
        *[_paid(kind, amount).alias(f"{kind}_{amount}") for kind in ("card", "cash")
          for amount in ("line_total", "net_sales")]
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(kind.upper()).alias("payment_type"),
                as_double(total(f"{kind}_line_total")).alias("line_total"),
                as_double(total(f"{kind}_net_sales")).alias("net_sales"),
            )
            for kind in ("card", "cash")
        ]
    )
    return row.select(F.inline(lines))


def business_summary(transactions: DataFrame, refunds: DataFrame) -> DataFrame:
    """Sale lines, revenue and refunds; a column the table does not have counts as zero."""

    def summed(df: DataFrame, column: str) -> Column:
        return F.sum(money(column)) if column in df.columns else F.lit(0).cast("decimal(20,6)")

    row = beside(
        transactions.agg(F.count("*").alias("total_transactions"), summed(transactions, "line_total").alias("revenue")),
        refunds.agg(summed(refunds, "refund_amount").alias("refunded")),
    )
    return row.select(
        total("total_transactions").alias("total_transactions"),
        as_double(total("revenue")).alias("total_revenue"),
        as_double(total("refunded")).alias("total_refunds"),
    )
