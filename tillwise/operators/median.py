"""Exact median price per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.numbers import as_double, is_filled, unit_price
from tillwise.operators.lookup import lookup_join
from tillwise.operators.ordering import stored, stored_in_order, with_running_total


# The sketch may be wrong by one in so many ranks; the bracket is wider than that on both sides.
ACCURACY = 10_000
MARGIN = 2 / ACCURACY


def median_price(transactions: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``product_id, price``: the median unit price, the mean of the middle two for an even count.

    Exact, without sorting the sales. A mergeable quantile sketch per product
    brackets the median in a first pass. A second one counts, combined in each
    task, how many prices lie below the bracket and how often each price inside
    occurs: well under a thousandth of a product's sales is left to be ranked.
    Where a middle price lies outside its bracket, which the counts show, the
    product is ranked whole. ``only`` restricts the work to the products it lists.
    """
    prices = transactions.where(is_filled(transactions, "product_id") & F.col("unit_price").isNotNull()).select(
        "product_id", unit_price().alias("unit_price")
    )
    if only is not None:
        prices = prices.join(only.select("product_id").distinct(), "product_id", "left_semi")
    ends = F.percentile_approx("unit_price", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)
    brackets = stored(
        prices.groupBy("product_id").agg(ends.alias("ends"))
        .select("product_id", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")),
        "price-brackets",
    )
    bracketed = lookup_join(prices, brackets, "product_id", scan=prices)
    inside = F.col("unit_price").between(F.col("low"), F.col("high"))
    # Below the bracket, above it, or at one price inside: one row each.
    counted = stored(
        bracketed.groupBy(
            "product_id", F.when(inside, 1).when(F.col("unit_price") < F.col("low"), 0).otherwise(2).alias("side"),
            F.when(inside, F.col("unit_price")).alias("unit_price"),
        ).agg(F.count("*").alias("n")),
        "price-counts",
    )
    product = Window.partitionBy("product_id")
    upto = product.orderBy("side", "unit_price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumns({"upto": F.sum("n").over(upto), "whole": F.sum("n").over(product)})
    middle = placed.where(_holds_middle(F.col("upto") - F.col("n"), F.col("n"), F.col("whole")))
    found = stored(
        middle.groupBy("product_id").agg(
            F.min("unit_price").alias("low"), F.max("unit_price").alias("high"), F.bool_and(F.col("side") == 1).alias("sure")
        ),
        "middle-prices",
    )
    sure = found.where("sure")
    if not found.where("NOT sure").isEmpty():
        rest = prices.join(found.where("NOT sure").select("product_id"), "product_id", "left_semi")
        sure = sure.drop("sure").unionByName(ranked_middle(rest))
    return sure.select("product_id", ((as_double("low") + as_double("high")) / 2).alias("price"))


def _holds_middle(before: Column, n: Column, whole: Column) -> Column:
    """Whether places before+1 … before+n hold one of the two middle places of ``whole``."""
    middle = F.array(F.floor((whole + 1) / 2), F.floor(whole / 2) + 1)
    return F.exists(middle, lambda m: (m > before) & (m <= before + n))


def ranked_middle(prices: DataFrame) -> DataFrame:
    """``product_id``, ``low``, ``high``: the middle prices by a sort of all (product, price) pairs.

    The running count over the sorted pairs tells which price holds the middle
    places, so no task gathers one product's prices.
    """
    pairs = prices.groupBy("product_id", "unit_price").agg(F.count("*").alias("n"))
    ordered = stored_in_order(pairs, F.asc("product_id"), F.asc("unit_price"), label="prices")
    counted = with_running_total(ordered, ["product_id"], F.col("n"))
    return (
        counted.where(_holds_middle(F.col("before"), F.col("n"), F.col("whole")))
        .groupBy("product_id")
        .agg(F.min("unit_price").alias("low"), F.max("unit_price").alias("high"))
    )


def median_price_approx(transactions: DataFrame, accuracy: int = 10000) -> DataFrame:
    """A price near the median in one pass; takes one of the two middle prices instead of their mean."""
    return (
        transactions.where(is_filled(transactions, "product_id"))
        .groupBy("product_id")
        .agg(F.percentile_approx(as_double(unit_price()), 0.5, accuracy).alias("price"))
    )
