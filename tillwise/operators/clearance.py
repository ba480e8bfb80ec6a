"""Cash that discounting slow movers would free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.numbers import rounded, total
from tillwise.operators.median import median_price
from tillwise.operators.ordering import stored, stored_in_order, with_row_number
from tillwise.operators.velocity import sku_quantities

SLOW_FRACTION = 0.2
DISCOUNT_RATE = 0.20
ASSUMED_LIFT = 1.5


def slow_movers(quantities: DataFrame, fraction: float = SLOW_FRACTION) -> DataFrame:
    """The slowest ``fraction`` of all products, at least one.

    A share of a large catalogue is itself large, so it is cut by row number
    over a distributed sort, not by a LIMIT that would end in one task.
    """
    ordered = stored_in_order(
        quantities, F.asc("qty_per_day"), F.asc("product_id"), F.asc("product_name"), label="slow-movers"
    )
    n_products = ordered.agg(F.count("*").alias("n")).scalar()
    wanted = F.greatest(F.lit(1), F.floor(F.lit(float(fraction)) * n_products))
    return with_row_number(ordered).where(F.col("row_no") <= wanted).select(*quantities.columns)


def free_up_cash(
    transactions: DataFrame,
    products: DataFrame | None = None,
    fraction: float = SLOW_FRACTION,
    discount_rate: float = DISCOUNT_RATE,
    assumed_lift: float = ASSUMED_LIFT,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """Slow movers with the extra units, discounted price and extra cash of one week's clearance."""
    # Stored, since it is used twice and its true size decides how the prices are restricted to it.
    slow = stored(slow_movers(sku_quantities(transactions, products, coverage), fraction), "slow")
    priced = slow.join(median_price(transactions, only=slow), "product_id", "left")
    return (
        priced.withColumns({"discount_rate": F.lit(discount_rate), "assumed_lift": F.lit(assumed_lift)})
        .withColumns(
            {
                "extra_units": rounded(F.col("qty_per_day") * 7 * (F.col("assumed_lift") - 1), 0),
                "discounted_price": rounded(F.col("price") * (1 - F.col("discount_rate")), 2),
            }
        )
        .withColumn("extra_cash_inflow", rounded(F.col("extra_units") * F.col("discounted_price"), 2))
        .drop("n_days")
    )


def free_up_total(clearance: DataFrame) -> DataFrame:
    """Number of slow movers and the extra cash of all of them; one row."""
    return clearance.agg(
        F.count("*").alias("n_products"),
        # Amounts have two decimals, so the sum in DECIMAL does not depend on the order of rows.
        total(F.sum(F.col("extra_cash_inflow").cast("decimal(28,2)"))).cast("double").alias("total_extra_cash"),
    )
