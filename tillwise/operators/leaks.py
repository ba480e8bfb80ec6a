"""Where cash leaks: discounts, refunds and processor fees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.numbers import as_double, day_money, guarded_ratio, money, total
from tillwise.operators.snapshot import beside, transaction_totals

# Result label -> name of the amount in the one-row form.
CATEGORIES = {"Discounts": "discounts", "Refunds": "refunds", "Processor fees": "processor_fees"}


def cash_eaters(
    transactions: DataFrame,
    refunds: DataFrame,
    payouts: DataFrame,
    products: DataFrame | None = None,
    with_share: bool = True,
) -> DataFrame:
    """The three leaks, largest first, with their share of the total in percent (0 when nothing leaks).

    Each table is read once and reduced to one row; the three result rows are
    spelled out from that row. ``products`` repeats sales as the master does.
    """
    row = beside(
        transaction_totals(transactions, {"discounts": F.sum(money("discount"))}, {}, products),
        refunds.agg(F.sum(money("refund_amount")).alias("refunds")),
        payouts.agg(F.sum(day_money("processor_fees")).alias("processor_fees")),
    ).select(*[total(c).cast("decimal(32,6)").alias(c) for c in CATEGORIES.values()])
    leaked = sum((F.col(c) for c in CATEGORIES.values()), F.lit(0).cast("decimal(32,6)"))
    lines = [
        F.struct(
            F.lit(label).alias("category"),
            as_double(c).alias("amount"),
            (guarded_ratio(c, leaked) * 100).alias("percentage"),
        )
        for label, c in CATEGORIES.items()
    ]
    leaks = row.select(F.inline(F.array(*lines))).orderBy(F.desc("amount"), "category")
    return leaks if with_share else leaks.drop("percentage")


def cash_eaters_wide(leaks: DataFrame) -> DataFrame:
    """The leak rows turned into one record."""
    wide = leaks.groupBy().pivot("category", list(CATEGORIES)).agg(F.sum("amount"))
    return wide.select(*[F.coalesce(F.col(f"`{label}`"), F.lit(0.0)).alias(c) for label, c in CATEGORIES.items()])
