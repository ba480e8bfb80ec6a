"""Results as lines to read: labels, thousands separators, two decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.numbers import rounded

# The lines of the snapshot in their order, and the column each shows.
SNAPSHOT_LINES = {
    "Transactions": "transactions",
    "Items sold": "items_sold",
    "Gross sales": "gross_sales",
    "Discounts": "discounts",
    "Tax collected": "tax",
    "Tips collected": "tips",
    "Card sales": "card_sales",
    "Cash sales": "cash_sales",
    "Processor fees": "processor_fees",
    "Refunds processed": "refunds",
    "Net card payouts": "net_payouts",
}
COUNTS = ("transactions", "items_sold")

# The wording of the one-line messages.
BUDGET, REMAINING = "Budget: ", " → Remaining: "
CLEARANCE = "Estimated extra cash this week from clearance: "
CURRENCY = "€"


def _plain(c: str | Column, digits: int) -> Column:
    """A number with fixed decimals and no separators."""
    return rounded(c, digits).cast(f"decimal(28,{digits})").cast("string")


def _money(c: str | Column, digits: int = 2) -> Column:
    return F.concat(F.lit(CURRENCY), _plain(c, digits))


def snapshot_lines(snapshot: DataFrame) -> DataFrame:
    """The one-row snapshot as ``line_no, label, value``; counts plain, amounts like €1,234.50."""
    period = F.concat_ws(" → ", F.col("first_day").cast("string"), F.col("last_day").cast("string"))
    values = [("Business Snapshot", period)]
    for label, c in SNAPSHOT_LINES.items():
        grouped = F.format_number(rounded(c, 2).cast("decimal(28,2)"), 2)
        values.append((label, F.col(c).cast("string") if c in COUNTS else F.concat(F.lit(CURRENCY), grouped)))
    lines = [
        F.struct(F.lit(n).alias("line_no"), F.lit(label).alias("label"), value.alias("value"))
        for n, (label, value) in enumerate(values)
    ]
    return snapshot.select(F.inline(F.array(*lines)))


def leak_lines(leaks: DataFrame) -> DataFrame:
    """Leaks with their amount and share as text."""
    share = F.concat(_plain("percentage", 1), F.lit("%"))
    return leaks.select("category", _money("amount").alias("amount"), share.alias("share"))


def reorder_message(summary: DataFrame) -> DataFrame:
    """``Budget: €500 → Remaining: €12.30``, one per row of the summary."""
    text = F.concat(F.lit(BUDGET), _money("budget", 0), F.lit(REMAINING), _money("remaining"))
    stores = [c for c in summary.columns if c not in ("budget", "spent", "remaining", "n_items")]
    return summary.select(*stores, text.alias("message"))


def clearance_message(total: DataFrame) -> DataFrame:
    return total.select(F.concat(F.lit(CLEARANCE), _money("total_extra_cash")).alias("message"))
