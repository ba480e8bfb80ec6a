"""Snapshots from stored states: a period is a merge of its months (or days), not another read of the sales.

A state holds, for one month and one range of transaction numbers, the sums of
the snapshot and a bitmap of the transactions in it. States merge: sums add up,
bitmaps are united, so the number of distinct transactions of any set of months
is exact, also where a transaction has lines in two of them. One scan of the
sales makes the states; new sales add states of their own beside the old ones.

Ranges have 32,768 numbers (4 KB of bitmap each). Transactions are whole numbers, or
texts that are; any other id is an error, not a loss. Months suit tills whose
ids grow with time; the finer ``day`` makes many sparse bitmaps where they do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.numbers import as_double, day_money, is_payment, money, quantity, total
from tillwise.operators.snapshot import beside

GRAINS = ("day", "week", "month", "quarter", "year")
_SALES = {
    "items_sold": lambda: quantity(),
    "gross_sales": lambda: money("gross_sales"),
    "discounts": lambda: money("discount"),
    "tax": lambda: money("tax"),
    "tips": lambda: money("tip_amount"),
    "card_sales": lambda: F.when(is_payment("card"), money("line_total")),
    "cash_sales": lambda: F.when(is_payment("cash"), money("line_total")),
}
_SUM = "decimal(36,6)"


def _start(day: str, grain: str) -> Column:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    return F.date_trunc(grain, F.col(day)).cast("date").alias("start")


def _number(transactions: DataFrame) -> Column:
    if isinstance(transactions.schema["transaction_id"].dataType, T.StringType):
        number = F.col("transaction_id").try_cast("bigint")
        unknown = F.col("transaction_id").isNotNull() & number.isNull()
        return F.when(unknown, F.raise_error(F.concat(F.lit("not a whole number: "), "transaction_id")).cast("bigint")).otherwise(number)
    return F.col("transaction_id").cast("bigint")


def sales_states(transactions: DataFrame, grain: str = "month") -> DataFrame:
    """``start``, ``bucket``, ``first_day``, ``last_day``, the sums and ``seen`` (a bitmap): one scan, one shuffle of states.

    Sales without a day or an id have a state of their own: they count in sums, not as transactions.
    """
    id_ = _number(transactions)
    return (
        transactions.withColumns({"_start": _start("sale_day", grain), "_id": id_})
        .groupBy(F.col("_start").alias("start"), F.bitmap_bucket_number("_id").alias("bucket"))
        .agg(
            F.min("sale_day").alias("first_day"),
            F.max("sale_day").alias("last_day"),
            *[F.sum(value()).cast(_SUM).alias(name) for name, value in _SALES.items()],
            F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("seen"),
        )
    )


def day_sums(df: DataFrame, day: str, sums: dict[str, Column], grain: str = "month") -> DataFrame:
    """States of a table without transactions (refunds, payouts): ``start`` and sums."""
    return df.groupBy(_start(day, grain)).agg(*[F.sum(value).cast(_SUM).alias(name) for name, value in sums.items()])


def snapshot_states(
    transactions: DataFrame, refunds: DataFrame, payouts: DataFrame, grain: str = "month"
) -> dict[str, DataFrame]:
    """The states that a snapshot of any period is merged from; worth storing."""
    fees = {"processor_fees": day_money("processor_fees"), "net_payouts": day_money("net_payout_amount")}
    return {
        "sales": sales_states(transactions, grain),
        "refunds": day_sums(refunds, "refund_date", {"refunds": money("refund_amount")}, grain),
        "payouts": day_sums(payouts, "covering_sales_date", fees, grain),
    }


def merged_snapshot(states: dict[str, DataFrame], first: str | None = None, last: str | None = None) -> DataFrame:
    """The executive snapshot of the states that start from ``first`` to ``last``, both included; of all without."""

    def chosen(df: DataFrame) -> DataFrame:
        since = F.lit(True) if first is None else F.col("start") >= F.lit(first).cast("date")
        until = F.lit(True) if last is None else F.col("start") <= F.lit(last).cast("date")
        return df.where(since & until)

    names = list(_SALES)
    # One row a range of numbers, then one row.
    ranges = chosen(states["sales"]).groupBy("bucket").agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        *[F.sum(n).cast(_SUM).alias(n) for n in names], F.bitmap_count(F.bitmap_or_agg("seen")).alias("transactions"),
    )
    # The bitmap of the state without numbers is empty, so it counts none.
    sales = ranges.agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("transactions").alias("transactions"),
        *[F.sum(n).cast(_SUM).alias(n) for n in names],
    )
    row = beside(
        sales,
        chosen(states["refunds"]).agg(F.sum("refunds").cast(_SUM).alias("refunds")),
        chosen(states["payouts"]).agg(*[F.sum(n).cast(_SUM).alias(n) for n in ("processor_fees", "net_payouts")]),
    )
    amounts = ["gross_sales", "discounts", "tax", "tips", "card_sales", "cash_sales", "processor_fees", "refunds", "net_payouts"]
    return row.select(
        "first_day", "last_day",
        total("transactions").alias("transactions"),
        total("items_sold").cast("bigint").alias("items_sold"),
        *[as_double(total(a)).alias(a) for a in amounts],
    )
