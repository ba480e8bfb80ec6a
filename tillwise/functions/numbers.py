"""Column helpers for exact money arithmetic.

Sums run in DECIMAL so that their value does not depend on row order or on how
the data is partitioned; results turn into DOUBLE once, where they leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.schemas import DAY_MONEY, MONEY, QUANTITY, UNIT_COST, UNIT_PRICE

TOTAL = "decimal(38,12)"  # type of a summed quantity x price
LOW_BITS = 20


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    return _col(c).cast(MONEY)


def day_money(c: str | Column) -> Column:
    return _col(c).cast(DAY_MONEY)


def quantity(c: str | Column = "quantity") -> Column:
    return _col(c).cast(QUANTITY)


def unit_price(c: str | Column = "unit_price") -> Column:
    return _col(c).cast(UNIT_PRICE)


def unit_cost(c: str | Column = "cogs") -> Column:
    return _col(c).cast(UNIT_COST)


def total(c: str | Column) -> Column:
    """A sum over no rows is zero, not NULL."""
    return F.coalesce(_col(c), F.lit(0))


def as_double(c: str | Column) -> Column:
    return _col(c).cast("double")


def exact_sum(c: Column, dtype: T.DecimalType) -> Column:
    """``sum(c)`` of values with at most 18 digits, for use in a ``groupBy``.

    A grouped DECIMAL sum keeps its buffer as bytes and rebuilds a big number
    for every row. Sums of longs are several times cheaper: the value in its
    smallest unit is split into high and low bits, both are summed, and neither
    sum can overflow before 2^43 rows.
    """
    units = (c.cast(dtype) * F.lit(10**dtype.scale)).cast("bigint")
    high = F.sum(F.shiftright(units, LOW_BITS)).cast("decimal(19,0)")
    low = F.sum(units.bitwiseAND(F.lit(2**LOW_BITS - 1))).cast("decimal(19,0)")
    whole = high * F.lit(2**LOW_BITS).cast("decimal(7,0)") + low
    unit = F.lit(f"{10 ** -dtype.scale:.{dtype.scale}f}").cast(f"decimal({dtype.scale},{dtype.scale})")
    return (whole * unit).cast(f"decimal(36,{dtype.scale})")


def price_times_quantity() -> Column:
    return (quantity() * unit_price()).cast("decimal(36,12)")


def cost_times_quantity(cost: Column, qty: Column) -> Column:
    """Unit cost times a summed quantity, with no digit lost to DECIMAL(38)."""
    return (cost.cast(UNIT_COST) * qty.cast("decimal(17,4)")).cast("decimal(36,12)")


def less(a: Column, b: Column) -> Column:
    """``a - b`` on totals, kept inside DECIMAL(38,12)."""
    return (a.cast("decimal(36,12)") - b.cast("decimal(36,12)")).cast(TOTAL)


def guarded_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """numerator / denominator, and 0 where the denominator is not positive."""
    n, d = as_double(numerator), as_double(denominator)
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def is_filled(df: DataFrame, name: str) -> Column:
    """Neither NULL nor, if it is text, blank."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return column.isNotNull() & (F.trim(column) != "")
    return column.isNotNull()


def is_payment(kind: str) -> Column:
    """Payment types arrive as CARD, card, or with stray blanks."""
    return F.upper(F.trim(F.col("payment_type"))) == F.lit(kind.upper())


def rounded(c: str | Column, digits: int, half_even: bool = True) -> Column:
    """A number rounded once, as it is: halves to the even digit, or up. Only real halves count as halves."""
    return (F.bround(_col(c), digits) if half_even else F.round(_col(c), digits)).cast("double")
