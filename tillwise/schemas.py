"""Canonical tables, the two input dialects, and their required columns.

``pos`` is the line-level export of a till (prices, tax, tips); ``web`` is the
leaner upload format that already carries cost and gross profit. Both are
renamed into one superset per table, with fixed types, so that every operator
sees the same columns whatever the file said.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Per line at most 18 digits: Parquet and Spark then keep the value in one long instead of a byte array.
MONEY = T.DecimalType(18, 6)
UNIT_PRICE = T.DecimalType(18, 8)
UNIT_COST = T.DecimalType(18, 4)
QUANTITY = T.DecimalType(14, 4)
# A payout adds up a day of sales.
DAY_MONEY = T.DecimalType(28, 6)

TABLES = ("transactions", "refunds", "payouts", "products")


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


CANONICAL: dict[str, T.StructType] = {
    "transactions": _table(
        transaction_id=T.StringType(),
        sale_day=T.DateType(),
        product_id=T.StringType(),
        product_name=T.StringType(),
        category=T.StringType(),
        quantity=QUANTITY,
        unit_price=UNIT_PRICE,
        gross_sales=MONEY,
        discount=MONEY,
        net_sales=MONEY,
        tax=MONEY,
        line_total=MONEY,
        payment_type=T.StringType(),
        tip_amount=MONEY,
        cogs=UNIT_COST,
        gross_profit=MONEY,
    ),
    "refunds": _table(
        refund_id=T.StringType(),
        original_transaction_id=T.StringType(),
        refund_date=T.DateType(),
        refund_amount=MONEY,
    ),
    "payouts": _table(
        covering_sales_date=T.DateType(),
        gross_card_volume=DAY_MONEY,
        processor_fees=DAY_MONEY,
        net_payout_amount=DAY_MONEY,
        payout_date=T.DateType(),
    ),
    "products": _table(
        product_id=T.StringType(),
        product_name=T.StringType(),
        category=T.StringType(),
        cogs=UNIT_COST,
    ),
}

# The columns each dialect demands per table.
REQUIRED_COLUMNS: dict[str, dict[str, list[str]]] = {
    "pos": {
        "transactions": [
            "date", "transaction_id", "product_id", "product_name", "category", "quantity", "unit_price",
            "gross_sales", "discount", "net_sales", "tax", "line_total", "payment_type", "tip_amount",
        ],
        "refunds": ["original_transaction_id", "refund_date", "refund_amount"],
        "payouts": ["covering_sales_date", "gross_card_volume", "processor_fees", "net_payout_amount", "payout_date"],
        "products": ["product_id", "product_name", "category", "cogs"],
    },
    "web": {
        "transactions": [
            "transaction_id", "day", "product_id", "product_name", "quantity", "gross_sales", "discount",
            "net_sales", "cogs", "gross_profit", "payment_type",
        ],
        "refunds": ["refund_id", "transaction_id", "refund_amount", "refund_date"],
        "payouts": ["payout_date", "processor_fees", "net_payout"],
        "products": ["product_id", "product_name", "cogs"],
    },
}

# Dialect column -> canonical column, where the two differ.
RENAMES: dict[str, dict[str, dict[str, str]]] = {
    "pos": {"transactions": {"date": "sale_day"}},
    "web": {
        "transactions": {"day": "sale_day"},
        "refunds": {"transaction_id": "original_transaction_id"},
        "payouts": {"net_payout": "net_payout_amount"},
    },
}


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in CANONICAL[table].fields]
    return spark.range(0).select(*nothing)


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The bundle of a shop that has connected but not sold anything yet."""
    return {table: empty_table(spark, table) for table in TABLES}
