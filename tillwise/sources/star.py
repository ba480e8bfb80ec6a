"""Canonical tables out of a star schema (lineitem, orders, part, supplier, nation).

Keys of orders, part, supplier and nation are unique, so each lookup adds
columns and never changes the number of sales; a lookup is made only if one of
its columns is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.numbers import exact_sum
from tillwise.operators.lookup import lookup_join
from tillwise.schemas import CANONICAL, MONEY

# What a till exports; cost and profit come from elsewhere.
TRANSACTION_COLUMNS = tuple(c for c in CANONICAL["transactions"].names if c not in ("cogs", "gross_profit"))
# Sales measures that need no lookup, and the product name.
SNAPSHOT_COLUMNS = tuple(c for c in TRANSACTION_COLUMNS if c not in ("product_name", "category", "unit_price"))
SKU_COLUMNS = ("product_id", "product_name", "quantity", "unit_price", "discount", "net_sales")

_FROM_ORDERS = {"sale_day", "payment_type", "tip_amount"}
_FROM_PART = {"product_name", "category"}


# Declared, so that opening a table starts no job to find out.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_type string, p_retailprice double",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "documents": "doc_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, text string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder.rstrip('/')}/{table}.parquet")


# Prices are DOUBLE with two decimals. They become whole cents, discounts and tax whole percents, and money the exact
# product of these; a cast of each DOUBLE to DECIMAL would go through its text form and cost ten times as much.
def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def _percent(rate: str) -> Column:
    return F.round(F.col(rate) * 100).cast("bigint")


def _scaled(whole: Column, digits: int) -> Column:
    """``whole`` / 10^digits as a DECIMAL with that many decimals."""
    unit = F.lit(f"{10 ** -digits:.{digits}f}").cast(f"decimal({digits},{digits})")
    return (whole.cast("decimal(18,0)") * unit).cast(f"decimal(18,{digits})")


def _net() -> Column:
    """Net sales in hundredths of a cent."""
    return _cents() * (100 - _percent("l_discount"))


# Canonical column -> its expression over the line items; called only for the columns asked for.
MEASURES = {
    "transaction_id": lambda: F.col("l_orderkey"),
    "product_id": lambda: F.col("l_partkey"),
    "quantity": lambda: F.col("l_quantity").cast("bigint").cast("decimal(14,4)"),
    "unit_price": lambda: _scaled(F.round(F.col("l_extendedprice") / F.col("l_quantity") * 10**8).cast("bigint"), 8),
    "gross_sales": lambda: _scaled(_cents(), 2),
    "discount": lambda: _scaled(_cents() * _percent("l_discount"), 4),
    "net_sales": lambda: _scaled(_net(), 4),
    "tax": lambda: _scaled(_net() * _percent("l_tax"), 6),
    "line_total": lambda: _scaled(_net() * (100 + _percent("l_tax")), 6),
    "tip_amount": lambda: _scaled(F.when(F.col("payment_type") == "CARD", _net() * 5).otherwise(0), 6),
}


def transactions(
    spark: SparkSession, folder: str, columns: Sequence[str] = TRANSACTION_COLUMNS, with_store: bool = False
) -> DataFrame:
    """Line items as sales; ``with_store`` adds the supplier's nation as ``store``."""
    wanted = set(columns)
    lines = read(spark, folder, "lineitem")
    sales = lines.withColumn("_seed", F.monotonically_increasing_id())
    if wanted & _FROM_ORDERS:
        priority = F.substr("o_orderpriority", F.lit(1), F.lit(1))
        orders = read(spark, folder, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_orderdate").cast("date").alias("sale_day"),
            F.when(priority.isin("1", "2", "3"), "CARD").when(priority == "4", "CASH").otherwise("VOUCHER")
            .alias("payment_type"),
        )
        sales = lookup_join(sales, orders, "l_orderkey", scan=lines, seed="_seed")
    if wanted & _FROM_PART:
        part = read(spark, folder, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
        )
        sales = lookup_join(sales, part, "l_partkey", scan=lines, seed="_seed")
    if with_store:
        nations = read(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        suppliers = read(spark, folder, "supplier")
        suppliers = lookup_join(suppliers, nations, "s_nationkey", scan=suppliers)
        stores = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("store"))
        sales = lookup_join(sales, stores, "l_suppkey", scan=lines, seed="_seed")
    stores = [F.col("store")] if with_store else []
    return sales.select(*[MEASURES[c]().alias(c) if c in MEASURES else F.col(c) for c in columns], *stores)


def _part_of(amount: str, rate: str) -> Column:
    return (F.col(amount) * F.lit(rate).cast("decimal(4,3)")).cast("decimal(30,6)")


def refunds(spark: SparkSession, folder: str) -> DataFrame:
    """Returned line items, refunded at their net price."""
    returned = read(spark, folder, "lineitem").where("l_returnflag = 'R'")
    return returned.select(
        F.col("l_orderkey").alias("original_transaction_id"),
        F.col("l_shipdate").cast("date").alias("refund_date"),
        _scaled(_net(), 4).alias("refund_amount"),
    )


def payouts(spark: SparkSession, folder: str) -> DataFrame:
    """One card payout per day of sale: 2.5 % fee, paid two days later."""
    card = transactions(spark, folder, ["sale_day", "payment_type", "line_total"]).where("payment_type = 'CARD'")
    volume = exact_sum(F.col("line_total"), MONEY).cast("decimal(28,6)")
    volume = card.groupBy("sale_day").agg(volume.alias("gross_card_volume"))
    return volume.select(
        F.col("sale_day").alias("covering_sales_date"),
        "gross_card_volume",
        _part_of("gross_card_volume", "0.025").alias("processor_fees"),
        _part_of("gross_card_volume", "0.975").alias("net_payout_amount"),
        F.date_add("sale_day", 2).alias("payout_date"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    """The product master."""
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("cogs"),
    )


def products_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The whole master, the costs of some products not filled in."""
    known = F.when(F.col("product_id") % 97 != 0, F.col("cogs"))
    return products(spark, folder).withColumn("cogs", known)


def products_loaded_twice(spark: SparkSession, folder: str) -> DataFrame:
    """The master and a second load of every tenth product, two units dearer; ``load_no`` orders them."""
    first = products(spark, folder).withColumn("load_no", F.lit(1))
    dearer = {"cogs": (F.col("cogs") + 2).cast("decimal(18,2)"), "load_no": F.lit(2)}
    return first.unionByName(first.where("product_id % 10 = 0").withColumns(dearer))


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "transactions": transactions(spark, folder),
        "refunds": refunds(spark, folder),
        "payouts": payouts(spark, folder),
        "products": products(spark, folder),
    }


def marked_up_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as insight texts: each sentence a line, by turns a heading, bullets, text, and text after a blank line."""

    def line(sentence: Column, i: Column) -> Column:
        number = F.floor(i / 6) + 1
        turn = i % 6
        return (
            F.when(turn == 0, F.concat(number, F.lit(". **Point "), i, F.lit("** "), sentence))
            .when(turn == 1, F.concat(F.lit("- "), sentence))
            .when(turn == 2, F.concat(F.lit("- **Key**: "), sentence))
            .when(turn == 3, sentence)
            .when(turn == 4, F.concat(F.lit("Note: "), sentence))
            .otherwise(F.concat(F.lit("\n"), sentence))
        )

    sentences = F.split("text", r"\. ")
    return read(spark, folder, "documents").select(
        "doc_id", F.array_join(F.transform(sentences, line), "\n").alias("text")
    )
