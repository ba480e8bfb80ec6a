"""Results as JSON records, ready to hand to whoever writes the commentary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.operators.snapshot import beside


def _record(columns: list[str]) -> Column:
    return F.struct(*columns)


# The longest list that becomes one value.
LONGEST_LIST = 100


def json_list(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """A short result (a top-k, the three leaks) as one JSON array in ``order``; one row. More than 100 rows are an error."""
    first = rows.orderBy(*order).limit(LONGEST_LIST + 1)
    numbered = first.select(F.row_number().over(Window.orderBy(*order)).alias("_order"), _record(rows.columns).alias("item"))
    items = numbered.agg(F.array_sort(F.array_agg(F.struct("_order", "item"))).alias("items"))
    short = F.assert_true(F.size("items") <= LONGEST_LIST, F.lit("too many rows for one JSON value")).isNull()
    return items.where(short).select(F.transform("items", lambda i: i["item"]).alias(name))


def cash_payload(leaks: DataFrame, low_margins: DataFrame) -> DataFrame:
    """Leaks, largest first, and lowest margins (both of fixed length) in one JSON record."""
    parts = [
        json_list(leaks, "cash_eaters", F.desc("amount"), F.asc("category")).withColumn(
            "cash_eaters", F.to_json("cash_eaters")
        ),
        json_list(
            low_margins, "low_margin_products", F.asc("margin_pct"), F.asc("revenue"), F.asc("product_id")
        ).withColumn("low_margin_products", F.to_json("low_margin_products")),
    ]
    both = beside(*parts)
    return both.select(
        F.concat(
            F.lit('{"cash_eaters":'), F.coalesce("cash_eaters", F.lit("[]")),
            F.lit(',"low_margin_products":'), F.coalesce("low_margin_products", F.lit("[]")), F.lit("}"),
        ).alias("payload")
    )


def plan_payload(plan: DataFrame, summary: DataFrame) -> DataFrame:
    """A purchase plan as JSON lines: one record for the budget, then one per product bought.

    A plan may be as long as the catalogue, so it never becomes one value.
    """
    head = summary.select(F.lit("budget").alias("section"), F.to_json(_record(summary.columns)).alias("payload"))
    lines = plan.select(F.lit("purchase").alias("section"), F.to_json(_record(plan.columns)).alias("payload"))
    return head.unionByName(lines)


def snapshot_payload(snapshot: DataFrame) -> DataFrame:
    """The snapshot as one JSON record, days as ISO text."""
    columns = [F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in snapshot.dtypes]
    return snapshot.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload"))


def payload_values(payloads: DataFrame, kinds: dict[str, str], payload: str = "payload") -> DataFrame:
    """The named values of JSON records, by way of a VARIANT: compared by value, not by how a number is written."""
    record = F.parse_json(F.col(payload))
    return payloads.select(*[F.variant_get(record, f"$.{name}", kind).alias(name) for name, kind in kinds.items()])
