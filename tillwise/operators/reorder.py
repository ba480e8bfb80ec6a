"""What to reorder within a budget.

Products are walked in rank order (best daily profit first); of each, as many
units are bought as five days need and the remaining money allows. The money
left is carried from product to product, so the walk looks sequential. It is
run like this, whatever the size of the catalogue:

* All heavy work (sales to per-product rates) is an ordinary aggregation.
* The ranked list is stored in blocks of at most ``BLOCK_ROWS`` products of one
  shop, each with its least cost, its greatest cost and what it costs whole.
* Rounds over all blocks at once settle the list. Let ``bit`` be the largest
  power of two not above the money left, and call a product *cheap* if its unit
  cost is at most ``bit``. While at least ``bit`` is left, a cheap product is
  bought in full (a purchase cut short by lack of money leaves less than its
  unit cost, thus less than ``bit``), and a dear one can be bought once at most,
  which also leaves less than ``bit``. So up to the block that leaves less than
  ``bit``, purchases are a running total of the cheap ones, and the money before
  each of these blocks is exact. Only a block that may end the round is walked,
  product by product, and only that one walk counts.
* Each round takes at least one binary digit off the money left: at most 63
  rounds, usually one or two, all shops together. A block whose least cost is
  more than what is left drops out for good.

Costs and money are whole ten-thousandths, so every comparison is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.numbers import rounded, total, unit_cost
from tillwise.operators.lookup import lookup_join
from tillwise.operators.ordering import PLACE_BITS, in_order, stored, with_running_total
from tillwise.operators.velocity import rank_order

DEFAULT_BUDGET = 500.0
DAYS_OF_STOCK = 5
BLOCK_ROWS = 1024
PARTS_PER_UNIT = 10_000

_DETAIL = ["product_id", "product_name", "cogs", "qty", "gross_profit"]
_MONEY = "decimal(38,0)"


def _in_parts(amount: Column) -> Column:
    return (amount.cast("decimal(22,4)") * PARTS_PER_UNIT).cast("bigint")


def reorder_purchases(
    rates: DataFrame,
    budget: float | None = None,
    by_quantity: bool = True,
    store_keys: Sequence[str] = (),
    budgets: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Which products to buy and how many of each, with their place ``pos`` in the rank order.

    ``rates`` comes from ``sku_rates``. With ``store_keys`` each store has its
    own plan, and its budget either the common one or that of ``budgets``
    (store keys and ``budget``); products without a store are not bought. Only
    a missing budget means the default; 0 buys nothing.
    """
    keys = list(store_keys) or ["_shop"]
    products = rates if store_keys else rates.withColumn("_shop", F.lit(0))
    money = _in_parts(F.lit(str(DEFAULT_BUDGET if budget is None else budget)))
    if budgets is None:
        offered = products.withColumn("remaining", money)
    else:
        offered = lookup_join(products, budgets.select(*keys, _in_parts(F.col("budget")).alias("remaining")), keys)
    needed = F.greatest(F.lit(1), F.ceil(F.col("qty_per_day") * DAYS_OF_STOCK)).cast("bigint")
    candidates = (
        offered.where(unit_cost() > 0)
        .dropna(subset=keys)
        .withColumns({"cost": _in_parts(unit_cost()), "needed": needed})
        .where("cost <= remaining")
        # One unit more than the whole budget buys is as unaffordable as any number.
        .withColumn("needed", F.expr("least(needed, remaining div cost + 1)"))
    )
    ordered = in_order(
        candidates.select(*keys, *_DETAIL, "qty_per_day", "gp_per_day", "cost", "needed", "remaining"),
        *[F.asc(k) for k in keys],
        *rank_order(by_quantity),
    )
    blocks = stored(_blocks(ordered, keys, block_rows), "reorder-blocks")
    live = blocks.drop("items")
    settled = []
    while not settled or not live.isEmpty():
        walked = stored(_round(live, keys), "reorder-round")
        # One row a shop whose round ended; the slim rows it comes from are written, so that their size is known.
        state = (
            walked.where("after < bit")
            .groupBy(*keys)
            .agg(F.min_by("after", "pos").alias("remaining"), F.min("pos").alias("cursor"))
        )
        reached = walked.join(state.drop("remaining"), keys, "left").where("cursor IS NULL OR pos <= cursor")
        settled.append(reached.where("after < before").select(*keys, "pos", "before", "bit", "after"))
        live = blocks.drop("items", "remaining").join(state, keys).where("pos > cursor AND least <= remaining")
    bought = _bought(blocks, reduce(DataFrame.unionByName, settled), keys)
    return bought if store_keys else bought.drop("_shop")


def _blocks(ordered: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Up to ``block_rows`` products of one shop, next to each other in one sort partition, in one row."""
    product = F.struct("place", "cost", "needed", F.struct(*_DETAIL).alias("item"))
    block = ordered.withColumn("block", F.floor(F.col("place") / block_rows)).groupBy(*keys, "part_no", "block")
    rows = block.agg(
        F.array_sort(F.collect_list(product)).alias("rows"),
        F.min("place").alias("place"),
        F.min("cost").alias("least"),
        F.max("cost").alias("greatest"),
        F.sum(_price(F.col("cost"), F.col("needed"))).cast(_MONEY).alias("whole"),
        F.max("remaining").alias("remaining"),
    )
    return rows.select(
        *keys,
        "part_no",
        "place",
        (F.shiftleft(F.col("part_no").cast("bigint"), PLACE_BITS) + F.col("place")).alias("pos"),
        "least",
        "greatest",
        "whole",
        "remaining",
        # The rounds read costs and needs only; names and sums are read once, at the end.
        F.transform("rows", lambda r: F.struct(r["cost"].alias("cost"), r["needed"].alias("needed"))).alias("steps"),
        F.col("rows.item").alias("items"),
    )


def _price(cost: Column, units: Column) -> Column:
    return (cost.cast("decimal(19,0)") * units.cast("decimal(18,0)")).cast(_MONEY)


def _round(live: DataFrame, keys: list[str]) -> DataFrame:
    """Per block the money ``before`` and ``after`` it; true up to the first block of a shop with ``after`` < ``bit``."""
    cheap = F.aggregate(
        "steps",
        F.lit(0).cast(_MONEY),
        lambda spent, s: F.when(
            s["cost"] <= F.col("bit"), (spent + _price(s["cost"], s["needed"])).cast(_MONEY)
        ).otherwise(spent),
    )
    sized = live.withColumn("bit", F.expr("shiftleft(1L, length(bin(remaining)) - 1)")).withColumn(
        "spend",
        F.when(F.col("greatest") <= F.col("bit"), F.col("whole")).when(F.col("least") > F.col("bit"), 0).otherwise(cheap),
    )
    totals = with_running_total(sized, keys, F.col("spend"))
    # Behind the end of the round there is nothing left; those blocks are for later rounds.
    before = F.greatest(F.col("remaining") - F.col("before"), F.lit(0)).cast("bigint")
    walked = F.expr("aggregate(steps, before, (left, s) -> left - least(s.needed, left div s.cost) * s.cost)")
    untouched = (F.col("before") - F.col("spend") >= F.col("bit")) & (
        (F.col("greatest") <= F.col("bit")) | (F.col("before") < F.col("least"))
    )
    after = F.when(untouched, (F.col("before") - F.col("spend")).cast("bigint")).otherwise(walked)
    return totals.withColumn("before", before).select(*keys, "pos", "bit", "before", after.alias("after"))


def _bought(blocks: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """Every block that sold something was settled by one round; its money before and after tell the units."""
    taken = blocks.select(*keys, "pos", "steps", "items").join(settled, [*keys, "pos"])
    in_full = F.expr("transform(steps, s -> IF(s.cost <= bit, s.needed, 0L))")
    walked = F.expr(
        "aggregate(steps, struct(before AS left, CAST(array() AS array<bigint>) AS units), (a, s) -> struct("
        "a.left - least(s.needed, a.left div s.cost) * s.cost AS left, "
        "concat(a.units, array(least(s.needed, a.left div s.cost))) AS units)).units"
    )
    units = F.when(F.col("after") >= F.col("bit"), in_full).otherwise(walked)
    rows = taken.withColumn("units", units).select(
        *keys, "pos", F.posexplode(F.arrays_zip("items", "units")).alias("at", "row")
    )
    return rows.where("row.units > 0").select(
        *keys,
        (F.col("pos") + F.col("at")).alias("pos"),
        *[F.col(f"row.items.{c}").alias(c) for c in _DETAIL],
        F.col("row.units").alias("suggested_qty"),
    )


def reorder_plan(purchases: DataFrame, half_even: bool = True, store_keys: Sequence[str] = ()) -> DataFrame:
    """The purchase plan, best earners first: unit cost, units, money spent and the profit they should bring."""
    profit = F.col("suggested_qty") * (F.col("gross_profit") / F.greatest(F.lit(1.0), F.col("qty")))
    return purchases.orderBy(*store_keys, "pos").select(
        *store_keys,
        "product_id",
        "product_name",
        rounded("cogs", 2, half_even).alias("unit_cogs"),
        "suggested_qty",
        rounded(_spend(), 2, half_even).alias("budget_spend"),
        rounded(profit, 2, half_even).alias("est_gp_uplift_week"),
    )


def _spend() -> Column:
    return (unit_cost() * F.col("suggested_qty").cast("decimal(16,0)")).cast("decimal(28,4)")


def web_plan(plan: DataFrame) -> DataFrame:
    """The plan under the column names of the web dialect."""
    return plan.select(
        "product_id", "product_name", "suggested_qty", "budget_spend",
        F.col("est_gp_uplift_week").alias("est_weekly_profit"),
    )


def reorder_summary(
    purchases: DataFrame,
    budget: float | None = None,
    store_keys: Sequence[str] = (),
    budgets: DataFrame | None = None,
) -> DataFrame:
    """Budget, money spent, money left and number of products bought; one row, or one per store.

    With ``budgets`` (store keys and ``budget``) every store listed there has
    its row and its own budget, also one that buys nothing; without it, with a
    common budget, only stores that buy are known.
    """
    spent = total(F.sum(_spend())).cast("decimal(30,4)")
    sums = purchases.groupBy(*store_keys).agg(F.count("*").alias("n_items"), spent.alias("spent"))
    if budgets is None:
        money = F.lit(str(DEFAULT_BUDGET if budget is None else budget)).cast("decimal(28,4)")
        given = sums.withColumn("budget", money)
    else:
        # One row a store on either side.
        money = F.col("budget").cast("decimal(28,4)").alias("budget")
        given = budgets.select(*store_keys, money).join(sums, list(store_keys), "left")
    return given.select(
        *store_keys,
        F.col("budget").cast("double").alias("budget"),
        total("spent").cast("double").alias("spent"),
        (F.col("budget") - total("spent")).cast("double").alias("remaining"),
        total("n_items").alias("n_items"),
    )
