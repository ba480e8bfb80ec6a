"""The budgeted purchase plan against the sequential walk it stands for."""

from __future__ import annotations

import math
import random
from decimal import Decimal

from data import dicts, frame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.operators import reorder

RATES = T.StructType(
    [
        T.StructField("store", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("cogs", T.DecimalType(18, 4)),
        T.StructField("qty", T.DoubleType()),
        T.StructField("gross_profit", T.DoubleType()),
        T.StructField("n_days", T.LongType()),
        T.StructField("qty_per_day", T.DoubleType()),
        T.StructField("gp_per_day", T.DoubleType()),
    ]
)


def rates(spark, shops):
    """``{store: [(cogs, target), …]}`` in rank order."""
    rows = []
    for store, items in shops.items():
        for place, (cogs, target) in enumerate(items):
            per_day = target / 5
            gp = float(len(items) - place)
            rows.append((store, f"p{place:05d}", f"n{place}", Decimal(str(cogs)), per_day, gp, 1, per_day, gp))
    return frame(spark, rows, RATES)


def walk(items, budget):
    """The definition: one product after the other."""
    left, bought = Decimal(str(budget)), {}
    for place, (cogs, target) in enumerate(items):
        cogs = Decimal(str(cogs))
        if cogs <= 0:
            continue
        units = max(0, min(max(1, math.ceil(target / 5 * 5)), int(left // cogs)))
        if units:
            bought[f"p{place:05d}"] = units
            left -= units * cogs
    return bought


def plan_of(purchases):
    found = {}
    for r in dicts(purchases):
        assert r["product_id"] not in found.setdefault(r["store"], {})
        found[r["store"]][r["product_id"]] = r["suggested_qty"]
    return found


FIXED = {
    "small": ([("0.30", 2), ("0.25", 5), ("0.07", 3)], {"p00000": 2, "p00001": 1, "p00002": 2}),
    "skip": ([("0.60", 1), ("0.50", 1), ("0.40", 1)], {"p00000": 1, "p00002": 1}),
}


def test_fixed_plans_in_one_block_and_in_many(spark):
    shops = {name: items for name, (items, _) in FIXED.items()}
    for block_rows in (1000, 1):
        found = plan_of(
            reorder.reorder_purchases(rates(spark, shops), 1.0, store_keys=["store"], block_rows=block_rows)
        )
        assert found == {name: expected for name, (_, expected) in FIXED.items()}


def test_nonpositive_costs_are_skipped(spark):
    one = rates(spark, {"s": [(0, 1), (-1, 1), ("0.10", 2)]}).drop("store")
    bought = reorder.reorder_purchases(one, 0.15)
    assert [(r["product_id"], r["suggested_qty"]) for r in dicts(bought)] == [("p00002", 1)]
    summary = dicts(reorder.reorder_summary(bought, 0.15))[0]
    assert summary == {"budget": 0.15, "spent": 0.1, "remaining": 0.05, "n_items": 1}


def _random_shops(seed, n_shops, longest):
    rng = random.Random(seed)
    shops = {}
    for shop in range(n_shops):
        kind = shop % 4
        items = []
        for place in range(rng.randint(1, longest)):
            if kind == 0:
                cogs = rng.randint(1, 400)
            elif kind == 1:  # cheap and just too dear by turns
                cogs = 1 if place % 2 else rng.choice([4000, 4999, 5000, 2500, 1250, 900])
            elif kind == 2:  # powers of two and their neighbours
                cogs = max(1, 2 ** rng.randint(0, 13) + rng.choice([-1, 0, 1]))
            else:
                cogs = rng.choice([0, rng.randint(1, 20), rng.randint(1000, 9000)])
            items.append((Decimal(cogs) / 100, rng.randint(1, 12)))
        shops[f"s{shop}"] = items
    return shops


def test_random_shops_in_rounds_equal_the_walk(spark):
    shops = _random_shops(7, 80, 60)
    for budget in (0.37, 50):
        expected = {s: b for s, items in shops.items() if (b := walk(items, budget))}
        # Blocks of three products: a shop has many, and several rounds.
        spread = rates(spark, shops).repartition(7)
        found = plan_of(reorder.reorder_purchases(spread, budget, store_keys=["store"], block_rows=3))
        assert found == expected


def test_budget_per_store_and_order_of_the_plan(spark):
    shops = _random_shops(3, 4, 30)
    budgets = spark.createDataFrame([(s, 10.0 * (i + 1)) for i, s in enumerate(shops)], "store string, budget double")
    bought = reorder.reorder_purchases(rates(spark, shops), store_keys=["store"], budgets=budgets)
    expected = {s: b for i, (s, items) in enumerate(shops.items()) if (b := walk(items, 10 * (i + 1)))}
    assert plan_of(bought) == expected
    plan = [(r["store"], r["product_id"]) for r in dicts(reorder.reorder_plan(bought, store_keys=["store"]))]
    assert plan == sorted(plan)
    for row in dicts(reorder.reorder_plan(bought, store_keys=["store"])):
        assert row["budget_spend"] <= 40


def test_one_large_catalogue(spark):
    shops = _random_shops(11, 3, 900)
    items = shops["s2"] + shops["s1"] + shops["s0"]
    whole = rates(spark, {"s": items}).drop("store")
    expected = walk(items, 1500)
    bought = reorder.reorder_purchases(whole.repartition(5), 1500, block_rows=20)
    assert {r["product_id"]: r["suggested_qty"] for r in dicts(bought)} == expected


def test_blocks_that_mix_cheap_and_dear_products_in_one_round(spark):
    """Dear products just beyond the money left, in blocks that do not end the round, and needs beyond any budget."""
    items = [("0.01", 1), ("5.00", 1)] * 40 + [("4.90", 10**9), ("0.03", 10**9)]
    shops = {"even": items, "odd": items[1:], "poor": [("9.99", 1)], "short": items[:3]}
    for block_rows in (2, 7, 1024):
        bought = reorder.reorder_purchases(rates(spark, shops), 5, store_keys=["store"], block_rows=block_rows)
        assert plan_of(bought) == {s: b for s, i in shops.items() if (b := walk(i, 5))}


def test_no_products_and_products_without_a_store(spark):
    none = rates(spark, {"s": [("0.50", 1)]}).withColumn("store", F.lit(None).cast("string"))
    assert dicts(reorder.reorder_purchases(none, 5, store_keys=["store"])) == []
    assert dicts(reorder.reorder_purchases(none.limit(0).drop("store"), 5)) == []


def test_zero_budget_buys_nothing_and_default_is_500(spark):
    one = rates(spark, {"s": [(400, 5)]}).drop("store")
    assert dicts(reorder.reorder_purchases(one, 0)) == []
    assert [r["suggested_qty"] for r in dicts(reorder.reorder_purchases(one))] == [1]


def test_rounding(spark):
    one = rates(spark, {"s": [("0.125", 1)]}).drop("store").withColumn("gross_profit", F.lit(0.125))
    one = one.withColumn("qty", F.lit(1.0))
    bought = reorder.reorder_purchases(one, 1)
    even, up = dicts(reorder.reorder_plan(bought))[0], dicts(reorder.reorder_plan(bought, half_even=False))[0]
    assert (even["unit_cogs"], even["budget_spend"], even["est_gp_uplift_week"]) == (0.12, 0.12, 0.12)
    assert (up["unit_cogs"], up["budget_spend"], up["est_gp_uplift_week"]) == (0.13, 0.13, 0.13)


def test_summary_per_store_with_own_budgets(spark):
    """A store that buys nothing keeps its row and its budget."""
    products = rates(spark, {"a": [(10, 3), (5, 2)], "b": [(50, 1)], "c": [(1, 4)]})
    budgets = spark.createDataFrame([("a", 100.0), ("b", 20.0), ("c", 2.5)], "store string, budget double")
    bought = reorder.reorder_purchases(products, store_keys=["store"], budgets=budgets)
    rows = {r["store"]: r for r in dicts(reorder.reorder_summary(bought, store_keys=["store"], budgets=budgets))}
    assert rows["a"] == {"store": "a", "budget": 100.0, "spent": 40.0, "remaining": 60.0, "n_items": 2}
    assert rows["b"] == {"store": "b", "budget": 20.0, "spent": 0.0, "remaining": 20.0, "n_items": 0}
    assert rows["c"] == {"store": "c", "budget": 2.5, "spent": 2.0, "remaining": 0.5, "n_items": 1}
