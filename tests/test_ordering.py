"""Ranks, running totals, medians, slow movers and skewed lookups."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from data import DAY, dicts, product, sale, table
from pyspark.sql import functions as F

from tillwise.operators import clearance, lookup, median, ordering, velocity


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(5)
    return [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", rng.randint(0, 50), i) for i in range(3000)]


def split_in_order(spark, rows, *order):
    """Stored in several sort partitions, which adaptive execution would merge for so few rows."""
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return ordering.stored_in_order(df, *order)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_row_numbers(spark, skewed):
    ordered = split_in_order(spark, skewed, F.desc("v"), F.asc("i"))
    assert ordered.select("part_no").distinct().count() > 1
    found = {r["i"]: r["row_no"] for r in dicts(ordering.with_row_number(ordered))}
    expected = {i: n for n, (_, _, i) in enumerate(sorted(skewed, key=lambda r: (-r[1], r[2])), 1)}
    assert found == expected


def test_running_totals_of_a_key_across_partitions(spark, skewed):
    ordered = split_in_order(spark, skewed, F.asc("k"), F.asc("i"))
    assert ordered.where("k = 'hot'").select("part_no").distinct().count() > 1
    totals = {}
    for k, v, _ in skewed:
        totals[k] = totals.get(k, 0) + v
    seen = dict.fromkeys(totals, 0)
    expected = {}
    for k, v, i in sorted(skewed, key=lambda r: (r[0], r[2])):
        expected[i] = (seen[k], totals[k])
        seen[k] += v
    found = ordering.with_running_total(ordered, ["k"], F.col("v"))
    assert {r["i"]: (int(r["before"]), int(r["whole"])) for r in dicts(found)} == expected


def test_median(spark):
    tx = table(spark, "transactions", [sale("A", price=p) for p in (20, 1, 10, 2)] + [sale("B", price=3)])
    assert {r["product_id"]: r["price"] for r in dicts(median.median_price(tx))} == {"A": 6.0, "B": 3.0}
    only = spark.createDataFrame([("B",)], "product_id string")
    assert [r["product_id"] for r in dicts(median.median_price(tx, only))] == ["B"]
    near = {r["product_id"]: r["price"] for r in dicts(median.median_price_approx(tx))}
    assert near == {"A": 2.0, "B": 3.0}


def test_median_of_a_hot_product(spark):
    rng = random.Random(9)
    prices = {"hot": [rng.randint(1, 400) for _ in range(1501)], "even": [rng.randint(1, 9) for _ in range(40)]}
    rows = [sale(p, price=v) for p, values in prices.items() for v in values] + [sale(None, price=1)]
    tx = table(spark, "transactions", rows).repartition(5)
    found = {r["product_id"]: r["price"] for r in dicts(median.median_price(tx))}
    assert found == {p: statistics.median(v) for p, v in prices.items()}


@pytest.mark.parametrize(("catalogue", "slow"), [(1, 1), (4, 1), (5, 1), (10, 2)])
def test_slow_movers_of_a_tiny_catalogue(spark, catalogue, slow):
    tx = table(spark, "transactions", [sale(f"p{i}", qty=i + 1) for i in range(catalogue)])
    found = dicts(clearance.slow_movers(velocity.sku_quantities(tx)))
    assert [r["product_id"] for r in found] == [f"p{i}" for i in range(slow)]


def test_free_up_cash_rounds_halves_to_even(spark):
    # Extra units are quantity / days x 7 x 0.5; over seven days that is half the quantity.
    last = DAY + dt.timedelta(days=6)
    tx = table(spark, "transactions", [sale("A", qty=5, price=10), sale("B", qty=7, price="10.00625", day=last)])
    cash = clearance.free_up_cash(tx, fraction=1.0)
    rows = {r["product_id"]: r for r in dicts(cash)}
    assert rows["A"]["extra_units"] == 2 and rows["B"]["extra_units"] == 4  # 2.5 and 3.5
    assert rows["B"]["discounted_price"] == 8.0  # 8.005
    assert rows["B"]["extra_cash_inflow"] == 32.0
    assert dicts(clearance.free_up_total(cash))[0] == {"n_products": 2, "total_extra_cash": 48.0}


def test_free_up_cash_parameters(spark):
    tx = table(spark, "transactions", [sale("A", qty=10, price=5)])
    row = dicts(clearance.free_up_cash(tx, discount_rate=0.5, assumed_lift=2.0))[0]
    assert row["extra_units"] == 70 and row["discounted_price"] == 2.5 and row["extra_cash_inflow"] == 175


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_salted_lookup_equals_left_join(spark, skewed, no_broadcast):
    facts = spark.createDataFrame([*skewed, (None, 1, -1), (None, 2, -2)], "k string, v long, i long").repartition(4)
    keyed = spark.createDataFrame(
        [("hot", "a"), ("hot", "b"), *[(f"k{n}", f"n{n}") for n in range(20)], (None, "x")], "k string, name string"
    )
    salted = lookup.lookup_join(facts, keyed, "k")
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    plain = facts.join(keyed, "k", "left")
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.select(*salted.columns).collect()))


def test_hot_key_is_spread_even_if_its_rows_are_copies(spark, no_broadcast):
    facts = spark.createDataFrame([("hot", 1)] * 2000 + [(f"k{n}", 1) for n in range(2000)], "k string, v long")
    hot = {r["k"]: r["_salts"] for r in dicts(lookup.hot_keys(facts, ["k"]))}
    assert hot == {"hot": 500}
    keyed = spark.createDataFrame([("hot", "a")], "k string, name string")
    joined = lookup._salted_left_join(facts, keyed, ["k"], lookup.hot_keys(facts, ["k"]))
    assert joined.count() == 4000 and joined.where("name = 'a'").count() == 2000


def test_analyses_do_not_depend_on_the_join_strategy(spark, no_broadcast):
    rows = [sale("A", qty=q, price=q + 3) for q in range(1, 40)] + [sale(f"p{i}", price=i + 1) for i in range(10)]
    tx = table(spark, "transactions", rows)
    pm = table(spark, "products", [product("A", 2), *[product(f"p{i}", 1) for i in range(8)]])
    rates = {r["product_id"]: r["gross_profit"] for r in dicts(velocity.sku_rates(tx, pm))}
    assert rates["A"] == sum(q * (q + 1) for q in range(1, 40)) and len(rates) == 9
    assert len(dicts(clearance.free_up_cash(tx, pm))) == 2


def test_hot_keys_are_found_once(spark, monkeypatch):
    scan = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    found = dicts(lookup.hot_keys(scan, ["k"], share=20))
    assert [r["k"] for r in found] == [-1] and 5 <= found[0]["_salts"] <= 9
    # A second lookup on the same key starts no job of its own.
    monkeypatch.setattr(lookup, "_frequent", None)
    again = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert dicts(lookup.hot_keys(again, ["k"], share=20)) == found


def test_hot_keys_of_several_columns_keep_their_types(spark):
    rows = [("a", 1, dt.date(2024, 1, 1))] * 500 + [("b", i, dt.date(2024, 1, 2)) for i in range(500)]
    found = dicts(lookup.hot_keys(spark.createDataFrame(rows, "k string, n int, d date"), ["k", "n", "d"], share=10))
    assert found == [{"k": "a", "n": 1, "d": dt.date(2024, 1, 1), "_salts": 5}]


def test_median_where_the_bracket_fails(spark, monkeypatch):
    """Brackets beside the median are noticed, and those products are ranked whole."""
    monkeypatch.setattr(median, "MARGIN", -0.2)
    tx = table(spark, "transactions", [sale(p, price=i) for p in "AB" for i in range(1, 42 + (p == "B"))])
    assert {r["product_id"]: r["price"] for r in dicts(median.median_price(tx))} == {"A": 21.0, "B": 21.5}


def test_rows_behind_a_shuffle_are_salted_by_content(spark):
    scan = spark.range(10)
    assert "monotonically" in str(lookup._row_number(scan))
    assert "xxhash64" in str(lookup._row_number(scan.repartition(3)))


@pytest.mark.parametrize(("text", "size"), [("10485760", 10485760), ("10MB", 10485760), ("10485760b", 10485760), ("-1", -1)])
def test_size_settings(text, size):
    assert lookup.bytes_of(text) == size
