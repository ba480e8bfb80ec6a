"""Order of loading, and sessions that are saved whole or not at all."""

from __future__ import annotations

import datetime as dt

import pytest
from data import DAY, dicts, product, sale, table

from tillwise.operators import base, velocity
from tillwise.sources import footers
from tillwise.sources import tables as store

PRODUCTS = "product_id,product_name,category,cogs\n"
SALES = (
    "date,transaction_id,product_id,product_name,category,quantity,unit_price,gross_sales,discount,net_sales,tax,line_total,"
    "payment_type,tip_amount\n"
)


def test_the_later_file_wins_whatever_its_name(spark, tmp_path):
    later, earlier = tmp_path / "a.csv", tmp_path / "b.csv"
    earlier.write_text(PRODUCTS + "".join(f"p{i},n,c,1\n" for i in range(50)))
    later.write_text(PRODUCTS + "p1,n,c,9\np2,n,c,\np3,n,c,5\np3,n,c,6\n")
    for files, costs in (([earlier, later], {"p0": 1, "p1": 9, "p2": None, "p3": 6}), ([later, earlier], {"p0": 1, "p1": 1, "p2": 1, "p3": 1})):
        loaded = store.load_tables(spark, {"products": [str(f) for f in files]}, load_order=True)["products"]
        for shuffled in (loaded, loaded.repartition(5, "cogs"), loaded.orderBy("cogs")):
            found = {r["product_id"]: r["cogs"] for r in dicts(base.last_costs(shuffled))}
            assert {p: found[p] for p in costs} == costs and len(found) == 50


def test_the_name_loaded_last_stands_for_a_product(spark, tmp_path):
    line = "2024-03-01,t{0},A,{1},c,1,10,10,0,10,0,10,CARD,0\n"
    one, two = tmp_path / "1.csv", tmp_path / "2.csv"
    one.write_text(SALES + line.format(1, "zebra"))
    two.write_text(SALES + line.format(2, "apple"))
    pm = table(spark, "products", [product("A", 4)])
    for files, name in (([one, two], "apple"), ([two, one], "zebra")):
        tx = store.load_tables(spark, {"transactions": [str(f) for f in files]}, load_order=True)["transactions"]
        assert [r["product_name"] for r in dicts(velocity.sku_rates(tx.repartition(3), pm, "net"))] == [name]
    plain = store.load_tables(spark, {"transactions": [str(one), str(two)]})["transactions"]
    assert [r["product_name"] for r in dicts(velocity.sku_rates(plain, pm, "net"))] == ["zebra"]


def test_a_save_that_breaks_off_leaves_the_session_as_it_was(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "sessions")
    old = {"transactions": table(spark, "transactions", [sale("A")]), "products": table(spark, "products", [product("A", 1)])}
    new = {"transactions": table(spark, "transactions", [sale("B"), sale("C")]), "products": table(spark, "products", [product("B", 2)])}
    assert store.save_session(old, folder, "s") == 1
    whole, written = store.conform, []

    def breaks(df, name, **more):
        written.append(name)
        if name == "payouts":
            raise OSError("disk full")
        return whole(df, name, **more)

    monkeypatch.setattr(store, "conform", breaks)
    with pytest.raises(OSError, match="disk full"):
        store.save_session(new, folder, "s")
    monkeypatch.setattr(store, "conform", whole)
    assert "transactions" in written  # new sales lie there already, unseen
    assert [r["product_id"] for r in dicts(store.load_session(spark, folder, "s")["transactions"])] == ["A"]
    assert store.save_session(new, folder, "s") == 2
    now = store.load_session(spark, folder, "s")
    assert now["transactions"].count() == 2 and [r["product_id"] for r in dicts(now["products"])] == ["B"]
    before = store.load_session(spark, folder, "s", version=1)
    assert [r["product_id"] for r in dicts(before["transactions"])] == ["A"]
    with pytest.raises(store.NoData, match="version 3"):
        store.load_session(spark, folder, "s", version=3)
    with pytest.raises(store.NoData):
        store.load_session(spark, folder, "never saved")


def test_footers_answer_without_a_scan(spark, tmp_path):
    folder = str(tmp_path / "sessions")
    days = [DAY, DAY + dt.timedelta(days=11), None]
    store.save_session({"transactions": table(spark, "transactions", [sale(day=d) for d in days])}, folder, "s")
    path = store.session_paths(spark, folder, "s")["transactions"]
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    with footers.footers_answer(spark):
        plan = footers.footer_aggregate(spark, path, "transactions", "sale_day")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(sale_day), MAX(sale_day)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    rows = {r["dataset"]: (r["loaded"], r["n_rows"]) for r in dicts(footers.session_status(spark, folder, "s"))}
    assert rows == {"transactions": (True, 3), "refunds": (False, 0), "payouts": (False, 0), "products": (False, 0)}
    assert dicts(footers.session_coverage(spark, folder, "s")) == [
        {"first_day": DAY, "last_day": DAY + dt.timedelta(days=11), "n_days": 12}
    ]
    store.save_session({"products": table(spark, "products", [product()])}, folder, "s")
    assert dicts(footers.session_coverage(spark, folder, "s")) == [{"first_day": None, "last_day": None, "n_days": None}]
