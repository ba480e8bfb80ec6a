"""Reading, validating and storing tables."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from data import DAY, dicts, product, sale, table

from tillwise.schemas import REQUIRED_COLUMNS, empty_tables
from tillwise.sources import tables as store
from tillwise.sources.conform import conform
from tillwise.sources.csv import read_csv, write_csv
from tillwise.sources.validate import SchemaError, dataset_status, require_columns, schema_report


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


DIRTY = (
    " product_id , product_name,Unnamed: 2,cogs ,\n"
    "007,Espresso,x,1.50,\n"
    "\n"
    '008,"Tea, green",,2,\n'
    "009,Cake\n"
    "\n"
    "010,Cup,,n/a,\n"
)


def test_dirty_csv(spark, tmp_path):
    path = write(tmp_path / "products.csv", DIRTY)
    raw = read_csv(spark, path)
    assert raw.columns == ["product_id", "product_name", "cogs"]
    rows = {r["product_id"]: r for r in dicts(raw)}
    assert rows["007"] == {"product_id": "007", "product_name": "Espresso", "cogs": "1.50"}
    assert rows["008"]["product_name"] == "Tea, green"
    assert rows["009"]["cogs"] is None and len(rows) == 4
    typed = {r["product_id"]: r["cogs"] for r in dicts(conform(raw, "products"))}
    assert typed == {"007": Decimal("1.5"), "008": 2, "009": None, "010": None}
    flagged = read_csv(spark, path, keep_malformed_text=True).where("_malformed IS NOT NULL")
    assert [r["product_id"] for r in dicts(flagged)] == ["009"]


def test_strict_csv(spark, tmp_path):
    path = write(tmp_path / "products.csv", DIRTY)
    with pytest.raises(Exception, match="malformed row: 009,Cake"):
        read_csv(spark, path, strict=True).select("product_id").collect()
    clean = write(tmp_path / "clean.csv", "product_id,product_name,category,cogs\n1,a,b,2\n")
    assert read_csv(spark, clean, strict=True).count() == 1
    bad_value = write(tmp_path / "bad.csv", "product_id,product_name,category,cogs\n1,a,b,x\n")
    with pytest.raises(Exception, match="CAST|cast"):
        conform(read_csv(spark, bad_value), "products", strict=True).collect()


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'product_id,product_name\n1,"two\nlines"\n2,"say ""hi"""\n')
    assert [r["product_name"] for r in dicts(read_csv(spark, path, multiline=True).orderBy("product_id"))] == ["two\nlines", 'say "hi"']
    lines = "".join(f"{i},name {i}\n" for i in range(50))
    opened = write(tmp_path / "f.csv", f'product_id,product_name\nx,"open\n{lines}y,last\n')
    assert read_csv(spark, opened).count() == 52


def test_files_with_columns_in_another_order_are_refused(spark, tmp_path):
    (tmp_path / "two").mkdir()
    write(tmp_path / "two" / "a.csv", "id,name\n1,one\n")
    write(tmp_path / "two" / "b.csv", "name,id\ntwo,2\n")
    with pytest.raises(Exception, match="header|CSV"):
        read_csv(spark, str(tmp_path / "two")).collect()


def test_csv_round_trip_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c'), ("2", "x\ny"), ("3", "back\\slash")], "id string, text string")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out"), multiline=True).collect())) == sorted(map(tuple, df.collect()))


def test_dates_and_dialects(spark, tmp_path):
    header = ",".join(REQUIRED_COLUMNS["web"]["transactions"])
    lines = "t1,2024-03-01T10:30:00,A,a,1,10,0,10,4,6,card\nt2,2024-03-02,A,a,1,10,0,10,4,6,cash\nt3,soon,A,a,1,1,0,1,1,0,cash\n"
    path = write(tmp_path / "tx.csv", header + "\n" + lines)
    tx = store.load_table(spark, "transactions", path, dialect="web")
    days = {r["transaction_id"]: r["sale_day"] for r in dicts(tx)}
    assert days == {"t1": dt.date(2024, 3, 1), "t2": dt.date(2024, 3, 2), "t3": None}
    with pytest.raises(SchemaError, match="unit_price"):
        store.load_table(spark, "transactions", path, dialect="pos")


def test_all_problems_at_once(spark, tmp_path):
    tx = write(tmp_path / "tx.csv", "\ufeffdate,transaction_id\n2024-03-01,1\n")
    pm = write(tmp_path / "pm.csv", "product_id\n1\n")
    with pytest.raises(SchemaError, match="transactions: missing.*products: missing"):
        store.load_tables(spark, {"transactions": tx, "products": pm})
    empty = write(tmp_path / "rf.csv", "refund_id\n")
    with pytest.raises(SchemaError, match="file is empty"):
        store.load_tables(spark, {"refunds": empty}, dialect="web")
    lenient = store.load_tables(spark, {"transactions": tx, "refunds": empty}, validate=False)
    assert dicts(lenient["transactions"])[0]["sale_day"] == DAY and lenient["refunds"].count() == 0


def test_load_needs_a_file(spark, tmp_path):
    with pytest.raises(store.NoData):
        store.load_tables(spark, {"transactions": None})
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        store.load_table(spark, "products", str(tmp_path / "nowhere.csv"))
    with pytest.raises(ValueError, match="unknown table"):
        store.load_table(spark, "people", "x")


def test_folder_round_trip(spark, tmp_path):
    tables = empty_tables(spark)
    tables["transactions"] = table(spark, "transactions", [sale("A", category="c"), sale("007", category="c")])
    tables["products"] = table(spark, "products", [product("007", "1.5", category="c")])
    store.save_folder(tables, str(tmp_path))
    store.save_folder({"products": tables["products"]}, str(tmp_path))  # replaces one file only
    back = store.load_folder(spark, str(tmp_path))
    assert dicts(back["products"]) == dicts(tables["products"])
    drop = ("cogs", "gross_profit")
    assert sorted(map(str, dicts(back["transactions"].drop(*drop)))) == sorted(
        map(str, dicts(tables["transactions"].drop(*drop)))
    )


def test_current_data(spark):
    for t in store.TABLES:
        spark.catalog.dropTempView(f"till_{t}")
    with pytest.raises(store.NoData):
        store.current(spark)
    store.set_current({"products": table(spark, "products", [product("A")])})
    with pytest.raises(store.NoData):
        store.current(spark)
    store.set_current({"transactions": table(spark, "transactions", [sale("A")])})
    store.set_current({"transactions": table(spark, "transactions", [sale("A"), sale("B")])})
    now = store.current(spark)
    assert now["transactions"].count() == 2 and now["products"].count() == 1 and "refunds" not in now
    assert store.with_empty(spark, now)["refunds"].count() == 0
    with pytest.raises(ValueError, match="unknown"):
        store.set_current({"people": now["products"]})


def test_sessions(spark, tmp_path):
    folder = str(tmp_path / "sessions")
    a = {"transactions": table(spark, "transactions", [sale("A")]), "products": table(spark, "products", [product("A")])}
    b = {"transactions": table(spark, "transactions", [sale("B"), sale("C")])}
    store.save_session(a, folder, "007")
    store.save_session(b, folder, "7")
    store.save_session(b, folder, "7")
    one, seven = store.load_session(spark, folder, "007"), store.load_session(spark, folder, "7")
    assert dicts(one["transactions"]) == dicts(a["transactions"])
    assert seven["transactions"].count() == 2 and seven["products"].count() == 0
    store.save_session({"products": a["products"], "transactions": empty_tables(spark)["transactions"]}, folder, "7")
    seven = store.load_session(spark, folder, "7")
    assert seven["transactions"].count() == 0 and dicts(seven["products"]) == dicts(a["products"])
    store.save_session(empty_tables(spark), folder, "new shop")
    assert all(df.count() == 0 for df in store.load_session(spark, folder, "new shop").values())
    assert dicts(store.load_session(spark, folder, "007")["transactions"]) == dicts(a["transactions"])
    with pytest.raises(store.NoData):
        store.load_session(spark, folder, "8")
    with pytest.raises(store.NoData):
        store.load_session(spark, str(tmp_path / "none"), "1")


def test_session_document(spark, tmp_path):
    document = {
        "transactions": [{"transaction_id": "t1", "sale_day": "2024-03-01", "product_id": "A", "net_sales": 12.5}],
        "refunds": [],
        "payouts": [],
        "products": [{"product_id": "A", "cogs": 4}],
    }
    path = write(tmp_path / "1.json", json.dumps(document, indent=2))
    loaded = store.load_session_json(spark, path)
    row = dicts(loaded["transactions"])[0]
    assert row["sale_day"] == DAY and row["net_sales"] == Decimal("12.5") and row["tax"] is None
    assert loaded["refunds"].count() == 0
    web = {"transactions": [{"day": "2024-03-01", "net_sales": 1}], "refunds": [{"transaction_id": "t1", "refund_amount": 2}],
           "payouts": [{"net_payout": 3}], "products": []}
    loaded = store.load_session_json(spark, write(tmp_path / "2.json", json.dumps(web)), dialect="web")
    assert dicts(loaded["transactions"])[0]["sale_day"] == DAY
    assert dicts(loaded["refunds"])[0]["original_transaction_id"] == "t1"
    assert dicts(loaded["payouts"])[0]["net_payout_amount"] == Decimal("3")


def test_schema_report(spark):
    tx = table(spark, "transactions", [sale()]).withColumnRenamed("sale_day", "date").drop("discount")
    none = empty_tables(spark)
    rows = {r["file"]: r for r in dicts(schema_report({"transactions": tx, "refunds": none["refunds"]}))}
    assert rows["transactions"]["errors"] == ["Missing required columns: discount"]
    assert rows["refunds"] == {"file": "refunds", "n_rows": 0, "errors": []}
    web = {r["file"]: r["errors"] for r in dicts(schema_report({"transactions": tx, "refunds": none["refunds"]}, "web"))}
    assert web["refunds"] == ["File is empty"] and "day" in web["transactions"][0]
    with pytest.raises(SchemaError, match="discount.*available columns"):
        require_columns(tx, "transactions")


def test_dataset_status(spark):
    rows = dicts(dataset_status(spark, {"transactions": table(spark, "transactions", [sale()])}))
    assert rows[0] == {"dataset": "transactions", "loaded": True, "n_rows": 1}
    assert [r["loaded"] for r in rows] == [True, False, False, False]
