"""Nothing is lost on loading without a trace."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tillwise.schemas import CANONICAL
from tillwise.sources import ledger
from tillwise.sources.conform import given_value
from tillwise.sources.csv import read_csv
from tillwise.sources.ledger import Ledger, audited, reject_report, rejected
from tillwise.sources.tables import load_tables
from tillwise.sources.validate import schema_report

HEADER = "product_id,product_name,category,cogs"
LINES = [
    ("A,fine,c,1.25", {}),
    ("B,too large,c,123456789012345.5", {("cogs", "became NULL")}),
    ("C,too fine,c,0.00004", {("cogs", "lost digits")}),
    ("D,rounded,c,1.23456", {("cogs", "lost digits")}),
    ("E,no number,c,abc", {("cogs", "became NULL")}),
    ("F,blank is none,c, ", {}),
    ("G,exponent,c,12e-1", {}),
    ("H,short", {("", "malformed line")}),
    ("I,long,c,1.5,more", {("", "malformed line")}),
    ("J,trailing zeros,c,1.250000000", {}),
    ('K,"quoted, comma",c,2', {}),
    ("L,both,c,1.00001,more", {("", "malformed line"), ("cogs", "lost digits")}),
    ("M,not a number,c,NaN", {("cogs", "became NULL")}),
]


@pytest.fixture
def products(tmp_path):
    path = tmp_path / "products.csv"
    path.write_text("\n".join([HEADER, *(line for line, _ in LINES)]) + "\n")
    return str(path)


def expected_counts():
    counts = {}
    for _, problems in LINES:
        for problem in problems:
            counts[problem] = counts.get(problem, 0) + 1
    return counts


def test_every_loss_is_named(spark, products):
    rows = audited(read_csv(spark, products, keep_malformed_text=True), "products")
    report = reject_report({"products": rows}).collect()
    assert {(r.field, r.problem): r.n_rows for r in report} == expected_counts() and {r.file for r in report} == {"products"}
    named = {r.product_id: set(r.problems) for r in rejected(rows, "products").collect()}
    assert named == {
        line[0]: {f"{c}: {p}" if c else p for c, p in problems} for line, problems in LINES if problems
    }


def test_counted_while_loading(spark, products):
    ledger = Ledger()
    loaded = load_tables(spark, {"products": products}, ledger=ledger)["products"]
    assert loaded.columns == ["product_id", "product_name", "category", "cogs"]
    # One job reads the table; the counts come with it, also when it reads one column only.
    assert loaded.select("product_id").count() == len(LINES)
    assert ledger.rows("products") == len(LINES) and ledger.losses("products") == expected_counts()
    assert ledger.report(spark).count() == len(expected_counts())


def test_typed_columns_and_dates(spark):
    df = spark.createDataFrame(
        [("t", "2024-02-30", 1.5, 0.1234567), ("u", "2024-02-28 10:00:00", 1e15, 2.0), ("v", None, None, None)],
        "original_transaction_id string, refund_date string, refund_amount double, other double",
    )
    report = reject_report({"refunds": audited(df, "refunds")}).collect()
    assert {(r.field, r.problem): r.n_rows for r in report} == {("refund_date", "became NULL"): 1, ("refund_amount", "became NULL"): 1}
    assert reject_report({"refunds": audited(df.limit(0), "refunds")}).count() == 0


def test_nameless_headers_are_told_apart(spark, tmp_path):
    one, two, other = (tmp_path / n for n in ("1.csv", "2.csv", "3.csv"))
    one.write_text("id,name,\n1,one,x\n")
    two.write_text("name,id,\ntwo,2,y\n")
    rows = read_csv(spark, [str(one), str(two)]).collect()
    assert sorted((r.id, r.name) for r in rows) == [("1", "one"), ("2", "two")]
    other.write_text("id,title,\n3,three,z\n")
    with pytest.raises(ValueError, match="headers differ"):
        read_csv(spark, [str(one), str(other)])
    same = tmp_path / "4.csv"
    same.write_text("id,name,\n4,four,\n")
    assert read_csv(spark, [str(one), str(same)]).count() == 2


def test_report_names_what_is_there(spark):
    df = spark.createDataFrame([("A", 1)], "product_id string, price int")
    row = schema_report({"products": df}, with_available=True).first()
    assert row.errors == ["Missing required columns: product_name, category, cogs"] and row.available == ["product_id", "price"]


def test_plain_texts_need_no_second_cast(spark):
    """Whatever the pattern lets pass has lost nothing by the full comparison; common ways of writing pass."""
    types = {f.name: f for f in CANONICAL["transactions"].fields}
    chance = random.Random(3)
    signs, blanks = ["", "-", "+"], ["", " ", "\t", "  \n"]

    def amount():
        digits = "".join(chance.choice("0123456789") for _ in range(chance.randint(0, 14)))
        behind = "".join(chance.choice("0123456789") for _ in range(chance.randint(0, 9))) + "0" * chance.randint(0, 9)
        return chance.choice(signs) + digits + chance.choice(["", ".", f".{behind}", "e2", "x"])

    def day():
        text = f"{chance.choice([0, 999, 1900, 2023, 2024])}-{chance.randint(0, 13):02}-{chance.randint(0, 32):02}"
        return text + chance.choice(["", " 10:00:00", "T23:59:59", " 24:00:00", " 10:00", "x"])

    plain = ["1", "-2.5", "+3.25", " 4.10 ", "5.2500000000", "123456789012.123456", "", "  ", None]
    rows = [(plain[i], "2024-01-31") for i in range(len(plain))] + [(None, "2024-02-28 10:00:00"), ("1", " 1999-12-31")]
    n_plain = len(rows)
    rows += [(chance.choice(blanks) + amount() + chance.choice(blanks), chance.choice(blanks) + day()) for _ in range(4000)]
    raw = spark.createDataFrame([(i, a, d) for i, (a, d) in enumerate(rows)], "no int, line_total string, sale_day string")
    lost = {}
    for name in ("line_total", "sale_day"):
        given = given_value(raw, types[name])
        problems = [ledger._lost(raw, types[name], p, given) for c, p in ledger._problems("transactions") if c == name]
        passes = F.coalesce(ledger._plain(raw, types[name]), F.lit(False))
        found = raw.select("no", passes.alias("plain"), F.array_contains(F.array(*problems), True).alias("lost")).collect()
        assert all(r.plain for r in found if r.no < n_plain) and not any(r.plain and r.lost for r in found)
        assert sum(r.plain for r in found) > 100 and sum(r.lost for r in found) > 100
        for r in found:
            lost[r.no] = lost.get(r.no, False) or r.lost
    named = audited(raw.withColumn("transaction_id", F.col("no").cast("string")), "transactions").select("transaction_id", "_lost")
    marked = {int(r.transaction_id): r._lost != 0 for r in named.collect()}
    assert marked == lost
