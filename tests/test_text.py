"""Sections, outlines and JSON records."""

from __future__ import annotations

import json
from decimal import Decimal

from data import dicts, product, sale, table

from tillwise.operators import leaks, margins, payload, reorder, report, snapshot, text, velocity
from tillwise.schemas import empty_tables


def sections(spark, value, **options):
    df = spark.createDataFrame([(1, value)], "id long, text string")
    return [
        (r["kind"], r["number"], r["header"], r["body"])
        for r in dicts(text.text_sections(df, "id", **options).orderBy("section_no"))
    ]


def outline(spark, value):
    df = spark.createDataFrame([(1, value)], "id long, text string")
    return [
        (r["kind"], r["content"], r["starts_list"]) for r in dicts(text.text_outline(df, "id").orderBy("block_no"))
    ]


def test_sections(spark):
    value = (
        "1. **Main**: body of **it**\n\n- item **x**\n\nHeader: text\n\nA plain sentence without a colon\n\n"
        "**Bold**: start\n\n6. Six\n\n• Key: v\n\n*star\n\n  \n\n2.x\n\nSee v1.0 now: yes"
    )
    assert sections(spark, value) == [
        ("numbered", 1, "Main", "body of **it**"),
        ("bullet", None, None, "item x"),
        ("plain", None, "Header", "text"),
        ("plain", None, None, "A plain sentence without a colon"),
        ("plain", None, "Bold", "start"),
        ("plain", None, None, "6. Six"),
        ("bullet", None, "Key", "v"),
        ("bullet", None, None, "star"),
        ("numbered", 2, None, "x"),
        ("plain", None, None, "See v1.0 now: yes"),
    ]


def test_sections_at_the_edges(spark):
    assert sections(spark, "") == [] and sections(spark, None) == [] and sections(spark, " \n\n ") == []
    assert sections(spark, "　one ") == [("plain", None, None, "one")]
    header = "h" * 79
    assert sections(spark, f"{header}: b") == [("plain", None, header, "b")]
    assert sections(spark, f"h{header}: b") == [("plain", None, None, f"h{header}: b")]
    assert sections(spark, "a ***:b") == [("plain", None, "", "b")]
    assert sections(spark, "a|b.c|d", separator="|") == [
        ("plain", None, None, "a"), ("plain", None, None, "b.c"), ("plain", None, None, "d"),
    ]


def test_outline(spark):
    value = (
        "Intro line\nsecond **bold** line\n1. **Title one** then text\nmore\n- a\n- **b**: c\n\n- d\nafter\n"
        "12.  **Last**\n-\n\n\nend\n3. **never closed"
    )
    assert outline(spark, value) == [
        ("paragraph", "Intro line second bold line", False),
        ("heading", "Title one", False),
        ("paragraph", "then text more", False),
        ("bullet", "a", True),
        ("bullet", "b: c", False),
        ("bullet", "d", True),
        ("paragraph", "after", False),
        ("heading", "Last", False),
        ("bullet", "", True),
        ("paragraph", "end 3. **never closed", False),
    ]


def test_outline_keeps_separators_of_the_text(spark):
    assert outline(spark, "a\x1eHb\x1ekc\n- \x1eLd") == [
        ("paragraph", "a\x1eHb\x1ekc", False),
        ("bullet", "Ld", True),
    ]
    assert outline(spark, None) == [] and outline(spark, " \n ") == []


def test_payloads(spark):
    tables = empty_tables(spark)
    tx = table(spark, "transactions", [sale("A", 2, 10, 1), sale("B", 1, 5)])
    pm = table(spark, "products", [product("A", 4), product("B", 4)])
    eaters = leaks.cash_eaters(tx, tables["refunds"], tables["payouts"])
    low = margins.low_margin_products(margins.product_margins(tx, pm))
    record = json.loads(payload.cash_payload(eaters, low).first()["payload"])
    assert [e["category"] for e in record["cash_eaters"]] == ["Discounts", "Processor fees", "Refunds"]
    assert [p["product_id"] for p in record["low_margin_products"]] == ["B", "A"]
    bought = reorder.reorder_purchases(velocity.sku_rates(tx, pm), 20)
    lines = dicts(payload.plan_payload(reorder.reorder_plan(bought), reorder.reorder_summary(bought, 20)))
    assert json.loads(lines[0]["payload"]) == {"budget": 20.0, "spent": 20.0, "remaining": 0.0, "n_items": 1}
    assert json.loads(lines[1]["payload"])["suggested_qty"] == 5
    wide = dicts(leaks.cash_eaters_wide(eaters))[0]
    assert wide == {"discounts": 1.0, "refunds": 0.0, "processor_fees": 0.0}


def test_empty_results_still_make_a_record(spark):
    tables = empty_tables(spark)
    eaters = leaks.cash_eaters(tables["transactions"], tables["refunds"], tables["payouts"])
    low = margins.low_margin_products(margins.product_margins(tables["transactions"], tables["products"]))
    assert json.loads(payload.cash_payload(eaters, low).first()["payload"])["low_margin_products"] == []


def test_lines_to_read(spark):
    tables = empty_tables(spark)
    tx = table(spark, "transactions", [sale("A", 200, 10, Decimal("0.5"))])
    shot = snapshot.executive_snapshot(tx, tables["refunds"], tables["payouts"])
    lines = {r["label"]: r["value"] for r in dicts(report.snapshot_lines(shot))}
    assert lines["Business Snapshot"] == "2024-03-01 → 2024-03-01"
    assert (lines["Items sold"], lines["Gross sales"], lines["Discounts"]) == ("200", "€2,000.00", "€0.50")
    eaters = report.leak_lines(leaks.cash_eaters(tx, tables["refunds"], tables["payouts"]))
    assert dicts(eaters)[0] == {"category": "Discounts", "amount": "€0.50", "share": "100.0%"}
    bought = reorder.reorder_purchases(velocity.sku_rates(tx, table(spark, "products", [product("A", 4)])), 500.5)
    messages = report.reorder_message(reorder.reorder_summary(bought, 500.5))
    assert dicts(messages) == [{"message": "Budget: €500 → Remaining: €0.50"}]
    total = spark.sql("SELECT 1234.5D AS total_extra_cash")
    assert dicts(report.clearance_message(total))[0]["message"].endswith("clearance: €1234.50")


def test_text_behind_a_heading_keeps_its_bold_marks(spark):
    df = spark.createDataFrame([(1, "1. **Title** with **bold** text\nand **more**")], "id int, text string")
    rows = [(r.kind, r.content) for r in text.text_outline(df, "id").orderBy("block_no").collect()]
    assert rows == [("heading", "Title"), ("paragraph", "with **bold** text and more")]
