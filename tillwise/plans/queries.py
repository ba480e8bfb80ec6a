"""Every query by name: ``(spark, folder) -> DataFrame`` over the star-schema tables in ``folder``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.numbers import as_double
from tillwise.operators import base, clearance, coverage, leaks, margins, median, payload, reorder, report
from tillwise.operators import snapshot, states, text, velocity
from tillwise.operators.lookup import lookup_join
from tillwise.operators.ordering import scratch_path, stored
from tillwise.plans.dispatch import run_analysis
from tillwise.sources import footers, months, star
from tillwise.sources.conform import conform, to_dialect
from tillwise.sources.csv import read_csv, write_csv
from tillwise.sources.ledger import audited, reject_report, rejected
from tillwise.sources.tables import (
    current, load_folder, load_session, load_tables, save_folder, save_session, set_current, with_empty,
)
from tillwise.sources.validate import dataset_status, schema_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BUDGET = 500_000.0
STORE_BUDGET = 50_000.0
SKU_AND_DAY = (*star.SKU_COLUMNS, "sale_day")


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _sales(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return star.transactions(spark, folder, columns)


def _days(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.date_coverage(_sales(spark, folder, "sale_day"))


def _doubles(df: DataFrame) -> DataFrame:
    """Decimal columns as DOUBLE, for output."""
    return df.select(
        *[as_double(c).alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes]
    )


# -- sales lines ---------------------------------------------------------------------------------


@query
def processed_transactions(spark, folder):
    done = base.processed_transactions(star.transactions(spark, folder), star.products(spark, folder))
    return _doubles(done)


@query
def processed_transactions_relisted(spark, folder):
    """A product listed twice repeats its sales."""
    done = base.processed_transactions(
        _sales(spark, folder, "transaction_id", "product_id", "quantity", "unit_price", "discount"),
        star.products_loaded_twice(spark, folder),
    )
    return _doubles(done)


@query
def processed_transactions_unknown_cost(spark, folder):
    """Costs that the master does not know leave margin and profit empty."""
    done = base.processed_transactions(
        _sales(spark, folder, "transaction_id", "product_id", "quantity", "unit_price", "discount"),
        star.products_with_gaps(spark, folder),
    )
    return _doubles(done)


@query
def gross_profit_last_load(spark, folder):
    """Two files of products with different costs: what the later one says counts, whatever becomes of the order of rows."""
    loads, path = star.products_loaded_twice(spark, folder), scratch_path(spark, "loads")
    files = [f"{path}/first", f"{path}/second"]
    for no, file in enumerate(files, 1):
        write_csv(loads.where(F.col("load_no") == no).drop("load_no"), file)
    listed = load_tables(spark, {"products": files}, load_order=True)["products"].repartition(7, "cogs")
    sales = _sales(spark, folder, "transaction_id", "product_id", "quantity", "net_sales")
    sales = sales.withColumn("product_id", F.col("product_id").cast("string"))
    return _doubles(base.gross_profit_net(sales, listed))


@query
def sales_with_listed_cost(spark, folder):
    """The master as if it were too large to broadcast: hot products are salted."""
    sales = _sales(spark, folder, "transaction_id", "product_id", "quantity", "net_sales")
    costs = star.products(spark, folder).select("product_id", "cogs")
    return _doubles(lookup_join(sales, costs, "product_id", scan=sales, limit=0))


@query
def gross_profit_net(spark, folder):
    done = base.gross_profit_net(
        _sales(spark, folder, "transaction_id", "product_id", "quantity", "net_sales"),
        star.products_loaded_twice(spark, folder),
        load_order="load_no",
    )
    return _doubles(done)


@query
def period_filter(spark, folder):
    sales = _sales(spark, folder, "transaction_id", "sale_day", "product_id", "net_sales")
    return _doubles(coverage.filter_period(sales, "sale_day", "1996-01-01", "1996-03-31"))


def _sales_by_month(spark, folder):
    """The path and the schema of the sales, laid out by month."""
    sales = _sales(spark, folder, "transaction_id", "sale_day", "product_id", "quantity", "net_sales")
    path = scratch_path(spark, "sales-by-month")
    months.save_by_month(sales, path)
    return path, sales.schema


@query
def period_from_months(spark, folder):
    """A period of sales laid out by month: the other months' files stay closed."""
    path, schema = _sales_by_month(spark, folder)
    return _doubles(months.read_period(spark, path, schema, "sale_day", "1996-01-01", "1996-03-31").drop("quantity"))


@query
def years_compared(spark, folder):
    """The first quarters of all years with orders, side by side."""
    path, schema = _sales_by_month(spark, folder)
    first = F.trunc(F.col("o_orderdate").cast("date"), "year")
    quarters = star.read(spark, folder, "orders").select(first.alias("first_day")).distinct()
    periods = stored(
        quarters.select(
            F.year("first_day").cast("string").alias("period"),
            "first_day",
            F.date_sub(F.add_months("first_day", 3), 1).alias("last_day"),
        ),
        "periods",
    )
    inside = months.read_periods(spark, path, schema, periods)
    return inside.groupBy("period").agg(
        F.count("*").alias("n_rows"),
        as_double(F.sum("quantity")).alias("quantity"),
        as_double(F.sum("net_sales")).alias("net_sales"),
    )


@query
def date_coverage(spark, folder):
    return _days(spark, folder)


# -- snapshot ------------------------------------------------------------------------------------


@query
def executive_snapshot(spark, folder):
    return snapshot.executive_snapshot(
        _sales(spark, folder, *star.SNAPSHOT_COLUMNS), star.refunds(spark, folder), star.payouts(spark, folder)
    )


@query
def executive_snapshot_relisted(spark, folder):
    return snapshot.executive_snapshot(
        _sales(spark, folder, *star.SNAPSHOT_COLUMNS),
        star.refunds(spark, folder),
        star.payouts(spark, folder),
        star.products_loaded_twice(spark, folder),
    )


@query
def executive_snapshot_net(spark, folder):
    return snapshot.executive_snapshot_net(
        _sales(spark, folder, *star.SNAPSHOT_COLUMNS), star.refunds(spark, folder), star.payouts(spark, folder)
    )


def _states(spark, folder):
    made = states.snapshot_states(
        _sales(spark, folder, *star.SNAPSHOT_COLUMNS), star.refunds(spark, folder), star.payouts(spark, folder)
    )
    return {name: stored(df, f"{name}-states") for name, df in made.items()}


@query
def snapshot_from_states(spark, folder):
    """The whole period, merged from the states of its months."""
    return states.merged_snapshot(_states(spark, folder))


@query
def snapshot_of_half_a_year(spark, folder):
    """Six months, merged from their states: no sale is read again."""
    return states.merged_snapshot(_states(spark, folder), "1995-01-01", "1995-06-01")


@query
def snapshot_lines(spark, folder):
    return report.snapshot_lines(executive_snapshot(spark, folder))


@query
def sales_by_payment_type(spark, folder):
    return snapshot.sales_by_payment_type(_sales(spark, folder, "payment_type", "line_total", "net_sales"))


@query
def business_summary(spark, folder):
    return snapshot.business_summary(_sales(spark, folder, "transaction_id", "line_total"), star.refunds(spark, folder))


# -- leaks and margins ---------------------------------------------------------------------------


def _leaks(spark, folder):
    return leaks.cash_eaters(
        _sales(spark, folder, "discount"), star.refunds(spark, folder), star.payouts(spark, folder)
    )


@query
def cash_eaters(spark, folder):
    return _leaks(spark, folder)


@query
def cash_eaters_wide(spark, folder):
    return leaks.cash_eaters_wide(_leaks(spark, folder))


@query
def leak_lines(spark, folder):
    return report.leak_lines(_leaks(spark, folder))


def _margins(spark, folder):
    return margins.product_margins(_sales(spark, folder, *star.SKU_COLUMNS), star.products(spark, folder))


@query
def product_margins(spark, folder):
    return _margins(spark, folder)


@query
def low_margin_products(spark, folder):
    return margins.low_margin_products(_margins(spark, folder))


@query
def low_margin_positive(spark, folder):
    skus = margins.product_margins(
        _sales(spark, folder, *SKU_AND_DAY),
        star.products_loaded_twice(spark, folder),
        "net",
        load_order="load_no",
        by_name=False,
        positive_only=True,
    )
    return margins.low_margin_products(skus, tie_on_revenue=False)


@query
def low_margin_given(spark, folder):
    """Sales that already carry cost and profit, as the strict upload delivers them."""
    given = base.gross_profit_net(
        _sales(spark, folder, *SKU_AND_DAY), star.products(spark, folder)
    )
    return margins.low_margin_products(margins.product_margins(given, definition="given", by_name=False))


# -- velocity, slow movers, clearance ------------------------------------------------------------


def _rates(spark, folder):
    return velocity.sku_rates(
        _sales(spark, folder, *star.SKU_COLUMNS), star.products(spark, folder), coverage=_days(spark, folder)
    )


def _rates_net(spark, folder):
    return velocity.sku_rates(
        _sales(spark, folder, *SKU_AND_DAY),
        star.products_loaded_twice(spark, folder),
        "net",
        load_order="load_no",
        coverage=_days(spark, folder),
    )


@query
def sku_velocity(spark, folder):
    return _doubles(velocity.sku_velocity(_rates(spark, folder)))


@query
def sku_velocity_net(spark, folder):
    return _doubles(velocity.sku_velocity(_rates_net(spark, folder), by_quantity=False))


@query
def median_price(spark, folder):
    return median.median_price(_sales(spark, folder, "product_id", "unit_price"))


def _quantities(spark, folder):
    return velocity.sku_quantities(
        _sales(spark, folder, "product_id", "product_name", "quantity"), coverage=_days(spark, folder)
    )


@query
def slow_movers(spark, folder):
    return clearance.slow_movers(_quantities(spark, folder))


def _clearance(spark, folder):
    return clearance.free_up_cash(
        _sales(spark, folder, "product_id", "product_name", "quantity", "unit_price"), coverage=_days(spark, folder)
    )


@query
def free_up_cash(spark, folder):
    return _clearance(spark, folder)


@query
def free_up_total(spark, folder):
    return clearance.free_up_total(_clearance(spark, folder))


@query
def clearance_message(spark, folder):
    return report.clearance_message(free_up_total(spark, folder))


# -- reorder -------------------------------------------------------------------------------------


@query
def reorder_plan(spark, folder):
    return reorder.reorder_plan(reorder.reorder_purchases(_rates(spark, folder), BUDGET))


@query
def reorder_plan_unknown_cost(spark, folder):
    """Products of unknown cost are never reordered."""
    rates = velocity.sku_rates(
        _sales(spark, folder, *star.SKU_COLUMNS), star.products_with_gaps(spark, folder), coverage=_days(spark, folder)
    )
    return reorder.reorder_plan(reorder.reorder_purchases(rates, BUDGET))


@query
def reorder_plan_default_budget(spark, folder):
    """No budget given: 500, for goods that cost a hundredth."""
    cheap = star.products(spark, folder).withColumn("cogs", (F.col("cogs") / 100).cast("decimal(18,4)"))
    rates = velocity.sku_rates(_sales(spark, folder, *star.SKU_COLUMNS), cheap, coverage=_days(spark, folder))
    return reorder.reorder_plan(reorder.reorder_purchases(rates))


@query
def reorder_plan_net(spark, folder):
    bought = reorder.reorder_purchases(_rates_net(spark, folder), BUDGET, by_quantity=False)
    return reorder.web_plan(reorder.reorder_plan(bought, half_even=False))


@query
def reorder_summary(spark, folder):
    return reorder.reorder_summary(reorder.reorder_purchases(_rates(spark, folder), BUDGET), BUDGET)


@query
def reorder_message(spark, folder):
    return report.reorder_message(reorder_summary(spark, folder))


def _by_nation(spark, folder, budgets=None):
    sales = star.transactions(spark, folder, star.SKU_COLUMNS, with_store=True)
    rates = velocity.sku_rates(
        sales, star.products(spark, folder), coverage=_days(spark, folder), extra_keys=["store"]
    )
    return reorder.reorder_purchases(rates, STORE_BUDGET, store_keys=["store"], budgets=budgets)


@query
def reorder_plan_by_nation(spark, folder):
    return reorder.reorder_plan(_by_nation(spark, folder), store_keys=["store"])


@query
def reorder_summary_by_nation(spark, folder):
    return reorder.reorder_summary(_by_nation(spark, folder), STORE_BUDGET, ["store"])


@query
def reorder_summary_own_budgets(spark, folder):
    """Every store has a budget of its own; the first one's is 0, and it still has its row."""
    nations = star.read(spark, folder, "nation")
    budgets = nations.select(F.col("n_name").alias("store"), (F.col("n_nationkey") * 2_000).cast("decimal(18,4)").alias("budget"))
    return reorder.reorder_summary(_by_nation(spark, folder, budgets), store_keys=["store"], budgets=budgets)


# -- analysis by name ----------------------------------------------------------------------------


@query
def analysis_cash_eaters(spark, folder):
    return run_analysis(star.tables(spark, folder), "cash_eaters")["cash_eaters"]


@query
def analysis_low_margin(spark, folder):
    return run_analysis(star.tables(spark, folder), "cash_eaters")["low_margin_products"]


@query
def analysis_cash_eaters_web(spark, folder):
    return run_analysis(star.tables(spark, folder), "cash_eaters", dialect="web")["cash_eaters"]


@query
def analysis_reorder(spark, folder):
    return run_analysis(star.tables(spark, folder), "reorder", budget=BUDGET)["reorder_plan"]


@query
def analysis_reorder_web(spark, folder):
    return run_analysis(star.tables(spark, folder), "reorder", dialect="web", budget=BUDGET)["reorder_summary"]


@query
def analysis_free_cash(spark, folder):
    return run_analysis(star.tables(spark, folder), "free_cash")["free_up_total"]


@query
def current_snapshot(spark, folder):
    """The snapshot of whatever tables are current; refunds come later and replace those of before."""
    tables = star.tables(spark, folder)
    set_current({**tables, "refunds": tables["refunds"].limit(0)})
    set_current({"refunds": tables["refunds"]})
    now = current(spark)
    return snapshot.executive_snapshot(now["transactions"], now["refunds"], now["payouts"])


@query
def snapshot_of_sales_only(spark, folder):
    """A shop that has connected its till and nothing else."""
    tables = with_empty(spark, {"transactions": star.transactions(spark, folder)})
    return snapshot.executive_snapshot(tables["transactions"], tables["refunds"], tables["payouts"])


@query
def analysis_snapshot_only(spark, folder):
    """A name no analysis goes by still gives the snapshot."""
    return run_analysis(star.tables(spark, folder), "free_up", dialect="web")["snapshot"]


# -- ingest, validation, status, round trips -----------------------------------------------------


@query
def csv_ingest(spark, folder):
    """A spreadsheet-like export: blanks around names, a nameless column, quantities that are no numbers."""
    sales = to_dialect(star.transactions(spark, folder), "transactions")
    unreadable = F.col("product_id") % 89 == 0
    export = sales.withColumns(
        {
            "quantity": F.when(unreadable, F.lit("n/a")).otherwise(F.col("quantity").cast("bigint").cast("string")),
            "Unnamed: 14": F.lit(None).cast("string"),
        }
    )
    path = scratch_path(spark, "csv-ingest")
    write_csv(export.toDF(*[f" {c} " for c in export.columns]), path)
    return _doubles(
        conform(read_csv(spark, path), "transactions").drop("cogs", "gross_profit")
    )


def _damaged_export(spark, folder):
    """Lines of CSV with values that do not fit, lines that end early, and lines with a field too many; its path."""
    sales = to_dialect(star.transactions(spark, folder), "transactions")
    product = F.col("product_id")

    def damaged(column: str, every: int, value: str) -> None:
        nonlocal sales
        sales = sales.withColumn(column, F.when(F.col("_product") % every == 0, F.lit(value)).otherwise(F.col(column).cast("string")))

    sales = sales.withColumn("_product", product)
    damaged("quantity", 89, "n/a")
    damaged("line_total", 83, "123456789012345.5")
    damaged("tip_amount", 79, "0.00000004")
    damaged("date", 73, "someday")
    columns = [c for c in sales.columns if c != "_product"]
    whole = F.to_csv(F.struct(*columns))
    line = (
        F.when(F.col("_product") % 71 == 0, F.to_csv(F.struct(*columns[:5])))
        .when(F.col("_product") % 67 == 0, F.concat(whole, F.lit(",surplus")))
        .otherwise(whole)
    )
    path = scratch_path(spark, "csv-damaged")
    # One column whose name is the header and whose values are lines, written as they are.
    as_is = {"header": True, "sep": "\u0001", "quote": "\u0000", "escapeQuotes": False}
    sales.select(line.alias(",".join(columns))).write.options(**as_is).csv(path)
    return path


@query
def load_losses(spark, folder):
    """What a damaged export loses on loading, by field and problem."""
    raw = read_csv(spark, _damaged_export(spark, folder), keep_malformed_text=True)
    return reject_report({"transactions": audited(raw, "transactions")})


@query
def load_rejects(spark, folder):
    """The rows that lost something, with what they lost."""
    raw = read_csv(spark, _damaged_export(spark, folder), keep_malformed_text=True)
    rows = rejected(audited(raw, "transactions"), "transactions")
    return rows.groupBy("product_id", F.array_join("problems", "; ").alias("problems")).agg(F.count("*").alias("n_rows"))


def _lines(tables):
    """The four tables as one: table, key, day and amount of each row."""
    parts = {
        "transactions": ("transaction_id", "sale_day", "line_total"),
        "refunds": ("original_transaction_id", "refund_date", "refund_amount"),
        "payouts": ("covering_sales_date", "payout_date", "net_payout_amount"),
        "products": ("product_id", None, "cogs"),
    }
    lines = [
        tables[t].select(
            F.lit(t).alias("part"),
            F.col(key).cast("string").alias("key"),
            (F.col(day) if day else F.lit(None)).cast("date").alias("day"),
            F.col(amount).cast("double").alias("amount"),
        )
        for t, (key, day, amount) in parts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), lines)


@query
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "csv-roundtrip")
    save_folder(star.tables(spark, folder), path)
    return _lines(load_folder(spark, path))


@query
def session_roundtrip(spark, folder):
    """Two sessions; the second is stored again with its products only, and so has nothing else left."""
    path = scratch_path(spark, "sessions")
    # Put together once, saved three times.
    tables = {t: stored(df, t) for t, df in star.tables(spark, folder).items()}
    save_session(tables, path, "001")
    save_session(tables, path, "002")
    save_session({"products": tables["products"]}, path, "002")
    return reduce(
        lambda a, b: a.unionByName(b),
        [_lines(load_session(spark, path, i)).withColumn("session", F.lit(i)) for i in ("001", "002")],
    )


def _stored_session(spark, folder):
    path = scratch_path(spark, "sessions")
    tables = star.tables(spark, folder)
    save_session({t: tables[t] for t in ("transactions", "refunds")}, path, "status")
    return path


@query
def session_status(spark, folder):
    """Rows of a stored session's tables, from file footers."""
    return footers.session_status(spark, _stored_session(spark, folder), "status")


@query
def session_coverage(spark, folder):
    """The days a stored session covers, from file footers."""
    return footers.session_coverage(spark, _stored_session(spark, folder), "status")


@query
def dataset_status_query(spark, folder):
    tables = star.tables(spark, folder)
    del tables["products"]
    return dataset_status(spark, tables)


@query
def schema_report_query(spark, folder):
    tables = {t: to_dialect(df, t) for t, df in star.tables(spark, folder).items()}
    tables["transactions"] = tables["transactions"].drop("discount", "tax")
    report = schema_report(tables)
    return report.withColumn("errors", F.array_join("errors", "; "))


@query
def schema_report_web(spark, folder):
    """Files of the other dialect: columns that are missing, those there instead, and a file without rows."""
    tables = {t: to_dialect(df, t) for t, df in star.tables(spark, folder).items()}
    tables["refunds"] = tables["refunds"].where("refund_amount < 0")
    report = schema_report(tables, "web", with_available=True)
    return report.withColumns({c: F.array_join(c, "; ") for c in ("errors", "available")})


QUERIES["dataset_status"] = QUERIES.pop("dataset_status_query")
QUERIES["schema_report"] = QUERIES.pop("schema_report_query")


# -- texts ---------------------------------------------------------------------------------------


@query
def text_sections(spark, folder):
    return text.text_sections(star.marked_up_documents(spark, folder), "doc_id", separator="\n")


@query
def text_sections_paragraphs(spark, folder):
    return text.text_sections(star.marked_up_documents(spark, folder), "doc_id")


@query
def text_sections_turns(spark, folder):
    return text.text_sections(star.read(spark, folder, "conversations"), "conv_id", "turn", separator="\n")


@query
def text_outline(spark, folder):
    return text.text_outline(star.marked_up_documents(spark, folder), "doc_id")


@query
def text_outline_turns(spark, folder):
    return text.text_outline(star.read(spark, folder, "conversations"), "conv_id", "turn")


# -- JSON records --------------------------------------------------------------------------------


@query
def insight_payload(spark, folder):
    low = margins.low_margin_products(_margins(spark, folder))
    return payload.cash_payload(_leaks(spark, folder), low)


@query
def insight_payload_read(spark, folder):
    """The insight record parsed again, one row per item."""
    schema = (
        "cash_eaters array<struct<category string, amount double, percentage double>>, "
        "low_margin_products array<struct<product_id bigint, revenue double, margin_pct double>>"
    )
    record = insight_payload(spark, folder).select(F.from_json("payload", schema).alias("r"))
    leaked = record.select(F.lit("cash_eaters").alias("section"), F.inline("r.cash_eaters"))
    low = record.select(F.lit("low_margin_products").alias("section"), F.inline("r.low_margin_products"))
    return leaked.toDF("section", "label", "amount", "ratio").unionByName(
        low.withColumn("product_id", F.col("product_id").cast("string")).toDF("section", "label", "amount", "ratio")
    )


@query
def snapshot_payload_read(spark, folder):
    """The snapshot as a JSON record and read again."""
    kinds = {"first_day": "string", "transactions": "bigint", "items_sold": "bigint"}
    amounts = [c for c in executive_snapshot(spark, folder).columns if c not in (*kinds, "last_day")]
    written = payload.snapshot_payload(executive_snapshot(spark, folder))
    return payload.payload_values(written, {**kinds, "last_day": "string", **dict.fromkeys(amounts, "double")})


@query
def reorder_payload(spark, folder):
    bought = reorder.reorder_purchases(_rates(spark, folder), BUDGET)
    return payload.plan_payload(reorder.reorder_plan(bought), reorder.reorder_summary(bought, BUDGET))
