"""The same results in plain SQL, straight from the definitions, for the correctness check."""

from __future__ import annotations

from tillwise.functions.strings import WHITE_SPACE
from tillwise.operators.report import SNAPSHOT_LINES

_TX = """
tx0 AS (
  SELECT l_orderkey AS transaction_id, l_partkey AS product_id, p_name AS product_name, p_type AS category,
         CAST(o_orderdate AS DATE) AS sale_day, CAST(l_quantity AS BIGINT) AS quantity,
         CAST(l_extendedprice / l_quantity AS DECIMAL(20,8)) AS unit_price,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS g, CAST(l_discount AS DECIMAL(4,2)) AS d,
         CAST(l_tax AS DECIMAL(4,2)) AS t, n_name AS store,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1','2','3') THEN 'CARD'
              WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'CASH' ELSE 'VOUCHER' END AS payment_type
  FROM lineitem
  LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN part ON p_partkey = l_partkey
  LEFT JOIN supplier ON s_suppkey = l_suppkey
  LEFT JOIN nation ON n_nationkey = s_nationkey),
tx AS (
  SELECT transaction_id, product_id, product_name, category, sale_day, quantity, unit_price, payment_type, store,
         g AS gross_sales, CAST(g * d AS DECIMAL(20,4)) AS discount, CAST(g * (1 - d) AS DECIMAL(20,4)) AS net_sales,
         CAST(CAST(g * (1 - d) AS DECIMAL(20,4)) * t AS DECIMAL(20,6)) AS tax,
         CAST(CAST(g * (1 - d) AS DECIMAL(20,4)) * (1 + t) AS DECIMAL(20,6)) AS line_total,
         CASE WHEN payment_type = 'CARD' THEN CAST(CAST(g * (1 - d) AS DECIMAL(20,4)) * 0.05 AS DECIMAL(20,6))
              ELSE CAST(0 AS DECIMAL(20,6)) END AS tip_amount
  FROM tx0)"""

_RF = """
rf AS (
  SELECT l_orderkey AS original_transaction_id, CAST(l_shipdate AS DATE) AS refund_date,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(20,4))
           AS refund_amount
  FROM lineitem WHERE l_returnflag = 'R')"""

_PO = """
po AS (
  SELECT sale_day, sum(line_total) AS gross_card_volume,
         CAST(CAST(sum(line_total) AS DECIMAL(28,6)) * 0.025 AS DECIMAL(30,6)) AS processor_fees,
         CAST(CAST(sum(line_total) AS DECIMAL(28,6)) * 0.975 AS DECIMAL(30,6)) AS net_payout_amount
  FROM tx WHERE payment_type = 'CARD' GROUP BY sale_day)"""

_PM = """
pm AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(18,2)) AS cogs
  FROM part)"""

_PM_GAPS = """
pm AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         CASE WHEN p_partkey % 97 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) END AS cogs
  FROM part)"""

_PM2 = (
    _PM
    + """,
pm2 AS (
  SELECT *, 1 AS load_no FROM pm
  UNION ALL
  SELECT product_id, product_name, category, CAST(cogs + 2 AS DECIMAL(18,2)), 2 FROM pm WHERE product_id % 10 = 0),
lastcost AS (SELECT product_id, arg_max(cogs, load_no) AS cogs FROM pm2 GROUP BY product_id)"""
)

_DAYS = """
cover AS (
  SELECT min(sale_day) AS first_day, max(sale_day) AS last_day,
         date_diff('day', min(sale_day), max(sale_day)) + 1 AS n_days FROM tx)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


_PROCESSED = """
ptx AS (
  SELECT tx.*, pm.cogs, unit_price - pm.cogs AS unit_margin,
         CAST(quantity AS DECIMAL(10,0)) * (unit_price - pm.cogs) - discount AS gross_profit
  FROM tx LEFT JOIN pm ON pm.product_id = tx.product_id)"""

_PROCESSED2 = _PROCESSED.replace("pm.", "pm2.").replace("JOIN pm ", "JOIN pm2 ")

_NET = """
ntx AS (
  SELECT tx.*, coalesce(lastcost.cogs, 0) AS cogs,
         net_sales - coalesce(lastcost.cogs, 0) * CAST(quantity AS DECIMAL(10,0)) AS gross_profit
  FROM tx LEFT JOIN lastcost ON lastcost.product_id = tx.product_id)"""

_LEAKS = """
leak AS (
  SELECT 'Discounts' AS category, CAST(sum(discount) AS DOUBLE) AS amount FROM tx
  UNION ALL SELECT 'Refunds', CAST(sum(refund_amount) AS DOUBLE) FROM rf
  UNION ALL SELECT 'Processor fees', CAST(sum(processor_fees) AS DOUBLE) FROM po)"""

_LEAK_TOTAL = """
leaktotal AS (
  SELECT CAST((SELECT sum(discount) FROM tx) + (SELECT sum(refund_amount) FROM rf)
              + (SELECT sum(processor_fees) FROM po) AS DOUBLE) AS everything)"""

_MARGINS = """
sku AS (
  SELECT product_id, product_name, CAST(sum(net_sales) AS DOUBLE) AS revenue,
         CAST(coalesce(sum(gross_profit), 0) AS DOUBLE) AS gross_profit
  FROM ptx GROUP BY product_id, product_name),
margins AS (
  SELECT *, CASE WHEN revenue > 0 THEN gross_profit / revenue ELSE 0.0 END AS margin_pct,
         CASE WHEN (CASE WHEN revenue > 0 THEN gross_profit / revenue ELSE 0.0 END) < 0.2 THEN 'low' ELSE 'watch' END
           AS margin_band
  FROM sku)"""

_MARGINS_NET = """
sku AS (
  SELECT product_id, arg_max(product_name, sale_day) AS product_name, CAST(sum(net_sales) AS DOUBLE) AS revenue,
         CAST(sum(gross_profit) AS DOUBLE) AS gross_profit
  FROM ntx GROUP BY product_id),
margins AS (
  SELECT *, CASE WHEN revenue > 0 THEN gross_profit / revenue ELSE 0.0 END AS margin_pct,
         CASE WHEN (CASE WHEN revenue > 0 THEN gross_profit / revenue ELSE 0.0 END) < 0.2 THEN 'low' ELSE 'watch' END
           AS margin_band
  FROM sku)"""


def _rates(source: str, keys: str) -> str:
    name = "product_name" if "product_name" in keys else "arg_max(product_name, sale_day) AS product_name"
    cogs = "cogs" if "cogs" in keys else "max(cogs) AS cogs"
    rest = [k for k in keys.split(", ") if k not in ("product_name", "cogs")]
    return f"""
rates AS (
  SELECT {', '.join(rest)}, {name}, {cogs}, CAST(sum(quantity) AS DOUBLE) AS qty,
         CAST(coalesce(sum(gross_profit), 0) AS DOUBLE) AS gross_profit, (SELECT n_days FROM cover) AS n_days,
         CAST(sum(quantity) AS DOUBLE) / (SELECT n_days FROM cover) AS qty_per_day,
         CAST(coalesce(sum(gross_profit), 0) AS DOUBLE) / (SELECT n_days FROM cover) AS gp_per_day
  FROM {source} WHERE cogs IS NOT NULL GROUP BY {keys})"""


_RATES = _rates("ptx", "product_id, product_name, cogs")
_RATES_NET = _rates("ntx", "product_id")
_RATES_STORE = _rates("ptx", "store, product_id, product_name, cogs")


def _walk(budget: float | str, order: str, by_store: bool = False) -> str:
    """The plan by definition: one product after the other in rank order, carrying the money left."""
    part = "PARTITION BY store " if by_store else ""
    store, tie = ("store, ", " AND r.store = w.store") if by_store else ("", "")
    return f"""
ranked AS (
  SELECT *, row_number() OVER ({part}ORDER BY {order}) AS rn, CAST(cogs * 10000 AS BIGINT) AS cost,
         CAST(greatest(1, ceil(qty_per_day * 5)) AS BIGINT) AS needed
  FROM rates WHERE cogs > 0),
walk AS (
  SELECT {store}CAST(0 AS BIGINT) AS rn, CAST({budget} AS BIGINT) * 10000 AS money, CAST(0 AS BIGINT) AS units
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT {store.replace('store', 'r.store')}r.rn, w.money - least(r.needed, w.money // r.cost) * r.cost,
         least(r.needed, w.money // r.cost)
  FROM walk w JOIN ranked r ON r.rn = w.rn + 1{tie}),
bought AS (
  SELECT r.*, w.units FROM walk w JOIN ranked r ON r.rn = w.rn{tie} WHERE w.units > 0)"""


_BEST = "gp_per_day DESC, qty_per_day DESC, product_id"

_SLOW = """
skuqty AS (
  SELECT product_id, product_name, CAST(sum(quantity) AS DOUBLE) AS qty, (SELECT n_days FROM cover) AS n_days,
         CAST(sum(quantity) AS DOUBLE) / (SELECT n_days FROM cover) AS qty_per_day
  FROM tx GROUP BY product_id, product_name),
slow AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (ORDER BY qty_per_day, product_id, product_name) AS rn FROM skuqty)
  WHERE rn <= greatest(1, CAST(floor(0.2 * (SELECT count(*) FROM skuqty)) AS BIGINT)))"""

_CLEAR = """
price AS (SELECT product_id, median(CAST(unit_price AS DOUBLE)) AS price FROM tx GROUP BY product_id),
clear0 AS (
  SELECT slow.product_id, product_name, qty, qty_per_day, price, CAST(0.2 AS DOUBLE) AS discount_rate,
         CAST(1.5 AS DOUBLE) AS assumed_lift,
         CAST(round_even(qty_per_day * 7 * (CAST(1.5 AS DOUBLE) - 1), 0) AS DOUBLE)
           AS extra_units,
         CAST(round_even(price * (1 - CAST(0.2 AS DOUBLE)), 2) AS DOUBLE) AS discounted_price
  FROM slow LEFT JOIN price ON price.product_id = slow.product_id),
clear AS (
  SELECT *, CAST(round_even(extra_units * discounted_price, 2) AS DOUBLE) AS extra_cash_inflow
  FROM clear0)"""


def _plan(rounding: str, uplift: str, extra: str = "") -> str:
    return f"""{extra}product_id, product_name, CAST({rounding}(cogs, 2) AS DOUBLE) AS unit_cogs, units AS suggested_qty,
  CAST({rounding}(cogs * units, 2) AS DOUBLE) AS budget_spend,
  CAST({rounding}(units * (gross_profit / greatest(1.0, qty)), 2) AS DOUBLE) AS {uplift}"""


_SNAPSHOT_P = """SELECT
  min(sale_day) AS first_day, max(sale_day) AS last_day, count(DISTINCT transaction_id) AS transactions,
  CAST(sum(quantity) AS BIGINT) AS items_sold, CAST(sum(gross_sales) AS DOUBLE) AS gross_sales,
  CAST(sum(discount) AS DOUBLE) AS discounts, CAST(sum(tax) AS DOUBLE) AS tax, CAST(sum(tip_amount) AS DOUBLE) AS tips,
  CAST(sum(CASE WHEN payment_type = 'CARD' THEN line_total END) AS DOUBLE) AS card_sales,
  CAST(sum(CASE WHEN payment_type = 'CASH' THEN line_total END) AS DOUBLE) AS cash_sales,
  (SELECT CAST(sum(processor_fees) AS DOUBLE) FROM po) AS processor_fees,
  (SELECT CAST(sum(refund_amount) AS DOUBLE) FROM rf) AS refunds,
  (SELECT CAST(sum(net_payout_amount) AS DOUBLE) FROM po) AS net_payouts FROM """

_SNAPSHOT_NET = """SELECT
  count(DISTINCT transaction_id) AS transactions, CAST(sum(quantity) AS DOUBLE) AS items_sold,
  CAST(sum(gross_sales) AS DOUBLE) AS gross_sales, CAST(sum(discount) AS DOUBLE) AS discounts,
  CAST(sum(CASE WHEN payment_type = 'CARD' THEN net_sales END) AS DOUBLE) AS card_sales,
  CAST(sum(CASE WHEN payment_type = 'CASH' THEN net_sales END) AS DOUBLE) AS cash_sales,
  (SELECT CAST(sum(processor_fees) AS DOUBLE) FROM po) AS processor_fees,
  (SELECT CAST(sum(refund_amount) AS DOUBLE) FROM rf) AS refunds FROM tx"""

_MONEY = ["unit_price", "gross_sales", "discount", "net_sales", "tax", "line_total", "tip_amount"]
_AS_DOUBLE = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ["quantity", *_MONEY])

_LINES = """
SELECT 'transactions' AS part, CAST(transaction_id AS VARCHAR) AS key, CAST(sale_day AS DATE) AS day,
       CAST(line_total AS DOUBLE) AS amount FROM tx
UNION ALL SELECT 'refunds', CAST(original_transaction_id AS VARCHAR), CAST(refund_date AS DATE), CAST(refund_amount AS DOUBLE) FROM rf
UNION ALL SELECT 'payouts', CAST(CAST(sale_day AS DATE) AS VARCHAR), CAST(sale_day AS DATE) + 2,
                 CAST(net_payout_amount AS DOUBLE) FROM po
UNION ALL SELECT 'products', CAST(product_id AS VARCHAR), NULL, CAST(cogs AS DOUBLE) FROM pm"""


ORACLE: dict[str, str] = {
    "processed_transactions": _with(_TX, _PM, _PROCESSED)
    + f" SELECT transaction_id, sale_day, product_id, product_name, category, payment_type, {_AS_DOUBLE}, "
    "CAST(cogs AS DOUBLE) AS cogs, CAST(unit_margin AS DOUBLE) AS unit_margin, "
    "CAST(gross_profit AS DOUBLE) AS gross_profit FROM ptx",
    "processed_transactions_relisted": _with(_TX, _PM2, _PROCESSED2)
    + " SELECT transaction_id, product_id, CAST(quantity AS DOUBLE) AS quantity, "
    "CAST(unit_price AS DOUBLE) AS unit_price, CAST(discount AS DOUBLE) AS discount, CAST(cogs AS DOUBLE) AS cogs, "
    "CAST(unit_margin AS DOUBLE) AS unit_margin, CAST(gross_profit AS DOUBLE) AS gross_profit FROM ptx",
    "gross_profit_net": _with(_TX, _PM2, _NET)
    + " SELECT transaction_id, product_id, CAST(quantity AS DOUBLE) AS quantity, CAST(net_sales AS DOUBLE) AS net_sales, "
    "CAST(cogs AS DOUBLE) AS cogs, CAST(gross_profit AS DOUBLE) AS gross_profit FROM ntx",
    "period_filter": _with(_TX)
    + " SELECT transaction_id, sale_day, product_id, CAST(net_sales AS DOUBLE) AS net_sales FROM tx "
    "WHERE sale_day BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'",
    "date_coverage": _with(_TX, _DAYS) + " SELECT * FROM cover",
    "executive_snapshot": _with(_TX, _RF, _PO) + _SNAPSHOT_P + "tx",
    "executive_snapshot_relisted": _with(_TX, _RF, _PO, _PM2, _PROCESSED2) + _SNAPSHOT_P + "ptx",
    "executive_snapshot_net": _with(_TX, _RF, _PO) + _SNAPSHOT_NET,
    "sales_by_payment_type": _with(_TX)
    + " SELECT payment_type, CAST(sum(line_total) AS DOUBLE) AS line_total, CAST(sum(net_sales) AS DOUBLE) AS net_sales "
    "FROM tx WHERE payment_type IN ('CARD', 'CASH') GROUP BY payment_type",
    "business_summary": _with(_TX, _RF)
    + " SELECT count(*) AS total_transactions, CAST(sum(line_total) AS DOUBLE) AS total_revenue, "
    "(SELECT CAST(sum(refund_amount) AS DOUBLE) FROM rf) AS total_refunds FROM tx",
    "cash_eaters": _with(_TX, _RF, _PO, _LEAKS, _LEAK_TOTAL)
    + " SELECT category, amount, amount / everything * 100 AS percentage FROM leak, leaktotal",
    "cash_eaters_wide": _with(_TX, _RF, _PO, _LEAKS)
    + " SELECT sum(amount) FILTER (category = 'Discounts') AS discounts, "
    "sum(amount) FILTER (category = 'Refunds') AS refunds, "
    "sum(amount) FILTER (category = 'Processor fees') AS processor_fees FROM leak",
    "product_margins": _with(_TX, _PM, _PROCESSED, _MARGINS) + " SELECT * FROM margins",
    "low_margin_products": _with(_TX, _PM, _PROCESSED, _MARGINS)
    + " SELECT * FROM margins ORDER BY margin_pct, revenue, product_id LIMIT 5",
    "low_margin_positive": _with(_TX, _PM2, _NET, _MARGINS_NET)
    + " SELECT * FROM margins WHERE revenue > 0 ORDER BY margin_pct, product_id LIMIT 5",
    "low_margin_given": _with(_TX, _PM2.replace("FROM pm2 GROUP", "FROM pm2 WHERE load_no = 1 GROUP"), _NET, _MARGINS_NET)
    + " SELECT * FROM margins ORDER BY margin_pct, revenue, product_id LIMIT 5",
    "sku_velocity": _with(_TX, _PM, _PROCESSED, _DAYS, _RATES)
    + " SELECT * REPLACE (CAST(cogs AS DOUBLE) AS cogs) FROM rates",
    "sku_velocity_net": _with(_TX, _PM2, _NET, _DAYS, _RATES_NET)
    + " SELECT * REPLACE (CAST(cogs AS DOUBLE) AS cogs) FROM rates",
    "median_price": _with(_TX)
    + " SELECT product_id, median(CAST(unit_price AS DOUBLE)) AS price FROM tx GROUP BY product_id",
    "slow_movers": _with(_TX, _DAYS, _SLOW) + " SELECT * FROM slow",
    "free_up_cash": _with(_TX, _DAYS, _SLOW, _CLEAR) + " SELECT * FROM clear",
    "free_up_total": _with(_TX, _DAYS, _SLOW, _CLEAR)
    + " SELECT count(*) AS n_products, CAST(sum(CAST(extra_cash_inflow AS DECIMAL(28,2))) AS DOUBLE) "
    "AS total_extra_cash FROM clear",
    "reorder_plan": _with(_TX, _PM, _PROCESSED, _DAYS, _RATES, _walk(500000, _BEST))
    + f" SELECT {_plan('round_even', 'est_gp_uplift_week')} FROM bought",
    "reorder_plan_net": _with(_TX, _PM2, _NET, _DAYS, _RATES_NET, _walk(500000, "gp_per_day DESC, product_id"))
    + f" SELECT * EXCLUDE (unit_cogs) FROM (SELECT {_plan('round', 'est_weekly_profit')} FROM bought)",
    "reorder_summary": _with(_TX, _PM, _PROCESSED, _DAYS, _RATES, _walk(500000, _BEST))
    + " SELECT CAST(500000 AS DOUBLE) AS budget, CAST(coalesce(sum(cogs * units), 0) AS DOUBLE) AS spent, "
    "CAST(500000 - coalesce(sum(cogs * units), 0) AS DOUBLE) AS remaining, count(*) AS n_items FROM bought",
    "reorder_plan_by_nation": _with(_TX, _PM, _PROCESSED, _DAYS, _RATES_STORE, _walk(50000, _BEST, by_store=True))
    + f" SELECT {_plan('round_even', 'est_gp_uplift_week', 'store, ')} FROM bought",
    "reorder_summary_by_nation": _with(_TX, _PM, _PROCESSED, _DAYS, _RATES_STORE, _walk(50000, _BEST, by_store=True))
    + " SELECT store, CAST(50000 AS DOUBLE) AS budget, CAST(sum(cogs * units) AS DOUBLE) AS spent, "
    "CAST(50000 - sum(cogs * units) AS DOUBLE) AS remaining, count(*) AS n_items FROM bought GROUP BY store",
    "analysis_cash_eaters": _with(_TX, _RF, _PO, _LEAKS) + " SELECT category, amount FROM leak",
    "analysis_snapshot_only": _with(_TX, _RF, _PO) + _SNAPSHOT_NET,
    "csv_ingest": _with(_TX)
    + " SELECT sale_day, CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(product_id AS VARCHAR) AS product_id, "
    "product_name, category, CASE WHEN product_id % 89 <> 0 THEN CAST(quantity AS DOUBLE) END AS quantity, "
    "CAST(unit_price AS DOUBLE) AS unit_price, CAST(gross_sales AS DOUBLE) AS gross_sales, "
    "CAST(discount AS DOUBLE) AS discount, CAST(net_sales AS DOUBLE) AS net_sales, CAST(tax AS DOUBLE) AS tax, "
    "CAST(line_total AS DOUBLE) AS line_total, payment_type, CAST(tip_amount AS DOUBLE) AS tip_amount FROM tx",
    "csv_roundtrip": _with(_TX, _RF, _PO, _PM) + _LINES,
    "session_roundtrip": _with(_TX, _RF, _PO, _PM)
    + f" SELECT *, '001' AS session FROM ({_LINES}) UNION ALL SELECT *, '002' FROM ({_LINES}) WHERE part = 'products'",
    "dataset_status": _with(_TX, _RF, _PO)
    + " SELECT 'transactions' AS dataset, true AS loaded, count(*) AS n_rows FROM tx "
    "UNION ALL SELECT 'refunds', true, count(*) FROM rf UNION ALL SELECT 'payouts', true, count(*) FROM po "
    "UNION ALL SELECT 'products', false, 0",
    "schema_report": _with(_TX, _RF, _PO, _PM)
    + " SELECT 'transactions' AS file, count(*) AS n_rows, 'Missing required columns: discount, tax' AS errors FROM tx "
    "UNION ALL SELECT 'refunds', count(*), '' FROM rf UNION ALL SELECT 'payouts', count(*), '' FROM po "
    "UNION ALL SELECT 'products', count(*), '' FROM pm",
}

_MARKED = """
src AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, '. '), lambda s, n: CASE (n - 1) % 6
    WHEN 0 THEN CAST((n - 1) // 6 + 1 AS VARCHAR) || '. **Point ' || CAST(n - 1 AS VARCHAR) || '** ' || s
    WHEN 1 THEN '- ' || s WHEN 2 THEN '- **Key**: ' || s WHEN 3 THEN s WHEN 4 THEN 'Note: ' || s ELSE chr(10) || s END), chr(10))
    AS text
  FROM documents)"""
_TURNS = """
src AS (SELECT conv_id, turn, text FROM conversations)"""


def _strip(text: str) -> str:
    return f"trim({text}, '{WHITE_SPACE}')"


def _sections(source: str, keys: str, separator: str = "chr(10)") -> str:
    bold = "strpos(c, '**:') > 0"
    before = _strip("substr(c, 1, strpos(c, ':') - 1)")
    plain = f"strpos(c, ':') > 0 AND length({before}) < 80 AND NOT contains({before}, '.')"
    bold_header = _strip("substr(c, strpos(c, '**') + 2, greatest(strpos(c, '**:') - strpos(c, '**') - 2, 0))")
    return _with(
        source,
        f"""
part AS (
  SELECT {keys}, {_strip('p')} AS p, i FROM (
    SELECT {keys}, unnest(string_split(text, {separator})) AS p, generate_subscripts(string_split(text, {separator}), 1) AS i
    FROM src)),
sect AS (
  SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY i) AS INTEGER) AS section_no, p,
         CASE WHEN regexp_matches(p, '^[1-5]\\.') THEN 'numbered'
              WHEN regexp_matches(p, '^[-•*]') AND NOT starts_with(p, '**') THEN 'bullet' ELSE 'plain' END AS kind
  FROM part WHERE p <> ''),
body AS (
  SELECT *, CASE kind WHEN 'numbered' THEN {_strip('substr(p, 3)')} WHEN 'bullet' THEN {_strip('substr(p, 2)')}
                      ELSE p END AS c FROM sect)""",
    ) + f"""
SELECT {keys}, section_no, kind, CASE WHEN kind = 'numbered' THEN CAST(substr(p, 1, 1) AS INTEGER) END AS number,
  CASE WHEN {bold} THEN {bold_header} WHEN {plain} THEN replace({before}, '**', '') END AS header,
  CASE WHEN {bold} THEN {_strip("substr(c, strpos(c, '**:') + 3)")}
       WHEN {plain} THEN {_strip("substr(c, strpos(c, ':') + 1)")} ELSE replace(c, '**', '') END AS body
FROM body"""


def _outline(source: str, keys: str) -> str:
    heading = r"(?s)^\d+\.\s+\*\*(.+?)\*\*(.*)$"
    unbold = r"regexp_replace({}, '\*\*(.+?)\*\*', '\1', 'gs')"
    return _with(
        source,
        f"""
line AS (
  SELECT {keys}, i, {_strip('l')} AS l FROM (
    SELECT {keys}, unnest(string_split({_strip('text')}, chr(10))) AS l,
           generate_subscripts(string_split({_strip('text')}, chr(10)), 1) AS i FROM src)),
kinds AS (
  SELECT *, CASE WHEN l = '' THEN 'blank' WHEN regexp_matches(l, '{heading}') THEN 'heading'
                 WHEN starts_with(l, '-') THEN 'bullet' ELSE 'text' END AS k FROM line),
item AS (
  SELECT {keys}, 2 * i AS i, k, CASE k WHEN 'heading' THEN {_strip(f"regexp_extract(l, '{heading}', 1)")}
    WHEN 'bullet' THEN {_strip(unbold.format('substr(l, 2)'))} WHEN 'text' THEN {unbold.format('l')} ELSE '' END AS c
  FROM kinds
  UNION ALL
  SELECT {keys}, 2 * i + 1, 'text', {_strip(f"regexp_extract(l, '{heading}', 2)")} FROM kinds
  WHERE k = 'heading'),
grouped AS (
  SELECT *, count(*) FILTER (k <> 'text') OVER (PARTITION BY {keys} ORDER BY i) AS g FROM item),
block AS (
  SELECT {keys}, i, k, c FROM grouped WHERE k <> 'text'
  UNION ALL
  SELECT {keys}, min(i), 'paragraph', {_strip("string_agg(c, ' ' ORDER BY i)")} AS c
  FROM grouped WHERE k = 'text' GROUP BY {keys}, g HAVING c <> ''),
seen AS (SELECT *, lag(k) OVER (PARTITION BY {keys} ORDER BY i) AS previous FROM block)""",
    ) + f"""
SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY i) AS INTEGER) AS block_no, k AS kind,
  c AS content, k = 'bullet' AND previous IS DISTINCT FROM 'bullet' AS starts_list
FROM seen WHERE k <> 'blank'"""


_HALF = "BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'"

ORACLE |= {
    "snapshot_from_states": ORACLE["executive_snapshot"],
    "snapshot_of_half_a_year": _with(_TX, _RF, _PO)
    + _SNAPSHOT_P.replace("FROM po)", f"FROM po WHERE sale_day {_HALF})").replace("FROM rf)", f"FROM rf WHERE refund_date {_HALF})")
    + f"tx WHERE sale_day {_HALF}",
    "text_sections": _sections(_MARKED, "doc_id"),
    "text_sections_paragraphs": _sections(_MARKED, "doc_id", "chr(10) || chr(10)"),
    "text_sections_turns": _sections(_TURNS, "conv_id, turn"),
    "text_outline": _outline(_MARKED, "doc_id"),
    "text_outline_turns": _outline(_TURNS, "conv_id, turn"),
    "insight_payload_read": _with(_TX, _RF, _PO, _LEAKS, _LEAK_TOTAL, _PM, _PROCESSED, _MARGINS)
    + """ SELECT 'cash_eaters' AS section, category AS label, amount, amount / everything * 100 AS ratio
FROM leak, leaktotal
UNION ALL
SELECT 'low_margin_products', CAST(product_id AS VARCHAR), revenue, margin_pct
FROM (SELECT * FROM margins ORDER BY margin_pct, revenue, product_id LIMIT 5)""",
    "reorder_payload": _with(_TX, _PM, _PROCESSED, _DAYS, _RATES, _walk(500000, _BEST))
    + f""" SELECT 'budget' AS section, CAST(to_json(s) AS VARCHAR) AS payload FROM (
  SELECT CAST(500000 AS DOUBLE) AS budget, CAST(coalesce(sum(cogs * units), 0) AS DOUBLE) AS spent,
         CAST(500000 - coalesce(sum(cogs * units), 0) AS DOUBLE) AS remaining, count(*) AS n_items FROM bought) s
UNION ALL
SELECT 'purchase', CAST(to_json(s) AS VARCHAR) FROM (SELECT {_plan('round_even', 'est_gp_uplift_week')} FROM bought) s""",
    "snapshot_lines": _with(_TX, _RF, _PO, "snap AS (" + _SNAPSHOT_P + "tx)")
    + " SELECT line_no, label, value FROM ("
    + " UNION ALL ".join(
        [
            "SELECT 0 AS line_no, 'Business Snapshot' AS label, "
            "CAST(first_day AS VARCHAR) || ' → ' || CAST(last_day AS VARCHAR) AS value FROM snap"
        ]
        + [
            f"SELECT {n}, '{label}', "
            + (f"CAST({c} AS VARCHAR)" if n < 3 else f"'€' || format('{{:,.2f}}', round_even({c}, 2))")
            + " FROM snap"
            for n, (label, c) in enumerate(SNAPSHOT_LINES.items(), 1)
        ]
    )
    + ")",
    "leak_lines": _with(_TX, _RF, _PO, _LEAKS, _LEAK_TOTAL)
    + " SELECT category, '€' || format('{:.2f}', amount) AS amount, "
    "format('{:.1f}', amount / everything * 100) || '%' AS share FROM leak, leaktotal",
    "clearance_message": _with(_TX, _DAYS, _SLOW, _CLEAR)
    + " SELECT 'Estimated extra cash this week from clearance: €' || format('{:.2f}', "
    "CAST(sum(CAST(extra_cash_inflow AS DECIMAL(28,2))) AS DOUBLE)) AS message FROM clear",
    "reorder_message": _with(_TX, _PM, _PROCESSED, _DAYS, _RATES, _walk(500000, _BEST))
    + " SELECT 'Budget: €500000 → Remaining: €' || format('{:.2f}', "
    "CAST(500000 - coalesce(sum(cogs * units), 0) AS DOUBLE)) AS message FROM bought",
}

# What is lost of a line: values that do not fit; a line that ends after five fields has no others to lose.
_LOSSES = """
lost AS (
  SELECT product_id, list_filter([
      CASE WHEN product_id % 73 = 0 THEN 'sale_day: became NULL' END,
      CASE WHEN product_id % 89 = 0 AND product_id % 71 <> 0 THEN 'quantity: became NULL' END,
      CASE WHEN product_id % 83 = 0 AND product_id % 71 <> 0 THEN 'line_total: became NULL' END,
      CASE WHEN product_id % 79 = 0 AND product_id % 71 <> 0 THEN 'tip_amount: lost digits' END,
      CASE WHEN product_id % 71 = 0 OR product_id % 67 = 0 THEN 'malformed line' END], lambda x: x IS NOT NULL) AS problems
  FROM tx)"""

_HALF = "BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'"

ORACLE |= {
    "snapshot_from_states": ORACLE["executive_snapshot"],
    "snapshot_of_half_a_year": _with(_TX, _RF, _PO)
    + _SNAPSHOT_P.replace("FROM po)", f"FROM po WHERE sale_day {_HALF})").replace("FROM rf)", f"FROM rf WHERE refund_date {_HALF})")
    + f"tx WHERE sale_day {_HALF}",
    "processed_transactions_unknown_cost": _with(_TX, _PM_GAPS, _PROCESSED)
    + " SELECT transaction_id, product_id, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price, "
    "CAST(discount AS DOUBLE) AS discount, CAST(cogs AS DOUBLE) AS cogs, CAST(unit_margin AS DOUBLE) AS unit_margin, "
    "CAST(gross_profit AS DOUBLE) AS gross_profit FROM ptx",
    "reorder_plan_unknown_cost": _with(_TX, _PM_GAPS, _PROCESSED, _DAYS, _RATES, _walk(500000, _BEST))
    + f" SELECT {_plan('round_even', 'est_gp_uplift_week')} FROM bought",
    "reorder_plan_default_budget": _with(
        _TX, _PM.replace("AS DECIMAL(18,2)) AS cogs", "AS DECIMAL(18,4)) / 100 AS DECIMAL(18,4)) AS cogs").replace(
            "CAST(p_retailprice", "CAST(CAST(p_retailprice"), _PROCESSED, _DAYS, _RATES, _walk(500, _BEST)
    )
    + f" SELECT {_plan('round_even', 'est_gp_uplift_week')} FROM bought",
    "reorder_summary_own_budgets": _with(
        _TX, _PM, _PROCESSED, _DAYS, _RATES_STORE,
        _walk("(SELECT n_nationkey * 2000 FROM nation WHERE n_name = store)", _BEST, by_store=True),
    )
    + " SELECT n_name AS store, CAST(n_nationkey * 2000 AS DOUBLE) AS budget, "
    "CAST(coalesce(sum(cogs * units), 0) AS DOUBLE) AS spent, "
    "CAST(n_nationkey * 2000 - coalesce(sum(cogs * units), 0) AS DOUBLE) AS remaining, count(product_id) AS n_items "
    "FROM nation LEFT JOIN bought ON store = n_name GROUP BY n_name, n_nationkey",
    "gross_profit_last_load": f"SELECT * REPLACE (CAST(product_id AS VARCHAR) AS product_id) FROM ({ORACLE['gross_profit_net']})",
    "sales_with_listed_cost": _with(_TX, _PM)
    + " SELECT transaction_id, tx.product_id, CAST(quantity AS DOUBLE) AS quantity, CAST(net_sales AS DOUBLE) AS net_sales, "
    "CAST(cogs AS DOUBLE) AS cogs FROM tx LEFT JOIN pm ON pm.product_id = tx.product_id",
    "analysis_low_margin": ORACLE["low_margin_products"],
    "analysis_cash_eaters_web": ORACLE["cash_eaters"],
    "analysis_reorder": ORACLE["reorder_plan"],
    "analysis_reorder_web": _with(
        _TX, _PM2.replace("FROM pm2 GROUP", "FROM pm2 WHERE load_no = 1 GROUP"), _NET, _DAYS, _RATES_NET,
        _walk(500000, "gp_per_day DESC, product_id"),
    )
    + " SELECT CAST(500000 AS DOUBLE) AS budget, CAST(coalesce(sum(cogs * units), 0) AS DOUBLE) AS spent, "
    "CAST(500000 - coalesce(sum(cogs * units), 0) AS DOUBLE) AS remaining, count(*) AS n_items FROM bought",
    "analysis_free_cash": ORACLE["free_up_total"],
    "current_snapshot": ORACLE["executive_snapshot"],
    "snapshot_of_sales_only": "SELECT * REPLACE (0.0::DOUBLE AS processor_fees, 0.0::DOUBLE AS refunds, "
    f"0.0::DOUBLE AS net_payouts) FROM ({ORACLE['executive_snapshot']})",
    "snapshot_payload_read": "SELECT * REPLACE (CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day) "
    f"FROM ({ORACLE['executive_snapshot']})",
    "load_losses": _with(_TX, _LOSSES)
    + " SELECT 'transactions' AS file, CASE WHEN contains(p, ': ') THEN split_part(p, ': ', 1) ELSE '' END AS field, "
    "CASE WHEN contains(p, ': ') THEN split_part(p, ': ', 2) ELSE p END AS problem, count(*) AS n_rows "
    "FROM (SELECT unnest(problems) AS p FROM lost) GROUP BY p",
    "load_rejects": _with(_TX, _LOSSES)
    + " SELECT CAST(product_id AS VARCHAR) AS product_id, array_to_string(problems, '; ') AS problems, count(*) AS n_rows "
    "FROM lost WHERE len(problems) > 0 GROUP BY ALL",
    "session_status": _with(_TX, _RF)
    + " SELECT 'transactions' AS dataset, true AS loaded, count(*) AS n_rows FROM tx "
    "UNION ALL SELECT 'refunds', true, count(*) FROM rf UNION ALL SELECT 'payouts', false, 0 UNION ALL SELECT 'products', false, 0",
    "session_coverage": ORACLE["date_coverage"],
    "schema_report_web": _with(_TX, _RF, _PO, _PM)
    + """ SELECT 'transactions' AS file, count(*) AS n_rows, 'Missing required columns: day, cogs, gross_profit' AS errors,
  'date; transaction_id; product_id; product_name; category; quantity; unit_price; gross_sales; discount; net_sales; tax; '
  || 'line_total; payment_type; tip_amount' AS available FROM tx
UNION ALL SELECT 'refunds', 0, 'File is empty', 'original_transaction_id; refund_date; refund_amount'
UNION ALL SELECT 'payouts', count(*), 'Missing required columns: net_payout',
  'covering_sales_date; gross_card_volume; processor_fees; net_payout_amount; payout_date' FROM po
UNION ALL SELECT 'products', count(*), '', '' FROM pm""",
    "period_from_months": ORACLE["period_filter"],
    "years_compared": _with(_TX)
    + " SELECT CAST(year(sale_day) AS VARCHAR) AS period, count(*) AS n_rows, CAST(sum(quantity) AS DOUBLE) AS quantity, "
    "CAST(sum(net_sales) AS DOUBLE) AS net_sales FROM tx WHERE month(sale_day) <= 3 GROUP BY year(sale_day)",
}
