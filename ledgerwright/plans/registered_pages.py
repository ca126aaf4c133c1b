"""Registered queries of page text, page structure, record assembly, files and streams, each with DuckDB SQL of its own making.

Pages are built from the test tables, so that the SQL can state the true values from the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import returns as R, schema, text as X
from ..functions.arrays import normalize_order_items
from ..operators import merge, pages, rows as B
from ..sources import html, io, ledger_store
from ..sources.shared import fresh_folder
from ..streaming import ledger as streaming
from . import registered
from .adapters import spark_view
from .oracle import NOW, chain

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""
    def put(f):
        SPARK[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return put


def spread(df: DataFrame) -> DataFrame:
    """A table of one small file is one task; before heavy work on its rows it is dealt to all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


# --- text ---------------------------------------------------------------------------------------------------------------


def _captures(s, d) -> DataFrame:
    return spread(spark_view(s, d, "v_page_text").withColumn("title", F.lit("")))


@query(chain("""
SELECT page_id, true_order_id AS order_id, true_cents AS purchase_cents, CASE WHEN page_id % 5 = 0 THEN 1250 END AS canonical_refund_cents, true_card AS card_last4,
  CASE WHEN page_id % 2 = 0 THEN 'June' ELSE 'Sep' END || printf(' %d, 2026', page_id % 28 + 1) AS order_date_text FROM v_page_text"""))
def extract_money(s, d):
    facts = pages.order_facts(_captures(s, d))
    return facts.select("page_id", "order_id", "purchase_cents", F.col("canonical_refund_cents").cast("int").alias("canonical_refund_cents"), "card_last4", "order_date_text")


@query(chain("SELECT page_id, true_card AS card_last4 FROM v_page_text"))
def card_last4(s, d):
    out, p = X.with_page(_captures(s, d))
    return out.select("page_id", X.card_last4(p).alias("card_last4"))


@query(chain("SELECT page_id, 'Payment method|Visa ending in ' || true_card || '|' || split_part(text, chr(10), 6) || '|' || split_part(text, chr(10), 7) AS payment_lines FROM v_page_text"))
def payment_evidence(s, d):
    return pages.order_facts(_captures(s, d)).select("page_id", F.array_join("payment_lines", "|").alias("payment_lines"))


@query(chain("SELECT page_id, true_order_id AS order_id FROM v_page_text"))
def extract_order_ids(s, d):
    return _captures(s, d).select("page_id", F.explode(X.order_ids(F.col("text"))).alias("order_id"))


@query(chain("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'shipped' WHEN 1 THEN 'received' WHEN 2 THEN 'refund_issued' WHEN 3 THEN 'credited' WHEN 4 THEN 'started' ELSE 'unknown' END AS stage,
  page_id % 6 IN (1, 2, 3) AS received_done, CASE WHEN page_id % 11 = 0 AND page_id % 6 IN (1, 2, 3) THEN printf('Aug %d', page_id % 28 + 1) END AS received_date,
  CASE WHEN page_id % 11 = 1 AND page_id % 6 <> 3 THEN printf('Oct %d, 2026', page_id % 28 + 1) END AS expected_credit_date,
  CASE page_id % 6 WHEN 0 THEN 'return_in_progress' WHEN 1 THEN 'returned_pending_refund' WHEN 2 THEN 'refunded' WHEN 3 THEN 'refunded' WHEN 4 THEN 'return_in_progress' ELSE 'unknown' END AS status,
  CASE page_id % 6 WHEN 0 THEN 'Your return was dropped off' WHEN 1 THEN 'We have received your return' WHEN 2 THEN 'Your refund has been issued'
    WHEN 3 THEN 'Your refund was credited to your card' WHEN 4 THEN 'Please drop off your return by Friday' ELSE 'Delivered Monday' END AS status_text,
  page_id % 6 <> 5 AS strong FROM v_page_text"""))
def milestones(s, d):
    f = pages.return_facts(_captures(s, d))
    return f.select("page_id", "stage", F.col("m.received.done").alias("received_done"), F.col("m.received.date").alias("received_date"), "expected_credit_date", "status", "status_text", "strong")


@query(chain("""
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'ordered' WHEN 1 THEN 'delivered' WHEN 2 THEN 'requested' END AS stage,
  CASE page_id % 7 WHEN 0 THEN 'Replacement ordered' WHEN 1 THEN 'Your replacement has been delivered' WHEN 2 THEN 'Replacement arriving Tuesday' END AS status_text FROM v_page_text"""))
def replacement_evidence(s, d):
    out, p = X.with_page(_captures(s, d))
    return out.withColumn("r", X.replacement(p)).select("page_id", F.col("r.stage").alias("stage"), F.col("r.status_text").alias("status_text"))


# ten pages speak of one item each: the furthest stage wins, of equal ones the later page's words
@query(chain("""
SELECT item, CASE rank WHEN 4 THEN 'delivered' ELSE arg_max(stage, page_id) FILTER (rank = best) END AS replacement_stage, arg_max(words, page_id) FILTER (rank = best) AS replacement_text
FROM (SELECT *, max(rank) OVER (PARTITION BY item) AS best FROM (
  SELECT page_id, page_id // 10 AS item, CASE page_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 2 END AS rank, CASE page_id % 7 WHEN 0 THEN 'ordered' WHEN 1 THEN 'delivered' ELSE 'requested' END AS stage,
    CASE page_id % 7 WHEN 0 THEN 'Replacement ordered' WHEN 1 THEN 'Your replacement has been delivered' ELSE 'Replacement arriving Tuesday' END AS words
  FROM v_page_text WHERE page_id % 7 < 3) a) b WHERE rank = best GROUP BY item, rank"""))
def stronger_replacement(s, d):
    item = F.floor(F.col("page_id") / 10).cast("long")
    blocks = _captures(s, d).select("account_id", item.cast("string").alias("order_id"), F.lit("B").alias("asin"), "page_id", F.lit(1).alias("block_id"), "text")
    return pages.replacement_facts(blocks).select(F.col("order_id").cast("long").alias("item"), "replacement_stage", "replacement_text")


# a third of the pages are blocked, want a sign-in, or are throttled; the kinds of route vary
_GATES = """
  SELECT page_id, true_order_id, text, page_id % 9 AS g, page_id % 4 AS k FROM v_page_text"""


def _gated(s, d) -> DataFrame:
    c = _captures(s, d)
    g, k = F.col("page_id") % 9, F.col("page_id") % 4
    said = F.when(g == 0, "Enter the characters you see below").when(g == 1, "Sign in\nEnter your password").when(g == 2, "Too many requests").otherwise(F.col("text"))
    base = "https://shop.example.com"
    url = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit(f"{base}/spr/returns/prep?orderId="), F.col("true_order_id")))
        .when(k == 2, F.lit(f"{base}/your-orders/orders?startIndex=10")).otherwise(F.lit(f"{base}/somewhere")))
    return c.withColumns({"text": said, "url": url, "captured_at": F.col("captured_at").cast("timestamp")})


@query(chain("""
SELECT page_id, CASE g WHEN 0 THEN 'blocked' WHEN 1 THEN 'sign_in' WHEN 2 THEN 'rate_limited' ELSE 'ok' END AS gate,
  CASE k WHEN 0 THEN 'order_detail' WHEN 1 THEN 'return' WHEN 2 THEN 'order_history' ELSE 'order' END AS page_type,
  CASE k WHEN 0 THEN false WHEN 1 THEN g > 2 AND regexp_matches(text, '(?i)Initiated|Return request|Drop off|Dropped off|Return received|Refund issued|Refund credited|Replacement')
    WHEN 2 THEN g > 2 ELSE g > 2 AND length(text) >= 80 END AS ready,
  CASE WHEN g > 2 THEN sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)\\b\\d{3}-\\d{7}-\\d{7}\\b|return|refund|replacement|deliver|total|cancel|credit')), chr(10)))
    ELSE sha256('') END AS signature
FROM gates""", gates=_GATES))
def classify_pages(s, d):
    return pages.classify_pages(_gated(s, d)).select("page_id", "gate", "page_type", "ready", "signature")


# the detail route, its id, a date, a total and an item make an order's details complete
@query(chain("""
SELECT page_id, page_id % 4 <> 0 AND page_id % 3 <> 0 AND page_id % 5 <> 0 AS complete, page_id % 10 = 1 AS cancelled FROM v_page_text"""))
def detail_complete(s, d):
    k = F.col("page_id")
    words = F.when(k % 10 == 1, F.concat_ws("\n", F.concat(F.lit("Order "), F.col("true_order_id")), F.lit("Cancelled"), F.lit("Total $0.00"), F.lit("x"))).otherwise(F.col("text"))
    f, p = X.with_page(_captures(s, d).withColumn("text", words))
    url = F.when(k % 4 == 0, "https://shop.example.com/your-orders/orders").otherwise(F.col("url"))
    whole = X.detail_complete(url, F.col("true_order_id"), F.when(k % 3 != 0, "June 2"), F.when(k % 5 != 0, 100), F.lit(1))
    return f.select("page_id", whole.alias("complete"), X.terminal_cancelled(p, F.col("true_order_id"), F.lit(False)).alias("cancelled"))


# checkmarks: one bound to each step up to page_id % 6, hidden ones and ones bound to several steps beside them
@query(chain("""
SELECT page_id, CASE CASE WHEN t > 0 THEN least(greatest(t, c), t) ELSE c END WHEN 0 THEN 'unknown' WHEN 1 THEN 'started' WHEN 2 THEN 'shipped' WHEN 3 THEN 'received'
  WHEN 4 THEN 'refund_issued' ELSE 'credited' END AS stage
FROM (SELECT page_id, page_id % 6 AS c, CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END AS t FROM v_page_text) q"""))
def fuse_checkmarks(s, d):
    p = _captures(s, d).select("page_id", F.when(F.col("page_id") % 4 == 0, "shipped").otherwise("unknown").alias("text_stage"))
    steps = ["Initiated", "Dropped off", "Return received", "Refund issued", "Refund credited"]
    marks = F.array(*[F.struct(F.lit(k).alias("k"), F.array(F.lit(n)).alias("labels"), F.lit(False).alias("hidden")) for k, n in enumerate(steps)],
                    F.struct(F.lit(0).alias("k"), F.array(F.lit("Refund credited")).alias("labels"), F.lit(True).alias("hidden")),
                    F.struct(F.lit(0).alias("k"), F.array(F.lit("Refund credited"), F.lit("Initiated")).alias("labels"), F.lit(False).alias("hidden")))
    c = p.select("page_id", F.explode(marks).alias("m")).where("m.hidden OR size(m.labels) > 1 OR m.k < page_id % 6").select("page_id", F.col("m.k").alias("check_id"), "m.labels", "m.hidden")
    return pages.fuse_checkmarks(p, c).select("page_id", "stage")


@query(chain("SELECT record_id, 'return:' || order_id || ':' || lower(return_token) || ':' || asin AS made FROM v_returns"))
def record_id(s, d):
    none = F.lit(None).cast("string")
    made = X.record_id(F.lit("return"), F.col("order_id"), F.col("return_token"), none, F.array("asin"), F.array("item_name"), F.lit(False), F.col("refund_cents"))
    return spark_view(s, d, "v_returns").select("record_id", made.alias("made"))


@query(chain("""
SELECT record_id, CASE l_partkey % 4 WHEN 0 THEN 'it7' WHEN 1 THEN trim(regexp_replace(lower(coalesce(item_name, 'no name')), '[^a-z0-9]+', '-', 'g'), '-') WHEN 2 THEN 'pending' ELSE coalesce(CAST(refund_cents AS VARCHAR), 'unknown') END AS part FROM v_returns"""))
def record_id_parts(s, d):
    k = F.col("l_partkey") % 4
    names = F.when(k == 1, F.array(F.coalesce("item_name", F.lit("no name")))).otherwise(F.array().cast("array<string>"))
    made = X.record_id(F.lit("return"), F.lit("o"), F.lit("t"), F.when(k == 0, "it7"), F.array().cast("array<string>"), names, k == 2, F.col("refund_cents"))
    return spark_view(s, d, "v_returns").select("record_id", F.substring_index(made, ":", -1).alias("part"))


# --- URLs and dates -----------------------------------------------------------------------------------------------------


@query(r"""
SELECT page_id, CAST(coalesce(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), ''), '1') AS INTEGER) AS page, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN k <> '' THEN '?' || k ELSE '' END AS place
FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(ref|ref_|tag)(=|$)')), '&') AS k FROM pages) q""")
def location_key(s, d):
    p = s.read.parquet(f"{d}/pages.parquet")
    return pages.history_route(p).select("page_id", "page", X.location_key(F.col("url")).alias("place"))


@query(chain("SELECT o_orderkey, order_id AS url_order_id, printf('RMA-%07d', o_orderkey) AS return_token, printf('it%d', o_orderkey % 7) AS return_item_id FROM v_orders_once"))
def url_facts(s, d):
    base = F.lit("https://shop.example.com/returns/status?orderId=")
    url = F.concat(base, F.col("order_id"), F.lit("&rmaId="), F.format_string("RMA-%07d", F.col("o_orderkey")), F.lit("&itemId="), F.format_string("it%d", F.col("o_orderkey") % 7))
    return pages.url_facts(spark_view(s, d, "v_orders_once").withColumn("url", url)).select("o_orderkey", "url_order_id", "return_token", "return_item_id")


@query(chain("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(year(order_date) AS INTEGER) END AS year, CASE o_orderkey % 3 WHEN 2 THEN 1 ELSE CAST(o_orderkey % 30 + 1 AS INTEGER) END AS page,
  CASE o_orderkey % 3 WHEN 0 THEN 'hash' WHEN 1 THEN 'query' ELSE 'first' END AS mode FROM v_orders_once"""))
def history_route(s, d):
    k, base = F.col("o_orderkey"), "https://shop.example.com/your-orders/orders"
    year, n = F.year("order_date").cast("string"), k % 30
    url = (
        F.when(k % 3 == 0, F.concat(F.lit(f"{base}#time/"), year, F.lit("/pagination/"), (n + 1).cast("string")))
        .when(k % 3 == 1, F.concat(F.lit(f"{base}?timeFilter=year-"), year, F.lit("&startIndex="), (n * 10).cast("string"))).otherwise(F.lit(base)))
    return pages.history_route(spark_view(s, d, "v_orders_once").withColumn("url", url)).select("o_orderkey", "year", "page", "mode")


@query(chain("""
SELECT event_id, 'https://shop.example.com/x' || CASE WHEN event_id % 2 = 0 THEN '?orderId=' || event_id ELSE '' END AS url FROM v_event_log WHERE type = 'view' OR event_id % 2 = 0"""))
def sanitize_events(s, d):
    log = spark_view(s, d, "v_event_log")
    kind = F.when(F.col("type") == "view", "navigation").otherwise(F.col("type"))
    url = F.concat(F.lit("https://shop.example.com/x?secret=1"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("&orderId="), F.col("event_id").cast("string"))).otherwise(""), F.lit("#end"))
    return pages.sanitize_events(log.withColumns({"type": kind, "url": url})).select("event_id", "url")


@query(chain("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(make_date(2026, month(order_date), day(order_date)) AS TIMESTAMP) + INTERVAL '23:59:59' HOUR TO SECOND
  WHEN 1 THEN CAST(order_date AS TIMESTAMP) + INTERVAL '23:59:59' HOUR TO SECOND WHEN 2 THEN CAST(order_date AS TIMESTAMP) END AS at
FROM v_orders_once WHERE NOT (month(order_date) = 2 AND day(order_date) = 29)""").replace("INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND"))
def loose_dates(s, d):
    o = spark_view(s, d, "v_orders_once").where("NOT (month(order_date) = 2 AND day(order_date) = 29)")
    k = F.col("o_orderkey") % 4
    written = (
        F.when(k == 0, F.date_format("order_date", "MMM d")).when(k == 1, F.date_format("order_date", "MMMM d, yyyy")).when(k == 2, F.col("order_date").cast("string")).otherwise("some day"))
    return o.select("o_orderkey", R.parse_loose_date(written, 2026).alias("at"))


# --- raw HTML and structure -----------------------------------------------------------------------------------------------


def _raw(s, d) -> DataFrame:
    return spread(s.read.parquet(f"{d}/pages.parquet").select("page_id", "html"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_anchors FROM pages")
def page_anchors(s, d):
    raw = _raw(s, d)
    a = html.page_anchors(html.page_nodes(raw)).groupBy("page_id").agg(F.count("*").alias("n"))
    return raw.select("page_id").join(a, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_anchors"))


@query(r"""
SELECT page_id, tag, count(*) AS n_blocks FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<(script|style|noscript|template|title)\b.*?</(script|style|noscript|template|title)>', '', 'g'),
    '<(div|section|article|li|td|tr|table|ul|ol|p|main|nav|footer|aside|header|body|h1|h2|h3)\b', 1)) AS tag FROM pages) q GROUP BY page_id, tag""")
def page_blocks(s, d):
    return html.page_blocks(html.page_nodes(_raw(s, d))).groupBy("page_id", "tag").agg(F.count("*").alias("n_blocks"))


def _order_pages(s, d) -> DataFrame:
    """A page an order: a card with its items and return links, an advertisement by class and one by words."""
    o, i = spark_view(s, d, "v_orders_once"), spark_view(s, d, "v_items")
    number = F.substring("item_key", 2, 20).cast("int")
    line = F.concat(
        F.lit('<div class="item"><a href="/dp/'), F.upper("asin"), F.lit('">'), F.col("item_name"), F.lit("</a><p>Qty: "), F.col("quantity").cast("string"), F.lit("</p><p>$"),
        F.format_string("%.2f", F.col("item_amount_cents") / 100), F.lit("</p><p>Arriving Monday</p>"),
        F.when(number % 3 == 0, F.concat(F.lit('<a href="/returns/status?orderId='), F.col("order_id"), F.lit("&amp;rmaId=RMA-"), F.lpad(number.cast("string"), 7, "0"), F.lit("&amp;itemId=i"), number.cast("string"), F.lit('">View return status</a>'))).otherwise(""),
        F.lit("</div>"))
    lines = i.groupBy("order_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct(number, line.alias("h"))))["h"], "").alias("lines"))
    url = F.concat(F.lit("https://shop.example.com/your-orders/order-details?orderID="), F.col("order_id"))
    page = F.concat(
        F.lit("<body><div><div><div><div><div class='card'><p>Order placed June 2, 2026</p><p>Total $"), F.format_string("%.2f", F.col("purchase_cents") / 100), F.lit("</p><p>Order # "), F.col("order_id"), F.lit("</p>"), F.col("lines"),
        F.lit('<a href="'), url, F.lit('">Order details</a><a href="/returns/cart?orderId='), F.col("order_id"), F.lit('">Return or replace items</a></div></div></div></div></div>'),
        F.lit("<div class='carousel'><a href='/dp/BAD0000001'>Some other thing</a></div><div><p>Customers who viewed this item</p><a href='/dp/BAD0000002'>Another thing</a></div></body>"))
    return o.join(lines, "order_id").select(F.col("o_orderkey").alias("page_id"), page.alias("html"))


def _structure(s, d) -> dict[str, DataFrame]:
    """Pages are parsed once and their nodes written: most tables of the structure read them several times."""
    path = fresh_folder(s, "nodes")
    html.page_nodes(spread(_order_pages(s, d))).write.parquet(path)
    nodes = s.read.parquet(path)
    return pages.page_structure(html.page_blocks(nodes), html.page_anchors(nodes))


_SHOWN = {"shown": "SELECT o_orderkey AS page_id, o.order_id, upper(asin) AS asin, item_name, quantity, item_amount_cents, CAST(substr(item_key, 2) AS INTEGER) AS number FROM v_items i JOIN v_orders_once o ON i.order_id = o.order_id"}


@query(chain("SELECT page_id, asin, item_name FROM shown", **_SHOWN))
def product_anchors(s, d):
    return _structure(s, d)["products"].select("page_id", "asin", "item_name")


@query(chain("SELECT DISTINCT page_id, order_id, 5 AS block_id FROM shown", **_SHOWN))
def order_cards(s, d):
    return _structure(s, d)["cards"].select("page_id", "order_id", "block_id")


# no page speaks of a replacement
@query(chain("""
SELECT page_id, order_id, asin, item_name, quantity, item_amount_cents, 'Arriving Monday' AS fulfillment_status, CAST(NULL AS VARCHAR) AS replacement_stage,
  CAST(NULL AS VARCHAR) AS replacement_status_text, false AS replacement_no_return_required FROM shown""", **_SHOWN))
def order_line_items(s, d):
    return _structure(s, d)["line_items"].select(
        "page_id", "order_id", "asin", "item_name", "quantity", "item_amount_cents", "fulfillment_status", "replacement_stage", "replacement_status_text", "replacement_no_return_required")


# items of one page with one name are one entry, that of the shortest block: the line with the smaller numbers
@query(chain("""
SELECT page_id, item_name, asin, true AS strong FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, item_name ORDER BY length(printf('%d%.2f', quantity, item_amount_cents / 100)) + CASE WHEN number % 3 = 0 THEN 19 ELSE 0 END, number) AS n
  FROM shown) q WHERE n = 1""", **_SHOWN))
def return_item_entries(s, d):
    return _structure(s, d)["return_items"].select("page_id", "item_name", "asin", "strong")


@query(chain("SELECT DISTINCT page_id, order_id, 'https://shop.example.com/your-orders/order-details?orderID=' || order_id AS url FROM shown", **_SHOWN))
def order_detail_links(s, d):
    """Anchors alone are read, and once, so nothing is written."""
    return pages.order_detail_links(html.page_anchors(html.page_nodes(spread(_order_pages(s, d)), kinds=("anchor",)))).select("page_id", "order_id", "url")


@query(chain("SELECT page_id, order_id, printf('RMA-%07d', number) AS return_token, 'i' || number AS return_item_id, asin, item_name FROM shown WHERE number % 3 = 0", **_SHOWN))
def return_status_links(s, d):
    return _structure(s, d)["return_links"].select("page_id", "order_id", "return_token", "return_item_id", "asin", "item_name")


# --- captures to return groups --------------------------------------------------------------------------------------------


def _return_pages(s, d) -> tuple[DataFrame, DataFrame]:
    """(facts, item entries) of a return page for each order and token, with one refund for the whole page."""
    r = spark_view(s, d, "v_returns").withColumn("page_id", F.col("o_orderkey") * 10 + F.substring("return_token", -1, 1).cast("int"))
    cents = 1037 + 100 * (F.col("page_id") % 1000)
    words = F.concat(F.lit("Your refund has been issued\nTotal refund $"), F.format_string("%.2f", cents / 100))
    url = F.concat(F.lit("https://shop.example.com/spr/returns/prep?orderId="), F.col("order_id"), F.lit("&rmaId="), F.col("return_token"))
    captures = r.select("account_id", "page_id", url.alias("url"), F.lit("").alias("title"), words.alias("text"), F.lit(NOW).cast("timestamp").alias("captured_at")).distinct()
    facts = pages.return_facts(captures).withColumns({"order_id": X.url_order_id(F.col("url")), "return_token": X.url_return_token(F.col("url"))})
    entries = r.groupBy("page_id", "asin").agg(F.min("item_name").alias("item_name"), F.min("l_partkey").cast("int").alias("block_id"))
    return facts, entries


def _assembled(s, d) -> DataFrame:
    facts, entries = _return_pages(s, d)
    orders = spark_view(s, d, "v_orders_once").select("account_id", F.col("o_orderkey").alias("page_id"), "order_id", "purchase_cents", F.lit(NOW).cast("timestamp").alias("captured_at"))
    links = spark_view(s, d, "v_returns").where("l_partkey % 6 = 1").select(
        "account_id", (-F.col("o_orderkey")).alias("page_id"), "order_id", F.concat(F.lit("LINK-"), F.col("return_token")).alias("return_token"), F.format_string("i%d", F.col("l_partkey")).alias("return_item_id"),
        "item_name", "asin", F.lit(False).alias("no_return_required"))
    return pages.assemble_records(orders, facts, entries, links)


_ENTRIES = {"entries": """
  SELECT o_orderkey * 10 + CAST(right(return_token, 1) AS INTEGER) AS page_id, account_id, order_id, return_token, asin, count(*) OVER (PARTITION BY order_id, return_token) AS n_items
  FROM (SELECT DISTINCT account_id, o_orderkey, order_id, return_token, asin FROM v_returns) a"""}


@query(chain("""
SELECT record_id, 'order' AS record_type, purchase_cents, NULL AS refund_cents, NULL AS group_refund_cents, NULL AS refund_scope, false AS authoritative, false AS provisional FROM v_orders_once
UNION ALL SELECT 'return:' || order_id || ':' || lower(return_token) || ':' || asin, 'return', NULL, CASE WHEN n_items = 1 THEN 1037 + 100 * (page_id % 1000) END,
  CASE WHEN n_items > 1 THEN 1037 + 100 * (page_id % 1000) END, CASE WHEN n_items = 1 THEN 'item' ELSE 'return' END, true, false FROM entries
UNION ALL SELECT DISTINCT 'return:' || order_id || ':link-' || lower(return_token) || ':i' || l_partkey, 'return', NULL, NULL, NULL, NULL, false, true FROM v_returns WHERE l_partkey % 6 = 1""", **_ENTRIES))
def assemble_records(s, d):
    return _assembled(s, d).select("record_id", "record_type", "purchase_cents", "refund_cents", "group_refund_cents", "refund_scope", "authoritative", "provisional")


@query(chain("""
SELECT order_id, return_token AS group_key, count(*) AS n_records, CAST(min(1037 + 100 * (page_id % 1000)) AS BIGINT) AS amount_cents, 'refund_issued' AS stage, false AS amount_conflict
FROM entries GROUP BY order_id, return_token""", **_ENTRIES))
def group_refunds_from_pages(s, d):
    """From captured return pages with several items to the amount of each return group: assembled, merged, deduplicated, grouped."""
    records = _assembled(s, d).where("record_type = 'return' AND authoritative").withColumns({"batch_id": F.lit(0).cast("long"), "seq": F.col("page_id")})
    ledger = merge.merge_latest(records.drop("page_id")).withColumn("last_scanned_at", F.col("captured_at"))
    groups = B.group_returns(B.dedupe_returns(B.prepared_returns(ledger, NOW)))
    return groups.select("order_id", "group_key", "n_records", "amount_cents", "stage", "amount_conflict")


@query(chain("""
SELECT record_id AS old_id, CASE WHEN n = 1 AND authoritative THEN 'return:' || order_id || ':tok-' || o_orderkey || ':it' || o_orderkey ELSE record_id END AS record_id,
  CASE WHEN n = 1 AND authoritative THEN 'TOK-' || o_orderkey ELSE return_token END AS return_token
FROM (SELECT *, count(*) FILTER (authoritative) OVER (PARTITION BY o_orderkey) AS n FROM v_returns) q"""))
def identity_hint(s, d):
    r = spark_view(s, d, "v_returns").withColumns({"page_id": F.col("o_orderkey"), "return_item_id": F.lit(None).cast("string"), "asins": F.array("asin"), "item_names": F.array("item_name"), "old_id": F.col("record_id")})
    name = lambda p: F.concat(F.lit(p), F.col("o_orderkey").cast("string"))
    links = r.select("account_id", "page_id", name("TOK-").alias("return_token"), name("it").alias("return_item_id")).distinct()
    return merge.apply_identity_hint(r, links).select("old_id", "record_id", "return_token")


@query(chain("""
SELECT order_id, 'K' || k AS item_key, CASE WHEN k % 4 <> 1 THEN printf('B%09d', k) END AS asin, item_name, CASE WHEN k % 5 <> 0 THEN quantity END AS quantity,
  CASE WHEN k % 3 <> 0 THEN item_amount_cents END AS item_amount_cents, CASE WHEN k % 2 = 0 THEN replacement_stage END AS replacement_stage
FROM (SELECT *, CAST(substr(item_key, 2) AS INTEGER) AS k FROM v_items) q WHERE k % 7 <> 0"""))
def normalize_items(s, d):
    """Order items with faults that the rules must mend or drop: no key, short ASINs, bad amounts, unknown stages, repeated keys."""
    k = F.substring("item_key", 2, 20).cast("int")
    item = F.struct(
        F.when(k % 7 != 0, F.concat(F.lit(" K"), k.cast("string"))).alias("item_key"), F.when(k % 4 == 1, "short").otherwise(F.lower(F.format_string("B%09d", k))).alias("asin"), F.concat(F.lit("  "), F.col("item_name")).alias("item_name"),
        F.when(k % 5 == 0, -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity"), F.when(k % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("item_amount_cents")).alias("item_amount_cents"),
        F.when(k % 2 == 0, F.upper("replacement_stage")).otherwise("odd").alias("replacement_stage"), F.lit(True).alias("replacement_no_return_required"))
    lists = spark_view(s, d, "v_items").groupBy("order_id").agg(F.collect_list(item).alias("items"))
    twice = F.concat("items", F.transform("items", lambda x: x.withField("item_name", F.lit("again"))))
    out = lists.select("order_id", F.explode(normalize_order_items(twice)).alias("x"))
    return out.select("order_id", *[f"x.{c}" for c in ("item_key", "asin", "item_name", "quantity", "item_amount_cents", "replacement_stage")])


def _identity_captures(s, d) -> DataFrame:
    c = spark_view(s, d, "v_captures")
    k = F.col("seq")
    number = lambda n: F.format_string("B%09d", k % n)
    return c.withColumns({
        "item_identity_source": F.when(k % 5 == 0, schema.TRUSTED_SOURCE), "return_item_id": F.lit("i"), "authoritative": k % 6 == 0,
        "item_names": F.array(F.concat(F.lit("Name "), (k % 4).cast("string"))), "asins": F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(number(5))),
        "item_asin_evidence_source": F.when(k % 7 == 0, schema.STRONG_EVIDENCE[0])})


# names and ASINs add up from the last authoritative capture on, up to the first one that came by the order's own link
@query(chain("""
SELECT record_id, array_to_string(list_transform(name_list, lambda n: 'Name ' || n), '|') AS item_names,
  array_to_string(list_transform(CASE WHEN fix IS NOT NULL AND len(fixed) > 0 THEN fixed ELSE open END, lambda a: printf('B%09d', a)), '|') AS asins,
  coalesce(fix IS NOT NULL AND len(fixed) > 0 AND len(list_filter(later, lambda a: NOT list_contains(fixed, a))) > 0, false) AS identity_conflict
FROM (
  SELECT record_id, any_value(fix) AS fix,
    (SELECT list(v ORDER BY p) FROM (SELECT seq % 4 AS v, min(n) AS p FROM placed x WHERE x.record_id = q.record_id AND n >= from_n AND n <= until_n GROUP BY seq % 4) a) AS name_list,
    coalesce((SELECT list(v ORDER BY p) FROM (SELECT seq % 5 AS v, min(n) AS p FROM placed x WHERE x.record_id = q.record_id AND n >= from_n AND n <= until_n AND seq % 3 <> 0 GROUP BY seq % 5) a), []) AS fixed,
    coalesce((SELECT list(v ORDER BY p) FROM (SELECT seq % 5 AS v, min(n) AS p FROM placed x WHERE x.record_id = q.record_id AND n >= last_n AND seq % 3 <> 0 GROUP BY seq % 5) a), []) AS open,
    coalesce((SELECT list(seq % 5) FROM placed x WHERE x.record_id = q.record_id AND n > fix AND seq % 3 <> 0 AND (seq % 5 = 0 OR seq % 7 = 0)), []) AS later
  FROM placed q GROUP BY record_id) r""", placed="""
  SELECT *, coalesce(max(CASE WHEN seq % 6 = 0 AND n <= until_n THEN n END) OVER (PARTITION BY record_id), 1) AS from_n, coalesce(max(CASE WHEN seq % 6 = 0 THEN n END) OVER (PARTITION BY record_id), 1) AS last_n FROM numbered""",
    numbered="SELECT *, min(CASE WHEN seq % 5 = 0 THEN n END) OVER (PARTITION BY record_id) AS fix, coalesce(min(CASE WHEN seq % 5 = 0 THEN n END) OVER (PARTITION BY record_id), 1000000000) AS until_n FROM counted",
    counted="SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY batch_id, seq) AS n FROM v_captures"))
def trusted_identity(s, d):
    got = merge.trusted_identity(_identity_captures(s, d))
    return registered.joined(got, "item_names", "asins").drop("account_id")


# --- files and streams ------------------------------------------------------------------------------------------------------


@query(chain("SELECT page_id, url, length(text) AS n_chars FROM v_page_text"))
def read_captures(s, d):
    path = fresh_folder(s, "captures")
    c = _captures(s, d).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    c.select(*schema.PAGE_CAPTURE.names).write.parquet(path)
    return io.read_page_captures(s, path).select("page_id", "url", F.length("text").cast("long").alias("n_chars"))


@query(chain("SELECT record_id, purchase_cents, last_scanned_at FROM v_orders_once"))
def ledger_versions(s, d):
    """Two versions of a ledger are written, the first with half of the orders; the newest one is read."""
    path, o = fresh_folder(s, "ledger"), spark_view(s, d, "v_orders_once")
    half = o.where("o_orderkey % 2 = 0")
    io.write_ledger(half, path, buckets=4)
    io.write_ledger(o, path, before=half, buckets=4)
    return io.read_ledger(s, path).select("record_id", "purchase_cents", "last_scanned_at")


_EXPORT = io.EXPORT_COLUMNS


@query(chain(r"""
SELECT label AS status, order_id, CAST(n_items AS VARCHAR) AS product_count, CAST(n_returned_items AS VARCHAR) AS returned_product_count, replace(item_names, '|', ' | ') AS items,
  replace(product_statuses, '|', ' | ') AS product_statuses, coalesce(regexp_replace(printf('%.2f', purchase_cents / 100), '\.?0+$', ''), '') AS order_total,
  coalesce(regexp_replace(printf('%.2f', refund_cents / 100), '\.?0+$', ''), '') AS expected_refund, coalesce(card_last4, '') AS card_last4, shop_status,
  CAST(detail_complete AS VARCHAR) AS detail_complete, open_url AS order_details_url, strftime(last_scanned_at, '%Y-%m-%dT%H:%M:%S.000Z') AS last_scanned_at
FROM orows WHERE data_complete AND n_items > 0"""))
def export_csv(s, d):
    path = fresh_folder(s, "export")
    io.export_ledger_csv(registered.Views(s, d).rows.where("n_items > 0"), path)
    back = s.read.csv(path, header=True, escape='"', schema=", ".join(f"{c} string" for c in _EXPORT), emptyValue="", nullValue="\x00")
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in _EXPORT])


@query(chain("SELECT order_id, state, purchase_cents, len(ranks) AS n_ranks FROM orows"))
def export_json(s, d):
    path, v = fresh_folder(s, "export"), registered.Views(s, d)
    io.export_ledger_json(v.rows, v.orders, path)
    back = s.read.schema("order_id string, state string, purchase_cents long, ranks array<int>").json(f"{path}/rows")
    return back.select("order_id", "state", "purchase_cents", F.size("ranks").cast("long").alias("n_ranks"))


@query(chain("SELECT account_id, request_id, expected_cents, card_last4 FROM v_requests"))
def bank_request_files(s, d):
    """Requests written as documents of at most 40 returns, and read back."""
    path = fresh_folder(s, "requests")
    io.write_bank_requests(spark_view(s, d, "v_requests").withColumn("return_record_id", F.col("request_id")), path, "q1", most=40)
    item = "array<struct<request_id:string,expectedRefund:double,paymentCardLast4:string>>"
    doc = s.read.schema(f"accountId string, requestId string, returns {item}").json(path).where("requestId = 'q1'")
    return doc.select(F.col("accountId").alias("account_id"), F.explode("returns").alias("r")).select(
        "account_id", "r.request_id", F.round(F.col("r.expectedRefund") * 100).cast("long").alias("expected_cents"), F.col("r.paymentCardLast4").alias("card_last4"))


@query(chain("SELECT account_id, request_id AS return_record_id, 'pending' AS status, expected_cents / 100 AS matched_amount FROM v_requests WHERE account_id <> 'A2'"))
def bank_result_files(s, d):
    """Result documents of three accounts, one of which answers another request; read with the rejects left out."""
    path = fresh_folder(s, "results")
    match = F.struct(F.col("request_id").alias("returnRecordId"), F.lit("pending").alias("status"), (F.col("expected_cents") / 100).alias("matchedAmount"))
    docs = spark_view(s, d, "v_requests").groupBy("account_id").agg(F.collect_list(match).alias("matches"))
    answered = F.when(F.col("account_id") == "A2", "old").otherwise("q1").alias("requestId")
    docs.select(F.lit("bank-reconciliation-result/1").alias("schema"), answered, F.col("account_id").alias("accountId"), "matches").repartition(3, "accountId").write.option("maxRecordsPerFile", 1).json(path)
    return io.read_bank_results(s, path, "q1")[0].select("account_id", "return_record_id", "status", "matched_amount")


@query(f"SELECT * EXCLUDE captured_at FROM ({chain(registered._MERGED, **registered._CAP)})")
def stream_ledger(s, d):
    """The captures arrive in three files, a batch each, and end as one merge of them all would."""
    source, path, c = fresh_folder(s, "arriving"), fresh_folder(s, "ledger"), spark_view(s, d, "v_captures").withColumns({"order_id": F.col("record_id"), "record_type": F.lit("return")})
    for k in range(3):
        c.where(F.floor(F.col("batch_id") / 2) == k).coalesce(1).write.mode("append").parquet(source)
    stream = s.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.stream_ledger(stream, path, fresh_folder(s, "checkpoint"), buckets=4).awaitTermination()
    return ledger_store.read_ledger_store(s, path).select(*registered._MERGED_COLUMNS[:-1])
