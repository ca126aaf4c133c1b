"""HTML structure, assembly, files and streams."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerwright.functions import schema, text
from ledgerwright.operators import merge, pages
from ledgerwright.plans import adapters
from ledgerwright.sources import html, io, ledger_store
from ledgerwright.streaming import ledger as streaming

O1, O2 = "112-1234567-7654321", "113-7654321-1234567"
PAGE = f"""<body><div class="card"><p>Order placed June 2, 2026</p><p>Total $30.00</p><p>Order # {O1}</p>
<div class="item"><a href="/dp/B000000001">Blue Bottle</a><p>Qty: 2</p><p>$10.00</p><p>Delivered Monday</p><a href="/returns/status?orderId={O1}&rmaId=RMA-1234567&itemId=i1">View return status</a></div>
<div class="item"><a href="/gp/product/B000000002" title="Desk Lamp with Shade"></a></div><a href="https://shop.example.com/your-orders/order-details?orderID={O1}">Order details</a><a href="/returns/cart?orderId={O1}">Return or replace items</a></div>
<div class="card"><p>Order placed</p><p>Total $1</p><p>{O2}</p><p>Cancelled</p><a href="https://evilshop-example.com/your-orders/order-details?orderID={O2}">x</a></div>
<div class="carousel"><a href="/dp/B000000009">Sponsored thing</a></div><script>var a = "<a href='/dp/B000000008'>no</a>"</script><p hidden>B</p>"""


def tables(spark):
    raw = spark.createDataFrame([(1, PAGE), (2, None), (3, "no tags"), (4, "<div><p>a<p>b</section></div>")], "page_id long, html string")
    nodes = html.page_nodes(raw)
    return html.page_blocks(nodes), html.page_anchors(nodes), html.page_text(nodes)


def test_structure(spark):
    blocks, anchors, words = tables(spark)
    got = pages.page_structure(blocks, anchors)
    assert {(r.asin, r.item_name) for r in got["products"].collect()} == {("B000000001", "Blue Bottle"), ("B000000002", "Desk Lamp with Shade")}
    assert {r.order_id for r in got["cards"].collect()} == {O1, O2}
    line = {r.asin: r for r in got["line_items"].collect()}
    assert (line["B000000001"].quantity, line["B000000001"].item_amount_cents, line["B000000001"].fulfillment_status, line["B000000001"].order_id) == (2, 1000, "Delivered Monday", O1)
    assert {(r.order_id, r.url.split("/")[2]) for r in got["detail_links"].collect()} == {(O1, "shop.example.com")}
    assert [(r.order_id, r.return_token, r.return_item_id, r.asin) for r in got["return_links"].collect()] == [(O1, "RMA-1234567", "i1", "B000000001")]
    assert any(r.asin == "B000000001" and r.strong for r in got["return_items"].collect())
    assert "Order placed" in words.where("page_id = 1").first().text and "var a" not in words.where("page_id = 1").first().text


def test_assembly(spark):
    cap = spark.createDataFrame([("a", 1, f"https://shop.example.com/returns/status?orderId={O1}&rmaId=RMA-1234567", "t", "Your refund has been issued\nTotal refund $10.00")], "account_id string, page_id long, url string, title string, text string").withColumn("captured_at", F.lit("2026-01-01").cast("timestamp"))
    checks = spark.createDataFrame([(1, 0, ["Refund credited"], False), (1, 1, ["Initiated"], False)], "page_id long, check_id int, labels array<string>, hidden boolean")
    facts = pages.return_facts(cap, checks).withColumns({"order_id": F.lit(O1), "return_token": F.lit("RMA-1234567")})
    r = facts.first()
    assert (r.stage, r.status, r.refund_cents) == ("refund_issued", "refunded", 1000)
    items = spark.createDataFrame([(1, 5, "B000000001", "Blue Bottle"), (1, 6, "B000000002", None)], "page_id long, block_id int, asin string, item_name string")
    links = spark.createDataFrame([("a", 9, O2, "RMA-7654321", "i2", "Lamp", None, False)], "account_id string, page_id long, order_id string, return_token string, return_item_id string, item_name string, asin string, no_return_required boolean")
    orders = spark.createDataFrame([("a", 1, O1, 3000), ("a", 1, O1, 3000)], "account_id string, page_id long, order_id string, purchase_cents long")
    got = {x.record_id: x for x in pages.assemble_records(orders, facts, items, links).collect()}
    assert set(got) == {f"order:{O1}", f"return:{O1}:rma-1234567:B000000001", f"return:{O1}:rma-1234567:B000000002", f"return:{O2}:rma-7654321:i2"}
    first = got[f"return:{O1}:rma-1234567:B000000001"]
    assert first.refund_cents is None and first.group_refund_cents == 1000 and first.refund_scope == "return" and first.authoritative
    hinted = merge.apply_identity_hint(spark.createDataFrame([("a", 1, "old", O1, None, None, ["B1"], [], True, 5)], "account_id string, page_id long, record_id string, order_id string, return_token string, return_item_id string, asins array<string>, item_names array<string>, authoritative boolean, refund_cents long"), spark.createDataFrame([("a", 1, "TOK", "it")], "account_id string, page_id long, return_token string, return_item_id string"))
    assert hinted.first().record_id == f"return:{O1}:tok:it"


def test_checkmarks_without_words(spark):
    p = spark.createDataFrame([(1, "unknown"), (2, "received"), (3, "unknown")], "page_id long, text_stage string")
    marks = [(1, 0, ["Initiated"], False), (1, 1, ["Dropped off"], False), (1, 2, ["Return received"], True), (1, 3, ["Refund issued", "Initiated"], False)] + [(2, i, [x], False) for i, x in enumerate(["Initiated", "Dropped off", "Return received", "Refund issued", "Refund credited"])]
    c = spark.createDataFrame(marks, "page_id long, check_id int, labels array<string>, hidden boolean")
    assert {r.page_id: r.stage for r in pages.fuse_checkmarks(p, c).collect()} == {1: "shipped", 2: "received", 3: "unknown"}
    weak = spark.createDataFrame([(2, "u", "t", "Return summary\nRefund method"), (1, "u", "t", "Return started")], "page_id long, url string, title string, text string")
    assert {r.page_id: r.stage for r in pages.return_facts(weak, c).collect()} == {2: "credited", 1: "started"}


def test_files(spark, tmp_path):
    kind = "account_id string, order_id string, data_complete boolean, label string, n_items long, n_returned_items long, item_names array<string>, product_statuses array<string>, purchase_cents long, refund_cents long, card_last4 string, shop_status string, detail_complete boolean, open_url string, last_scanned_at timestamp"
    seen = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
    rows = spark.createDataFrame([
        ("a", O1, True, "Refund issued", 2, 1, ["x", 'y "z"'], ["x => Refund issued", 'y "z" => Not returned'], 12345, 1200, "1234", "Return received", True, "https://u", seen),
        ("a", O2, True, "Cancelled", 0, 0, ["only"], [], None, 50, None, "—", False, "", None), ("a", "hidden", False, "Processing", 0, 0, [], [], 1, 1, None, "—", False, "", None)], kind)
    io.export_ledger_csv(rows.coalesce(1), f"{tmp_path}/csv")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/csv").collect()]
    assert lines == [
        '"status","order_id","product_count","returned_product_count","items","product_statuses","order_total","expected_refund","card_last4","shop_status","detail_complete","order_details_url","last_scanned_at"',
        f'"Refund issued","{O1}","2","1","x | y ""z""","x => Refund issued | y ""z"" => Not returned","123.45","12","1234","Return received","true","https://u","2026-01-02T03:04:05.000Z"',
        f'"Cancelled","{O2}","1","0","only","","","0.5","","—","false","",""']
    io.export_ledger_json(rows, rows, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json/rows").count() == 3
    led = rows.select("account_id", "order_id", F.col("order_id").alias("record_id"), "purchase_cents")
    assert io.write_ledger(led, f"{tmp_path}/led") and not io.write_ledger(led, f"{tmp_path}/led", before=led)
    assert io.write_ledger(led.limit(1), f"{tmp_path}/led") and io.read_ledger(spark, f"{tmp_path}/led").count() == 1
    assert io.drop_old_versions(spark, f"{tmp_path}/led", 1) == 1 and io.read_ledger(spark, f"{tmp_path}/led").count() == 1
    tag = "bank-reconciliation-result/1"
    (tmp_path / "in").mkdir()
    for k, doc in enumerate([f'{{"schema": "{tag}", "requestId": "q", "matches": [{{"returnRecordId": "r", "status": "confirmed", "matchedAmount": 1.5}}]}}', '{"schema": "other", "requestId": "q", "matches": []}', f'{{"schema": "{tag}", "requestId": "old", "matches": []}}', "{broken", f'{{"schema": "{tag}", "requestId": "q"}}']):
        (tmp_path / "in" / f"{k}.json").write_text(doc)
    good, bad = io.read_bank_results(spark, f"{tmp_path}/in", "q")
    assert good.count() == 1 and sorted(r.problem for r in bad.collect()) == ["malformed", "matches", "request", "schema"]
    assert good.first().account_id == "main"
    io.write_bank_requests(spark.createDataFrame([("a", "r1", 5), ("a", "r2", None)], "account_id string, return_record_id string, expected_cents long"), f"{tmp_path}/req", "q1")
    doc = spark.read.json(f"{tmp_path}/req").first()
    assert doc.requestId == "q1" and len(doc.returns) == 2
    cap = spark.createDataFrame([("a", 1, "u", "t", "x", None)], schema.PAGE_CAPTURE)
    cap.write.parquet(f"{tmp_path}/cap")
    assert io.read_page_captures(spark, f"{tmp_path}/cap").count() == 1 and io.read_page_captures(spark, f"{tmp_path}/cap", streaming=True).isStreaming
    io.append_events(spark.createDataFrame([("a", 1)], "account_id string, event_id long"), f"{tmp_path}/ev")
    io.append_events(spark.createDataFrame([("a", 2)], "account_id string, event_id long"), f"{tmp_path}/ev")
    assert spark.read.parquet(f"{tmp_path}/ev").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    c = adapters.spark_view(spark, "/root/testdata/sf0.001", "v_captures").withColumns({"batch_id": F.lit(0).cast("long"), "order_id": F.col("record_id"), "record_type": F.lit("return")})
    for k in range(3):  # files arrive out of order
        c.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streaming.stream_ledger(source, f"{tmp_path}/led", f"{tmp_path}/cp", buckets=5).awaitTermination(120)
    got, want = ledger_store.read_ledger_store(spark, f"{tmp_path}/led"), merge.merge_latest(c)
    rank = lambda df: {(r.record_id, r.k) for r in df.select("record_id", schema.stage_rank(F.col("return_stage")).alias("k")).collect()}
    assert rank(got) == rank(want) and got.count() == want.count()
    q = streaming.stage_stream(source).writeStream.format("memory").queryName("stages").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(180)
    kept = spark.table("stages").groupBy("record_id").agg(F.max("stage_rank").alias("k"), F.max("n_captures").alias("n"))
    assert {(r.record_id, r.k) for r in kept.collect()} == rank(want) and kept.agg(F.sum("n")).first()[0] == c.count()


def test_advertisements(spark):
    page = """<body><div id="rhf"><a href="/dp/B000000001">In the foot</a></div><div><div><div><div><div><a href="/dp/B000000002">Far from the words</a></div></div></div></div></div>
    <div><p>Products related to your return</p><div><a href="/dp/B000000003">Near the words</a></div></div><section data-a-carousel-options="{}"><a href="/dp/B000000004">Turning</a></section>
    <div class="My-RECOMMENDations"><p><a href="/dp/B000000005">Advised</a></p></div><aside><a href="/dp/B000000006">Aside</a></aside></body>"""
    nodes = html.page_nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))
    kept = pages.exclude_recommendation_anchors(html.page_anchors(nodes), html.page_blocks(nodes))
    assert {r.href[-1] for r in kept.collect()} == {"2"}


def test_replacement_arriving(spark):
    df = spark.createDataFrame([("Replacement arriving Tuesday",), ("Replacement complete",), ("arriving Tuesday",)], "text string")
    assert [r.s for r in df.select(text.replacement(F.col("text"))["stage"].alias("s")).collect()] == ["requested", "complete", None]
