"""The fast way through plain pages gives what HTMLParser gives; structure opens up only blocks that hold links."""

import random

from pyspark.sql import functions as F

from ledgerwright.functions import text as X
from ledgerwright.operators import pages
from ledgerwright.sources import html

PARTS = [
    "<p>", "</p>", "<div>", "</div>", "<div class='x' id=\"k\">", "<a href='/dp/B&amp;1' title=\"q&lt;\">", "</a>", "<br>", "<br/>", "<img alt='pic'>", "text", "  two  words ", "\n", "\t", "&am", "&#65;", "\xa0 ", "<", ">",
    "<!-- c -->", "<script>if(a<b)</script>", "<title>T</title>", "<textarea><p></textarea>", "</LI>", "<li hidden>", "<p class='a' class='b'>", "</ div>", "<a href=x>", "<a href=\"x>y\">", "<a\nhref='u'>", "x\n \ny", "\x1c"]


def by_parser(text):
    reader = html._Reader()
    reader.feed(text)
    reader.close()
    return reader


def test_plain_pages_are_read_as_the_parser_reads_them():
    dice, plain, known = random.Random(7), 0, {}
    for _ in range(4000):
        text = "".join(dice.choice(PARTS[:16] if dice.random() < 0.5 else PARTS) for _ in range(dice.randint(0, 10)))
        fast, slow = html._Reader(), by_parser(text)
        if html._read_plain(text, fast, known):
            plain += 1
            assert (fast.words, fast.blocks, fast.anchors) == (slow.words, slow.blocks, slow.anchors), text
    assert plain > 500
    assert html._tidy("\n a \t b \n\n \xa0c \nd") == "a b\nc\nd"


def test_anchors_alone(spark):
    raw = spark.createDataFrame([(1, "<div><p>a</p><a href='/x'>link</a></div>"), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    found = html.page_nodes(raw, kinds=("anchor",)).collect()
    assert [(r.page_id, r.node.kind, r.node.text, r.node.block_id) for r in found] == [(1, "anchor", "link", 0)]
    assert html.page_nodes(raw).where("node.kind = 'anchor'").collect() == found


def test_blocks_around_links_only(spark):
    blocks = spark.createDataFrame([(1, 0, []), (1, 1, [0]), (1, 2, [0, 1]), (1, 3, [0])], "page_id long, block_id int, ancestors array<int>")
    rows = pages.above(spark.createDataFrame([(1, 2, "x")], "page_id long, leaf int, v string"), blocks)
    assert sorted((r.block_id, r.v) for r in rows.collect()) == [(0, "x"), (1, "x"), (2, "x")]


def test_words_are_tidied_as_they_come():
    dice, odd = random.Random(11), ["a", " b", "c ", "\xa0d", " \n e\t\tf \n\n", "\xa0\n", "g\r", "  ", "\x1ch "]
    for _ in range(3000):
        said = [("data", dice.choice(odd)) if dice.random() < 0.7 else (dice.choice(["start", "end"]), dice.choice(["p", "div", "br", "a"])) for _ in range(dice.randint(0, 12))]
        words, size, reader, spans = [], [], html._Reader(), []
        for kind, what in said:  # the words as they stand on the page, and how many there are of them and of the reader's characters at each step
            if kind == "data":
                reader.handle_data(what)
                words += [what] if what.strip() else []
            elif kind == "start":
                spans.append((len(words), reader.size))
                reader.handle_starttag(what, [("href", "x")])
                words += ["\n"] if what != "a" else []
            elif what != "a" and what != "br" and any(reader.blocks[i][2] == what for i in reader.open):
                reader.handle_endtag(what)
                words.append("\n")
        for start, at in spans:
            assert "".join(reader.words)[at:].strip() == html._tidy("".join(words[start:])), said


def test_structure_deals_rows_by_page_once(spark, tmp_path):
    """Anchors bring the blocks around them along, so finding products and cards takes no join by block, and no text is dealt."""
    raw = spark.createDataFrame([(1, "<div><div><p>a</p><a href='/x'>link</a></div></div><a href='/y'>out</a>")], "page_id long, html string")
    html.page_nodes(raw).write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    anchors, blocks = html.page_anchors(nodes), html.page_blocks(nodes)
    assert {r.pos: r.ancestors for r in anchors.collect()} == {0: [0, 1], 1: []}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        found = pages.page_structure(blocks, anchors)
        assert plan(found["products"]).count("Exchange hashpartitioning") == plan(found["cards"]).count("Exchange hashpartitioning") == 2
        assert plan(found["return_links"]).count("Join") <= 4 and plan(found["line_items"]).count("Join") <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_without_the_blocks_around_anchors_give_the_same(spark):
    order = "112-1234567-7654321"
    page = f"""<div class='card'><p>Order placed June 2</p><p>Total $3</p><p>{order}</p><div><a href='/dp/B000000001'>Blue Lamp</a><p>Qty: 2</p><p>$3.00</p>
    <p>There is no need to return the item. Replacement ordered</p><a href='/returns/status?orderId={order}&rmaId=RMA-1234567'>View return status</a></div></div><aside><p><a href='/dp/B000000002'>Red Lamp</a></p></aside><a href='/dp/B000000003'>No block</a><a href='/your-orders/order-details?orderID={order}'>Details</a>"""
    nodes = html.page_nodes(spark.createDataFrame([(1, page), (2, page.replace("-", "-\r", 1)), (2, page)], "page_id long, html string"))
    anchors, blocks = html.page_anchors(nodes), html.page_blocks(nodes)
    with_, without = pages.page_structure(blocks, anchors), pages.page_structure(blocks, anchors.drop("ancestors"))
    for name, table in with_.items():
        rows = lambda df: sorted(map(str, df.drop("ancestors").collect()))
        assert rows(table) == rows(without[name]) and table.count(), name
    assert {r.asin for r in with_["products"].collect()} == {"B000000001", "B000000003"}
    assert [r.no_return_required for r in with_["return_links"].where("page_id = 1").collect()] == [True]


def test_ids_that_a_carriage_return_breaks(spark):
    texts = ["x 112-1234567-7654321 112-1234567-7654321", "112-12345\r67-7654321", "9112-1234567-7654321", "112-1234567-76543210", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.order_ids(F.col("t")).alias("ids")).collect()
    assert [r.ids for r in got] == [["112-1234567-7654321"]] * 2 + [[], [], []]


def test_line_items_take_all_links_and_the_strongest_replacement(spark):
    """An item's second link has its longer name, its amount and the stronger replacement; items behind the thirtieth product count too."""
    order = "112-1234567-7654321"
    two = """<div><a href='/dp/B000000001'>Lamp</a><p>Qty: 2</p><p>Replacement shipped</p><p>There is no need to return the item</p></div><div><a href='/dp/B000000001'>Lamp, blue</a><p>Qty: 5</p><p>$3.00</p><p>Replacement ordered</p></div>"""
    more = "".join(f"<div><a href='/dp/B1000000{k:02d}'>Thing {k}</a><p>Replacement requested</p></div>" for k in range(35))
    page = f"<div class='card'><p>Order placed June 2</p><p>Total $3</p><p>{order}</p>{two}{more}</div>"
    nodes = html.page_nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))
    found = {r.asin: r for r in pages.page_structure(html.page_blocks(nodes), html.page_anchors(nodes))["line_items"].collect()}
    first = found["B000000001"]
    assert (first.item_name, first.quantity, first.item_amount_cents) == ("Lamp, blue", 2, 300)
    assert (first.replacement_stage, first.replacement_status_text, first.replacement_no_return_required) == ("shipped", "Replacement shipped", True)
    assert len(found) == 36 and found["B100000034"].replacement_stage == "requested" and found["B100000034"].replacement_source == "order-details-product-block"
