"""Jobs over captured pages: gates, keys, facts, structure, and the assembly of typed captures.

Inputs are flat tables: page_captures, page_anchors (page_id, pos, block_id, href, text, title, aria_label, img_alt, and if known ancestors,
the blocks around an anchor, the innermost last), page_blocks (page_id, block_id, depth, ancestors, tag, css_class, attrs, hidden, text),
page_checkmarks (page_id, check_id, labels, hidden).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import schema, text as X
from ..functions.arrays import bound

# Marks of recommendation blocks (in class or id, and in text), labels that name no product, and routes and words of links.
AD_MARK = r"(?i)recommend"
AD_CLASS = r"(?i)carousel|sponsored|similarit"
AD_TEXT_WORDS = ("products related to your return", "customers who viewed", "sponsored products")
AD_TEXT = "(?i)" + "|".join(AD_TEXT_WORDS)
AD_TEXT_CHARS, AD_TEXT_LEVELS = 4500, 5
ACTION_LABEL = (
    r"(?i)^(?:buy it again|view (?:your )?item|track package|return or replace(?: items)?|write a (?:product )?review"
    r"|get (?:product )?support|order details|view order details|invoice)$")
ASIN_HREF = r"(?i)/(?:dp|gp/product|product)/([A-Z0-9]{10})(?:[/?#]|$)"
REPLACEMENT_SOURCE = "order-details-product-block"
RETURN_HREF = r"(?i)/spr/returns/(?:prep|label|cart)|/returns?/(?:status|details)|return-status"
RETURN_WORDS = r"(?i)(?:view|check|track).{0,20}(?:return|refund)|return(?:/| and |\s)refund status|return status"


# --- J1, J2 ---------------------------------------------------------------------------------------------------------


def classify_pages(captures: DataFrame) -> DataFrame:
    """Adds gate, page_type, ready, signature, changed (against the previous capture of the same place)."""
    status = F.col("http_status") if "http_status" in captures.columns else None
    kind = X.page_type(F.col("url"), F.col("text"))
    job = F.when(kind == "order_history", "history").when(kind == "order_detail", "detail").when(kind == "return", "return").otherwise("other")
    out = captures.withColumns({"gate": X.page_gate(F.col("text"), status), "page_type": kind, "place": X.location_key(F.col("url")), "signature": X.page_signature(F.col("text"))})
    out = out.withColumn("ready", X.page_ready(job, F.col("url"), F.col("text"), X.url_order_id(F.col("url")), F.col("text").rlike(r"(?i)/dp/|\bqty\b|buy it again")))
    before = F.lag("signature").over(W.partitionBy("account_id", "place").orderBy("captured_at", "page_id"))
    return out.withColumn("changed", ~before.eqNullSafe(F.col("signature"))).drop("place")


def page_keys(captures: DataFrame) -> DataFrame:
    """One row an order id on a page (null without any): position, URL facts, canonical place, history route."""
    u = F.col("url")
    ids = F.posexplode_outer(X.order_ids(F.col("text")))
    x = captures.select("account_id", "page_id", "url", ids.alias("pos", "order_id"))
    return x.select(
        "account_id", "page_id", "pos", "order_id", X.url_order_id(u).alias("url_order_id"), X.url_return_token(u).alias("return_token"),
        X.url_param(u, "itemId").alias("return_item_id"), X.url_param(u, "contractId").alias("return_contract_id"), X.url_param(u, "rmaId").alias("return_rma_id"),
        X.history_year(u).alias("year"), X.history_page(u).alias("page"), X.location_key(u).alias("place"))


def url_facts(df: DataFrame) -> DataFrame:
    u = F.col("url")
    return df.withColumns({"url_order_id": X.url_order_id(u), "return_token": X.url_return_token(u), "return_item_id": X.url_param(u, "itemId"), "return_contract_id": X.url_param(u, "contractId"), "return_rma_id": X.url_param(u, "rmaId")})


def history_route(df: DataFrame) -> DataFrame:
    u = F.col("url")
    mode = F.when(u.rlike(r"#(?:time/\d{4}/)?pagination/\d+"), "hash").when(u.rlike(r"(?i)[?&](?:startIndex|page)="), "query").otherwise("first")
    return df.withColumns({"year": X.history_year(u), "page": X.history_page(u), "mode": mode})


def sanitize_events(events: DataFrame, relevant: str = r"(?i)order|return|refund") -> DataFrame:
    """Events that are navigations or concern orders, with cleaned URLs."""
    return events.where((F.col("type") == "navigation") | F.col("url").rlike(relevant)).withColumn("url", X.sanitized_url(F.col("url")))


# --- J3, J4, J5 -----------------------------------------------------------------------------------------------------


def order_facts(captures: DataFrame) -> DataFrame:
    """One row a page: the order that its URL or its only id names, with money, date, card and completeness facts."""
    shared, p = X.with_page(captures)
    shared = shared.withColumn("__ids", X.order_ids(p))
    order = F.coalesce(X.url_order_id(F.col("url")), F.when(F.size("__ids") == 1, F.get("__ids", F.lit(0))))
    out = shared.withColumns({
        "order_id": order, "purchase_cents": X.purchase_cents(p), "history_total_cents": X.history_total_cents(p), "canonical_refund_cents": X.canonical_refund_cents(p),
        "order_date_text": X.labelled_date(p, ["Order placed", "Ordered on", "Order date"]), "card_last4": X.card_last4(p), "payment_lines": X.payment_evidence(p)})
    cancelled = F.coalesce(X.terminal_cancelled(p, F.col("order_id"), F.lit(False)), F.lit(False))
    return out.withColumn("terminal_cancelled", cancelled).drop("text", "title", "__text", "__lines", "__ids")


def return_facts(captures: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """One row a return page: milestones, stage, status, amounts and words; checkmarks are fused in where given."""
    out, p = X.with_page(captures)
    out = out.withColumn("m", X.milestones(p))
    out = out.withColumns({
        "refund_cents": X.refund_cents(p), "refund_subtotal_cents": X.refund_subtotal_cents(p), "expected_credit_date": F.col("m.expected_credit_date"), "card_last4": X.card_last4(p),
        "text_stage": F.col("m.stage"), "affirmed_stage": X.affirmed_stage(p, F.col("m.stage")),
        "strong": (F.col("m.stage") != "unknown") | p.text.rlike(X.CHECK_STATUS)})
    out = fuse_checkmarks(out, checks) if checks is not None else out.withColumn("stage", F.col("text_stage"))
    return out.withColumns({"status": X.record_status(F.col("stage"), p, F.lit("return")), "status_text": X.status_text(F.col("text_stage"), p)}).drop("__text", "__lines")


def fuse_checkmarks(pages: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds stage from text_stage and visible checkmarks.

    A checkmark counts if it is bound to exactly one step label; it completes that step and those before. Where a sentence
    proves a step (affirmed_stage, or text_stage without that column), it also caps what checkmarks may claim: pages draw
    all steps in advance.
    """
    of_label = F.create_map(*[F.lit(v) for s, ls in X.STEP_LABELS.items() for l in ls for v in (l.lower(), schema.RETURN_STAGES[s])])
    known = F.filter(F.array_distinct(F.transform("labels", lambda x: F.try_element_at(of_label, F.lower(F.trim(x))))), lambda r: r.isNotNull())
    by = checks.where("NOT coalesce(hidden, false)").withColumn("k", known).where(F.size("k") == 1).groupBy("page_id").agg(F.max(F.get("k", F.lit(0))).alias("check_rank"))
    rank = schema.stage_rank(F.col("text_stage"))
    cap = schema.stage_rank(F.col("affirmed_stage")) if "affirmed_stage" in pages.columns else rank
    most = F.greatest(rank, F.coalesce("check_rank", F.lit(0)))
    fused = F.when(cap > 0, F.least(most, cap)).otherwise(most)
    return pages.join(by, "page_id", "left").withColumn("stage", schema.stage_name(fused)).drop("check_rank")


def replacement_facts(blocks: DataFrame) -> DataFrame:
    """Per (account, order, asin) the strongest replacement evidence of its blocks; the later one on equal rank, flags or-ed."""
    r = blocks.withColumn("r", X.replacement(F.col("text"))).where("r.stage IS NOT NULL")
    return stronger_replacement(r.select("account_id", "order_id", "asin", "page_id", "block_id", "r.*"), ["account_id", "order_id", "asin"])


def stronger_replacement(evidence: DataFrame, key: list[str]) -> DataFrame:
    return evidence.groupBy(*key).agg(*strongest(F.struct("stage", "status_text", "no_return_required"), "replacement_text", "no_return_required", "page_id", "block_id"))


def strongest(evidence: Column, text: str, free: str, *order: str) -> list[Column]:
    """replacement_stage, its text and whether any says that no return is required, of a group's evidence (stage, status_text, no_return_required)."""
    at = F.struct(schema.ranked(evidence["stage"], schema.REPLACEMENT_RANKS), *map(F.col, order))
    words = evidence["status_text"]
    return [F.max_by(evidence["stage"], at).alias("replacement_stage"), F.max_by(words, F.when(words.isNotNull(), at)).alias(text), F.bool_or(evidence["no_return_required"]).alias(free)]


# --- J6: structure --------------------------------------------------------------------------------------------------


def lined(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of `found`, which lie in the block `block_id` of a page, with the blocks around them as `ancestors`, the innermost, their own, last.

    Rows that bring them along, as the anchors of the HTML reader do, need no join.
    """
    if "ancestors" in found.columns:
        return found
    held = blocks.select("page_id", "block_id", F.array_union(F.col("ancestors"), F.array("block_id")).alias("ancestors")).distinct()
    return found.join(held, ["page_id", "block_id"], "left")


def above(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of `found`, which lie in the block `leaf` of a page, once for that block and each block around it (block_id, level 0 the outermost).

    Only blocks that hold such a row are opened up: pages have many more blocks than links.
    """
    line = lined(found.withColumnRenamed("leaf", "block_id"), blocks).withColumnRenamed("block_id", "leaf")
    kept = [c for c in line.columns if c != "ancestors"]
    return line.select(*kept, F.posexplode("ancestors").alias("level", "block_id"))


def single_products(products: DataFrame, blocks: DataFrame) -> DataFrame:
    """page_id, block_id, asin, item_name: the blocks that hold a single product."""
    held = above(products.select("page_id", F.col("block_id").alias("leaf"), "asin", "item_name", *([c for c in products.columns if c == "ancestors"])), blocks)
    g = held.groupBy("page_id", "block_id").agg(F.min("asin").alias("asin"), F.max("asin").alias("__last"), F.min("item_name").alias("item_name"))
    return g.where(F.col("asin") == F.col("__last")).drop("__last")


def said(text: Column, *words: str) -> Column:
    """Whether a text may say one of the words, given in lower case: a search that is cheap beside a pattern."""
    return bound(F.lower(text), lambda even: reduce(lambda a, b: a | b, [even.contains(w) for w in words]))


def scope_order_cards(blocks: DataFrame, anchors: DataFrame, longest: int = 12_000) -> DataFrame:
    """page_id, order_id, block_id: the block that is an order's card.

    Blocks that name several orders never are. Best: blocks with order date, total and a product or a fulfilment line;
    then those with the detail link and a product; then the smallest text.
    """
    t = F.col("text")
    # exploded, so that a text is searched once and not again for a filter
    one = F.explode(bound(X.order_ids(t), lambda ids: F.when(F.size(ids) == 1, ids)))
    named = blocks.where(~F.coalesce("hidden", F.lit(False)) & (F.length("text") <= longest)).select("page_id", "block_id", "depth", "text", one.alias("order_id"))
    # what a block's text says is read off before rows are dealt by page, so no text travels
    ids = named.select(
        "page_id", "block_id", "depth", "order_id", F.length("text").alias("chars"), (t.rlike("(?i)order placed") & t.rlike("(?i)total")).alias("named"),
        t.rlike("(?i)delivered|arriving|shipped|cancell?ed").alias("moved"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    links = anchors.withColumns({"product": yes(F.col("href").rlike(ASIN_HREF)), "detail": yes(F.col("href").rlike(X.DETAIL_ROUTE))}).where("product OR detail")
    # an anchor counts for its block and all ancestors of it
    around = lambda c: F.array_distinct(F.flatten(F.collect_list(F.when(F.col(c), F.col("ancestors"))))).alias(c)
    held = lined(links.select("page_id", "block_id", "product", "detail", *([c for c in anchors.columns if c == "ancestors"])), blocks).groupBy("page_id").agg(around("product"), around("detail"))
    inside = lambda c: yes(F.array_contains(c, F.col("block_id")))
    j = ids.join(held, "page_id", "left").withColumns({"product": inside("product"), "detail": inside("detail")})
    full = F.col("named") & (F.col("product") | F.col("moved"))
    w = W.partitionBy("page_id", "order_id").orderBy(full.desc(), (F.col("detail") & F.col("product")).desc(), "chars", F.col("depth").desc(), "block_id")
    return j.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("page_id", "order_id", "block_id")


def exclude_recommendation_anchors(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Anchors outside of advertisements.

    Those inside a footer, an aside, a block whose class or id speaks of recommendations or whose attributes mark a carousel
    go, at any depth. So do those with a block of at most 4,500 characters, among the five nearest, whose text says that
    it advertises.
    """
    attr = lambda name: F.try_element_at("attrs", F.lit(name))
    marked = F.coalesce(F.col("css_class").rlike(AD_MARK) | F.col("css_class").rlike(AD_CLASS), F.lit(False)) | F.coalesce(attr("id").rlike(AD_MARK) | (attr("id") == "rhf"), F.lit(False))
    marked = marked | F.col("tag").isin("footer", "aside") | F.exists(F.map_keys("attrs"), lambda k: k.contains("carousel"))
    told = (F.length("text") <= AD_TEXT_CHARS) & said(F.col("text"), *AD_TEXT_WORDS) & F.col("text").rlike(AD_TEXT)
    ads = blocks.select("page_id", "block_id", F.coalesce(marked, F.lit(False)).alias("marked"), F.coalesce(told, F.lit(False)).alias("told")).where("marked OR told")
    of_page = ads.groupBy("page_id").agg(F.collect_set(F.when(F.col("marked"), F.col("block_id"))).alias("__marked"), F.collect_set(F.when(F.col("told"), F.col("block_id"))).alias("__told"))
    near = F.slice(F.reverse("ancestors"), 1, AD_TEXT_LEVELS)
    inside = F.arrays_overlap("ancestors", "__marked") | F.arrays_overlap(near, "__told")
    return lined(anchors, blocks).join(of_page, "page_id", "left").where(~F.coalesce(inside, F.lit(False))).select(*anchors.columns)


def anchor_name() -> Column:
    """First usable name of an anchor: text, title, aria label, image text; 3 to 500 characters and no action label."""
    names = F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("text", "title", "aria_label", "img_alt")])
    return F.get(F.filter(names, lambda n: F.length(n).between(3, 500) & ~n.rlike(ACTION_LABEL)), F.lit(0))


def product_links(anchors: DataFrame) -> DataFrame:
    """page_id, pos, block_id, asin, item_name and ancestors, if known: all anchors that lead to a product."""
    x = anchors.withColumns({"asin": F.upper(X.found(F.col("href"), ASIN_HREF)), "item_name": anchor_name()}).where("asin IS NOT NULL")
    return x.select("page_id", "pos", "block_id", "asin", "item_name", *([c for c in anchors.columns if c == "ancestors"]))


def product_anchors(anchors: DataFrame, most: int = schema.MAX_NAMES) -> DataFrame:
    """product_links(): the first named anchor of each ASIN on a page, `most` at most (a limit of the feature)."""
    first = W.partitionBy("page_id", "asin").orderBy(F.col("item_name").isNull(), "pos")
    once = product_links(anchors).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return once.withColumn("__k", F.row_number().over(W.partitionBy("page_id").orderBy("pos"))).where(F.col("__k") <= most).drop("__k")


def order_line_items(cards: DataFrame, blocks: DataFrame, products: DataFrame, most: int = schema.MAX_ITEMS) -> DataFrame:
    """One row (page, order, asin): longest name, first quantity, amount from a label or the block's single price, fulfilment line, strongest
    replacement evidence of its blocks. `products` are all links to products (product_links): an item may have several in a card.
    """
    text = blocks.select("page_id", "block_id", "text")
    own = lined(products, blocks).join(cards.withColumnRenamed("block_id", "__card"), "page_id").where(F.array_contains("ancestors", F.col("__card"))).drop("ancestors", "__card")
    j, p = X.with_page(own.join(text, ["page_id", "block_id"]))
    prices = F.array_distinct(F.regexp_extract_all("text", F.lit(X.MONEY), F.lit(1)))
    amount = F.coalesce(X.labelled_money(p, ["Item price", "Price"]), F.when(F.size(prices) == 1, X.cents(F.get(prices, F.lit(0)))))
    x = j.withColumns({"quantity": X.found(F.col("text"), r"(?i)\b(?:qty|quantity)\s*:?\s*(\d{1,3})\b").cast("int"), "item_amount_cents": amount, "fulfillment_status": F.substring(X.first_line(p.lines, r"^(?:delivered|arriving|shipped|out for delivery|not yet shipped|cancell?ed)\b"), 1, 180), "__r": X.replacement(p)})
    g = x.groupBy("page_id", "order_id", "asin").agg(
        F.max_by("item_name", F.struct(F.length("item_name"), (-F.col("pos")).alias("p"))).alias("item_name"), F.min_by("quantity", F.when(F.col("quantity").isNotNull(), F.col("pos"))).alias("quantity"),
        F.min_by("item_amount_cents", F.when(F.col("item_amount_cents").isNotNull(), F.col("pos"))).alias("item_amount_cents"), F.min_by("fulfillment_status", F.when(F.col("fulfillment_status").isNotNull(), F.col("pos"))).alias("fulfillment_status"), F.min("pos").alias("pos"),
        *strongest(F.col("__r"), "replacement_status_text", "replacement_no_return_required", "pos"))
    g = g.withColumn("replacement_source", F.when(F.col("replacement_stage").isNotNull(), REPLACEMENT_SOURCE))
    return g.withColumn("__k", F.row_number().over(W.partitionBy("page_id", "order_id").orderBy("pos", "asin"))).where(F.col("__k") <= most).drop("__k")


def return_item_entries(blocks: DataFrame, products: DataFrame) -> DataFrame:
    """Blocks that describe a returned item: page_id, block_id, asin, item_name, strong, score; the best one for each ASIN, then each name.

    A block's data-asin, or the only product inside it, binds its ASIN strongly.
    """
    b = blocks.where(F.length("text").between(8, 3600) & F.col("text").rlike(r"(?i)return|refund|quantity|qty"))
    b = b.select("page_id", "block_id", F.try_element_at("attrs", F.lit("data-asin")).alias("data"), F.length("text").alias("chars"))
    inside = single_products(products, blocks).withColumnRenamed("asin", "p_asin")
    asin = F.coalesce(F.when(F.col("data").rlike("^[A-Z0-9]{10}$"), F.col("data")), F.col("p_asin"))
    x = b.join(inside, ["page_id", "block_id"], "left").withColumns({"asin": asin, "strong": asin.isNotNull()}).where("asin IS NOT NULL OR item_name IS NOT NULL")
    x = x.withColumn("score", F.when(F.col("asin").isNotNull(), 100_000).otherwise(0) + F.when(F.col("strong"), 10_000).otherwise(0) - F.col("chars"))
    best = lambda df, *k: df.withColumn("__n", F.row_number().over(W.partitionBy("page_id", *k).orderBy(F.col("score").desc(), "block_id"))).where("__n = 1").drop("__n")
    return best(best(x, F.coalesce("asin", F.concat(F.lit("block:"), F.col("block_id").cast("string")))), F.coalesce(F.lower("item_name"), "asin")).select("page_id", "block_id", "asin", "item_name", "strong", "score")


def order_detail_links(anchors: DataFrame, host: str = "example.com") -> DataFrame:
    """page_id, order_id, url: the first real detail link of each order on a page, on the host or a subdomain of it."""
    on_host = F.col("href").rlike(rf"(?i)^https?://(?:[^/?#]+\.)?{host.replace('.', chr(92) + '.')}(?:[:/?#]|$)") | F.col("href").startswith("/")
    x = anchors.where(on_host & F.col("href").rlike(X.DETAIL_ROUTE)).withColumn("order_id", X.url_order_id(F.col("href"))).where("order_id IS NOT NULL")
    w = W.partitionBy("page_id", "order_id").orderBy("pos")
    return x.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("page_id", "order_id", F.col("href").alias("url"))


def return_status_links(anchors: DataFrame, blocks: DataFrame, products: DataFrame) -> DataFrame:
    """page_id, order_id, return_token, return_item_id, url, asin, item_name, no_return_required: one row an (order, token, item).

    Explicit status routes or status words count, generic return buttons don't. Names come from the nearest block above
    the link that holds a single product.
    """
    x = anchors.where((F.col("href").rlike(RETURN_HREF) | F.col("text").rlike(RETURN_WORDS)) & ~F.coalesce(F.col("text").rlike(r"(?i)^return or replace"), F.lit(False)))
    own = [F.col("href").alias("url"), X.url_order_id(F.col("href")).alias("order_id"), X.url_return_token(F.col("href")).alias("return_token"), X.url_param(F.col("href"), "itemId").alias("return_item_id")]
    x = x.select("page_id", "pos", "block_id", *own, *([c for c in anchors.columns if c == "ancestors"]))
    one = x.withColumn("__n", F.row_number().over(W.partitionBy("page_id", "order_id", "return_token", "return_item_id").orderBy("pos"))).where("__n = 1").drop("__n")
    key = ["page_id", "pos", "order_id", "return_token", "return_item_id", "url"]
    around = lined(one, blocks).select(*key, F.posexplode_outer("ancestors").alias("level", "block_id")).join(single_products(products, blocks), ["page_id", "block_id"], "left")
    # of the blocks around a link, those further in have a higher level
    near = around.groupBy(*key).agg(F.max(F.when(F.col("asin").isNotNull(), F.struct("level", "asin", "item_name", "block_id"))).alias("near")).select(*key, "near.asin", "near.item_name", "near.block_id")
    # only texts that name a replacement can say so
    told = blocks.where(said(F.col("text"), "replacement", "\r")).where(X.replacement(F.col("text"))["no_return_required"]).select("page_id", "block_id", F.lit(True).alias("free")).distinct()
    out = near.join(told, ["page_id", "block_id"], "left")
    return out.select("page_id", "order_id", "return_token", "return_item_id", "url", "asin", "item_name", F.coalesce("free", F.lit(False)).alias("no_return_required"))


def page_structure(blocks: DataFrame, anchors: DataFrame, host: str = "example.com") -> dict[str, DataFrame]:
    """All structural tables of captured pages."""
    shown = exclude_recommendation_anchors(anchors, blocks)
    products = product_anchors(shown)
    cards = scope_order_cards(blocks, anchors)
    return {"products": products, "cards": cards, "line_items": order_line_items(cards, blocks, product_links(shown)), "return_items": return_item_entries(blocks, products),
            "detail_links": order_detail_links(anchors, host), "return_links": return_status_links(anchors, blocks, products)}


# --- J7 -------------------------------------------------------------------------------------------------------------


def assemble_records(orders: DataFrame, return_pages: DataFrame, return_items: DataFrame, return_links: DataFrame) -> DataFrame:
    """Typed captures of pages, one row a record id and page: orders, authoritative returns, provisional returns.

    A return page gives one record for each item entry, else one for the page. A refund belongs to an item only if the page
    has a single entry; else it is the group's. Links and strong words without a return page give provisional records.
    """
    empty = F.array().cast("array<string>")
    listed = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c))).otherwise(empty)
    no = F.lit(None)

    def shape(df: DataFrame, branch: int, kind: str, provisional: bool, **cols: Column) -> DataFrame:
        get = lambda c, t: cols.get(c, F.col(c) if c in df.columns else no).cast(t)
        names, asins = cols.get("item_names", empty), cols.get("asins", empty)
        rid = X.record_id(F.lit(kind), F.col("order_id"), get("return_token", "string"), get("return_item_id", "string"), asins, names, F.lit(provisional), get("refund_cents", "bigint"))
        return df.select(
            "account_id", "page_id", F.lit(branch).alias("branch"), get("pos", "int").alias("pos"), rid.alias("record_id"), F.lit(kind).alias("record_type"), "order_id", get("return_token", "string").alias("return_token"), get("return_item_id", "string").alias("return_item_id"),
            names.alias("item_names"), asins.alias("asins"), get("purchase_cents", "bigint").alias("purchase_cents"), get("refund_cents", "bigint").alias("refund_cents"), get("group_cents", "bigint").alias("group_refund_cents"), get("scope", "string").alias("refund_scope"),
            get("stage", "string").alias("return_stage"), get("status", "string").alias("status"), get("status_text", "string").alias("status_text"), F.lit(provisional).alias("provisional"), F.lit(kind == "return" and not provisional).alias("authoritative"), get("captured_at", "timestamp").alias("captured_at"))

    entries = return_pages.join(return_items.select("page_id", F.col("block_id").alias("pos"), "asin", "item_name", F.count("*").over(W.partitionBy("page_id")).alias("n_items")), "page_id", "left")
    single = F.coalesce("n_items", F.lit(0)) <= 1
    entries = entries.withColumnRenamed("refund_cents", "page_cents")
    parts = [
        shape(orders.where("order_id IS NOT NULL"), 0, "order", False, status=F.lit("purchase")),
        shape(entries, 1, "return", False, item_names=listed("item_name"), asins=listed("asin"), refund_cents=F.when(single, F.col("page_cents")), group_cents=F.when(~single, F.col("page_cents")), scope=F.when(single, "item").when(F.col("page_cents").isNotNull(), "return")),
        shape(return_links.where("order_id IS NOT NULL AND NOT no_return_required"), 2, "return", True, item_names=listed("item_name"), asins=listed("asin"), stage=F.lit("started"), status=F.lit("return_in_progress"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = W.partitionBy("account_id", "page_id", "record_id").orderBy("branch", F.col("pos").asc_nulls_last())
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "branch", "pos")
