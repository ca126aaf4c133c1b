"""Questions asked of order rows and of the ledger: views, filters, search, sorts, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import schema
from ..functions.arrays import clean_strings
from .rows import KEY, current_orders, replacement_label, stage_label

SORTS = {
    "newest": [F.desc_nulls_last, "sort_at"], "oldest": [F.asc_nulls_first, "sort_at"],
    "order_high": [F.desc_nulls_last, "purchase_cents"], "order_low": [F.asc_nulls_first, "purchase_cents"],
    "refund_high": [F.desc_nulls_last, "refund_cents"], "refund_low": [F.asc_nulls_first, "refund_cents"], "order_id": [F.asc, "order_id"]}


def view(rows: DataFrame, name: str) -> DataFrame:
    """all, returns or needs_review (complete orders only), or errors."""
    done = rows.where("data_complete")
    return {"all": done, "returns": done.where("n_groups > 0"), "needs_review": done.where("needs_review"), "errors": rows.where("processing_error IS NOT NULL")}[name]


def status_condition(value: str) -> Column:
    """all, no_return, needs_review, replacement, cancelled, or any return at the stage that a value of STATUS_FILTERS names.

    no_return means complete orders that are not cancelled; the others hold for incomplete orders too.
    """
    plain = {
        "all": F.lit(True), "no_return": F.col("data_complete") & (F.col("n_groups") == 0) & ~F.col("cancelled"), "needs_review": F.col("needs_review"),
        "replacement": F.col("n_replacements") > 0, "cancelled": F.col("cancelled")}
    return plain[value] if value in plain else F.array_contains("ranks", schema.RETURN_STAGES[schema.STATUS_FILTERS[value]])


def filter_status(rows: DataFrame, value: str) -> DataFrame:
    """Order rows by one of the ten status filters of status_condition()."""
    return rows.where(status_condition(value))


def filter_year_card(rows: DataFrame, year: int | None = None, card: str | None = None) -> DataFrame:
    rows = rows.where(F.col("order_year") == year) if year is not None else rows
    return rows.where(F.col("card_last4") == card) if card is not None else rows


def year_options(rows: DataFrame) -> DataFrame:
    return rows.where("order_year IS NOT NULL").select("order_year").distinct().orderBy(F.desc("order_year"))


def card_options(rows: DataFrame) -> DataFrame:
    return rows.where("card_last4 IS NOT NULL").select("card_last4").distinct().orderBy("card_last4")


def money_text(c: Column) -> Column:
    """Cents as the shortest number of units: 12, 12.5, 12.05; null stays null."""
    size = F.regexp_replace(F.format_string("%d.%02d", F.floor(F.abs(c) / 100), F.abs(c) % 100), r"\.?0+$", "")
    return F.when(c.isNotNull(), F.concat(F.when(c < 0, "-").otherwise(""), size))


def search(rows: DataFrame, query: str) -> DataFrame:
    """Rows that contain the text, in any case: in id, names, ASINs, card, label, shop status, error or amounts."""
    lists = [F.array_join(c, " ") for c in ("search_names", "asins")]
    hay = F.lower(F.concat_ws(" ", "order_id", *lists, "card_last4", "label", "shop_status", "processing_error", money_text(F.col("purchase_cents")), money_text(F.col("refund_cents"))))
    return rows.where(hay.contains(query.strip().lower()))


def sort_rows(rows: DataFrame, mode: str, limit: int | None = None) -> DataFrame:
    """One of eight orders; unknown amounts are lowest; ties and the status order end by order id. `limit` makes it a top-k."""
    if mode == "status":
        out = rows.orderBy(F.lower("label"), *reversed(KEY))
    else:
        how, column = SORTS[mode]
        out = rows.orderBy(how(column), *reversed(KEY))
    return out.limit(limit) if limit is not None else out


def dashboard_stats(rows: DataFrame) -> DataFrame:
    """Complete orders and their total, returns and expected refunds, reviews and their money, errors: one row."""
    done = F.col("data_complete")
    back = done & (F.col("n_groups") > 0)
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    return rows.agg(
        F.count_if(done).alias("n_orders"), total("purchase_cents", done).alias("order_cents"), F.count_if(back).alias("n_return_orders"),
        total("refund_cents", back).alias("expected_cents"), F.count_if("needs_review").alias("n_review"), total("review_cents", F.lit(True)).alias("review_cents"),
        F.count_if(F.col("processing_error").isNotNull()).alias("n_errors"), F.count_if(back & F.col("all_issued")).alias("n_issued"), F.count_if(back & F.col("all_bank_confirmed")).alias("n_bank_credited"))


def review_expected(rows: DataFrame) -> DataFrame:
    """Money under review per order under review."""
    return rows.where("needs_review").select(*KEY, "review_cents")


def ledger_summary(orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Distinct order counts over all records: lifetime, detailed, returned, confirmed, refunded, credited, unresolved; record counts."""
    detailed = F.coalesce("detail_scan_complete", F.lit(False))
    o = orders.select(*KEY, detailed.alias("d"), F.lit(None).cast("int").alias("rank"), F.lit(False).alias("credit"))
    r = returns.select(*KEY, F.lit(False).alias("d"), "rank", F.col("credit_confirmed").alias("credit"))
    # one partial aggregate by order first, so that the distinct counts are plain counts
    by = o.unionByName(r).groupBy(*KEY).agg(
        F.max("d").alias("d"), F.max("rank").alias("rank"), F.max("credit").alias("credit"), F.count("rank").alias("nr"), F.count("*").alias("n"),
        F.min(F.when(F.col("rank").isNotNull(), F.col("credit"))).alias("all_credit"))
    return by.agg(
        F.count("*").alias("lifetime"), F.count_if("d").alias("detailed"), F.count_if(F.col("nr") > 0).alias("returned"), F.count_if(F.col("rank") >= 3).alias("confirmed"),
        F.count_if(F.col("rank") >= 4).alias("refunded"), F.count_if("credit").alias("credited"), F.count_if((F.col("nr") > 0) & ~F.col("all_credit")).alias("unresolved"),
        F.sum(F.col("n") - F.col("nr")).cast("long").alias("order_records"), F.sum("nr").cast("long").alias("return_records"))


def summary_delta(before: DataFrame, after: DataFrame, counters: tuple[str, ...] = ("lifetime", "returned", "refunded", "credited")) -> DataFrame:
    """Difference of counters of two one-row summaries."""
    tagged = before.select(*[(-F.col(c)).alias(c) for c in counters]).unionByName(after.select(*counters))
    return tagged.agg(*[F.sum(c).cast("long").alias(f"{c}_delta") for c in counters])


def compact_summary(orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Counts and money over all orders, complete or not: one row.

    An order's amounts are those of its current record. Money returned is the order's canonical total, else the sum of its refunds; an order
    is under review if a return waits for its credit and none was reconciled by hand, with the refunds of the returns that wait. A
    refund is an amount, else its subtotal, counted once a token, else once an amount with the same ASINs and names; the
    newest record counts.
    """
    full = schema.completed(orders, {"canonical_refund_cents": "bigint", "purchase_cents": "bigint"})
    o = current_orders(full).select(*KEY, "purchase_cents", "canonical_refund_cents")
    r = schema.completed(returns, schema.RETURN_COLUMNS).withColumn("amount", F.coalesce("refund_cents", "refund_subtotal_cents"))
    items = F.array_join(F.transform(F.concat(clean_strings(F.col("asins")), clean_strings(F.col("item_names"))), F.lower), "|")
    once = F.coalesce(F.when(F.col("return_token") != "", F.concat(F.lit("t:"), "return_token")), F.concat_ws(":", F.col("amount").cast("string"), items))
    newest, waits = F.struct("last_scanned_at", "record_id"), F.coalesce("credit_review", F.lit(False))
    first = lambda cond: F.max_by("amount", F.when(cond & F.col("amount").isNotNull(), newest))
    r = r.groupBy(*KEY, once.alias("k")).agg(
        first(F.lit(True)).alias("refund"), first(waits).alias("waiting"), F.bool_or(waits).alias("review"), F.bool_or(F.coalesce(F.col("manual_state") == "reconciled", F.lit(False))).alias("by_hand"))
    by = r.groupBy(*KEY).agg(F.sum("refund").alias("refund"), F.sum("waiting").alias("waiting"), F.bool_or("review").alias("review"), F.bool_or("by_hand").alias("by_hand"))
    j = o.join(by.withColumn("has_return", F.lit(True)), KEY, "full_outer")
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("long")
    has, review = F.coalesce("has_return", F.lit(False)), F.coalesce(F.col("review") & ~F.col("by_hand"), F.lit(False))
    return j.agg(
        F.count("*").alias("n_all"), total(F.col("purchase_cents"), F.lit(True)).alias("all_cents"), F.count_if(has).alias("n_returns"),
        total(F.coalesce("canonical_refund_cents", "refund"), has).alias("return_cents"), F.count_if(review).alias("n_review"), total(F.col("waiting"), review).alias("review_cents"))


def product_status_table(states: DataFrame) -> DataFrame:
    """Per purchased item: what became of it, in words."""
    many = F.when(F.col("n_groups") > 1, F.concat(F.col("n_groups").cast("string"), F.lit(" returns · "))).otherwise("")
    back = F.when(F.col("n_groups") > 0, F.concat(many, stage_label(F.col("best_rank"))))
    swap = F.when(F.col("replacement_stage").isNotNull(), replacement_label(F.col("replacement_stage")))
    label = F.concat_ws(" · ", swap, back)
    return states.select(*KEY, "item_key", "item_name", F.when(label == "", "Not returned").otherwise(label).alias("workflow"))
