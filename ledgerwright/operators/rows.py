"""From ledger records to one row an order: deduplication, grouping, item matching, roll-ups, flags.

All windows, groups and joins are keyed by (account_id, order_id), so orders, returns and items are each shuffled once; every
window ends in a unique column. Order keys hold a bounded number of records each, so no group grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import returns as R, schema
from ..functions.arrays import bound, clean_strings, distinct_ci
from ..functions.text import DETAIL_ROUTE

KEY = ["account_id", "order_id"]
STRINGS = "array<string>"


def current_orders(ledger: DataFrame) -> DataFrame:
    """One order record an order: a complete detail capture first, then the newest, then the smallest record id."""
    w = W.partitionBy(*KEY).orderBy(F.coalesce("detail_scan_complete", F.lit(False)).desc(), F.col("last_scanned_at").desc_nulls_last(), "record_id")
    return ledger.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def filled(c: Column) -> Column:
    """The text, or null if it is blank."""
    return F.when(F.trim(c) != "", c)


def group_key() -> Column:
    return F.coalesce(filled(F.col("return_token")), filled(F.col("return_status_url")), F.col("record_id"))


def identity_key() -> Column:
    first = lambda c: filled(F.get(F.col(c), F.lit(0)))
    return F.lower(F.concat_ws(":", group_key(), F.coalesce(filled(F.col("return_item_id")), first("asins"), first("item_names"), F.col("record_id"))))


def prepared_returns(returns: DataFrame, now: str) -> DataFrame:
    """Returns with all columns of a return record, stage, rank, bank columns and the review rule as of `now`; step_dates come from milestones."""
    if "return_milestones" in returns.columns and "step_dates" not in returns.columns:
        returns = returns.withColumn("step_dates", F.array(*[filled(F.col(f"return_milestones.{n}.date")) for n in schema.STAGE_NAMES[1:]]))
    return R.needs_credit_review(R.bank_columns(R.with_stage(schema.completed(returns, schema.RETURN_COLUMNS))), now)


def dedupe_returns(returns: DataFrame) -> DataFrame:
    """One record a return identity: the furthest stage, then the newest, then the smallest record id. Adds group_key, identity.

    Records are dealt by (account, order) once, which group_returns() reuses. The window's own shuffle would first sort all records
    in the tasks that made them, to drop next to none, and grouping would shuffle them again.
    """
    keyed = schema.completed(returns, schema.RETURN_COLUMNS).withColumns({"group_key": group_key(), "identity": identity_key()}).repartition(*KEY)
    w = W.partitionBy(*KEY, "identity").orderBy(F.col("rank").desc(), F.col("last_scanned_at").desc_nulls_last(), "record_id")
    return keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def record_columns() -> dict[str, Column]:
    """What grouping reads of a return: whether it names its items by a trusted link, its refund, and the parts that the refund may be."""
    refund = F.coalesce("refund_cents", "refund_subtotal_cents")
    return {
        "trusted": F.coalesce(F.col("item_identity_source") == schema.TRUSTED_SOURCE, F.lit(False)) & ((F.size("item_names") > 0) | (F.size("asins") > 0)), "refund": refund,
        "explicit": F.coalesce("group_refund_cents", F.when(F.col("refund_scope") == "return", refund)), "of_item": F.when(F.col("refund_scope") == "item", refund)}


def trusted_list(held: Column, c: str) -> Column:
    """Distinct names or ASINs of a group's records: of the trusted ones if there are any."""
    use = F.when(F.exists(held, lambda x: x["trusted"]), F.filter(held, lambda x: x["trusted"])).otherwise(held)
    return distinct_ci(F.flatten(F.transform(use, lambda x: F.coalesce(x[c], F.array().cast(STRINGS)))))


def group_returns(deduped: DataFrame) -> DataFrame:
    """One row a return group of an order, from prepared and deduplicated returns.

    Names and ASINs come from trusted records if the group has any; seen_asins are those of all its records. The representative has the furthest stage, then is
    newest. amount_cents: the newest group amount (its own column, or the refund of a record that covers the whole return;
    amount_conflict if there are several), else the sum of the items' amounts, else the newest amount, else null; a
    refund falls back to its subtotal. flagged_cents is the same over the records that need a credit review.
    """
    made = record_columns()
    trusted, refund, explicit, of_item = (made[c] for c in ("trusted", "refund", "explicit", "of_item"))
    when = F.struct("last_scanned_at", "record_id")

    def amount(only: Column) -> Column:
        newest = lambda v: F.max_by(v, F.when(only & v.isNotNull(), when))
        return F.coalesce(newest(explicit), F.sum(F.when(only, of_item)), newest(refund)).cast("long")

    lead = F.struct("rank", "last_scanned_at", "record_id", "stage", "bank_status", "manual_state", "expected_credit_at", "step_dates")
    records = lambda *c: F.array_sort(F.collect_list(F.struct("record_id", *c)))
    g = deduped.groupBy(*KEY, "group_key").agg(
        F.count("record_id").alias("n_records"), F.max(lead).alias("lead"),
        records("item_names", "asins", trusted.alias("trusted")).alias("held"), records("status_text").alias("said"), records("card_last4").alias("cards"),
        amount(F.lit(True)).alias("amount_cents"), F.coalesce(F.min(explicit) < F.max(explicit), F.lit(False)).alias("amount_conflict"), amount(F.col("credit_review")).alias("flagged_cents"),
        F.min("rank").alias("low_rank"), F.sort_array(F.collect_set("rank")).alias("ranks"), F.max("last_scanned_at").alias("last_scanned_at"),
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ("identity_conflict", "bank_conflict", "credit_review", "authoritative")],
        F.bool_or(F.coalesce(F.col("manual_state") == "reconciled", F.lit(False))).alias("reconciled"),
        F.bool_and("credit_confirmed").alias("all_confirmed"), F.bool_and("bank_confirmed").alias("all_bank_confirmed"))
    return g.select(
        *KEY, "group_key", "n_records", *[F.col(f"lead.{c}").alias(c) for c in ("record_id", "stage", "rank", "bank_status", "manual_state", "expected_credit_at", "step_dates")],
        trusted_list(F.col("held"), "item_names").alias("item_names"), trusted_list(F.col("held"), "asins").alias("asins"),
        distinct_ci(F.flatten(F.transform("held", lambda x: F.coalesce(x["asins"], F.array().cast(STRINGS))))).alias("seen_asins"), "amount_cents", "amount_conflict", "flagged_cents",
        "identity_conflict", "bank_conflict", "credit_review", "reconciled", "all_confirmed", "all_bank_confirmed", "authoritative", "low_rank", "ranks", "last_scanned_at",
        F.transform("said", lambda x: x["status_text"]).alias("status_texts"), F.get(F.filter(F.transform("cards", lambda x: x["card_last4"]), lambda c: filled(c).isNotNull()), F.lit(0)).alias("card_last4"))


# --- purchased items against return groups ------------------------------------------------------------------------------


def norm_title(name: Column) -> Column:
    """Letters and digits in lower case with single blanks, order ids left out."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r"\d{3}-\d{7}-\d{7}", " ")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def item_struct(pos: Column, **given: Column) -> Column:
    """An item as the row operators hold it: the columns of an item, its position, title and upper-case ASIN."""
    get = lambda c: given.get(c, F.lit(None)).cast(schema.ITEM_COLUMNS[c]).alias(c)
    asin = F.upper(filled(F.trim(get("asin"))))
    return F.struct(pos.cast("int").alias("pos"), get("item_key"), asin.alias("asin"), get("item_name"), get("replacement_stage"), get("replacement_status_text"))


def items_of_orders(items: DataFrame) -> DataFrame:
    """One row an order: items, the list of its purchased items, in order of position and key.

    Items are dealt by order before they are listed: lists begun in the tasks that made the items would hold one or two each.
    """
    full = schema.completed(items, schema.ITEM_COLUMNS)
    each = item_struct(F.coalesce("pos", F.lit(0)), **{c: F.col(c) for c in schema.ITEM_COLUMNS if c != "pos"})
    return full.select(*KEY, each.alias("i")).repartition(*KEY).groupBy(*KEY).agg(F.sort_array(F.collect_list("i")).alias("items"))


def legacy_items(names: Column, asins: Column) -> Column:
    """Items of an order record that only holds names and ASINs: paired if both lists are equally long, names alone otherwise."""
    def build(n: Column) -> Column:
        upper = distinct_ci(F.transform(clean_strings(asins), F.upper))
        asin = lambda i: F.when(F.size(upper) == F.size(n), F.get(upper, i))
        key = lambda x, i: F.coalesce(F.concat(F.lit("asin:"), asin(i)), F.concat(F.lit("title:"), F.substring(norm_title(x), 1, 100)))
        return F.transform(n, lambda x, i: item_struct(i, item_key=key(x, i), asin=asin(i), item_name=x))

    return bound(distinct_ci(names), build)


def title_score(own: Column, titles: Column) -> Column:
    """80 for an equal title, 70 if one title (24 characters and 4 words at least) starts the other, else 0."""

    def near(other: Column) -> Column:
        short, long = F.when(F.length(own) <= F.length(other), own).otherwise(other), F.when(F.length(own) > F.length(other), own).otherwise(other)
        return (F.length(short) >= 24) & (F.size(F.split(short, " ")) >= 4) & long.startswith(short)

    return F.when(own == "", 0).when(F.array_contains(titles, own), 80).when(F.exists(titles, near), 70).otherwise(0)


def best_item(items: Column, asins: Column, names: Column) -> Column:
    """struct<item_key, score> of the only item that scores best against a group and at least 70; key null if there is none.

    A shared ASIN scores 100, titles as title_score() says. Titles are read only where no item shares an ASIN and the group has a title.
    """
    only = lambda keys, score: F.struct(F.when(F.size(keys) == 1, keys[0]).alias("item_key"), score.cast("int").alias("score"))
    same = bound(F.transform(clean_strings(asins), F.upper), lambda a: F.filter(items, lambda i: F.coalesce(F.array_contains(a, i["asin"]), F.lit(False))))
    titles = F.filter(F.transform(clean_strings(names), norm_title), lambda t: t != "")

    def by_title(t: Column) -> Column:
        scored = F.transform(items, lambda i: F.struct(bound(norm_title(i["item_name"]), lambda own: title_score(own, t)).alias("score"), i["item_key"].alias("item_key")))
        best = lambda x: F.array_max(F.transform(x, lambda y: y["score"]))
        picked = bound(scored, lambda x: bound(best(x), lambda b: F.when(b >= 70, only(F.transform(F.filter(x, lambda y: y["score"] == b), lambda y: y["item_key"]), b))))
        return F.when(F.size(t) > 0, picked)

    return bound(same, lambda s: F.when(F.size(s) > 0, only(F.transform(s, lambda i: i["item_key"]), F.lit(100))).otherwise(bound(titles, by_title)))


def match_items_to_groups(items: DataFrame, groups: DataFrame) -> DataFrame:
    """account_id, order_id, group_key, item_key, score: each group with the only item of its order that scores best and at least 70.

    The groups' rank comes with them if they have one, so that item_states() need not join them again.
    """
    rank = [c for c in groups.columns if c == "rank"]
    best = groups.join(items_of_orders(items), KEY).select(*KEY, "group_key", *rank, best_item(F.col("items"), F.col("asins"), F.col("item_names")).alias("m"))
    return best.where("m.item_key IS NOT NULL").select(*KEY, "group_key", *rank, "m.item_key", "m.score")


def unmatched_groups(groups: DataFrame, matches: DataFrame) -> DataFrame:
    """Groups without an item, with strong_identity: whether they name an ASIN."""
    left = groups.join(matches.select(*KEY, "group_key"), [*KEY, "group_key"], "left_anti")
    return left.select(*KEY, "group_key", (F.size("asins") > 0).alias("strong_identity"))


def item_states(items: DataFrame, groups: DataFrame, matches: DataFrame) -> DataFrame:
    """Every purchased item with the number and furthest stage of its return groups, and how many of the order's items returned."""
    ranked = matches if "rank" in matches.columns else matches.join(groups.select(*KEY, "group_key", "rank"), [*KEY, "group_key"])
    attached = ranked.groupBy(*KEY, "item_key").agg(F.count("*").alias("n_groups"), F.max("rank").alias("best_rank"))
    out = items.join(attached, [*KEY, "item_key"], "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))
    returned = F.sum((F.col("n_groups") > 0).cast("long")).over(W.partitionBy(*KEY))
    return out.withColumn("returned_products", returned).withColumn("best_stage", schema.stage_name(F.col("best_rank")))


def replacement_rollup(items: DataFrame) -> DataFrame:
    """Per order: items with a replacement, and the stage of the least advanced one (the first of equally advanced ones)."""
    has = schema.completed(items, schema.ITEM_COLUMNS).where("replacement_stage IS NOT NULL")
    least = F.struct(schema.ranked(F.col("replacement_stage"), schema.REPLACEMENT_RANKS), F.coalesce("pos", F.lit(0)), "item_key", "replacement_stage")
    return has.groupBy(*KEY).agg(F.count("*").alias("n_replacements"), F.min(least)["replacement_stage"].alias("replacement_stage"))


def replacement_label(stage: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in schema.REPLACEMENT_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(stage)), F.lit("Replacement"))


def stage_label(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, schema.STAGE_LABELS)), rank)


# --- the order row ------------------------------------------------------------------------------------------------------


def data_complete(n_authoritative: Column, order: str = "") -> Column:
    """Whether an order is known whole: cancelled for good, or its details are complete and so many returns authoritative as expected."""
    o = lambda c, default: F.coalesce(F.col(f"{order}{c}"), F.lit(default))
    return o("terminal_cancelled", False) | (o("order_data_complete", False) & (F.coalesce(n_authoritative, F.lit(0)) >= o("expected_returns", 0)))


def order_records(orders: DataFrame, returns: DataFrame, now: str) -> DataFrame:
    """The deduplicated returns that count, with data_complete of their order, and a row without a return for each order record `o` (struct).

    Once an order is complete and expects returns, only authoritative ones count.

    Both tables are put together and shuffled once: a window picks the current order and one record a return identity, by
    the rules of current_orders() and dedupe_returns(), and another one tells all rows of an order whether it is complete. An
    order stays on its own row, and a return's columns stay apart, so that only those that a query reads are shuffled and sorted.
    """
    full = schema.completed(orders, schema.ORDER_COLUMNS)
    own = full.select(
        *KEY, F.lit("order").alias("__what"), F.coalesce("detail_scan_complete", F.lit(False)).cast("int").alias("__first"), "last_scanned_at", "record_id",
        F.struct(*schema.ORDER_COLUMNS).alias("o"))
    keyed = prepared_returns(returns, now).withColumns({"group_key": group_key(), "identity": identity_key()})
    added = ["group_key", "identity", "stage", "rank", "bank_confirmed", "credit_confirmed", "bank_conflict", "credit_review"]
    back = keyed.select(*KEY, F.concat(F.lit("return:"), "identity").alias("__what"), F.col("rank").alias("__first"), *schema.RETURN_COLUMNS, *added)
    both = own.unionByName(back, allowMissingColumns=True).repartition(*KEY)
    best = W.partitionBy(*KEY, "__what").orderBy(F.col("__first").desc(), F.col("last_scanned_at").desc_nulls_last(), "record_id")
    once = both.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    whole = W.partitionBy(*KEY)
    judged = F.when(F.col("o").isNotNull(), F.struct(*[F.col(f"o.{c}") for c in ("terminal_cancelled", "order_data_complete", "expected_returns")]))
    shared = once.withColumns({"__o": F.first(judged, ignorenulls=True).over(whole), "__authoritative": F.count_if("authoritative").over(whole)})
    shared = shared.withColumn("data_complete", data_complete(F.col("__authoritative"), "__o."))
    strict = F.col("data_complete") & (F.coalesce("__o.expected_returns", F.lit(0)) > 0)
    used = shared.where(F.col("o").isNotNull() | ~strict | F.coalesce("authoritative", F.lit(False)))
    of_return = lambda c: F.when(F.col("o").isNull(), F.col(c)).alias(c)
    return used.select(*KEY, "o", "data_complete", *[of_return(c) if c in ("record_id", "last_scanned_at") else c for c in [*schema.RETURN_COLUMNS, *added]])


def used_returns(orders: DataFrame, returns: DataFrame, now: str) -> DataFrame:
    """The returns that count in order_rows(), prepared and deduplicated, with data_complete of their order."""
    return order_records(orders, returns, now).where("record_id IS NOT NULL").drop("o")


def runs(sorted_structs: Column, field: str) -> Column:
    """The slices of an array of structs, sorted by a first field, that have the same value there."""
    def cut(rs: Column) -> Column:
        starts = F.filter(F.transform(rs, lambda x, i: F.when((i == 0) | ~x[field].eqNullSafe(F.get(rs, i - 1)[field]), i)), lambda i: i.isNotNull())
        return bound(starts, lambda at: F.transform(at, lambda a, k: F.slice(rs, a + 1, F.coalesce(F.get(at, k + 1), F.size(rs)) - a)))

    return cut(sorted_structs)


def total(values: Column) -> Column:
    """Sum of the values of an array that are not null; null if there is none."""
    return bound(F.filter(values, lambda v: v.isNotNull()), lambda vs: F.when(F.size(vs) > 0, F.aggregate(vs, F.lit(0).cast("long"), lambda a, v: a + v)))


def listed_amount(held: Column) -> Column:
    """The amount of a group's listed records, by the rule of group_returns()."""
    def newest(c: str) -> Column:
        return F.array_max(F.transform(F.filter(held, lambda x: x[c].isNotNull()), lambda x: F.struct(x["last_scanned_at"], x["record_id"], x[c].alias("v"))))["v"]

    return F.coalesce(newest("explicit"), total(F.transform(held, lambda x: x["of_item"])), newest("refund"))


def order_rows(orders: DataFrame, returns: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """The flagship: one row an order that has an order record or a return.

    Joins current orders, the return groups that count, and purchased items (those of the order record's own lists
    where no items are given). Adds completeness, refund roll-up, flags, state, label, the money under review and descriptors.
    ranks lists the stages that any return is at; returns_cents sums the groups' known amounts.
    """
    records = order_records(orders, returns, now).withColumns(record_columns())
    real = F.col("o").isNull() & F.col("record_id").isNotNull()
    only = lambda c: F.when(real, F.col(c))
    held = ["group_key", "record_id", "item_names", "asins", "trusted"]
    listed = lambda *c: F.array_sort(F.collect_list(F.when(real, F.struct(*held, *c))))
    some = lambda c: F.coalesce(F.bool_or(only(c)), F.lit(False)).alias(c)
    low = F.min(only("rank"))
    rolled = records.groupBy(*KEY).agg(
        F.first("o", ignorenulls=True).alias("o"), F.coalesce(F.bool_or("data_complete"), F.lit(False)).alias("data_complete"),
        low.alias("low_rank"), F.max(only("rank")).alias("high_rank"), F.coalesce(low >= 5, F.lit(False)).alias("all_credited"), F.coalesce(low >= 4, F.lit(False)).alias("all_issued"),
        some("identity_conflict"), some("bank_conflict"), F.coalesce(F.bool_or(only("credit_review")), F.lit(False)).alias("any_review"),
        F.coalesce(F.bool_or(real & (F.col("manual_state") == "reconciled")), F.lit(False)).alias("reconciled"), F.coalesce(F.bool_and(only("bank_confirmed")), F.lit(False)).alias("all_bank_confirmed"),
        F.max(only("last_scanned_at")).alias("returns_scanned_at"),
        listed("rank", "last_scanned_at", "credit_review", "refund", "explicit", "of_item").alias("rs"), listed("status_text", "card_last4").alias("texts"))
    placed = rolled.join(items_of_orders(items), KEY, "left")
    placed = placed.withColumns({
        "items": F.when(F.size("items") > 0, F.col("items")).otherwise(legacy_items(F.col("o.item_names"), F.col("o.asins"))), "groups": runs(F.col("rs"), "group_key"),
        "ranks": F.array_sort(F.array_distinct(F.transform("rs", lambda x: x["rank"])))})

    def group(g: Column) -> Column:
        known = F.struct(trusted_list(g, "item_names").alias("item_names"), trusted_list(g, "asins").alias("asins"))
        rank = F.array_max(F.transform(g, lambda x: x["rank"])).alias("rank")
        own = lambda k: best_item(F.col("items"), k["asins"], k["item_names"])["item_key"].alias("item_key")
        return bound(known, lambda k: F.struct(k["item_names"].alias("item_names"), own(k), rank, (F.size(k["asins"]) > 0).alias("strong")))

    cents = lambda only: total(F.transform("groups", lambda g: listed_amount(F.filter(g, only))))
    explicit = lambda g: F.filter(F.transform(g, lambda x: x["explicit"]), lambda c: c.isNotNull())
    grouped = placed.withColumns({
        "gs": F.transform("groups", group), "n_groups": F.size("groups").cast("long"), "returns_cents": cents(lambda x: F.lit(True)), "flagged_cents": cents(lambda x: x["credit_review"]),
        "amount_conflict": F.exists("groups", lambda g: F.size(F.array_distinct(explicit(g))) > 1)})
    lost = F.filter("gs", lambda g: g["item_key"].isNull())
    grouped = grouped.withColumns({"n_unmatched": F.size(lost).cast("long"), "strong_unmatched": F.exists(lost, lambda g: g["strong"])})
    return review_money(state_and_label(needs_review(described(grouped))))


def described(rolled: DataFrame) -> DataFrame:
    """Plain columns of an order row from its order `o`, items, groups `gs` and the `texts` of their records, with names, ASINs, status words and links."""
    o = lambda c: F.col(f"o.{c}")
    gathered = lambda c, of="texts": F.flatten(F.transform(of, lambda g: F.coalesce(g[c], F.array().cast(STRINGS))))
    replaced = F.filter("items", lambda i: i["replacement_stage"].isNotNull())
    least = F.array_min(F.transform("replaced", lambda i: F.struct(schema.ranked(i["replacement_stage"], schema.REPLACEMENT_RANKS), i["pos"], i["item_key"], i["replacement_stage"].alias("stage"))))
    best = lambda i: F.array_max(F.transform(F.filter("gs", lambda g: g["item_key"] == i["item_key"]), lambda g: g["rank"]))
    said = F.concat(F.transform("replaced", lambda i: F.coalesce(filled(i["replacement_status_text"]), replacement_label(i["replacement_stage"]))), F.transform("texts", lambda x: x["status_text"]))
    bought = distinct_ci(F.transform("items", lambda i: i["item_name"]))
    url = o("order_details_url")
    x = rolled.withColumns({
        "replaced": replaced, "bought": bought, "returned_names": distinct_ci(gathered("item_names", "gs")),
        "became": F.transform("items", lambda i: F.struct(i["item_name"].alias("name"), best(i).alias("rank")))})
    x = x.withColumns({"order_names": F.when(F.size("bought") > 0, F.col("bought")).otherwise(distinct_ci(o("item_names"))), "said": F.array_join(distinct_ci(said), " · "), "least": least})
    returns_cents, refund = F.col("returns_cents"), o("canonical_refund_cents")
    scanned = F.greatest(o("last_scanned_at"), F.col("returns_scanned_at"))
    return x.select(
        *KEY, "data_complete", F.coalesce(o("terminal_cancelled"), F.lit(False)).alias("cancelled"), filled(o("processing_error")).alias("processing_error"), o("processing_state").alias("processing_state"),
        o("purchase_cents").alias("purchase_cents"), F.coalesce(filled(o("card_last4")), F.get(F.filter(F.transform("texts", lambda g: g["card_last4"]), lambda c: filled(c).isNotNull()), F.lit(0))).alias("card_last4"),
        "n_groups", "n_unmatched", F.size("items").cast("long").alias("n_items"), F.size(F.filter("became", lambda i: i["rank"].isNotNull())).cast("long").alias("n_returned_items"),
        F.size("replaced").cast("long").alias("n_replacements"), F.col("least.stage").alias("replacement_stage"),
        F.coalesce(refund, returns_cents).cast("long").alias("refund_cents"), returns_cents.cast("long").alias("returns_cents"), F.coalesce("flagged_cents", F.lit(0)).cast("long").alias("flagged_cents"),
        F.coalesce(returns_cents > refund + schema.TOLERANCE_CENTS, F.lit(False)).alias("amount_mismatch"), "identity_conflict", "amount_conflict", "bank_conflict", "strong_unmatched",
        "any_review", "all_issued", "all_credited", "all_bank_confirmed", "reconciled", "low_rank", "high_rank", "ranks",
        F.year(o("order_date")).alias("order_year"), F.coalesce(o("order_date").cast("timestamp"), scanned).alias("sort_at"), scanned.alias("last_scanned_at"),
        F.when(F.size("order_names") > 0, F.col("order_names")).otherwise(F.col("returned_names")).alias("item_names"), "returned_names", distinct_ci(F.concat("order_names", "returned_names")).alias("search_names"),
        distinct_ci(F.concat(F.coalesce(o("asins"), F.array().cast(STRINGS)), F.transform("items", lambda i: i["asin"]), gathered("asins"))).alias("asins"),
        F.coalesce(filled(F.col("said")), filled(o("status_text")), filled(o("status")), F.lit("—")).alias("shop_status"), o("status_text").alias("order_status_text"),
        F.coalesce(o("detail_scan_complete"), F.lit(False)).alias("detail_complete"), F.when(url.rlike(DETAIL_ROUTE), url).otherwise("").alias("open_url"),
        F.transform("became", lambda i: F.concat(i["name"], F.lit(" => "), F.coalesce(stage_label(i["rank"]), F.lit("Not returned")))).alias("product_statuses"))


def needs_review(rows: DataFrame) -> DataFrame:
    """Adds needs_review: a complete, not reconciled order with a return that waits, or whose evidence disagrees."""
    odd = F.col("any_review") | F.col("amount_mismatch") | F.col("identity_conflict") | F.col("amount_conflict") | F.col("strong_unmatched") | F.col("bank_conflict")
    return rows.withColumn("needs_review", F.col("data_complete") & (F.col("n_groups") > 0) & ~F.col("reconciled") & odd)


def state_and_label(rows: DataFrame) -> DataFrame:
    """Adds state and label by precedence; a return's label is that of its least advanced record."""
    has = F.col("n_groups") > 0
    state = (
        F.when(~F.col("data_complete") & F.col("processing_error").isNotNull(), "error").when(~F.col("data_complete"), "processing")
        .when(F.col("cancelled") & ~has, "cancelled").when(F.col("reconciled"), "reconciled").when(F.col("needs_review"), "needs_review")
        .when(F.col("all_credited"), "credited").when(F.col("all_issued"), "refund_issued").when(has, "return").when(F.col("n_replacements") > 0, "replacement").otherwise("purchase"))
    lowest = stage_label(F.col("low_rank"))
    reason = (
        F.when(F.col("amount_mismatch"), "Refund amount mismatch").when(F.col("identity_conflict"), "Item needs review").when(F.col("amount_conflict"), "Return refund needs review")
        .when(F.col("strong_unmatched"), "Returned item needs matching").when(F.col("bank_conflict"), "Bank/shop status conflict").otherwise(lowest))
    s = F.col("state")
    label = (
        F.when(s == "error", "Processing error").when((s == "processing") & (F.col("processing_state") == "retrying"), "Retrying").when(s == "processing", "Processing")
        .when(s == "cancelled", "Cancelled").when(s == "reconciled", "Reconciled").when(s == "needs_review", reason).when(s == "credited", "Shop credited")
        .when(s == "refund_issued", "Refund issued").when(s == "return", lowest).when(s == "replacement", replacement_label(F.col("replacement_stage")))
        .otherwise(F.coalesce(filled(F.col("order_status_text")), F.when(F.col("detail_complete"), "Order details captured").otherwise("Order discovered"))))
    return rows.withColumn("state", state).withColumn("label", label)


def review_money(rows: DataFrame) -> DataFrame:
    """Adds review_cents of rows under review: the amounts of their flagged returns, or the row's refund where amounts or identities disagree."""
    broken = F.col("amount_mismatch") | F.col("amount_conflict") | F.col("identity_conflict") | F.col("strong_unmatched")
    money = F.coalesce(F.when(broken, F.col("refund_cents")), F.col("flagged_cents"))
    return rows.withColumn("review_cents", F.when(F.col("needs_review"), money)).drop("flagged_cents", "order_status_text")


ROW_DESCRIPTORS = ["shop_status", "last_scanned_at", "order_year", "sort_at", "item_names", "returned_names", "asins", "card_last4", "detail_complete", "open_url"]


def row_descriptors(rows: DataFrame) -> DataFrame:
    """The descriptive columns of order rows."""
    return rows.select(*KEY, *ROW_DESCRIPTORS)


def lifecycle_steps(groups: DataFrame) -> DataFrame:
    """Five rows a group: step number, name, label, whether done, and the date its representative's milestones give (text as the page has it).

    The last one, while it's open, has the expected date and names it in its label.
    """
    # Names of the steps.
    names = ["Initiated", "Dropped off", "Return received", "Refund issued", "Refund credited"]
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), F.lit(names[k - 1]).alias("label")) for k, n in enumerate(schema.STAGE_NAMES) if k])
    x = groups.select(*KEY, "group_key", "rank", "expected_credit_at", "bank_status", "step_dates", F.explode(steps).alias("s"))
    eta = F.when((F.col("s.step") == 5) & (F.col("rank") < 5), F.col("expected_credit_at"))
    return x.select(
        *KEY, "group_key", F.col("s.step").alias("step"), F.col("s.name").alias("name"), (F.col("s.step") <= F.col("rank")).alias("done"),
        F.when(eta.isNotNull(), F.concat(F.lit("Expected "), F.date_format(eta, "yyyy-MM-dd"))).otherwise(F.col("s.label")).alias("label"), filled(F.get("step_dates", F.col("s.step") - 1)).alias("date"),
        eta.alias("expected_at"), F.when(F.col("s.step") == 5, F.col("bank_status")).alias("bank_status"))
