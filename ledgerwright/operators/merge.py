"""Merging captures into the ledger: last non-empty value wins, a return's stage never falls, weak evidence never replaces strong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import schema, text
from ..functions.arrays import clean_strings, distinct_ci
from ..sources.shared import brief_shuffles, removed

ID = ["account_id", "record_id"]
STAGE_COLUMNS = ("status", "return_stage", "status_text")
#: Columns that a merge or scan writes about itself; they don't make a record differ.
BOOKKEEPING = {"first_seen_at", "last_scanned_at", "detail_scanned_at", "captured_at", "batch_id", "seq", "updated_at", "source_url"}


def monotonic_stage(captures: DataFrame) -> DataFrame:
    """Adds rank, best_before (highest rank of earlier captures of the record) and accepted: rank >= best_before."""
    w = W.partitionBy(*ID).orderBy("batch_id", "seq").rowsBetween(W.unboundedPreceding, -1)
    ranked = captures.withColumn("rank", schema.stage_rank(F.col("return_stage"))).withColumn("best_before", F.coalesce(F.max("rank").over(w), F.lit(0)))
    return ranked.withColumn("accepted", F.col("rank") >= F.col("best_before"))


def filled(c: str, kind: str) -> Column:
    return F.col(c).isNotNull() & ((F.trim(c) != "") if kind == "string" else F.lit(True))


def merge_latest(captures: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """One row a record: per column the last non-empty value, in order of (batch_id, seq).

    Stage columns only take values of captures whose stage didn't fall, and a status only gives way to one of at least
    its own rank. A given ledger (same columns) counts as
    the oldest capture. No list of captures is gathered: every column is a max_by, combined in each task first.
    """
    rows = captures if ledger is None else captures.unionByName(ledger.withColumns({"batch_id": F.lit(-1).cast("long"), "seq": F.lit(0).cast("long")}), allowMissingColumns=True)
    at = F.struct("batch_id", "seq")
    marked = monotonic_stage(rows)
    kinds = dict(rows.dtypes)
    made = []
    for c in rows.columns:
        if c in (*ID, "batch_id", "seq"):
            continue
        if c == "authoritative":  # once authoritative, always: a later provisional capture must not hide the return
            made.append(F.bool_or(F.coalesce(c, F.lit(False))).alias(c))
            continue
        take = filled(c, kinds[c]) & (F.col("accepted") if c in STAGE_COLUMNS else F.lit(True))
        order = F.struct(schema.ranked(F.col(c), schema.STATUS_RANKS), at) if c == "status" else at
        made.append(F.max_by(c, F.when(take, order)).alias(c))
    out = marked.groupBy(*ID).agg(*made)
    return out.withColumn("provisional", ~F.col("authoritative")) if {"authoritative", "provisional"} <= set(out.columns) else out


def merge_milestones(captures: DataFrame, milestones: str = "return_milestones") -> DataFrame:
    """Milestones of each record: a step is done once any capture says so, its date is the newest known, the credit date only counts
    once credited, the stage is the furthest, the expected date the newest known."""
    at = F.struct("batch_id", "seq")
    steps = ("started", "shipped", "received", "refund_issued", "credited")
    m = lambda f: F.col(f"{milestones}.{f}")
    newest = lambda c: F.max_by(c, F.when(c.isNotNull() & (c != ""), at))
    g = captures.where(F.col(milestones).isNotNull()).groupBy(*ID).agg(
        F.max(schema.stage_rank(m("stage"))).alias("rank"), newest(m("expected_credit_date")).alias("eta"),
        *[F.bool_or(F.coalesce(m(f"{s}.done"), F.lit(False))).alias(f"{s}_done") for s in steps], *[newest(m(f"{s}.date")).alias(f"{s}_date") for s in steps])
    shown = lambda s: F.when(F.col("credited_done"), F.col("credited_date")) if s == "credited" else F.col(f"{s}_date")
    parts = [F.struct(F.col(f"{s}_done").alias("done"), shown(s).alias("date")).alias(s) for s in steps]
    return g.select(*ID, F.struct(schema.stage_name(F.col("rank")).alias("stage"), F.col("eta").alias("expected_credit_date"), *parts).alias(milestones))


def merge_items(captures: DataFrame) -> DataFrame:
    """Order items of each record: those of the newest complete detail capture; without one, the newest list there is."""
    at = F.struct(F.coalesce("detail_scan_complete", F.lit(False)), "batch_id", "seq")
    return captures.groupBy(*ID).agg(F.max_by("order_items", F.when(F.size("order_items") > 0, at)).alias("order_items"))


def trusted_identity(captures: DataFrame) -> DataFrame:
    """Names, ASINs and conflict flag of each record from its captures in order of (batch_id, seq).

    Each capture adds its names and ASINs; an authoritative one (that has the list) replaces what was there. The first capture
    that came by an order's own return link, with the record's latest return_item_id, ends this for names, and for
    ASINs once there are any. A later capture of the same item whose ASIN is bound strongly, by such a link or by STRONG_EVIDENCE,
    and shares nothing with the fixed ASINs is a conflict.

    What is gathered for a record are its distinct values with their first places, not its captures.
    """
    w = W.partitionBy(*ID)
    order = w.orderBy("batch_id", "seq")
    linked = F.coalesce(F.col("item_identity_source") == schema.TRUSTED_SOURCE, F.lit(False))
    rows = captures.withColumn("__n", F.row_number().over(order)).withColumn("__item", F.last("return_item_id", True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    same = F.col("return_item_id").isNotNull() & (F.col("return_item_id") == F.col("__item"))
    rows = rows.withColumns({"__same": same, "__fix": F.min(F.when(linked & same, F.col("__n"))).over(w)})
    until = F.coalesce("__fix", F.lit(1 << 30))
    full = F.coalesce("authoritative", F.lit(False))
    reset = lambda c, last: F.coalesce(F.max(F.when(full & F.col(c).isNotNull() & (F.col("__n") <= last), F.col("__n"))).over(w), F.lit(1))
    rows = rows.withColumns({"__names_from": reset("item_names", until), "__asins_from": reset("asins", until), "__last_from": reset("asins", F.lit(1 << 30))})
    between = lambda first, last: (F.col("__n") >= F.col(first)) & (F.col("__n") <= last)
    kinds = {"names": ("item_names", between("__names_from", until)), "asins": ("asins", between("__asins_from", until)), "open": ("asins", between("__last_from", F.lit(1 << 30)))}

    def placed(kind: str, values: Column) -> Column:
        return F.transform(clean_strings(values), lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("x"), F.col("__n").alias("n"), i.alias("i")))

    listed = [placed(k, F.when(rule, F.col(c))) for k, (c, rule) in kinds.items()]
    each = rows.select(*ID, "__fix", F.explode_outer(F.concat(*listed)).alias("e"))
    distinct = each.groupBy(*ID, "__fix", "e.kind", F.lower("e.x").alias("low")).agg(F.min(F.struct("e.n", "e.i", "e.x")).alias("first"))
    held = distinct.groupBy(*ID, "__fix").agg(F.array_sort(F.collect_list(F.struct("first", "kind"))).alias("all"))
    pick = lambda k: F.transform(F.filter("all", lambda e: e["kind"] == k), lambda e: e["first"]["x"])
    named = held.select(*ID, "__fix", pick("names").alias("item_names"), pick("asins").alias("__fixed"), pick("open").alias("__open"))
    named = named.withColumn("asins", F.when(F.col("__fix").isNotNull() & (F.size("__fixed") > 0), F.col("__fixed")).otherwise(F.col("__open")))
    # the captures after the fixed one, held against its ASINs
    upper = lambda c: F.transform(clean_strings(F.col(c)), F.upper)
    strong = (linked | F.coalesce(F.col("item_asin_evidence_source").isin(*schema.STRONG_EVIDENCE), F.lit(False))) & (F.col("__n") > F.col("__fix")) & F.col("__same") & (F.size(clean_strings(F.col("asins"))) > 0)
    later = rows.where(strong).select(*ID, upper("asins").alias("__asins")).join(named.where(F.size("__fixed") > 0).select(*ID, upper("__fixed").alias("__known")), ID)
    odd = later.where(~F.arrays_overlap("__asins", "__known")).select(*ID).distinct().withColumn("__odd", F.lit(True))
    return named.join(odd, ID, "left").select(*ID, "item_names", "asins", F.coalesce("__odd", F.lit(False)).alias("identity_conflict"))


def held_by_batches(captures: DataFrame) -> DataFrame:
    """Captures without those that a later batch's authoritative captures of the same (order, token) superseded.

    A batch that captures returns of a token authoritatively removes every other provisional or authoritative return of the token
    as it was before; what the batch itself and later ones captured of it stays. What is gathered are the batches of
    a token, one number each.
    """
    full = F.coalesce("authoritative", F.lit(False)) & F.col("return_token").isNotNull()
    key = ["account_id", "order_id", "return_token"]
    by_record = captures.where("record_type = 'return'").groupBy(*ID).agg(
        F.max_by("order_id", F.struct("batch_id", "seq")).alias("order_id"), F.max_by("return_token", F.when(F.col("return_token").isNotNull(), F.struct("batch_id", "seq"))).alias("return_token"),
        F.bool_or(F.coalesce("authoritative", F.lit(False)) | F.coalesce("provisional", F.lit(False))).alias("marked"), F.collect_set(F.when(full, F.col("batch_id"))).alias("own"))
    by_token = captures.where(full & (F.col("record_type") == "return")).groupBy(*key).agg(F.collect_set("batch_id").alias("all"))
    since = by_record.where("marked").join(by_token, key).select(*ID, F.array_max(F.array_except("all", "own")).alias("__since"))
    return captures.join(since, ID, "left").where(F.col("__since").isNull() | (F.col("batch_id") >= F.col("__since"))).drop("__since")


def fold_identity(captures: DataFrame) -> DataFrame:
    """item_names, asins, item_identity_source, identity_conflict and the latest conflict's names, ASINs and source of each record.

    Captures count in order of (batch_id, seq). A capture is bound if the record came by an order's own return link and it has the
    record's item id: then it changes neither names nor source, nor ASINs once there are any; strong evidence of other ASINs
    makes it a conflict. Otherwise its lists are added, those of an authoritative return replace what was there.
    Running marks decide all of this row by row, so no captures are gathered, only distinct values with their first places.
    """
    w = W.partitionBy(*ID)
    order = w.orderBy("batch_id", "seq")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    given = lambda c: F.when(F.trim(c) != "", F.col(c))
    rows = captures.select(
        *ID, "batch_id", "seq", "item_names", "asins", given("item_identity_source").alias("source"), given("return_item_id").alias("item"),
        F.coalesce(F.col("item_identity_source") == schema.TRUSTED_SOURCE, F.lit(False)).alias("linked"), (F.coalesce("authoritative", F.lit(False)) & (F.col("record_type") == "return")).alias("full"),
        F.coalesce(F.col("item_asin_evidence_source").isin(*schema.STRONG_EVIDENCE), F.lit(False)).alias("strong"), (F.col("record_type") == "return").alias("is_return"))
    rows = rows.withColumns({"n": F.row_number().over(order), "same": F.coalesce(F.col("item") == F.last("item", True).over(before), F.lit(False)) & F.col("is_return")})
    trusted = F.when(F.col("linked"), True).when(F.col("source").isNotNull() & ~F.col("same"), False)
    rows = rows.withColumn("trust", trusted).withColumn("bound", F.coalesce(F.last("trust", True).over(before), F.lit(False)) & F.col("same"))
    clean_size = F.size(clean_strings(F.col("asins")))
    blank = F.when(clean_size > 0, False).when(F.col("full") & F.col("asins").isNotNull() & ~F.col("bound"), True)
    rows = rows.withColumn("blank", blank).withColumn("empty", F.coalesce(F.last("blank", True).over(before), F.lit(True)))
    rows = rows.withColumns({"take_asins": ~F.col("bound") | F.col("empty"), "source": F.when(F.col("bound"), schema.TRUSTED_SOURCE).otherwise(F.col("source"))})
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    part = lambda c, takes: F.coalesce(F.max(F.when(takes & F.col("full") & F.col(c).isNotNull(), F.col("n"))).over(so_far), F.lit(0))
    rows = rows.withColumns({"names_part": part("item_names", ~F.col("bound")), "asins_part": part("asins", F.col("take_asins"))})
    ends = rows.groupBy(*ID).agg(
        F.max("names_part").alias("names_last"), F.max("asins_part").alias("asins_last"), F.max_by("source", F.when(F.col("source").isNotNull(), F.col("n"))).alias("item_identity_source"))

    def placed(kind: str, c: str, at: str, takes: Column, tests: Column) -> Column:
        mark = F.struct(F.lit(kind).alias("kind"), F.col(at).alias("part"), takes.alias("takes"), tests.alias("tests"))
        return F.transform(clean_strings(F.col(c)), lambda x, i: F.struct(mark.alias("m"), x.alias("x"), i.alias("i")))

    tested = F.col("bound") & (F.col("linked") | F.col("strong")) & ~F.col("empty") & (clean_size > 0)
    each = rows.select(*ID, "n", F.explode(F.concat(placed("names", "item_names", "names_part", ~F.col("bound"), F.lit(False)), placed("asins", "asins", "asins_part", F.col("take_asins"), tested))).alias("e"))
    each = each.select(*ID, "n", "e.m.*", "e.x", "e.i", F.lower("e.x").alias("low")).where("takes OR tests")
    first = F.min(F.when(F.col("takes"), F.col("n"))).over(W.partitionBy(*ID, "kind", "part", "low"))
    each = each.withColumn("first", first)
    distinct = each.where("takes").groupBy(*ID, "kind", "part", "low").agg(F.min(F.struct("n", "i", "x")).alias("v"))
    lists = distinct.join(ends.select(*ID, "names_last", "asins_last"), ID).where(F.col("part") == F.when(F.col("kind") == "names", F.col("names_last")).otherwise(F.col("asins_last")))
    lists = lists.groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("v", "kind"))).alias("all"))
    pick = lambda k: F.coalesce(F.transform(F.filter("all", lambda e: e["kind"] == k), lambda e: e["v"]["x"]), F.array().cast("array<string>"))
    odd = each.where("tests").groupBy(*ID, "n").agg(F.bool_or(F.coalesce(F.col("first") < F.col("n"), F.lit(False))).alias("known")).where("NOT known").groupBy(*ID).agg(F.max("n").alias("n"))
    raw = captures.select(*ID, "item_names", "asins", "item_identity_source", F.row_number().over(order).alias("n"))
    told = odd.join(raw, [*ID, "n"]).select(*ID, F.struct(distinct_ci(F.col("item_names")).alias("item_names"), distinct_ci(F.col("asins")).alias("asins"), F.col("item_identity_source").alias("source")).alias("identity_conflict_incoming"))
    out = ends.join(lists, ID, "left").join(told, ID, "left")
    return out.select(*ID, pick("names").alias("item_names"), pick("asins").alias("asins"), "item_identity_source", F.col("identity_conflict_incoming").isNotNull().alias("identity_conflict"), "identity_conflict_incoming")


def ordered_union(captures: DataFrame, columns: list[str]) -> DataFrame:
    """Each list column of each record: all values of its captures, first ones first, without repeats in another case."""
    def placed(c: str) -> Column:
        return F.transform(clean_strings(F.col(c)), lambda x, i: F.struct(F.lit(c).alias("c"), x.alias("x"), i.alias("i")))

    def picked(c: str) -> Column:
        return F.transform(F.filter("all", lambda e: e["c"] == c), lambda e: e["v"]["x"]).alias(c)

    each = captures.select(*ID, "batch_id", "seq", F.explode(F.concat(*map(placed, columns))).alias("e"))
    distinct = each.groupBy(*ID, "e.c", F.lower("e.x").alias("low")).agg(F.min(F.struct("batch_id", "seq", "e.i", "e.x")).alias("v"))
    held = distinct.groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("all"))
    return held.select(*ID, *map(picked, columns))


#: Columns of a capture that decide about others; a table of captures without one holds nulls there.
EVIDENCE_COLUMNS = {
    "record_type": "string", "order_id": "string", "return_token": "string", "authoritative": "boolean", "provisional": "boolean", "detail_scan_complete": "boolean", "return_item_id": "string",
    "item_identity_source": "string", "item_asin_evidence_source": "string", "item_names": "array<string>", "asins": "array<string>", "return_stage": "string", "status": "string", "status_text": "string",
    "captured_at": "timestamp"}
#: What a user wrote about a record: no capture touches it.
BY_HAND = {"manual_state", "note"}


def merge_captures(captures: DataFrame, versions: bool = False, staged: str | None = None) -> DataFrame:
    """The ledger that a set of captures makes: one row a record, whatever order and batches they arrived in.

    Captures count in order of their own (batch_id, seq), which is unique in a record; the same capture twice counts once. Rules:

    * what a later batch superseded is gone (held_by_batches);
    * a value gives way to the next that isn't null or blank; a return's stage, status and status text only to those of captures
      whose stage didn't fall, a status only to one of at least its rank;
    * names, ASINs and identity follow fold_identity, other lists of texts are united in order;
    * order_items are those of the newest complete order capture that has any, else the first there were;
    * detail_scan_complete and authoritative stay once true; return_milestones are merged step by step;
    * first_seen_at is the time of the first capture, last_scanned_at that of the last; manual_state and note are never taken.

    A field merged so keeps the (batch_id, seq) it came from in the struct `versions`, if asked for. Everything is
    keyed by (account, record): no list of captures is gathered.

    Several steps read the captures. With `staged`, a new folder's path, those that count are written there at once and read from it
    by every step, so that what `captures` costs is paid once; the folder must stay until the result is used.
    """
    rows = schema.completed(captures, {c: k for c, k in EVIDENCE_COLUMNS.items() if c not in captures.columns}).dropDuplicates([*ID, "batch_id", "seq"])
    if staged is not None:
        spark = rows.sparkSession
        with brief_shuffles(spark):
            rows.write.parquet(f"{staged}/all")
            rows = spark.read.schema(rows.schema).parquet(f"{staged}/all")
            held_by_batches(rows).write.parquet(f"{staged}/held")
        removed(spark, f"{staged}/all")
        rows = spark.read.schema(rows.schema).parquet(f"{staged}/held")
    else:
        rows = held_by_batches(rows)
    at = F.struct("batch_id", "seq")
    kinds = dict(rows.dtypes)
    marked = monotonic_stage(rows).withColumn("accepted", F.col("accepted") | (F.col("record_type") != "return") | F.col("record_type").isNull())
    lists = [c for c, k in kinds.items() if k == "array<string>" and c not in ("item_names", "asins", "order_items")]
    apart = {*ID, "batch_id", "seq", "captured_at", "first_seen_at", "last_scanned_at", "item_names", "asins", "item_identity_source", "order_items", "return_milestones", *lists, *BY_HAND}
    made, seen = [], []
    for c in [c for c in rows.columns if c not in apart]:
        if c in ("authoritative", "detail_scan_complete"):
            made.append(F.bool_or(F.coalesce(c, F.lit(False))).alias(c))
            continue
        take = filled(c, kinds[c]) & (F.col("accepted") if c in STAGE_COLUMNS else F.lit(True))
        ranked = F.struct(schema.ranked(F.col(c), schema.STATUS_RANKS), at) if c == "status" else at
        made.append(F.max_by(c, F.when(take, ranked)).alias(c))
        seen.append((F.max(F.when(take, ranked)), c))
    if "order_items" in kinds:
        some = F.size("order_items") > 0
        whole = some & F.coalesce("detail_scan_complete", F.lit(False)) & (F.col("record_type") == "order")
        made.append(F.coalesce(F.max_by("order_items", F.when(whole, at)), F.min_by("order_items", F.when(some, at))).alias("order_items"))
    made += [F.min_by("captured_at", at).alias("first_seen_at"), F.max_by("captured_at", at).alias("last_scanned_at")]
    if versions:
        made.append(F.struct(*[(v["col2"] if c == "status" else v).alias(c) for v, c in seen]).alias("versions"))
    out = marked.groupBy(*ID).agg(*made)
    for part in [fold_identity(rows), *([ordered_union(rows, lists)] if lists else []), *([merge_milestones(rows)] if "return_milestones" in kinds else [])]:
        out = out.join(part, ID, "left")
    return out.withColumn("provisional", F.coalesce("provisional", F.lit(False)) & ~F.col("authoritative"))


def supersede_provisional(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Ledger without the returns that the batch's authoritative captures of the same (order, token) replace.

    Only provisional or authoritative returns go, and only if the batch didn't capture them again.

    Both tables are put together and shuffled twice, by token and by record; a token's rows are those of one order, so no group grows.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    token = ["account_id", "order_id", "return_token"]
    marks = lambda row, may_go, new, fresh: [*ID, *token[1:], row.alias("__row"), may_go.alias("__may_go"), new.alias("__new"), fresh.alias("__fresh")]
    row = F.struct(*[F.col(f"`{c}`") for c in ledger.columns])
    old = ledger.select(*marks(row, yes(F.expr("(provisional OR authoritative) AND record_type = 'return'")), F.lit(False), F.lit(False)))
    new = batch.select(*marks(F.lit(None).cast(old.schema["__row"].dataType), F.lit(False), F.lit(True), yes(F.col("authoritative"))))
    named = F.col("order_id").isNotNull() & F.col("return_token").isNotNull() & F.col("account_id").isNotNull() & F.col("record_id").isNotNull()
    both = old.unionByName(new).withColumn("__gone", named & F.col("__may_go") & F.max("__fresh").over(W.partitionBy(*token)))
    both = both.withColumn("__gone", F.max("__gone").over(W.partitionBy(*ID)) & ~F.max("__new").over(W.partitionBy(*ID)))
    return both.where("__row IS NOT NULL AND NOT __gone").select("__row.*")


def fingerprint(df: DataFrame) -> DataFrame:
    """Adds __fp: hash of all columns that aren't bookkeeping; arrays count as sets."""
    kinds = dict(df.dtypes)
    parts = []
    for c in sorted(set(df.columns) - BOOKKEEPING - set(ID)):
        parts.append(F.coalesce((F.sort_array(c) if kinds[c].startswith("array") else F.col(c)).cast("string"), F.lit("\x00")))
    return df.withColumn("__fp", F.xxhash64(*parts))


def diff_ledger(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per record: inserted, updated, unchanged or removed."""
    a = fingerprint(before).select(*ID, F.col("__fp").alias("old"))
    b = fingerprint(after).select(*ID, F.col("__fp").alias("new"))
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return a.join(b, ID, "full_outer").select(*ID, change.alias("change"))


def keep_scan_time(before: DataFrame, after: DataFrame) -> DataFrame:
    """after, with the old last_scanned_at on unchanged records unless a complete detail capture made them."""
    old = before.select(*ID, F.col("last_scanned_at").alias("__old"))
    same = diff_ledger(before, after).where("change = 'unchanged'").select(*ID, F.lit(True).alias("__same"))
    kept = after.join(same, ID, "left").join(old, ID, "left")
    back = F.coalesce("__same", F.lit(False)) & ~F.coalesce("detail_scan_complete", F.lit(False))
    return kept.withColumn("last_scanned_at", F.when(back, F.col("__old")).otherwise(F.col("last_scanned_at"))).drop("__same", "__old")


def patch_records(ledger: DataFrame, patches: DataFrame) -> DataFrame:
    """ledger with the non-null columns of one patch a record laid over it; patches of unknown records do nothing."""
    own = [c for c in patches.columns if c not in ID]
    p = patches.select(*ID, *[F.col(c).alias(f"__p_{c}") for c in own])
    joined = ledger.join(p, ID, "left")
    laid = {c: F.coalesce(F.col(f"__p_{c}"), F.col(c)) if c in ledger.columns else F.col(f"__p_{c}") for c in own}
    return joined.withColumns(laid).drop(*[f"__p_{c}" for c in own])


def reset_orders(ledger: DataFrame, requested: DataFrame, host: str = "example.com") -> tuple[DataFrame, DataFrame]:
    """(ledger, rejects): all records of the requested orders go, a shell record with link and first sight stays.

    Orders without a detail link on the host are rejected and keep their records.
    """
    good = F.coalesce(F.col("order_details_url").rlike(rf"(?i)^https?://(?:[^/]+\.)?{host.replace('.', chr(92) + '.')}/") & F.col("order_details_url").rlike(text.DETAIL_ROUTE), F.lit(False))
    key = ["account_id", "order_id"]
    mine = ledger.join(requested.select(*key).distinct(), key, "left_semi")
    state = mine.groupBy(*key).agg(F.max(F.when(good, F.col("order_details_url"))).alias("order_details_url"), F.min("first_seen_at").alias("first_seen_at"))
    ok = state.where("order_details_url IS NOT NULL")
    shell = ok.select(*key, F.concat(F.lit("order:"), F.col("order_id")).alias("record_id"), F.lit("order").alias("record_type"), "order_details_url", "first_seen_at", F.lit("pending").alias("processing_state"))
    rest = ledger.join(ok.select(*key), key, "left_anti")
    rejects = requested.select(*key).distinct().join(ok.select(*key), key, "left_anti").withColumn("reason", F.lit("no detail link"))
    return rest.unionByName(shell, allowMissingColumns=True), rejects


def apply_identity_hint(returns: DataFrame, links: DataFrame) -> DataFrame:
    """A page with exactly one authoritative return takes token and item id from the link that led to it, and a new record id."""
    w = W.partitionBy("account_id", "page_id")
    counted = returns.withColumn("__k", F.sum(F.coalesce("authoritative", F.lit(False)).cast("int")).over(w))
    hint = links.select("account_id", "page_id", F.col("return_token").alias("__t"), F.col("return_item_id").alias("__i")).dropDuplicates(["account_id", "page_id"])
    joined = counted.join(hint, ["account_id", "page_id"], "left")
    use = (F.col("__k") == 1) & F.coalesce("authoritative", F.lit(False)) & F.col("__t").isNotNull()
    out = joined.withColumn("return_token", F.when(use, F.col("__t")).otherwise(F.col("return_token"))).withColumn("return_item_id", F.when(use, F.coalesce("__i", "return_item_id")).otherwise(F.col("return_item_id")))
    anew = text.record_id(F.lit("return"), F.col("order_id"), F.col("return_token"), F.col("return_item_id"), F.col("asins"), F.col("item_names"), F.lit(False), F.col("refund_cents"))
    return out.withColumn("record_id", F.when(use, anew).otherwise(F.col("record_id"))).drop("__k", "__t", "__i")


def order_processing_state(orders: DataFrame, attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """complete, retrying, error or pending per order.

    Complete if its detail data are and it has as many authoritative returns as links; error after `max_attempts`
    failed attempts or a blocked one; retrying after fewer.
    """
    key = ["account_id", "order_id"]
    a = attempts.groupBy(*key).agg(F.count_if(~F.col("ok")).alias("n_failed"), F.max_by("outcome", "seq").alias("last_outcome"), F.bool_or(F.coalesce(F.col("outcome") == "blocked", F.lit(False))).alias("blocked"))
    j = orders.join(a, key, "left")
    full = F.coalesce("order_data_complete", F.lit(False)) & (F.coalesce("n_authoritative", F.lit(0)) >= F.coalesce("expected_returns", F.lit(0)))
    state = F.when(full, "complete").when(F.coalesce("blocked", F.lit(False)) | (F.coalesce("n_failed", F.lit(0)) >= max_attempts), "error").when(F.col("n_failed") > 0, "retrying").otherwise("pending")
    return j.select(*key, state.alias("processing_state"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), "last_outcome")


def union_lists(df: DataFrame, *columns: str) -> Column:
    """Ordered case-insensitive union of several string-array columns of one row."""
    return distinct_ci(reduce(lambda a, b: F.concat(a, b), [clean_strings(F.col(c)) for c in columns]))
