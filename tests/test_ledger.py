"""Merging, rows, bank matching, coverage and plans on small tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from ledgerwright.functions import arrays, returns as R, schema
from ledgerwright.operators import bank, coverage, merge, queries as Q, rows as B
from ledgerwright.plans import adapters, registered, registered_pages

SF = "/root/testdata/sf0.001"
CAP = "account_id string, record_id string, batch_id long, seq long, return_stage string, status string, status_text string, refund_cents long, card_last4 string"


def caps(spark, rows):
    return spark.createDataFrame([("a", "r", 0, i, *r) for i, r in enumerate(rows)], CAP)


def test_stage_never_falls_and_blanks_never_overwrite(spark):
    got = merge.merge_latest(caps(spark, [("started", "s1", "x", 5, None), ("received", "s2", "", None, "1234"), ("started", "s3", "late", None, "")])).first()
    assert (got.return_stage, got.status, got.status_text, got.refund_cents, got.card_last4) == ("received", "s2", "x", 5, "1234")


def test_authoritative_stays(spark):
    c = caps(spark, [("received", "s", "x", 5, None), ("received", "s", "y", 5, None)]).withColumn("authoritative", F.col("seq") == 0).withColumn("provisional", F.col("seq") == 1)
    got = merge.merge_latest(c).first()
    assert got.authoritative and not got.provisional and got.status_text == "y"


def test_any_permutation_ends_at_the_furthest_stage(spark):
    stages = ["started", "refund_issued", "shipped", "unknown"]
    for order in list(itertools.permutations(stages))[::5]:
        seen = merge.monotonic_stage(caps(spark, [(s, None, None, None, None) for s in order])).where("accepted").orderBy("seq").collect()
        ranks = [r["rank"] for r in seen]
        assert ranks == sorted(ranks) and ranks[-1] == 4


def test_merging_again_changes_nothing(spark):
    c = adapters.spark_view(spark, SF, "v_captures")
    once = merge.merge_latest(c)
    twice = merge.merge_latest(c, once)
    assert merge.diff_ledger(once, twice).where("change <> 'unchanged'").count() == 0


def test_trusted_identity(spark):
    kinds = "account_id string, record_id string, batch_id long, seq long, item_identity_source string, return_item_id string, item_names array<string>, asins array<string>, item_asin_evidence_source string, authoritative boolean"
    row = lambda seq, src, names, asins, strong=None, auth=False: ("a", "r", 0, seq, src, "i", names, asins, strong, auth)
    t = schema.TRUSTED_SOURCE
    fixed = [row(0, None, ["Weak"], []), row(1, t, ["Named"], ["B1"], None, True), row(2, None, ["Other"], ["B2"])]
    got = merge.trusted_identity(spark.createDataFrame(fixed, kinds)).first()
    assert (got.item_names, got.asins, got.identity_conflict) == (["Named"], ["B1"], False)
    for strong in schema.STRONG_EVIDENCE:
        got = merge.trusted_identity(spark.createDataFrame([*fixed, row(3, None, ["Other"], ["B2"], strong)], kinds)).first()
        assert got.identity_conflict and got.item_names == ["Named"]
    assert not merge.trusted_identity(spark.createDataFrame([*fixed, row(3, None, ["Other"], ["b1"], strong), row(4, None, [], ["B3"], "page text")], kinds)).first().identity_conflict
    # a link's capture that replaces nothing adds to what was known, and later names no longer count
    got = merge.trusted_identity(spark.createDataFrame([row(0, None, ["Weak"], []), row(1, t, ["Named"], []), row(2, None, ["Other"], ["B2"])], kinds)).first()
    assert (got.item_names, got.asins) == (["Weak", "Named"], ["B2"])
    got = merge.trusted_identity(spark.createDataFrame([row(0, None, ["A"], []), row(1, None, ["B"], [], None, True), row(2, None, ["b", "C"], [])], kinds)).first()
    assert got.item_names == ["B", "C"]


def test_items_and_lists(spark):
    items = [("k", "b000000001", " Name ", 2, 100, "SHIPPED", True), ("k", None, "again", 1, None, None, None), (None, None, "no key", 1, 1, None, None), ("z", "short", "N", 0, -5, "odd", True)]
    kind = "array<struct<item_key:string,asin:string,item_name:string,quantity:int,item_amount_cents:long,replacement_stage:string,replacement_no_return_required:boolean>>"
    df = spark.createDataFrame([(items, ["A", " a ", "B"], ["b", "C", None])], f"x {kind}, p array<string>, q array<string>")
    got = df.select(arrays.normalize_order_items(F.col("x")).alias("x"), arrays.array_union_ci(F.col("p"), F.col("q")).alias("u"), merge.union_lists(df, "p", "q").alias("v"), arrays.order_items_from_legacy(F.col("p"), F.col("q")).alias("l")).first()
    assert [(i.item_key, i.asin, i.item_name, i.quantity, i.item_amount_cents, i.replacement_stage) for i in got.x] == [("k", "B000000001", "Name", 2, 100, "shipped"), ("z", None, "N", None, None, None)]
    assert got.u == ["A", "B", "C"] == got.v and [i.asin for i in got.l] == ["b", "C", None]


def test_merge_items_prefers_complete_details(spark):
    kind = "account_id string, record_id string, batch_id long, seq long, detail_scan_complete boolean, order_items array<string>"
    df = spark.createDataFrame([("a", "r", 0, 0, True, ["full"]), ("a", "r", 0, 1, False, ["later"]), ("a", "s", 0, 0, None, ["only"])], kind)
    assert {r.record_id: r.order_items for r in merge.merge_items(df).collect()} == {"r": ["full"], "s": ["only"]}


def test_loose_dates_and_review_rules(spark):
    df = spark.createDataFrame([("Sep 7",), ("September 7, 2025",), ("2024-02-01T10:00:00Z",), ("soon",), (None,)], "d string")
    got = [str(r.x) for r in df.select(R.parse_loose_date(F.col("d"), 2026).alias("x")).collect()]
    assert got == ["2026-09-07 23:59:59", "2025-09-07 23:59:59", "2024-02-01 10:00:00", "None", "None"]
    kind = "rank int, manual_state string, bank_status string, identity_conflict boolean, eta string"
    cases = [((5, None, None, True, None), True), ((4, "reconciled", None, False, None), False), ((3, None, "confirmed", False, None), True), ((5, None, None, False, None), False), ((3, None, None, False, None), True), ((4, None, "ambiguous", False, None), True), ((4, None, "confirmed", False, "2026-01-01"), False), ((2, "reconciled", None, False, None), False), ((4, None, None, False, None), False), ((4, None, None, False, "2026-01-01"), True), ((4, None, None, False, "2026-01-31 12:00:00"), False)]
    df = spark.createDataFrame([c for c, _ in cases], kind).withColumn("expected_credit_at", F.col("eta").cast("timestamp"))
    out = R.needs_credit_review(R.bank_columns(df), "2026-02-01 00:00:00").collect()
    assert [r.credit_review for r in out] == [w for _, w in cases]


def test_item_matching(spark):
    names = ["Stainless Steel Water Bottle 32oz Blue with Straw Lid", "Twin", "Twin", "Lamp"]
    items = spark.createDataFrame([("a", "o", f"P{i}", f"b{i:09d}", n) for i, n in enumerate(names)], "account_id string, order_id string, item_key string, asin string, item_name string")
    groups = [("g1", [], ["Stainless Steel Water Bottle 32oz Blue"]), ("g2", [], ["twin"]), ("g3", ["B000000003"], ["x"]), ("g4", ["B999999999"], []), ("g5", ["B000000000", "B000000003"], []), ("g6", [], ["Lamp 112-1234567-7654321…"])]
    g = spark.createDataFrame([("a", "o", *x) for x in groups], "account_id string, order_id string, group_key string, asins array<string>, item_names array<string>")
    m = B.match_items_to_groups(items, g)
    assert {(r.group_key, r.item_key, r.score) for r in m.collect()} == {("g1", "P0", 70), ("g3", "P3", 100), ("g6", "P3", 80)}
    assert {(r.group_key, r.strong_identity) for r in B.unmatched_groups(g, m).collect()} == {("g2", False), ("g4", True), ("g5", True)}


ORDER = "account_id string, order_id string, order_data_complete boolean, terminal_cancelled boolean, expected_returns long, canonical_refund_cents long, processing_error string, processing_state string, detail_scan_complete boolean, status_text string, item_names array<string>, asins array<string>, card_last4 string"
RETURN = "account_id string, order_id string, record_id string, return_token string, return_item_id string, return_stage string, refund_cents long, refund_subtotal_cents long, refund_scope string, group_refund_cents long, authoritative boolean, manual_state string, bank_status string, identity_conflict boolean, item_names array<string>, asins array<string>, d string"
ITEM = "account_id string, order_id string, item_key string, asin string, item_name string, replacement_stage string"


def table(spark, kind, rows):
    names = [c.split()[0] for c in kind.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], kind)


def row_table(spark, orders, returns, items=()):
    o = [{"account_id": "a", "order_data_complete": True, "detail_scan_complete": True} | x for x in orders]
    r = [{"account_id": "a", "record_id": f"r{k}", "return_token": "T", "return_item_id": f"i{k}", "return_stage": "credited", "authoritative": True, "d": "2026-01-01"} | x for k, x in enumerate(returns)]
    i = [{"account_id": "a"} | x for x in items]
    return B.order_rows(table(spark, ORDER, o), table(spark, RETURN, r).withColumn("last_scanned_at", F.col("d").cast("timestamp")), table(spark, ITEM, i), "2026-02-01 00:00:00")


def build(spark, *tables):
    return {x.order_id: x for x in row_table(spark, *tables).collect()}


def test_order_states(spark):
    orders = [
        {"order_id": "left_error", "processing_error": "old"}, {"order_id": "error", "order_data_complete": False, "processing_error": "x"}, {"order_id": "retry", "order_data_complete": False, "processing_state": "retrying"},
        {"order_id": "gone", "terminal_cancelled": True}, {"order_id": "gone_back", "terminal_cancelled": True}, {"order_id": "one_by_hand"}, {"order_id": "bank"}, {"order_id": "two_stages"}, {"order_id": "seen", "detail_scan_complete": False},
        {"order_id": "said", "status_text": "Delivered"}, {"order_id": "swap"}, {"order_id": "strict", "expected_returns": 1}, {"order_id": "conflict"}, {"order_id": "many", "canonical_refund_cents": 100}]
    returns = [
        {"order_id": "gone_back", "return_stage": "refund_issued"}, {"order_id": "one_by_hand", "manual_state": "reconciled", "return_stage": "started"}, {"order_id": "one_by_hand", "return_stage": "started"},
        {"order_id": "bank", "return_stage": "refund_issued", "bank_status": "confirmed"}, {"order_id": "two_stages", "return_stage": "credited"}, {"order_id": "two_stages", "return_stage": "shipped"},
        {"order_id": "strict", "authoritative": True}, {"order_id": "strict", "authoritative": False, "return_stage": "started"}, {"order_id": "conflict", "return_stage": "shipped", "bank_status": "confirmed"},
        {"order_id": "many", "refund_cents": 300, "refund_scope": "item", "identity_conflict": True}, {"order_id": "orphan", "return_stage": "received", "item_names": ["Lone"]}]
    rows = row_table(spark, orders, returns, [{"order_id": "swap", "item_key": "k", "item_name": "Lamp", "replacement_stage": "ordered"}]).persist()
    got = {x.order_id: x for x in rows.collect()}
    assert {k: (r.state, r.label) for k, r in got.items()} == {
        "left_error": ("purchase", "Order details captured"), "error": ("error", "Processing error"), "retry": ("processing", "Retrying"), "gone": ("cancelled", "Cancelled"), "gone_back": ("refund_issued", "Refund issued"),
        "one_by_hand": ("reconciled", "Reconciled"), "bank": ("refund_issued", "Refund issued"), "two_stages": ("needs_review", "Dropped off / shipped"), "seen": ("purchase", "Order discovered"), "said": ("purchase", "Delivered"),
        "swap": ("replacement", "Replacement ordered"), "strict": ("credited", "Shop credited"), "conflict": ("needs_review", "Bank/shop status conflict"), "many": ("needs_review", "Refund amount mismatch"), "orphan": ("processing", "Processing")}
    assert (got["many"].review_cents, got["two_stages"].review_cents, got["bank"].review_cents) == (100, 0, None)
    assert got["two_stages"].n_groups == 1 and got["two_stages"].ranks == [2, 5] and not got["two_stages"].all_issued and got["orphan"].item_names == ["Lone"]
    picked = lambda v: {r.order_id for r in Q.filter_status(rows, v).collect()}
    assert picked("no_return") == {"left_error", "seen", "said", "swap"} and picked("cancelled") == {"gone", "gone_back"} and picked("dropped_off") == {"two_stages", "conflict"}
    assert picked("refund_credited") == {"two_stages", "strict", "many"} and picked("replacement") == {"swap"} and len(picked("all")) == len(got)


def test_group_amounts(spark):
    cases = {
        "group": ([{"group_refund_cents": 5000}, {"group_refund_cents": 5000}], 5000, False), "clash": ([{"group_refund_cents": 5000, "d": "2026-01-02"}, {"refund_cents": 4000, "refund_scope": "return"}], 5000, True),
        "scoped_subtotal": ([{"refund_subtotal_cents": 70, "refund_scope": "return"}], 70, False), "items": ([{"refund_cents": 10, "refund_scope": "item"}, {"refund_subtotal_cents": 5, "refund_scope": "item"}, {"refund_cents": 99}], 15, False),
        "legacy": ([{"refund_cents": 7, "d": "2025-01-01"}, {"refund_cents": 8}], 8, False), "unknown": ([{}, {}], None, False)}
    got = build(spark, [{"order_id": k} for k in cases], [{"order_id": k} | x for k, (rows, _, _) in cases.items() for x in rows])
    assert {k: (got[k].refund_cents, got[k].amount_conflict) for k in cases} == {k: (amount, clash) for k, (_, amount, clash) in cases.items()}


def test_descriptors_and_legacy_items(spark):
    orders = [{"order_id": "o", "item_names": ["Desk Lamp", "desk lamp", "Cup"], "asins": ["b000000001", "B000000002"], "canonical_refund_cents": 0}, {"order_id": "p", "item_names": ["x"]}]
    got = build(spark, orders, [{"order_id": "o", "asins": ["B000000002"], "item_names": ["Mug"]}, {"order_id": "o", "return_token": "U", "asins": ["B000000009"]}], [{"order_id": "p", "item_key": "k", "asin": "B000000003", "item_name": "Pen"}])
    o, p = got["o"], got["p"]
    assert (o.item_names, o.asins, o.n_items, o.n_returned_items, o.n_unmatched, o.strong_unmatched) == (["Desk Lamp", "Cup"], ["b000000001", "B000000002", "B000000009"], 2, 1, 1, True)
    assert o.product_statuses == ["Desk Lamp => Not returned", "Cup => Credited"] and o.returned_names == ["Mug"] and o.label == "Returned item needs matching"
    assert (p.item_names, p.product_statuses, p.shop_status, p.open_url) == (["Pen"], ["Pen => Not returned"], "—", "")


def test_order_rows_plan_is_flat(spark):
    text = plan(registered.order_rows(spark, SF))
    assert text.count("Join") <= 10 and text.count("Window ") <= 6 and text.count("Scan parquet") <= 14 and text.count("Exchange") <= 26, [text.count(x) for x in ("Join", "Window ", "Scan parquet", "Exchange")]


def test_bank_matching(spark):
    q = spark.createDataFrame([("a", r, t, c, "1111", "2024-01-01") for r, t, c in [("exact", "t", 1000), ("near", "t", 2001), ("far", "t", 3002), ("two", "t", 4000), ("rival1", "t", 5000), ("rival2", "t", 5000), ("wait", "t", 6000), ("half1", "g", 700), ("half2", "g", 800), ("none", "t", None)]], "account_id string, request_id string, return_token string, expected_cents long, card_last4 string, d string").withColumn("refund_issued_at", F.col("d").cast("timestamp"))
    t = spark.createDataFrame([("a", i, "2024-01-05", s, c, "1111", True) for i, (s, c) in enumerate([("posted", 1000), ("posted", 2000), ("posted", 3000), ("posted", 4000), ("posted", 4001), ("posted", 5000), ("pending", 6000), ("posted", 1500)])], "account_id string, txn_id long, d string, txn_state string, amount_cents long, txn_last4 string, merchant_match boolean").withColumn("posted_at", F.col("d").cast("timestamp"))
    first = bank.reconcile_credits(q, t)
    got = {r.request_id: (r.status, r.txn_id) for r in first.collect()}
    assert got == {"exact": ("confirmed", 0), "near": ("confirmed", 1), "far": ("not_found", None), "two": ("ambiguous", None), "rival1": ("ambiguous", None), "rival2": ("ambiguous", None), "wait": ("pending", 6), "half1": ("not_found", None), "half2": ("not_found", None), "none": ("not_found", None)}
    second = {r.request_id: (r.status, r.txn_id) for r in bank.reconcile_grouped(q, t, first).collect()}
    assert second["half1"] == second["half2"] == ("confirmed", 7) and second["exact"] == ("confirmed", 0)


def test_bank_import(spark):
    ledger = spark.createDataFrame([("a", "r1", 1000, None), ("a", "r2", None, None), ("a", "r3", 500, "pending")], "account_id string, record_id string, refund_cents long, bank_status string")
    res = spark.createDataFrame([("a", "r1", "confirmed", 1002), ("a", "r2", "confirmed", 7), ("a", "r3", "ambiguous", None), ("a", "gone", "pending", 1)], "account_id string, return_record_id string, status string, matched_cents long").withColumn("checked_at", F.lit("2024-01-01").cast("timestamp"))
    out, bad = bank.apply_bank_results(ledger, res)
    assert {r.record_id: r.bank_status for r in out.collect()} == {"r1": None, "r2": "confirmed", "r3": "ambiguous"}
    assert {(r.return_record_id, r.problem) for r in bad.collect()} == {("r1", "amount"), ("gone", "missing")}
    # the same record id in two accounts: only the account that the result names is touched, and two results of one record count once
    two = spark.createDataFrame([("a", "r", 500, None), ("b", "r", 900, None)], "account_id string, record_id string, refund_cents long, bank_status string")
    both = [("b", "r", "Confirmed", 9.0, "2024-01-01", "x12345"), ("b", "r", "pending", None, "2023-01-01", None), ("b", "q", "odd", None, None, None), ("b", "r", "confirmed", float("nan"), None, None)]
    good, no = bank.validate_bank_results(spark.createDataFrame(both, "account_id string, return_record_id string, status string, matched_amount double, t string, account_last4 string").withColumn("checked_at", F.col("t").cast("timestamp")))
    assert sorted(r.problem for r in no.collect()) == ["amount is no number", "status"] and {r.account_last4 for r in good.collect()} == {"2345", None}
    done, none = bank.apply_bank_results(two, good)
    assert {(r.account_id, r.bank_status, r.bank_cents) for r in done.collect()} == {("a", None, None), ("b", "confirmed", 900)} and none.count() == 0
    assert bank.import_counters(res, bad).first().asDict() == {"n_applied": 2, "n_confirmed": 1, "n_review": 1, "n_missing": 1}


def test_coverage_rules(spark):
    kind = "account_id string, session_id int, seq long, year int, page int, order_ids array<string>, detail_link_ids array<string>, terminal_ids array<string>"
    p = spark.createDataFrame([("a", 1, 1, 2024, 1, ["x", "y"], ["x"], []), ("a", 1, 2, 2024, 1, ["y", "x"], ["x"], []), ("a", 1, 3, 2024, 2, ["y", "z"], [], ["z"]), ("a", 1, 4, 2023, 31, ["w"], [], [])], kind)
    assert [r.advanced for r in coverage.page_progress(p).orderBy("seq").collect()] == [False, False, True, True]
    assert [(r.order_id, r.first_page, r.again_page, r.n_hits) for r in coverage.overlap_hits(p).collect()] == [("y", "1:2024:1", "1:2024:2", 1)]
    ledger = spark.createDataFrame([("a", "w", "https://x", False)], "account_id string, order_id string, order_details_url string, terminal_cancelled boolean")
    assert {r.order_id for r in coverage.missing_detail_links(p, ledger).collect()} == {"y"}
    assert coverage.deepest_frontier(p).first().asDict() == {"account_id": "a", "year": 2023, "page": 31}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["reconcile_credits", "match_items", "order_rows", "missing_links", "supersede", "bank_request"])
def test_no_nested_loops(spark, name):
    text = plan(registered.SPARK[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan(adapters.spark_view(spark, SF, "v_requests"))


def test_queries_have_names_and_sql():
    for known in (registered, registered_pages):
        assert set(known.SQL) == set(known.SPARK)
    assert not set(registered.SPARK) & set(registered_pages.SPARK) and len(registered.SQL) + len(registered_pages.SQL) > 110


def test_compact_summary_by_hand(spark):
    orders = spark.createDataFrame(
        [("a", "o1", "1", 1000, None, True, "2024-01-01"), ("a", "o1", "2", 5, None, False, "2024-02-01"), ("b", "o1", "1", 300, 4000, True, "2024-01-01"), ("a", "o2", "1", 200, 4000, False, "2024-01-01")],
        "account_id string, order_id string, record_id string, purchase_cents long, canonical_refund_cents long, detail_scan_complete boolean, t string").withColumn("last_scanned_at", F.col("t").cast("timestamp"))
    kind = "account_id string, order_id string, record_id string, return_token string, refund_cents long, refund_subtotal_cents long, manual_state string, credit_review boolean, asins array<string>, item_names array<string>, t string"
    rows = [
        ("a", "o1", "r1", "T1", None, 777, None, True, ["B1"], ["Lamp"], "2024-01-01"), ("a", "o1", "r2", "T2", 500, 1, None, False, [], [], "2024-01-01"), ("a", "o1", "r3", "T2", 400, None, None, True, [], [], "2024-01-03"),
        ("b", "o1", "r1", "T1", 50, None, "reconciled", False, [], [], "2024-01-01"), ("b", "o1", "r2", "T2", 60, None, None, True, [], [], "2024-01-01"),
        ("c", "o9", "r1", None, 10, None, None, True, ["B1"], [" Lamp"], "2024-01-01"), ("c", "o9", "r2", "", 10, None, None, True, ["b1 "], ["lamp"], "2024-01-02"), ("c", "o9", "r3", None, None, None, None, True, [], [], "2024-01-02")]
    returns = spark.createDataFrame(rows, kind).withColumn("last_scanned_at", F.col("t").cast("timestamp"))
    got = Q.compact_summary(orders, returns).first().asDict()
    # o1 of a: 777 + the newer 400; o1 of b: its canonical total, and nothing under review; o9: one refund, whose order isn't known
    assert got == {"n_all": 4, "all_cents": 1500, "n_returns": 3, "return_cents": 777 + 400 + 4000 + 10, "n_review": 2, "review_cents": 777 + 400 + 10}


def test_money_text_of_any_sign(spark):
    cents = [0, 5, 10, 1250, 1200, -50, -1250, -1200, -5, None]
    df = spark.createDataFrame([(c,) for c in cents], "c long")
    assert [r[0] for r in df.select(Q.money_text(F.col("c"))).collect()] == ["0", "0.05", "0.1", "12.5", "12", "-0.5", "-12.5", "-12", "-0.05", None]


def test_results_leave_other_records_alone_and_keep_all_they_say(spark, tmp_path):
    from ledgerwright.functions import returns as R
    from ledgerwright.sources import io

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(
        '{"schema": "bank-reconciliation-result/1", "requestId": "q", "accountId": "a", "checkedAt": "2026-09-04T10:00:00Z", "matches": [{"returnRecordId": "r2", "status": "confirmed", "matchedAmount": 7.0, "postedDate": "2026-09-03", "accountLast4": "xx3172", "merchantName": "Shop", "reason": "exact"}]}')
    matches, _ = io.read_bank_results(spark, str(tmp_path / "in"), "q")
    good, _ = bank.validate_bank_results(matches)
    ledger = spark.sql("SELECT 'a' AS account_id, 'r1' AS record_id, 500L AS refund_cents, 'confirmed' AS bank_status, 500L AS bank_cents, TIMESTAMP '2026-01-01' AS bank_verified_at UNION ALL SELECT 'a', 'r2', 700L, NULL, NULL, NULL")
    got = {r.record_id: r for r in bank.apply_bank_results(ledger, good)[0].collect()}
    assert (got["r1"].bank_status, got["r1"].bank_cents, str(got["r1"].bank_verified_at)) == ("confirmed", 500, "2026-01-01 00:00:00")
    r = got["r2"]
    assert (r.bank_cents, str(r.bank_verified_at), str(r.bank_posted_date), r.bank_account_last4, r.bank_merchant_name, r.bank_reason, r.bank_request_id) == (700, "2026-09-04 10:00:00", "2026-09-03", "3172", "Shop", "exact", "q")
    # the issue date comes from the milestones and reaches the request file
    m = spark.sql("SELECT 'r' AS record_id, named_struct('refund_issued', named_struct('done', true, 'date', 'Sep 7, 2026')) AS return_milestones, 'a' AS account_id, 1250L AS expected_cents")
    dated = R.with_issue_date(m, 2026)
    io.write_bank_requests(dated.select("account_id", F.col("record_id").alias("return_record_id"), "expected_cents", "refund_issued_at"), f"{tmp_path}/out", "q2", generated_at="2026-09-08 00:00:00")
    doc = spark.read.json(f"{tmp_path}/out").first()
    assert tuple(doc.returns[0].asDict()[k] for k in ("returnRecordId", "expectedRefund", "refundIssuedDate")) == ("r", 12.5, "2026-09-07") and doc.generatedAt.startswith("2026-09-08") and doc.policy.preferSameCardLast4
