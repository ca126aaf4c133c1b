"""The stored event log, streams of pages, and bank matching in rounds."""

import itertools
import random

from pyspark.sql import functions as F

from ledgerwright.operators import bank, pages, rows
from ledgerwright.plans import registered_streams
from ledgerwright.sources import event_log, ledger_store
from ledgerwright.streaming import pages as page_streams


def events(spark, *some):
    return spark.createDataFrame(list(some), "account_id string, event_id long, day int").select("account_id", "event_id", F.make_timestamp(F.lit(2026), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("at"))


def test_log_stays_bounded(spark, tmp_path):
    path, whole = f"{tmp_path}/log", []
    assert event_log.read_log(spark, path) is None and event_log.compact_log(spark, path) is None
    for epoch in range(6):
        part = [("a", epoch * 10 + i, 28 - (epoch * 7 + i) % 28) for i in range(10)] + [("b", epoch, epoch + 1)]
        whole += part
        assert event_log.append_batch(events(spark, *part), path, epoch) and not event_log.append_batch(events(spark, *part), path, epoch)
        assert event_log.compact_log(spark, path, 3) == epoch
        folder = ledger_store.Folder(spark, path)
        assert len(folder.numbers("base", "v")) <= 2 and len(folder.numbers("deltas", "e")) <= 2
        assert spark.read.parquet(folder.at("base", f"v={epoch:012d}")).count() <= 6
    assert not event_log.append_batch(events(spark, ("a", 1, 1)), path, 0)  # compacted away, still known
    newest = {a: sorted(((d, e) for x, e, d in whole if x == a), reverse=True)[:3] for a in "ab"}
    got = event_log.read_log(spark, path, 3).select("account_id", F.dayofmonth("at").alias("d"), "event_id").collect()
    assert {(r.account_id, r.d, r.event_id) for r in got} == {(a, d, e) for a in newest for d, e in newest[a]}


def test_log_takes_new_columns_and_empty_batches(spark, tmp_path):
    path = f"{tmp_path}/log"
    event_log.append_batch(events(spark, ("a", 1, 1)), path, 0)
    event_log.append_batch(events(spark, ("a", 2, 2)).withColumn("type", F.lit("click")).limit(0), path, 1)
    event_log.append_batch(events(spark, ("a", 3, 3)).withColumn("type", F.lit("click")), path, 2)
    (ledger_store.Folder(spark, path)).remove("_writing-nothing")
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{path}/_writing-v=000000000002/part")  # what a broken compaction left
    assert event_log.compact_log(spark, path) == 2
    assert {(r.event_id, r.type) for r in event_log.read_log(spark, path).collect()} == {(1, None), (3, "click")}


def test_changed_pages_equal_the_batch(spark, tmp_path):
    seen = [("a", i, f"https://shop.example.com/your-orders/order-details?orderID=112-1234567-765432{i % 3}", f"Total ${(i // 4) % 2}\nword {i}", i) for i in range(12)]
    c = spark.createDataFrame(seen, "account_id string, page_id long, url string, text string, n int").withColumn("captured_at", F.timestamp_seconds(F.col("n") * 60))
    stream = registered_streams.arriving(spark, c, F.floor(F.col("n") / 5), 3)
    got = {r.page_id: (r.changed, r.late) for r in registered_streams.finished(spark, page_streams.changed_pages(stream)).collect()}
    assert got == {r.page_id: (r.changed, False) for r in pages.classify_pages(c).collect()} and {True, False} == {x for x, _ in got.values()}
    late = registered_streams.arriving(spark, c.where("n IN (0, 3, 6)"), F.when(F.col("n") == 3, 1).otherwise(0), 2)
    assert {r.page_id: r.late for r in registered_streams.finished(spark, page_streams.changed_pages(late)).collect()} == {0: False, 6: False, 3: True}


def by_rounds(pairs):
    """Outcome of each request by plain loops: pairs (request, credit, score)."""
    left, won = list(pairs), {}
    while True:
        def only_best(k, x):
            best = max(p[2] for p in left if p[k] == x)
            top = [p for p in left if p[k] == x and p[2] == best]
            return top[0] if len(top) == 1 else None
        hits = [p for p in left if only_best(0, p[0]) == p and only_best(1, p[1]) == p]
        if not hits:
            return won, {p[0] for p in left}
        won |= {r: t for r, t, _ in hits}
        left = [p for p in left if p[0] not in won and p[1] not in won.values()]


def test_rounds_against_loops(spark):
    rng, requests, credits = random.Random(5), [], []
    for group in range(12):
        requests += [(f"g{group}", f"q{i}", 1000 + rng.randrange(3), rng.choice(["1", "2", None])) for i in range(rng.randrange(1, 6))]
        credits += [(f"g{group}", 100 * group + i, 1000 + rng.randrange(3), rng.choice(["1", "2"]), rng.random() < 0.5, rng.choice(["posted", "pending"])) for i in range(rng.randrange(0, 6))]
    r = spark.createDataFrame(requests, "account_id string, request_id string, expected_cents long, card_last4 string").withColumn("refund_issued_at", F.lit(None).cast("timestamp"))
    t = spark.createDataFrame(credits, "account_id string, txn_id long, amount_cents long, txn_last4 string, merchant_match boolean, txn_state string").withColumn("posted_at", F.lit("2026-01-01").cast("timestamp"))
    got = bank.reconcile_rounds(r, t).collect()
    assert len(got) == len(requests)
    pairs = [((a, q), (a2, x), 4 * (card == last) + 2 * match + (state == "posted")) for (a, q, cents, card), (a2, x, have, last, match, state) in itertools.product(requests, credits) if a == a2 and abs(cents - have) <= 1]
    won, open_ = by_rounds(pairs)
    state = {(a, x): s for a, x, _, _, _, s in credits}
    for x in got:
        key = (x.account_id, x.request_id)
        want = {"posted": "confirmed", "pending": "pending"}[state[won[key]]] if key in won else "ambiguous" if key in open_ else "not_found"
        assert (x.status, x.txn_id) == (want, won[key][1] if key in won else None)
    single = {(x.account_id, x.request_id) for x in bank.reconcile_credits(r, t).where("txn_id IS NOT NULL").collect()}
    assert single < set(won)  # a later round found more
    nothing = bank.reconcile_rounds(r.limit(0), t)
    assert nothing.count() == 0


def test_step_dates_and_all_asins(spark):
    step = "struct<done:boolean,date:string>"
    r = spark.createDataFrame(
        [("a", "o", "r1", "T", "received", ["B1"], "order-detail-return-link", (("received", None, (True, "June 1"), (True, " "), (True, "June 3"), (False, None), (False, None)))),
         ("a", "o", "r2", "T", "started", ["B2"], None, None)],
        f"account_id string, order_id string, record_id string, return_token string, return_stage string, asins array<string>, item_identity_source string, return_milestones struct<stage:string,expected_credit_date:string,started:{step},shipped:{step},received:{step},refund_issued:{step},credited:{step}>")
    r = r.withColumns({"return_item_id": F.col("record_id"), "expected_credit_at": F.lit("2026-02-03").cast("timestamp")})
    g = rows.group_returns(rows.dedupe_returns(rows.prepared_returns(r, "2026-01-01 00:00:00")))
    assert [(x.asins, x.seen_asins) for x in g.collect()] == [(["B1"], ["B1", "B2"])]
    got = [(x.name, x.done, x.date, x.label) for x in rows.lifecycle_steps(g).orderBy("step").collect()]
    assert [x[:3] for x in got] == [("started", True, "June 1"), ("shipped", True, None), ("received", True, "June 3"), ("refund_issued", False, None), ("credited", False, None)]
    assert got[4][3] == "Expected 2026-02-03" and got[3][3] == "Refund issued"
    orders = spark.createDataFrame([("a", "o", "order:o")], "account_id string, order_id string, record_id string")
    items = spark.createDataFrame([], "account_id string, order_id string, item_key string")
    assert rows.order_rows(orders, r, items, "2026-01-01 00:00:00").first().asins == ["B1", "B2"]
