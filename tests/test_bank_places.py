"""Bank matching by running counts of a place, against all pairs listed by loops."""

import random

from pyspark.sql import functions as F

from ledgerwright.operators import bank

REQUESTS = "account_id string, request_id string, expected_cents long, card_last4 string, refund_issued_at string"
CREDITS = "account_id string, txn_id long, amount_cents long, txn_last4 string, merchant_match boolean, txn_state string, posted_at string"


def tables(spark, requests, credits):
    r = spark.createDataFrame(requests, REQUESTS).withColumn("refund_issued_at", F.col("refund_issued_at").cast("timestamp"))
    t = spark.createDataFrame(credits, CREDITS).withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    return r, t


def by_loops(requests, credits):
    """{(account, request): (status, txn_id, n_candidates)} of one round."""
    pairs = [
        ((a, q), (a, x), 4 * (card is not None and card == last) + 2 * bool(match) + (state == "posted"), state)
        for a, q, want, card, since in requests for b, x, have, last, match, state, at in credits
        if a is not None and a == b and want is not None and have is not None and abs(want - have) <= 1 and at is not None and (since is None or at >= since)]
    def only(k, key):
        mine = [p for p in pairs if p[k] == key]
        top = [p for p in mine if p[2] == max(m[2] for m in mine)]
        return top[0] if len(top) == 1 else None
    out = {(a, q): ["not_found", None, 0] for a, q, *_ in requests}
    for key in out:
        n = sum(p[0] == key for p in pairs)
        if n:
            p = only(0, key)
            out[key] = [{"posted": "confirmed"}.get(p[3], "pending"), p[1][1], n] if p and only(1, p[1]) == p else ["ambiguous", None, n]
    return {k: tuple(v) for k, v in out.items()}


def test_running_counts_against_pairs(spark):
    rng = random.Random(11)
    day = lambda: rng.choice([None, "2026-01-01", "2026-01-02", "2026-01-03 05:00:00", "2026-01-04"])
    requests, credits = [], []
    for k in range(60):
        account = f"a{k}" if k else None
        requests += [(account, f"q{i}", rng.choice([999, 1000, 1001, 1003, None]), rng.choice(["1", "2", "3", None]), day()) for i in range(rng.randrange(1, 6))]
        credits += [(account, 100 * k + i, rng.choice([999, 1000, 1002, None]), rng.choice(["1", "2", "3", None]), rng.choice([True, False, None]), rng.choice(["posted", "pending"]), day()) for i in range(rng.randrange(0, 6))]
    requests += [("same", "q", 1000, "1", None), ("same", "q", 1001, "2", None), ("twice", "q", 1000, "1", None), ("tail", "q", 1000, "1", "2026-01-02")]
    credits += [("same", -1, 1000, "1", True, "posted", "2026-01-02"), ("twice", -2, 1000, "1", True, "posted", "2026-01-02"), ("twice", -2, 1001, "1", True, "posted", "2026-01-02"), ("tail", -3, 999, None, None, "pending", "2026-01-02")]
    got = {(x.account_id, x.request_id): (x.status, x.txn_id, x.n_candidates) for x in bank.reconcile_credits(*tables(spark, requests, credits)).collect()}
    want = by_loops(requests, credits)
    assert got == want and {"confirmed", "pending", "ambiguous", "not_found"} == {v[0] for v in want.values()}


def test_no_pair_is_formed(spark):
    """Requests and credits of one amount and account: the work is that of the rows, where all pairs would be 400,000,000."""
    n = 20_000
    r = spark.range(n).select(F.lit("a").alias("account_id"), F.concat(F.lit("q"), "id").alias("request_id"), F.lit(500).cast("long").alias("expected_cents"), F.col("id").cast("string").alias("card_last4"), F.lit("2026-01-01").cast("timestamp").alias("refund_issued_at"))
    t = spark.range(n).select(F.lit("a").alias("account_id"), F.col("id").alias("txn_id"), F.lit(500).cast("long").alias("amount_cents"), F.col("id").cast("string").alias("txn_last4"), F.lit(True).alias("merchant_match"), F.lit("posted").alias("txn_state"), F.lit("2026-01-02").cast("timestamp").alias("posted_at"))
    one = bank.reconcile_credits(r, t)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the requests, to keep those without candidates
    for out in (one, bank.reconcile_rounds(r, t)):
        assert out.where("status = 'confirmed' AND request_id = concat('q', txn_id)").agg(F.count("*"), F.min("n_candidates"), F.max("n_candidates")).first()[:] == (n, n, n)
