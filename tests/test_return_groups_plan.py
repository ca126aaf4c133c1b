"""Return groups: one shuffle, and no sort of all records before it."""

from ledgerwright.operators import rows as B

NOW = "2026-01-01 00:00:00"


def test_groups_share_the_shuffle_of_deduplication(spark):
    records = [("a", f"o{i % 7}", f"r{i}", f"T{i % 3}", "started" if i % 2 else "received", f"B{i % 5:09d}") for i in range(60)]
    r = spark.createDataFrame(records, "account_id string, order_id string, record_id string, return_token string, return_stage string, asin string")
    groups = B.group_returns(B.dedupe_returns(B.prepared_returns(r, NOW)))
    text = groups._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1, text
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") and "WindowGroupLimit" not in text[text.index("Exchange hashpartitioning"):]
    asins = {(o, t): {x[5].lower() for x in records if x[1] == o and x[3] == t} for _, o, _, t, _, _ in records}
    assert {(x.order_id, x.group_key): x.n_records for x in groups.collect()} == {k: len(v) for k, v in asins.items()}
