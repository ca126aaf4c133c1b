"""Steps that write what they share: the staged merge, and page changes as tables."""

import datetime as dt

from ledgerwright.operators import merge
from ledgerwright.sources.shared import fresh_folder
from ledgerwright.streaming import pages

CAPTURE = "account_id string, url string, page_id long, captured_at timestamp, text string"


def test_page_changes_as_tables(spark):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    batches = [
        [("a", "https://s/x", 1, at(2), "total 1"), ("a", "https://s/x", 2, at(3), "total 1"), ("a", "https://s/y", 3, None, "total 5"), (None, None, 4, at(1), None)],
        [("a", "https://s/x", 5, at(1), "total 1"), ("a", "https://s/x", 6, at(1), "total 9"), ("a", "https://s/x", 7, at(4), "total 2"), ("a", "https://s/y", 8, at(1), "total 5"), (None, None, 9, at(2), None)]]
    source, path = fresh_folder(spark, "arriving"), fresh_folder(spark, "changes")
    for b in batches:
        spark.createDataFrame(b, CAPTURE).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", 1).parquet(source)
    pages.stream_changed_pages(stream, path, fresh_folder(spark, "checkpoint")).awaitTermination()
    got = {r.page_id: (r.changed, r.late) for r in pages.read_changed_pages(spark, path).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, False), 4: (True, False), 5: (False, True), 6: (True, True), 7: (True, False), 8: (False, False), 9: (False, False)}


def test_staged_merge(spark):
    rows = spark.createDataFrame(
        [("a", "r", 0, 1, "return", "o", "t", True, "x"), ("a", "r", 0, 1, "return", "o", "t", True, "x"), ("a", "q", 0, 2, "return", "o", "t", False, "y"), ("a", "r", 1, 3, "return", "o", "t", True, "z")],
        "account_id string, record_id string, batch_id long, seq long, record_type string, order_id string, return_token string, authoritative boolean, status_text string")
    plain = merge.merge_captures(rows)
    staged = merge.merge_captures(rows, staged=fresh_folder(spark, "merging"))
    assert sorted(map(str, staged.collect())) == sorted(map(str, plain.collect()))
