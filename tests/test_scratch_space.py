"""What only leads to a result goes when it has been used: shuffle files, staged tables, captures of a merge; exports are compressed."""

import os

from pyspark.sql import functions as F

from ledgerwright.llm import phrases, scratch
from ledgerwright.sources import io, ledger_store, shared


def held(spark):
    folder = shared.shared_folder(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_exports_are_compressed_and_whole(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.lit("the same words again and again").alias("words"), F.array("id").alias("ids"))
    io.export_ledger_json(rows, rows.select("id"), f"{tmp_path}/json")
    files = [f for f in os.listdir(f"{tmp_path}/json/rows") if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    back = spark.read.schema(rows.schema).json(f"{tmp_path}/json/rows")
    assert sorted(back.collect()) == sorted(rows.collect()) and spark.read.json(f"{tmp_path}/json/ledger").count() == 1000


def test_shuffles_of_written_tables_go(spark):
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, setting = blocks(), spark.conf.get(shared.CLEANUP, None)
    kept = scratch.staged(spark.range(50_000).groupBy((F.col("id") % 40_000).alias("k")).count())
    assert blocks() <= before and spark.conf.get(shared.CLEANUP, None) == setting
    assert kept.count() == 40_000


def test_phrases_leave_only_what_the_result_reads(spark):
    before = held(spark)
    docs = spark.createDataFrame([("en", f"red lamp on desk {k % 3} red lamp on desk")for k in range(30)], "lang string, text string")
    found = phrases.mine_phrases(docs, least=5)
    assert len(held(spark) - before) == 3 and found.count() > 0


def test_merged_captures_go_when_changes_are_written(spark, tmp_path):
    before = held(spark)
    rows = spark.createDataFrame([("a", f"o{k}", f"r{k}", "return", 0, k, "shipped") for k in range(9)], "account_id string, order_id string, record_id string, record_type string, batch_id long, seq long, return_stage string")
    ledger_store.append_captures(rows.withColumn("captured_at", F.lit("2026-01-01").cast("timestamp")), f"{tmp_path}/led", 0, buckets=2)
    ledger_store.compact_ledger(spark, f"{tmp_path}/led")
    assert held(spark) == before
    assert ledger_store.read_changes(spark, f"{tmp_path}/led").count() == ledger_store.read_ledger_store(spark, f"{tmp_path}/led").count() == 9
