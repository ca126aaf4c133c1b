"""Registered queries of streams: the stored event log and pages that arrive in files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import event_log
from ..sources.shared import fresh_folder
from ..streaming import pages as page_streams
from . import registered
from .adapters import duck_ctes, spark_view

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        SPARK[f.__name__], SQL[f.__name__] = f, sql
        return f
    return add


def arriving(s: SparkSession, rows: DataFrame, part, n: int) -> DataFrame:
    """A stream of the rows in n micro-batches, by the number that `part` gives a row."""
    source = fresh_folder(s, "arriving")
    for k in range(n):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(source)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)


def finished(s: SparkSession, stream: DataFrame) -> DataFrame:
    """Everything that a stream in append mode writes until its source is empty."""
    out = fresh_folder(s, "streamed")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_folder(s, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


@query(f"""
WITH {duck_ctes('v_event_log')}
SELECT account_id, event_id, logged_at FROM v_event_log QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY logged_at DESC, event_id DESC) <= 5""")
def bounded_event_log(s, d):
    """Events arrive in four batches, whatever their times; the log is compacted every other batch and keeps five an account."""
    path, log = fresh_folder(s, "log"), spark_view(s, d, "v_event_log").withColumnRenamed("logged_at", "at")
    stream = arriving(s, log, F.pmod(F.col("event_id"), F.lit(4)), 4)
    event_log.stream_log(stream, path, fresh_folder(s, "checkpoint"), n=5, compact_every=2).awaitTermination()
    return event_log.read_log(s, path, 5).select("account_id", "event_id", F.col("at").alias("logged_at"))


@query(registered.SQL["session_refresh"])
def session_refresh_stream(s, d):
    """The pages of session 1 arrive before those of session 2; both tell of the same years, so the watermark allows for all of them."""
    shown = registered.history_pages(s, d)
    stream = arriving(s, shown, F.col("session_id") - 1, 2)
    return finished(s, page_streams.session_refreshes(stream, registered._completed(s, d), "4000 days"))


@query(f"""
WITH {duck_ctes('v_page_text')},
seen AS (
  SELECT page_id, CAST(captured_at AS TIMESTAMP) + to_days(CAST(v AS INTEGER)) AS captured_at, CASE WHEN page_id * (v + 1) % 4 = 0 THEN 'closed' ELSE '' END AS tail
  FROM v_page_text, (VALUES (0), (1)) AS t(v))
SELECT page_id, captured_at, lag(tail) OVER (PARTITION BY page_id ORDER BY captured_at) IS DISTINCT FROM tail AS changed FROM seen""")
def changed_pages_stream(s, d):
    """Every page is captured twice; every fourth gets a line about a return."""
    once = spark_view(s, d, "v_page_text").select("account_id", "page_id", "url", "captured_at", "text").withColumn("v", F.explode(F.array(*map(F.lit, range(2)))))
    tail = F.when(F.col("page_id") * (F.col("v") + 1) % 4 == 0, "\nReturn closed").otherwise("")
    rows = once.withColumns({"text": F.concat("text", tail), "captured_at": F.col("captured_at").cast("timestamp") + F.make_dt_interval(F.col("v"))})
    source, path, checkpoint = (fresh_folder(s, x) for x in ("arriving", "changes", "checkpoint"))
    # what has arrived when the stream goes on is one micro-batch, of as many files as it took tasks to write
    for k in range(2):
        rows.where(F.col("v") == k).write.mode("append").parquet(source)
        page_streams.stream_changed_pages(s.readStream.schema(rows.schema).parquet(source), path, checkpoint).awaitTermination()
    return page_streams.read_changed_pages(s, path).select("page_id", "captured_at", "changed")
