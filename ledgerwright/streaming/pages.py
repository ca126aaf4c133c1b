"""Page captures as a stream: which pages changed, and which complete orders a session shows for the first time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..sources.ledger_store import Folder

CHANGES = "account_id string, place string, page_id long, captured_at timestamp, signature string, changed boolean, late boolean"
STATE = "signature string, micros long, page_id long"


def _captured(captures: DataFrame) -> DataFrame:
    """What is compared of a capture; a null time is the oldest."""
    return captures.select(
        "account_id", X.location_key(F.col("url")).alias("place"), F.col("page_id").cast("long").alias("page_id"), F.col("captured_at").cast("timestamp").alias("captured_at"), X.page_signature(F.col("text")).alias("signature"),
        F.coalesce(F.unix_micros(F.col("captured_at").cast("timestamp")), F.lit(-(1 << 62))).alias("micros"))


def _judged(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """CHANGES of a batch's captures against the state of the batches before: account_id, place, signature, micros, page_id."""
    both = rows.withColumn("fresh", F.lit(True))
    if state is not None:
        both = both.unionByName(state.withColumn("fresh", F.lit(False)), allowMissingColumns=True)
    place = W.partitionBy("account_id", "place")
    at = F.struct("micros", "page_id")
    both = both.withColumn("known", F.max(F.when(~F.col("fresh"), F.struct("micros", "page_id", "signature"))).over(place))
    both = both.withColumn("late", F.col("known").isNotNull() & F.coalesce(at < F.struct("known.micros", "known.page_id"), F.lit(False)))
    before = F.lag(F.struct("signature")).over(W.partitionBy("account_id", "place", "late").orderBy("micros", "page_id", "fresh", "signature"))
    both = both.withColumn("before", F.when(F.col("late"), F.struct("known.signature")).otherwise(before))
    changed = F.col("before").isNull() | ~F.col("before.signature").eqNullSafe(F.col("signature"))
    return both.withColumn("changed", changed).where("fresh").select("account_id", "place", "page_id", "captured_at", "signature", "changed", "late")


def stream_changed_pages(captures: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """changed_pages() as tables: each micro-batch writes its changes to <path>/changes/e=<epoch>, then the last signature, time and page of every
    place to <path>/state/e=<epoch>.

    All captures of a batch are compared in one shuffle by place, without Python. A batch costs its captures and a row for every place
    known so far. Folders are written aside and become visible by one rename; an epoch whose state is there is left as it is. read_changed_pages() gives the rows.
    """
    def add(batch: DataFrame, epoch: int) -> None:
        folder, name = Folder(batch.sparkSession, path), f"e={epoch:012d}"
        if folder.exists("state", name):
            return
        read = batch.sparkSession.read
        before = max((e for e in folder.numbers("state", "e") if e < epoch), default=None)
        state = read.parquet(folder.at("state", f"e={before:012d}")) if before is not None else None
        for left in (("changes", name), ("_writing-changes",), ("_writing-state",)):
            folder.remove(*left)
        _judged(_captured(batch), state).write.parquet(folder.at("_writing-changes"))
        folder.place("_writing-changes", "changes", name)
        seen = read.parquet(folder.at("changes", name)).select(
            "account_id", "place", "signature", F.coalesce(F.unix_micros("captured_at"), F.lit(-(1 << 62))).alias("micros"), "page_id", F.lit(True).alias("fresh"))
        every = seen if state is None else seen.unionByName(state.withColumn("fresh", F.lit(False)))
        last = every.groupBy("account_id", "place").agg(F.max(F.struct("micros", "page_id", "fresh", "signature")).alias("s"))
        last.select("account_id", "place", "s.signature", "s.micros", "s.page_id").write.parquet(folder.at("_writing-state"))
        folder.place("_writing-state", "state", name)
        for old in folder.numbers("state", "e"):
            if before is not None and old < before:
                folder.remove("state", f"e={old:012d}")

    return captures.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_changed_pages(spark: SparkSession, path: str) -> DataFrame:
    """What stream_changed_pages() wrote of all batches whose state is there."""
    folder = Folder(spark, path)
    whole = max(folder.numbers("state", "e"), default=-1)
    found = [folder.at("changes", f"e={e:012d}") for e in folder.numbers("changes", "e") if e <= whole]
    return spark.read.schema(CHANGES).parquet(*found) if found else spark.createDataFrame([], CHANGES)


def changed_pages(captures: DataFrame, idle: str | None = None) -> DataFrame:
    """One row a capture: place, signature, changed (against the capture before it of the same account and place), late.

    The batch form is pages.classify_pages(); stream_changed_pages() does the same for many places, since here Python is called once a place and
    micro-batch. State is a place's last signature, its time and page id. Within a micro-batch captures
    are taken by (captured_at, page_id). One that is older than the state is late: it is compared with the state, which
    stays as it is. `idle` (milliseconds as text) drops places without captures for that long; the next capture of such a
    place counts as changed. Null accounts, places and times make groups and times of their own (a null time is the oldest).
    """
    rows = _captured(captures)

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        seen = pd.concat(list(parts))
        if len(seen) > 1:
            seen = seen.sort_values(["micros", "page_id"], kind="stable")
        changed, late = [], []
        for signature, micros, page in zip(seen["signature"], seen["micros"], seen["page_id"]):
            old = last is not None and (micros, page) < (last[1], last[2])
            signature = None if pd.isna(signature) else signature
            changed.append(last is None or last[0] != signature)
            late.append(old)
            if not old:
                last = (signature, int(micros), int(page))
        state.update(last)
        if idle:
            state.setTimeoutDuration(int(idle))
        yield seen[["account_id", "place", "page_id", "captured_at", "signature"]].assign(changed=changed, late=late)

    return rows.groupBy("account_id", "place").applyInPandasWithState(judge, CHANGES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def session_refreshes(pages: DataFrame, completed: DataFrame, delay: str = "1 day") -> DataFrame:
    """account_id, session_id, order_id: complete orders, once for each session that shows them; the batch form is coverage.session_refresh_set().

    pages has order_ids and captured_at, completed is a table. Spark keeps one key an order and session, and forgets it
    when the watermark, `delay` behind the newest capture, has passed it by another `delay`: sessions are shorter than that.
    """
    shown = pages.withColumn("captured_at", F.col("captured_at").cast("timestamp")).withWatermark("captured_at", delay).select("account_id", "session_id", "captured_at", F.explode("order_ids").alias("order_id"))
    due = shown.join(completed.select("account_id", "order_id").distinct(), ["account_id", "order_id"], "left_semi")
    return due.dropDuplicatesWithinWatermark(["account_id", "session_id", "order_id"]).select("account_id", "session_id", "order_id")
