"""The ledger as a stream: captures arrive in files, late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import schema
from ..sources import ledger_store


def stream_ledger(captures: DataFrame, path: str, checkpoint: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """Adds each micro-batch of a capture stream to the stored ledger at `path` (sources.ledger_store).

    A batch writes its captures and what they changed, whatever the ledger's size. Captures are ordered by their own
    (batch_id, seq), so late, repeated and differently cut batches give the same ledger, and a repeated epoch is left as it is.
    ledger_store.read_ledger_store() gives the ledger, read_changes() the feed; ledger_store.compact_ledger() folds the deltas from time to time.
    """
    def add(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            ledger_store.append_captures(batch, path, epoch, buckets)
        finally:
            batch.unpersist()

    return captures.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stage_stream(captures: DataFrame, idle: str | None = None) -> DataFrame:
    """account_id, record_id, stage_rank, refund_cents, n_captures after each micro-batch, from keyed state that never moves back.

    State is three numbers a record. Records stay without a timeout; `idle` (milliseconds as text) drops the state of
    records without captures for that long.
    """
    rows = captures.select("account_id", "record_id", "seq", schema.stage_rank(F.col("return_stage")).alias("rank"), "refund_cents")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rank, cents, at, n = state.get if state.exists else (0, None, -1, 0)
        for part in parts:
            n += len(part)
            rank = max(rank, int(part["rank"].max()))
            known = part[part["refund_cents"].notna()].sort_values("seq")
            if len(known) and int(known["seq"].iloc[-1]) >= at:
                cents, at = int(known["refund_cents"].iloc[-1]), int(known["seq"].iloc[-1])
        state.update((rank, cents, at, n))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame({"account_id": [key[0]], "record_id": [key[1]], "stage_rank": [rank], "refund_cents": pd.array([cents], dtype="Int64"), "n_captures": [n]})

    return rows.groupBy("account_id", "record_id").applyInPandasWithState(
        fold, "account_id string, record_id string, stage_rank int, refund_cents long, n_captures long", "rank int, cents long, at long, n long", "update",
        GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
