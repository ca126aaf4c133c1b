"""A stored event log that keeps the newest events of each account.

    <path>/deltas/e=<epoch>/   events of a batch
    <path>/base/v=<epoch>/     the newest events of each account out of all batches up to an epoch

Appending writes a batch and nothing else; compaction keeps what retention lets stay, so the log holds at most n events an
account and those of the batches since. Folders are written aside and become visible by one rename. There is one writer;
the base before the newest one, and its deltas, stay until the next compaction, for readers who have planned on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import schema
from .io import latest_events
from .ledger_store import Folder


def _name(mark: str, epoch: int) -> str:
    return f"{mark}={epoch:012d}"


def _base(folder: Folder) -> int | None:
    return max(folder.numbers("base", "v"), default=None)


def _since(folder: Folder) -> list[int]:
    """Epochs of the batches that the newest base doesn't hold."""
    base = _base(folder)
    return [e for e in folder.numbers("deltas", "e") if base is None or e > base]


def append_batch(events: DataFrame, path: str, epoch: int) -> bool:
    """Adds the events (account_id, event_id, at and others) of an epoch; whether it was new. An epoch that is there, or in a base, is left alone.

    Batches may bring new columns. An empty batch leaves an empty folder.
    """
    folder = Folder(events.sparkSession, path)
    base = _base(folder)
    if folder.exists("deltas", _name("e", epoch)) or (base is not None and epoch <= base):
        return False
    aside = f"_writing-{_name('e', epoch)}"
    folder.remove(aside)
    events.write.parquet(folder.at(aside))
    folder.place(aside, "deltas", _name("e", epoch))
    return True


def _stored(folder: Folder) -> DataFrame | None:
    base = _base(folder)
    at = ([folder.at("base", _name("v", base))] if base is not None else []) + [folder.at("deltas", _name("e", e)) for e in _since(folder)]
    return folder.spark.read.option("mergeSchema", "true").parquet(*at) if at else None


def read_log(spark: SparkSession, path: str, n: int = schema.MAX_EVENTS) -> DataFrame | None:
    """The newest n events of each account, by (at, event_id); None if there are none. An event that arrived in two batches counts twice."""
    stored = _stored(Folder(spark, path))
    return None if stored is None else latest_events(stored, n)


def compact_log(spark: SparkSession, path: str, n: int = schema.MAX_EVENTS) -> int | None:
    """Writes the newest n events of each account as a new base; its epoch, None without new batches.

    Late events count by their own time, so the order of batches doesn't matter. n must not grow from one compaction to the next.
    """
    folder = Folder(spark, path)
    epochs, before = _since(folder), _base(folder)
    if not epochs:
        return None
    name = _name("v", max(epochs))
    folder.remove(f"_writing-{name}")
    latest_events(_stored(folder), n).write.parquet(folder.at(f"_writing-{name}"))
    folder.place(f"_writing-{name}", "base", name)
    if before is not None:
        for kind, mark, gone in (("base", "v", lambda e: e < before), ("deltas", "e", lambda e: e <= before)):
            for e in filter(gone, folder.numbers(kind, mark)):
                folder.remove(kind, _name(mark, e))
    return max(epochs)


def stream_log(events: DataFrame, path: str, checkpoint: str, n: int = schema.MAX_EVENTS, compact_every: int = 20, **trigger) -> StreamingQuery:
    """Adds each micro-batch of an event stream to the log, and compacts it every few batches. A repeated epoch changes nothing."""
    def add(batch: DataFrame, epoch: int) -> None:
        append_batch(batch, path, epoch)
        if epoch % compact_every == compact_every - 1:
            compact_log(batch.sparkSession, path, n)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
