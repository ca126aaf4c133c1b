"""A stored ledger that grows by its captures: deltas, compaction and a change feed.

    <path>/ledger.json                      number of buckets
    <path>/deltas/e=<epoch>/bucket=<k>/     captures of a batch
    <path>/changes/e=<epoch>/               what that batch did to the ledger's records
    <path>/base/v=<epoch>/evidence/bucket=<k>/, .../folded/bucket=<k>/
                                            captures of all batches up to an epoch, and the ledger they make

The ledger is a function of the set of captures (merge.merge_captures), so batches may come in any order and again. A batch
writes its own captures and nothing else. Every folder is written aside and becomes visible by one rename; what a broken
write leaves behind is removed by the next. There is one writer; compaction keeps what the version before it needs, so
that readers who have planned on that one can end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.merge import ID, fingerprint, merge_captures
from .shared import brief_shuffles, fresh_folder, removed

ORDER = ["account_id", "order_id"]


class Folder:
    """A folder of the file system that the path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def numbers(self, kind: str, mark: str) -> list[int]:
        return [int(n[len(mark) + 1:]) for n in self.names(kind) if n.startswith(mark + "=")]

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self._at(*parts))

    def remove(self, *parts: str) -> None:
        self.fs.delete(self._at(*parts), True)

    def place(self, written: str, *parts: str) -> None:
        """Makes a written folder visible under its name."""
        target = self._at(*parts)
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(self._at(written), target):
            raise OSError(f"{written} could not be put in place as {target}")

    def at(self, *parts: str) -> str:
        return "/".join([self.path, *parts])


def _named(epoch: int) -> str:
    return f"{epoch:012d}"


def _buckets(folder: Folder, wanted: int) -> int:
    """The ledger's number of buckets, fixed by its first batch."""
    if not folder.exists("ledger.json"):
        # written aside and renamed, so that a broken write leaves no half of it
        folder.remove("_ledger.json")
        row = folder.spark.createDataFrame([(json.dumps({"buckets": wanted}),)], "value string")
        row.coalesce(1).write.text(folder.at("_ledger.json"))
        folder.place("_ledger.json", "ledger.json")
    return int(json.loads(folder.spark.read.text(folder.at("ledger.json")).first()[0])["buckets"])


def _placed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*ORDER), F.lit(buckets)).cast("int")).hint("rebalance", "bucket")


def _captures(folder: Folder, epochs: list[int]) -> DataFrame | None:
    """Captures of these deltas; batches may have added columns."""
    paths = [folder.at("deltas", f"e={_named(e)}") for e in epochs]
    frames = [folder.spark.read.parquet(p) for p in paths]
    made = None
    for f in frames:
        made = f if made is None else made.unionByName(f, allowMissingColumns=True)
    return made


def _base(folder: Folder) -> int | None:
    return max(folder.numbers("base", "v"), default=None)


def _evidence(folder: Folder, epochs: list[int]) -> DataFrame | None:
    """Captures of all orders that the deltas of these epochs touch, those of the base included."""
    new, base = _captures(folder, epochs), _base(folder)
    if new is None or base is None:
        return new
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most the ledger's number of buckets
    old = folder.spark.read.parquet(folder.at("base", f"v={_named(base)}", "evidence")).where(F.col("bucket").isin(touched))
    return old.join(new.select(*ORDER).distinct(), ORDER, "left_semi").unionByName(new, allowMissingColumns=True)


def append_captures(captures: DataFrame, path: str, epoch: int, buckets: int = 64, feed: bool = True) -> None:
    """Adds a batch of captures as the delta of its epoch and, with `feed`, says what it changed. An epoch that is there already is left as it is.

    `buckets` only counts for the first batch of a ledger. Batches without rows leave an empty delta, so that a replay is known.
    """
    folder = Folder(captures.sparkSession, path)
    n = _buckets(folder, buckets)
    for left in folder.names():
        if left.startswith("_writing-"):
            folder.remove(left)
    name, base = f"e={_named(epoch)}", _base(folder)
    if base is not None and epoch <= base:
        return
    if not folder.exists("deltas", name):
        with brief_shuffles(folder.spark):
            _placed(captures, n).write.partitionBy("bucket").parquet(folder.at(f"_writing-{name}"))
        if not any(x.startswith("bucket=") for x in folder.names(f"_writing-{name}")):
            captures.limit(0).withColumn("bucket", F.lit(0)).write.mode("overwrite").parquet(folder.at(f"_writing-{name}"))
        folder.place(f"_writing-{name}", "deltas", name)
    if feed and not folder.exists("changes", name):
        with _merging(folder.spark) as staged, brief_shuffles(folder.spark):
            batch_changes(folder, epoch, staged).write.parquet(folder.at(f"_writing-c{name}"))
        folder.place(f"_writing-c{name}", "changes", name)


@contextmanager
def _merging(spark: SparkSession) -> Iterator[str]:
    """A folder for the captures of a merge, there until what they make is written."""
    path = fresh_folder(spark, "merging")
    try:
        yield path
    finally:
        removed(spark, path)


def batch_changes(folder: Folder, epoch: int, staged: str) -> DataFrame:
    """account_id, record_id, change (inserted, updated, unchanged, removed), scanned_at: what the epoch's captures did to the records of
    their orders. scanned_at is null where a record stays as it was, unless a complete detail capture confirmed it.

    The new folder `staged` takes the captures and must stay until the result is written."""
    base = _base(folder)
    epochs = [e for e in folder.numbers("deltas", "e") if (base is None or e > base) and e <= epoch]
    new = _captures(folder, [epoch])
    orders = new.select(*ORDER).distinct()
    every = _evidence(folder, epochs).join(orders, ORDER, "left_semi")
    fresh = new.select(*ID, "batch_id", "seq").distinct()
    earlier = every.join(fresh, [*ID, "batch_id", "seq"], "left_anti")
    # one merge of both states, kept apart by a mark before the account
    mark = lambda df, side: df.drop("bucket").withColumn("account_id", F.concat(F.lit(side), "account_id"))
    both = fingerprint(merge_captures(mark(earlier, "0").unionByName(mark(every, "1")), staged=staged).drop("last_scanned_at"))
    state = lambda side: F.max(F.when(F.substring("account_id", 1, 1) == side, F.col("__fp")))
    found = both.groupBy(F.expr("substring(account_id, 2)").alias("account_id"), "record_id").agg(state("0").alias("old"), state("1").alias("new"))
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    whole = F.max(F.coalesce(F.col("detail_scan_complete"), F.lit(False))) if "detail_scan_complete" in new.columns else F.lit(False)
    scans = new.groupBy(*ID).agg(F.max("captured_at").alias("at"), whole.alias("whole"))
    changes = found.select(*ID, change.alias("change")).join(scans, ID, "left")
    return changes.select(*ID, "change", F.when((F.col("change") != "unchanged") | F.col("whole"), F.col("at")).alias("scanned_at"))


def read_changes(spark: SparkSession, path: str) -> DataFrame | None:
    """The change feed that is kept: epoch, account_id, record_id, change, scanned_at."""
    folder = Folder(spark, path)
    found = folder.numbers("changes", "e")
    return spark.read.option("basePath", folder.at("changes")).parquet(*[folder.at("changes", f"e={_named(e)}") for e in found]).withColumnRenamed("e", "epoch") if found else None


def read_ledger_store(spark: SparkSession, path: str, staged: str | None = None) -> DataFrame | None:
    """The ledger of all captures; None if there is none. Orders without new captures are read as they were folded last.

    `staged` names a new folder for the captures that are merged, which must stay until the result is used; by default one that stays for good.

    With a change feed, last_scanned_at is the time of the last batch that changed a record or saw its details completely.
    """
    folder = Folder(spark, path)
    base = _base(folder)
    epochs = [e for e in folder.numbers("deltas", "e") if base is None or e > base]
    folded = spark.read.parquet(folder.at("base", f"v={_named(base)}", "folded")).drop("bucket") if base is not None else None
    if not epochs:
        return folded
    new = _captures(folder, epochs)
    made = merge_captures(_evidence(folder, epochs).drop("bucket"), staged=staged or fresh_folder(spark, "merging"))
    kept = [e for e in folder.numbers("changes", "e") if e in set(epochs)]
    if kept:
        scans = spark.read.parquet(*[folder.at("changes", f"e={_named(e)}") for e in kept]).groupBy(*ID).agg(F.max("scanned_at").alias("__scan"))
        made = made.join(scans, ID, "left")
        if folded is not None:
            made = made.join(folded.select(*ID, F.col("last_scanned_at").alias("__before")), ID, "left")
        else:
            made = made.withColumn("__before", F.lit(None).cast("timestamp"))
        made = made.withColumn("last_scanned_at", F.coalesce("__scan", "__before", "last_scanned_at")).drop("__scan", "__before")
    if folded is None:
        return made
    return folded.join(new.select(*ORDER).distinct(), ORDER, "left_anti").unionByName(made, allowMissingColumns=True)


def thinned(captures: DataFrame) -> DataFrame:
    """Captures without those of orders that say the same as the ones right before and after them: no later capture can make them count.

    Returns keep all, since a batch that captures one authoritatively decides about its neighbours.
    """
    said = F.struct(*[c for c in captures.columns if c not in ("batch_id", "seq", "captured_at", "bucket")])
    order = W.partitionBy(*ID).orderBy("batch_id", "seq")
    same = lambda f: F.coalesce(f(said, 1).over(order).eqNullSafe(said), F.lit(False))
    marked = captures.withColumn("__between", same(F.lag) & same(F.lead) & F.lag(F.lit(1)).over(order).isNotNull() & F.lead(F.lit(1)).over(order).isNotNull() & (F.col("record_type") == "order"))
    return marked.where(~F.coalesce("__between", F.lit(False))).drop("__between")


def compact_ledger(spark: SparkSession, path: str) -> int | None:
    """Folds all deltas into a new base; the epoch it stands for, None without deltas. The base before it, and the deltas that
    belong to that one, stay for readers until the next compaction; older ones go."""
    folder = Folder(spark, path)
    base, found = _base(folder), folder.numbers("deltas", "e")
    epochs = [e for e in found if base is None or e > base]
    if not epochs:
        return None
    n, name = _buckets(folder, 0), f"v={_named(max(epochs))}"
    folder.remove(f"_writing-{name}")
    every = _captures(folder, epochs)
    if base is not None:
        every = spark.read.parquet(folder.at("base", f"v={_named(base)}", "evidence")).unionByName(every, allowMissingColumns=True)
    unique = every.drop("bucket").dropDuplicates([*ID, "batch_id", "seq"])
    with _merging(spark) as staged, brief_shuffles(spark):
        _placed(thinned(unique) if "record_type" in unique.columns else unique, n).write.partitionBy("bucket").parquet(folder.at(f"_writing-{name}", "evidence"))
        _placed(read_ledger_store(spark, path, staged), n).write.partitionBy("bucket").parquet(folder.at(f"_writing-{name}", "folded"))
    folder.place(f"_writing-{name}", "base", name)
    for old in folder.numbers("base", "v"):
        if base is not None and old < base:
            folder.remove("base", f"v={_named(old)}")
    for kind in ("deltas", "changes"):
        for e in folder.numbers(kind, "e"):
            if base is not None and e <= base:
                folder.remove(kind, f"e={_named(e)}")
    return max(epochs)
