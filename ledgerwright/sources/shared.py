"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder.

    Where the setting is missing, a temporary folder is made and set if the master is local (tests); on a cluster that
    would scatter a table over the executors' own disks, so it is an error there.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-checkpoints-', dir='/tmp')}"
        spark.conf.set(SETTING, folder)
    return folder


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a table written inside the block go when it is written: what was written is read instead.

    Otherwise they lie on the executors' disks until the driver happens to collect its garbage, those of all steps of a job together.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder; one that isn't there is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A name of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
