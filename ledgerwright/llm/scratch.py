"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import brief_shuffles, fresh_folder, removed

#: Lists of the tables written inside the open `cleared` blocks, the innermost last.
_open: list[list[str]] = []


def staged(df: DataFrame, outlives: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut, and a lost executor loses nothing of it.

    With `outlives` it stays when the innermost `cleared` block ends, and goes with the one around it.
    """
    path = fresh_folder(df.sparkSession, "staged")
    around = _open[:-1] if outlives else _open
    if around:
        around[-1].append(path)
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes the tables staged inside the block when it ends; results must have been written or collected by then.

    Operators return DataFrames that read staged tables, so the caller decides when these may go. Without such a block
    they stay in the shared folder.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            removed(spark, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df, in whatever case."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        free.append(name)
    return free
