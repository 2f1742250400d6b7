"""Rebuild only what changed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = ("path", "length", "modificationTime", "revision")


def source_signatures(listing: DataFrame, revision: str) -> DataFrame:
    """What a finished unit was built from: file, size, time, builder revision."""
    return listing.select(
        "split", "unit", "path", "length", "modificationTime", F.lit(revision).alias("revision")
    )


def pending(current: DataFrame, done: DataFrame | None) -> DataFrame:
    """Sources that are new, changed, or were built by another revision."""
    return current if done is None else current.join(done, list(SIGNATURE), "left_anti")


def rebuild(current: DataFrame, done: DataFrame | None, build, sink: str, log: str) -> DataFrame:
    """Build pending units, append them, then record their signatures.

    The log is written last: a run that dies repeats its units instead of
    losing them, and the sink replaces whole (split, unit) partitions.
    """
    todo = pending(current, done)
    if todo.isEmpty():
        return todo
    (
        build(todo)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("split", "unit")
        .parquet(sink)
    )
    todo.write.mode("append").parquet(log)
    return todo
