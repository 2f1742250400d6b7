"""File fingerprints, verification, sinks and the sealed ranking dataset."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ranking import forbid_columns


# A file up to this size is hashed as one value inside the JVM; a larger one is streamed.
WHOLE_BYTES = 256 << 20
STREAM_BYTES = 8 << 20


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the named files, read a piece at a time."""
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            # Spark tells local files as file:/x, which is no full address.
            address = path if "://" in path else path.replace(":/", ":///", 1)
            system, name = pafs.FileSystem.from_uri(quote(address, safe="/:@"))
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while piece := stream.read(STREAM_BYTES):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield batch.drop_columns(["sha256"]).append_column("sha256", pa.array(digests, pa.string()))


def fingerprint(
    spark: SparkSession, tiers: Mapping[str, Sequence[str]], *, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """(tier, path, sha256, bytes) for every file of every tier's patterns.

    A file may belong to several tiers; it is read once per pattern. A pattern
    without files is an error. Contents are hashed where they are read and never
    shuffled. Files above ``whole_bytes`` are streamed through a buffer of fixed size,
    so their length has no limit; one file is one task's work, as its digest is sequential.
    """
    out = None
    for tier, patterns in tiers.items():
        for pattern in patterns:
            files = spark.read.format("binaryFile").load(pattern)
            if not files.inputFiles():
                raise ValueError(f"no file matches {pattern}")
            # Scans pass over empty files; Spark's listing of the pattern has them.
            listed = [(unquote(f).replace("file:///", "file:/"),) for f in files.inputFiles()]
            empty = spark.createDataFrame(listed, "path string").join(
                files.select("path"), "path", "left_anti"
            ).select("path", F.lit(0).cast("bigint").alias("length"))
            # The length filter reaches the reader: contents it rules out are not read.
            small = files.where(F.col("length") <= whole_bytes)
            large = files.where(F.col("length") > whole_bytes)
            told = lambda f, digest: f.select(
                F.lit(tier).alias("tier"), "path", F.col("length").alias("bytes"), digest.alias("sha256")
            )
            named = told(large, F.lit(None).cast("string"))
            rows = told(small, F.sha2("content", 256)).unionByName(
                named.mapInArrow(_streamed, named.schema)
            ).unionByName(told(empty, F.lit(hashlib.sha256(b"").hexdigest()))).select("tier", "path", "sha256", "bytes")
            out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def tier_totals(prints: DataFrame) -> DataFrame:
    return prints.groupBy("tier").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )


def verify(manifest: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Problems only: missing, unexpected or changed content."""
    m = manifest.select(key, F.col("sha256").alias("_m")).distinct()
    c = current.select(key, F.col("sha256").alias("_c")).distinct()
    reason = (
        F.when(F.col("_c").isNull(), "missing")
        .when(F.col("_m").isNull(), "unexpected")
        .when(F.col("_m") != F.col("_c"), "content-mismatch")
    )
    joined = m.join(c, key, "full_outer").select(key, reason.alias("problem"))
    return joined.where(F.col("problem").isNotNull())


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = ("split",)) -> None:
    """Partitioned Parquet; the commit protocol makes it all or nothing."""
    df.write.partitionBy(*partitions).parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Report tables have a fixed number of rows, so they go to one file."""
    writer = df.coalesce(1).write
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def write_ranking_dataset(df: DataFrame, path: str) -> None:
    forbid_columns(df).write.partitionBy("subset").parquet(path)


def read_ranking_dataset(spark: SparkSession, path: str, subset: str) -> DataFrame:
    """One subset, pruned to its folder. Test subsets are sealed."""
    if subset.endswith("_test"):
        raise ValueError(f"subset {subset} is sealed and cannot be loaded")
    return spark.read.parquet(path).where(F.col("subset") == subset)
