"""Decisions about single rows, by a number that each row of a table gets.

A doc_id may be missing or shared by rows of different texts, so what a stage drops is
told by row. The number is the row's place in its file split, which every scan of the
same files gives again. Only the short list of dropped rows is joined: a bitmap of fixed
size lets all other rows pass by without a shuffle.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

BITS = 1 << 26  # of the bitmap, at any size of the list: 8 MB


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, a table as it is read from files, with each row's number."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def in_file_order(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with each row's number from 0, in the order of its files' names and their rows.
    A table that isn't read from files is counted by partition."""
    part, at, before = (unused(docs, c) for c in ("_part", "_row_at", "_rows_before"))
    try:
        docs.select("_metadata.row_index")
        spot = (F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    except AnalysisException:
        spot = (F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    spots = docs.select("*", spot[0].alias(part), spot[1].alias(at))
    rows = spots.groupBy(part).agg((F.max(at) + 1).alias("_rows"))
    earlier = F.sum("_rows").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    # A row per file.
    rows = F.broadcast(rows.select(part, F.coalesce(earlier, F.lit(0)).alias(before)))
    return spots.join(rows, part).select(*docs.columns, (F.col(before) + F.col(at)).alias(name))


def all_but_first(rows: DataFrame, group: str, doc_id: Column, row: str) -> DataFrame:
    """(row) of ``rows`` that are not the first of their ``group``: smallest doc_id, a null
    one last, then smallest number. Rows of a null group are left out."""
    rows = rows.select(F.col(group).alias("_g"), doc_id.alias("_id"), F.col(row).alias(row))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", row)).alias("_first")
    best = rows.groupBy("_g").agg(first, F.count(F.lit(1)).alias("_n")).where("_n > 1")
    best = best.select("_g", F.col(f"_first.{row}").alias("_best"))
    return rows.join(best, "_g").where(F.col(row) != F.col("_best")).select(row)


def without_rows(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """Rows of ``docs`` whose number isn't in ``dropped``, a written table of numbers."""
    place = F.pmod(F.xxhash64(row), F.lit(BITS))
    bits = dropped.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    # BITS / 8 bytes at most, so it is sent to every executor.
    bits = F.broadcast(materialize(bits, "bitmap"))
    at = F.bitmap_bit_position(place)
    marked = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[row].alias("_number"),
        F.bitmap_bucket_number(place).alias("_bucket"), at.alias("_at"),
    )
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_at div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce((F.floor(byte / F.pow(F.lit(2.0), F.col("_at") % 8)) % 2) == 1, F.lit(False))
    marked = marked.join(bits, "_bucket", "left").withColumn("_hit", hit)
    left = marked.where("_hit").join(dropped.withColumnRenamed(row, "_number"), "_number", "left_anti")
    return marked.where("NOT _hit").select("_row.*").unionByName(left.select("_row.*"))
