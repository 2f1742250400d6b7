"""Training-data pipeline: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, jaccard_join, mixing, packing, quality, rows
from plumbline.llm.queries import table, with_crc32
from plumbline.llm.ship import ship
from plumbline.session import materialize

# SQL expresses neither the learned scores nor the schedule nor the packing.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier accepts; it learns from all labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.learn(docs, labels)
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep one row, that of the smallest doc_id."""
    ship(spark)
    row = rows.unused(docs, "_row_no")
    docs_no = rows.numbered(docs, row)
    marked = exact_dedup.exact_duplicates(docs_no, doc_id=row).where("group_size > 1")
    marked = marked.select(F.col("doc_id").alias(row), "keep_id")
    return _first_of_each(docs, docs_no, marked, "keep_id", row)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, 0.8) keep one row, that of
    the smallest doc_id. Texts without words are alone."""
    ship(spark)
    row = rows.unused(docs, "_row_no")
    docs_no = rows.numbered(docs, row)
    found = jaccard_join.jaccard_components(docs_no, size=5, least=(80, 100), doc_id=row)
    found = found.select(F.col("doc_id").alias(row), "component_id")
    return _first_of_each(docs, docs_no, found, "component_id", row)


def _first_of_each(docs, docs_no, grouped: DataFrame, group: str, row: str) -> DataFrame:
    """``docs`` with one row of each group of (row, group); rows of no group stay."""
    ids = docs_no.select(row, F.col("doc_id").alias("_doc"))
    dropped = rows.all_but_first(grouped.join(ids, row), group, F.col("_doc"), row)
    kept = rows.without_rows(docs_no, materialize(dropped, "dropped"), row)
    return kept.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, written in the order of the mixture."""
    ship(spark)
    return mixing.in_mixed_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens. Sequences are
    filled from stretches of the mixture and numbered in its order."""
    ship(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    place = rows.unused(docs, "_place")
    docs_no = rows.in_file_order(docs, place)
    return with_crc32(packing.packed_documents(docs_no, path, place=place))


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixture", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
