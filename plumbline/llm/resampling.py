"""Importance resampling toward a target distribution, on hashed word features.

The tokenizers library's pre-tokenisation, a Split by a fixed pattern that needs no
training, cuts each ASCII-lowered text into words with offsets. A feature is a run of
consecutive words, a window over the offset pairs, and its bucket is the CRC-32 of the
words joined by one blank. Bucket counts of the documents and of the target texts give
each bucket a gain in whole thousandths; a document's weight is the sum of its features'
gains, and Gumbel noise from a hash of its id turns the highest scores into a draw
without replacement in proportion to the weights.

Texts are cut once: the bucket numbers, two bytes a feature, are written in compressed
form, and the histogram and the weights are read from them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import SLICE_BYTES, slices
from plumbline.operators.ordering import with_positions
from plumbline.session import materialize

# Runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LEAST_WORDS = 20
TASK_ROWS = 100_000  # rows that one task may number alone
MOST_KNOWN = 200_000  # words of a task's table; it is emptied when full


class Windows:
    """Bucket numbers of the word runs of texts."""

    def __init__(self, most_words: int = 1, buckets: int = BUCKETS, pattern: str = WORD):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.most, self.buckets = most_words, buckets
        self.known: dict[str, int] = {}

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, bucket of every run of 1 to ``most`` words) of a lowered text."""
        words = self.split.pre_tokenize_str(text)
        if len(self.known) > MOST_KNOWN:
            self.known = {}
        known, sums = self.known, []
        for word, _ in words:
            crc = known.get(word)
            if crc is None:
                crc = known[word] = zlib.crc32(word.encode())
            sums.append(crc)
        out = [np.array(sums, dtype=np.int64) % self.buckets]
        # A run of k words goes on from the checksum of its first k - 1.
        spans = [span for _, span in words]
        for k in range(1, min(self.most, len(words))):
            ends = [text[a:b].encode() for a, b in spans[k:]]
            sums = [zlib.crc32(b" " + word, crc) for word, crc in zip(ends, sums)]
            out.append(np.array(sums, dtype=np.int64) % self.buckets)
        return len(words), np.concatenate(out)


def feature_buckets(
    rows: DataFrame, *, most_words: int = 1, buckets: int = BUCKETS, row_id: str, text: str = "text"
) -> DataFrame:
    """(row_id, n_words, n_features, features) of every row; ``features`` are the bucket
    numbers as little-endian integers, of two bytes where they fit, compressed."""
    kind = bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, press = Windows(most_words, buckets), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at, part in slices(batch.column(1), SLICE_BYTES):
                words, sizes, data = [], [], []
                for low in pc.ascii_lower(part).to_pylist():
                    n, got = windows.of(low or "")
                    words.append(n)
                    sizes.append(len(got))
                    data.append(press.compress(got.astype(kind).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)), pa.array(words, pa.int64()),
                        pa.array(sizes, pa.int64()), pa.array(data, pa.binary()),
                    ],
                    names=["row_id", "n_words", "n_features", "features"],
                )

    return rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).cast("string")).mapInArrow(
        run, "row_id long, n_words long, n_features long, features binary"
    )


def bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def histogram(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of ``feature_buckets``; a task sends a row per bucket."""
    kind = bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros(buckets, dtype=np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            data = b"".join(map(unpack.decompress, batch.column(0).to_pylist()))
            total += np.bincount(np.frombuffer(data, kind), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"]
        )

    counted = features.select("features").mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the histograms of documents and target texts.

    floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) with the counts
    s, t of the bucket and S, T of all; a bucket that neither holds has a gain too.
    """
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = (
        every.join(raw.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    )
    # At most ``buckets`` rows: two totals and a gain for each come to the driver.
    s, t = both.agg(F.sum("s"), F.sum("t")).first()
    rate = (F.col("t") + 1) * F.lit(s + buckets) / ((F.col("s") + 1) * F.lit(t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(rate)).alias("gain"))


def gumbel(seed: int, doc_id: str = "doc_id"):
    """Whole thousandths of Gumbel noise from the id alone; a null id counts as no text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``row_id``, ``n_words``, ``n_features`` and ``weight``, the sum of the features' gains."""
    kind = bucket_type(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            data = b"".join(map(unpack.decompress, batch.column(3).to_pylist()))
            upto = np.concatenate([[0], np.cumsum(gain[np.frombuffer(data, kind)])])
            ends = np.cumsum(batch.column(2).to_numpy())
            sums = np.diff(upto[ends], prepend=0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())],
                names=["row_id", "n_words", "n_features", "weight"],
            )

    return features.select("row_id", "n_words", "n_features", "features").mapInArrow(
        run, "row_id long, n_words long, n_features long, weight long"
    )


def resampled(
    docs: DataFrame, target: DataFrame, *, percent: int = 10, seed: int, most_words: int = 1,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, doc_id: str = "doc_id",
    text: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Of the N rows of ``least_words`` words or more, the floor(percent * N / 100) highest
    scores are drawn; they have ranks from 1, ties to the smaller doc_id (null first), all
    others a null rank. A null or empty text has no features and weight 0. Rows that
    repeat are scored and ranked each; empty documents give no rows, and an empty target
    weighs all features by the documents' own counts.
    """
    names = {"most_words": most_words, "buckets": buckets}
    made = materialize(feature_buckets(docs, row_id=doc_id, text=text, **names), "features")
    own = target.select(F.lit(None).cast("long").alias("_id"), F.col(target_text).alias("_text"))
    aim = histogram(feature_buckets(own, row_id="_id", text="_text", **names), buckets)
    # One gain per bucket, as many as the parameter says.
    gain = np.zeros(buckets, dtype=np.int64)
    for r in gains(histogram(made, buckets), aim, buckets).collect():
        gain[r["bucket"]] = r["gain"]
    rows = weighted(made, gain).withColumn("score", F.col("weight") + gumbel(seed, "row_id"))
    # Written once: rows that tie in everything are numbered once and for all.
    rows = materialize(rows.withColumnRenamed("row_id", "doc_id"), "scores")
    fit = F.col("n_words") >= least_words
    drawn = percent * rows.where(fit).count() // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    placed = with_positions(rows.where(fit), [], order, position="rank", hot_rows=TASK_ROWS)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    left = rows.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).unionByName(left)
