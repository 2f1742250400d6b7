"""Exact deduplication by a Golomb-coded exchange of fingerprints.

Every partition hashes its normalised texts and sends each owner of a hash range
one message: the sorted distinct hashes of that range as Golomb-Rice coded
differences, and a bit per hash that says whether the sender holds it twice.
An owner decodes the messages of all senders and answers each with a bitmap of
the hashes that occur more than once. Only texts under such a hash are shuffled
and compared byte by byte, by grouping on the text itself. A third of the rows
may be one text: a sender sends its hash once, and the grouping is combined
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

# Most hashes that an owner holds at once, and that one message set covers.
OWNER_HASHES = 4_000_000
SENDER_HASHES = 1_000_000
LEAST_OWNERS = 64
SPACES = r"[\x20\x09-\x0D]+"


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values as Golomb-Rice coded differences.

    The quotients in unary come first and the remainders of a fixed width after
    them, so that both sides work on whole arrays. Header: count, remainder width.
    """
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if n == 0:
        return np.array([0, 0], dtype="<u4").tobytes()
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(0, int(int(values[-1]) // n).bit_length() - 1)
    quotients = (steps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    places = np.arange(width, dtype=np.uint64)
    rest = ((steps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    head = np.array([n, width], dtype="<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    """Inverse of ``golomb_encode``."""
    n, width = (int(x) for x in np.frombuffer(data, "<u4", 2))
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    tail = -(-n * width // 8)
    body = np.frombuffer(data, np.uint8, offset=8)
    ends = np.flatnonzero(np.unpackbits(body[: len(body) - tail]))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    steps = quotients.astype(np.uint64) << np.uint64(width)
    if width:
        rest = np.unpackbits(body[len(body) - tail :])[: n * width].reshape(n, width)
        steps += (rest.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(
            axis=1, dtype=np.uint64
        )
    return np.cumsum(steps, dtype=np.uint64)


def normalised(text: Column) -> Column:
    """The text with each run of spaces as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def duplicate_hashes(prints: DataFrame, owners: int) -> DataFrame:
    """Values of column ``h`` (long) that occur in more than one row, by the exchange."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, held, turn = TaskContext.get().partitionId(), [], 0, 0

        def messages():
            hashes, counts = np.unique(np.concatenate(waiting).view(np.uint64), return_counts=True)
            owner = ((hashes >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
            cuts = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
            to = [o for o in range(owners) if cuts[o] < cuts[o + 1]]
            spans = [slice(cuts[o], cuts[o + 1]) for o in to]
            return pa.RecordBatch.from_pydict(
                {
                    "sender": pa.array([f"{part}-{turn}"] * len(to), pa.string()),
                    "owner": pa.array(to, pa.int32()),
                    "hashes": pa.array([golomb_encode(hashes[s]) for s in spans], pa.binary()),
                    "twice": pa.array(
                        [np.packbits(counts[s] > 1).tobytes() for s in spans], pa.binary()
                    ),
                }
            )

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(batch)
            if held >= SENDER_HASHES:
                yield messages()
                waiting, held, turn = [], 0, turn + 1
        if held:
            yield messages()

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(x) for x in group["hashes"]]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(y)] for x, y in zip(group["twice"], lists)]
        _, place, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        local = np.bincount(place, weights=np.concatenate(twice), minlength=len(counts))
        found = ((counts > 1) | (local > 0))[place]
        parts = np.split(found, np.cumsum([len(x) for x in lists])[:-1])
        return pd.DataFrame(
            {
                "sender": group["sender"],
                "owner": group["owner"],
                "bitmap": [np.packbits(x).tobytes() for x in parts],
            }
        )

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = [np.zeros(0, dtype=np.uint64)]
            for coded, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = golomb_decode(coded)
                picked.append(hashes[np.unpackbits(np.frombuffer(bits, np.uint8))[: len(hashes)] > 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(picked).view(np.int64))], names=["h"]
            )

    # Written once: the senders that are answered are the senders that sent.
    sent = materialize(
        prints.select("h").mapInArrow(send, "sender string, owner int, hashes binary, twice binary"),
        "fingerprints",
    )
    answers = sent.groupBy("owner").applyInPandas(answer, "sender string, owner int, bitmap binary")
    suspects = sent.join(answers, ["sender", "owner"]).select("hashes", "bitmap")
    return suspects.mapInArrow(receive, "h long").distinct()


def exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are. A null text is an empty one;
    an empty table gives an empty result; other columns are not read. Of equal
    texts the smallest doc_id stays, a null doc_id last; of rows that repeat both
    doc_id and text exactly one is kept.
    """
    spark = docs.sparkSession
    norm = normalised(F.col(text))
    source = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
    source = source.withColumn("h", F.xxhash64("norm"))
    prints = materialize(
        source.select(
            "doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "prints",
    )
    owners = max(LEAST_OWNERS, -(-prints.count() // OWNER_HASHES))
    suspects = materialize(duplicate_hashes(prints, owners), "suspects")
    groups = (
        source.join(suspects, "h", "left_semi")
        .groupBy("h", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    )
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")
    keepers = (
        prints.join(suspects, "h", "left_semi")
        .groupBy("h", "sha")
        .agg(F.min(first).alias("first"))
    )
    verified = groups.join(keepers, ["h", "sha"]).select(
        "h", "sha", "group_size",
        F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid"),
    )
    verified = materialize(verified, "groups")
    alone = F.col("group_size").isNull()
    return prints.join(verified, ["h", "sha"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, True).otherwise(F.col("rid") == F.col("first_rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
