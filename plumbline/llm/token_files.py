"""Token ids in files: canonical length-limited Huffman codes, decoded by table.

A file set is a folder with two Parquet containers, so that Spark's committer
takes care of lost and repeated tasks:

``code``    one row: the code length of every id, from which the canonical code
            follows, and the longest length
``blocks``  one row per block of whole documents, in ascending document order
            within a part and over the parts: part, block, doc_ids, n_tokens per
            document, the bit stream, and the bit offset of every STRIDE-th token

A block is decoded alone; its stretches of STRIDE tokens are decoded side by side,
one table look-up per token.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.tokens import encoder
from plumbline.session import materialize

MAX_BITS = 20  # of a code; the decoding table has 2 ** MAX_BITS entries
BLOCK_TOKENS = 1 << 16  # a block ends with the document that reaches this
STRIDE = 128  # tokens between checkpoints
END_ID = 0


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Huffman code lengths of at most ``max_bits``; 0 for ids that don't occur.

    Plain Huffman lengths are cut at the limit, and the codes that then are too
    many are made longer, the rarest first, until Kraft's sum is at most one;
    what is left over shortens the most frequent codes.
    """
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    heap = [(int(counts[i]), k) for k, i in enumerate(used)]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(used) - 1, dtype=np.int64)
    for node in range(len(used), 2 * len(used) - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = node
        heapq.heappush(heap, (a[0] + b[0], node))
    depth = np.zeros(len(parent), dtype=np.int64)
    for node in range(len(parent) - 2, -1, -1):
        depth[node] = depth[parent[node]] + 1
    own = np.minimum(depth[: len(used)], max_bits)
    order = np.lexsort((used, counts[used]))  # rarest first
    room = (1 << max_bits) - int((1 << (max_bits - own)).sum())
    while room < 0:
        for k in order:
            if own[k] < max_bits:
                own[k] += 1
                room += 1 << (max_bits - int(own[k]))
                if room >= 0:
                    break
    for k in order[::-1]:
        while own[k] > 1 and (gain := 1 << (max_bits - int(own[k]))) <= room:
            own[k] -= 1
            room -= gain
    lengths[used] = own
    return lengths


class Code:
    """Canonical code of given lengths: ids ordered by (length, id)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.int64)
        self.bits = max(1, int(self.lengths.max(initial=1)))
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.lexsort((ids, self.lengths[ids]))]
        spans = 1 << (self.bits - self.lengths[ids])
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(self.lengths), dtype=np.int64)
        self.codes[ids] = first >> (self.bits - self.lengths[ids])
        self.table = np.zeros(1 << self.bits, dtype=np.uint32)
        self.table[: int(spans.sum())] = np.repeat(ids, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bit stream, bit offsets of every STRIDE-th id)."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = ends - size
        shifted = self.codes[ids] << (32 - size - (at & 7))
        n = int(ends[-1]) // 8 + 4 if len(ids) else 4
        out = np.zeros(n)
        for k in range(4):
            part = (shifted >> (24 - 8 * k)) & 255
            out += np.bincount((at >> 3) + k, weights=part, minlength=n)[:n]
        return out.astype(np.uint8).tobytes(), at[::STRIDE]

    def decode(self, data: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8).astype(np.uint32)
        words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = np.asarray(offsets, dtype=np.int64).copy()
        out = np.zeros((STRIDE, len(at)), dtype=np.uint32)
        drop = np.uint32(32 - self.bits)
        last = len(words) - 1
        for k in range(STRIDE):
            seen = (words[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> drop
            out[k] = ids = self.table[seen]
            at += self.lengths[ids]
        return out.T.reshape(-1)[:n]


def token_ids(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of whole texts, the end id included.

    ``ids`` holds little-endian unsigned 32-bit integers, compressed by zstandard
    for the exchange (half-width while the vocabulary allows it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at, n, ids, starts in enc.parts(batch.column(1)):
                if enc.size <= 1 << 16:
                    ids = ids.astype("<u2")
                end = ids.dtype.type(END_ID).tobytes()
                packed = [pack.compress(ids[a:b].tobytes() + end) for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        pa.array(np.diff(starts) + 1, pa.int64()),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary"
    )


def unpacked(ids: bytes, n: int) -> np.ndarray:
    """Ids of one row of ``token_ids`` as unsigned 32-bit integers."""
    raw = zstandard.ZstdDecompressor().decompress(ids, max_output_size=4 * n)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def global_counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.bincount(unpacked(ids, n))
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"]
        )

    return (
        tokens.select("ids", "n_tokens").mapInArrow(run, "id long, n long")
        .groupBy("id").agg(F.sum("n").alias("n"))
    )


def write_token_files(tokens: DataFrame, folder: str, *, max_bits: int = MAX_BITS) -> None:
    """Write rows of ``token_ids`` to ``folder`` in ascending doc_id order, nulls first.

    The counts that come to the driver are bounded by the vocabulary.
    """
    spark = tokens.sparkSession
    counted = {r["id"]: r["n"] for r in global_counts(tokens).collect()}
    counts = np.zeros(max(counted, default=0) + 1, dtype=np.int64)
    counts[list(counted)] = list(counted.values())
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(
        1
    ).write.parquet(f"{folder}/code")
    shared = spark.sparkContext.broadcast(lengths)  # one byte per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, block = Code(shared.value), TaskContext.get().partitionId(), 0
        docs, sizes, parts, held = [], [], [], 0

        def close():
            ids = np.concatenate(parts)
            bits, offsets = code.encode(ids)
            row = {
                "part": [part], "block": [block], "doc_ids": [docs], "sizes": [sizes],
                "n_tokens": [len(ids)], "bits": [bits],
                "offsets": [np.asarray(offsets, dtype="<i8").tobytes()],
            }
            return pa.RecordBatch.from_pydict(row, schema=_BLOCKS)

        for batch in batches:
            for d, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                docs.append(d)
                sizes.append(n)
                parts.append(unpacked(x, n))
                held += n
                if held >= BLOCK_TOKENS:
                    yield close()
                    docs, sizes, parts, held, block = [], [], [], 0, block + 1
        if docs:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.select("doc_id", "n_tokens", "ids").mapInArrow(
        run,
        "part int, block int, doc_ids array<long>, sizes array<long>, n_tokens long,"
        " bits binary, offsets binary",
    ).write.parquet(f"{folder}/blocks", compression="none")


_BLOCKS = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("bits", pa.binary()),
        ("offsets", pa.binary()),
    ]
)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before;
    ``ids`` holds little-endian unsigned 32-bit integers, the end id included."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{folder}/code").first()[0]), np.uint8)
    shared = spark.sparkContext.broadcast(lengths)  # one byte per id of the vocabulary
    blocks = spark.read.parquet(f"{folder}/blocks")
    # A row per part, of which there are as many as files: small enough for one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.select("part", "block", "n_tokens")
        .withColumn("s", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "block", (F.col("s") + F.col("part_start")).alias("first"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in batches:
            for first, docs, sizes, n, bits, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                ids = code.decode(bits, np.frombuffer(offsets, "<i8"), n).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                begin = ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(begin + first, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([ids[4 * a : 4 * b] for a, b in zip(begin, ends)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    columns = ["first", "doc_ids", "sizes", "n_tokens", "bits", "offsets"]
    return blocks.join(starts, ["part", "block"]).select(*columns).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary"
    )


def token_file_set(docs: DataFrame, path: str, folder: str, **columns: str) -> None:
    """Encode whole texts of ``docs`` by the vocabulary at ``path`` into ``folder``.

    Null texts are empty ones and hold the end id alone, like empty ones; an empty
    table gives an empty file set. Rows that repeat a doc_id stay, in any order.
    """
    write_token_files(materialize(token_ids(docs, path, **columns), "ids"), folder)
