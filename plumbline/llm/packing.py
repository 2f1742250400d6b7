"""Best-fit packing of documents into sequences under several capacities.

A sequence holds at most so many tokens, documents (pieces) and so much attention
cost; a piece of n tokens costs n * n, as attention stays inside a document. A
piece goes to the open sequence that fits it under every capacity and scores
best: least weighted norm of what would be left, or largest weighted dot product
of the piece with what is left. Longest pieces go first.

Pieces are dealt by hash to groups of about GROUP pieces, which tasks pack on
their own, from lengths alone. Sequences that a group leaves open are emptied and
packed once more over all groups, so that the number of groups costs little.

Where documents come in an order that counts, as a mixture's, pieces are dealt by
stretches of that order instead, and a sequence's number is its earliest piece's place:
read by number, sequences follow the order as far as their stretch goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.token_files import END_ID
from plumbline.llm.tokens import encoder
from plumbline.session import materialize

SEQUENCE_TOKENS = 2048
GROUP = 8192
FULL = 0.98  # a sequence filled less is packed again
WEIGHTS = (1.0, 0.25, 0.25)  # of what is left of tokens, documents and attention
PIECES = 24  # bits of a piece's number in a key that begins with a place


def best_fit(
    lengths: np.ndarray,
    *,
    tokens: int = SEQUENCE_TOKENS,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
) -> np.ndarray:
    """Bin of each piece, numbered from 0. ``None`` capacities are those that tokens imply.

    A piece above a capacity on its own takes a bin alone; ties go to the longer
    piece, then to the earlier one, and to the older bin.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    sizes = np.stack([lengths, np.ones_like(lengths), lengths * lengths]).astype(float)
    caps = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=float)
    binds = np.array([True, documents is not None, attention is not None])
    rows = [k for k in range(3) if k == 0 or binds[k] or weights[k]]
    sizes, caps = sizes[rows] / caps[rows, None], caps[rows]
    w = np.array(weights)[rows]
    w = w / max(w.sum(), 1e-12)
    out = np.full(len(lengths), -1, dtype=np.int64)
    left = np.zeros((len(rows), 1024))
    score_left = np.zeros(1024)
    used, eps = 0, 1e-12
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[:, i]
        chosen = -1
        if used and lengths[i] < tokens:
            open_ = left[:, :used]
            fits = open_[0] >= size[0] - eps
            for k in range(1, len(rows)):
                fits &= open_[k] >= size[k] - eps
            if rule == "norm" and len(rows) == 1:
                score = open_[0]
            elif rule == "norm":
                score = (w[:, None] * (open_ - size[:, None]) ** 2).sum(axis=0)
            else:
                score = -((w * size)[:, None] * open_).sum(axis=0)
            place = np.where(fits, score, np.inf)
            chosen = int(place.argmin())
            if not np.isfinite(place[chosen]):
                chosen = -1
        if chosen < 0:
            if used == left.shape[1]:
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
            chosen, used = used, used + 1
            left[:, chosen] = 1.0
        left[:, chosen] -= size
        out[i] = chosen
    return out


def pieces_of(
    docs: DataFrame, path: str, *, tokens: int = SEQUENCE_TOKENS,
    doc_id: str = "doc_id", text: str = "text", place: str | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids): documents cut only where they are too long.
    With ``place``, a long column of ``docs``, that one too.

    ``ids`` holds little-endian unsigned 32-bit integers compressed by zstandard,
    the end id of the document included; a null text is an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at, count, ids, starts in enc.parts(batch.column(1)):
                sizes = np.diff(starts) + 1
                n = -(-sizes // tokens)
                owner = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                begin = piece * tokens
                length = np.minimum(tokens, sizes[owner] - begin)
                end = np.array([END_ID], dtype="<u4").tobytes()
                data = []
                for a, m, stop in zip((starts[owner] + begin).tolist(), length.tolist(), starts[owner + 1].tolist()):
                    part = ids[a : min(a + m, stop)].tobytes()
                    data.append(pack.compress(part if 4 * m == len(part) else part + end))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, count).take(pa.array(owner)),
                        pa.array(piece, pa.int32()),
                        pa.array(begin, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(data, pa.binary()),
                        *[c.slice(at, count).take(pa.array(owner)) for c in batch.columns[2:]],
                    ],
                    names=["doc_id", "piece", "start", "length", "ids", *(["place"] if place else [])],
                )

    more = [F.col(place).cast("long").alias("place")] if place else []
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string"), *more).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary" + (", place long" if place else "")
    )


def _packed(
    items: DataFrame, groups: int, turn: int, tokens: int, options: dict, places: int | None = None
) -> DataFrame:
    """(key, length, sequence_id, offset, fill) of items (key, length). ``places``: keys begin
    with one of so many places, whose order counts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        bins = best_fit(rows["length"].to_numpy(), tokens=tokens, **options)
        rows["bin"] = bins
        rows = rows.sort_values(["bin", "length", "key"], ascending=[True, False, True])
        size = rows.groupby("bin")["length"]
        group = (turn << 56) | (int(rows["group"].iloc[0]) << 24)
        return pd.DataFrame(
            {
                "key": rows["key"],
                "length": rows["length"],
                "sequence_id": group + rows["bin"] if places is None else rows.groupby("bin")["key"].transform("min"),
                "offset": size.cumsum() - rows["length"],
                "fill": size.transform("sum"),
            }
        )

    if places is None:
        group = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(groups))
    else:
        group = F.floor(F.shiftright("key", PIECES) / F.lit(places) * groups)
    return items.withColumn("group", group).groupBy("group").applyInPandas(
        run, "key long, length long, sequence_id long, offset long, fill long"
    )


def pack(
    items: DataFrame, *, tokens: int = SEQUENCE_TOKENS, ordered: bool = False, **options
) -> DataFrame:
    """(key, sequence_id, offset) of items (key, length), by two rounds of best fit.

    ``options`` are those of ``best_fit``. Offsets are gapless from 0. ``ordered``: a key is a
    place times 2 ** PIECES plus a number, and a sequence_id the smallest key in it.
    """
    total, last = items.agg(F.count(F.lit(1)), F.max(F.shiftright("key", PIECES))).first()
    places = (last or 0) + 1 if ordered else None
    groups = max(1, -(-total // GROUP))
    first = _packed(items, groups, 0, tokens, options, places)
    out = ["key", "sequence_id", "offset"]
    if groups == 1:
        return first.select(out)
    first = materialize(first, "packed")
    is_open = F.col("fill") < FULL * tokens
    again = first.where(is_open).select("key", "length")
    left = again.count()
    second = _packed(again, max(1, -(-left // GROUP)), 1, tokens, options, places)
    return first.where(~is_open).select(out).unionByName(second.select(out))


def packed_documents(
    docs: DataFrame, path: str, *, tokens: int = SEQUENCE_TOKENS, doc_id: str = "doc_id",
    text: str = "text", place: str | None = None, **options,
) -> DataFrame:
    """Pieces with their sequence: doc_id, piece, start, length, sequence_id, offset, ids.

    ``place`` names a column of whole numbers from 0, one a row, in whose order sequences are
    to be read, by sequence_id.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers. Null and
    empty texts hold the end id alone; rows that repeat a doc_id are packed each;
    an empty table gives none.
    """
    cut = pieces_of(docs, path, tokens=tokens, doc_id=doc_id, text=text, place=place)
    key = F.shiftleft("place", PIECES) + F.col("piece") if place else F.monotonically_increasing_id()
    # Written once: keys and ids stay as they are for the packing and the join.
    cut = materialize(cut.withColumn("key", key).drop("place"), "pieces")
    placed = pack(cut.select("key", "length"), tokens=tokens, ordered=place is not None, **options)
    joined = cut.join(placed, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = [unpack.decompress(x) for x in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(raw, pa.binary())], names=_OUT
            )

    return joined.select(*_OUT).mapInArrow(
        run,
        "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary",
    )


_OUT = ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"]
