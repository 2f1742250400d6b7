"""A filter of fixed size: which keys may be in a table that is too large to broadcast.

The filter only thins out rows before a join, which stays. It holds BITS bits at any
size of the data: much help for small tables, none for huge ones, never a wrong row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import mixed

BITS = 1 << 26
PIECE = 1 << 16


def slot(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64)) >> np.uint64(38)).astype(np.int64)


def membership(keys: DataFrame, column: str) -> np.ndarray:
    """The packed bits (BITS / 8 bytes) at which keys of ``column`` fall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(slot(batch.column(0).to_numpy()))
            piece = at // PIECE
            cuts = np.flatnonzero(np.diff(piece, prepend=-1))
            places = np.split((at % PIECE).astype("<u2"), cuts[1:])
            some = piece[cuts] if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([x.tobytes() for x in places][: len(some)], pa.binary())],
                names=["piece", "places"],
            )

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(PIECE, dtype=bool)
        for x in group["places"]:
            held[np.frombuffer(x, "<u2")] = True
        return pd.DataFrame({"piece": [group["piece"].iloc[0]], "bits": [np.packbits(held).tobytes()]})

    out = np.zeros((BITS // PIECE, PIECE // 8), dtype=np.uint8)
    got = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull())
    got = got.mapInArrow(run, "piece int, places binary").groupBy("piece")
    for r in got.applyInPandas(merged, "piece int, bits binary").collect():
        out[r["piece"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def may_hold(bits: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Whether each key may be in the table; a null key is not."""
    known = keys.is_valid().to_numpy(zero_copy_only=False)
    at = slot(keys.fill_null(0).to_numpy(zero_copy_only=False))
    return known & ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def thinned(df: DataFrame, bits, column: str, *, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose key may (or, if not ``inside``, can't) be in the table;
    ``bits`` is a broadcast of ``membership``."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = may_hold(bits.value, batch.column(at))
            yield batch.filter(pa.array(hit if inside else ~hit))

    return df.mapInArrow(run, df.schema)
