"""Mixing sources to target weights by Pfair scheduling of blocks.

The rows of a source are cut into blocks. Block j of a source of weight w may not
run before slot floor(j / w) and must run before slot ceil((j + 1) / w); of the
blocks that may run, the one with the earliest deadline takes the slot. Then at any
slot each source is less than one block away from its target.

Releases and deadlines are whole numbers worked out from the exact weights, without
rounding. One task goes through the slots in order, holds a block per source and gives
the schedule out in segments, which are joined to the rows by source and block. When a
source has run out, the weights of the others are scaled up and a new phase begins, in
which the deviation is counted anew. No row is left out or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import with_positions
from plumbline.session import materialize

BLOCK_ROWS = 64
MOST_SOURCES = 1000
SEGMENT = 1 << 16  # most slots of a segment


def shares_of(weights: Mapping[str, float], cycle: int) -> dict[str, int]:
    """Whole shares of ``cycle`` slots, at least one each, by largest remainders."""
    total = sum(weights.values())
    exact = {s: w / total * (cycle - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    rest = sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in rest[: cycle - sum(out.values())]:
        out[s] += 1
    return out


def scheduled(weights: Mapping[str, float]) -> Iterator[tuple[str, int]]:
    """(source, number of its block) of slot after slot, without end."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    total = sum(whole.values())
    future = [(0, -(-total // w), s, 0) for s, w in whole.items()]
    heapq.heapify(future)
    ready: list = []
    slot = 0
    while True:
        while future and future[0][0] <= slot:
            _, deadline, s, j = heapq.heappop(future)
            heapq.heappush(ready, (deadline, s, j))
        deadline, s, j = heapq.heappop(ready)
        assert slot < deadline
        yield s, j
        nxt = ((j + 1) * total // whole[s], -(-(j + 2) * total // whole[s]), s, j + 1)
        heapq.heappush(future, nxt)
        slot += 1


def one_cycle(shares: Mapping[str, int]) -> dict[str, np.ndarray]:
    """Slots of each source's blocks in one cycle of sum(shares) slots."""
    out: dict[str, list[int]] = {s: [] for s in shares}
    for slot, (s, _) in enumerate(islice(scheduled(shares), sum(shares.values()))):
        out[s].append(slot)
    return {s: np.array(x) for s, x in out.items()}


def phases(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple]:
    """(source, first block, end block, first slot, slots, share, places) of each segment:
    ``share`` blocks of the source stand in the segment's ``slots`` slots at ``places``."""
    left, done = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    start = 0
    while left:
        places: dict[str, list[int]] = {}
        size = 0
        for s, _ in scheduled({s: weights[s] for s in left}):
            places.setdefault(s, []).append(size)
            size += 1
            left[s] -= 1
            if size == SEGMENT or not left[s]:
                for x, at in places.items():
                    yield x, done[x], done[x] + len(at), start, size, len(at), at
                    done[x] += len(at)
                start, size, places = start + size, 0, {}
            if not left[s]:
                del left[s]
                break


def _schedule(spark, blocks: Mapping[str, int], weights: Mapping[str, float]) -> DataFrame:
    """(_s, block, slot) of every block, from one task that holds a segment at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(len(batch)):
                for s, first, end, slot, _, _, places in phases(blocks, weights):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([s] * len(places), pa.string()),
                            pa.array(np.arange(first, end, dtype=np.int64)),
                            pa.array(np.array(places, dtype=np.int64) + slot),
                        ],
                        names=["_s", "block", "slot"],
                    )

    return spark.range(1, numPartitions=1).mapInArrow(run, "_s string, block long, slot long")


def tempered(counts: Mapping[str, int], temperature: float = 2.0) -> dict[str, float]:
    """Weights by the rows of a source to the power 1 / temperature."""
    return {s: n ** (1 / temperature) for s, n in counts.items()}


def mixed(
    docs: DataFrame, weights: Mapping[str, float] | None = None, *, doc_id: str = "doc_id",
    source: str = "source", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(doc_id, source, block, slot, place) of every row; the mixture is ordered by slot, place.

    ``weights`` names every source; without it the square root of a source's rows
    counts. Rows of a source keep an order by hash of doc_id. Rows without a source
    are a source of their own, named ``""`` in ``weights`` (with an empty name);
    rows that repeat are placed each; an empty table gives none.
    """
    spark = docs.sparkSession
    keys = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_s"),
    )
    counted = keys.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counts = {r["_s"]: r["n"] for r in counted}
    weights = dict(weights) if weights is not None else tempered(counts)
    if missing := sorted(set(counts) - set(weights)):
        raise ValueError(f"no weight for {missing[:5]}")
    if any(weights[s] <= 0 for s in counts):
        raise ValueError("weights must be positive")
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    # Written once: rows that tie are numbered once and for all.
    placed = with_positions(keys.withColumn("_h", F.xxhash64("doc_id")), ["_s"], ["_h", "doc_id"])
    placed = materialize(placed.drop("_h"), "positions").withColumn(
        "block", F.floor((F.col("position") - 1) / block_rows)
    )
    plan = materialize(_schedule(spark, blocks, weights), "schedule")
    # A merge: the schedule grows with the rows and is not sent to every executor.
    return placed.join(plan.hint("merge"), ["_s", "block"]).select(
        "doc_id", "source", "block", "slot",
        ((F.col("position") - 1) % block_rows).cast("int").alias("place"),
    )


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, **names) -> DataFrame:
    """The rows of ``docs`` with all their columns, partitions and rows in the mixture's order."""
    doc_id = names.get("doc_id", "doc_id")
    key = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))
    spots = mixed(docs, weights, **names).select(key("doc_id").alias("_id"), "slot", "place")
    # Rows that repeat a doc_id are told apart by number; which is which doesn't matter.
    turn = F.row_number().over(Window.partitionBy("_id").orderBy("slot", "place"))
    spots = materialize(spots.withColumn("_at", turn), "mixture")
    # The row as one column: no name in it can clash.
    rows = docs.select(key(doc_id).alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0))))
    # A difference, not an equality, lets the join keep the partitioning by key.
    same = (F.col("_key") == F.col("_id")) & (F.col("_turn") - F.col("_at") == 0)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.join(spots, same)
        .repartitionByRange(n, "slot", "place")
        .sortWithinPartitions("slot", "place")
        .select("_row.*")
    )
