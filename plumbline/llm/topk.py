"""Exact top-k search by distributed selection on score histograms.

All vectors are scored in blocks of queries against blocks of candidates. No score
is kept: each pass scores again and counts, for every query, the scores by bins of
the interval that is known to hold its k-th score; the interval then shrinks to one
bin. A block reports its highest bins only, down to the one where its own k-th score
lies, as lower ones can't hold the global one. When an interval is one value wide,
a last pass keeps the scores above it and, of those equal to it, the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

BINS = 4096
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 2048
SCALE = 256


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with a missing, empty or
    non-finite vector or a null id take no part. A component that leaves a long raises."""
    x = F.col(embedding)
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    scaled = lambda c: F.floor(F.when(_fits(c.cast("double") * scale), c.cast("double") * scale).otherwise(
        F.raise_error(F.lit("a component leaves the range of a long")).cast("double")))
    fit = F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite)
    return rows.where(fit).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, scaled).alias("v"))


def _fits(c):
    return (c >= -float(1 << 63)) & (c < float(1 << 63))


def _blocks(vectors: DataFrame, size: int, total: int) -> DataFrame:
    """(dim, ids, data): a row per block of about ``size`` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def close(dim):
            ids, data = zip(*held.pop(dim))
            return pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim], pa.int32()),
                    "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                    "data": pa.array([np.array(data, "<i8").tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= size:
                    yield close(len(v))
        for dim in list(held):
            yield close(dim)

    parts = max(1, -(-total // size))
    return vectors.repartition(parts, "id").mapInArrow(run, "dim int, ids binary, data binary")


def _scores(q: bytes, c: bytes, dim: int) -> np.ndarray:
    """Inner products of two blocks, exact: by doubles while they can hold them, by longs
    while those can, by Python's integers for the pairs beyond. A score that leaves a long
    raises."""
    a = np.frombuffer(q, "<i8").reshape(-1, dim)
    b = np.frombuffer(c, "<i8").reshape(-1, dim)
    most_a, most_b = (np.maximum(x.max(axis=1).astype(float), -x.min(axis=1).astype(float)) for x in (a, b))
    most = most_a.max(initial=0) * most_b.max(initial=0) * dim
    if most < 1 << 52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    out = a @ b.T
    if most >= 1 << 62:
        for i in np.flatnonzero(most_a * most_b.max(initial=0) * dim >= 1 << 62).tolist():
            wide = np.flatnonzero(most_a[i] * most_b * dim >= 1 << 62)
            exact = (b[wide].astype(object) * a[i].astype(object)).sum(axis=1)
            if max(exact, default=0) >= 1 << 63 or min(exact, default=0) < -(1 << 63):
                raise OverflowError("a score leaves the range of a long")
            out[i, wide] = exact.astype(np.int64)
    return out


def top_k(
    rows: DataFrame, queries: DataFrame, k: int, *, vec_id: str = "vec_id",
    embedding: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products.

    ``queries`` holds rows of the same form; a query's own id is no candidate. Ties
    go to smaller ids; with fewer than k candidates of its length a query gets all.
    A repeated id is scored for each of its rows; empty tables give no rows. Components
    of any size count; one, or a score, that leaves the range of a long raises an error.
    """
    spark = rows.sparkSession
    vectors = materialize(integer_vectors(rows, vec_id, embedding, scale), "vectors")
    asked = materialize(integer_vectors(queries, vec_id, embedding, scale), "asked")
    many, few = vectors.count(), asked.count()
    candidates = materialize(_blocks(vectors, CANDIDATE_BLOCK, many), "candidates")
    query_blocks = materialize(
        _blocks(asked, QUERY_BLOCK, few).withColumn("block", F.monotonically_increasing_id()),
        "queries",
    )
    # Every candidate block meets every query block: the query blocks are copied to
    # each deal of candidate blocks, and a deal is about one block.
    deals = max(1, -(-many // CANDIDATE_BLOCK))
    candidates = candidates.withColumn("deal", F.pmod(F.xxhash64("ids"), F.lit(deals)))
    largest = vectors.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))
    bound = (largest.first()[0] or 0.0) ** 0.5
    high = min(int(bound * bound * (1 + 1e-9)) + 1, (1 << 63) - 1)
    width = 1  # of a bin in the first pass; a power of BINS
    while width * BINS < 2 * high + 1:
        width *= BINS

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's first interval: all that products of two norms allow."""
        for batch in batches:
            for block, ids in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(ids) // 8
                low = np.full(n, -high, "<i8")
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([block]), "ids": pa.array([ids], pa.binary()),
                        "low": pa.array([low.tobytes()], pa.binary()),
                        "above": pa.array([np.zeros(n, "<i8").tobytes()], pa.binary()),
                    }
                )

    state = query_blocks.select("block", "ids").mapInArrow(
        spans, "block long, ids binary, low binary, above binary"
    )
    state = materialize(state, "state")

    def pairs(state: DataFrame) -> DataFrame:
        """Every block of queries with every block of candidates of its length, dealt evenly."""
        asked = query_blocks.select("block", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q"))
        asked = asked.join(state.drop("ids"), "block")
        asked = asked.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        return asked.withColumn("deal", F.col("deal").cast("long")).join(candidates, ["deal", "dim"])

    def counting(width: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    own, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                    low = np.frombuffer(row["low"], "<i8")
                    scores = _scores(row["q"], row["data"], row["dim"])
                    # Differences may need all 64 bits.
                    apart = (ids[None, :] == own[:, None]) | (scores < low[:, None])
                    bins = (scores.view(np.uint64) - low.view(np.uint64)[:, None]) // np.uint64(width)
                    bins = np.minimum(bins, BINS).astype(np.int64)
                    bins[apart | (bins >= BINS)] = -1
                    top = -np.partition(-bins, min(k, bins.shape[1]) - 1, axis=1)[:, :k]
                    at, place = np.nonzero(bins >= np.maximum(top.min(axis=1), 0)[:, None])
                    code, n = np.unique(at * BINS + bins[at, place], return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array(np.full(len(code), row["block"])),
                            "at": pa.array((code // BINS).astype(np.int32)),
                            "bin": pa.array((code % BINS).astype(np.int32)),
                            "n": pa.array(n.astype(np.int64)),
                        }
                    )

        return count

    def narrowed(state: DataFrame, width: int) -> DataFrame:
        """Each query's interval cut down to the bin of its k-th score."""
        found = (
            pairs(state)
            .select("block", "q_ids", "q", "low", "dim", "ids", "data")
            .mapInArrow(counting(width), "block long, at int, bin int, n long")
            .groupBy("block", "at", "bin").agg(F.sum("n").alias("n"))
        )

        def shrink(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in old.to_dict("records"):
                low = np.frombuffer(row["low"], "<i8").copy()
                above = np.frombuffer(row["above"], "<i8").copy()
                got = new.sort_values(["at", "bin"], ascending=[True, False])
                for at, part in got.groupby("at"):
                    upto = above[at] + part["n"].cumsum().to_numpy()
                    reached = np.flatnonzero(upto >= k)
                    if len(reached):
                        i = reached[0]
                        above[at] = upto[i] - part["n"].iloc[i]
                        low[at] = int(low[at]) + width * int(part["bin"].iloc[i])
                    # Fewer than k candidates: the lowest value is kept and all lie above.
                out.append(
                    {
                        "block": row["block"], "ids": row["ids"], "low": low.tobytes(),
                        "above": above.tobytes(),
                    }
                )
            return pd.DataFrame(out, columns=["block", "ids", "low", "above"])

        return state.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(
            shrink, "block long, ids binary, low binary, above binary"
        )

    while width:
        state = materialize(narrowed(state, width), "state")
        width = width // BINS if width > 1 else 0

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                low = np.frombuffer(row["low"], "<i8")
                scores = _scores(row["q"], row["data"], row["dim"])
                fit = (scores >= low[:, None]) & (ids[None, :] != own[:, None])
                at, place = np.nonzero(fit)
                score, vec = scores[at, place], ids[place]
                order = np.lexsort((vec, -score, at))
                at, score, vec = at[order], score[order], vec[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                some = rank < k
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array(own[at[some]]),
                        "vec_id": pa.array(vec[some]),
                        "score": pa.array(score[some]),
                    }
                )

    best = pairs(state).select("q_ids", "q", "low", "dim", "ids", "data").mapInArrow(
        keep, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
