"""Rankings that need no fitted model, and small changes of a selected set.

Candidates are rows with a position inside their decision; ``budget`` is the
number of selected ones. Nothing gathers a decision's candidates into an array.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import draws
from plumbline.functions import exprs as E
from plumbline.operators.ordering import (
    hot_groups,
    hot_row_limit,
    split_hot,
    with_group_aggregates,
    with_positions,
)
from plumbline.session import materialize


def random_rank(rows: DataFrame, *, decision: Sequence[str], key: str, index: str, name: str,
                out: str = "random_rank") -> DataFrame:
    """Hash permutation: the same key gives the same order on any partitioning."""
    hashed = rows.withColumn(
        "_h", draws.hash_key(F.lit(key), F.col(index).cast("string"), F.col(name).cast("string"))
    )
    return with_positions(hashed, decision, ["_h", index], position=out).drop("_h")


def metric_rank(rows: DataFrame, *, decision: Sequence[str], metric: str, index: str,
                out: str = "metric_rank") -> DataFrame:
    """Falling metric with NaN last and native order as tie-break."""
    value = F.col(metric).cast("double")
    keyed = rows.withColumn(
        "_v", F.when(value.isNull() | F.isnan(value), F.lit(-E.INF)).otherwise(value)
    )
    return with_positions(keyed, decision, [F.col("_v").desc(), index], position=out).drop("_v")


def with_group_maxima(rows: DataFrame, *, decision: Sequence[str], columns: Sequence[str]):
    return with_group_aggregates(rows, decision, {f"max_{c}": F.max(c) for c in columns})


# ---- swaps at the selection boundary ------------------------------------------
def swap_pairs(
    rows: DataFrame, *, decision: Sequence[str], position: str, budget: str, metric: str,
    carry: Sequence[str] = (), extra: Sequence[Column] = (), offsets: Sequence[int] = (0, 1),
) -> DataFrame:
    """Per decision: what each swap would remove and add.

    ``swap_<offset>`` exchanges the last selected with the first (or a later)
    unselected candidate. ``promote`` exchanges the worst selected (ties: the
    later one) with the best unselected (ties: the earlier one) when the metric
    strictly improves. One aggregate with partial minima; positions start at 1.
    """
    at, k = F.col(position), F.col(budget)
    value = F.col(metric).cast("double")
    rank = F.when(value.isNull() | F.isnan(value), F.lit(-E.INF)).otherwise(value)
    whole = F.struct(at.alias("at"), *[F.col(c) for c in carry])
    key = F.struct(rank.alias("v"), (-at).alias("o"), whole.alias("row"))
    aggs = [
        F.count(F.lit(1)).alias("n_candidates"),
        F.min(k).alias("budget"),
        F.max(F.when(at == k, whole)).alias("_last"),
        F.min(F.when(at <= k, key)).alias("_worst"),
        F.max(F.when(at > k, key)).alias("_best"),
        *[F.max(F.when(at == k + 1 + o, whole)).alias(f"_next{o}") for o in offsets],
        *extra,
    ]
    grouped = rows.groupBy(*decision).agg(*aggs)
    inside = (F.col("budget") > 0) & (F.col("budget") < F.col("n_candidates"))

    def pair(removed: Column, added: Column, ok: Column) -> Column:
        return F.when(ok, F.struct(removed.alias("removed"), added.alias("added")))

    swaps = [
        pair(F.col("_last"), F.col(f"_next{o}"), inside & F.col(f"_next{o}").isNotNull()).alias(
            f"swap_{o}"
        )
        for o in offsets
    ]
    better = inside & (F.col("_best.v") > F.col("_worst.v"))
    promote = pair(F.col("_worst.row"), F.col("_best.row"), better).alias("promote")
    hidden = {"_last", "_worst", "_best", *[f"_next{o}" for o in offsets]}
    keep = [c for c in grouped.columns if c not in hidden]
    return grouped.select(*keep, *swaps, promote)


def apply_swap(rows: DataFrame, pairs: DataFrame, *, decision: Sequence[str], position: str,
               pair: str, out: str = "new_position") -> DataFrame:
    """New positions after exchanging the two candidates; unchanged without a pair."""
    ends = pairs.select(
        *decision,
        F.col(f"{pair}.removed.at").alias("_out"),
        F.col(f"{pair}.added.at").alias("_in"),
    )
    at = F.col(position)
    moved = (
        F.when(at == F.col("_out"), F.col("_in"))
        .when(at == F.col("_in"), F.col("_out"))
        .otherwise(at)
    )
    return rows.join(ends, list(decision)).withColumn(out, moved).drop("_out", "_in")


def selection_change(rows: DataFrame, *, before: str, after: str, budget: "str | Column"):
    """Candidates that leave or enter the selected set between two orders."""
    k = E.col(budget)
    was, now = F.col(before) <= k, F.col(after) <= k
    return rows.withColumn(
        "change", F.when(was & ~now, "removed").when(now & ~was, "added")
    ).where(F.col("change").isNotNull())


def expand_occurrences(rows: DataFrame, *, decision: Sequence[str], model_rank: str,
                       occurrence: str, index: str, out: str = "position") -> DataFrame:
    """Representatives in model order, then repeated occurrences in the same order."""
    tail = (F.col(occurrence) > 1).cast("int")
    return with_positions(
        rows.withColumn("_tail", tail), decision, ["_tail", model_rank, index], position=out
    ).drop("_tail")


# ---- diversity-filtered top-k ------------------------------------------------------
# Bytes of vectors that one task may hold for each row that it may hold otherwise.
ROW_BYTES = 64


def _stacked(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, norms); a missing vector is a zero one, parallel to nothing."""
    width = max((len(v) for v in vectors if v is not None), default=1)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None:
            out[i, : len(v)] = v
    out[~np.isfinite(out).all(axis=1)] = 0.0
    return out, np.sqrt((out * out).sum(axis=1))


def _near(vectors, norms, ref, ref_norm, allowed) -> np.ndarray:
    """The one rule of similarity: rows too parallel to a reference vector."""
    width = min(vectors.shape[1], len(ref))
    return np.abs((vectors[:, :width] * ref[:width]).sum(axis=1)) > allowed * norms * ref_norm


def _scan(limit: float, good_limit: float):
    """Pick in score order from one stretch of a decision, drop rows near to a pick.

    ``before`` holds the picks so far and the forced rows; rows come in order.
    """

    def run(before: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", kind="stable").reset_index(drop=True)
        vectors, norms = _stacked(pdf["_vector"])
        allowed = np.where(pdf["_s"] >= pdf["_top"], good_limit, limit)
        viable = ~pdf["_forced"].to_numpy(dtype=bool)
        refs, ref_norms = _stacked(before["_vector"])
        for ref, n in zip(refs, ref_norms):
            viable &= ~_near(vectors, norms, ref, n, allowed)
        have = int((~before["_forced"].astype(bool)).sum())
        left = (int(pdf["_budget"].iloc[0]) if len(pdf) else 0) - have
        picked: list[int] = []
        for i in range(len(pdf)):
            if len(picked) >= left:
                break
            if viable[i]:
                picked.append(i)
                viable &= ~_near(vectors, norms, vectors[i], norms[i], allowed)
        out = pdf.iloc[picked].copy()
        out["_place"] = np.arange(have + 1, have + 1 + len(picked), dtype="int64")
        return out

    run.limit, run.good = limit, good_limit
    return run


def _prepared(rows, decision, index, score, vector, budget, forced):
    k = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    s = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(-E.INF)), F.lit(-E.INF))
    free = ~(F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False))
    return rows.select(
        *decision,
        F.col(index).alias("_index"),
        # Rows that repeat an index are ordered by their vector.
        F.xxhash64(vector).alias("_tie"),
        s.alias("_s"),
        F.col(vector).alias("_vector"),
        (~free).alias("_forced"),
        k.cast("bigint").alias("_budget"),
    )


def diverse_top_k(
    rows: DataFrame, *, decision: Sequence[str], index: str, score: str, vector: str,
    budget: "int | str", forced: "str | None" = None, min_orthogonality: float = 0.9,
    hot_rows: int | None = None,
) -> DataFrame:
    """Greedy selection per decision with a parallelism limit; returns the picks.

    Rows at the best score may be more parallel (limit at least one half), forced
    rows filter first, and an unfilled budget is topped up by score. Ties go to the
    smaller index; a missing vector is parallel to nothing; a repeated index is
    decided for each of its rows.
    """
    order = diverse_order(
        rows, decision=decision, index=index, score=score, vector=vector, budget=budget,
        forced=forced, min_orthogonality=min_orthogonality, hot_rows=hot_rows,
    )
    kept = order.where(F.col("selected"))
    return kept.select(*decision, "pick", "place")


def diverse_order(
    rows: DataFrame, *, decision: Sequence[str], index: str, score: str, vector: str,
    budget: "int | str", forced: "str | None" = None, min_orthogonality: float = 0.9,
    hot_rows: int | None = None,
) -> DataFrame:
    """All free rows: the picks in order, then the rest by score, with ``place`` and
    ``selected`` (place within the budget).

    Decisions are scanned in stretches whose vectors fit a fixed number of bytes;
    most decisions are one stretch, and a large one is taken up again only while its
    budget isn't filled. One scan and one rule of similarity serve both.
    """
    limit = 1.0 - min_orthogonality
    decision = list(decision)
    work = _prepared(rows, decision, index, score, vector, budget, forced)
    bytes_left = ROW_BYTES * hot_row_limit(rows.sparkSession, hot_rows)
    weight = (F.lit(8) * F.greatest(F.coalesce(F.size("_vector"), F.lit(1)), F.lit(1)) + 16).cast("bigint")
    scan = _scan(limit, max(0.5, limit))
    keys = hot_groups(work.select(*decision, weight.alias("_w")), decision,
                      weight=F.col("_w"), limit=bytes_left)
    if keys is None:
        return _ordered_at_once(work, decision, scan)
    small, large = split_hot(work, decision, keys)
    return _ordered_at_once(small, decision, scan).unionByName(
        _ordered_by_stretches(large, decision, scan, weight, bytes_left, hot_rows)
    )


def _ordered_at_once(work: DataFrame, decision: list[str], scan) -> DataFrame:
    """Decisions that fit a task: one shuffle, sorted, scanned and placed where they meet."""

    def whole(table: pa.Table) -> pa.Table:
        keys = [("_s", "descending"), ("_index", "ascending"), ("_tie", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        pdf = table.select(["_s", "_vector", "_forced", "_budget"]).to_pandas()
        free = ~pdf["_forced"].to_numpy(dtype=bool)
        pdf["_at"] = np.arange(len(pdf))
        pdf["_top"] = pdf["_s"].to_numpy()[free].max(initial=-np.inf)
        picked = scan(pdf[~free], pdf[free])["_at"].to_numpy(dtype="int64")
        free[picked] = False
        order = np.concatenate([picked, np.flatnonzero(free)])
        place = np.arange(1, len(order) + 1)
        kept = table.select([*decision, "_index", "_budget"]).take(pa.array(order, pa.int64()))
        chosen = pc.less_equal(pa.array(place, pa.int64()), kept["_budget"])
        return pa.table(
            [*kept.columns[:-1], pa.array(place, pa.int64()), chosen],
            names=[*decision, "pick", "place", "selected"],
        )

    schema = T.StructType(
        [work.schema[c] for c in decision]
        + [T.StructField("pick", work.schema["_index"].dataType), T.StructField("place", T.LongType()),
           T.StructField("selected", T.BooleanType())]
    )
    return work.groupBy(*decision).applyInArrow(whole, schema)


def _ordered_by_stretches(
    work: DataFrame, decision: list[str], scan, weight: Column, bytes_left: int, hot_rows: int | None
) -> DataFrame:
    """Decisions too large for a task, numbered in score order over many."""
    order = [F.col("_s").desc(), "_index", "_tie"]
    top = F.max(F.when(~F.col("_forced"), F.col("_s")))
    work = with_group_aggregates(work, decision, {"_top": top}, hot_rows=hot_rows)
    work = work.withColumn("_top", F.coalesce("_top", F.lit(-E.INF)))
    placed = with_positions(
        work.withColumn("_w", weight), [*decision, "_forced"], order,
        position="_at", running={"_upto": "_w"}, hot_rows=hot_rows,
    )
    # Written once: stretches and picks refer to the same numbering.
    placed = materialize(
        placed.withColumn("_part", F.floor((F.col("_upto") - 1) / bytes_left)).drop("_upto", "_w"),
        "diverse",
    )
    schema = placed.withColumn("_place", F.lit(0).cast("bigint")).schema
    picks = materialize(_stretches(placed, decision, scan, schema), "picks")
    named = [F.col(c).alias(f"_p{i}") for i, c in enumerate(decision)]
    chosen = picks.select(*named, F.col("_at").alias("_pat"), "_place")
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(decision)],
        F.col("_at") == F.col("_pat"),
    )
    free = placed.where(~F.col("_forced")).drop("_vector").join(chosen, same, "left")
    # Picks keep their place; the others follow in score order.
    last = F.coalesce(F.col("_place"), F.lit((1 << 62)))
    return with_positions(
        free.withColumn("_last", last), decision, ["_last", "_at"], position="place", hot_rows=hot_rows
    ).select(
        *decision, F.col("_index").alias("pick"), "place",
        (F.col("place") <= F.col("_budget")).alias("selected"),
    )


def _stretches(large, decision, scan, schema):
    """Picks of decisions too large for a task, stretch by stretch of their order."""
    # Written apart: a cogroup of two parts of one frame would be ambiguous.
    forced = materialize(large.where("_forced"), "forced")
    blocks = [r["_part"] for r in forced.select("_part").distinct().orderBy("_part").collect()]
    parts = [r["_part"] for r in large.where(~F.col("_forced")).select("_part").distinct()
             .orderBy("_part").collect()]
    picks = None

    def clear(near: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        if not len(near) or not len(pdf):
            return pdf
        allowed = np.where(pdf["_s"] >= pdf["_top"], scan.good, scan.limit)
        vectors, norms = _stacked(pdf["_vector"])
        keep = np.ones(len(pdf), dtype=bool)
        for ref, n in zip(*_stacked(near["_vector"])):
            keep &= ~_near(vectors, norms, ref, n, allowed)
        return pdf[keep]

    bare = large.schema
    for part in parts:
        rest = large.where(~F.col("_forced") & (F.col("_part") == part))
        if picks is not None:  # decisions whose budget is filled are done
            have = picks.groupBy(*decision).agg(F.count(F.lit(1)).alias("_have"))
            rest = rest.join(have, decision, "left").where(F.coalesce("_have", F.lit(0)) < F.col("_budget"))
            rest = rest.drop("_have")
            if rest.isEmpty():
                break
        rest = materialize(rest, "stretch")
        for block in blocks:
            refs = forced.where(F.col("_part") == block)
            rest = materialize(
                refs.groupBy(*decision).cogroup(rest.groupBy(*decision)).applyInPandas(clear, bare), "viable"
            )
        before = (picks.drop("_place") if picks is not None else forced.limit(0)).groupBy(*decision)
        new = materialize(before.cogroup(rest.groupBy(*decision)).applyInPandas(scan, schema), "picks")
        picks = new if picks is None else picks.unionByName(new)
    return picks if picks is not None else large.withColumn("_place", F.lit(0).cast("bigint")).limit(0)
