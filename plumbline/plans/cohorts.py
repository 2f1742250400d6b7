"""Cohort selection, arm assignment, audits and collection metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import precision as N
from plumbline.operators import protocols as V
from plumbline.operators import rollup as R
from plumbline.operators import sampling as W
from plumbline.session import materialize
from plumbline.sources import html as H


def select_cohort(
    assignments: DataFrame, summaries: DataFrame, quality: DataFrame, *, leading: int = 30,
    bins: int = 10,
) -> DataFrame:
    """Clean training units, one per cluster: the quickest, then one per rank bin."""
    pool = W.assemble_pool(assignments.where("split = 'train'"), summaries, quality)
    return W.stratified_cohort(
        pool, cluster="cluster", unit="unit", order=["elapsed", "unit"], leading=leading, bins=bins
    )


def select_pilot(
    candidates: DataFrame, development: DataFrame, count: int, key: str
) -> DataFrame:
    """Hash-ordered units from clusters that development never touched."""
    pool = W.eligible_pool(candidates, development)
    return W.one_per_cluster(pool, count, cluster="cluster", unit="unit", key=key)


def assign_arms(
    units: DataFrame, seeds: Sequence[int], arms: Sequence[str], key: str, design: str
) -> tuple[DataFrame, DataFrame]:
    """(schedule, position counts) for the all-orders, carry-over or alternating design."""
    orders = {
        "all-orders": W.all_orders, "carry-over": W.carryover_orders,
        "alternating": W.alternating_orders,
    }[design](arms)
    schedule = W.balanced_schedule(
        W.blocks(units, seeds), orders, key, divisible=design == "all-orders"
    )
    return schedule, W.position_counts(schedule)


def cohort_audit(active: DataFrame, queues: DataFrame, assignments: DataFrame):
    """(per unit overlap, per queue overlap, grouped support) of an active cohort."""
    return (
        W.cohort_overlap(active, queues),
        W.overlap_by_queue(active, queues),
        N.cluster_support(assignments),
    )


@dataclass(frozen=True)
class AuditRollup:
    rollup: DataFrame
    members: DataFrame
    report: DataFrame


def audit_rollup(
    records: DataFrame, units: DataFrame, assignments: DataFrame,
    summaries: Mapping[str, tuple[DataFrame, Sequence[str]]],
) -> AuditRollup:
    """The whole audit of a cohort: totals by artifact, queue and status, members of
    repeated clusters, and one report of these totals, the support and ``summaries``
    (name to a summary and its keys, such as arm statistics)."""
    rollup = materialize(R.cohort_rollup(records, units), "rollup")
    parts = {
        "rollup": (rollup, ["level", "artifact", "queue", "status"]),
        "support": (N.cluster_support(assignments), ["split"]),
        **summaries,
    }
    return AuditRollup(rollup, N.repeated_members(assignments), R.audit_report(parts))


# ---- fixed values: cells of the collection table, in page order -------------
CELL_NAMES = [
    "instance",
    "variables",
    "binaries",
    "integers",
    "continuous",
    "constraints",
    "nonzeros",
    "submitter",
    "group",
    "page_status",
    "objective",
]


def collection_metadata(
    pages: DataFrame, easy: DataFrame, infeasible: DataFrame, *, table_id: str,
    names: Sequence[str] = CELL_NAMES,
) -> DataFrame:
    """Table rows with resolved status; names must be unique and lists inside it."""
    rows = H.checked_cells(H.table_rows(pages, table_id), list(names)).withColumnRenamed(
        "instance", "unit"
    )
    rows = rows.withColumn("page_status", F.lower("page_status"))
    repeated = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError("duplicate names in the collection table")
    listed = easy.select("unit").unionByName(infeasible.select("unit"))
    if not V.missing_metadata(listed, rows.select("unit")).isEmpty():
        raise ValueError("a status list names units outside the collection table")
    done = V.resolve_status(rows, easy, infeasible)
    return done.withColumn(
        "tags", F.when(F.col("status") == "infeasible", "infeasible").otherwise("")
    )
