"""Audit roll-up: what a cohort's records say, by artifact, queue and status at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as E


def cohort_rollup(
    records: DataFrame, units: DataFrame, *, by: Sequence[str] = ("artifact", "queue", "status"),
    unit: str = "unit", group: str = "group", active: str = "active",
) -> DataFrame:
    """Totals of ``records`` (unit and the columns ``by``) for every subset of ``by``.

    ``units`` has one row per unit with its group and whether it is in the active cohort.
    Columns: ``level`` (names of the columns grouped by, comma-joined; empty for the whole),
    ``by`` (null where not grouped by), rows, units, active_units, unevaluated_units (active
    ones without a record there), groups, repeated_groups (of several units). A unit of no
    group, or of an empty one, is its own. Records of units that ``units`` lacks, or without
    unit, count as rows and unknown_rows only. Null values of ``by`` are values of their own,
    so ``level`` tells them from columns not grouped by. The whole is there without records too.

    Grouping sets meet in three steps, by unit, by group and by set, each pre-aggregated:
    no distinct list of a set is ever held, so a set of all records is no hot task.
    """
    known = units.select(
        F.col(unit).alias("_unit"), E.cluster_key(group, unit).alias("_group"),
        F.coalesce(F.col(active), F.lit(False)).alias("_active"),
    ).where("_unit IS NOT NULL")
    # A row per distinct record, before the sets multiply them.
    counted = records.groupBy(*by, F.col(unit).alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
    joined = counted.join(known, "_unit", "left")
    sets = [list(c) for n in range(len(by), -1, -1) for c in combinations(by, n)]

    def level(names):
        return F.concat_ws(",", *[F.when(F.grouping(c) == 0, c) for c in names])

    own = ["_unit", "_group", "_active"]
    per_unit = joined.groupingSets([[*s, *own] for s in sets], *by, *own).agg(
        level(by).alias("level"), F.sum("_n").alias("_n")
    )
    hit = F.col("_group").isNotNull()
    per_group = per_unit.groupBy("level", *by, "_group").agg(
        F.sum("_n").alias("_n"), F.count(F.when(hit, 1)).alias("_units"),
        F.count_if(hit & F.col("_active")).alias("_in"),
    )
    # Without records the whole would be no row: an empty one stands in.
    none = records.sparkSession.range(1).select(
        F.lit("").alias("level"),
        *[F.lit(None).cast(records.schema[c].dataType).alias(c) for c in by],
        F.lit(None).cast("string").alias("_group"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("_n", "_units", "_in")],
    )
    told = per_group.unionByName(none).groupBy("level", *by).agg(
        F.sum("_n").alias("rows"),
        F.sum(F.when(~hit, F.col("_n")).otherwise(0)).alias("unknown_rows"),
        F.sum("_units").alias("units"), F.sum("_in").alias("active_units"),
        F.count("_group").alias("groups"), F.count_if(F.col("_units") > 1).alias("repeated_groups"),
    )
    cohort = known.agg(F.count_if("_active")).scalar()
    return told.withColumn("unevaluated_units", cohort - F.col("active_units"))


def report_rows(artifact: str, summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A summary as rows (artifact, key, measure, value): a row per column that is no key.

    Keys are joined by ``|``, a null one is empty; values are texts, null stays null.
    """
    measures = [c for c in summary.columns if c not in keys]
    entries = [
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in measures
    ]
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    key = F.concat_ws("|", *named) if named else F.lit("")
    return summary.select(
        F.lit(artifact).alias("artifact"), key.alias("key"), F.inline(F.array(*entries))
    )


def audit_report(parts: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One table of all summaries: name to (summary, its keys)."""
    return reduce(DataFrame.unionAll, [report_rows(a, s, k) for a, (s, k) in parts.items()])
