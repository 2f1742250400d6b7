"""Corpus inventory, candidate scan and audit verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.fixed_values import EXPECTED_UNITS, SCAN_MISSING_COLUMNS, SPLITS
from plumbline.functions import exprs as E
from plumbline.operators.decisions import duplicate_occurrences
from plumbline.operators.gates import check_rows
from plumbline.session import materialize


def inventory(units: DataFrame, *, split: str = "split", status: str = "status") -> DataFrame:
    """Units by split and, where a status is known, by split:status: (kind, key, units)."""
    by_status = F.struct(
        F.lit("split:status").alias("kind"), F.concat_ws(":", split, status).alias("key")
    )
    by_split = F.struct(F.lit("split").alias("kind"), F.col(split).alias("key"))
    kinds = F.array(by_split, F.when(F.col(status).isNotNull(), by_status))
    keyed = units.select(F.explode(F.array_compact(kinds)).alias("e"))
    return keyed.groupBy("e.kind", "e.key").agg(F.count(F.lit(1)).alias("units"))


def run_count_mismatches(
    reported: DataFrame, observed: Sequence[DataFrame], *, unit: str = "unit", run: str = "run"
) -> DataFrame:
    """Units whose reported run count differs from the largest run in any table.

    Units without an observed run are not judged. Each table is reduced to one
    number per unit before the join.
    """
    joined = reported
    names = []
    for i, table in enumerate(observed):
        top = table.groupBy(unit).agg(F.max(run).cast("bigint").alias(f"file_{i}"))
        joined = joined.join(top, unit, "left")
        names.append(f"file_{i}")
    largest = F.greatest(F.lit(0).cast("bigint"), *[F.coalesce(F.col(n), F.lit(0)) for n in names])
    return joined.withColumn("observed_runs", largest).where(
        (F.col("observed_runs") != 0) & (F.col("observed_runs") != F.col("reported_runs"))
    )


def transition_coverage(rows: DataFrame, *, split="split", unit="unit", run="run", depth="depth"):
    top = F.col(depth) == 0
    key = F.struct(split, unit, run)
    per_run = rows.groupBy(key.alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(top).alias("_root")
    )
    return per_run.agg(
        F.sum("_n").alias("transition_rows"),
        F.sum("_root").alias("root_transition_rows"),
        F.count(F.lit(1)).alias("runs_with_transitions"),
        F.count_if(F.col("_root") > 0).alias("runs_with_root_transition"),
    )


def missing_by_column(rows: DataFrame, columns: Sequence[str] = SCAN_MISSING_COLUMNS) -> DataFrame:
    """(column, missing, rows): blank or null texts, all columns in one pass."""
    text = {c for c, kind in rows.dtypes if kind == "string"}
    gone = [E.blank(c) if c in text else F.col(c).isNull() for c in columns]
    counts = rows.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(g).alias(f"_m{i}") for i, g in enumerate(gone)],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing"),
                 F.col("_rows").alias("rows"))
        for i, c in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*entries)))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)).agg(
        F.count(F.lit(1)).alias("rows")
    )


def scan_counts(rows: DataFrame, flags: dict[str, Column], *, split: str = "split") -> DataFrame:
    """Flat counters of the scan: all rows, rows per split, rows per flag."""
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(split) == s).alias(f"{s}_rows") for s in SPLITS],
        *[F.count_if(cond).alias(name) for name, cond in flags.items()],
    )


def trace_flags() -> dict[str, Column]:
    """Counters of the raw candidate table; texts are compared as written."""
    ratio, chosen = F.col("coeff_sparsity_ratio"), F.col("is_selected")
    return {
        "root_rows": E.exact_true("root"),
        "forced_rows": E.exact_true("is_forced"),
        "selected_blank_rows": E.blank(chosen),
        "selected_true_rows": E.exact_true("is_selected"),
        "applied_rows": E.exact_true("is_applied"),
        "sparsity_one_rows": F.coalesce(ratio == "1.0", F.lit(False)),
        "sparsity_zero_rows": F.coalesce(ratio == "0.0", F.lit(False)),
    }


def scan_once(
    rows: DataFrame, keep: Sequence[str], flags: dict[str, Column], *, malformed: str,
    missing: Sequence[str] = SCAN_MISSING_COLUMNS, split: str = "split",
) -> tuple[DataFrame, dict[str, int]]:
    """Write the ``keep`` columns of well-formed rows once and count on the way.

    The counts are observed by the tasks that write, so the files are parsed a single
    time: ``lines``, ``malformed_rows``, ``rows``, rows per split, every flag, and
    ``missing.<column>`` of each column. A null flag counts as false.
    """
    whole = F.col(malformed).isNull()

    def n(cond: Column) -> Column:
        return F.count_if(whole & F.coalesce(cond, F.lit(False)))

    seen = Observation()
    counted = rows.observe(
        seen,
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~whole).alias("malformed_rows"),
        F.count_if(whole).alias("rows"),
        *[n(F.col(split) == s).alias(f"{s}_rows") for s in SPLITS],
        *[n(cond).alias(name) for name, cond in flags.items()],
        *[n(E.blank(c)).alias(f"missing.{c}") for c in missing],
    )
    written = materialize(counted.where(whole).select(*keep), "scanned", compression="zstd")
    return written, dict(seen.get)


def missing_rows(spark: SparkSession, seen: dict[str, int]) -> DataFrame:
    """(column, missing, rows) of the counts of ``scan_once``: a row per counted column."""
    counts = [(c.removeprefix("missing."), n, seen["rows"]) for c, n in seen.items() if c.startswith("missing.")]
    return spark.createDataFrame(counts, "`column` string, missing bigint, rows bigint")


def duplicate_totals(rows: DataFrame, *, decision: Sequence[str], source_id: str, applied: str,
                     sequence: Sequence[str]) -> DataFrame:
    """Decision groups, those with a repeated id, and the repeated rows."""
    per = duplicate_occurrences(
        rows, decision=decision, source_id=source_id, applied=applied, sequence=sequence
    )
    return per.agg(
        F.count(F.lit(1)).alias("decision_groups"),
        F.count_if(F.col("duplicate_rows") > 0).alias("groups_with_duplicate_id"),
        F.sum("duplicate_rows").alias("duplicate_id_rows"),
        F.sum("duplicate_applied_rows").alias("duplicate_applied_rows"),
    )


def audit_checks(report: DataFrame, expected_units: int = EXPECTED_UNITS) -> DataFrame:
    """Check rows over a one-row report of totals, scan counters and fault counts."""
    c = F.col
    return check_rows(
        report,
        {
            "unit_count_as_expected": c("units") == expected_units,
            "all_required_files_present": c("missing_files") == 0,
            "headers_are_consistent": c("header_mismatches") == 0,
            "selector_statistics_parse": c("parse_failures") == 0,
            "logger_and_native_calls_match": c("call_mismatches") == 0,
            "observed_runs_match_reported": c("run_mismatches") == 0,
            "scan_matches_summaries": c("rows") == c("candidate_rows"),
            "one_decision_group_per_call": c("decision_groups") == c("calls"),
            "accounting_matches_candidates": c("selected") + c("filtered") == c("rows"),
            "only_forced_rows_have_selected_label": (c("selected_true_rows") == c("forced_rows"))
            & (c("selected_blank_rows") + c("selected_true_rows") == c("rows")),
            "sparsity_feature_is_nonconstant": c("sparsity_one_rows") != c("rows"),
            "applied_label_has_no_ambiguous_ids": c("groups_with_duplicate_id") == 0,
        },
    )


def audit_ratios(report: DataFrame) -> DataFrame:
    pairs = {
        "optimal_unit_fraction": ("optimal_units", "units"),
        "transition_coverage": ("transition_rows", "calls"),
        "applied_label_fraction": ("applied_rows", "rows"),
        "ambiguous_decision_fraction": ("groups_with_duplicate_id", "decision_groups"),
        "root_candidate_fraction": ("root_rows", "rows"),
        "cutoff_distance_missing_fraction": ("cutoff_distance_missing", "rows"),
    }
    entries = [
        F.struct(
            F.lit(name).alias("metric"), (F.col(a) / F.nullif(F.col(b), F.lit(0))).alias("value")
        )
        for name, (a, b) in pairs.items()
    ]
    return report.select(F.inline(F.array(*entries)))


# ---- selector records -----------------------------------------------------------
def usable_records(pairs: DataFrame) -> DataFrame:
    """Pairs that become records: a context all arms agree on, native finished.

    A partly observed or disagreeing context is an error, not a skip.
    """
    context_ok = F.col("no_arm_observed") | F.col("matching_across_arms")
    guarded = F.when(context_ok, F.col("no_arm_observed")).otherwise(
        F.raise_error(F.lit("contexts observed in part or not matching")).cast("boolean")
    )
    return pairs.where(~guarded & F.col("native_complete"))


def record_accounting(pairs: DataFrame) -> DataFrame:
    none, done = F.col("no_arm_observed"), F.col("native_complete")
    counts = pairs.agg(
        F.count(F.lit(1)).alias("source_pairs"),
        F.count_if(none).alias("skipped_no_context"),
        F.count_if(~none & ~done).alias("skipped_native_incomplete"),
        F.count_if(~none & done).alias("records"),
    )
    return counts.withColumn(
        "accounted",
        F.col("records") + F.col("skipped_no_context") + F.col("skipped_native_incomplete")
        == F.col("source_pairs"),
    )


def record_profile(
    records: DataFrame, *, size: str = "n_candidates", status: str = "native_status"
) -> DataFrame:
    """(whole, status, records, sized_records, smallest, largest, mean_size): a row per
    status and one of all records, in one aggregate. Null sizes don't count as sizes; a null
    status is a status of its own, told from the whole by ``whole``. No records, no rows."""
    return records.groupingSets([[F.col(status)], []], F.col(status)).agg(
        (F.grouping(status) == 1).alias("whole"), F.count(F.lit(1)).alias("records"),
        F.count(size).alias("sized_records"), F.min(size).alias("smallest"),
        F.max(size).alias("largest"), F.avg(size).alias("mean_size"),
    ).select(
        "whole", F.col(status).alias("status"), "records", "sized_records", "smallest", "largest", "mean_size",
    )


def label_counts(labels: DataFrame) -> DataFrame:
    """Per arm: safe, valid and positive-saving labels of the records."""
    return labels.groupBy("arm").agg(
        F.count_if("safe").alias("safe"),
        F.count_if("valid").alias("valid"),
        F.count_if(F.col("valid") & (F.col("saving") > 0)).alias("positive_saving"),
    )


def union_sources(sources: Sequence[DataFrame], keys: Sequence[str], arms: str = "arms"):
    """Union of experiments with one common arm set; a repeated key is an error."""
    whole = sources[0]
    for other in sources[1:]:
        whole = whole.unionByName(other)
    arm_sets = whole.select(F.array_sort(arms).alias("a")).distinct().limit(2).count()
    if arm_sets > 1:
        raise ValueError("all sources must use the same arm set")
    repeated = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError("duplicate unit-seed record across sources")
    return whole


def contract_mismatches(plan: DataFrame, result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned and observed keys that do not meet, with the missing side."""
    p = plan.select(*keys).distinct().withColumn("_p", F.lit(True))
    r = result.select(*keys).distinct().withColumn("_r", F.lit(True))
    joined = p.join(r, list(keys), "full_outer")
    return joined.where(F.col("_p").isNull() | F.col("_r").isNull()).select(
        *keys, F.when(F.col("_p").isNull(), "unplanned").otherwise("missing").alias("problem")
    )
