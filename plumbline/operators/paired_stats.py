"""Pair to unit to arm: intention-to-treat cost ratios, safety, descriptive metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import DESCRIPTIVE_METRICS, TIE_TOLERANCE
from plumbline.functions import exprs as E
from plumbline.operators.ordering import percentiles

CLASSES = (
    "both_complete",
    "native_complete_treatment_incomplete",
    "native_incomplete_treatment_complete",
    "both_incomplete",
)


def outcome_flags(pairs: DataFrame) -> DataFrame:
    """Completion, equivalence of the end state and safety failure per pair."""
    n, t = E.is_complete("native_status"), E.is_complete("treatment_status")
    equal = (
        n
        & t
        & F.col("native_status").eqNullSafe(F.col("treatment_status"))
        & F.col("native_objective_sense").eqNullSafe(F.col("treatment_objective_sense"))
        & E.close_to("native_primal_bound", "treatment_primal_bound")
        & E.close_to("native_dual_bound", "treatment_dual_bound")
    )
    return pairs.select(
        "*",
        n.alias("native_complete"),
        t.alias("treatment_complete"),
        equal.alias("equivalent"),
        (n & ~equal).alias("safety_failure"),
    )


def cost_pairs(pairs: DataFrame, limit: float, *, time: str = "time") -> DataFrame:
    """Penalised costs, their log ratio and the outcome class."""
    return (
        pairs.withColumn(
            "native_cost", E.penalised_time("native_complete", f"native_{time}", limit)
        )
        .withColumn(
            "treatment_cost", E.penalised_time("treatment_complete", f"treatment_{time}", limit)
        )
        .withColumn("log_ratio", F.log(F.col("treatment_cost") / F.col("native_cost")))
        .withColumn("outcome_class", E.outcome_class("native_complete", "treatment_complete"))
    )


def unit_records(costed: DataFrame, keys: Sequence[str] = ("arm", "unit")) -> DataFrame:
    """One row per (arm, unit). The log ratio over native-complete pairs is kept
    apart: it is the secondary, conditional analysis."""
    done = F.col("native_complete")
    aggs = [
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(done).alias("native_complete_pairs"),
        F.count_if("treatment_complete").alias("treatment_complete_pairs"),
        *[F.count_if(F.col("outcome_class") == c).alias(f"{c}_pairs") for c in CLASSES],
        F.count_if("safety_failure").alias("safety_failure_pairs"),
        F.bool_or("safety_failure").alias("safety_failure_unit"),
        F.count_if("intervention").alias("intervention_pairs"),
        F.count_if("policy_fallback").alias("policy_fallback_pairs"),
        F.avg("log_ratio").alias("mean_log_ratio"),
        F.avg(F.when(done, F.col("log_ratio"))).alias("mean_log_ratio_complete"),
    ]
    return costed.groupBy(*keys).agg(*aggs)


def _contest(log_mean: str, among) -> list:
    ratio = F.when(among, F.exp(log_mean))
    n = F.count(ratio)
    wins = F.count_if(ratio < 1.0)
    ties = F.count_if(F.abs(ratio - 1.0) <= F.lit(TIE_TOLERANCE))
    # a ratio just below one counts both as win and as tie; losses are the rest
    return [n, wins, ties, n - wins - ties]


def arm_statistics(
    units: DataFrame, keys: Sequence[str] = ("arm",), confidence: float = 0.95
) -> DataFrame:
    """Ratios over all pairs and over native-complete pairs, wins, safety bound."""
    everyone, complete = F.lit(True), F.col("native_complete_pairs") > 0
    n, w, t, lo = _contest("mean_log_ratio", everyone)
    cn, cw, ct, cl = _contest("mean_log_ratio_complete", complete)
    stats = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("pairs").alias("pairs"),
        F.sum("native_complete_pairs").alias("native_complete_pairs"),
        F.sum("intervention_pairs").alias("intervention_pairs"),
        F.sum("policy_fallback_pairs").alias("policy_fallback_pairs"),
        *[F.sum(f"{c}_pairs").alias(f"{c}_pairs") for c in CLASSES],
        F.sum("safety_failure_pairs").alias("safety_failure_pairs"),
        F.count_if(complete).alias("safety_units"),
        F.count_if(complete & F.col("safety_failure_unit")).alias("safety_failure_units"),
        F.count_if(F.col("intervention_pairs") > 0).alias("intervention_units"),
        F.exp(F.avg("mean_log_ratio")).alias("ratio"),
        w.alias("wins"), t.alias("ties"), lo.alias("losses"),
        F.exp(F.avg("mean_log_ratio_complete")).alias("ratio_complete"),
        cw.alias("wins_complete"), ct.alias("ties_complete"), cl.alias("losses_complete"),
    )
    return stats.select(
        "*",
        (1.0 - F.col("ratio")).alias("relative_saving"),
        (F.col("safety_failure_units") / F.nullif("safety_units", F.lit(0))).alias("failure_rate"),
        E.binomial_upper_bound("safety_failure_units", "safety_units", confidence).alias(
            "failure_rate_upper"
        ),
    )


def statistics_gate(stats: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("arm",)):
    from plumbline.operators.gates import keyed_check_rows

    return keyed_check_rows(
        stats.join(intervals, list(keys)),
        list(keys),
        {
            "zero_unit_safety_failures": F.col("safety_failure_units") == 0,
            "cost_ci95_upper_below_one": F.col("upper") < 1.0,
            "more_unit_wins_than_losses": F.col("wins") > F.col("losses"),
        },
    )


def descriptive_metrics(
    pairs: DataFrame, metrics: Sequence[str] = DESCRIPTIVE_METRICS, keys: Sequence[str] = ("arm",)
) -> DataFrame:
    """Unit-equal descriptive table per metric; non-finite values drop out."""
    entries = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"native_{m}").cast("double").alias("native"),
            F.col(f"treatment_{m}").cast("double").alias("treatment"),
        )
        for m in metrics
    ]
    long = pairs.select(*keys, "unit", F.inline(F.array(*entries))).where(
        E.is_finite("native") & E.is_finite("treatment")
    )
    per_unit = long.groupBy(*keys, "metric", "unit").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("native").alias("native"),
        F.avg("treatment").alias("treatment"),
        F.avg(E.relative_change("native", "treatment")).alias("change"),
    )
    d = F.col("treatment") - F.col("native")
    tol = F.lit(TIE_TOLERANCE)
    by = [*keys, "metric"]
    medians = percentiles(per_unit.withColumn("_d", d), by, "_d", {"median_delta": 0.5})
    stats = per_unit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("pairs").alias("pairs"),
        F.avg("native").alias("native_mean"),
        F.avg("treatment").alias("treatment_mean"),
        F.avg(d).alias("mean_delta"),
        F.avg("change").alias("mean_relative_change"),
        F.count_if(d < -tol).alias("units_lower"),
        F.count_if(F.abs(d) <= tol).alias("units_equal"),
        F.count_if(d > tol).alias("units_higher"),
    )
    return stats.join(medians, by).withColumn(
        "ratio_of_means", F.col("treatment_mean") / F.nullif("native_mean", F.lit(0.0))
    )


def timing_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Records, mean, median, nearest-rank 95th percentile and sum."""
    sums = rows.groupBy(*keys).agg(
        F.count(value).alias("records"), F.avg(value).alias("mean"), F.sum(value).alias("total")
    )
    ranks = percentiles(rows, keys, value, {"median": 0.5}, nearest_rank={"p95": 0.95})
    return sums.join(ranks, list(keys), "left")


def overhead(
    pairs: DataFrame, limit: float, *, times: Sequence[str], exposed: str, structural_match: str
) -> DataFrame:
    """Geometric ratios per time field over all pairs and over exposed pairs."""
    entries = [
        F.struct(
            F.lit(t).alias("field"),
            E.penalised_time("native_complete", f"native_{t}", limit).alias("_n"),
            E.penalised_time("treatment_complete", f"treatment_{t}", limit).alias("_t"),
        )
        for t in times
    ]
    long = pairs.select("arm", "unit", exposed, structural_match, F.inline(F.array(*entries)))
    log_ratio = F.log(F.col("_t") / F.col("_n"))
    per_unit = long.groupBy("arm", "field", "unit").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(exposed).alias("exposed_pairs"),
        F.count_if(structural_match).alias("structural_matches"),
        F.count_if(F.col(exposed) & F.col(structural_match)).alias("exposed_matches"),
        F.avg(log_ratio).alias("_all"),
        F.avg(F.when(F.col(exposed), log_ratio)).alias("_exposed"),
    )
    return per_unit.groupBy("arm", "field").agg(
        F.count(F.lit(1)).alias("units"),
        *[F.sum(c).alias(c) for c in
          ("pairs", "exposed_pairs", "structural_matches", "exposed_matches")],
        F.exp(F.avg("_all")).alias("ratio"),
        F.exp(F.avg("_exposed")).alias("ratio_exposed"),
    )


def arm_ratio_matrix(
    cells: DataFrame, limit: float, comparisons: Sequence[tuple[str, str]],
    times: Sequence[str], *, keys: Sequence[str] = ("unit", "seed"),
) -> DataFrame:
    """Geometric ratio of every listed arm pair for every time field.

    The arms of a block become columns in one aggregation; no self-join per pair.
    An arm that ran twice in a block is an error.
    """
    names = sorted({a for pair in comparisons for a in pair})

    def once(a: str, t: str) -> Column:
        value = F.when(F.col("arm") == a, E.penalised_time("complete", t, limit))
        twice = F.raise_error(F.lit(f"arm {a} ran twice in a block")).cast("double")
        return F.when(F.count_if(F.col("arm") == a) > 1, twice).otherwise(
            F.first(value, ignorenulls=True)
        )

    wide = cells.groupBy(*keys).agg(
        *[
            once(a, t).alias(f"{t}@{a}")
            for a in names
            for t in times
        ]
    )
    entries = [
        F.struct(
            F.lit(t).alias("field"),
            F.lit(top).alias("numerator"),
            F.lit(base).alias("denominator"),
            F.log(F.col(f"`{t}@{top}`") / F.col(f"`{t}@{base}`")).alias("log_ratio"),
        )
        for t in times
        for top, base in comparisons
    ]
    long = wide.select(*keys, F.inline(F.array(*entries))).where("log_ratio IS NOT NULL")
    by = ["field", "numerator", "denominator"]
    per_unit = long.groupBy(*by, keys[0]).agg(F.avg("log_ratio").alias("m"))
    return per_unit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("units"), F.exp(F.avg("m")).alias("ratio")
    )


# ---- decisions ------------------------------------------------------------------
def confirmation_faults(pairs: DataFrame, *, allowed: Sequence[int] = (0, 1)) -> DataFrame:
    """(unit, seed, fault): pairs that a planned confirmation can't be judged by.

    Every pair logs one context, acts an allowed number of times and starts where the
    native run does; a completed attributable pair is valid. Nulls are faults.
    """
    n, t, e = (F.col(c) for c in ("native_complete", "treatment_complete", "eligible"))
    faults = {
        "not_one_context": F.col("contexts") == 1,
        "too_many_interventions": F.col("interventions").isin(*allowed),
        "contexts_differ": F.col("contexts_match"),
        "completed_pair_not_valid": ~(n & e & t) | F.col("valid"),
    }
    named = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in faults.items()])
    )
    return pairs.select("unit", "seed", F.explode(named).alias("fault"))


def confirmation(pairs: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Planned-cohort confirmation per unit (and arm, if among the keys).

    Only native-complete pairs are attributable; ineligible units tie at zero;
    savings count over valid eligible pairs. Completed ones that are not valid are
    counted apart; a job stops on them.
    """
    n, t, e = (F.col(c) for c in ("native_complete", "treatment_complete", "eligible"))
    done, valid = n & e & t, F.coalesce("valid", F.lit(False))
    used = F.when(done & valid, F.col("saving"))
    per_unit = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("planned_pairs"),
        F.count_if(n).alias("attributable_pairs"),
        F.count_if(~n).alias("native_incomplete_pairs"),
        F.count_if(n & e).alias("eligible_attributable_pairs"),
        F.count_if(n & e & ~t).alias("unsafe_pairs"),
        F.count(used).alias("valid_pairs"),
        F.count_if(done & ~valid).alias("invalid_pairs"),
        F.coalesce(F.avg(used), F.lit(0.0)).alias("mean_saving"),
    )
    return per_unit.withColumn(
        "outcome",
        F.when(F.col("mean_saving") > 0, "win").when(F.col("mean_saving") < 0, "loss")
        .otherwise("tie"),
    )


def confirmation_summary(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"),
        *[F.sum(c).alias(c) for c in (
            "planned_pairs", "attributable_pairs", "native_incomplete_pairs",
            "eligible_attributable_pairs", "unsafe_pairs", "valid_pairs", "invalid_pairs")],
        F.avg("mean_saving").alias("mean_saving"),
        F.count_if(F.col("outcome") == "win").alias("wins"),
        F.count_if(F.col("outcome") == "loss").alias("losses"),
        F.count_if(F.col("outcome") == "tie").alias("ties"),
        F.min("mean_saving").alias("worst_saving"),
    )


def confirmation_gate(
    summary: DataFrame, minimum_pairs: int, keys: Sequence[str] = ()
) -> DataFrame:
    from plumbline.operators.gates import keyed_check_rows

    return keyed_check_rows(
        summary,
        list(keys),
        {
            "minimum_attributable_pairs_met": F.col("attributable_pairs") >= minimum_pairs,
            "zero_attributable_unsafe_pairs": F.col("unsafe_pairs") == 0,
            "mean_saving_positive": F.col("mean_saving") > 0,
            "more_unit_wins_than_losses": F.col("wins") > F.col("losses"),
            "no_unit_below_minus_0_25": F.col("worst_saving") >= -0.25,
        },
    )


def pilot_gate(
    stats: DataFrame, intervals: DataFrame, *, expected_pairs: int | Column, minimum_units: int,
    by_interval: bool = True,
) -> DataFrame:
    """Checks per arm that decide which fixed policy may advance."""
    from plumbline.operators.gates import keyed_check_rows

    last = (
        {"cost_ci95_upper_below_one": F.col("upper") < 1.0}
        if by_interval
        else {"cost_point_ratio_below_one": F.col("ratio") < 1.0}
    )
    return keyed_check_rows(
        stats.join(intervals, "arm", "left"),
        ["arm", "ratio"],
        {
            "all_native_runs_complete": F.col("native_complete_pairs") == expected_pairs,
            "zero_unit_safety_failures": F.col("safety_failure_units") == 0,
            f"changes_on_at_least_{minimum_units}_units": F.col("intervention_units")
            >= minimum_units,
            "more_unit_wins_than_losses": F.col("wins") > F.col("losses"),
            **last,
        },
    )


def best_passing_arm(checks: DataFrame, tie_order: Sequence[str]) -> DataFrame:
    """Passing arm with the smallest ratio; ties by the frozen order; null if none."""
    place = F.array_position(F.array(*[F.lit(a) for a in tie_order]), F.col("arm"))
    per_arm = checks.groupBy("arm", "ratio").agg(F.bool_and("passed").alias("passed"))
    return per_arm.agg(
        F.min_by(
            F.when(F.col("passed"), F.col("arm")),
            F.when(F.col("passed"), F.struct(F.col("ratio"), place)),
        ).alias("selected_arm"),
        F.count_if("passed").alias("passing_arms"),
        F.count(F.lit(1)).alias("arms"),
    )


def cluster_decision(blocks: DataFrame, limit: float, *, times: Sequence[str] = ("wall", "solver")):
    """Per cluster: exposure, correctness failure, lost runs and cost ratios.

    ``blocks`` has one row per (cluster, seed) with native_/active_ completion
    and times, mechanical_ok, terminal_ok, shadow_safe and intervention counts
    (``pairs.pilot_blocks`` makes them).
    """
    n, a = F.col("native_complete"), F.col("active_complete")
    acted = F.coalesce(F.col("interventions") > 0, F.lit(False))
    ratios = [
        F.avg(
            F.log(
                E.penalised_time("active_complete", f"active_{t}", limit)
                / E.penalised_time("native_complete", f"native_{t}", limit)
            )
        ).alias(f"log_{t}")
        for t in times
    ]
    return blocks.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if("shadow_safe").alias("shadow_matches"),
        F.bool_or(acted).alias("exposed"),
        F.count_if(~acted).alias("fallback_pairs"),
        F.bool_or(~F.col("mechanical_ok") | (n & a & ~F.col("terminal_ok"))).alias(
            "correctness_failure"
        ),
        F.bool_or(n & ~a).alias("lost_run"),
        F.count_if("context_observed").alias("observed_contexts"),
        F.count_if(F.col("context_observed") & ~F.col("context_match")).alias(
            "context_mismatches"
        ),
        *ratios,
    )


def pilot_population(clusters: DataFrame) -> DataFrame:
    """One row: how many clusters and pairs acted, fell back, matched or failed."""
    return clusters.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("pairs").alias("pairs"),
        F.count_if("exposed").alias("exposed_clusters"),
        F.sum("fallback_pairs").alias("fallback_pairs"),
        F.sum("shadow_matches").alias("shadow_matches"),
        F.sum("observed_contexts").alias("observed_contexts"),
        F.sum("context_mismatches").alias("context_mismatches"),
        F.count_if("correctness_failure").alias("correctness_failure_clusters"),
        F.count_if("lost_run").alias("lost_run_clusters"),
    )


def pilot_ratios(
    clusters: DataFrame, *, count: int, seed: int, draw: Callable[..., DataFrame],
    confidence: float = 0.95, one_sided: float = 0.80,
) -> DataFrame:
    """(measure, replicates, ratio, lower, upper, upper_one_sided) over clusters.

    Wall time is drawn twice, for its interval and for its one-sided bound, solver time
    once; each has a seed of its own. ``draw`` is a bootstrap of this library. All three
    are drawn in one pass over the clusters, as keys.
    """
    from plumbline.operators import bootstrap as B

    shift = {"wall": 0, "wall_one_sided": 1, "solver": 2}
    of = {"wall": "log_wall", "wall_one_sided": "log_wall", "solver": "log_solver"}
    entries = [F.struct(F.lit(m).alias("measure"), F.col(of[m]).alias("log_ratio")) for m in shift]
    logs = clusters.select("cluster", F.inline(F.array(*entries)))
    step = F.create_map(*[F.lit(x) for pair in shift.items() for x in pair])
    drawn = draw(
        logs, keys=["measure"], item="cluster", numerator="log_ratio", count=count,
        seed=(F.lit(seed) + step[F.col("measure")]).cast("bigint"),
    )
    point = logs.groupBy("measure").agg(F.exp(F.avg("log_ratio")).alias("ratio"))
    two = B.interval(drawn, keys=["measure"], confidence=confidence, geometric=True)
    one = B.upper_percentile(drawn, keys=["measure"], confidence=one_sided)
    return point.join(two, "measure").join(one, "measure")


def cluster_decision_gate(
    clusters: DataFrame, upper: DataFrame, *, planned_pairs: int, required_matches: int,
    minimum_exposed: int, max_failures: int = 0, max_lost: int = 0, max_ratio: float = 0.95,
    max_upper: float = 1.0,
) -> DataFrame:
    """The joint eight-check gate over clusters."""
    from plumbline.operators.gates import check_rows

    total = clusters.agg(
        F.sum("pairs").alias("pairs"),
        F.sum("shadow_matches").alias("shadow_matches"),
        F.sum("context_mismatches").alias("context_mismatches"),
        F.count_if("exposed").alias("exposed"),
        F.count_if("correctness_failure").alias("failures"),
        F.count_if("lost_run").alias("lost"),
        F.exp(F.avg("log_wall")).alias("ratio"),
    ).withColumn("upper", upper.select("upper_one_sided").scalar())
    return check_rows(
        total,
        {
            "all_planned_pairs_present": F.col("pairs") == planned_pairs,
            "shadow_matches_all_pairs": F.col("shadow_matches") == required_matches,
            "zero_context_mismatches": F.col("context_mismatches") == 0,
            "enough_clusters_exposed": F.col("exposed") >= minimum_exposed,
            "correctness_failures_within_cap": F.col("failures") <= max_failures,
            "lost_runs_within_cap": F.col("lost") <= max_lost,
            "point_ratio_within_cap": F.col("ratio") <= max_ratio,
            "one_sided_upper_within_cap": F.col("upper") <= max_upper,
        },
    )
