"""Paired experiments from runs or pairs to decisions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.operators import bootstrap as B
from plumbline.operators import gates as G
from plumbline.operators import models as M
from plumbline.operators import nested as J
from plumbline.operators import paired_stats as S
from plumbline.operators import pairs as P
from plumbline.operators import precision as N
from plumbline.operators import quality as Q
from plumbline.operators import risk as K
from plumbline.session import materialize


@dataclass(frozen=True)
class ArmComparison:
    pairs: DataFrame
    summary: DataFrame
    oracle: DataFrame
    held_out: DataFrame
    failed_checks: DataFrame


def compare_arms(
    runs: DataFrame, arms: Sequence[str], *, native: str = "native",
    policy_arms: Sequence[str] = (), shadow_arms: Sequence[str] = (),
    primary: str = "lp_iterations",
) -> ArmComparison:
    """Runs (unit, seed, arm, unit_sha256, runtime, parameters, outcome, selector)
    to pair verdicts, arm summary, hindsight best arm and held-out arm choice."""
    if not P.duplicate_runs(runs).isEmpty():
        raise ValueError("an arm ran twice for one unit and seed")
    pairs = P.pair_arms(
        runs, ["unit_sha256", "runtime", "parameters", "outcome", "selector"], native=native
    )
    compared = P.compare_treatments(pairs, policy_arms=policy_arms, shadow_arms=shadow_arms)
    compared = materialize(compared, "compared")
    keep = ["unit", "seed", "arm", "safe", "eligible", "valid"]
    long = P.pair_metrics(
        compared.withColumn("native_complete", E.is_complete("native.outcome.status")),
        [*keep, "native_complete"],
    )
    main = long.where(F.col("metric") == primary)
    return ArmComparison(
        compared,
        P.arm_summary(compared, long, primary=primary),
        P.oracle_arm(main, arms, native=native),
        P.leave_one_seed_out(main, arms, native=native),
        P.failed_check_counts(compared),
    )


@dataclass(frozen=True)
class PairedStatistics:
    units: DataFrame
    arms: DataFrame
    intervals: DataFrame
    intervals_complete: DataFrame
    checks: DataFrame


def paired_statistics(
    pairs: DataFrame, limit: float, *, time: str = "solving_time", replicates: int = 10_000,
    seed: int = 20260720, confidence: float = 0.95,
) -> PairedStatistics:
    """Flat pairs (native_*/treatment_* status, bounds, time, intervention,
    policy_fallback) to unit and arm tables, intervals and the gate."""
    costed = S.cost_pairs(S.outcome_flags(pairs), limit, time=time)
    units = materialize(S.unit_records(costed), "unit-records")
    stats = S.arm_statistics(units, confidence=confidence)

    def boot(column: str, suffix: str) -> DataFrame:
        drawn = B.multinomial_replicates(
            units.where(F.col(column).isNotNull()), keys=["arm"], item="unit", numerator=column,
            count=replicates, seed=B.action_seed(seed, "arm", suffix),
        )
        return B.interval(drawn, keys=["arm"], confidence=confidence, geometric=True)

    intervals = boot("mean_log_ratio", "")
    complete = boot("mean_log_ratio_complete", ":native-complete")
    return PairedStatistics(
        units, stats, intervals, complete, S.statistics_gate(stats, intervals)
    )


def _refuse(what: str, differences: DataFrame | None) -> None:
    """Stop where a result differs from its plan; names a few of the places."""
    some = [] if differences is None else [r["path"] for r in differences.limit(5).collect()]
    if some:
        raise ValueError(f"{what} violates its plan at {sorted(some)}")


def confirm_plan(
    pairs: DataFrame, plan: DataFrame, minimum_pairs: int, differences: DataFrame | None = None
):
    """Planned-cohort confirmation; the observed blocks must be the planned ones.

    ``differences`` are those of plan and result (``nested.contract_differences``). Pairs that log
    contexts (contexts, interventions, contexts_match) are held against the rules for
    them; any fault stops the job."""
    _refuse("the confirmation", differences)
    if not Q.contract_mismatches(plan, pairs, ["unit", "seed"]).isEmpty():
        raise ValueError("observed blocks differ from the plan")
    logged = {"contexts", "interventions", "contexts_match"} <= set(pairs.columns)
    units = S.confirmation(pairs)
    if logged:
        some = S.confirmation_faults(pairs).select("fault").distinct().collect()
        if some:
            raise ValueError(f"pairs can't be judged: {sorted(r['fault'] for r in some)}")
    summary = S.confirmation_summary(units)
    if summary.select("invalid_pairs").first()[0]:
        raise ValueError("a completed attributable pair is not valid")
    return units, summary, S.confirmation_gate(summary, minimum_pairs)


def pilot_gate(
    stats: PairedStatistics, tie_order: Sequence[str], *, expected_pairs: int, minimum_units: int
):
    checks = S.pilot_gate(
        stats.arms, stats.intervals, expected_pairs=expected_pairs, minimum_units=minimum_units
    )
    return checks, S.best_passing_arm(checks, tie_order)


@dataclass(frozen=True)
class PilotReport:
    clusters: DataFrame
    population: DataFrame
    ratios: DataFrame
    checks: DataFrame
    verdict: DataFrame


def pilot_report(
    blocks: DataFrame, limit: float, *, planned_pairs: int, minimum_exposed: int,
    replicates: int = 10_000, seed: int = 20260720, differences: DataFrame | None = None,
    draw: Callable[..., DataFrame] = B.multinomial_replicates, **caps: float,
) -> PilotReport:
    """Cluster-level go/no-go of an active policy: per cluster what happened, the whole
    population, wall and solver ratios with intervals, eight checks and the verdict.

    ``differences`` are those of plan and result; one stops the job. ``caps`` are those
    of ``cluster_decision_gate``."""
    _refuse("the pilot", differences)
    clusters = materialize(S.cluster_decision(blocks, limit), "clusters")
    ratios = S.pilot_ratios(clusters, count=replicates, seed=seed, draw=draw)
    ratios = materialize(ratios, "pilot-ratios")
    checks = S.cluster_decision_gate(
        clusters, ratios.where("measure = 'wall_one_sided'"), planned_pairs=planned_pairs,
        required_matches=planned_pairs, minimum_exposed=minimum_exposed, **caps,
    )
    return PilotReport(clusters, S.pilot_population(clusters), ratios, checks, G.gate(checks))


def pilot_decision(blocks: DataFrame, limit: float, **options):
    """(clusters, checks) of ``pilot_report``."""
    report = pilot_report(blocks, limit, **options)
    return report.clusters, report.checks


def overhead_analysis(
    pairs: DataFrame, timings: DataFrame, limit: float, *, times: Sequence[str],
    exposed: str = "exposed", structural_match: str = "structural_match",
):
    """(ratio table, timing table) of a neutral arm; ``timings`` is (name, seconds)."""
    return (
        S.overhead(pairs, limit, times=times, exposed=exposed, structural_match=structural_match),
        S.timing_summary(timings, ["name"], "seconds"),
    )


@dataclass(frozen=True)
class FailureDiagnostics:
    status_counts: DataFrame
    failed_checks: DataFrame
    discordant: DataFrame
    objectives: DataFrame
    ratios: DataFrame


def failure_diagnostics(
    runs: DataFrame, compared: DataFrame, reference: DataFrame, limit: float,
    comparisons: Sequence[tuple[str, str]], times: Sequence[str],
) -> FailureDiagnostics:
    done = E.is_complete("outcome.status").alias("complete")
    cells = runs.select("unit", "seed", "arm", done, *[f"outcome.{t}" for t in times])
    fields = ("status", "primal_bound", "dual_bound")
    sides = ("native", "treatment")
    flat = compared.select(
        "unit", "seed", "arm",
        *[F.col(f"{s}.outcome.{f}").alias(f"{s}_{f}") for s in sides for f in fields],
        *[E.is_complete(f"{s}.outcome.status").alias(f"{s}_complete") for s in sides],
    )
    return FailureDiagnostics(
        P.status_counts(runs.select("arm", "outcome.status")),
        P.failed_check_counts(compared),
        P.discordance(flat),
        P.objective_mismatch(flat, reference),
        S.arm_ratio_matrix(cells, limit, comparisons, times),
    )


def precision_plan(units: DataFrame, assignments: DataFrame) -> DataFrame:
    """Sample sizes from unit records and the sealed split's support."""
    support = N.cluster_support(assignments).where("split = 'test'")
    return N.precision_plan(N.log_ratio_spread(units), support)


def checked_contexts(arms: DataFrame, expected: int) -> DataFrame:
    """(unit, seed, context_sha256, context) of every block; any fault or any key that only
    an outcome has stops the job."""
    blocks = materialize(P.shared_contexts(arms, expected=expected), "contexts")
    faults = [r["verdict"] for r in blocks.where("verdict IS NOT NULL").select("verdict").distinct().collect()]
    if faults:
        raise ValueError(f"arms don't share a sound context: {sorted(faults)}")
    kept = blocks.select("unit", "seed", "context_sha256", "context")
    paths = [r["path"] for r in J.forbidden_paths(kept, "context").limit(5).collect()]
    if paths:
        raise ValueError(f"outcome fields in contexts: {sorted(paths)}")
    return kept


def build_records(pairs: DataFrame, labels: DataFrame):
    """(records, accounting, label counts); every source pair is accounted for."""
    counts = Q.record_accounting(pairs)
    if not counts.first()["accounted"]:
        raise ValueError("source pairs are not all accounted for")
    records = Q.usable_records(pairs)
    kept = labels.join(records.select("unit", "seed"), ["unit", "seed"], "left_semi")
    return records, counts, Q.label_counts(kept)


def risk_diagnostic(
    rows: DataFrame, features: Sequence[str], *, label: str = "unsafe", unit: str = "unit",
    action: str = "action", candidates: str = "n_candidates", selected: str = "budget",
    rounds: int = 20,
):
    """(model quality, baseline quality, thresholds, gate) of an out-of-fold risk model."""
    scored = materialize(
        M.out_of_fold(rows, label=label, features=features, rounds=rounds), "risk-scored"
    )
    blocks = materialize(K.score_blocks(scored, score="model_score", label=label), "blocks")
    base = K.structural_baselines(
        rows, unit=unit, action=action, label=label, candidates=candidates, selected=selected
    )
    base_blocks = materialize(
        K.score_blocks(base, score="score", label="label", keys=["baseline"]), "blocks"
    )
    model, thresholds = K.ranking_quality(blocks), K.threshold_table(blocks, score="model_score")
    other = K.ranking_quality(base_blocks, ["baseline"])
    other_t = K.threshold_table(base_blocks, score="score", keys=["baseline"])
    return model, other, thresholds, K.risk_gate(model, thresholds, other, other_t)
