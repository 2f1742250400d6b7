"""Control-versus-treatment pairs: joining, safety checks, arm selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import (
    INTERVENTION_SCOPES,
    PAIR_METRICS,
    STRUCTURAL_FLOAT_FIELDS,
    STRUCTURAL_INTEGER_FIELDS,
)
from plumbline.functions import exprs as E

KEYS = ("unit", "seed")
# Checks that tell how a run was done, and those that tell how it ended.
MECHANICAL_CHECKS = (
    "same_unit_sha256", "same_parameters", "same_runtime_versions", "same_objective_sense",
    "known_intervention_scope", "run_budget_respected", "one_record_per_intervention",
    "context_budget_respected", "interventions_have_context",
)
TERMINAL_CHECKS = ("same_status", "same_primal_bound", "same_dual_bound")


def pair_arms(
    arms: DataFrame, columns: Sequence[str], *, native: str = "native", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Every treatment run beside the native run of its (unit, seed), as structs."""
    whole = F.struct(*columns)
    control = arms.where(F.col("arm") == native).select(*keys, whole.alias("native"))
    others = arms.where(F.col("arm") != native).select(*keys, "arm", whole.alias("treatment"))
    return others.join(control, list(keys))


def flat_pairs(pairs: DataFrame, fields: Sequence[str], keep: Sequence[str] = (*KEYS, "arm")):
    return pairs.select(
        *keep,
        *[F.col(f"{side}.{f}").alias(f"{side}_{f}") for f in fields for side in
          ("native", "treatment")],
    )


def duplicate_runs(arms: DataFrame, keys: Sequence[str] = (*KEYS, "arm")) -> DataFrame:
    return arms.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")


def _same(path: str) -> Column:
    return F.col(f"native.{path}").eqNullSafe(F.col(f"treatment.{path}"))


def _same_map(path: str) -> Column:
    # maps have no equality; their sorted entries do
    def entries(side):
        return F.array_sort(F.map_entries(F.col(f"{side}.{path}")))

    return entries("native").eqNullSafe(entries("treatment"))


def _close(path: str) -> Column:
    return E.close_to(f"native.outcome.{path}", f"treatment.outcome.{path}")


def _check_map(checks: dict[str, Column]) -> Column:
    parts = []
    for name, cond in checks.items():
        parts += [F.lit(name), F.coalesce(cond, F.lit(False))]
    return F.create_map(*parts)


def _all_true(checks: Column) -> Column:
    return F.forall(F.map_values(checks), lambda x: x)


def identity_checks() -> dict[str, Column]:
    return {
        "same_unit_sha256": _same("unit_sha256"),
        "same_parameters": _same_map("parameters"),
        "same_runtime_versions": _same_map("runtime"),
        "same_status": _same("outcome.status"),
        "same_objective_sense": _same("outcome.objective_sense"),
    }


def structural_checks(prefix: str = "same_") -> dict[str, Column]:
    return {
        **{f"{prefix}{f}": _same(f"outcome.{f}") for f in STRUCTURAL_INTEGER_FIELDS},
        **{f"{prefix}{f}": _close(f) for f in STRUCTURAL_FLOAT_FIELDS},
    }


def compare_structure(pairs: DataFrame) -> DataFrame:
    """Parity of a neutral arm with native: checks, verdict and reason.

    Time and integral are reported, never gating.
    """
    checks = _check_map(
        {
            **identity_checks(),
            "callback_exercised": F.col("treatment.selector.calls") > 0,
            **structural_checks(),
        }
    )
    t, n = "treatment.outcome", "native.outcome"
    return (
        pairs.withColumn("checks", checks)
        .withColumn("passed", _all_true(F.col("checks")))
        .withColumn(
            "class",
            E.parity_class(
                "passed", F.col("checks")["callback_exercised"], f"{n}.status", f"{t}.status"
            ),
        )
        .withColumn(
            "time_ratio",
            F.when(
                F.col(f"{n}.solving_time") > 0,
                F.col(f"{t}.solving_time") / F.nullif(F.col(f"{n}.solving_time"), F.lit(0.0)),
            ),
        )
        .withColumn(
            "integral_delta",
            F.col(f"{t}.primal_dual_integral") - F.col(f"{n}.primal_dual_integral"),
        )
    )


def compare_treatments(
    pairs: DataFrame, *, policy_arms: Sequence[str] = (), shadow_arms: Sequence[str] = ()
) -> DataFrame:
    """Safety checks per pair and what they allow: safe, eligible, fallback, valid.

    A treatment acts at most once per run (once in all for first-run scope) and
    must log a context for every action. A neutral shadow must also leave every
    structural number unchanged.
    """
    s = F.col("treatment.selector")
    budget = F.when(s["intervention_scope"] == "first-run-only", F.lit(1).cast("bigint")).otherwise(
        s["run_count"]
    )
    contexts = F.transform(s["context_records"], lambda r: r["context_sha256"])
    shadow = F.col("arm").isin(*shadow_arms) if shadow_arms else F.lit(False)
    policy = F.col("arm").isin(*policy_arms) if policy_arms else F.lit(False)
    base = {
        **identity_checks(),
        "native_complete": E.is_complete("native.outcome.status"),
        "treatment_complete": E.is_complete("treatment.outcome.status"),
        "same_primal_bound": _close("primal_bound"),
        "same_dual_bound": _close("dual_bound"),
        "known_intervention_scope": s["intervention_scope"].isin(*INTERVENTION_SCOPES),
        "run_budget_respected": (s["interventions"] >= 0) & (s["interventions"] <= budget),
        "one_record_per_intervention": F.size(s["intervention_records"]) == s["interventions"],
        "context_budget_respected": s["context_records"].isNull()
        | (F.size(s["context_records"]) <= budget),
        "interventions_have_context": s["context_records"].isNull()
        | F.forall(
            s["intervention_records"],
            lambda r: F.array_contains(contexts, r["context_sha256"]),
        ),
    }
    neutral = {
        "shadow_has_no_interventions": s["interventions"] == 0,
        "one_record_per_shadow_evaluation": F.size(s["shadow_records"]) == s["shadow_evaluations"],
        **structural_checks("shadow_same_"),
    }
    both = F.when(shadow, F.map_concat(_check_map(base), _check_map(neutral))).otherwise(
        _check_map(base)
    )
    return (
        pairs.withColumn("checks", both)
        .withColumn("safe", _all_true(F.col("checks")))
        .withColumn("eligible", s["interventions"] > 0)
        .withColumn("neutral_shadow", shadow)
        .withColumn("policy_fallback", policy & ~F.col("eligible"))
        .withColumn(
            "policy_evaluable",
            F.col("neutral_shadow") | F.col("eligible") | F.col("policy_fallback"),
        )
        .withColumn("valid", F.col("safe") & F.col("policy_evaluable"))
    )


def shadow_pairs(
    compared: DataFrame, times: Sequence[str], keys: Sequence[str] = ("unit", "seed")
) -> DataFrame:
    """(keys..., arm, times and completeness of both sides) with what a shadow arm did.

    ``structural_match``: every check holds, those of completeness aside. ``exposed``:
    the arm evaluated at all. ``proposed_change``: an evaluation would have selected
    otherwise; ``first_change`` is the place of the first such one, from 1, else null.
    Missing records or counts are no evaluation and no change.
    """
    checks = F.map_filter(
        "checks", lambda name, _: ~name.isin("native_complete", "treatment_complete")
    )
    s = F.col("treatment.selector")
    changes = F.transform(
        s["shadow_records"], lambda r: F.coalesce(r["proposed_changed_selected_cuts"] > 0, F.lit(False))
    )
    first = F.nullif(F.array_position(changes, F.lit(True)), F.lit(0).cast("bigint"))
    sides = [
        F.col(f"{side}.outcome.{t}").alias(f"{side}_{t}") for t in times for side in ("native", "treatment")
    ]
    return compared.select(
        *keys, "arm", *sides,
        *[E.is_complete(f"{side}.outcome.status").alias(f"{side}_complete")
          for side in ("native", "treatment")],
        _all_true(checks).alias("structural_match"),
        F.coalesce(s["shadow_evaluations"] > 0, F.lit(False)).alias("exposed"),
        first.isNotNull().alias("proposed_change"), first.alias("first_change"),
    )


def shadow_counts(shadows: DataFrame) -> DataFrame:
    """Per arm: pairs by completeness, matches, exposure and proposed changes."""
    native, treated = F.col("native_complete"), F.col("treatment_complete")
    return shadows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(native & treated).alias("both_complete"),
        F.count_if(native & ~treated).alias("native_complete_shadow_incomplete"),
        F.count_if(~native & treated).alias("native_incomplete_shadow_complete"),
        F.count_if(~native & ~treated).alias("both_incomplete"),
        F.count_if("structural_match").alias("structural_matches"),
        F.count_if("exposed").alias("exposed_pairs"),
        F.count_if(F.col("exposed") & F.col("structural_match")).alias("exposed_matches"),
        F.count_if("proposed_change").alias("proposed_changes"),
        F.sum("first_change").alias("first_change_places"),
    )


def pilot_blocks(
    compared: DataFrame, *, shadow: str, active: str, cluster: "Column | str",
    wall: str = "arm_wall_time_seconds", solver: str = "solving_time",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Compared pairs of a shadow and an active arm as one row per (unit, seed).

    ``mechanical_ok``: the active arm ran the planned way; ``terminal_ok``: it ended like
    native. A context is observed when both arms logged one, and matches when the first
    ones are equal. A block that lacks an arm stays: what is missing counts as not
    complete, not safe and not done the planned way.
    """
    s, checks = F.col("treatment.selector"), F.col("checks")

    def hold(names):
        every = [F.coalesce(checks[name], F.lit(False)) for name in names]
        return F.forall(F.array(*every), lambda x: x)

    def of(arm, value):  # an arm has one row per block
        return F.max(F.when(F.col("arm") == arm, value))

    def true_of(arm, value):
        return F.coalesce(of(arm, value), F.lit(False))

    context = F.get(s["context_records"], 0)["context_sha256"]
    done = {side: E.is_complete(f"{side}.outcome.status") for side in ("native", "treatment")}
    named = {"wall": wall, "solver": solver}
    grouped = compared.where(F.col("arm").isin(shadow, active)).withColumn(
        "_cluster", F.col(cluster) if isinstance(cluster, str) else cluster
    )
    blocks = grouped.groupBy(*keys).agg(
        F.max("_cluster").alias("cluster"),
        F.coalesce(F.max(done["native"]), F.lit(False)).alias("native_complete"),
        true_of(active, done["treatment"]).alias("active_complete"),
        *[F.max(f"native.outcome.{c}").alias(f"native_{t}") for t, c in named.items()],
        *[of(active, F.col(f"treatment.outcome.{c}")).alias(f"active_{t}")
          for t, c in named.items()],
        true_of(active, hold(MECHANICAL_CHECKS)).alias("mechanical_ok"),
        true_of(active, hold(TERMINAL_CHECKS)).alias("terminal_ok"),
        true_of(shadow, F.col("safe")).alias("shadow_safe"),
        F.coalesce(of(active, s["interventions"]), F.lit(0)).alias("interventions"),
        of(shadow, context).alias("_shadow"), of(active, context).alias("_active"),
    )
    seen = F.col("_shadow").isNotNull() & F.col("_active").isNotNull()
    return blocks.select(
        "*", seen.alias("context_observed"),
        F.coalesce(F.col("_shadow") == F.col("_active"), F.lit(False)).alias("context_match"),
    ).drop("_shadow", "_active")


def pair_metrics(
    compared: DataFrame, keep: Sequence[str], metrics: Sequence[str] = PAIR_METRICS
) -> DataFrame:
    """Long (keep..., metric, native, treatment, delta, saving)."""
    entries = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"native.outcome.{m}").cast("double").alias("native_value"),
            F.col(f"treatment.outcome.{m}").cast("double").alias("treatment_value"),
        )
        for m in metrics
    ]
    long = compared.select(*keep, F.inline(F.array(*entries)))
    return long.where(
        F.col("native_value").isNotNull() & F.col("treatment_value").isNotNull()
    ).select(
        "*",
        (F.col("treatment_value") - F.col("native_value")).alias("delta"),
        E.relative_saving("native_value", "treatment_value").alias("saving"),
    )


def arm_counts(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    return compared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if("safe").alias("safe_pairs"),
        F.count_if("eligible").alias("eligible_pairs"),
        F.count_if("neutral_shadow").alias("neutral_shadow_pairs"),
        F.count_if("valid").alias("valid_pairs"),
        F.count_if(F.col("eligible") & ~F.col("safe")).alias("unsafe_eligible_pairs"),
        F.count_if("policy_fallback").alias("policy_fallback_pairs"),
        F.count_if(F.col("policy_evaluable") & ~F.col("safe")).alias("unsafe_policy_pairs"),
    )


def metric_summary(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean delta and saving over valid pairs, with wins, ties and losses."""
    return (
        long.where("valid")
        .groupBy(*keys, "metric")
        .agg(
            F.count(F.lit(1)).alias("valid_pairs"),
            F.avg("delta").alias("mean_delta"),
            F.avg("saving").alias("mean_saving"),
            F.count_if(F.col("delta") < 0).alias("wins"),
            F.count_if(F.col("delta") == 0).alias("ties"),
            F.count_if(F.col("delta") > 0).alias("losses"),
        )
    )


def arm_summary(compared: DataFrame, long: DataFrame, *, primary: str = "lp_iterations"):
    """Per arm: counts over pairs, and unit-equal means of the primary metric."""
    counts = arm_counts(compared, ["arm"]).withColumn(
        "safe", F.col("safe_pairs") == F.col("pairs")
    )
    per_unit = metric_summary(long.where(F.col("metric") == primary), ["arm", "unit"])
    units = per_unit.groupBy("arm").agg(
        F.count(F.lit(1)).alias("eligible_units"),
        F.avg("mean_delta").alias("mean_primary_delta"),
        F.avg("mean_saving").alias("mean_primary_saving"),
        F.count_if(F.col("mean_delta") < 0).alias("unit_wins"),
        F.count_if(F.col("mean_delta") == 0).alias("unit_ties"),
        F.count_if(F.col("mean_delta") > 0).alias("unit_losses"),
    )
    return counts.join(units, "arm", "left").na.fill(
        {"eligible_units": 0, "unit_wins": 0, "unit_ties": 0, "unit_losses": 0}
    )


def parity_summary(compared: DataFrame) -> DataFrame:
    """Per arm: passed pairs and units, reasons, and the complete-and-exercised subset."""
    full = (
        F.col("checks")["callback_exercised"]
        & E.is_complete("native.outcome.status")
        & E.is_complete("treatment.outcome.status")
    )
    per_unit = compared.groupBy("arm", "unit").agg(
        F.bool_and("passed").alias("unit_passed"),
        F.count(F.lit(1)).alias("pairs"),
        F.count_if("passed").alias("passed_pairs"),
        F.count_if(full).alias("full_pairs"),
        F.count_if(full & F.col("passed")).alias("full_passed_pairs"),
        *[
            F.count_if(F.col("class") == c).alias(c)
            for c in (
                "callback_not_exercised",
                "both_arms_same_incomplete_limit_status",
                "structural_mismatch",
            )
        ],
    )
    sums = [c for c in per_unit.columns if c not in ("arm", "unit", "unit_passed")]
    return per_unit.groupBy("arm").agg(
        F.count_if("unit_passed").alias("passed_units"), *[F.sum(c).alias(c) for c in sums]
    )


def parity_exceptions(compared: DataFrame) -> DataFrame:
    failed = F.filter(
        F.map_entries("checks"), lambda e: ~e["value"]
    )
    return compared.where(~F.col("passed")).select(
        "unit", "seed", "arm", "class",
        F.array_join(F.array_sort(F.transform(failed, lambda e: e["key"])), ";").alias("failed"),
    )


def failed_check_counts(compared: DataFrame, keys: Sequence[str] = ("arm",)) -> DataFrame:
    return (
        compared.select(*keys, F.explode("checks").alias("check", "passed"))
        .where(~F.col("passed"))
        .groupBy(*keys, "check")
        .agg(F.count(F.lit(1)).alias("failed_pairs"))
    )


def context_agreement(arms: DataFrame, *, keys: Sequence[str] = KEYS, expected: int) -> DataFrame:
    """How many arms logged their first context, and whether all logged the same."""
    seen = arms.groupBy(*keys).agg(
        F.count("context_sha256").alias("observed_arms"),
        F.min("context_sha256").alias("_lo"),
        F.max("context_sha256").alias("_hi"),
    )
    everyone = F.col("observed_arms") == expected
    return seen.select(
        *keys,
        "observed_arms",
        everyone.alias("all_arms_observed"),
        (F.col("observed_arms") == 0).alias("no_arm_observed"),
        (everyone & (F.col("_lo") == F.col("_hi"))).alias("matching_across_arms"),
    )


# What a logged context may lack, in the order in which it is told.
CONTEXT_FAULTS = ("not_one_context", "payload_hash_differs", "manifest_hash_differs")


def shared_contexts(arms: DataFrame, *, keys: Sequence[str] = KEYS, expected: int) -> DataFrame:
    """The context that all arms of a block started from, checked down to its text.

    ``arms`` has a row per arm: ``context_records`` (context_sha256, decision_context as
    text) and the manifest's ``initial_context_sha256``. An arm must log one context, whose
    text has the logged hash, which is the manifest's; its first fault counts. Nulls are
    faults. Per block: arms, arms by fault, ``verdict`` (null, or arm_missing, arm_fault,
    arms_differ, equal_hashes_unequal_texts), and the context and its hash where all is
    well. A text is read once, by its task; blocks meet in one aggregate.
    """
    first = F.get("context_records", F.lit(0))
    told, text = first["context_sha256"], first["decision_context"]
    holds = (
        F.size("context_records") == 1,
        F.sha2(text, 256) == told,
        F.col("initial_context_sha256") == told,
    )
    bad = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in zip(CONTEXT_FAULTS, holds)]
    judged = arms.select(*keys, F.coalesce(*bad).alias("_fault"), told.alias("_hash"), text.alias("_text"))
    blocks = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("arms"),
        *[F.count_if(F.col("_fault") == name).alias(name) for name in CONTEXT_FAULTS],
        F.count("_fault").alias("_faults"),
        *[f(c).alias(f"{c}_{n}") for c in ("_hash", "_text") for n, f in (("lo", F.min), ("hi", F.max))],
    )
    verdict = (
        F.when(F.col("arms") < expected, "arm_missing")
        .when(F.col("_faults") > 0, "arm_fault")
        .when(F.col("_hash_lo") != F.col("_hash_hi"), "arms_differ")
        .when(F.col("_text_lo") != F.col("_text_hi"), "equal_hashes_unequal_texts")
    )
    fine = verdict.isNull()
    return blocks.select(
        *keys, "arms", *CONTEXT_FAULTS, verdict.alias("verdict"),
        F.when(fine, F.col("_hash_lo")).alias("context_sha256"),
        F.when(fine, F.col("_text_lo")).alias("context"),
    )


# ---- choosing an arm --------------------------------------------------------
def _place(arm: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in order]), arm)


def oracle_arm(
    comparisons: DataFrame, arms: Sequence[str], *, keys: Sequence[str] = KEYS,
    native: str = "native",
) -> DataFrame:
    """Best valid arm per block in hindsight; native wins every tie.

    ``comparisons`` has arm, native_value, treatment_value, valid. The arms of
    one block must share one native value.
    """
    option = F.struct(
        F.col("treatment_value").alias("value"),
        _place(F.col("arm"), arms).cast("int").alias("place"),
        F.col("arm").alias("arm"),
    )
    best = comparisons.groupBy(*keys).agg(
        F.min("native_value").alias("_lo"),
        F.max("native_value").alias("_hi"),
        F.min(F.when(F.col("valid"), option)).alias("_best"),
        F.count_if("valid").alias("valid_arms"),
    )
    shared = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.raise_error(F.lit("arms of one block must share one native value")).cast("double")
    )
    stay = F.struct(
        F.col("native_value").alias("value"), F.lit(0).alias("place"), F.lit(native).alias("arm")
    )
    picked = best.withColumn("native_value", shared).withColumn(
        "_pick", F.least(stay, F.coalesce(F.col("_best"), stay))
    )
    return picked.select(
        *keys,
        F.col("_pick.arm").alias("selected_arm"),
        "native_value",
        F.col("_pick.value").alias("selected_value"),
        (F.col("_pick.value") - F.col("native_value")).alias("delta"),
        E.relative_saving("native_value", "_pick.value").alias("saving"),
        "valid_arms",
    )


def oracle_summary(chosen: DataFrame, unit: str = "unit") -> DataFrame:
    per_unit = chosen.groupBy(unit).agg(
        F.avg("delta").alias("mean_delta"),
        F.avg("saving").alias("mean_saving"),
        F.count_if(F.col("delta") < 0).alias("wins"),
        F.count_if(F.col("delta") == 0).alias("ties"),
    )
    return per_unit.agg(
        F.count(F.lit(1)).alias("units"),
        F.avg("mean_delta").alias("mean_delta"),
        F.avg("mean_saving").alias("mean_saving"),
        F.sum("wins").alias("wins"),
        F.sum("ties").alias("ties"),
    )


# Exact sums make "total minus own" equal to summing the other seeds.
EXACT = "decimal(38,18)"


def leave_one_seed_out(
    comparisons: DataFrame, arms: Sequence[str], *, unit: str = "unit", seed: str = "seed",
    native: str = "native",
) -> DataFrame:
    """Choose an arm on all other seeds of a unit, then look at the held-out seed.

    The training score of an arm is its mean saving over the other seeds; an arm
    with an unsafe training pair is out; the score must be positive; the first
    arm in order wins ties. Scores come from exact unit totals minus the held
    seed, so no seed pairs are formed. ``comparisons`` has arm, safe, eligible,
    valid, native_complete, delta, saving.
    """
    own = F.when(F.col("safe"), F.when(F.col("eligible"), F.col("saving")).otherwise(F.lit(0.0)))
    scored = comparisons.withColumn("_own", own.cast(EXACT))
    totals = scored.groupBy(unit, "arm").agg(
        F.sum("_own").alias("_sum"),
        F.count(F.lit(1)).alias("_seeds"),
        F.count("_own").alias("_usable"),
    )
    joined = scored.join(totals, [unit, "arm"])
    others = F.col("_seeds") - 1
    clean = F.col("_usable") - F.when(F.col("_own").isNull(), 0).otherwise(1) == others
    rest = F.col("_sum").cast(EXACT) - F.coalesce(F.col("_own"), F.lit(0).cast(EXACT))
    training = F.when(
        (others > 0) & clean,
        F.coalesce(rest, F.lit(0).cast(EXACT)).cast("double") / F.nullif(others, F.lit(0)),
    )
    held = F.struct("arm", "safe", "eligible", "valid", "delta", "saving", "_train")
    order = F.struct(F.col("_train"), (-_place(F.col("arm"), arms)).alias("o"))
    chosen = (
        joined.withColumn("_train", training)
        .groupBy(unit, seed)
        .agg(
            F.max_by(F.when(F.col("_train") > 0, held), F.when(F.col("_train") > 0, order)).alias(
                "_pick"
            ),
            F.bool_and("native_complete").alias("_native_ok"),
        )
    )
    p = F.col("_pick")
    stay = p.isNull()
    fallback = p["safe"] & ~p["eligible"]
    value = {
        c: F.when(stay, F.when(F.col("_native_ok"), F.lit(0.0)))
        .when(fallback, F.lit(0.0))
        .when(p["valid"], p[c])
        for c in ("delta", "saving")
    }
    return chosen.select(
        unit,
        seed,
        F.coalesce(p["arm"], F.lit(native)).alias("selected_arm"),
        F.coalesce(p["_train"], F.lit(0.0)).alias("training_saving"),
        F.when(stay, native)
        .when(fallback, f"{native}-ineligible-fallback")
        .otherwise(p["arm"])
        .alias("effective_arm"),
        F.when(stay, F.col("_native_ok")).otherwise(p["safe"]).alias("held_out_safe"),
        (~stay & F.coalesce(p["eligible"], F.lit(False))).alias("held_out_eligible"),
        value["delta"].alias("held_out_delta"),
        value["saving"].alias("held_out_saving"),
    )


def leave_one_seed_out_summary(evaluations: DataFrame, unit: str = "unit") -> DataFrame:
    s = F.col("held_out_saving")
    return evaluations.groupBy(unit).agg(
        F.bool_and("held_out_safe").alias("safe"),
        F.count("held_out_saving").alias("evaluable_seeds"),
        F.count_if(~F.col("held_out_safe")).alias("unsafe_seeds"),
        F.avg(s).alias("mean_saving"),
        F.count_if(s > 0).alias("wins"),
        F.count_if(s == 0).alias("ties"),
        F.count_if(s < 0).alias("losses"),
    )


def complete_blocks(rows: DataFrame, arms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Blocks in which every arm ran."""
    full = rows.groupBy(*keys).agg(F.count_distinct("arm").alias("_arms")).where(
        F.col("_arms") == arms
    )
    return rows.join(full.select(*keys), list(keys), "left_semi")


# ---- mismatch diagnostics ------------------------------------------------------
def status_counts(arms: DataFrame) -> DataFrame:
    return arms.groupBy("arm", "status").agg(F.count(F.lit(1)).alias("runs"))


def discordance(pairs: DataFrame) -> DataFrame:
    """Pairs in which exactly one side finished, or both stopped at one limit."""
    n, t = F.col("native_complete"), F.col("treatment_complete")
    kind = (
        F.when(n & ~t, "native_complete_treatment_incomplete")
        .when(t & ~n, "treatment_complete_native_incomplete")
        .when(~n & ~t & (F.col("native_status") == F.col("treatment_status")),
              "both_incomplete_same_status")
    )
    return pairs.withColumn("kind", kind).where(F.col("kind").isNotNull())


def objective_mismatch(pairs: DataFrame, reference: DataFrame, *, unit: str = "unit") -> DataFrame:
    """Completed pairs that disagree on a bound, and who is nearer the known value."""
    off = ~E.close_to("native_primal_bound", "treatment_primal_bound") | ~E.close_to(
        "native_dual_bound", "treatment_dual_bound"
    )
    rows = pairs.where(F.col("native_complete") & F.col("treatment_complete") & off)
    far_n = F.abs(F.col("native_primal_bound") - F.col("reference_objective"))
    far_t = F.abs(F.col("treatment_primal_bound") - F.col("reference_objective"))
    return rows.join(reference, unit, "left").withColumn(
        "closer",
        F.when(F.col("reference_objective").isNull(), F.lit(None).cast("string"))
        .when(far_t < far_n, "treatment")
        .when(far_n < far_t, "native")
        .otherwise("tie"),
    )
