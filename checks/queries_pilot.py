"""Decisions on pilots and confirmations, from whole run records to verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.queries_pairs import (
    ARM_STATS_SQL, ARMS, COMPARED_SQL, LIMIT, LOSO_SQL, NAME_SEED, NATIVE, POLICY, REPLICATES, SEED,
    SHADOW, arm_runs, choices, costed, draw_sql,
)
from checks.queries_ranking import rounded
from checks.views import CELLS_SQL, PAIRED_SQL, pairs_cells
from plumbline.functions import exprs as E
from plumbline.operators import bootstrap as B
from plumbline.operators import paired_stats as S
from plumbline.operators import pairs as P
from plumbline.operators import quality as Q
from plumbline.plans import experiments as X
from plumbline.session import materialize

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def compared(spark, sf):
    """All arms against native. A run of a multiple of four nodes logs no context, others
    one that tells odd from even."""
    n = F.col("outcome.nodes")
    sha = F.sha2(F.concat_ws("|", "unit", "seed", n % 2), 256)
    record = F.struct(F.lit(1).cast("bigint").alias("run_number"), sha.alias("context_sha256"))
    none = F.array().cast("array<struct<run_number:bigint,context_sha256:string>>")
    selector = (
        F.col("selector")
        .withField("context_records", F.when(n % 4 == 0, none).otherwise(F.array(record)))
        .withField("intervention_records", F.when(n % 2 == 0, none).otherwise(F.array(record)))
    )
    pairs = P.pair_arms(
        arm_runs(spark, sf).withColumn("selector", selector),
        ["unit_sha256", "runtime", "parameters", "outcome", "selector"], native=NATIVE,
    )
    return P.compare_treatments(pairs, policy_arms=POLICY, shadow_arms=SHADOW)


# ---- pilot of an active arm, beside a shadow ---------------------------------------
BLOCKS_SQL = f"""{COMPARED_SQL},
logged AS (SELECT *, CASE WHEN treatment_nodes % 4 <> 0 THEN treatment_nodes % 2 END AS context FROM compared),
halves AS (
  SELECT unit, seed, 'c' || (unit % 20) AS cluster, bool_or(native_complete) AS native_complete,
    coalesce(bool_or(treatment_complete) FILTER (arm = 'click'), false) AS active_complete,
    max(native_time + native_nodes / 10) AS native_wall,
    max(treatment_time + treatment_nodes / 10) FILTER (arm = 'click') AS active_wall,
    max(native_time) AS native_solver, max(treatment_time) FILTER (arm = 'click') AS active_solver,
    coalesce(bool_or(same_parameters) FILTER (arm = 'click'), false) AS mechanical_ok,
    coalesce(bool_or(same_status AND same_bounds) FILTER (arm = 'click'), false) AS terminal_ok,
    coalesce(bool_or(safe) FILTER (arm = 'error'), false) AS shadow_safe,
    coalesce(max(treatment_nodes % 2) FILTER (arm = 'click'), 0) AS interventions,
    max(context) FILTER (arm = 'error') AS s, max(context) FILTER (arm = 'click') AS a
  FROM logged WHERE arm IN ('error', 'click') GROUP BY unit, seed),
blocks AS (SELECT * EXCLUDE (s, a), s IS NOT NULL AND a IS NOT NULL AS context_observed,
    coalesce(s = a, false) AS context_match FROM halves)"""

CLUSTERS_SQL = f"""{BLOCKS_SQL},
costs AS (SELECT *, CASE WHEN active_complete THEN greatest(active_wall, 1e-12::DOUBLE) ELSE 400 END AS aw,
    CASE WHEN native_complete THEN greatest(native_wall, 1e-12::DOUBLE) ELSE 400 END AS nw,
    CASE WHEN active_complete THEN greatest(active_solver, 1e-12::DOUBLE) ELSE 400 END AS av,
    CASE WHEN native_complete THEN greatest(native_solver, 1e-12::DOUBLE) ELSE 400 END AS nv FROM blocks),
clusters AS (
  SELECT cluster, count(*) AS pairs, count(*) FILTER (shadow_safe) AS shadow_matches,
    bool_or(interventions > 0) AS exposed, count(*) FILTER (interventions = 0) AS fallback_pairs,
    bool_or(NOT mechanical_ok OR (native_complete AND active_complete AND NOT terminal_ok)) AS correctness_failure,
    bool_or(native_complete AND NOT active_complete) AS lost_run,
    count(*) FILTER (context_observed) AS observed_contexts,
    count(*) FILTER (context_observed AND NOT context_match) AS context_mismatches,
    avg(ln(aw / nw)) AS log_wall, avg(ln(av / nv)) AS log_solver FROM costs GROUP BY cluster)"""

SHIFTED = f"{SEED} + CASE measure WHEN 'wall' THEN 0 WHEN 'wall_one_sided' THEN 1 ELSE 2 END"
RATIOS_SQL = f"""{CLUSTERS_SQL},
items AS (SELECT unnest(['wall', 'wall_one_sided', 'solver']) AS measure, cluster AS item,
    unnest([log_wall, log_wall, log_solver]) AS num, 1::DOUBLE AS den FROM clusters),
{draw_sql('items', 'measure', SHIFTED)},
ratios AS (
  SELECT measure, any_value(ratio) AS ratio, count(*) AS replicates,
    quantile_cont(exp(estimate), 0.025) AS lower, quantile_cont(exp(estimate), 0.975) AS upper,
    quantile_cont(exp(estimate), 0.8) AS upper_one_sided
  FROM boot JOIN (SELECT measure, exp(avg(num)) AS ratio FROM items GROUP BY measure) USING (measure)
  GROUP BY measure)"""


def blocks(spark, sf):
    cluster = F.concat(F.lit("c"), (F.col("unit") % 20).cast("string"))
    return P.pilot_blocks(compared(spark, sf), shadow="error", active="click", cluster=cluster)


# Caps of the second case, wide enough for these runs.
WIDE = {"max_failures": 20, "max_lost": 20, "max_ratio": 3.0, "max_upper": 3.0}


def report(spark, sf, planned=54, rows=None, **caps):
    return X.pilot_report(
        blocks(spark, sf) if rows is None else rows, LIMIT, planned_pairs=planned,
        minimum_exposed=10, replicates=REPLICATES, seed=SEED, draw=B.replicates, **caps,
    )


@query(
    "pilot_blocks",
    f"""WITH {BLOCKS_SQL}
SELECT * EXCLUDE (native_wall, active_wall, native_solver, active_solver), round(native_wall, 9) AS native_wall,
  round(active_wall, 9) AS active_wall, round(native_solver, 9) AS native_solver,
  round(active_solver, 9) AS active_solver FROM blocks""",
)
def pilot_blocks(spark, sf):
    return rounded(blocks(spark, sf))


@query(
    "pilot_clusters",
    f"""WITH {CLUSTERS_SQL}
SELECT * EXCLUDE (log_wall, log_solver), round(log_wall, 9) AS log_wall, round(log_solver, 9) AS log_solver
FROM clusters""",
)
def pilot_clusters(spark, sf):
    return rounded(S.cluster_decision(blocks(spark, sf), LIMIT))


@query(
    "pilot_population",
    f"""WITH {CLUSTERS_SQL}
SELECT count(*) AS clusters, sum(pairs)::BIGINT AS pairs, count(*) FILTER (exposed) AS exposed_clusters,
  sum(fallback_pairs)::BIGINT AS fallback_pairs, sum(shadow_matches)::BIGINT AS shadow_matches,
  sum(observed_contexts)::BIGINT AS observed_contexts, sum(context_mismatches)::BIGINT AS context_mismatches,
  count(*) FILTER (correctness_failure) AS correctness_failure_clusters,
  count(*) FILTER (lost_run) AS lost_run_clusters FROM clusters""",
)
def pilot_population(spark, sf):
    return S.pilot_population(S.cluster_decision(blocks(spark, sf), LIMIT))


@query(
    "pilot_ratios",
    f"""WITH {RATIOS_SQL}
SELECT measure, replicates, round(ratio, 9) AS ratio, round(lower, 9) AS lower, round(upper, 9) AS upper,
  round(upper_one_sided, 9) AS upper_one_sided FROM ratios""",
)
def pilot_ratios(spark, sf):
    return rounded(report(spark, sf).ratios)


@query(
    "pilot_decision",
    f"""WITH {RATIOS_SQL},
t AS (SELECT *, (SELECT sum(pairs) FROM clusters) AS pairs, (SELECT sum(shadow_matches) FROM clusters) AS matches,
    (SELECT sum(context_mismatches) FROM clusters) AS mismatches,
    (SELECT count(*) FROM clusters WHERE exposed) AS exposed,
    (SELECT count(*) FROM clusters WHERE correctness_failure) AS failures,
    (SELECT count(*) FROM clusters WHERE lost_run) AS lost
  FROM ratios WHERE measure = 'wall_one_sided'),
cases AS (SELECT * FROM t, (VALUES ('strict', 54, 0, 0, 0.95::DOUBLE, 1::DOUBLE),
    ('wide', NULL, 20, 20, 3::DOUBLE, 3::DOUBLE)) v("case", planned, max_failures, max_lost, max_ratio, max_upper)),
told AS (SELECT "case", unnest(['all_planned_pairs_present', 'shadow_matches_all_pairs', 'zero_context_mismatches',
    'enough_clusters_exposed', 'correctness_failures_within_cap', 'lost_runs_within_cap', 'point_ratio_within_cap',
    'one_sided_upper_within_cap']) AS "check",
  unnest([pairs = coalesce(planned, pairs), matches = coalesce(planned, pairs), mismatches = 0, exposed >= 10,
    failures <= max_failures, lost <= max_lost, ratio <= max_ratio, upper_one_sided <= max_upper]) AS passed
  FROM cases)
SELECT * FROM told UNION ALL SELECT "case", 'all', bool_and(passed) FROM told GROUP BY "case" """,
)
def pilot_decision(spark, sf):
    """Two plans over the same blocks: a strict one, and one of all pairs with wide caps."""
    rows = materialize(blocks(spark, sf), "pilot-blocks")
    made = {"strict": report(spark, sf, rows=rows), "wide": report(spark, sf, rows.count(), rows, **WIDE)}
    told = [
        part.select(F.lit(case).alias("case"), "check", "passed")
        for case, r in made.items()
        for part in (r.checks, r.verdict.withColumn("check", F.lit("all")))
    ]
    return reduce(DataFrame.unionAll, told)


# ---- pilot of fixed arms -----------------------------------------------------------
CASES_SQL = """,
cases AS (
  SELECT arm, unit, native_complete, treatment_complete, treatment_nodes, log_ratio FROM costed
  UNION ALL SELECT 'swapped ' || arm, unit, treatment_complete, native_complete, native_nodes, -log_ratio FROM costed
  UNION ALL SELECT 'completed ' || arm, unit, native_complete, treatment_complete, treatment_nodes, log_ratio
    FROM costed WHERE native_complete AND treatment_complete)"""
CASE_STATS_SQL = ARM_STATS_SQL.replace(PAIRED_SQL, PAIRED_SQL + CASES_SQL).replace(
    "FROM costed GROUP BY arm, unit", "FROM cases GROUP BY arm, unit"
)
GATE_SQL = f"""{CASE_STATS_SQL},
items AS (SELECT arm, unit AS item, mean_log_ratio AS num, 1::DOUBLE AS den FROM unit_log),
{draw_sql('items', 'arm', NAME_SEED.format(SEED))},
ci AS (SELECT arm, quantile_cont(exp(estimate), 0.975) AS upper FROM boot GROUP BY arm),
checked AS (SELECT arm, ratio, unnest(['all_native_runs_complete', 'zero_unit_safety_failures',
    'changes_on_at_least_10_units', 'more_unit_wins_than_losses', 'cost_ci95_upper_below_one']) AS "check",
  unnest([native_complete_pairs = pairs, safety_failure_units = 0, intervention_units >= 10,
    wins > units - wins - ties, upper < 1]) AS passed FROM stats JOIN ci USING (arm))"""


def gate_checks(spark, sf):
    """The arms as run, with the roles of both sides swapped, and over completed pairs."""
    done = costed(spark, sf)
    swap = {
        f"{a}_{c}": f"{b}_{c}"
        for a, b in (("native", "treatment"), ("treatment", "native"))
        for c in ("time", "complete", "nodes", "work", "peak")
    }
    turned = done.select("unit", "seed", "arm", "cluster", *[F.col(b).alias(a) for a, b in swap.items()])
    turned = S.cost_pairs(
        turned.select(
            "*", (F.col("native_complete") & ~F.col("treatment_complete")).alias("safety_failure"),
            (F.col("treatment_nodes") > 1).alias("intervention"),
            (F.col("treatment_nodes") <= 1).alias("policy_fallback"),
        ), LIMIT,
    )
    both = done.where("native_complete AND treatment_complete")
    named = {"swapped ": turned, "completed ": both}
    cases = reduce(
        DataFrame.unionByName,
        [d.withColumn("arm", F.concat(F.lit(n), "arm")) for n, d in named.items()], done,
    )
    units = materialize(S.unit_records(cases), "gate-units")
    drawn = B.replicates(
        units, keys=["arm"], item="unit", numerator="mean_log_ratio", count=REPLICATES,
        seed=B.action_seed(SEED, "arm"),
    )
    return S.pilot_gate(
        S.arm_statistics(units), B.interval(drawn, keys=["arm"], geometric=True),
        expected_pairs=F.col("pairs"), minimum_units=10,
    )


@query(
    "pilot_gate",
    f"""WITH {GATE_SQL} SELECT arm, round(ratio, 9) AS ratio, "check", passed FROM checked""",
)
def pilot_gate(spark, sf):
    return rounded(gate_checks(spark, sf))


@query(
    "pilot_gate_selection",
    f"""WITH {GATE_SQL},
v AS (SELECT arm, any_value(ratio) AS ratio, bool_and(passed) AS ok FROM checked GROUP BY arm),
o AS (SELECT *, list_position(['completed click', 'swapped click', 'click', 'swapped error'], arm) AS place FROM v)
SELECT arg_min(CASE WHEN ok THEN arm END, CASE WHEN ok THEN (ratio, place) END) AS selected_arm,
  count(*) FILTER (ok) AS passing_arms, count(*) AS arms FROM o""",
)
def pilot_gate_selection(spark, sf):
    """The arm that advances, if any does."""
    order = ["completed click", "swapped click", "click", "swapped error"]
    return S.best_passing_arm(gate_checks(spark, sf), order)


# ---- confirmation of planned arms --------------------------------------------------
JUDGED_SQL = f"""{COMPARED_SQL},
judged AS (SELECT *, native_complete AND eligible AND treatment_complete AS done,
    CASE WHEN floor(native_work) <> 0 THEN (floor(native_work) - floor(treatment_work)) / floor(native_work) END AS saving
  FROM compared),
cunits AS (
  SELECT arm, unit, count(*) AS planned_pairs, count(*) FILTER (native_complete) AS attributable_pairs,
    count(*) FILTER (NOT native_complete) AS native_incomplete_pairs,
    count(*) FILTER (native_complete AND eligible) AS eligible_attributable_pairs,
    count(*) FILTER (native_complete AND eligible AND NOT treatment_complete) AS unsafe_pairs,
    count(saving) FILTER (done AND valid) AS valid_pairs, count(*) FILTER (done AND NOT valid) AS invalid_pairs,
    coalesce(avg(saving) FILTER (done AND valid), 0) AS mean_saving FROM judged GROUP BY arm, unit),
csum AS (
  SELECT arm, count(*) AS units, sum(planned_pairs)::BIGINT AS planned_pairs,
    sum(attributable_pairs)::BIGINT AS attributable_pairs, sum(native_incomplete_pairs)::BIGINT AS native_incomplete_pairs,
    sum(eligible_attributable_pairs)::BIGINT AS eligible_attributable_pairs, sum(unsafe_pairs)::BIGINT AS unsafe_pairs,
    sum(valid_pairs)::BIGINT AS valid_pairs, sum(invalid_pairs)::BIGINT AS invalid_pairs, avg(mean_saving) AS mean_saving,
    count(*) FILTER (mean_saving > 0) AS wins, count(*) FILTER (mean_saving < 0) AS losses,
    count(*) FILTER (mean_saving = 0) AS ties, min(mean_saving) AS worst_saving FROM cunits GROUP BY arm)"""


def judged(spark, sf):
    c = compared(spark, sf)
    done = {f"{s}_complete": E.is_complete(f"{s}.outcome.status") for s in ("native", "treatment")}
    s, first = F.col("treatment.selector"), lambda side: F.get(F.col(f"{side}.selector.context_records"), 0)
    same = first("native")["context_sha256"] == first("treatment")["context_sha256"]
    c = c.withColumns(done).withColumns({
        "contexts": F.size(s["context_records"]), "interventions": s["interventions"], "contexts_match": same,
    })
    keep = ["unit", "seed", "arm", "eligible", "valid", *done, "contexts", "interventions", "contexts_match"]
    return P.pair_metrics(c, keep, ["lp_iterations"])


@query(
    "confirmation_summary",
    f"""WITH {JUDGED_SQL}
SELECT * EXCLUDE (mean_saving, worst_saving), round(mean_saving, 9) AS mean_saving,
  round(worst_saving, 9) AS worst_saving FROM csum""",
)
def confirmation_summary(spark, sf):
    units = S.confirmation(judged(spark, sf), ["arm", "unit"])
    return rounded(S.confirmation_summary(units, ["arm"]))


@query(
    "confirmation_gate",
    f"""WITH {JUDGED_SQL}
SELECT arm, unnest(['minimum_attributable_pairs_met', 'zero_attributable_unsafe_pairs', 'mean_saving_positive',
    'more_unit_wins_than_losses', 'no_unit_below_minus_0_25']) AS "check",
  unnest([attributable_pairs >= 50, unsafe_pairs = 0, mean_saving > 0, wins > losses, worst_saving >= -0.25]) AS passed
FROM csum""",
)
def confirmation_gate(spark, sf):
    summary = S.confirmation_summary(S.confirmation(judged(spark, sf), ["arm", "unit"]), ["arm"])
    return S.confirmation_gate(summary, 50, ["arm"])


@query(
    "confirmation_faults",
    f"""WITH {JUDGED_SQL},
logs AS (SELECT *, treatment_nodes % 4 <> 0 AS logs, coalesce(native_nodes % 4 <> 0 AND treatment_nodes % 4 <> 0
    AND native_nodes % 2 = treatment_nodes % 2, false) AS matches FROM judged)
SELECT unit, seed, 'not_one_context' AS fault, count(*) AS arms FROM logs WHERE NOT logs GROUP BY ALL
UNION ALL SELECT unit, seed, 'contexts_differ', count(*) FROM logs WHERE NOT matches GROUP BY ALL
UNION ALL SELECT unit, seed, 'completed_pair_not_valid', count(*) FROM logs WHERE done AND NOT valid GROUP BY ALL""",
)
def confirmation_faults(spark, sf):
    found = S.confirmation_faults(judged(spark, sf))
    return found.groupBy("unit", "seed", "fault").agg(F.count(F.lit(1)).alias("arms"))


# ---- contexts and held-out seeds over all blocks ------------------------------------
CONTEXT_SQL = f"""{CELLS_SQL},
c AS (SELECT unit, seed, floor(work)::BIGINT AS w FROM cells),
p AS (SELECT *, '{{"odd":' || CASE WHEN w % 23 = 0 THEN 1 ELSE 0 END || ',"unit":' || unit || '}}' AS text FROM c),
f AS (SELECT unit, seed, text, CASE WHEN w % 29 = 0 THEN 'not_one_context' WHEN w % 31 = 0 THEN 'payload_hash_differs'
    WHEN w % 37 = 0 THEN 'manifest_hash_differs' END AS fault FROM p),
g AS (SELECT unit, seed, count(*) AS arms, count(*) FILTER (fault = 'not_one_context') AS not_one_context,
    count(*) FILTER (fault = 'payload_hash_differs') AS payload_hash_differs,
    count(*) FILTER (fault = 'manifest_hash_differs') AS manifest_hash_differs, count(fault) AS faults,
    count(DISTINCT text) AS texts, min(text) AS text FROM f GROUP BY unit, seed),
v AS (SELECT *, CASE WHEN arms < 3 THEN 'arm_missing' WHEN faults > 0 THEN 'arm_fault'
    WHEN texts > 1 THEN 'arms_differ' END AS verdict FROM g)"""


@query(
    "shared_contexts",
    f"""WITH {CONTEXT_SQL}
SELECT unit, seed, arms, not_one_context, payload_hash_differs, manifest_hash_differs, verdict,
  CASE WHEN verdict IS NULL THEN sha256(text) END AS context_sha256, CASE WHEN verdict IS NULL THEN text END AS context
FROM v""",
)
def shared_contexts(spark, sf):
    """Blocks of at least three arms; some log twice, some a text or a manifest of another hash."""
    w = F.floor("work").cast("bigint")
    odd = F.when(w % 23 == 0, 1).otherwise(0).cast("string")
    text = F.concat(F.lit('{"odd":'), odd, F.lit(',"unit":'), F.col("unit").cast("string"), F.lit("}"))
    sha = F.sha2(text, 256)
    record = F.struct(
        sha.alias("context_sha256"),
        F.when(w % 31 == 0, F.concat(text, F.lit(" "))).otherwise(text).alias("decision_context"),
    )
    arms = pairs_cells(spark, sf).select(
        "unit", "seed", "arm",
        F.when(w % 29 == 0, F.array(record, record)).otherwise(F.array(record)).alias("context_records"),
        F.when(w % 37 == 0, F.lit("x")).otherwise(sha).alias("initial_context_sha256"),
    )
    return P.shared_contexts(arms, expected=3)


@query(
    "leave_one_seed_out_all",
    f"""WITH {LOSO_SQL.replace(' SEMI JOIN full_blocks USING (unit, seed)', '')}
SELECT * EXCLUDE (training_saving, held_out_saving), round(training_saving, 9) AS training_saving,
  round(held_out_saving, 9) AS held_out_saving FROM ev""",
)
def leave_one_seed_out_all(spark, sf):
    """Every block, those that lack arms too: an arm is chosen among those that ran."""
    return rounded(P.leave_one_seed_out(choices(spark, sf), ARMS))


# ---- records and their labels ---------------------------------------------------------
@query(
    "record_profile",
    f"""WITH {CELLS_SQL},
r AS (SELECT nodes, CASE WHEN complete THEN 'optimal' ELSE 'timelimit' END AS status FROM cells WHERE arm = 'view')
SELECT grouping(status) = 1 AS whole, status, count(*) AS records, count(nodes) AS sized_records, min(nodes) AS smallest,
  max(nodes) AS largest, round(avg(nodes), 9) AS mean_size FROM r GROUP BY GROUPING SETS ((status), ())""",
)
def record_profile(spark, sf):
    """Sizes and end states of the native runs, a record each."""
    runs = arm_runs(spark, sf).where(F.col("arm") == NATIVE)
    return rounded(Q.record_profile(runs.select("outcome.nodes", "outcome.status"), size="nodes", status="status"))


@query(
    "label_counts",
    f"""WITH {JUDGED_SQL}
SELECT arm, count(*) FILTER (safe) AS safe, count(*) FILTER (valid) AS valid,
  count(*) FILTER (valid AND saving > 0) AS positive_saving FROM judged GROUP BY arm""",
)
def label_counts(spark, sf):
    long = P.pair_metrics(compared(spark, sf), ["arm", "safe", "valid"], ["lp_iterations"])
    return Q.label_counts(long)
