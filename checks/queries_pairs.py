"""Paired experiments over ``events``: comparisons, statistics, selection, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries_ranking import rounded, rounded_list
from checks.views import CELLS_SQL, PAIRED_SQL, pairs_cells, table
from plumbline.functions import exprs as E
from plumbline.operators import bootstrap as B
from plumbline.operators import gates as G
from plumbline.operators import paired_stats as S
from plumbline.operators import pairs as P
from plumbline.operators import precision as N
from plumbline.session import materialize

QUERIES, ORACLES = {}, {}
NATIVE, LIMIT = "view", 200.0
ARMS = ("click", "purchase", "signup", "error")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


FIELDS = ["time", "complete", "nodes", "work", "peak"]


def flat(spark, sf):
    """native_*/treatment_* columns per (unit, seed, arm)."""
    pairs = P.pair_arms(pairs_cells(spark, sf), [*FIELDS, "cluster"], native=NATIVE)
    wide = P.flat_pairs(pairs, FIELDS)
    return wide.withColumn("cluster", F.concat(F.lit("c"), (F.col("unit") % 20).cast("string")))


def costed(spark, sf):
    done = flat(spark, sf).withColumn(
        "safety_failure", F.col("native_complete") & ~F.col("treatment_complete")
    )
    marked = done.withColumn("intervention", F.col("treatment_nodes") > 1).withColumn(
        "policy_fallback", F.col("treatment_nodes") <= 1
    )
    return S.cost_pairs(marked, LIMIT)


UNITS_OF_ARMS_SQL = f"""{PAIRED_SQL},
unit_log AS (
  SELECT arm, unit, count(*) AS pairs, count(*) FILTER (native_complete) AS native_complete_pairs,
         count(*) FILTER (treatment_complete) AS treatment_complete_pairs,
         count(*) FILTER (native_complete AND treatment_complete) AS both_complete_pairs,
         count(*) FILTER (native_complete AND NOT treatment_complete)
           AS native_complete_treatment_incomplete_pairs,
         count(*) FILTER (NOT native_complete AND treatment_complete)
           AS native_incomplete_treatment_complete_pairs,
         count(*) FILTER (NOT native_complete AND NOT treatment_complete) AS both_incomplete_pairs,
         count(*) FILTER (native_complete AND NOT treatment_complete) AS safety_failure_pairs,
         bool_or(native_complete AND NOT treatment_complete) AS safety_failure_unit,
         count(*) FILTER (treatment_nodes > 1) AS intervention_pairs,
         count(*) FILTER (treatment_nodes <= 1) AS policy_fallback_pairs,
         avg(log_ratio) AS mean_log_ratio,
         avg(log_ratio) FILTER (native_complete) AS mean_log_ratio_complete
  FROM costed GROUP BY arm, unit)"""


@query(
    "outcome_classes",
    f"""WITH {PAIRED_SQL}
SELECT arm, CASE WHEN native_complete AND treatment_complete THEN 'both_complete'
    WHEN native_complete THEN 'native_complete_treatment_incomplete'
    WHEN treatment_complete THEN 'native_incomplete_treatment_complete'
    ELSE 'both_incomplete' END AS outcome_class, count(*) AS pairs
FROM paired GROUP BY ALL""",
)
def outcome_classes(spark, sf):
    return costed(spark, sf).groupBy("arm", "outcome_class").agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "unit_records",
    f"""WITH {UNITS_OF_ARMS_SQL}
SELECT * EXCLUDE (mean_log_ratio, mean_log_ratio_complete), round(mean_log_ratio, 9) AS mean_log_ratio,
       round(mean_log_ratio_complete, 9) AS mean_log_ratio_complete FROM unit_log""",
)
def unit_records(spark, sf):
    return rounded(S.unit_records(costed(spark, sf)))


BOUND_SQL = """WITH RECURSIVE bisect AS (
  SELECT k, n, 0 AS step, 0::DOUBLE AS lo, 1::DOUBLE AS hi FROM kn WHERE k > 0 AND k < n
  UNION ALL
  SELECT k, n, step + 1,
    CASE WHEN cdf > ln(0.05::DOUBLE) THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN cdf > ln(0.05::DOUBLE) THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT *, (SELECT ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
            + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2))))
          FROM range(0, k + 1) t(i)) AS cdf FROM bisect WHERE step < 60))"""
BOUND_CASE = """CASE WHEN n = 0 THEN NULL WHEN k = n THEN 1::DOUBLE
  WHEN k = 0 THEN 1 - pow(0.05::DOUBLE, 1::DOUBLE / n)
  ELSE (SELECT (lo + hi) / 2 FROM bisect b WHERE b.step = 60 AND b.k = kn.k AND b.n = kn.n LIMIT 1) END"""


ARM_STATS_SQL = f"""{UNITS_OF_ARMS_SQL},
stats AS (
  SELECT arm, count(*) AS units, sum(pairs)::BIGINT AS pairs,
    sum(native_complete_pairs)::BIGINT AS native_complete_pairs,
    sum(intervention_pairs)::BIGINT AS intervention_pairs,
    sum(policy_fallback_pairs)::BIGINT AS policy_fallback_pairs,
    {', '.join(f'sum({c}_pairs)::BIGINT AS {c}_pairs' for c in S.CLASSES)},
    sum(safety_failure_pairs)::BIGINT AS safety_failure_pairs,
    count(*) FILTER (native_complete_pairs > 0) AS safety_units,
    count(*) FILTER (native_complete_pairs > 0 AND safety_failure_unit) AS safety_failure_units,
    count(*) FILTER (intervention_pairs > 0) AS intervention_units,
    exp(avg(mean_log_ratio)) AS ratio,
    count(*) FILTER (exp(mean_log_ratio) < 1) AS wins,
    count(*) FILTER (abs(exp(mean_log_ratio) - 1) <= 1e-12) AS ties,
    exp(avg(mean_log_ratio_complete)) AS ratio_complete,
    count(mean_log_ratio_complete) AS n_complete,
    count(*) FILTER (exp(mean_log_ratio_complete) < 1) AS wins_complete,
    count(*) FILTER (abs(exp(mean_log_ratio_complete) - 1) <= 1e-12) AS ties_complete
  FROM unit_log GROUP BY arm)"""


@query(
    "par2_geometric_ratio",
    f"""WITH {ARM_STATS_SQL}
SELECT arm, units, pairs, native_complete_pairs, round(ratio, 9) AS ratio,
       round(1 - ratio, 9) AS relative_saving, round(ratio_complete, 9) AS ratio_complete FROM stats""",
)
def par2_geometric_ratio(spark, sf):
    stats = S.arm_statistics(S.unit_records(costed(spark, sf)))
    return rounded(
        stats.select("arm", "units", "pairs", "native_complete_pairs", "ratio", "relative_saving",
                     "ratio_complete")
    )


@query(
    "win_tie_loss",
    f"""WITH {ARM_STATS_SQL}
SELECT arm, wins, ties, units - wins - ties AS losses, wins_complete, ties_complete,
       n_complete - wins_complete - ties_complete AS losses_complete FROM stats""",
)
def win_tie_loss(spark, sf):
    return S.arm_statistics(S.unit_records(costed(spark, sf))).select(
        "arm", "wins", "ties", "losses", "wins_complete", "ties_complete", "losses_complete"
    )


@query(
    "safety_failures",
    f"""WITH RECURSIVE {ARM_STATS_SQL},
kn AS (SELECT arm, safety_failure_units AS k, safety_units AS n FROM stats),
{BOUND_SQL.removeprefix('WITH RECURSIVE ')}
SELECT arm, k AS safety_failure_units, n AS safety_units, round(k / n::DOUBLE, 9) AS failure_rate,
       round({BOUND_CASE}, 9) AS failure_rate_upper FROM kn""",
)
def safety_failures(spark, sf):
    return rounded(
        S.arm_statistics(S.unit_records(costed(spark, sf))).select(
            "arm", "safety_failure_units", "safety_units", "failure_rate", "failure_rate_upper"
        )
    )


@query(
    "clopper_pearson_upper",
    f"""WITH RECURSIVE {CELLS_SQL},
kn AS (SELECT arm, count(*) FILTER (NOT complete) AS k, count(*) AS n FROM cells GROUP BY arm),
{BOUND_SQL.removeprefix('WITH RECURSIVE ')}
SELECT arm, k AS failures, n AS trials, round({BOUND_CASE}, 9) AS upper FROM kn""",
)
def clopper_pearson_upper(spark, sf):
    c = pairs_cells(spark, sf).groupBy("arm").agg(
        F.count_if(~F.col("complete")).alias("failures"), F.count(F.lit(1)).alias("trials")
    )
    return rounded(c.withColumn("upper", E.binomial_upper_bound("failures", "trials")))


METRIC_PAIRS = ("nodes", "work", "peak")


@query(
    "descriptive_metrics",
    f"""WITH {PAIRED_SQL},
long AS (
  {' UNION ALL '.join(f"SELECT arm, unit, '{m}' AS metric, native_{m}::DOUBLE AS n, treatment_{m}::DOUBLE AS t FROM paired" for m in METRIC_PAIRS)}),
u AS (SELECT arm, metric, unit, count(*) AS pairs, avg(n) AS n, avg(t) AS t,
        avg(CASE WHEN n <> 0 THEN (t - n) / abs(n) END) AS change FROM long GROUP BY ALL)
SELECT arm, metric, count(*) AS units, sum(pairs)::BIGINT AS pairs, round(avg(n), 6) AS native_mean,
       round(avg(t), 6) AS treatment_mean, round(avg(t - n), 6) AS mean_delta,
       round(quantile_cont(t - n, 0.5), 6) AS median_delta, round(avg(change), 6) AS mean_relative_change,
       count(*) FILTER (t - n < -1e-12) AS units_lower, count(*) FILTER (abs(t - n) <= 1e-12) AS units_equal,
       count(*) FILTER (t - n > 1e-12) AS units_higher, round(avg(t) / avg(n), 6) AS ratio_of_means
FROM u GROUP BY ALL""",
)
def descriptive_metrics(spark, sf):
    return rounded(S.descriptive_metrics(flat(spark, sf), METRIC_PAIRS), 6)


@query(
    "timing_summary",
    """SELECT event_type, count(value) AS records, round(avg(value), 7) AS mean,
       round(quantile_cont(value, 0.5), 7) AS median, quantile_disc(value, 0.95) AS p95,
       round(sum(value), 4) AS total FROM events GROUP BY event_type""",
)
def timing_summary(spark, sf):
    e = table(spark, sf, "events")
    t = S.timing_summary(e, ["event_type"], "value")
    return rounded(rounded(t, 7, ["mean", "median"]), 4, ["total"])


@query(
    "arm_ratio_matrix",
    f"""WITH {CELLS_SQL},
c AS (SELECT *, CASE WHEN complete THEN greatest(time, 1e-12::DOUBLE) ELSE 400::DOUBLE END AS cost_time,
        CASE WHEN complete THEN greatest(peak, 1e-12::DOUBLE) ELSE 400::DOUBLE END AS cost_peak FROM cells),
l AS (
  SELECT a.unit, a.arm AS numerator, b.arm AS denominator, unnest(['time', 'peak']) AS field,
         unnest([ln(a.cost_time / b.cost_time), ln(a.cost_peak / b.cost_peak)]) AS lr
  FROM c a JOIN c b USING (unit, seed)
  WHERE (a.arm, b.arm) IN (('purchase', 'view'), ('click', 'view'), ('purchase', 'click')))
SELECT field, numerator, denominator, count(*) AS units, round(exp(avg(m)), 9) AS ratio
FROM (SELECT field, numerator, denominator, unit, avg(lr) AS m FROM l GROUP BY ALL) GROUP BY ALL""",
)
def arm_ratio_matrix(spark, sf):
    return rounded(
        S.arm_ratio_matrix(
            pairs_cells(spark, sf), LIMIT,
            [("purchase", "view"), ("click", "view"), ("purchase", "click")], ["time", "peak"],
        )
    )


@query(
    "overhead_decomposition",
    f"""WITH {PAIRED_SQL},
l AS (
  SELECT arm, unit, unnest(['time', 'peak']) AS field, treatment_nodes > 1 AS exposed,
    native_nodes = treatment_nodes AS matched,
    unnest([ln(treatment_cost / native_cost),
      ln((CASE WHEN treatment_complete THEN greatest(treatment_peak, 1e-12::DOUBLE) ELSE 400 END)
       / (CASE WHEN native_complete THEN greatest(native_peak, 1e-12::DOUBLE) ELSE 400 END))]) AS lr
  FROM paired),
u AS (SELECT arm, field, unit, count(*) AS pairs, count(*) FILTER (exposed) AS exposed_pairs,
  count(*) FILTER (matched) AS structural_matches, count(*) FILTER (exposed AND matched) AS exposed_matches,
  avg(lr) AS a, avg(lr) FILTER (exposed) AS e FROM l GROUP BY ALL)
SELECT arm, field, count(*) AS units, sum(pairs)::BIGINT AS pairs, sum(exposed_pairs)::BIGINT AS exposed_pairs,
  sum(structural_matches)::BIGINT AS structural_matches, sum(exposed_matches)::BIGINT AS exposed_matches,
  round(exp(avg(a)), 9) AS ratio, round(exp(avg(e)), 9) AS ratio_exposed FROM u GROUP BY ALL""",
)
def overhead_decomposition(spark, sf):
    marked = flat(spark, sf).select(
        "*", (F.col("treatment_nodes") > 1).alias("exposed"),
        (F.col("native_nodes") == F.col("treatment_nodes")).alias("matched"),
    )
    return rounded(
        S.overhead(marked, LIMIT, times=["time", "peak"], exposed="exposed",
                   structural_match="matched")
    )


# ---- full comparisons ------------------------------------------------------------
def arm_runs(spark, sf):
    """Cells as full run records: settings, outcome and selector log."""
    n = F.col("nodes")
    acts = (n % 2).cast("bigint")
    sha = F.sha2(F.concat_ws("|", "unit", "seed"), 256)
    record = F.struct(F.lit(1).cast("bigint").alias("run_number"), sha.alias("context_sha256"))
    none = F.array().cast("array<struct<run_number:bigint,context_sha256:string>>")
    shadow = F.struct(F.lit(0).cast("bigint").alias("proposed_changed_selected_cuts"))
    return pairs_cells(spark, sf).select(
        "unit", "seed", "arm",
        F.sha2(F.col("unit").cast("string"), 256).alias("unit_sha256"),
        F.create_map(F.lit("release"), F.lit("1")).alias("runtime"),
        F.create_map(
            F.lit("limit"), F.lit("200"), F.lit("mode"),
            F.when(n % 7 == 0, "a").otherwise("b"),
        ).alias("parameters"),
        F.struct(
            F.when(F.col("complete"), "optimal").otherwise("timelimit").alias("status"),
            F.lit("minimize").alias("objective_sense"),
            (n % 3).cast("double").alias("primal_bound"),
            (n % 3).cast("double").alias("dual_bound"),
            F.lit(0.0).alias("gap"),
            n.alias("nodes"), n.alias("total_nodes"),
            F.floor("work").cast("bigint").alias("lp_iterations"),
            (n % 5).alias("lp_count"), (n % 2).alias("cuts_applied"),
            F.col("time").alias("solving_time"),
            (F.col("time") + n / 10).alias("arm_wall_time_seconds"),
            F.col("work").alias("primal_dual_integral"),
        ).alias("outcome"),
        F.struct(
            (n - 1).alias("calls"), acts.alias("interventions"),
            F.lit(1).cast("bigint").alias("run_count"), F.lit("per-run").alias("intervention_scope"),
            F.when(acts > 0, F.array(record)).otherwise(none).alias("intervention_records"),
            F.array(record).alias("context_records"),
            F.lit(1).cast("bigint").alias("shadow_evaluations"),
            F.array(shadow).alias("shadow_records"),
        ).alias("selector"),
    )


def run_pairs(spark, sf):
    return P.pair_arms(
        arm_runs(spark, sf), ["unit_sha256", "runtime", "parameters", "outcome", "selector"],
        native=NATIVE,
    )


POLICY, SHADOW = ("click", "purchase"), ("error",)

COMPARED_SQL = f"""{PAIRED_SQL},
checked AS (
  SELECT *, treatment_nodes % 2 > 0 AS eligible, arm = 'error' AS neutral_shadow,
    (native_nodes % 7 = 0) = (treatment_nodes % 7 = 0) AS same_parameters,
    native_complete = treatment_complete AS same_status,
    native_nodes % 3 = treatment_nodes % 3 AS same_bounds,
    native_nodes = treatment_nodes AS same_nodes,
    floor(native_work) = floor(treatment_work) AS same_work,
    native_nodes % 5 = treatment_nodes % 5 AS same_lp,
    native_nodes % 2 = treatment_nodes % 2 AS same_cuts FROM paired),
safed AS (
  SELECT *, same_parameters AND native_complete AND treatment_complete AND same_status AND same_bounds
      AND (NOT neutral_shadow OR (NOT eligible AND same_nodes AND same_work AND same_lp AND same_cuts))
      AS safe,
    arm IN ('click', 'purchase') AND NOT eligible AS policy_fallback FROM checked),
compared AS (
  SELECT *, neutral_shadow OR eligible OR policy_fallback AS policy_evaluable,
    safe AND (neutral_shadow OR eligible OR policy_fallback) AS valid FROM safed)"""


def compared(spark, sf):
    return P.compare_treatments(run_pairs(spark, sf), policy_arms=POLICY, shadow_arms=SHADOW)


@query(
    "pair_comparison",
    f"""WITH {COMPARED_SQL}
SELECT unit, seed, arm, safe, eligible, neutral_shadow, policy_fallback, policy_evaluable, valid
FROM compared""",
)
def pair_comparison(spark, sf):
    return compared(spark, sf).select(
        "unit", "seed", "arm", "safe", "eligible", "neutral_shadow", "policy_fallback",
        "policy_evaluable", "valid",
    )


@query(
    "arm_summary",
    f"""WITH {COMPARED_SQL},
u AS (SELECT arm, unit, avg(floor(treatment_work) - floor(native_work)) AS d,
        avg(CASE WHEN floor(native_work) <> 0 THEN
          (floor(native_work) - floor(treatment_work)) / floor(native_work) END) AS s
      FROM compared WHERE valid GROUP BY ALL),
us AS (SELECT arm, count(*) AS eligible_units, avg(d) AS mean_primary_delta, avg(s) AS mean_primary_saving,
        count(*) FILTER (d < 0) AS unit_wins, count(*) FILTER (d = 0) AS unit_ties,
        count(*) FILTER (d > 0) AS unit_losses FROM u GROUP BY arm),
c AS (SELECT arm, count(*) AS pairs, count(*) FILTER (safe) AS safe_pairs,
        count(*) FILTER (eligible) AS eligible_pairs, count(*) FILTER (neutral_shadow) AS neutral_shadow_pairs,
        count(*) FILTER (valid) AS valid_pairs, count(*) FILTER (eligible AND NOT safe) AS unsafe_eligible_pairs,
        count(*) FILTER (policy_fallback) AS policy_fallback_pairs,
        count(*) FILTER (policy_evaluable AND NOT safe) AS unsafe_policy_pairs FROM compared GROUP BY arm)
SELECT c.*, safe_pairs = pairs AS safe, coalesce(eligible_units, 0) AS eligible_units,
  round(mean_primary_delta, 6) AS mean_primary_delta, round(mean_primary_saving, 6) AS mean_primary_saving,
  coalesce(unit_wins, 0) AS unit_wins, coalesce(unit_ties, 0) AS unit_ties,
  coalesce(unit_losses, 0) AS unit_losses FROM c LEFT JOIN us USING (arm)""",
)
def arm_summary(spark, sf):
    c = materialize(compared(spark, sf), "compared")  # read by the counts and the metrics
    long = P.pair_metrics(c, ["unit", "seed", "arm", "valid"])
    return rounded(P.arm_summary(c, long), 6)


@query(
    "metric_summary",
    f"""WITH {COMPARED_SQL},
l AS (
  SELECT arm, 'nodes' AS metric, native_nodes::DOUBLE AS n, treatment_nodes::DOUBLE AS t
    FROM compared WHERE valid
  UNION ALL SELECT arm, 'solving_time', native_time, treatment_time FROM compared WHERE valid)
SELECT arm, metric, count(*) AS valid_pairs, round(avg(t - n), 6) AS mean_delta,
  round(avg(CASE WHEN n <> 0 THEN (n - t) / n END), 6) AS mean_saving, count(*) FILTER (t < n) AS wins,
  count(*) FILTER (t = n) AS ties, count(*) FILTER (t > n) AS losses FROM l GROUP BY ALL""",
)
def metric_summary(spark, sf):
    long = P.pair_metrics(
        compared(spark, sf), ["unit", "seed", "arm", "valid"], ["nodes", "solving_time"]
    )
    return rounded(P.metric_summary(long, ["arm"]), 6)


PARITY_SQL = f"""{COMPARED_SQL},
par AS (
  SELECT *, treatment_nodes > 1 AS exercised, same_parameters AND same_status AND treatment_nodes > 1
    AND same_nodes AND same_work AND same_lp AND same_cuts AND same_bounds AS passed FROM checked),
classed AS (
  SELECT *, CASE WHEN passed THEN 'passed' WHEN NOT exercised THEN 'callback_not_exercised'
    WHEN NOT native_complete AND NOT treatment_complete THEN 'both_arms_same_incomplete_limit_status'
    ELSE 'structural_mismatch' END AS class FROM par)"""


@query(
    "parity_comparison",
    f"""WITH {PARITY_SQL}
SELECT unit, seed, arm, passed, class, CASE WHEN native_time > 0 THEN
  round(treatment_time / native_time, 9) END AS time_ratio,
  round(treatment_work - native_work, 6) AS integral_delta FROM classed""",
)
def parity_comparison(spark, sf):
    c = P.compare_structure(run_pairs(spark, sf)).select(
        "unit", "seed", "arm", "passed", "class", "time_ratio", "integral_delta"
    )
    return rounded(rounded(c, 9, ["time_ratio"]), 6, ["integral_delta"])


@query(
    "parity_summary",
    f"""WITH {PARITY_SQL},
u AS (SELECT arm, unit, bool_and(passed) AS unit_passed, count(*) AS pairs,
  count(*) FILTER (passed) AS passed_pairs,
  count(*) FILTER (exercised AND native_complete AND treatment_complete) AS full_pairs,
  count(*) FILTER (exercised AND native_complete AND treatment_complete AND passed) AS full_passed_pairs,
  count(*) FILTER (class = 'callback_not_exercised') AS callback_not_exercised,
  count(*) FILTER (class = 'both_arms_same_incomplete_limit_status') AS both_arms_same_incomplete_limit_status,
  count(*) FILTER (class = 'structural_mismatch') AS structural_mismatch FROM classed GROUP BY ALL)
SELECT arm, count(*) FILTER (unit_passed) AS passed_units, sum(pairs)::BIGINT AS pairs,
  sum(passed_pairs)::BIGINT AS passed_pairs, sum(full_pairs)::BIGINT AS full_pairs,
  sum(full_passed_pairs)::BIGINT AS full_passed_pairs,
  sum(callback_not_exercised)::BIGINT AS callback_not_exercised,
  sum(both_arms_same_incomplete_limit_status)::BIGINT AS both_arms_same_incomplete_limit_status,
  sum(structural_mismatch)::BIGINT AS structural_mismatch FROM u GROUP BY arm""",
)
def parity_summary(spark, sf):
    return P.parity_summary(P.compare_structure(run_pairs(spark, sf)))


@query(
    "parity_exceptions",
    f"""WITH {PARITY_SQL}
SELECT unit, seed, arm, class, array_to_string(list_sort(list_filter([
  CASE WHEN NOT same_parameters THEN 'same_parameters' END,
  CASE WHEN NOT same_status THEN 'same_status' END,
  CASE WHEN NOT exercised THEN 'callback_exercised' END,
  CASE WHEN NOT same_nodes THEN 'same_nodes' END, CASE WHEN NOT same_nodes THEN 'same_total_nodes' END,
  CASE WHEN NOT same_work THEN 'same_lp_iterations' END, CASE WHEN NOT same_lp THEN 'same_lp_count' END,
  CASE WHEN NOT same_cuts THEN 'same_cuts_applied' END, CASE WHEN NOT same_bounds THEN 'same_primal_bound' END,
  CASE WHEN NOT same_bounds THEN 'same_dual_bound' END], lambda x: x IS NOT NULL)), ';') AS failed
FROM classed WHERE NOT passed""",
)
def parity_exceptions(spark, sf):
    return P.parity_exceptions(P.compare_structure(run_pairs(spark, sf)))


@query(
    "failed_check_counts",
    f"""WITH {COMPARED_SQL},
f AS (
  SELECT arm, unnest(['same_parameters', 'native_complete', 'treatment_complete', 'same_status',
     'same_primal_bound', 'same_dual_bound']) AS "check",
   unnest([same_parameters, native_complete, treatment_complete, same_status, same_bounds, same_bounds])
     AS ok FROM compared
  UNION ALL
  SELECT arm, unnest(['shadow_has_no_interventions', 'shadow_same_nodes', 'shadow_same_total_nodes',
     'shadow_same_lp_iterations', 'shadow_same_lp_count', 'shadow_same_cuts_applied',
     'shadow_same_primal_bound', 'shadow_same_dual_bound']),
   unnest([NOT eligible, same_nodes, same_nodes, same_work, same_lp, same_cuts, same_bounds, same_bounds])
  FROM compared WHERE neutral_shadow)
SELECT arm, "check", count(*) AS failed_pairs FROM f WHERE NOT ok GROUP BY ALL""",
)
def failed_check_counts(spark, sf):
    return P.failed_check_counts(compared(spark, sf))


@query(
    "context_agreement",
    f"""WITH {CELLS_SQL},
x AS (SELECT unit, seed, CASE WHEN nodes > 1 THEN nodes % 2 END AS ctx FROM cells)
SELECT unit, seed, count(ctx) AS observed_arms, count(ctx) = 5 AS all_arms_observed,
  count(ctx) = 0 AS no_arm_observed, count(ctx) = 5 AND count(DISTINCT ctx) = 1 AS matching_across_arms
FROM x GROUP BY ALL""",
)
def context_agreement(spark, sf):
    n = F.col("nodes")
    logged = pairs_cells(spark, sf).withColumn(
        "context_sha256", F.when(n > 1, F.sha2((n % 2).cast("string"), 256))
    )
    return P.context_agreement(logged, expected=5)


@query(
    "status_counts",
    f"""WITH {CELLS_SQL}
SELECT arm, CASE WHEN complete THEN 'optimal' ELSE 'timelimit' END AS status, count(*) AS runs
FROM cells GROUP BY ALL""",
)
def status_counts(spark, sf):
    return P.status_counts(arm_runs(spark, sf).select("arm", "outcome.status"))


@query(
    "completion_discordance",
    f"""WITH {PAIRED_SQL}
SELECT unit, seed, arm, CASE WHEN native_complete THEN 'native_complete_treatment_incomplete'
  WHEN treatment_complete THEN 'treatment_complete_native_incomplete'
  ELSE 'both_incomplete_same_status' END AS kind
FROM paired WHERE NOT (native_complete AND treatment_complete)""",
)
def completion_discordance(spark, sf):
    f = run_pairs(spark, sf).select(
        "unit", "seed", "arm",
        F.col("native.outcome.status").alias("native_status"),
        F.col("treatment.outcome.status").alias("treatment_status"),
    ).select(
        "*", E.is_complete("native_status").alias("native_complete"),
        E.is_complete("treatment_status").alias("treatment_complete"),
    )
    return P.discordance(f).select("unit", "seed", "arm", "kind")


@query(
    "objective_mismatch",
    f"""WITH {PAIRED_SQL},
ref AS (SELECT c_custkey AS unit, c_acctbal / 1000 AS reference_objective FROM customer
        WHERE c_custkey % 3 <> 0)
SELECT unit, seed, arm, native_nodes % 3 AS native_objective, treatment_nodes % 3 AS treatment_objective,
  CASE WHEN reference_objective IS NULL THEN NULL
    WHEN abs(treatment_nodes % 3 - reference_objective) < abs(native_nodes % 3 - reference_objective) THEN 'treatment'
    WHEN abs(native_nodes % 3 - reference_objective) < abs(treatment_nodes % 3 - reference_objective) THEN 'native'
    ELSE 'tie' END AS closer
FROM paired LEFT JOIN ref USING (unit)
WHERE native_complete AND treatment_complete AND native_nodes % 3 <> treatment_nodes % 3""",
)
def objective_mismatch(spark, sf):
    o = [("status", "status"), ("primal_bound", "primal_bound"), ("dual_bound", "dual_bound")]
    f = run_pairs(spark, sf).select(
        "unit", "seed", "arm",
        *[F.col(f"{s}.outcome.{c}").alias(f"{s}_{n}") for s in ("native", "treatment")
          for c, n in o],
    )
    f = f.select(
        "*", E.is_complete("native_status").alias("native_complete"),
        E.is_complete("treatment_status").alias("treatment_complete"),
    )
    known = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("unit"), (F.col("c_acctbal") / 1000).alias("reference_objective")
    )
    return P.objective_mismatch(f, known).select(
        "unit", "seed", "arm",
        F.col("native_primal_bound").cast("bigint").alias("native_objective"),
        F.col("treatment_primal_bound").cast("bigint").alias("treatment_objective"), "closer",
    )


# ---- arm selection --------------------------------------------------------------
CHOICE_SQL = f"""{COMPARED_SQL},
scored AS (SELECT *, floor(native_work) AS native_value, floor(treatment_work) AS treatment_value,
  floor(treatment_work) - floor(native_work) AS delta,
  CASE WHEN floor(native_work) <> 0 THEN (floor(native_work) - floor(treatment_work)) / floor(native_work)
    END AS saving,
  CASE arm WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS place
  FROM compared)"""


def choices(spark, sf):
    c = compared(spark, sf).withColumn("native_complete", E.is_complete("native.outcome.status"))
    long = P.pair_metrics(
        c, ["unit", "seed", "arm", "safe", "eligible", "valid", "native_complete"],
        ["lp_iterations"],
    )
    return long


ORACLE_SQL = f"""{CHOICE_SQL},
opts AS (
  SELECT unit, seed, native_value, 'native' AS arm, native_value AS value, 0 AS place FROM scored
  UNION ALL
  SELECT unit, seed, native_value, arm, treatment_value, place FROM scored WHERE valid),
best AS (SELECT DISTINCT ON (unit, seed) * FROM opts ORDER BY unit, seed, value, place),
chosen AS (
SELECT b.unit, b.seed, b.arm AS selected_arm, b.native_value, b.value AS selected_value,
  b.value - b.native_value AS delta,
  CASE WHEN b.native_value <> 0 THEN (b.native_value - b.value) / b.native_value END AS saving,
  v.valid_arms
FROM best b JOIN (SELECT unit, seed, count(*) FILTER (valid) AS valid_arms FROM scored GROUP BY ALL) v
  USING (unit, seed))"""


@query(
    "oracle_arm",
    f"""WITH {ORACLE_SQL}
SELECT * EXCLUDE (saving), round(saving, 9) AS saving FROM chosen""",
)
def oracle_arm(spark, sf):
    return rounded(P.oracle_arm(choices(spark, sf), ARMS))


@query(
    "oracle_summary",
    f"""WITH {ORACLE_SQL},
u AS (SELECT unit, avg(delta) AS d, avg(saving) AS s, count(*) FILTER (delta < 0) AS w,
  count(*) FILTER (delta = 0) AS t FROM chosen GROUP BY unit)
SELECT count(*) AS units, round(avg(d), 6) AS mean_delta, round(avg(s), 9) AS mean_saving,
  sum(w)::BIGINT AS wins, sum(t)::BIGINT AS ties FROM u""",
)
def oracle_summary(spark, sf):
    o = P.oracle_summary(P.oracle_arm(choices(spark, sf), ARMS))
    return rounded(rounded(o, 6, ["mean_delta"]))


LOSO_SQL = f"""{CHOICE_SQL},
full_blocks AS (SELECT unit, seed FROM scored GROUP BY ALL HAVING count(DISTINCT arm) = 4),
b AS (SELECT *, CASE WHEN safe THEN CASE WHEN eligible THEN saving ELSE 0 END END AS own
      FROM scored SEMI JOIN full_blocks USING (unit, seed)),
t AS (
  SELECT h.unit, h.seed, h.arm, avg(o.own) AS train
  FROM b h JOIN b o ON h.unit = o.unit AND h.arm = o.arm AND h.seed <> o.seed
  GROUP BY ALL HAVING count(o.own) = count(*)),
pick AS (SELECT DISTINCT ON (unit, seed) t.unit, t.seed, t.arm, t.train FROM t
   JOIN b USING (unit, seed, arm) WHERE train > 1e-15 ORDER BY unit, seed, train DESC, place),
ev AS (
  SELECT s.unit, s.seed, coalesce(p.arm, 'native') AS selected_arm, coalesce(p.train, 0) AS training_saving,
    CASE WHEN p.arm IS NULL THEN 'native' WHEN h.safe AND NOT h.eligible THEN 'native-ineligible-fallback'
      ELSE p.arm END AS effective_arm,
    CASE WHEN p.arm IS NULL THEN s.native_ok ELSE h.safe END AS held_out_safe,
    p.arm IS NOT NULL AND h.eligible AS held_out_eligible,
    CASE WHEN p.arm IS NULL THEN CASE WHEN s.native_ok THEN 0::DOUBLE END
      WHEN h.safe AND NOT h.eligible THEN 0::DOUBLE WHEN h.valid THEN h.delta END AS held_out_delta,
    CASE WHEN p.arm IS NULL THEN CASE WHEN s.native_ok THEN 0::DOUBLE END
      WHEN h.safe AND NOT h.eligible THEN 0::DOUBLE WHEN h.valid THEN h.saving END AS held_out_saving
  FROM (SELECT unit, seed, bool_and(native_complete) AS native_ok FROM b GROUP BY ALL) s
  LEFT JOIN pick p USING (unit, seed) LEFT JOIN b h ON h.unit = p.unit AND h.seed = p.seed AND h.arm = p.arm)"""


def held_out(spark, sf):
    return P.leave_one_seed_out(P.complete_blocks(choices(spark, sf), 4), ARMS)


@query(
    "leave_one_seed_out",
    f"""WITH {LOSO_SQL}
SELECT * EXCLUDE (training_saving, held_out_saving), round(training_saving, 9) AS training_saving,
  round(held_out_saving, 9) AS held_out_saving FROM ev""",
)
def leave_one_seed_out(spark, sf):
    return rounded(held_out(spark, sf))


@query(
    "leave_one_seed_out_summary",
    f"""WITH {LOSO_SQL}
SELECT unit, bool_and(held_out_safe) AS safe, count(held_out_saving) AS evaluable_seeds,
  count(*) FILTER (NOT held_out_safe) AS unsafe_seeds, round(avg(held_out_saving), 9) AS mean_saving,
  count(*) FILTER (held_out_saving > 0) AS wins, count(*) FILTER (held_out_saving = 0) AS ties,
  count(*) FILTER (held_out_saving < 0) AS losses FROM ev GROUP BY unit""",
)
def leave_one_seed_out_summary(spark, sf):
    return rounded(P.leave_one_seed_out_summary(held_out(spark, sf)))


# ---- bootstrap -------------------------------------------------------------------
REPLICATES, SEED = 400, 20260720


def mixed(inner: str, source: str, out: str, keep: str) -> str:
    """SQL of the 32-bit scramble as two nested selects."""
    step = "(xor({0}, {0} >> 16) * 73244475) % 4294967296"
    return (
        f"SELECT {keep}, xor(h2, h2 >> 16) AS {out} FROM (SELECT {keep}, {step.format('h1')} AS h2 "
        f"FROM (SELECT {keep}, {step.format('h0')} AS h1 FROM (SELECT {keep}, {inner} AS h0 "
        f"FROM {source})))"
    )


def draw_sql(items: str, key: str, seed: str) -> str:
    """CTEs from ``items`` (key, item, num, den) to ``boot`` (key, replicate, estimate)."""
    return f"""placed AS (
  SELECT {key}, num, den, row_number() OVER (PARTITION BY {key} ORDER BY item) - 1 AS draw FROM {items}),
sizes AS (SELECT {key}, count(*) AS n, any_value(({seed})::BIGINT) AS seed FROM {items} GROUP BY {key}),
base AS ({mixed('seed % 4294967296', 'sizes', 'base', f'{key}, n')}),
reps AS (SELECT {key}, n, base, r AS replicate FROM base, range({REPLICATES}) t(r)),
states AS ({mixed('(base + replicate) % 4294967296', 'reps', 'state', f'{key}, n, replicate')}),
slots AS (SELECT {key}, n, replicate, state, unnest(range(n)) AS slot FROM states),
draws AS ({mixed('(state + slot) % 4294967296', 'slots', 'word', f'{key}, n, replicate')}),
boot AS (
  SELECT d.{key}, d.replicate, sum(num) / sum(den) AS estimate
  FROM draws d JOIN placed p ON p.{key} = d.{key} AND p.draw = d.word % d.n GROUP BY ALL)"""


NAME_SEED = "({0} + ('0x' || substr(sha256(arm), 1, 8))::BIGINT) % 4294967296"


@query(
    "arm_bootstrap_seed",
    f"""SELECT DISTINCT event_type AS arm,
  {NAME_SEED.format(SEED).replace('arm', 'event_type')} AS bootstrap_seed FROM events""",
)
def arm_bootstrap_seed(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("arm")).distinct()
    return e.select("arm", B.action_seed(SEED, "arm").alias("bootstrap_seed"))


def unit_logs(spark, sf):
    return S.unit_records(costed(spark, sf)).select("arm", "unit", "mean_log_ratio")


def boot(spark, sf):
    return B.replicates(
        unit_logs(spark, sf), keys=["arm"], item="unit", numerator="mean_log_ratio",
        count=REPLICATES, seed=B.action_seed(SEED, "arm"),
    )


BOOT_SQL = f"""{UNITS_OF_ARMS_SQL},
items AS (SELECT arm, unit AS item, mean_log_ratio AS num, 1::DOUBLE AS den FROM unit_log),
{draw_sql('items', 'arm', NAME_SEED.format(SEED))}"""


@query(
    "cluster_bootstrap_ci",
    f"""WITH {BOOT_SQL}
SELECT arm, count(*) AS replicates, round(quantile_cont(exp(estimate), 0.025), 9) AS lower,
       round(quantile_cont(exp(estimate), 0.975), 9) AS upper FROM boot GROUP BY arm""",
)
def cluster_bootstrap_ci(spark, sf):
    return rounded(B.interval(boot(spark, sf), keys=["arm"], geometric=True))


@query(
    "one_sided_upper",
    f"""WITH {BOOT_SQL}
SELECT arm, round(quantile_cont(exp(estimate), 0.8), 9) AS upper_one_sided FROM boot GROUP BY arm""",
)
def one_sided_upper(spark, sf):
    return rounded(B.upper_percentile(boot(spark, sf), keys=["arm"], confidence=0.8))


@query(
    "two_level_bootstrap_ci",
    f"""WITH {UNITS_OF_ARMS_SQL},
items AS (SELECT arm, 'c' || (unit % 20) AS item, sum(mean_log_ratio) AS num, count(*)::DOUBLE AS den
          FROM unit_log GROUP BY ALL),
{draw_sql('items', 'arm', str(SEED))}
SELECT arm, round(quantile_cont(estimate, 0.025), 9) AS ci95_lower,
  round(quantile_cont(estimate, 0.975), 9) AS ci95_upper,
  round(avg((estimate > 0)::INT), 9) AS probability_positive FROM boot GROUP BY arm""",
)
def two_level_bootstrap_ci(spark, sf):
    logs = unit_logs(spark, sf).withColumn(
        "cluster", F.concat(F.lit("c"), (F.col("unit") % 20).cast("string"))
    )
    sums = B.cluster_sums(logs, keys=["arm"], cluster="cluster", value="mean_log_ratio")
    drawn = B.replicates(
        sums, keys=["arm"], item="cluster", numerator="value_sum", denominator="value_count",
        count=REPLICATES, seed=SEED,
    )
    return rounded(B.delta_interval(drawn, keys=["arm"]))


@query(
    "multinomial_bootstrap",
    f"""WITH {UNITS_OF_ARMS_SQL}
SELECT arm, {REPLICATES}::BIGINT AS replicates, count(*)::BIGINT AS fewest_draws, count(*)::BIGINT AS most_draws,
  round(avg(mean_log_ratio), 9) AS mean_log_ratio, true AS centred, true AS spread, true AS mean_inside
FROM unit_log GROUP BY arm""",
)
def multinomial_bootstrap(spark, sf):
    """Centre and spread of the estimates lie within five of their standard errors."""
    logs = unit_logs(spark, sf)
    drawn = B.multinomial_replicates(
        logs, keys=["arm"], item="unit", numerator="mean_log_ratio",
        count=REPLICATES, seed=B.action_seed(SEED, "arm"), block_items=256,
    )
    point = logs.groupBy("arm").agg(
        F.avg("mean_log_ratio").alias("mean"),
        (F.stddev_pop("mean_log_ratio") / F.sqrt(F.count(F.lit(1)))).alias("error"),
    )
    seen = drawn.groupBy("arm").agg(
        F.count(F.lit(1)).alias("replicates"), F.min("drawn").alias("fewest_draws"),
        F.max("drawn").alias("most_draws"), F.avg("estimate").alias("middle"),
        F.stddev_pop("estimate").alias("width"),
    )
    ci = B.interval(drawn, keys=["arm"]).drop("replicates")
    near = 5 / F.sqrt(F.col("replicates"))
    return seen.join(point, "arm").join(ci, "arm").select(
        "arm", "replicates", "fewest_draws", "most_draws", F.round("mean", 9).alias("mean_log_ratio"),
        (F.abs(F.col("middle") - F.col("mean")) < near * F.col("error")).alias("centred"),
        (F.abs(F.col("width") / F.col("error") - 1) < near).alias("spread"),
        F.col("mean").between(F.col("lower"), F.col("upper")).alias("mean_inside"),
    )


@query(
    "shadow_structure",
    f"""WITH {COMPARED_SQL},
shadow AS (SELECT *, same_parameters AND same_status AND same_bounds AND (NOT neutral_shadow
    OR (NOT eligible AND same_nodes AND same_work AND same_lp AND same_cuts)) AS matched,
  treatment_nodes % 3 > 0 AS exposed,
  CASE WHEN treatment_nodes % 3 >= 1 AND treatment_nodes % 5 = 0 THEN 1
    WHEN treatment_nodes % 3 = 2 AND (treatment_nodes + 1) % 5 = 0 THEN 2 END AS place FROM checked),
units AS (SELECT arm, unit, avg(ln(treatment_cost / native_cost)) AS a,
  avg(ln(treatment_cost / native_cost)) FILTER (exposed) AS e FROM shadow GROUP BY ALL),
ratios AS (SELECT arm, round(exp(avg(a)), 9) AS ratio, round(exp(avg(e)), 9) AS ratio_exposed FROM units GROUP BY arm)
SELECT arm, count(*) AS pairs, count(*) FILTER (native_complete AND treatment_complete) AS both_complete,
  count(*) FILTER (native_complete AND NOT treatment_complete) AS native_complete_shadow_incomplete,
  count(*) FILTER (NOT native_complete AND treatment_complete) AS native_incomplete_shadow_complete,
  count(*) FILTER (NOT native_complete AND NOT treatment_complete) AS both_incomplete,
  count(*) FILTER (matched) AS structural_matches, count(*) FILTER (exposed) AS exposed_pairs,
  count(*) FILTER (exposed AND matched) AS exposed_matches, count(place) AS proposed_changes,
  sum(place)::BIGINT AS first_change_places, any_value(ratio) AS ratio, any_value(ratio_exposed) AS ratio_exposed
FROM shadow JOIN ratios USING (arm) GROUP BY arm""",
)
def shadow_structure(spark, sf):
    """Match, exposure and proposed changes from the arms' records, with the ratios over them."""
    n = F.col("outcome.nodes")
    records = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (n % 3).cast("int")),
        lambda i: F.struct(
            F.when((n + i) % 5 == 0, 2).otherwise(0).cast("bigint").alias("proposed_changed_selected_cuts")
        ),
    )
    runs = arm_runs(spark, sf).withColumn(
        "selector",
        F.col("selector").withField("shadow_evaluations", n % 3).withField("shadow_records", records),
    )
    pairs = P.pair_arms(
        runs, ["unit_sha256", "runtime", "parameters", "outcome", "selector"], native=NATIVE
    )
    done = P.compare_treatments(pairs, policy_arms=POLICY, shadow_arms=SHADOW)
    shadows = P.shadow_pairs(done, ["solving_time"])
    ratios = S.overhead(
        shadows, LIMIT, times=["solving_time"], exposed="exposed", structural_match="structural_match"
    ).select("arm", "ratio", "ratio_exposed")
    return rounded(P.shadow_counts(shadows).join(ratios, "arm"))


@query(
    "gate_report",
    f"""WITH {ARM_STATS_SQL}, {BOOT_SQL.split(UNITS_OF_ARMS_SQL + ',')[1]},
ci AS (SELECT arm, quantile_cont(exp(estimate), 0.975) AS upper FROM boot GROUP BY arm)
SELECT arm, unnest(['zero_unit_safety_failures', 'cost_ci95_upper_below_one',
   'more_unit_wins_than_losses']) AS "check",
  unnest([safety_failure_units = 0, upper < 1, wins > units - wins - ties]) AS passed
FROM stats JOIN ci USING (arm)""",
)
def gate_report(spark, sf):
    units = S.unit_records(costed(spark, sf))
    ci = B.interval(boot(spark, sf), keys=["arm"], geometric=True)
    return S.statistics_gate(S.arm_statistics(units), ci)


@query(
    "gate_verdict",
    f"""WITH {ARM_STATS_SQL},
c AS (SELECT arm, unnest([safety_failure_units = 0, ratio < 1, wins > units - wins - ties]) AS p FROM stats)
SELECT arm, bool_and(p) AS passed, count(*) AS checks, count(*) FILTER (NOT p) AS failed_checks
FROM c GROUP BY arm""",
)
def gate_verdict(spark, sf):
    stats = S.arm_statistics(S.unit_records(costed(spark, sf)))
    checks = G.keyed_check_rows(
        stats, ["arm"],
        {
            "no_failures": F.col("safety_failure_units") == 0,
            "ratio_below_one": F.col("ratio") < 1,
            "more_wins": F.col("wins") > F.col("losses"),
        },
    )
    return G.gate(checks, ["arm"])


@query(
    "pilot_gate_choice",
    f"""WITH {ARM_STATS_SQL}
SELECT arg_min(CASE WHEN ok THEN arm END, CASE WHEN ok THEN (ratio, place) END) AS selected_arm,
  count(*) FILTER (ok) AS passing_arms, count(*) AS arms
FROM (SELECT *, intervention_units >= 5 AND ratio < 2 AS ok,
  CASE arm WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS place FROM stats)""",
)
def pilot_gate_choice(spark, sf):
    stats = S.arm_statistics(S.unit_records(costed(spark, sf)))
    checks = G.keyed_check_rows(
        stats, ["arm", "ratio"],
        {"exposed": F.col("intervention_units") >= 5, "bounded": F.col("ratio") < 2},
    )
    return S.best_passing_arm(checks, ["signup", "purchase", "click", "error"])


@query(
    "confirmation_units",
    f"""WITH {CHOICE_SQL}
SELECT unit, count(*) AS planned_pairs, count(*) FILTER (native_complete) AS attributable_pairs,
  count(*) FILTER (NOT native_complete) AS native_incomplete_pairs,
  count(*) FILTER (native_complete AND eligible) AS eligible_attributable_pairs,
  count(*) FILTER (native_complete AND eligible AND NOT treatment_complete) AS unsafe_pairs,
  count(saving) FILTER (native_complete AND eligible AND treatment_complete) AS valid_pairs,
  round(coalesce(avg(saving) FILTER (native_complete AND eligible AND treatment_complete), 0), 9) AS mean_saving,
  CASE WHEN coalesce(avg(saving) FILTER (native_complete AND eligible AND treatment_complete), 0) > 0 THEN 'win'
    WHEN coalesce(avg(saving) FILTER (native_complete AND eligible AND treatment_complete), 0) < 0 THEN 'loss'
    ELSE 'tie' END AS outcome
FROM scored WHERE arm = 'purchase' GROUP BY unit""",
)
def confirmation_units(spark, sf):
    rows = choices(spark, sf).where("arm = 'purchase'").select("unit", "seed", "native_complete",
                                                             "eligible", "saving")
    done = flat(spark, sf).where("arm = 'purchase'").select("unit", "seed", "treatment_complete")
    judged = rows.join(done, ["unit", "seed"]).withColumn("valid", F.lit(True))
    return rounded(S.confirmation(judged).drop("invalid_pairs"))


# ---- planning ---------------------------------------------------------------------
CRIT = N.critical_value()


@query(
    "log_ratio_spread",
    f"""WITH {UNITS_OF_ARMS_SQL}
SELECT arm, count(*) AS units, round(stddev_samp(mean_log_ratio), 9) AS sigma FROM unit_log GROUP BY arm""",
)
def log_ratio_spread(spark, sf):
    return rounded(N.log_ratio_spread(S.unit_records(costed(spark, sf))))


@query(
    "sample_size_plan",
    f"""WITH {UNITS_OF_ARMS_SQL},
s AS (SELECT max(sd) AS sigma FROM (SELECT arm, stddev_samp(mean_log_ratio) AS sd FROM unit_log GROUP BY arm)),
a AS (SELECT count(*) AS units, count(DISTINCT unit % 20) AS clusters FROM
  (SELECT DISTINCT user_id AS unit FROM events)),
j AS (SELECT * FROM s, a)
SELECT 'planning_sigma' AS quantity, 'widest arm' AS scenario, round(sigma, 9) AS value FROM j
UNION ALL SELECT 'superiority_units', printf('%.2f', e),
  ceil(pow({CRIT}::DOUBLE * sigma / (0 - ln(1 - e)), 2)) FROM j, (SELECT unnest([0.05::DOUBLE, 0.1, 0.15]) AS e)
UNION ALL SELECT 'noninferiority_units', '1.05', ceil(pow({CRIT}::DOUBLE * sigma / ln(1.05::DOUBLE), 2)) FROM j
UNION ALL SELECT 'zero_failure_units', printf('%.3f', c), ceil(ln(0.05::DOUBLE) / ln(1 - c))
  FROM (SELECT unnest([0.025::DOUBLE, 0.05, 0.1]) AS c)
UNION ALL SELECT 'zero_failure_upper', printf('%.3f', c),
  round(1 - pow(0.05::DOUBLE, 1 / ceil(ln(0.05::DOUBLE) / ln(1 - c))), 9)
  FROM (SELECT unnest([0.025::DOUBLE, 0.05, 0.1]) AS c)
UNION ALL SELECT 'available_upper', k, round(1 - pow(0.05::DOUBLE, 1::DOUBLE / n), 9)
  FROM (SELECT unnest(['units', 'clusters']) AS k, unnest([units, clusters]) AS n FROM j)
UNION ALL SELECT 'available_detectable_ratio', k, round(exp(-{CRIT}::DOUBLE * sigma / sqrt(n)), 9)
  FROM (SELECT sigma, unnest(['units', 'clusters']) AS k, unnest([units, clusters]) AS n FROM j)""",
)
def sample_size_plan(spark, sf):
    spread = N.log_ratio_spread(S.unit_records(costed(spark, sf)))
    users = table(spark, sf, "events").select(F.col("user_id").alias("unit")).distinct()
    support = N.cluster_support(
        users.withColumn("cluster", F.col("unit") % 20).withColumn("split", F.lit("test"))
    )
    return rounded(N.precision_plan(spread, support))
