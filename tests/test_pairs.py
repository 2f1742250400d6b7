"""Paired statistics, comparisons, arm choice and gates on small literals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import bootstrap as B
from plumbline.operators import paired_stats as S
from plumbline.operators import pairs as P
from plumbline.operators import precision as N
from plumbline.plans import experiments as X

PAIR = (
    "unit string, seed bigint, arm string, native_status string, treatment_status string, "
    "native_objective_sense string, treatment_objective_sense string, native_primal_bound double, "
    "treatment_primal_bound double, native_dual_bound double, treatment_dual_bound double, "
    "native_solving_time double, treatment_solving_time double, intervention boolean, "
    "policy_fallback boolean"
)


def pair(unit, native, treatment, ns="optimal", ts="optimal", seed=1, bound=1.0):
    return (unit, seed, "a", ns, ts, "min", "min", 1.0, bound, 1.0, bound, float(native),
            float(treatment), True, False)


def stats(spark, data, limit=100.0):
    df = spark.createDataFrame(data, PAIR)
    return X.paired_statistics(df, limit, replicates=50)


def test_geometric_ratio_and_wins(spark):
    s = stats(spark, [pair("x", 10, 8), pair("y", 10, 9), pair("z", 10, 11)])
    r = s.arms.first()
    assert r["ratio"] == pytest.approx((0.8 * 0.9 * 1.1) ** (1 / 3))
    assert (r["wins"], r["ties"], r["losses"], r["safety_failure_units"]) == (2, 0, 1, 0)
    ci = s.intervals.first()
    assert 0 < ci["lower"] < r["ratio"] < ci["upper"]
    assert not [c for c in s.checks.collect() if c["check"] == "zero_unit_safety_failures"
                and not c["passed"]]


def test_timeout_is_penalised_and_unsafe(spark):
    r = stats(spark, [pair("x", 50, 100, ts="timelimit")]).arms.first()
    assert r["ratio"] == pytest.approx(4.0)
    assert (r["safety_failure_pairs"], r["failure_rate"], r["failure_rate_upper"]) == (1, 1.0, 1.0)


def test_native_timeouts_stay_in_the_main_analysis(spark):
    data = [
        pair("x", 100, 50, ns="timelimit"),
        pair("x", 100, 100, ns="timelimit", ts="timelimit", seed=2),
        pair("y", 10, 20),
    ]
    r = stats(spark, data).arms.first()
    assert (r["units"], r["pairs"], r["native_complete_pairs"]) == (2, 3, 1)
    assert r["ratio"] == pytest.approx(math.exp((math.log(0.25) / 2 + math.log(2)) / 2))
    assert r["ratio_complete"] == pytest.approx(2.0)
    assert (r["native_incomplete_treatment_complete_pairs"], r["both_incomplete_pairs"]) == (1, 1)


def test_different_bound_is_a_safety_failure(spark):
    r = stats(spark, [pair("x", 10, 8, bound=2.0)]).arms.first()
    assert r["safety_failure_units"] == 1


def test_a_ratio_just_below_one_is_win_and_tie(spark):
    units = spark.createDataFrame([("a", "u", 1, math.log(1 - 1e-13))], "arm string, unit string, n int, l double")
    w, t, lo = (units.agg(c).first()[0] for c in S._contest("l", F.lit(True))[1:])
    assert (w, t, lo) == (1, 1, -1)


def test_bootstrap_repeats_and_ignores_partitioning(spark):
    data = [("a", f"u{i}", math.log(v)) for i, v in enumerate((0.8, 1.0, 1.2))]
    df = spark.createDataFrame(data, "arm string, unit string, v double")

    def run(frame):
        d = B.replicates(frame, keys=["arm"], item="unit", numerator="v", count=200, seed=7)
        return B.interval(d, keys=["arm"], geometric=True).first()

    one, two = run(df), run(df.repartition(3, "v"))
    assert one["lower"] == pytest.approx(two["lower"]) and one["upper"] == pytest.approx(two["upper"])
    assert 0 < one["lower"] < one["upper"]


def test_bootstrap_matches_plain_arithmetic_when_shuffled(spark, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_ITEMS", 0)
    monkeypatch.setattr(B, "SLOT_CHUNK", 4)

    def mix(h):
        for _ in range(2):
            h = ((h ^ (h >> 16)) * 73_244_475) % 2**32
        return h ^ (h >> 16)

    values = [float(i * i) for i in range(11)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "unit bigint, v double")
    got = B.replicates(df, keys=[], item="unit", numerator="v", count=5, seed=3).collect()
    base = mix(3)
    for r in got:
        state = mix((base + r["replicate"]) % 2**32)
        picks = [values[mix((state + s) % 2**32) % 11] for s in range(11)]
        assert r["estimate"] == pytest.approx(sum(picks) / 11)
    assert len(got) == 5


def test_bootstrap_of_many_items_never_broadcasts_its_draws(spark, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_ITEMS", 0)
    df = spark.createDataFrame([("a", i, 1.0) for i in range(50)], "arm string, unit bigint, v double")
    got = B.replicates(df, keys=["arm"], item="unit", numerator="v", count=4, seed=3)
    assert {r["estimate"] for r in got.collect()} == {1.0}
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "_draw" in x]
    assert joins and not any("Broadcast" in x for x in joins)


def test_shadow_pairs_read_records_and_pass_over_missing_ones(spark):
    checks = {"native_complete": False, "treatment_complete": True, "same_bounds": True}
    out = ("timelimit", 2.0)
    data = [
        (i, 1, "s", checks | {"same_nodes": match}, (out,), (("optimal", 1.0), (evals, records)))
        for i, (match, evals, records) in enumerate([
            (True, 2, [(0,), (3,), (1,)]), (False, 1, [(None,)]), (True, 0, []), (True, None, None),
        ])
    ]
    outcome = "outcome: struct<status: string, solving_time: double>"
    selector = "selector: struct<shadow_evaluations: long, shadow_records: array<struct<proposed_changed_selected_cuts: long>>>"
    df = spark.createDataFrame(
        data, f"unit int, seed int, arm string, checks map<string,boolean>, native struct<{outcome}>, "
        f"treatment struct<{outcome}, {selector}>",
    )
    shadows = P.shadow_pairs(df, ["solving_time"])
    got = sorted(
        (r.unit, r.structural_match, r.exposed, r.proposed_change, r.first_change) for r in shadows.collect()
    )
    assert got == [
        (0, True, True, True, 2), (1, False, True, False, None), (2, True, False, False, None),
        (3, True, False, False, None),
    ]
    total = P.shadow_counts(shadows).first()
    assert (total.pairs, total.native_incomplete_shadow_complete, total.structural_matches) == (4, 4, 3)
    assert (total.exposed_pairs, total.exposed_matches, total.proposed_changes) == (2, 1, 1)
    assert P.shadow_counts(shadows.limit(0)).count() == 0


def test_multinomial_counts_are_whole_and_even():
    items, size, count = 1000, 64, 400
    blocks = [np.array(list(B.item_counts(5, count, items, b, size))) for b in range(-(-items // size))]
    times = np.concatenate(blocks, axis=1)
    assert times.shape == (count, items) and (times.sum(axis=1) == items).all()
    # A count is binomial(n, 1/n): mean 1, variance 1 - 1/n, covariance -1/n between items.
    assert abs(times.mean(axis=0) - 1).max() < 5 / math.sqrt(count)
    assert times.var() == pytest.approx(1, abs=0.02)
    halves = times[:, : items // 2].sum(axis=1)
    assert halves.var() == pytest.approx(items / 4, rel=0.35)
    assert len({tuple(r) for r in times}) == count


@pytest.mark.parametrize("block", [3, 65_536])
def test_multinomial_replicates_equal_the_counts(spark, block):
    data = [(k, f"u{i:02}", float(i * i), float(i % 3), 11) for k, n in (("a", 10), (None, 4), ("b", 1))
            for i in range(n)]
    df = spark.createDataFrame(data, "arm string, unit string, v double, w double, s long")

    def run(frame):
        made = B.multinomial_replicates(
            frame, keys=["arm"], item="unit", numerator="v", denominator="w", count=6,
            seed=F.col("s"), block_items=block,
        )
        return {(r.arm, r.replicate): (r.drawn, r.estimate) for r in made.collect()}

    got = run(df)
    assert got == run(df.repartition(5, "v")) and len(got) == 18
    for (arm, replicate), (drawn, estimate) in got.items():
        mine = [r for r in data if r[0] == arm]
        times = [
            t for b in range(-(-len(mine) // block))
            for t in list(B.item_counts(11, 6, len(mine), b, block))[replicate]
        ]
        below = sum(t * r[3] for t, r in zip(times, mine, strict=True))
        above = sum(t * r[2] for t, r in zip(times, mine, strict=True))
        assert drawn == len(mine) == sum(times)
        assert estimate == (pytest.approx(above / below) if below else None)


def test_multinomial_replicates_of_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([("a", "u1", None), ("a", "u2", 2.0)], "arm string, unit string, v double")
    args = {"keys": [], "item": "unit", "numerator": "v", "count": 50, "seed": 1}
    got = {r.estimate for r in B.multinomial_replicates(df, **args).collect()}
    assert got == {0.0, 1.0, 2.0}
    assert B.multinomial_replicates(df.limit(0), **args).count() == 0


def test_two_level_bootstrap_pools_clusters(spark):
    data = [("m", "family", 0.1), ("m", "family", 0.2), ("m", "other", -0.1)]
    df = spark.createDataFrame(data, "metric string, cluster string, delta double")
    sums = B.cluster_sums(df, keys=["metric"], cluster="cluster", value="delta")
    total = sums.agg(F.sum("value_sum") / F.sum("value_count"), F.count("*")).first()
    assert total[0] == pytest.approx(0.2 / 3) and total[1] == 2


# ---- planning ----------------------------------------------------------------
@pytest.mark.parametrize("cap,n", [(0.05, 59), (0.10, 29), (0.5, 5), (0.95, 1)])
def test_zero_failure_size(spark, cap, n):
    assert spark.range(1).select(N.zero_failure_size(cap)).first()[0] == n


def test_paired_sizes(spark):
    sigma = F.lit(0.3741327367245724)
    r = spark.range(1).select(
        N.paired_size(sigma, F.lit(1.0), F.lit(0.9)), N.paired_size(sigma, F.lit(1.05), F.lit(1.0))
    )
    assert tuple(r.first()) == (78, 364)


# ---- choosing arms --------------------------------------------------------------
CHOICE = (
    "unit string, seed bigint, arm string, native_value double, treatment_value double, "
    "safe boolean, eligible boolean, valid boolean, native_complete boolean"
)


def choice(spark, data):
    df = spark.createDataFrame(data, CHOICE)
    n, t = F.col("native_value"), F.col("treatment_value")
    return df.withColumn("delta", t - n).withColumn("saving", (n - t) / n)


def test_oracle_prefers_native_on_ties(spark):
    c = choice(spark, [("u", 1, "a", 33.0, 33.0, True, True, True, True),
                       ("u", 1, "b", 33.0, 20.0, True, True, True, True),
                       ("v", 1, "a", 33.0, 33.0, True, True, True, True),
                       ("v", 1, "b", 33.0, 20.0, False, True, False, True)])
    got = {r["unit"]: r for r in P.oracle_arm(c, ["a", "b"]).collect()}
    assert (got["u"]["selected_arm"], got["u"]["delta"]) == ("b", -13.0)
    assert got["u"]["saving"] == pytest.approx(13 / 33)
    assert got["v"]["selected_arm"] == "native"


def test_oracle_needs_one_native_value(spark):
    c = choice(spark, [("u", 1, "a", 33.0, 1.0, True, True, True, True),
                       ("u", 1, "b", 34.0, 1.0, True, True, True, True)])
    with pytest.raises(Exception, match="share one native value"):
        P.oracle_arm(c, ["a", "b"]).collect()


def test_leave_one_seed_out(spark):
    c = choice(spark, [("u", s, "a", 33.0, t, True, True, True, True)
                       for s, t in ((1, 20.0), (2, 20.0), (3, 40.0))])
    ev = P.leave_one_seed_out(c, ["a"])
    got = {r["seed"]: r for r in ev.collect()}
    assert got[3]["selected_arm"] == "a" and got[3]["held_out_saving"] < 0
    s = P.leave_one_seed_out_summary(ev).first()
    assert (s["wins"], s["losses"], s["evaluable_seeds"]) == (2, 1, 3)


def test_leave_one_seed_out_against_brute_force(spark):
    import random

    rng = random.Random(5)
    arms = ["a", "b", "c"]
    data = []
    for u in "uvw":
        for s in range(6):
            for a in arms:
                safe, elig = rng.random() > 0.15, rng.random() > 0.3
                data.append((u, s, a, 10.0, float(rng.randrange(5, 16)), safe, elig, safe and elig, True))
    got = {(r["unit"], r["seed"]): r for r in P.leave_one_seed_out(choice(spark, data), arms).collect()}
    table = {(u, s, a): ((10 - t) / 10 if e else 0.0) if ok else None for u, s, a, _, t, ok, e, _, _ in data}
    for (u, s), r in got.items():
        best, score = "native", 0.0
        for a in arms:
            rest = [table[u, o, a] for o in range(6) if o != s]
            if all(x is not None for x in rest) and sum(rest) / 5 > score + 1e-12:
                best, score = a, sum(rest) / 5
        assert (r["selected_arm"], r["training_saving"]) == (best, pytest.approx(score))


# ---- comparison of full runs ---------------------------------------------------------
RUN = (
    "unit string, seed bigint, arm string, unit_sha256 string, runtime map<string,string>, "
    "parameters map<string,string>, outcome struct<status:string,objective_sense:string,"
    "primal_bound:double,dual_bound:double,gap:double,nodes:bigint,total_nodes:bigint,"
    "lp_iterations:bigint,lp_count:bigint,cuts_applied:bigint,solving_time:double,"
    "arm_wall_time_seconds:double,primal_dual_integral:double>, selector struct<calls:bigint,"
    "interventions:bigint,run_count:bigint,intervention_scope:string,"
    "intervention_records:array<struct<context_sha256:string>>,"
    "context_records:array<struct<context_sha256:string>>,shadow_evaluations:bigint,"
    "shadow_records:array<struct<proposed_changed_selected_cuts:bigint>>>"
)


def run(arm, iterations=33, status="optimal", acts=1, calls=3, bound=1.0, contexts=("h",), records=None,
        scope="per-run", **over):
    out = (status, "min", bound, bound, 0.0, 5, 5, iterations, 4, 2, 1.0, 1.5, 3.0)
    records = ["h"] * acts if records is None else records
    sel = (calls, acts, 1, scope, [(r,) for r in records], [(c,) for c in contexts], 0, [])
    row = ["u", 1, arm, "sha", {"v": "1"}, {"p": "2", "q": "3"}, out, sel]
    if "sha" in over:
        row[3] = over["sha"]
    return tuple(row)


def compared(spark, *runs, **kw):
    df = spark.createDataFrame(list(runs), RUN)
    pairs = P.pair_arms(df, ["unit_sha256", "runtime", "parameters", "outcome", "selector"])
    return P.compare_treatments(pairs, **kw).first()


def test_safe_pair(spark):
    r = compared(spark, run("native", acts=0), run("t", 20))
    assert (r["safe"], r["eligible"], r["valid"]) == (True, True, True)


@pytest.mark.parametrize(
    "bad,check",
    [
        (run("t", status="timelimit"), "treatment_complete"),
        (run("t", bound=2.0), "same_primal_bound"),
        (run("t", acts=2), "run_budget_respected"),
        (run("t", records=["x"]), "interventions_have_context"),
        (run("t", records=["h", "h"]), "one_record_per_intervention"),
        (run("t", contexts=("h", "h")), "context_budget_respected"),
        (run("t", scope="always"), "known_intervention_scope"),
        (run("t", sha="other"), "same_unit_sha256"),
    ],
)
def test_each_safety_check_can_fail(spark, bad, check):
    r = compared(spark, run("native", acts=0), bad)
    assert not r["safe"] and r["checks"][check] is False


def test_fallback_and_shadow(spark):
    r = compared(spark, run("native", acts=0), run("t", acts=0), policy_arms=["t"])
    assert (r["policy_fallback"], r["valid"]) == (True, True)
    r = compared(spark, run("native", acts=0), run("t", acts=0))
    assert (r["policy_evaluable"], r["valid"]) == (False, False)
    r = compared(spark, run("native", acts=0), run("t", 34, acts=0), shadow_arms=["t"])
    assert not r["safe"] and r["checks"]["shadow_same_lp_iterations"] is False


@pytest.mark.parametrize(
    "native,other,expected",
    [
        (run("native", acts=0), run("noop", acts=0), "passed"),
        (run("native", acts=0), run("noop", acts=0, calls=0), "callback_not_exercised"),
        (run("native", acts=0, status="timelimit"), run("noop", 40, acts=0, status="timelimit"),
         "both_arms_same_incomplete_limit_status"),
        (run("native", acts=0), run("noop", 40, acts=0), "structural_mismatch"),
    ],
)
def test_parity_classes(spark, native, other, expected):
    df = spark.createDataFrame([native, other], RUN)
    pairs = P.pair_arms(df, ["unit_sha256", "runtime", "parameters", "outcome", "selector"])
    assert P.compare_structure(pairs).first()["class"] == expected


def test_compare_arms_job(spark):
    df = spark.createDataFrame([run("native", acts=0), run("a", 33), run("b", 20)], RUN)
    out = X.compare_arms(df, ["a", "b"])
    assert out.oracle.first()["selected_arm"] == "b"
    with pytest.raises(ValueError, match="ran twice"):
        X.compare_arms(df.unionAll(df), ["a", "b"])


# ---- gates --------------------------------------------------------------------
def test_confirmation(spark):
    data = [("a", 1, True, True, True, True, 0.2), ("a", 2, True, True, True, True, 0.1),
            ("b", 1, True, True, False, False, 0.0), ("b", 2, True, True, False, False, 0.0)]
    schema = ("unit string, seed int, native_complete boolean, treatment_complete boolean, "
              "eligible boolean, valid boolean, saving double")  # fmt: skip
    df = spark.createDataFrame(data, schema)
    units, summary, checks = X.confirm_plan(df, df.select("unit", "seed"), 3)
    s = summary.first()
    assert (s["attributable_pairs"], s["wins"], s["ties"]) == (4, 1, 1)
    assert s["mean_saving"] == pytest.approx(0.075)
    assert all(r["passed"] for r in checks.collect())
    with pytest.raises(ValueError, match="differ from the plan"):
        X.confirm_plan(df, df.where("unit = 'a'").select("unit", "seed"), 3)


def test_pilot_picks_by_ratio_then_order(spark):
    data = [("efficacy", 0.98, True), ("adaptive", 0.98, True), ("random", 0.9, False)]
    df = spark.createDataFrame(data, "arm string, ratio double, passed boolean")
    assert S.best_passing_arm(df, ["efficacy", "adaptive", "random"]).first()[0] == "efficacy"
    none = S.best_passing_arm(df.where("arm = 'random'"), ["random"]).first()
    assert none["selected_arm"] is None and none["passing_arms"] == 0


def test_cluster_decision(spark):
    rows = [(f"c{i}", s, True, True, 10.0, 9.0, 10.0, 9.0, True, True, True, 1, True, True)
            for i in range(18) for s in range(3)]
    schema = ("cluster string, seed int, native_complete boolean, active_complete boolean, "
              "native_wall double, active_wall double, native_solver double, active_solver double, "
              "mechanical_ok boolean, terminal_ok boolean, shadow_safe boolean, interventions int, "
              "context_observed boolean, context_match boolean")  # fmt: skip
    df = spark.createDataFrame(rows, schema)
    clusters, checks = X.pilot_decision(df, 300.0, planned_pairs=54, minimum_exposed=10, replicates=20)
    assert all(r["passed"] for r in checks.collect())
    assert clusters.count() == 18
    worse = df.withColumn("active_wall", F.lit(9.9))
    _, failed = X.pilot_decision(worse, 300.0, planned_pairs=54, minimum_exposed=10, replicates=20)
    assert {r["check"] for r in failed.where("NOT passed").collect()} == {"point_ratio_within_cap"}


def test_pilot_report(spark):
    rows = [(f"c{i}", s, True, True, 10.0, 9.0, 10.0, 8.0, True, True, True, i % 2, True, True)
            for i in range(18) for s in range(3)]
    schema = ("cluster string, seed int, native_complete boolean, active_complete boolean, "
              "native_wall double, active_wall double, native_solver double, active_solver double, "
              "mechanical_ok boolean, terminal_ok boolean, shadow_safe boolean, interventions int, "
              "context_observed boolean, context_match boolean")  # fmt: skip
    df = spark.createDataFrame(rows, schema)

    def told(df, **more):
        return X.pilot_report(df, 300.0, planned_pairs=54, minimum_exposed=9, replicates=20, **more)

    good = told(df)
    assert good.verdict.first()["passed"]
    people = good.population.first()
    assert (people["clusters"], people["exposed_clusters"], people["fallback_pairs"]) == (18, 9, 27)
    got = {r["measure"]: r for r in good.ratios.collect()}
    assert got["wall"]["ratio"] == pytest.approx(0.9) and got["solver"]["ratio"] == pytest.approx(0.8)
    # equal clusters: every draw is the same
    assert got["solver"]["lower"] == pytest.approx(0.8) == got["solver"]["upper"]
    # one block broken in one way fails its own check alone
    first = (F.col("cluster") == "c1") & (F.col("seed") == 0)
    broken = {
        "shadow_safe": "shadow_matches_all_pairs", "context_match": "zero_context_mismatches",
        "terminal_ok": "correctness_failures_within_cap", "active_complete": "lost_runs_within_cap",
    }
    for column, check in broken.items():
        bad = df.withColumn(column, F.col(column) & ~first)
        if column == "active_complete":  # a lost run costs twice the limit: widen the ratio's cap
            r = told(bad, max_ratio=2.0, max_upper=2.0)
        else:
            r = told(bad)
        assert [x["check"] for x in r.checks.where("NOT passed").collect()] == [check]
    other = spark.createDataFrame([("arms[1]", "a", "b")], "path string, planned string, found string")
    with pytest.raises(ValueError, match=r"plan at \['arms\[1\]'\]"):
        told(df, differences=other)
    assert told(df, differences=other.limit(0)).verdict.first()["passed"]


def test_pilot_blocks_keep_what_lacks_an_arm(spark):
    arms = [(1, "native"), (1, "shadow"), (1, "active"), (2, "native"), (2, "shadow")]
    runs = [(r[0], seed, *r[2:]) for seed, a in arms for r in [run(a)]]
    df = spark.createDataFrame(runs, RUN)
    pairs = P.pair_arms(df, ["unit_sha256", "runtime", "parameters", "outcome", "selector"])
    done = P.compare_treatments(pairs, policy_arms=["active"], shadow_arms=["shadow"])
    got = {r["seed"]: r for r in P.pilot_blocks(done, shadow="shadow", active="active", cluster=F.lit("c")).collect()}
    assert got[1]["mechanical_ok"] and got[1]["terminal_ok"] and got[1]["interventions"] == 1
    assert got[1]["active_complete"] and got[1]["context_match"]
    lost = got[2]
    assert not (lost["active_complete"] or lost["mechanical_ok"] or lost["context_observed"])
    assert lost["interventions"] == 0 and lost["active_wall"] is None
    one = S.cluster_decision(spark.createDataFrame(list(got.values())), 300.0).first()
    assert (one["pairs"], one["fallback_pairs"], one["lost_run"], one["correctness_failure"]) == (2, 1, True, True)
    none = P.pilot_blocks(done.limit(0), shadow="shadow", active="active", cluster=F.lit("c"))
    assert S.pilot_population(S.cluster_decision(none, 300.0)).first()["clusters"] == 0


def test_confirmation_faults(spark):
    schema = ("unit string, seed int, native_complete boolean, treatment_complete boolean, eligible boolean, "
              "valid boolean, saving double, contexts int, interventions int, contexts_match boolean")  # fmt: skip
    good = ("a", 1, True, True, True, True, 0.2, 1, 1, True)
    odd = [
        (*good[:7], 2, 1, True), (*good[:7], 1, 2, True), (*good[:7], 1, 1, None),
        ("a", 1, True, True, True, None, 0.2, 1, 1, True),
    ]
    names = ["not_one_context", "too_many_interventions", "contexts_differ", "completed_pair_not_valid"]
    for row, name in zip(odd, names):
        df = spark.createDataFrame([row], schema)
        assert [r["fault"] for r in S.confirmation_faults(df).collect()] == [name]
        with pytest.raises(ValueError, match=name):
            X.confirm_plan(df, df.select("unit", "seed"), 1)
    df = spark.createDataFrame([good], schema)
    assert S.confirmation_faults(df).isEmpty()
    assert all(r["passed"] for r in X.confirm_plan(df, df.select("unit", "seed"), 1)[2].collect())
    # the validity of completed pairs is held without logged contexts too
    bare = spark.createDataFrame([odd[3]], schema).drop("contexts", "interventions", "contexts_match")
    with pytest.raises(ValueError, match="not valid"):
        X.confirm_plan(bare, bare.select("unit", "seed"), 1)


def test_objective_mismatch_names_the_nearer_side(spark):
    df = spark.createDataFrame(
        [("u", 1.0, 2.0, 1.0, 2.0, True, True)],
        "unit string, native_primal_bound double, treatment_primal_bound double, "
        "native_dual_bound double, treatment_dual_bound double, native_complete boolean, "
        "treatment_complete boolean",
    )
    ref = spark.createDataFrame([("u", 2.0)], "unit string, reference_objective double")
    assert P.objective_mismatch(df, ref).first()["closer"] == "treatment"


def test_shared_contexts(spark):
    import hashlib

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    def arm(seed, name, text="{}", records=1, told=None, manifest=None):
        told = sha(text) if told is None else told
        return ("u", seed, name, [(told, text)] * records, told if manifest is None else manifest)

    rows = [
        arm(1, "a"), arm(1, "b"),
        arm(2, "a"),
        arm(3, "a", records=2), arm(3, "b"),
        arm(4, "a", told="0" * 64), arm(4, "b"),
        arm(5, "a", manifest="1" * 64), arm(5, "b"),
        arm(6, "a", '{"k":1}'), arm(6, "b"),
        ("u", 7, "a", None, None), arm(7, "b"),
        ("u", 8, "a", [(sha("x"), None)], sha("x")), arm(8, "b"),
        arm(9, "a", '{"nested":{"outcome":1}}'), arm(9, "b", '{"nested":{"outcome":1}}'),
    ]
    df = spark.createDataFrame(rows, "unit string, seed int, arm string, context_records array<struct<context_sha256:string,"
                               "decision_context:string>>, initial_context_sha256 string")  # fmt: skip
    got = {r["seed"]: r for r in P.shared_contexts(df, expected=2).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {
        1: None, 2: "arm_missing", 3: "arm_fault", 4: "arm_fault", 5: "arm_fault", 6: "arms_differ", 7: "arm_fault",
        8: "arm_fault", 9: None,
    }
    assert (got[1]["context"], got[1]["context_sha256"]) == ("{}", sha("{}")) and got[6]["context"] is None
    assert [got[k][f] for k, f in [(3, "not_one_context"), (4, "payload_hash_differs"), (5, "manifest_hash_differs"),
                                   (7, "not_one_context"), (8, "payload_hash_differs")]] == [1] * 5
    assert X.checked_contexts(df.where("seed = 1"), 2).count() == 1
    with pytest.raises(ValueError, match="arm_fault.*arm_missing.*arms_differ"):
        X.checked_contexts(df, 2)
    from plumbline.fixed_values import FORBIDDEN_CONTEXT_KEYS

    leak = '{"nested":[{"%s":1}]}' % FORBIDDEN_CONTEXT_KEYS[0]
    bad = spark.createDataFrame([arm(1, "a", leak), arm(1, "b", leak)], df.schema)
    with pytest.raises(ValueError, match="outcome fields"):
        X.checked_contexts(bad, 2)
    assert P.shared_contexts(df.limit(0), expected=2).isEmpty()
