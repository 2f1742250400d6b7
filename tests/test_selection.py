"""Sampling, folds, protocols, heuristics and risk metrics on small literals."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import heuristics as H
from plumbline.operators import protocols as V
from plumbline.operators import ranking as R
from plumbline.operators import risk as K
from plumbline.operators import sampling as W
from plumbline.plans import cohorts as C
from plumbline.plans.audit import build_protocols


def pool(spark, n, shared=2):
    data = [(f"u{i:03d}", "g0" if i < shared else f"g{i}", float(i)) for i in range(n)]
    return spark.createDataFrame(data, "unit string, cluster string, elapsed double")


def test_one_per_cluster_is_order_free(spark):
    p = pool(spark, 20)
    a = W.one_per_cluster(p, 18, cluster="cluster", unit="unit", key="k").collect()
    b = W.one_per_cluster(p.orderBy(F.desc("unit")), 18, cluster="cluster", unit="unit", key="k")
    assert sorted(map(tuple, a)) == sorted(map(tuple, b.collect()))
    assert len({r["cluster"] for r in a}) == 18
    with pytest.raises(ValueError, match="only 19"):
        W.one_per_cluster(p, 20, cluster="cluster", unit="unit", key="k")


def test_stratified_cohort_thirty_and_ten(spark):
    got = W.stratified_cohort(
        pool(spark, 120, shared=1), cluster="cluster", unit="unit", order=["elapsed", "unit"]
    ).collect()
    assert [sum(r["stratum"] == s for r in got) for s in ("leading", "rank_bins")] == [30, 10]
    assert len({r["cluster"] for r in got}) == 40
    assert {r["unit"] for r in got if r["bin"] == 9} == {"u111"}


@pytest.mark.parametrize(
    "units,arms,design,each",
    [(40, ["native", "a", "b", "c"], "carry-over", 30), (18, ["native", "s", "x"], "all-orders", 18),
     (10, ["native", "s"], "alternating", 15)],
)
def test_balanced_designs(spark, units, arms, design, each):
    u = spark.createDataFrame([(f"u{i}",) for i in range(units)], "unit string")
    schedule, counts = C.assign_arms(u, [1, 2, 3], arms, "key", design)
    assert schedule.count() == units * 3
    assert {r["blocks"] for r in counts.collect()} == {each}
    assert counts.count() == len(arms) ** 2


def test_all_orders_must_divide(spark):
    u = spark.createDataFrame([("a",)], "unit string")
    with pytest.raises(ValueError, match="divisible"):
        C.assign_arms(u, [1, 2, 3, 4], ["n", "s", "x"], "k", "all-orders")


def greedy(table, folds):
    loads = [[0, 0] for _ in range(folds)]
    out = {}
    for name, (u, r) in sorted(table.items(), key=lambda kv: (-kv[1][0], -kv[1][1], kv[0])):
        j = min(range(folds), key=lambda i: (loads[i][0], loads[i][1], i))
        out[name] = j
        loads[j][0] += u
        loads[j][1] += r
    return out


@pytest.mark.parametrize("seed,folds", [(1, 2), (2, 3), (3, 5), (4, 7)])
def test_folds_equal_the_sequential_rule(spark, seed, folds):
    rng = random.Random(seed)
    rows, table = [], {}
    for c in range(90):
        units = rng.choice([1, 1, 1, 2, 3])
        size = [rng.choice([1, 2, 5]) for _ in range(units)]
        table[f"c{c:02d}"] = (units, sum(size))
        rows += [(f"c{c:02d}", f"u{c}-{i}", s) for i, s in enumerate(size)]
    df = spark.createDataFrame(rows, "cluster string, unit string, n_candidates bigint")
    got = {r["cluster"]: r["fold"] for r in W.cluster_folds(df, folds).collect()}
    assert got == greedy(table, folds)


def test_ungrouped_get_fold_minus_one(spark):
    df = spark.createDataFrame(
        [("A", "a1", 1), ("A", "a2", 1), ("B", "b", 1), ("C", "c", 1), ("", "u", 1)],
        "cluster string, unit string, n_candidates bigint",
    )
    folds = W.cluster_folds(df.where("cluster <> ''"), 2)
    got = {r["unit"]: r["fold"] for r in W.assign_folds(df, folds).collect()}
    assert got["a1"] == got["a2"] and got["u"] == -1 and {got["b"], got["c"]} == {1 - got["a1"]}


SPLITS = [("a1", "A", "train"), ("u0", "", "train"), ("a2", "A", "val"), ("b1", "B", "val"),
          ("v0", "", "val"), ("a3", "A", "test"), ("c1", "C", "test"), ("t0", "", "test")]


def test_protocols(spark):
    df = spark.createDataFrame(SPLITS, "unit string, grp string, split string")
    assigned, members, checks = build_protocols(df)
    at = {r["unit"]: r["stratum"] for r in assigned.collect()}
    assert (at["b1"], at["c1"], at["a2"], at["a3"], at["t0"]) == (
        "unseen_family", "unseen_family", "seen_family", "seen_family", "officially_ungrouped",
    )
    assert members.where("split = 'train'").count() == 6
    assert checks.count() == 7


@pytest.mark.parametrize(
    "extra,message",
    [(("a1", "A", "val"), "more than one split"), (("c2", "C", "val"), "ood_val_and_test"),
     (("m", None, "val"), "all_units_have_metadata")],
)
def test_broken_protocols_raise(spark, extra, message):
    df = spark.createDataFrame([*SPLITS, extra], "unit string, grp string, split string")
    with pytest.raises(ValueError, match=message):
        build_protocols(df)


def test_metric_rank_puts_nan_last(spark):
    df = spark.createDataFrame(
        [("d", 0, "a", 0.2), ("d", 1, "b", 0.5), ("d", 2, "c", 0.5), ("d", 3, "d", math.nan)],
        "g string, i int, n string, m double",
    )
    got = H.metric_rank(df, decision=["g"], metric="m", index="i").orderBy("metric_rank").collect()
    assert [r["n"] for r in got] == ["b", "c", "a", "d"]


@pytest.mark.parametrize("budget,expected", [(2, ["a", "c"]), (3, ["a", "c", "b"])])
def test_diversity_filter_then_fill(spark, budget, expected):
    # b is nearly parallel to a, c is not
    df = spark.createDataFrame(
        [("d", 0, "a", 1.0, [1.0, 0.0]), ("d", 1, "b", 0.9, [1.0, 0.2]), ("d", 2, "c", 0.8, [0.0, 1.0])],
        "g string, i int, n string, s double, v array<double>",
    )
    got = H.diverse_top_k(df, decision=["g"], index="i", score="s", vector="v", budget=budget)
    names = dict(df.select("i", "n").collect())
    assert [names[r["pick"]] for r in got.orderBy("place").collect()] == expected


def test_swap_pairs(spark):
    data = [("d", i + 1, e) for i, e in enumerate((0.3, 0.1, 0.2, 0.4))]
    df = spark.createDataFrame(data, "g string, at bigint, e double").withColumn("k", F.lit(2))
    r = H.swap_pairs(df, decision=["g"], position="at", budget="k", metric="e").first()
    pairs = [(r[c]["removed"]["at"] - 1, r[c]["added"]["at"] - 1) for c in ("swap_0", "swap_1", "promote")]
    assert pairs == [(1, 2), (1, 3), (1, 3)]
    same = df.withColumn("e", F.lit(0.5))
    assert H.swap_pairs(same, decision=["g"], position="at", budget="k", metric="e").first()["promote"] is None


def test_risk_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (0, 0.2), (1, 0.8)], "y int, s double")
    blocks = K.score_blocks(df, score="s", label="y")
    q = K.ranking_quality(blocks).first()
    assert (q["average_precision"], q["roc_auc"]) == (1.0, 1.0)
    full = K.threshold_table(blocks, score="s").where("rule = 'full_recall'").first()
    assert (full["unsafe_recall"], full["safe_abstention_rate"]) == (1.0, 0.0)


@pytest.mark.parametrize("hot", [None, "20"])
def test_risk_metrics_against_brute_force(spark, hot):
    rng = random.Random(11)
    data = [(int(rng.random() < 0.3), rng.randrange(60) / 60) for _ in range(300)]
    df = spark.createDataFrame(data, "y int, s double")
    if hot:
        spark.conf.set("spark.plumbline.hotGroupRows", hot)
    try:
        blocks = K.score_blocks(df, score="s", label="y")
        q = K.ranking_quality(blocks).first()
        table = {r["rule"]: r for r in K.threshold_table(blocks, score="s").collect()}
    finally:
        spark.conf.unset("spark.plumbline.hotGroupRows")
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ap = sum(
        sum(y for y, s in data if s >= t) / sum(1 for _, s in data if s >= t)
        * sum(y for y, s in data if s == t)
        for t in {s for _, s in data}
    ) / len(pos)
    assert q["roc_auc"] == pytest.approx(auc) and q["average_precision"] == pytest.approx(ap)
    ordered = sorted((s for _, s in data), reverse=True)
    for rule, f in (("top_5_percent", 0.05), ("top_10_percent", 0.1), ("top_20_percent", 0.2)):
        assert table[rule]["threshold"] == ordered[max(1, math.ceil(300 * f)) - 1]
    assert table["full_recall"]["threshold"] == min(pos)


def test_action_features_layout(spark):
    cand = [(e, 0.1, 0.2, 3, 1, 1.0, 1.0, 0.5, True, False, None) for e in (0.3, 0.1, 0.2, 0.4)]
    state = tuple([1.0] * 12 + [2.0])
    fields = ":double,".join(K.STATE_FIELDS) + ":double"
    c = ("efficacy:double,obj_parallelism:double,cutoff_distance:double,nnz:bigint,n_int_cols:bigint,"
         "coeff_norm_l2:double,coeff_max_abs:double,coeff_std_abs:double,is_integral:boolean,"
         "is_local:boolean,in_global_cutpool:boolean")  # fmt: skip
    df = spark.createDataFrame(
        [("u", 1, state, cand)],
        f"unit string, seed int, solver_state struct<{fields}>, candidates array<struct<{c}>>",
    )
    f = K.action_features(K.candidate_rows(df, ["unit", "seed"]), ["unit", "seed"])
    got = {r["action"]: r for r in f.collect()}
    assert len(f.columns) == 3 + 67 and set(got) == set(K.ACTIONS)
    p = got["efficacy-promote"]
    assert (p["removed_efficacy"], p["added_efficacy"]) == (0.1, 0.4)
    assert math.isnan(p["selected_global_pool_fraction"])
    assert p["state_selected_fraction"] == 0.5 and p["removed_rank_fraction"] == 0.25


# ---- ranking ---------------------------------------------------------------------
QUERIES = [("q1", "a", [1, 0, 0]), ("q2", "a", [1, 0]), ("q3", "b", [1, 0, 0])]


def matrix(spark, scores=None):
    data = []
    for i, (q, u, labels) in enumerate(QUERIES):
        for r, y in enumerate(labels):
            data.append((q, u, y, r + 1, scores[i][r] if scores else float(y)))
    return spark.createDataFrame(data, "decision string, unit string, label int, rank int, s double")


def metric(df, **kw):
    return R.query_metrics(df, query=["decision"], score="s", baseline_rank="rank", label="label",
                           carry=["unit"], **kw)


def test_perfect_scores(spark):
    r = R.unit_equal_mean(metric(matrix(spark))).first()
    assert (r["ndcg_10"], r["selection_overlap"], r["units"], r["queries"]) == (1.0, 1.0, 2, 3)


def test_anchor_keeps_the_first_choice(spark):
    df = matrix(spark, [[0.1, 0.9, 0.8], [0.2, 0.7], [0.3, 0.9, 0.8]])
    lifted = R.anchored_score(df, query=["decision"], score="s", baseline_rank="rank")
    tops = lifted.groupBy("decision").agg(F.max_by("rank", "anchored_score").alias("r"))
    assert {r["r"] for r in tops.collect()} == {1}
    with pytest.raises(Exception, match="one rank-1"):
        R.anchored_score(
            df.withColumn("rank", F.lit(1)), query=["decision"], score="s", baseline_rank="rank"
        ).collect()


def test_weights(spark):
    df = spark.createDataFrame([("q1", "a"), ("q2", "a"), ("q3", "b")], "decision string, unit string")
    got = {r["decision"]: r["query_weight"] for r in R.unit_balanced_weights(df).collect()}
    assert got == {"q1": 0.75, "q2": 0.75, "q3": 1.5}
    assert R.weight_balance(R.unit_balanced_weights(df)).first()["balanced"]


def test_only_effective_queries_are_scored(spark):
    data = [("x", "a", 1, 1, 1.0), ("x", "a", 1, 2, 0.5), ("y", "a", 0, 1, 1.0), ("z", "b", 1, 1, 1.0),
            ("z", "b", 0, 2, 0.0)]
    df = spark.createDataFrame(data, "decision string, unit string, label int, rank int, s double")
    assert [r["decision"] for r in metric(df).collect()] == ["z"]


@pytest.mark.parametrize("hot", [None, "3"])
def test_metrics_against_brute_force(spark, hot):
    rng = random.Random(2)
    data = [(f"q{i % 5}", "a", int(rng.random() < 0.4), i, float(rng.randrange(6))) for i in range(120)]
    df = spark.createDataFrame(data, "decision string, unit string, label int, rank int, s double")
    if hot:
        spark.conf.set("spark.plumbline.hotGroupRows", hot)
    try:
        got = {r["decision"]: r for r in metric(df).collect()}
    finally:
        spark.conf.unset("spark.plumbline.hotGroupRows")
    for q in {d[0] for d in data}:
        ys = [d[2] for d in sorted((d for d in data if d[0] == q), key=lambda d: (-d[4], d[3]))]
        p = sum(ys)
        dcg = sum(y / math.log2(i + 2) for i, y in enumerate(ys[:10]))
        ideal = sum(1 / math.log2(i + 2) for i in range(min(p, 10)))
        ap = sum(sum(ys[: i + 1]) / (i + 1) for i, y in enumerate(ys) if y) / p
        r = got[q]
        assert r["ndcg_10"] == pytest.approx(dcg / ideal)
        assert r["average_precision"] == pytest.approx(ap)
        assert r["selection_overlap"] == pytest.approx(sum(ys[:p]) / p)


def test_schema_guards(spark):
    df = spark.createDataFrame([(1, ({"x": 1},))], "a int, b struct<solving_time: map<string,int>>")
    assert R.forbidden_columns(df) == ["b.solving_time"]
    with pytest.raises(ValueError, match="prohibited"):
        R.forbid_columns(df)
    with pytest.raises(ValueError, match="unaccounted"):
        R.select_subset(df, ["a", "b"], ["a"], [])


def test_forbidden_keys_in_json(spark):
    texts = ['{"a": {"solving_time": 1}}', '{"a": "solving_time"}', '{"b": ["x", {"rank" : "k"}]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = R.forbidden_json_keys(df, "t", ["solving_time", "rank", "k"]).collect()
    assert sorted((r["i"], r["forbidden_key"]) for r in got) == [(0, "solving_time"), (2, "rank")]
