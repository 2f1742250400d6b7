"""Heuristic rankings, risk metrics, cohorts and assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries_ranking import ranked, rounded
from checks.views import (
    RANKED_SQL, RISK_SQL, SEQ, SPLIT_SQL, UNITS_SQL, cand, cand_sql, risk, split_of, table, units,
)
from plumbline.functions import exprs as E
from plumbline.operators import heuristics as H
from plumbline.operators import risk as K
from plumbline.operators import sampling as W
from plumbline.session import materialize
from plumbline.sources.html import list_links, table_rows, checked_cells

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---- heuristic rankings ----------------------------------------------------
@query(
    "random_rank_sha",
    f"""WITH {cand_sql()}
SELECT decision, l_partkey, l_suppkey, score, row_number() OVER (PARTITION BY decision
  ORDER BY sha256('k1|' || score || '|' || l_partkey)) AS random_rank FROM cand""",
)
def random_rank_sha(spark, sf):
    c = cand(spark, sf)
    return H.random_rank(
        c, decision=["decision"], key="k1", index="score", name="l_partkey"
    ).select("decision", "l_partkey", "l_suppkey", "score", "random_rank")


@query(
    "metric_rank",
    f"""WITH {cand_sql()}, {RANKED_SQL}
SELECT decision, baseline_rank, row_number() OVER (PARTITION BY decision
  ORDER BY CASE WHEN l_linenumber = 3 THEN '-inf'::DOUBLE ELSE second END DESC, baseline_rank) AS metric_rank
FROM ranked""",
)
def metric_rank(spark, sf):
    r = ranked(spark, sf).withColumn(
        "m", F.when(F.col("l_linenumber") == 3, F.lit(E.NAN)).otherwise(F.col("second"))
    )
    return H.metric_rank(r, decision=["decision"], metric="m", index="baseline_rank").select(
        "decision", "baseline_rank", "metric_rank"
    )


@query(
    "adaptive_score",
    f"""WITH {cand_sql('l_discount', 'l_tax')},
m AS (SELECT *, max(score) OVER (PARTITION BY decision) AS me, max(second) OVER (PARTITION BY decision) AS md
      FROM cand)
SELECT decision, l_partkey, score, round(pow(ln(1 + score) / ln(1 + me), 2)
  + 0.1::DOUBLE * l_discount + 0.1::DOUBLE * (l_linenumber / 7::DOUBLE)
  + CASE WHEN l_linenumber % 2 = 0 THEN 1e-4 ELSE 0 END, 9) AS adaptive_score FROM m""",
)
def adaptive_score(spark, sf):
    c = H.with_group_maxima(
        cand(spark, sf, "l_discount", "l_tax"), decision=["decision"], columns=["score", "second"]
    )
    s = E.adaptive_score(
        "score", "max_score", "second", "max_second", "l_discount",
        E.integer_support("l_linenumber", F.lit(7)), incumbent=F.col("decision") % 2 == 0,
        pool=F.col("l_linenumber") % 2 == 0,
    )
    return rounded(c.select("decision", "l_partkey", "score", s.alias("adaptive_score")), 9,
                   ["adaptive_score"])


@query(
    "linear_score",
    """WITH x AS (SELECT *, l_orderkey % 2 = 0 AS inc, l_linenumber = 3 AS loc, l_discount * 10 AS eff,
   l_tax * 10 AS dist FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, round(
  CASE WHEN inc THEN 0.5::DOUBLE * (CASE WHEN loc THEN eff ELSE greatest(dist, eff) END) + eff
    ELSE 1.5::DOUBLE * eff END + 0.1::DOUBLE * l_tax + 0.1::DOUBLE * (l_linenumber / 7::DOUBLE)
  + CASE WHEN l_linenumber % 2 = 0 THEN 1e-4 ELSE 0 END, 9) AS linear_score FROM x""",
)
def linear_score(spark, sf):
    n = F.col("l_linenumber")
    s = E.linear_score(
        F.col("l_discount") * 10, F.col("l_tax") * 10, "l_tax", E.integer_support(n, F.lit(7)),
        incumbent=F.col("l_orderkey") % 2 == 0, local=n == 3, pool=n % 2 == 0,
        weights={"distance": 0.5, "efficacy": 1.0, "integer": 0.1, "parallelism": 0.1},
    )
    li = table(spark, sf, "lineitem")
    return rounded(
        li.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice",
                  s.alias("linear_score")), 9, ["linear_score"],
    )


SWAP_SQL = f"""{cand_sql()}, {RANKED_SQL},
sized AS (SELECT *, count(*) OVER (PARTITION BY decision) AS n, 2 AS k FROM ranked)"""


def swaps(spark, sf):
    r = ranked(spark, sf).withColumn("k", F.lit(2).cast("bigint"))
    return H.swap_pairs(
        r, decision=["decision"], position="baseline_rank", budget="k", metric="second",
        carry=["l_partkey", "second"],
    )


@query(
    "boundary_swap",
    f"""WITH {SWAP_SQL}
SELECT a.decision, a.l_partkey AS removed, b.l_partkey AS added, b.baseline_rank - 3 AS shift
FROM sized a JOIN sized b ON a.decision = b.decision AND a.baseline_rank = 2 AND b.baseline_rank IN (3, 4)
WHERE a.n > 2""",
)
def boundary_swap(spark, sf):
    s = swaps(spark, sf)
    long = s.select(
        "decision",
        F.inline(F.array(*[
            F.struct(F.lit(o).cast("bigint").alias("shift"), F.col(f"swap_{o}").alias("p"))
            for o in (0, 1)
        ])),
    )
    return long.where("p IS NOT NULL").select(
        "decision", "shift", F.col("p.removed.l_partkey").alias("removed"),
        F.col("p.added.l_partkey").alias("added"),
    )


@query(
    "efficacy_promote",
    f"""WITH {SWAP_SQL},
w AS (SELECT decision, arg_min(baseline_rank, (second, -baseline_rank)) AS r, min(second) AS v FROM sized
      WHERE baseline_rank <= k AND n > k GROUP BY decision),
b AS (SELECT decision, arg_max(baseline_rank, (second, -baseline_rank)) AS r, max(second) AS v FROM sized
      WHERE baseline_rank > k GROUP BY decision)
SELECT decision, w.r AS removed_at, b.r AS added_at, w.v AS removed_value, b.v AS added_value
FROM w JOIN b USING (decision) WHERE b.v > w.v""",
)
def efficacy_promote(spark, sf):
    return swaps(spark, sf).where("promote IS NOT NULL").select(
        "decision", F.col("promote.removed.at").alias("removed_at"),
        F.col("promote.added.at").alias("added_at"),
        F.col("promote.removed.second").alias("removed_value"),
        F.col("promote.added.second").alias("added_value"),
    )


@query(
    "swapped_order",
    f"""WITH {SWAP_SQL}
SELECT decision, baseline_rank, CASE WHEN n > 2 AND baseline_rank = 2 THEN 3
  WHEN n > 2 AND baseline_rank = 3 THEN 2 ELSE baseline_rank END AS new_position FROM sized""",
)
def swapped_order(spark, sf):
    r = ranked(spark, sf).select("decision", "baseline_rank")
    return H.apply_swap(
        r, swaps(spark, sf), decision=["decision"], position="baseline_rank", pair="swap_0"
    )


@query(
    "selection_change",
    f"""WITH {cand_sql()}, {RANKED_SQL},
x AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY second DESC, baseline_rank) AS m FROM ranked)
SELECT decision, baseline_rank, CASE WHEN baseline_rank <= 2 THEN 'removed' ELSE 'added' END AS change
FROM x WHERE (baseline_rank <= 2) <> (m <= 2)""",
)
def selection_change(spark, sf):
    r = H.metric_rank(
        ranked(spark, sf), decision=["decision"], metric="second", index="baseline_rank"
    )
    return H.selection_change(
        r, before="baseline_rank", after="metric_rank", budget=F.lit(2)
    ).select("decision", "baseline_rank", "change")


@query(
    "occurrence_expansion",
    f"""WITH {cand_sql()},
o AS (SELECT *, row_number() OVER (PARTITION BY decision, l_suppkey % 4 ORDER BY score DESC) AS occ,
  max(second) OVER (PARTITION BY decision, l_suppkey % 4) AS model FROM cand)
SELECT decision, score, row_number() OVER (PARTITION BY decision ORDER BY (occ > 1)::INT, model DESC,
  l_suppkey % 4, score DESC) AS position FROM o""",
)
def occurrence_expansion(spark, sf):
    from plumbline.operators.ordering import with_positions

    c = cand(spark, sf).withColumn("g", F.col("l_suppkey") % 4)
    o = with_positions(c, ["decision", "g"], [F.col("score").desc()], position="occ")
    tops = c.groupBy("decision", "g").agg(F.max("second").alias("_m"))
    placed = with_positions(tops, ["decision"], [F.col("_m").desc(), "g"], position="model_rank")
    o = o.join(placed, ["decision", "g"]).withColumn("index", -F.col("score"))
    return H.expand_occurrences(
        o, decision=["decision"], model_rank="model_rank", occurrence="occ", index="index"
    ).select("decision", "score", "position")


@query(
    "vector_summary",
    """SELECT vec_id, len(embedding)::BIGINT AS nnz,
  round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS norm_l1,
  round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm_l2,
  round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS max_abs,
  round(list_min(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS min_abs,
  round(list_avg(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS mean_abs,
  round(list_stddev_pop(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS std_abs FROM embeddings""",
)
def vector_summary(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", E.vector_summary("embedding").alias("s"))
    return rounded(e.select("vec_id", "s.*"), 6)


@query("diverse_topk")
def diverse_topk(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("score", (F.col("vec_id") * 7919 % 1000) / 1000)
    return H.diverse_top_k(
        e, decision=["label"], index="vec_id", score="score", vector="embedding", budget=8,
        min_orthogonality=0.6,
    )


@query("diverse_topk_split")
def diverse_topk_split(spark, sf):
    """The same picks when every decision is scanned in many stretches."""
    e = table(spark, sf, "embeddings").withColumn("score", (F.col("vec_id") * 7919 % 1000) / 1000)
    return H.diverse_top_k(
        e, decision=["label"], index="vec_id", score="score", vector="embedding", budget=8,
        min_orthogonality=0.6, hot_rows=200,
    )


@query("diverse_order")
def diverse_order(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("score", (F.col("vec_id") * 7919 % 1000) / 1000)
    return H.diverse_order(
        e, decision=["label"], index="vec_id", score="score", vector="embedding", budget=8,
        min_orthogonality=0.6,
    )


SIM = (
    "abs(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / "
    "(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * "
    "sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
)
# Greedy in score order: the state is the list of picks, one step per place.
ORACLES["diverse_topk"] = f"""WITH RECURSIVE
e AS (SELECT vec_id, label, embedding, (vec_id * 7919 % 1000) / 1000::DOUBLE AS score FROM embeddings),
t AS (SELECT *, CASE WHEN score >= max(score) OVER (PARTITION BY label) THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END
        AS allowed FROM e),
near AS (SELECT b.label, b.vec_id AS hit, list(a.vec_id) AS blockers FROM t a JOIN t b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND {SIM} > b.allowed GROUP BY ALL),
c AS (SELECT t.label, t.vec_id, t.score, coalesce(blockers, []) AS blockers FROM t
  LEFT JOIN near ON hit = vec_id AND near.label = t.label),
go AS (
  SELECT label, []::BIGINT[] AS picks, 0 AS step FROM (SELECT DISTINCT label FROM c)
  UNION ALL
  SELECT g.label, list_append(any_value(g.picks), arg_max(c.vec_id, (c.score, -c.vec_id))), any_value(g.step) + 1
  FROM go g JOIN c ON c.label = g.label AND NOT list_contains(g.picks, c.vec_id)
    AND NOT list_has_any(c.blockers, g.picks)
  WHERE g.step < 8 GROUP BY g.label),
done AS (SELECT label, arg_max(picks, step) AS picks FROM go GROUP BY label),
fill AS (SELECT c.label, c.vec_id, row_number() OVER (PARTITION BY c.label ORDER BY c.score DESC, c.vec_id) AS r
  FROM c JOIN done d ON c.label = d.label AND NOT list_contains(d.picks, c.vec_id))
SELECT label, unnest(picks) AS pick, generate_subscripts(picks, 1)::BIGINT AS place FROM done
UNION ALL
SELECT f.label, f.vec_id, (len(d.picks) + r)::BIGINT FROM fill f JOIN done d USING (label)
WHERE len(d.picks) + r <= 8"""
ORACLES["diverse_topk_split"] = ORACLES["diverse_topk"]
ORACLES["diverse_order"] = (
    ORACLES["diverse_topk"].replace("SELECT label, unnest(picks)", "SELECT *, place <= 8 AS selected FROM (SELECT label, unnest(picks)")
    .replace("WHERE len(d.picks) + r <= 8", ")")
)


# ---- risk --------------------------------------------------------------------
@query(
    "average_precision_auc",
    f"""WITH {RISK_SQL},
b AS (SELECT score, sum(label)::BIGINT AS pos, count(*) AS n FROM risk GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn,
  sum(pos) OVER () AS p, sum(n) OVER () AS t FROM b)
SELECT max(t)::BIGINT AS rows, max(p)::BIGINT AS positives, round(max(p) / max(t)::DOUBLE, 9) AS prevalence,
  round(sum(cp / cn::DOUBLE * pos) / max(p), 9) AS average_precision,
  round(sum(pos * ((t - p) - (cn - cp) + 0.5::DOUBLE * (n - pos))) / (max(p) * max(t - p)), 9) AS roc_auc FROM c""",
)
def average_precision_auc(spark, sf):
    return rounded(K.ranking_quality(K.score_blocks(risk(spark, sf), score="score", label="label")))


RULES = (("top_5_percent", 0.05), ("top_10_percent", 0.1), ("top_20_percent", 0.2))


@query(
    "threshold_metrics",
    f"""WITH {RISK_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY score DESC) AS i, count(*) OVER () AS n FROM risk),
t AS (
  {' UNION ALL '.join(f"SELECT '{n}' AS rule, min(score) AS threshold FROM r WHERE i <= greatest(1, ceil(n * {f}::DOUBLE))" for n, f in RULES)}
  UNION ALL SELECT 'full_recall', min(score) FROM risk WHERE label = 1)
SELECT rule, threshold, count(*) FILTER (score >= threshold) AS abstained_rows,
  round(count(*) FILTER (score >= threshold AND label = 1) / sum(label)::DOUBLE, 9) AS unsafe_recall,
  round(count(*) FILTER (score >= threshold AND label = 0) / count(*) FILTER (label = 0)::DOUBLE, 9)
    AS safe_abstention_rate FROM risk, t GROUP BY ALL""",
)
def threshold_metrics(spark, sf):
    blocks = K.score_blocks(risk(spark, sf), score="score", label="label")
    return rounded(K.threshold_table(blocks, score="score"))


@query(
    "loo_action_prior",
    f"""WITH {RISK_SQL}
SELECT doc_id, unit, action, round((sum(label) OVER (PARTITION BY action)
  - sum(label) OVER (PARTITION BY action, unit) + 1) / (count(*) OVER (PARTITION BY action)
  - count(*) OVER (PARTITION BY action, unit) + 2)::DOUBLE, 9) AS prior FROM risk""",
)
def loo_action_prior(spark, sf):
    p = K.leave_one_unit_out_prior(risk(spark, sf), unit="unit", action="action", label="label")
    return rounded(p.select("doc_id", "unit", "action", "prior"))


def baselines(spark, sf):
    return K.structural_baselines(
        risk(spark, sf), unit="unit", action="action", label="label", candidates="score",
        selected="quality",
    )


@query(
    "structural_baselines",
    f"""WITH {RISK_SQL},
x AS (SELECT label, unnest(['constant_prevalence', 'candidate_count', 'selected_count', 'action_prior']) AS baseline,
  unnest([(SELECT avg(label) FROM risk), score, quality::DOUBLE,
   (sum(label) OVER (PARTITION BY action) - sum(label) OVER (PARTITION BY action, unit) + 1)
    / (count(*) OVER (PARTITION BY action) - count(*) OVER (PARTITION BY action, unit) + 2)::DOUBLE]) AS s FROM risk),
b AS (SELECT baseline, s, sum(label)::BIGINT AS pos, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY baseline) AS p,
  sum(n) OVER (PARTITION BY baseline) AS t FROM b WINDOW w AS (PARTITION BY baseline ORDER BY s DESC))
SELECT baseline, max(t)::BIGINT AS rows, max(p)::BIGINT AS positives, round(max(p) / max(t)::DOUBLE, 9) AS prevalence,
  round(sum(cp / cn::DOUBLE * pos) / max(p), 9) AS average_precision,
  round(sum(pos * ((t - p) - (cn - cp) + 0.5::DOUBLE * (n - pos))) / (max(p) * max(t - p)), 9) AS roc_auc
FROM c GROUP BY baseline""",
)
def structural_baselines(spark, sf):
    blocks = K.score_blocks(baselines(spark, sf), score="score", label="label", keys=["baseline"])
    return rounded(K.ranking_quality(blocks, ["baseline"]))


# Every check compares the document length score with prevalence and baselines.
@query(
    "risk_gate",
    f"""WITH {RISK_SQL},
x AS (SELECT label, unnest(['model', 'constant', 'count', 'selected', 'prior']) AS who,
  unnest([score, (SELECT avg(label) FROM risk), score, quality::DOUBLE,
   (sum(label) OVER (PARTITION BY action) - sum(label) OVER (PARTITION BY action, unit) + 1)
    / (count(*) OVER (PARTITION BY action) - count(*) OVER (PARTITION BY action, unit) + 2)::DOUBLE]) AS s FROM risk),
b AS (SELECT who, s, sum(label)::BIGINT AS pos, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY who) AS p,
  sum(n) OVER (PARTITION BY who) AS t FROM b WINDOW w AS (PARTITION BY who ORDER BY s DESC)),
m AS (SELECT who, max(p) / max(t)::DOUBLE AS prev, sum(cp / cn::DOUBLE * pos) / max(p) AS ap,
  sum(pos * ((t - p) - (cn - cp) + 0.5::DOUBLE * (n - pos))) / (max(p) * max(t - p)) AS auc,
  min(cp) FILTER (cn >= greatest(1, ceil(t * 0.2::DOUBLE))) / max(p)::DOUBLE AS top20,
  max(cn - cp) FILTER (pos > 0) / max(t - p)::DOUBLE AS cost FROM c GROUP BY who),
o AS (SELECT a.*, (SELECT max(ap) FROM m WHERE who <> 'model') AS bap,
  (SELECT min(cost) FROM m WHERE who <> 'model') AS bcost FROM m a WHERE who = 'model')
SELECT unnest(['average_precision_at_least_twice_prevalence', 'roc_auc_at_least_0_75',
  'top_20_percent_recalls_all_unsafe', 'full_recall_abstains_at_most_20_percent_safe',
  'average_precision_exceeds_all_structural_baselines', 'full_recall_cost_beats_all_structural_baselines'])
  AS "check",
 unnest([ap >= 2 * prev, auc >= 0.75, top20 = 1, cost <= 0.2, ap > bap, cost < bcost]) AS passed FROM o""",
)
def risk_gate(spark, sf):
    blocks = materialize(K.score_blocks(risk(spark, sf), score="score", label="label"), "blocks")
    base = K.score_blocks(baselines(spark, sf), score="score", label="label", keys=["baseline"])
    base = materialize(base, "blocks")
    return K.risk_gate(
        K.ranking_quality(blocks), K.threshold_table(blocks, score="score"),
        K.ranking_quality(base, ["baseline"]),
        K.threshold_table(base, score="score", keys=["baseline"]),
    )


def context_rows(spark, sf):
    """Orders as contexts: lines are candidates, the first two by price are selected."""
    r = ranked(spark, sf, "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    n = F.col("l_linenumber").cast("double")
    return r.select(
        "decision",
        F.struct(
            *[F.lit(float(i)).alias(f) for i, f in enumerate(K.STATE_FIELDS[:-1])],
            F.lit(2.0).alias(K.STATE_FIELDS[-1]),
        ).alias("state"),
        F.col("baseline_rank").alias("position"),
        F.when(F.col("l_linenumber") == 6, F.lit(E.NAN)).otherwise(F.col("l_discount")).alias("efficacy"),
        F.col("l_tax").alias("obj_parallelism"), F.col("second").alias("cutoff_distance"),
        n.alias("nnz"), (n % 3).alias("n_int_cols"), F.col("score").alias("coeff_norm_l2"),
        (n * 2).alias("coeff_max_abs"), (n / 2).alias("coeff_std_abs"),
        F.when(F.col("l_linenumber") != 5, F.col("l_returnflag") == "R").alias("is_integral"),
        (F.col("l_linestatus") == "O").alias("is_local"),
        (F.col("l_returnflag") == "N").alias("in_global_cutpool"),
    )


RISK_COLUMNS = (
    "state_lp_cols", "state_selected_fraction", "state_lp_rows_per_col", "selected_efficacy_mean",
    "selected_nnz_max", "unselected_efficacy_max", "unselected_efficacy_min",
    "unselected_integral_fraction", "selected_global_pool_fraction", "removed_efficacy",
    "added_efficacy", "delta_coeff_norm_l2", "delta_is_integral", "removed_rank_fraction",
    "added_rank_fraction", "action_boundary_swap", "action_efficacy_promote",
)


@query(
    "action_features",
    f"""WITH {cand_sql('l_discount', 'l_returnflag')}, {RANKED_SQL},
x AS (SELECT decision, baseline_rank AS pos, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_discount END AS e,
   l_linenumber::DOUBLE AS nnz, score AS norm, CASE WHEN l_linenumber <> 5 THEN (l_returnflag = 'R')::INT END AS i,
   (l_returnflag = 'N')::INT AS g, count(*) OVER (PARTITION BY decision) AS n FROM ranked),
a AS (SELECT decision, any_value(n) AS n, avg(e) FILTER (pos <= 2) AS sem, max(nnz) FILTER (pos <= 2) AS snm,
   max(e) FILTER (pos > 2) AS uex, min(e) FILTER (pos > 2) AS uen, avg(i) FILTER (pos > 2) AS uif,
   avg(g) FILTER (pos <= 2) AS sgf,
   arg_min(pos, (coalesce(e, '-inf'::DOUBLE), -pos)) FILTER (pos <= 2) AS worst,
   arg_max(pos, (coalesce(e, '-inf'::DOUBLE), -pos)) FILTER (pos > 2) AS best
  FROM x WHERE n > 2 GROUP BY decision),
p AS (SELECT *, 'boundary-swap' AS action, 2 AS ro, 3 AS ad FROM a
  UNION ALL SELECT *, 'boundary-swap-2', 2, 4 FROM a WHERE n > 3
  UNION ALL SELECT a.*, 'efficacy-promote', worst, best FROM a JOIN x w ON w.decision = a.decision AND w.pos = worst
    JOIN x b ON b.decision = a.decision AND b.pos = best
    WHERE coalesce(b.e, '-inf'::DOUBLE) > coalesce(w.e, '-inf'::DOUBLE))
SELECT p.decision, action, 1::DOUBLE AS state_lp_cols, round(2 / p.n::DOUBLE, 9) AS state_selected_fraction,
  0::DOUBLE AS state_lp_rows_per_col, round(sem, 9) AS selected_efficacy_mean, snm AS selected_nnz_max,
  uex AS unselected_efficacy_max, uen AS unselected_efficacy_min,
  round(uif, 9) AS unselected_integral_fraction, round(sgf, 9) AS selected_global_pool_fraction,
  r.e AS removed_efficacy, d.e AS added_efficacy, round(d.norm - r.norm, 6) AS delta_coeff_norm_l2,
  (coalesce(d.i, 0) - coalesce(r.i, 0))::DOUBLE AS delta_is_integral,
  round((ro - 1) / p.n::DOUBLE, 9) AS removed_rank_fraction, round((ad - 1) / p.n::DOUBLE, 9) AS added_rank_fraction,
  (action = 'boundary-swap')::INT::DOUBLE AS action_boundary_swap,
  (action = 'efficacy-promote')::INT::DOUBLE AS action_efficacy_promote
FROM p JOIN x r ON r.decision = p.decision AND r.pos = ro JOIN x d ON d.decision = p.decision AND d.pos = ad""",
)
def action_features(spark, sf):
    f = K.action_features(context_rows(spark, sf), ["decision"])
    f = f.select(
        "decision", "action",
        *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in RISK_COLUMNS],
    )
    return rounded(rounded(f, 6, ["delta_coeff_norm_l2"]))


# ---- cohorts ------------------------------------------------------------------
POOL_SQL = f"""{UNITS_SQL.replace('AS split', 'AS split, c_acctbal AS elapsed, c_nationkey')},
pool AS (SELECT *, coalesce(nullif(grp, ''), 'officially-ungrouped:' || unit) AS cluster FROM units)"""


def pool(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("elapsed"), "c_nationkey"
    )
    return units(spark, sf).join(c, "unit").withColumn("cluster", E.cluster_key("grp", "unit"))


@query(
    "one_per_cluster_sample",
    f"""WITH {POOL_SQL},
f AS (SELECT *, sha256('plan|' || cluster || '|' || unit) AS h FROM pool),
o AS (SELECT DISTINCT ON (cluster) cluster, unit, h FROM f ORDER BY cluster, h)
SELECT cluster, unit FROM o ORDER BY h LIMIT 18""",
)
def one_per_cluster_sample(spark, sf):
    return W.one_per_cluster(pool(spark, sf), 18, cluster="cluster", unit="unit", key="plan")


@query(
    "ordered_cluster_sample",
    f"""WITH {POOL_SQL},
o AS (SELECT DISTINCT ON (cluster) cluster, unit, elapsed FROM pool
  WHERE cluster NOT IN (SELECT cluster FROM pool WHERE split = 'test') ORDER BY cluster, elapsed, unit)
SELECT cluster, unit, elapsed FROM o ORDER BY elapsed, unit LIMIT 30""",
)
def ordered_cluster_sample(spark, sf):
    p = pool(spark, sf)
    return W.one_per_cluster(
        p, 30, cluster="cluster", unit="unit", order=["elapsed", "unit"],
        excluded=p.where("split = 'test'").select("cluster").distinct(),
    ).select("cluster", "unit", "elapsed")


@query(
    "equal_rank_bins",
    """SELECT o_orderkey, ((row_number() OVER (ORDER BY o_totalprice, o_orderkey)) * 10 - 1)
   // (SELECT count(*) FROM orders) AS bin FROM orders""",
)
def equal_rank_bins(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return W.equal_rank_bins(o, ["o_totalprice", "o_orderkey"], 10).select("o_orderkey", "bin")


@query(
    "stratified_cohort",
    f"""WITH RECURSIVE {POOL_SQL},
o AS (SELECT DISTINCT ON (cluster) cluster, unit, elapsed FROM pool ORDER BY cluster, elapsed, unit),
lead30 AS (SELECT * FROM o ORDER BY elapsed, unit LIMIT 30),
rest AS (SELECT *, row_number() OVER (ORDER BY elapsed, unit) AS r, count(*) OVER () AS n FROM pool
  WHERE cluster NOT IN (SELECT cluster FROM lead30)),
binned AS (SELECT *, (r * 10 - 1) // n AS bin FROM rest),
pick AS (
  SELECT -1::BIGINT AS bin, NULL::BIGINT AS unit, []::VARCHAR[] AS used
  UNION ALL
  SELECT p.bin + 1, arg_min(b.unit, b.r), list_append(any_value(p.used), arg_min(b.cluster, b.r))
  FROM pick p JOIN binned b ON b.bin = p.bin + 1 AND NOT list_contains(p.used, b.cluster)
  GROUP BY p.bin)
SELECT NULL::BIGINT AS bin, cluster, unit, 'leading' AS stratum FROM lead30
UNION ALL SELECT bin, used[-1], unit, 'rank_bins' FROM pick WHERE bin >= 0""",
)
def stratified_cohort(spark, sf):
    return W.stratified_cohort(
        pool(spark, sf), cluster="cluster", unit="unit", order=["elapsed", "unit"]
    )


BLOCKS_SQL = """blocks AS (SELECT c_custkey AS unit, unnest([1, 2, 3])::BIGINT AS seed FROM customer)"""


def block_rows(spark, sf):
    return W.blocks(table(spark, sf, "customer").select(F.col("c_custkey").alias("unit")), [1, 2, 3])


@query("block_grid", f"WITH {BLOCKS_SQL} SELECT * FROM blocks")
def block_grid(spark, sf):
    return block_rows(spark, sf)


def schedule_sql(orders, key):
    rows = ", ".join("'" + ";".join(o) + "'" for o in orders)
    return f"""WITH {BLOCKS_SQL},
p AS (SELECT *, row_number() OVER (ORDER BY sha256('{key}|' || unit || '|' || seed)) - 1 AS i FROM blocks)
SELECT unit, seed, i % {len(orders)} AS design_row, ([{rows}])[(i % {len(orders)}) + 1] AS arm_order FROM p"""


DESIGNS = {
    "balanced_arm_schedule": (W.all_orders(["native", "shadow", "active"]), "k3"),
    "carryover_arm_schedule": (W.carryover_orders(["native", "a", "b", "c"]), "k4"),
    "alternating_arm_schedule": (W.alternating_orders(["native", "shadow"]), "k2"),
}
for _name, (_orders, _key) in DESIGNS.items():

    def _run(spark, sf, orders=_orders, key=_key):
        s = W.balanced_schedule(block_rows(spark, sf), orders, key)
        return s.withColumn("arm_order", F.array_join("arm_order", ";"))

    QUERIES[_name] = _run
    ORACLES[_name] = schedule_sql(_orders, _key)


@query(
    "position_balance",
    f"""WITH s AS ({schedule_sql(*DESIGNS['carryover_arm_schedule'])}),
e AS (SELECT string_split(arm_order, ';') AS a FROM s)
SELECT unnest(a) AS arm, (generate_subscripts(a, 1) - 1)::INT AS position, count(*) AS blocks FROM e GROUP BY ALL""",
)
def position_balance(spark, sf):
    orders, key = DESIGNS["carryover_arm_schedule"]
    return W.position_counts(W.balanced_schedule(block_rows(spark, sf), orders, key))


ORACLES["position_balance"] = f"""WITH s AS ({schedule_sql(*DESIGNS['carryover_arm_schedule'])}),
e AS (SELECT unnest([1, 2, 3, 4]) AS i, string_split(arm_order, ';') AS a FROM s)
SELECT a[i] AS arm, (i - 1)::INT AS position, count(*) AS blocks FROM e GROUP BY ALL"""


@query(
    "arm_order_hash",
    f"""WITH {BLOCKS_SQL}, x AS (SELECT unit, seed, unnest(['native', 'a', 'b']) AS arm FROM blocks)
SELECT unit, seed, string_agg(arm, ';' ORDER BY sha256('k|' || unit || '|' || seed || '|' || arm)) AS arm_order
FROM x GROUP BY ALL""",
)
def arm_order_hash(spark, sf):
    h = W.hashed_arm_order(block_rows(spark, sf), ["native", "a", "b"], "k")
    return h.withColumn("arm_order", F.array_join("arm_order", ";"))


@query(
    "candidate_pool",
    f"""WITH {POOL_SQL}
SELECT unit, cluster FROM pool p WHERE unit % 4 <> 0 AND unit % 7 <> 0 AND split <> 'train'
  AND cluster NOT IN (SELECT cluster FROM pool WHERE split = 'train')""",
)
def candidate_pool(spark, sf):
    p = pool(spark, sf)
    marked = p.where("split <> 'train'").select(
        "unit", "cluster", F.when(F.col("unit") % 4 == 0, "hard").otherwise("easy").alias("status"),
        F.when(F.col("unit") % 7 == 0, "big infeasible").otherwise("big").alias("tags"),
    )
    return W.eligible_pool(marked, p.where("split = 'train'")).select("unit", "cluster")


@query(
    "pool_assembly",
    f"""WITH {UNITS_SQL}, q AS (SELECT o_custkey AS unit, count(*) AS n_candidates FROM orders GROUP BY 1)
SELECT unit, grp, split, c_acctbal AS elapsed, n_candidates FROM units JOIN customer ON c_custkey = unit
JOIN q USING (unit) WHERE c_acctbal > 0""",
)
def pool_assembly(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("elapsed"),
        (F.col("c_acctbal") > 0).alias("ok"),
    )
    q = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(
        F.count(F.lit(1)).alias("n_candidates")
    )
    return W.assemble_pool(units(spark, sf), c, q)


def queue_rows(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("queue")
    )


@query(
    "cohort_overlap",
    """SELECT c_custkey AS unit, coalesce(q, '') AS prior_queues, q IS NOT NULL AS previously_evaluated
FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS q
  FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""",
)
def cohort_overlap(spark, sf):
    active = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"))
    prior = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("queue")
    )
    return W.cohort_overlap(active, prior)


@query(
    "overlap_by_queue",
    """SELECT o_orderpriority AS queue, count(DISTINCT o_custkey) AS units FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 0) GROUP BY 1""",
)
def overlap_by_queue(spark, sf):
    active = table(spark, sf, "customer").where("c_nationkey % 5 = 0").select(
        F.col("c_custkey").alias("unit")
    )
    return W.overlap_by_queue(active, queue_rows(spark, sf))


@query(
    "grouped_support",
    f"""WITH {POOL_SQL},
p AS (SELECT split, cluster, count(*) AS u FROM pool GROUP BY ALL),
t AS (SELECT DISTINCT cluster FROM pool WHERE split = 'train')
SELECT split, sum(u)::BIGINT AS units, count(*) AS clusters, count(*) FILTER (u > 1) AS repeated_clusters,
  count(*) FILTER (cluster IN (FROM t)) AS seen_in_training,
  count(*) FILTER (cluster NOT IN (FROM t)) AS unseen_in_training,
  bool_and(cluster NOT IN (FROM t)) AS strictly_out_of_family FROM p GROUP BY split""",
)
def grouped_support(spark, sf):
    from plumbline.operators.precision import cluster_support

    return cluster_support(pool(spark, sf))


FOLD_SQL = f"""WITH RECURSIVE {POOL_SQL},
q AS (SELECT o_custkey AS unit, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT cluster, count(*) AS units, sum(n)::BIGINT AS rows FROM pool JOIN q USING (unit) GROUP BY cluster),
o AS (SELECT *, row_number() OVER (ORDER BY units DESC, rows DESC, cluster) AS i FROM t),
go AS (
  SELECT 0::BIGINT AS i, NULL::VARCHAR AS cluster, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS u,
    [0, 0, 0, 0, 0]::BIGINT[] AS r
  UNION ALL
  SELECT o.i, o.cluster, f, list_transform(g.u, lambda x, k: x + CASE WHEN k = f + 1 THEN o.units ELSE 0 END),
    list_transform(g.r, lambda x, k: x + CASE WHEN k = f + 1 THEN o.rows ELSE 0 END)
  FROM (SELECT *, (list_sort(list_transform(range(5), lambda k: {{'a': u[k + 1], 'b': r[k + 1], 'c': k}})))[1].c::INT
          AS f FROM go) g JOIN o ON o.i = g.i + 1)
SELECT go.cluster, units, rows, fold FROM go JOIN t USING (cluster)"""


@query("cluster_folds", FOLD_SQL)
def cluster_folds(spark, sf):
    q = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(
        F.count(F.lit(1)).alias("n_candidates")
    )
    return W.cluster_folds(pool(spark, sf).join(q, "unit"), 5)


# ---- documents to rows --------------------------------------------------------------
@query(
    "html_link_rows",
    r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS hits FROM pages),
x AS (SELECT page_id, unnest(hits) AS hit, unnest(range(len(hits))) AS position FROM h)
SELECT page_id, position, regexp_extract(hit, 'href="([^"]*)"', 1) AS href, regexp_extract(hit, '>([^<>]*)</a>', 1) AS text
FROM x""",
)
def html_link_rows(spark, sf):
    return list_links(table(spark, sf, "pages"))


@query(
    "html_table_rows",
    """SELECT s_suppkey AS page_id, 0::INT AS row, s_name AS name, CASE WHEN s_nationkey % 3 = 0 THEN ''
  ELSE 'g' || s_nationkey END AS "group", 'a & b' AS note FROM supplier
UNION ALL SELECT s_suppkey, 1, 'x', '', s_nationkey::VARCHAR FROM supplier""",
)
def html_table_rows(spark, sf):
    s = table(spark, sf, "supplier")
    group = F.when(F.col("s_nationkey") % 3 == 0, "–").otherwise(F.concat(F.lit("g"), "s_nationkey"))
    page = F.concat(
        F.lit('<html><table id="other"><tbody><tr><td>no</td></tr></tbody></table>'
              '<table class="t" id="main"><thead><tr><th>n</th></tr></thead><tbody>\n<tr><td><b>'),
        "s_name", F.lit("</b></td>\n<td>"), group, F.lit("</td><td> a &amp;  b</td></tr><tr><td>x</td>"
                                                        "<td>-</td><td>"),
        "s_nationkey", F.lit("</td></tr></tbody></table></html>"),
    )
    pages = s.select(F.col("s_suppkey").alias("page_id"), page.alias("html"))
    return checked_cells(table_rows(pages, "main"), ["name", "group", "note"])
