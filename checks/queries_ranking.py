"""Decision tables, ranking datasets and ranking metrics over ``cand`` and ``occ``."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import (
    OCC_SEQ, OCC_SQL, RANKED_SQL, SEQ, cand, cand_rows, cand_sql, occ, scan_rows, table,
)
from plumbline.operators import decisions as D
from plumbline.operators import ranking as R
from plumbline.operators.ordering import deal

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df, digits=9, only=None):
    """Summation order differs between engines; reported doubles keep 9 digits."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" and (only is None or c in only) else c
            for c, t in df.dtypes
        ]
    )


def ranked(spark, sf, *extra):
    c = cand(spark, sf, *extra)
    return D.score_rank(
        c, decision=["decision"], score="score", ties=["l_linenumber", "l_partkey", "l_suppkey"]
    ).withColumnRenamed("score_rank", "baseline_rank")


# ---- decision tables ----------------------------------------------------
def logical_of(o, rows=None):
    """Collapsed candidates, dealt by decision for ``rows`` rows (their own, if not given)."""
    return D.collapse_duplicates(
        o.where(~F.col("forced")),
        decision=["unit", "run", "decision", "split"],
        source_id="source_id",
        signature="signature",
        applied="applied",
        sequence=OCC_SEQ,
        carry=["score"],
        dealt_rows=rows,
    )


def decisions_of(spark, sf, o, logical):
    summary = D.decision_summary(
        o, logical, decision=["unit", "run", "decision", "split"], forced="forced"
    )
    orders = table(spark, sf, "orders")
    # Dealt by the key alone, so that the decisions come to as many tasks.
    states = deal(
        orders.where("o_orderstatus <> 'P'").select(
            F.col("o_orderkey").alias("decision"), "o_totalprice", "o_orderdate"
        ),
        ["decision"], cand_rows(spark, sf),
    )
    stated = D.attach_pre_state(
        summary, states, key=["decision"], fields=["o_totalprice"],
        sequence=["o_orderdate", "o_totalprice"],
    )
    return D.run_flags(stated, run=["unit", "run"], sequence=["decision"])


@query(
    "duplicate_collapse",
    f"""WITH {OCC_SQL}
SELECT decision, source_id, signature, multiplicity, first_l_extendedprice, score,
        observed_applied, labels_consistent, id_collision FROM collided""",
)
def duplicate_collapse(spark, sf):
    return logical_of(occ(spark, sf), cand_rows(spark, sf)).select(
        "decision", "source_id", "signature", "multiplicity", "first_l_extendedprice", "score",
        "observed_applied", "labels_consistent", "id_collision",
    )


FLAG_COLUMNS = (
    "unit", "run", "decision", "n_candidate_occurrences", "n_forced", "n_logical",
    "n_applied_logical", "has_collision", "n_collapsed", "n_inconsistent",
    "n_collision_candidates", "n_duplicate_occurrences",
)


@query(
    "decision_summary",
    f"WITH {OCC_SQL} SELECT {', '.join(FLAG_COLUMNS)} FROM summary",
)
def decision_summary(spark, sf):
    o = occ(spark, sf)
    return D.decision_summary(
        o, logical_of(o, cand_rows(spark, sf)), decision=["unit", "run", "decision", "split"], forced="forced"
    ).select(*FLAG_COLUMNS)


@query(
    "first_eligible_per_run",
    f"""WITH {OCC_SQL}
SELECT unit, run, decision, pre_state_available, is_first_in_run, is_eligible FROM flagged""",
)
def first_eligible_per_run(spark, sf):
    o = occ(spark, sf)
    return decisions_of(spark, sf, o, logical_of(o, cand_rows(spark, sf))).select(
        "unit", "run", "decision", "pre_state_available", "is_first_in_run", "is_eligible"
    )


@query(
    "pre_state_join",
    """SELECT c.o_orderkey AS decision, s.o_totalprice AS state_price,
       s.o_orderkey IS NOT NULL AS pre_state_available
FROM orders c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') s
  ON c.o_orderkey = s.o_orderkey""",
)
def pre_state_join(spark, sf):
    o = table(spark, sf, "orders")
    states = o.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("decision"), F.col("o_totalprice").alias("state_price"),
        "o_orderdate",
    )
    return D.attach_pre_state(
        o.select(F.col("o_orderkey").alias("decision")), states, key=["decision"],
        fields=["state_price"], sequence=["o_orderdate", "state_price"],
    )


COUNTERS_SQL = """counters AS (
  SELECT count(*) AS decisions, sum(n_candidate_occurrences + n_forced)::BIGINT AS root_rows,
         sum(n_candidate_occurrences)::BIGINT AS optional_rows, sum(n_forced)::BIGINT AS forced_rows,
         sum(n_logical)::BIGINT AS logical_candidates,
         sum(n_duplicate_occurrences)::BIGINT AS duplicate_occurrences,
         count(*) FILTER (n_collapsed > 0) AS decisions_with_duplicates,
         count(*) FILTER (has_collision) AS decisions_with_collision,
         sum(n_collision_candidates)::BIGINT AS collision_candidates,
         sum(n_applied_logical)::BIGINT AS applied_labels,
         sum(n_inconsistent)::BIGINT AS inconsistent_candidates,
         count(*) FILTER (pre_state_available) AS decisions_with_state,
         count(*) FILTER (is_eligible) AS eligible_decisions,
         coalesce(sum(n_logical) FILTER (is_eligible), 0)::BIGINT AS eligible_candidates,
         count(*) FILTER (is_eligible AND NOT pre_state_available) AS eligible_without_state,
         count(*) FILTER (is_eligible AND has_collision) AS eligible_with_collision
  FROM flagged)"""


@query("build_counters", f"WITH {OCC_SQL}, {COUNTERS_SQL} SELECT * FROM counters")
def build_counters(spark, sf):
    o = occ(spark, sf)
    return D.build_counters(decisions_of(spark, sf, o, logical_of(o, cand_rows(spark, sf))))


@query(
    "accounting_checks",
    f"""WITH {OCC_SQL}, {COUNTERS_SQL},
t AS (SELECT *, (SELECT count(*) FROM lineitem) AS src, (SELECT count(*) FROM logical) AS written
      FROM counters)
SELECT unnest(['root_rows_match_source', 'root_equals_optional_plus_forced',
               'optional_equals_logical_plus_duplicates', 'written_equals_logical',
               'eligible_not_above_decisions', 'eligible_have_state',
               'eligible_have_no_collision', 'labels_not_above_candidates']) AS "check",
       unnest([root_rows = src, root_rows = optional_rows + forced_rows,
               optional_rows = logical_candidates + duplicate_occurrences,
               written = logical_candidates, eligible_decisions <= decisions,
               eligible_without_state = 0, eligible_with_collision = 0,
               applied_labels <= logical_candidates]) AS passed FROM t""",
)
def accounting_checks(spark, sf):
    o = occ(spark, sf)
    logical = logical_of(o, cand_rows(spark, sf))
    counters = D.build_counters(decisions_of(spark, sf, o, logical))
    return D.accounting_checks(counters, table(spark, sf, "lineitem"), logical)


@query(
    "score_rank_pre",
    f"""WITH {cand_sql()}, {RANKED_SQL}
SELECT decision, l_partkey, score, baseline_rank,
       round((baseline_rank - 1) / greatest(count(*) OVER (PARTITION BY decision) - 1, 1)::DOUBLE, 9)
         AS score_rank_fraction FROM ranked""",
)
def score_rank_pre(spark, sf):
    return rounded(ranked(spark, sf), only=["score_rank_fraction"]).select(
        "decision", "l_partkey", "score", "baseline_rank", "score_rank_fraction"
    )


@query(
    "duplicate_occurrence_flags",
    f"""WITH {OCC_SQL},
marked AS (SELECT *, row_number() OVER (PARTITION BY decision, source_id ORDER BY seq) AS nth FROM occ)
SELECT decision, count(*) AS rows, count(*) FILTER (nth > 1) AS duplicate_rows,
       count(*) FILTER (nth > 1 AND applied) AS duplicate_applied_rows
FROM marked GROUP BY decision""",
)
def duplicate_occurrence_flags(spark, sf):
    return D.duplicate_occurrences(
        scan_rows(spark, sf), decision=["decision"], source_id="source_id", applied="applied",
        sequence=OCC_SEQ,
    )


@query(
    "contiguity_islands",
    f"""WITH {cand_sql()},
marked AS (SELECT unit, run, lag(run) OVER (PARTITION BY unit ORDER BY decision, l_linenumber,
             l_partkey, l_suppkey, l_extendedprice) AS prior FROM cand)
SELECT unit, count(*) FILTER (prior IS NULL OR prior <> run) AS islands,
       count(DISTINCT run) AS distinct_keys,
       count(*) FILTER (prior IS NULL OR prior <> run) = count(DISTINCT run) AS contiguous
FROM marked GROUP BY unit""",
)
def contiguity_islands(spark, sf):
    return D.contiguity(
        cand(spark, sf), source=["unit"], key=["run"], sequence=["decision", *SEQ]
    )


# ---- ranking datasets ---------------------------------------------------
@query(
    "unit_balanced_weights",
    f"""WITH {cand_sql()},
q AS (SELECT unit, decision, count(*) AS n_candidates, sum(label)::BIGINT AS n_positives
      FROM cand WHERE split = 'train' GROUP BY ALL),
w AS (SELECT *, n_positives > 0 AND n_positives < n_candidates AS active,
        count(*) OVER (PARTITION BY unit) AS mine,
        count(*) FILTER (n_positives > 0 AND n_positives < n_candidates)
          OVER (PARTITION BY unit) AS mine_active FROM q)
SELECT unit, decision, round((SELECT count(*) FROM q) /
         ((SELECT count(DISTINCT unit) FROM q) * mine)::DOUBLE, 9) AS query_weight,
       CASE WHEN active THEN round((SELECT count(*) FROM w WHERE active) /
         ((SELECT count(DISTINCT unit) FROM w WHERE active) * mine_active)::DOUBLE, 9)
         ELSE 0::DOUBLE END AS effective_weight FROM w""",
)
def unit_balanced_weights(spark, sf):
    q = (
        cand(spark, sf).where("split = 'train'").groupBy("unit", "decision")
        .agg(F.count(F.lit(1)).alias("n_candidates"), F.sum("label").alias("n_positives"))
    )
    active = (F.col("n_positives") > 0) & (F.col("n_positives") < F.col("n_candidates"))
    w = R.unit_balanced_weights(q, weights={"query_weight": None, "effective_weight": active})
    return rounded(w.select("unit", "decision", "query_weight", "effective_weight"))


@query(
    "weight_balance",
    f"""WITH {cand_sql()},
q AS (SELECT DISTINCT unit, decision FROM cand WHERE split = 'train')
SELECT count(DISTINCT unit) AS units,
       round(count(*) / count(DISTINCT unit)::DOUBLE, 6) AS min_weight,
       round(count(*) / count(DISTINCT unit)::DOUBLE, 6) AS max_weight,
       true AS balanced FROM q""",
)
def weight_balance(spark, sf):
    q = cand(spark, sf).where("split = 'train'").select("unit", "decision").distinct()
    return rounded(R.weight_balance(R.unit_balanced_weights(q)), 6)


TOPK = (1, 5, 10, 20)


@query(
    "topk_capture",
    f"""WITH {cand_sql()}, {RANKED_SQL}
SELECT split, sum(label)::BIGINT AS positives,
       {', '.join(f'sum(label) FILTER (baseline_rank <= {k})::BIGINT AS top_{k}' for k in TOPK)},
       {', '.join(f'round(sum(label) FILTER (baseline_rank <= {k}) / sum(label)::DOUBLE, 9) AS recall_{k}' for k in TOPK)}
FROM ranked GROUP BY split""",
)
def topk_capture(spark, sf):
    return rounded(R.top_k_capture(ranked(spark, sf), ["split"], rank="baseline_rank", label="label"))


def metrics_sql(score: str, source: str = "ranked") -> str:
    ndcg = ", ".join(
        f"sum(CASE WHEN r <= {k} THEN label / log2(r + 1) END) / "
        f"list_sum(list_transform(range(1, least(any_value(p), {k})::BIGINT + 1), "
        f"lambda i: 1 / log2(i + 1))) AS ndcg_{k}"
        for k in TOPK
    )
    recall = ", ".join(
        f"sum(label) FILTER (r <= {k}) / any_value(p)::DOUBLE AS recall_{k}" for k in TOPK
    )
    return f"""placed AS (
  SELECT unit, decision, label, row_number() OVER w AS r, sum(label) OVER w AS hits,
         sum(label) OVER (PARTITION BY decision) AS p, count(*) OVER (PARTITION BY decision) AS n
  FROM {source} WINDOW w AS (PARTITION BY decision ORDER BY {score} DESC, baseline_rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
metrics AS (
  SELECT unit, decision, count(*) AS n_candidates, sum(label)::BIGINT AS n_positives, {ndcg},
         {recall}, sum(hits / r::DOUBLE) FILTER (label = 1) / any_value(p) AS average_precision,
         count(*) FILTER (label = 1 AND r <= p) / any_value(p)::DOUBLE AS selection_overlap
  FROM placed WHERE p > 0 AND p < n GROUP BY unit, decision)"""


def rounded_list(names, fn="{0}"):
    return ", ".join(f"round({fn.format(m)}, 9) AS {m}" for m in names)


def metrics(spark, sf, score="second", rows=None):
    return R.query_metrics(
        ranked(spark, sf) if rows is None else rows,
        query=["decision"], score=score, baseline_rank="baseline_rank", label="label",
        carry=["unit"],
    )


@query(
    "query_ranking_metrics",
    f"""WITH {cand_sql()}, {RANKED_SQL}, {metrics_sql('second')}
SELECT unit, decision, n_candidates, n_positives, {rounded_list(R.METRICS)} FROM metrics""",
)
def query_ranking_metrics(spark, sf):
    return rounded(metrics(spark, sf))


@query(
    "unit_equal_metrics",
    f"""WITH {cand_sql()}, {RANKED_SQL}, {metrics_sql('second')},
u AS (SELECT unit, count(*) AS queries, {', '.join(f'avg({m}) AS {m}' for m in R.METRICS)}
      FROM metrics GROUP BY unit)
SELECT count(*) AS units, sum(queries)::BIGINT AS queries, {rounded_list(R.METRICS, 'avg({0})')}
FROM u""",
)
def unit_equal_metrics(spark, sf):
    return rounded(R.unit_equal_mean(metrics(spark, sf)))


@query(
    "anchored_metrics",
    f"""WITH {cand_sql()}, {RANKED_SQL},
lifted AS (SELECT *, CASE WHEN baseline_rank = 1
    THEN max(second) OVER (PARTITION BY decision)
       + greatest(abs(max(second) OVER (PARTITION BY decision)), 1)
    ELSE second END AS anchored FROM ranked),
{metrics_sql('anchored', 'lifted')}
SELECT unit, decision, n_candidates, n_positives, {rounded_list(R.METRICS)} FROM metrics""",
)
def anchored_metrics(spark, sf):
    rows = R.anchored_score(
        ranked(spark, sf), query=["decision"], score="second", baseline_rank="baseline_rank"
    )
    return rounded(metrics(spark, sf, "anchored_score", rows))
