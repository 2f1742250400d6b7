"""Learned scores: no SQL engine trains the same trees, so SQL tells only what is certain."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries_ranking import ranked
from checks.views import cand_sql, risk
from plumbline.functions import exprs as E
from plumbline.operators import boosting as L
from plumbline.operators import models as M
from plumbline.operators import ranking as R
from plumbline.operators import risk as K
from plumbline.operators import sampling as W
from plumbline.session import materialize

QUERIES, ORACLES = {}, {}
FEATURES = ["score", "second", "score_rank_fraction", "l_discount"]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def folded(spark, sf, folds=3):
    rows = ranked(spark, sf, "l_discount").where("split = 'train'")
    rows = rows.withColumn("cluster", F.concat(F.lit("f"), F.floor(F.col("unit") / 2).cast("string")))
    sizes = rows.groupBy("decision", "unit", "cluster").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.sum("label").alias("p")
    )
    effective = sizes.where("p > 0 AND p < n_candidates")
    weighted = R.unit_balanced_weights(effective)
    table = W.cluster_folds(effective, folds)
    queries = W.assign_folds(weighted, table).select("decision", "fold", "query_weight")
    return rows.join(queries, "decision")


def scored(spark, sf):
    return M.out_of_fold(
        folded(spark, sf), label="label", features=FEATURES, weight="query_weight", rounds=5
    )


@query("ranker_scores")
def ranker_scores(spark, sf):
    return scored(spark, sf).select("decision", "l_partkey", "fold", "label", "model_score")


@query("ranker_cv")
def ranker_cv(spark, sf):
    return M.cross_validated_comparison(
        scored(spark, sf), query="decision", unit="unit", cluster="cluster", label="label",
        baseline_rank="baseline_rank", replicates=200,
    )


@query("ranker_gate")
def ranker_gate(spark, sf):
    return M.ranking_gate(ranker_cv(spark, sf))


@query("oof_scores")
def oof_scores(spark, sf):
    rows = risk(spark, sf).withColumn("n_candidates", F.lit(1))
    folds = W.cluster_folds(rows.withColumn("cluster", F.col("unit")), 3, unit="unit")
    rows = rows.join(folds.select(F.col("cluster").alias("unit"), "fold"), "unit")
    rows = rows.withColumn("quality", F.coalesce(F.col("quality").cast("double"), F.lit(E.NAN)))
    out = M.out_of_fold(rows, label="label", features=["score", "quality"], rounds=5)
    return out.select("doc_id", "unit", "fold", "label", "model_score")


@query("oof_risk_quality")
def oof_risk_quality(spark, sf):
    blocks = K.score_blocks(oof_scores(spark, sf), score="model_score", label="label")
    return K.ranking_quality(blocks)


@query(
    "listwise_ranker",
    f"""WITH {cand_sql()}
SELECT unit % 3 AS fold, count(*) AS rows, count(DISTINCT decision) AS decisions, true AS each_row_once,
  true AS kept_round_is_first_best, true AS ended_in_time, true AS scores_are_of_kept_round FROM cand GROUP BY 1""",
)
def listwise_ranker(spark, sf, rounds=4, patience=2):
    """Out-of-fold scores of the listwise ranker, held against its own written history."""
    rows = ranked(spark, sf, "l_discount").withColumn("fold", F.col("unit") % 3)
    key = ["decision", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    scores, history, _ = L.out_of_fold_ranking(
        rows, fold="fold", keep=[*key, "unit", "label", "baseline_rank"], query="decision", unit="unit", label="label",
        baseline_rank="baseline_rank", features=FEATURES, rounds=rounds, patience=patience, depth=3, rate=0.3, bins=32,
    )
    scores = materialize(scores, "scores")
    counts = scores.groupBy("fold", *key).agg(F.count(F.lit(1)).alias("n")).groupBy("fold").agg(
        F.sum("n").alias("rows"), F.countDistinct("decision").alias("decisions"),
        (F.max("n") == 1).alias("each_row_once"),
    )
    told = history.groupBy("fold").agg(
        F.max("metric").alias("best"), F.min(F.when(F.col("kept"), F.col("round"))).alias("kept"),
        F.max("round").alias("last"), F.max(F.when(F.col("kept"), F.col("metric"))).alias("kept_metric"),
    )
    first = history.join(told.select("fold", "best"), "fold").where("metric = best").groupBy("fold").agg(
        F.min("round").alias("first")
    )
    metrics = R.query_metrics(
        scores, query=["decision"], score="model_score", baseline_rank="baseline_rank", label="label", carry=["unit", "fold"]
    )
    again = metrics.groupBy("fold", "unit").agg(F.avg("ndcg_10").alias("m")).groupBy("fold").agg(F.avg("m").alias("again"))
    joined = counts.join(told, "fold").join(first, "fold").join(again, "fold")
    return joined.select(
        "fold", "rows", "decisions", "each_row_once", (F.col("kept") == F.col("first")).alias("kept_round_is_first_best"),
        ((F.col("last") == rounds) | (F.col("last") - F.col("kept") == patience)).alias("ended_in_time"),
        (F.abs(F.col("again") - F.col("kept_metric")) < 1e-9).alias("scores_are_of_kept_round"),
    )
