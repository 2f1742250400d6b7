"""Ranking dataset, its evaluation, cross-validation and training."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import BOOLEAN_FEATURES, CATEGORICAL_FEATURES, PROHIBITED_FIELDS
from plumbline.functions import exprs as E
from plumbline.operators import bootstrap as B
from plumbline.operators import models as M
from plumbline.operators import ranking as R
from plumbline.operators import sampling as W
from plumbline.session import materialize


@dataclass(frozen=True)
class RankingDataset:
    rows: DataFrame
    queries: DataFrame
    contract: DataFrame
    profile: DataFrame
    labels: DataFrame
    balance: DataFrame


def build_ranking_dataset(
    decisions: DataFrame,
    candidates: DataFrame,
    *,
    decision_features: Sequence[str],
    candidate_features: Sequence[str],
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
    booleans: Sequence[str] = BOOLEAN_FEATURES,
    size: str = "n_logical",
) -> RankingDataset:
    """Eligible decisions and their candidates as weighted, labelled rows.

    The contract is fitted on training rows only: decision features count once
    per decision, candidate features once per candidate. ``decisions`` carries
    unit, split, evaluation_stratum; ``candidates`` label and score_rank_pre.
    """
    banned = sorted({*decision_features, *candidate_features} & set(PROHIBITED_FIELDS))
    if banned:
        raise ValueError(f"prohibited features: {banned}")
    chosen = R.eligible_decisions(decisions).withColumn(
        "subset", E.subset_name("split", "evaluation_stratum")
    )
    chosen = materialize(chosen, "eligible")
    carry = ["subset", "unit", *decision_features]
    columns = ["decision_id", "logical_candidate_id", "label", "score_rank_pre"]
    rows = R.candidates_of(
        candidates.select(*columns, *candidate_features), chosen, columns=carry
    )
    # Read three times: counts, contract and the matrix itself.
    rows = materialize(rows, "ranking-rows")
    count = R.candidate_count_check(rows, chosen, expected=size)
    if not count.first()["passed"]:
        raise ValueError("candidate rows do not match the decisions' counts")
    train_q, train_c = chosen.where("subset = 'train'"), rows.where("subset = 'train'")

    def numeric(names):
        return [f for f in names if f not in categorical]

    audits = [
        R.numeric_audit(train_q, numeric(decision_features), booleans),
        R.numeric_audit(train_c, numeric(candidate_features), booleans),
    ]
    values = R.category_counts(train_q, [f for f in decision_features if f in categorical])
    values = values.unionByName(
        R.category_counts(train_c, [f for f in candidate_features if f in categorical])
    )
    order = [*numeric(decision_features), *numeric(candidate_features)]
    contract = materialize(
        R.encoded_features(audits, R.vocabulary(values), order, categorical), "contract"
    )
    matrix = R.assemble(rows, contract, booleans).select(*columns, "subset", "unit", "features")
    y = F.col("label").cast("bigint")
    queries = materialize(
        rows.groupBy("subset", "unit", "decision_id").agg(
            F.count(F.lit(1)).alias("n_candidates"), F.sum(y).alias("n_positives")
        ),
        "ranking-queries",
    )
    active = (F.col("n_positives") > 0) & (F.col("n_positives") < F.col("n_candidates"))
    weighted = None
    for (subset,) in queries.select("subset").distinct().collect():  # seven names at most
        one = R.unit_balanced_weights(
            queries.where(F.col("subset") == subset),
            weights={"query_weight": None, "effective_weight": active},
        )
        weighted = one if weighted is None else weighted.unionByName(one)
    return RankingDataset(
        matrix,
        weighted,
        contract,
        R.concentration(queries, ["subset"]),
        R.label_profile(queries, ["subset"], subset="subset"),
        R.weight_balance(weighted.where("subset = 'train'")),
    )


def derive_feature_subset(
    rows: DataFrame, contract: Sequence[str], keep: Sequence[str], dropped: Sequence[str],
    others: Sequence[str],
) -> DataFrame:
    return R.select_subset(rows, contract, keep, dropped, others)


def evaluate_ranking(
    rows: DataFrame, *, score: str, baseline_rank: str = "baseline_rank", label: str = "label",
    query: str = "decision", unit: str = "unit", replicates: int = 5000, seed: int = 0,
) -> DataFrame:
    """Model against baseline per metric: unit-equal means, delta and interval.

    Metrics are bootstrapped over the same unit draws, one key per metric.
    """
    base = rows.withColumn("_neg", -F.col(baseline_rank))
    sides = [
        R.query_metrics(base, query=[query], score=s, baseline_rank=baseline_rank, label=label,
                        carry=[unit])
        for s in ("_neg", score)
    ]
    deltas = materialize(R.unit_deltas(*sides, unit=unit), "unit-deltas")
    place = F.array_position(F.array(*[F.lit(m) for m in R.METRICS]), F.col("metric")) - 1
    drawn = B.multinomial_replicates(
        deltas, keys=["metric"], item=unit, numerator="delta", count=replicates,
        seed=F.lit(seed) + place,
    )
    point = deltas.groupBy("metric").agg(
        F.count(F.lit(1)).alias("units"),
        *[F.avg(c).alias(c) for c in ("baseline", "model", "delta")],
    )
    return point.join(B.delta_interval(drawn, keys=["metric"]), "metric")


def cross_validate_ranking(
    rows: DataFrame, folds: int, *, features: Sequence[str], query: str = "decision",
    unit: str = "unit", cluster: str = "cluster", label: str = "label",
    baseline_rank: str = "baseline_rank", rounds: int = 20, replicates: int = 5000,
) -> tuple[DataFrame, DataFrame]:
    """Cluster-disjoint folds, one model per fold, each query scored once."""
    sizes = rows.groupBy(query, unit, cluster).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.sum(label).alias("_p")
    )
    effective = sizes.where((F.col("_p") > 0) & (F.col("_p") < F.col("n_candidates")))
    plan = W.cluster_folds(effective, folds, cluster=cluster, unit=unit)
    keyed = W.assign_folds(R.unit_balanced_weights(effective, unit=unit), plan, cluster=cluster)
    joined = rows.join(keyed.select(query, "fold", "query_weight"), query)
    scored = materialize(
        M.out_of_fold(joined, label=label, features=features, weight="query_weight",
                      rounds=rounds),
        "scored",
    )
    table = M.cross_validated_comparison(
        scored, query=query, unit=unit, cluster=cluster, label=label, baseline_rank=baseline_rank,
        replicates=replicates,
    )
    return table, M.ranking_gate(table)


def train_ranker(
    rows: DataFrame, *, features: Sequence[str], grid: Sequence[int], label: str = "label",
    query: str = "decision", unit: str = "unit", baseline_rank: str = "baseline_rank",
    weight: str = "query_weight", fold: str = "fold",
):
    """Freeze the rounds by inner folds, then fit on every training row."""
    rounds = M.best_rounds(
        rows, label=label, features=features, query=query, unit=unit,
        baseline_rank=baseline_rank, grid=grid, fold=fold, weight=weight,
    )
    ready = M.as_vector(rows, features)
    scored, gains = M.fit_score(ready, ready, label=label, weight=weight, rounds=rounds)
    return rounds, scored, M.importance_table(rows.sparkSession, gains, features)
