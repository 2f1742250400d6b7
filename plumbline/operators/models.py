"""Learned scores on Spark ML, trained and applied per fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import bootstrap as B
from plumbline.operators import ranking as R
from plumbline.operators.gates import check_rows
from plumbline.operators.ordering import deal
from plumbline.session import materialize


def as_vector(rows: DataFrame, features: Sequence[str], *, out: str = "vector") -> DataFrame:
    """Dense vector; a missing value becomes zero beside an indicator, because the
    trees here do not treat NaN as missing."""
    cells = []
    for f in features:
        c = F.col(f).cast("double")
        gone = c.isNull() | F.isnan(c)
        cells += [F.when(gone, 0.0).otherwise(c), gone.cast("double")]
    return rows.withColumn(out, array_to_vector(F.array(*cells)))


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Positives weigh negatives/positives; one class alone is an error."""
    counts = train.agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    ).first()
    if not counts["p"] or not counts["n"]:
        raise ValueError("a training fold has one class only")
    ratio = counts["n"] / counts["p"]
    return train.withColumn("weight", F.when(F.col(label) == 1, F.lit(ratio)).otherwise(1.0))


def fit_score(train: DataFrame, test: DataFrame, *, label: str, weight: str, rounds: int = 20,
              depth: int = 3, seed: int = 20260716, out: str = "model_score"):
    """Fit on one frame, score the other; returns (scored, importances)."""
    model = GBTClassifier(
        featuresCol="vector", labelCol=label, weightCol=weight, maxIter=rounds, maxDepth=depth,
        seed=seed,
    ).fit(train)
    scored = model.transform(test).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction"), model.featureImportances


def out_of_fold(
    rows: DataFrame, *, label: str, features: Sequence[str], fold: str = "fold",
    weight: str | None = None, rounds: int = 20, depth: int = 3, seed: int = 20260716,
) -> DataFrame:
    """Every row scored once, by a model that saw none of its fold.

    The loop is over folds, a handful; rows are written once so each fit
    re-reads them instead of rebuilding them. A fit holds what it reads as points, far
    larger than the files, so its rows are dealt into tasks of a fixed size.
    """
    rows = materialize(as_vector(rows, features), "oof")
    total = rows.count()
    ids = [r[0] for r in rows.where(F.col(fold) >= 0).select(fold).distinct().collect()]
    scored = None
    for f in sorted(ids):
        train = rows.where((F.col(fold) != f) & (F.col(fold) >= 0))
        train = class_weights(train, label) if weight is None else train
        train = deal(train.select("vector", label, weight or "weight"), [], total)
        part, _ = fit_score(
            train, rows.where(F.col(fold) == f), label=label, weight=weight or "weight",
            rounds=rounds, depth=depth, seed=seed + int(f),
        )
        scored = part if scored is None else scored.unionByName(part)
    return scored.drop("vector")


def importance_table(spark, importances, names: Sequence[str], top: int = 20) -> DataFrame:
    """Largest gains by (falling gain, name); one row per feature, so driver-sized."""
    gains: dict[str, float] = {}
    values = importances.toArray()
    for i, value in enumerate(values):
        gains[names[i // 2]] = gains.get(names[i // 2], 0.0) + float(value)
    frame = spark.createDataFrame(list(gains.items()), "feature string, gain double")
    return frame.orderBy(F.desc("gain"), "feature").limit(top)


def cross_validated_comparison(
    scored: DataFrame, *, query: str, unit: str, cluster: str, label: str, baseline_rank: str,
    score: str = "model_score", replicates: int = 400, seed: int = 1,
) -> DataFrame:
    """Metric, mean delta and cluster-bootstrap interval of model against baseline."""
    base = scored.withColumn("_neg", -F.col(baseline_rank))
    sides = {}
    for name, s in (("baseline", "_neg"), ("model", score)):
        sides[name] = R.query_metrics(
            base, query=[query], score=s, baseline_rank=baseline_rank, label=label,
            carry=[unit, cluster],
        )
    deltas = R.unit_deltas(sides["baseline"], sides["model"], unit=unit)
    clusters = scored.select(unit, cluster).distinct()
    deltas = materialize(deltas.join(clusters, unit), "deltas")
    sums = B.cluster_sums(deltas, keys=["metric"], cluster=cluster, value="delta")
    drawn = B.multinomial_replicates(
        sums, keys=["metric"], item=cluster, numerator="value_sum", denominator="value_count",
        count=replicates, seed=seed,
    )
    point = deltas.groupBy("metric").agg(
        F.count(F.lit(1)).alias("units"),
        F.avg("baseline").alias("baseline"),
        F.avg("model").alias("model"),
        F.avg("delta").alias("delta"),
        F.avg((F.col("delta") > 0).cast("double")).alias("win_fraction"),
        F.avg((F.col("delta") == 0).cast("double")).alias("tie_fraction"),
        F.avg((F.col("delta") < 0).cast("double")).alias("loss_fraction"),
    )
    return point.join(B.delta_interval(drawn, keys=["metric"]), "metric")


def scored_once(scored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows scored more than once; must be empty."""
    return scored.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ranking_gate(primary: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Does the model improve on the baseline where it counts?

    A row per metric is written first: each check would compute the comparison anew."""
    primary = materialize(primary, "primary")
    seen = seen if seen is None else materialize(seen, "seen")

    def at(frame, metric, c):
        return frame.where(F.col("metric") == metric).agg(F.max(c)).scalar()

    one = primary.groupBy().agg(F.count(F.lit(1)).alias("_n")).select(
        at(primary, "ndcg_10", "delta").alias("ndcg"),
        at(primary, "ndcg_10", "ci95_lower").alias("low"),
        at(primary, "selection_overlap", "delta").alias("overlap"),
        *([] if seen is None else [
            at(seen, "ndcg_10", "delta").alias("seen_ndcg"),
            at(seen, "selection_overlap", "delta").alias("seen_overlap"),
        ]),
    )
    checks = {
        "ndcg10_improves": F.col("ndcg") > 0,
        "ndcg10_ci95_excludes_zero": F.col("low") > 0,
        "selection_overlap_improves": F.col("overlap") > 0,
    }
    if seen is not None:
        checks["seen_ndcg10_does_not_regress"] = F.col("seen_ndcg") >= 0
        checks["seen_overlap_does_not_regress"] = F.col("seen_overlap") >= 0
    return check_rows(one, checks)


def best_rounds(
    rows: DataFrame, *, label: str, features: Sequence[str], query: str, unit: str,
    baseline_rank: str, grid: Sequence[int], fold: str = "fold", weight: str | None = None,
) -> int:
    """Rounds to freeze: per fold the best of the grid by anchored overlap, then
    the median over folds, truncated."""
    per_fold: dict[int, list[tuple[float, int]]] = {}
    for rounds in grid:
        scored = out_of_fold(
            rows, label=label, features=features, fold=fold, weight=weight, rounds=rounds
        )
        lifted = R.anchored_score(
            scored, query=[query], score="model_score", baseline_rank=baseline_rank
        )
        m = R.query_metrics(
            lifted, query=[query], score="anchored_score", baseline_rank=baseline_rank,
            label=label, carry=[unit, fold],
        )
        means = m.groupBy(fold, unit).agg(F.avg("selection_overlap").alias("v"))
        for r in means.groupBy(fold).agg(F.avg("v").alias("v")).collect():
            per_fold.setdefault(r[fold], []).append((r["v"], rounds))
    best = sorted(max(v, key=lambda x: (x[0], -x[1]))[1] for v in per_fold.values())
    mid = len(best) // 2
    return int(best[mid] if len(best) % 2 else (best[mid - 1] + best[mid]) / 2)
