"""Sample sizes and detectable effects as columns over scenario rows."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.operators.ordering import with_positions


def critical_value(alpha: float = 0.05, power: float = 0.80) -> float:
    normal = NormalDist()
    return normal.inv_cdf(1.0 - alpha) + normal.inv_cdf(power)


def zero_failure_size(cap, confidence: float = 0.95) -> Column:
    """Smallest n whose zero-failure upper bound is within the cap.

    The closed form is checked one step either way, so a rounding error at an
    exact boundary cannot shift the answer.
    """
    c = E.col(cap) if not isinstance(cap, float) else F.lit(cap)
    guess = F.ceil(F.log(F.lit(1.0 - confidence)) / F.log1p(-c)).cast("bigint")

    def within(n: Column) -> Column:
        return 1.0 - F.pow(F.lit(1.0 - confidence), 1.0 / n.cast("double")) <= c

    return (
        F.when((guess > 1) & within(F.greatest(guess - 1, F.lit(1))), guess - 1)
        .when(within(guess), guess)
        .otherwise(guess + 1)
    )


def paired_size(sigma, null_ratio, alternative, alpha: float = 0.05, power: float = 0.80) -> Column:
    effect = F.log(E.col(null_ratio)) - F.log(E.col(alternative))
    scaled = F.lit(critical_value(alpha, power)) * E.col(sigma) / effect
    return F.ceil(scaled * scaled).cast("bigint")


def detectable_ratio(sigma, units, alpha: float = 0.05, power: float = 0.80) -> Column:
    return F.exp(-F.lit(critical_value(alpha, power)) * E.col(sigma) / F.sqrt(E.col(units)))


def log_ratio_spread(units: DataFrame, keys: Sequence[str] = ("arm",)) -> DataFrame:
    """Sample deviation of unit mean log ratios per arm."""
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), F.stddev_samp("mean_log_ratio").alias("sigma")
    )


def cluster_support(
    assignments: DataFrame, *, unit: str = "unit", cluster: str = "cluster", split: str = "split"
) -> DataFrame:
    """Per split: units, distinct clusters, repeated ones, and those seen in training."""
    per = assignments.groupBy(split, cluster).agg(F.count(F.lit(1)).alias("_units"))
    trained = (
        assignments.where(F.col(split) == "train").select(cluster).distinct()
        .withColumn("_seen", F.lit(True))
    )
    joined = per.join(trained, cluster, "left")
    seen = F.coalesce("_seen", F.lit(False))
    return joined.groupBy(split).agg(
        F.sum("_units").alias("units"),
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("_units") > 1).alias("repeated_clusters"),
        F.count_if(seen).alias("seen_in_training"),
        F.count_if(~seen).alias("unseen_in_training"),
        F.bool_and(~seen).alias("strictly_out_of_family"),
    )


def repeated_members(
    assignments: DataFrame, *, unit: str = "unit", cluster: str = "cluster", split: str = "split"
) -> DataFrame:
    """(split, cluster, member, unit, seen_in_training) of clusters with several units.

    A row per unit instead of a list: a cluster may hold any number of them. Members are
    numbered from 1 by name inside their split.
    """
    placed = with_positions(
        assignments.select(split, cluster, unit, F.lit(1).alias("_one")), [split, cluster], [unit],
        position="member", totals={"_units": "_one"},
    )
    trained = assignments.where(F.col(split) == "train").select(cluster).distinct()
    seen = trained.withColumn("_seen", F.lit(True))
    return placed.where("_units > 1").join(seen, cluster, "left").select(
        split, cluster, "member", unit, F.coalesce("_seen", F.lit(False)).alias("seen_in_training")
    )


def future_design(
    spread: DataFrame, support: DataFrame, *, improvement: float = 0.10, margin: float = 1.05,
    cap: float = 0.05, seeds: int = 3, arms: Sequence[int] = (2, 3),
) -> DataFrame:
    """(quantity, scenario, value): what a study needs that serves several claims at once.

    Superiority with safety takes the larger of both sizes, the dual purpose also that of
    noninferiority. What ``support`` (one row of ``cluster_support``) lacks is told for all
    its clusters and for those unseen in training; runs are units x seeds x arms.
    """
    one = spread.agg(F.max("sigma").alias("sigma")).select(
        paired_size("sigma", F.lit(1.0), F.lit(1.0 - improvement)).alias("superiority"),
        paired_size("sigma", F.lit(margin), F.lit(1.0)).alias("noninferiority"),
        zero_failure_size(cap).alias("safety"),
        support.select("clusters").scalar().alias("clusters"),
        support.select("unseen_in_training").scalar().alias("unseen"),
    )
    need = {
        "superiority_and_safety": F.greatest("superiority", "safety"),
        "dual_purpose": F.greatest("superiority", "noninferiority", "safety"),
    }
    rows = {("basis", c): F.col(c) for c in ("superiority", "noninferiority", "safety")}
    for design, units in need.items():
        rows[design, "units"] = units
        rows[design, "beyond_available"] = F.greatest(units - F.col("clusters"), F.lit(0))
        rows[design, "beyond_unseen"] = F.greatest(units - F.col("unseen"), F.lit(0))
        for n in arms:
            rows[design, f"runs_of_{n}_arms"] = units * seeds * n
    entries = [
        F.struct(F.lit(q).alias("quantity"), F.lit(s).alias("scenario"), v.cast("bigint").alias("value"))
        for (q, s), v in rows.items()
    ]
    return one.select(F.inline(F.array(*entries)))


def precision_plan(
    spread: DataFrame,
    support: DataFrame,
    *,
    improvements: Sequence[float] = (0.05, 0.10, 0.15),
    caps: Sequence[float] = (0.025, 0.05, 0.10),
    margin: float = 1.05,
) -> DataFrame:
    """(quantity, scenario, value) rows of the plan, from the widest arm's spread."""
    widest = spread.agg(F.max("sigma").alias("sigma"))
    one = widest.select(
        "sigma",
        support.select("units").scalar().cast("bigint").alias("units"),
        support.select("clusters").scalar().cast("bigint").alias("clusters"),
    )

    def row(quantity: str, scenario: str, value: Column) -> Column:
        return F.struct(
            F.lit(quantity).alias("quantity"),
            F.lit(scenario).alias("scenario"),
            value.cast("double").alias("value"),
        )

    rows = [row("planning_sigma", "widest arm", F.col("sigma"))]
    for step in improvements:
        rows.append(
            row("superiority_units", f"{step:.2f}",
                paired_size("sigma", F.lit(1.0), F.lit(1.0 - step)))
        )
    rows.append(
        row("noninferiority_units", f"{margin:.2f}",
            paired_size("sigma", F.lit(margin), F.lit(1.0)))
    )
    for cap in caps:
        need = zero_failure_size(cap)
        rows.append(row("zero_failure_units", f"{cap:.3f}", need))
        rows.append(
            row("zero_failure_upper", f"{cap:.3f}",
                E.binomial_upper_bound(F.lit(0), need))
        )
    for level in ("units", "clusters"):
        rows.append(row("available_upper", level, E.binomial_upper_bound(F.lit(0), level)))
        rows.append(row("available_detectable_ratio", level, detectable_ratio("sigma", level)))
    return one.select(F.inline(F.array(*rows)))
