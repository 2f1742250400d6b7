"""Strata, evaluation protocols and leakage flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import IGNORED_FAMILY_KEYS, SPLITS
from plumbline.functions import exprs as E
from plumbline.operators.gates import check_rows


def cross_split_units(assignments: DataFrame, *, unit: str = "unit", split: str = "split"):
    """Units listed in more than one split."""
    return assignments.groupBy(unit).agg(F.count_distinct(split).alias("splits")).where(
        F.col("splits") > 1
    )


def cross_split_groups(
    rows: DataFrame, *, group: str, split: str = "split", ignored: Sequence[str] = ("",)
) -> DataFrame:
    """Groups that occur in more than one split, with units per split."""
    counts = rows.where(~F.coalesce(F.col(group), F.lit("")).isin(*ignored)).groupBy(group).agg(
        *[F.count_if(F.col(split) == s).alias(f"{s}_units") for s in SPLITS]
    )
    present = sum((F.col(f"{s}_units") > 0).cast("int") for s in SPLITS)
    return counts.where(present > 1)


def family_overlap(names: DataFrame, *, name: str, split: str = "split") -> DataFrame:
    """Heuristic family keys that cross splits; very common stems are ignored."""
    keyed = names.withColumn("family", E.family_key(name))
    return cross_split_groups(keyed, group="family", split=split, ignored=IGNORED_FAMILY_KEYS)


def assign_strata(
    units: DataFrame, *, group: str = "grp", split: str = "split", out: str = "stratum"
) -> DataFrame:
    """Training (un)grouped; evaluation ungrouped, seen or unseen in training."""
    named = F.coalesce(F.trim(group), F.lit(""))
    trained = (
        units.where(F.col(split) == "train").select(named.alias("_g")).where("_g <> ''").distinct()
        .withColumn("_seen", F.lit(True))
    )
    # Units without a group have no key, so they don't meet in one task.
    joined = units.withColumn("_g", F.nullif(named, F.lit(""))).join(trained, "_g", "left")
    has = F.col("_g").isNotNull()
    stratum = (
        F.when((F.col(split) == "train") & has, "training_grouped")
        .when(F.col(split) == "train", "training_ungrouped")
        .when(~has, "officially_ungrouped")
        .when(F.col("_seen"), "seen_family")
        .otherwise("unseen_family")
    )
    return joined.withColumn(out, stratum).drop("_g", "_seen")


def protocol_members(assigned: DataFrame, *, split: str = "split", stratum: str = "stratum"):
    """One row per (protocol, unit): training units belong to all three."""
    names = ("official_group_ood", "seen_family", "officially_ungrouped")
    own = (
        F.when(F.col(stratum) == "unseen_family", "official_group_ood")
        .when(F.col(stratum) == "seen_family", "seen_family")
        .otherwise("officially_ungrouped")
    )
    every = F.array(*[F.lit(n) for n in names])
    return assigned.withColumn(
        "protocol", F.explode(F.when(F.col(split) == "train", every).otherwise(F.array(own)))
    )


def protocol_counts(assigned: DataFrame, *, split: str = "split", stratum: str = "stratum"):
    return protocol_members(assigned, split=split, stratum=stratum).groupBy("protocol", split).agg(
        F.count(F.lit(1)).alias("units")
    )


def protocol_invariants(
    assigned: DataFrame, *, group: str = "grp", split: str = "split", stratum: str = "stratum"
) -> DataFrame:
    """The seven invariants as check rows.

    Groups are reduced to membership flags first, so every set comparison is a
    count over groups.
    """

    def within(s, st):
        return F.bool_or((F.col(split) == s) & (F.col(stratum) == st))

    flags = (
        assigned.where(F.coalesce(F.trim(group), F.lit("")) != "")
        .groupBy(F.trim(group).alias("_g"))
        .agg(
            F.bool_or(F.col(split) == "train").alias("train"),
            within("val", "unseen_family").alias("ov"),
            within("test", "unseen_family").alias("ot"),
            within("val", "seen_family").alias("sv"),
            within("test", "seen_family").alias("st"),
        )
    )
    g = flags.agg(
        F.count_if(F.col("ov") & F.col("train")).alias("ov_train"),
        F.count_if(F.col("ot") & F.col("train")).alias("ot_train"),
        F.count_if(F.col("ov") & F.col("ot")).alias("ov_ot"),
        F.count_if(F.col("sv") & ~F.col("train")).alias("sv_out"),
        F.count_if(F.col("st") & ~F.col("train")).alias("st_out"),
    )
    known = F.col(stratum).isin("unseen_family", "seen_family", "officially_ungrouped")
    evaluation = F.col(split) != "train"
    units = assigned.agg(
        F.count_if(F.col(group).isNull()).alias("no_metadata"),
        F.count_if(evaluation & ~known).alias("unplaced"),
    )
    one = g.select(
        "*",
        units.select("no_metadata").scalar().alias("no_metadata"),
        units.select("unplaced").scalar().alias("unplaced"),
    )
    zero = {
        "all_units_have_metadata": "no_metadata",
        "evaluation_partition_is_complete": "unplaced",
        "ood_val_groups_disjoint_from_train": "ov_train",
        "ood_test_groups_disjoint_from_train": "ot_train",
        "ood_val_and_test_groups_are_disjoint": "ov_ot",
        "seen_val_groups_are_in_train": "sv_out",
        "seen_test_groups_are_in_train": "st_out",
    }
    return check_rows(one, {name: F.coalesce(F.col(c), F.lit(0)) == 0 for name, c in zero.items()})


def missing_metadata(units: DataFrame, metadata: DataFrame, *, unit: str = "unit") -> DataFrame:
    return units.join(metadata, unit, "left_anti")


def inconsistent_clusters(rows: DataFrame, *, unit: str, group: str) -> DataFrame:
    """Units that map to more than one cluster key."""
    keyed = rows.select(unit, E.cluster_key(group, unit).alias("_k"))
    return keyed.groupBy(unit).agg(F.count_distinct("_k").alias("keys")).where("keys > 1")


def resolve_status(rows: DataFrame, easy: DataFrame, infeasible: DataFrame, *, unit: str = "unit",
                   label: str = "page_status") -> DataFrame:
    """Infeasible list first, then the easy list, then the page's own label; a page
    that alone says easy is ``not-easy-current``."""
    e = easy.select(unit).distinct().withColumn("_easy", F.lit(True))
    i = infeasible.select(unit).distinct().withColumn("_inf", F.lit(True))
    status = (
        F.when(F.col("_inf"), "infeasible")
        .when(F.col("_easy"), "easy")
        .when(F.col(label) == "easy", "not-easy-current")
        .otherwise(F.col(label))
    )
    joined = rows.join(e, unit, "left").join(i, unit, "left")
    return joined.withColumn("status", status).drop("_easy", "_inf")
