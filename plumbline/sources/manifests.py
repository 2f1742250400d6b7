"""Experiment manifests and record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = (
    "struct<status:string,objective_sense:string,primal_bound:string,dual_bound:string,"
    "gap:string,nodes:bigint,total_nodes:bigint,lp_iterations:bigint,lp_count:bigint,"
    "cuts_applied:bigint,solving_time:double,arm_wall_time_seconds:double,"
    "primal_dual_integral:double>"
)
SELECTOR = (
    "struct<calls:bigint,root_calls:bigint,interventions:bigint,run_count:bigint,"
    "intervention_scope:string,"
    "intervention_records:array<struct<run_number:bigint,context_sha256:string>>,"
    "context_records:array<struct<run_number:bigint,context_sha256:string>>,"
    "shadow_evaluations:bigint,"
    "shadow_records:array<struct<proposed_changed_selected_cuts:bigint>>,"
    "timing_seconds:map<string,double>>"
)
COMPARISON = (
    "struct<safe:boolean,eligible:boolean,valid:boolean,policy_fallback:boolean,"
    "safety_checks:map<string,boolean>,"
    "metrics:map<string,struct<native:double,treatment:double,"
    "delta_treatment_minus_native:double,relative_saving:double>>>"
)
MANIFEST = (
    "time_limit double, actions array<string>, seeds array<bigint>, intervention_scope string, "
    "per_instance array<struct<instance_id:string,instance_sha256:string,"
    "pairs:array<struct<seed:bigint,"
    f"native_outcome:{OUTCOME},"
    "initial_context:struct<all_actions_observed:boolean,no_action_observed:boolean,"
    "partial_actions_observed:boolean,matching_across_actions:boolean>,"
    f"actions:map<string,struct<outcome:{OUTCOME},selector:{SELECTOR},comparison:{COMPARISON}>>"
    ">>>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nested experiment manifests; bounds stay texts because they may be ``inf``."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def flat_manifest(manifests: DataFrame) -> DataFrame:
    """One row per (unit, seed, arm) with native and treatment structs."""
    units = manifests.select("time_limit", F.explode("per_instance").alias("u"))
    seeds = units.select(
        "time_limit",
        F.col("u.instance_id").alias("unit"),
        F.col("u.instance_sha256").alias("unit_sha256"),
        F.explode("u.pairs").alias("p"),
    )
    return seeds.select(
        "time_limit",
        "unit",
        "unit_sha256",
        F.col("p.seed").alias("seed"),
        F.col("p.native_outcome").alias("native"),
        F.col("p.initial_context").alias("initial_context"),
        F.explode("p.actions").alias("arm", "treatment"),
    )


def write_records(df: DataFrame, path: str) -> None:
    """Compact JSON lines, gzip; one file per partition."""
    df.write.option("compression", "gzip").json(path)


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def canonical_hash(columns) -> F.Column:
    """Hash of the columns as JSON with sorted names: stable for equal content."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def drop_nested(array: str, field: str) -> F.Column:
    """Array of structs without one field."""
    return F.transform(array, lambda x: x.dropFields(field))
