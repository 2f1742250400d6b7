"""Composite jobs over the given tables: they run and their totals close."""

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import queries_jobs as J
from checks import queries_pairs as Q
from checks.verify import compare
from checks.views import pairs_cells
from plumbline.plans import cohorts as C
from plumbline.plans import experiments as X
from plumbline.session import _OWN


def test_failure_diagnostics(spark, sf):
    runs, compared = Q.arm_runs(spark, sf), Q.compared(spark, sf)
    ref = spark.range(50).select(F.col("id").alias("unit"), F.lit(1.0).alias("reference_objective"))
    d = X.failure_diagnostics(runs, compared, ref, 200.0, [("click", "view")], ["solving_time"])
    cells = pairs_cells(spark, sf).count()
    assert d.status_counts.agg(F.sum("runs")).first()[0] == cells
    assert d.ratios.first()["ratio"] > 0
    assert d.objectives.where("closer IS NOT NULL").count() <= d.objectives.count()


def test_overhead_analysis(spark, sf):
    pairs = Q.flat(spark, sf).select(
        "*", (F.col("treatment_nodes") > 1).alias("exposed"),
        (F.col("native_nodes") == F.col("treatment_nodes")).alias("structural_match"),
    )
    timings = pairs.select(F.col("arm").alias("name"), F.col("treatment_time").alias("seconds"))
    ratios, times = X.overhead_analysis(pairs, timings, 200.0, times=["time"])
    assert ratios.agg(F.sum("pairs")).first()[0] == pairs.count()
    assert times.agg(F.sum("records")).first()[0] == pairs.count()


def test_cohort_audit(spark):
    active = spark.createDataFrame([("a",), ("b",)], "unit string")
    queues = spark.createDataFrame([("a", "q2"), ("a", "q1"), ("z", "q1")], "unit string, queue string")
    assigned = spark.createDataFrame(
        [("a", "A", "train"), ("b", "A", "test")], "unit string, cluster string, split string"
    )
    overlap, by_queue, support = C.cohort_audit(active, queues, assigned)
    assert {r["unit"]: r["prior_queues"] for r in overlap.collect()} == {"a": "q1;q2", "b": ""}
    assert {r["queue"]: r["units"] for r in by_queue.collect()} == {"q1": 1, "q2": 1}
    test = support.where("split = 'test'").first()
    assert (test["seen_in_training"], test["strictly_out_of_family"]) == (1, False)


def test_scratch_folder_leaves_nothing_behind(spark):
    from pathlib import Path

    from plumbline.session import materialize, scratch_folder, scratch_root

    root = scratch_root(spark)
    with scratch_folder(spark) as own:
        assert materialize(spark.range(5), "t").count() == 5
        assert any(Path(own.removeprefix("file:")).iterdir())
    assert not Path(own.removeprefix("file:")).exists() and scratch_root(spark) == root


@pytest.mark.parametrize("name", ["decision_tables_job", "audit_job"])
def test_jobs_over_small_compressed_pieces_equal_sql(spark, sf, tmp_path, monkeypatch, name):
    monkeypatch.setattr(J, "PIECE_ROWS", 60)
    monkeypatch.setitem(_OWN, spark.sparkContext.applicationId, str(tmp_path))
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert compare(J.QUERIES[name](spark, sf), con, J.ORACLES[name])[0] == ""
    trees = list(tmp_path.glob("tree-*"))
    files = [f for t in trees for f in t.glob("split=*/unit=13/file=candidate_cuts.csv.*/part-*")]
    assert len(trees) == 2 and len(files) > 8 and all(f.name.endswith(".gz") for f in files)
    # A build that stops writes no rows before.
    assert len(list(tmp_path.glob("root-rows-*"))) == (name == "decision_tables_job")
