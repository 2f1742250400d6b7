"""The small ranking dataset: weights, one-hot columns, sealed labels."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import quality as Q
from plumbline.operators import ranking as R
from plumbline.plans.ranking_study import build_ranking_dataset, evaluate_ranking

RUNS = [("a", 0, "train", [1, 0], "SEPA"), ("a", 1, "train", [0, 1, 0], "SEPA"),
        ("b", 0, "train", [1, 0], "CONSHDLR"), ("v", 0, "val", [0, 1], "SEPA"),
        ("t", 0, "test", [1, 0], "SEPA")]


@pytest.fixture(scope="module")
def dataset(spark):
    d, c = [], []
    for u, run, split, labels, origin in RUNS:
        q = f"{u}|{run}"
        stratum = "training_grouped" if split == "train" else "unseen_family"
        d.append((q, u, split, stratum, run, True, True, False, len(labels), "optimal", str(len(labels))))
        for i, y in enumerate(labels):
            c.append((q, f"{q}|{i}", y, i + 1, str(i), origin, "" if i else "5"))
    decisions = spark.createDataFrame(
        d, "decision_id string, unit string, split string, evaluation_stratum string, run int, "
        "is_eligible boolean, pre_state_available boolean, has_collision boolean, n_logical bigint, "
        "pre_lp_status string, rows string",
    )
    candidates = spark.createDataFrame(
        c, "decision_id string, logical_candidate_id string, label int, score_rank_pre int, "
        "score string, origin_type string, cutoff_distance string",
    )
    return build_ranking_dataset(
        decisions, candidates, decision_features=["pre_lp_status", "rows"],
        candidate_features=["score", "origin_type", "cutoff_distance"],
    ), decisions, candidates


def test_contract_is_fitted_on_training_rows(dataset):
    names = [r["name"] for r in dataset[0].contract.orderBy("position").collect()]
    assert names == ["rows", "score", "origin_type==CONSHDLR", "origin_type==SEPA", "origin_type==<UNK>"]


def test_rows_and_weights(dataset):
    ds = dataset[0]
    train = ds.queries.where("subset = 'train'").orderBy("decision_id").collect()
    assert [r["n_candidates"] for r in train] == [2, 3, 2]
    assert [r["query_weight"] for r in train] == [0.75, 0.75, 1.5]
    assert [r["effective_weight"] for r in train] == [0.75, 0.75, 1.5]
    assert ds.rows.where("subset = 'train'").count() == 7
    r = ds.rows.where("logical_candidate_id = 'b|0|1'").first()
    assert list(r["features"]) == [2.0, 1.0, 1.0, 0.0, 0.0]
    assert ds.balance.first()["balanced"]


def test_test_labels_are_sealed(dataset):
    got = {r["subset"]: r for r in dataset[0].labels.collect()}
    assert got["official_group_ood_test"]["label_statistics"] == "sealed"
    assert got["official_group_ood_test"]["positives"] is None
    assert got["train"]["positives"] == 3


def test_broken_inputs_raise(spark, dataset):
    _, decisions, candidates = dataset
    with pytest.raises(ValueError, match="prohibited"):
        build_ranking_dataset(decisions, candidates, decision_features=[], candidate_features=["rank"])
    with pytest.raises(ValueError, match="do not match"):
        build_ranking_dataset(
            decisions, candidates.where("label = 1"), decision_features=["rows"],
            candidate_features=["score"],
        )
    with pytest.raises(ValueError, match="lacks state"):
        build_ranking_dataset(
            decisions.withColumn("has_collision", F.lit(True)), candidates,
            decision_features=["rows"], candidate_features=["score"],
        )


def test_evaluation_compares_with_the_baseline(spark):
    data = [(f"q{i}", f"u{i % 4}", y, r + 1, float(y)) for i in range(12) for r, y in enumerate((0, 1, 0))]
    df = spark.createDataFrame(data, "decision string, unit string, label int, baseline_rank int, s double")
    got = {r["metric"]: r for r in evaluate_ranking(df, score="s", replicates=30).collect()}
    assert got["ndcg_1"]["baseline"] == 0.0 and got["ndcg_1"]["model"] == 1.0
    assert got["ndcg_1"]["ci95_lower"] == 1.0 and got["ndcg_1"]["probability_positive"] == 1.0
    assert got["recall_5"]["delta"] == 0.0


def test_record_guards(spark):
    schema = "unit string, seed int, no_arm_observed boolean, matching_across_arms boolean, native_complete boolean"
    ok = spark.createDataFrame(
        [("a", 1, False, True, True), ("a", 2, True, False, True), ("b", 1, False, True, False)], schema
    )
    assert [r["seed"] for r in Q.usable_records(ok).collect()] == [1]
    assert tuple(Q.record_accounting(ok).first()) == (3, 1, 1, 1, True)
    with pytest.raises(Exception, match="not matching"):
        Q.usable_records(ok.withColumn("matching_across_arms", F.lit(False))).collect()
    arms = ok.withColumn("arms", F.array(F.lit("x")))
    with pytest.raises(ValueError, match="duplicate"):
        Q.union_sources([arms, arms], ["unit", "seed"])
    with pytest.raises(ValueError, match="same arm set"):
        Q.union_sources([arms, arms.withColumn("arms", F.array(F.lit("y")))], ["unit", "seed"])


def dense(cell):
    out = [0.0] * cell["size"]
    for i, v in zip(cell["indices"], cell["values"], strict=True):
        out[i] = v
    return out


SPEC = "position long, name string, feature string, category string"


def test_sparse_assembly_equals_the_dense_one(spark):
    spec = spark.createDataFrame([
        (1, "n", "n", None), (2, "t", "t", None), (3, "b", "b", None), (4, "c==x", "c", "x"),
        (5, "c==y", "c", "y"), (6, "c==u", "c", R.UNKNOWN_CATEGORY), (7, "d==1", "d", "1"), (8, "d==2", "d", "2"),
    ], SPEC)
    data = [
        (1.5, "2", "True", "x", 1, 9), (0.0, "0", "no", "y", 2, 9), (None, "", "", None, None, None),
        (float("inf"), "z", None, R.UNKNOWN_CATEGORY, 3, 9), (0.0, "0", "no", "", 2, 9), (1.5, "2", "True", "x", 1, 9),
    ]
    kinds = "n double, t string, b string, c string, d int, features int"
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"i int, {kinds}")
    # A feature without a bucket for the unknown gives no cell there; the dense way needs no bucket either.
    want = {r.i: r.features for r in R.assemble(rows, spec, ["b"]).collect()}
    got = R.assemble_sparse(rows, spec, ["b"])
    assert set(got.columns) == set(rows.columns)
    told = {r.i: r.features for r in got.collect()}
    assert {i: str(dense(c)) for i, c in told.items()} == {i: str(v) for i, v in want.items()}
    assert all(list(c["indices"]) == sorted(c["indices"]) and 0.0 not in c["values"] for c in told.values())
    assert R.assemble_sparse(rows.limit(0), spec).count() == 0
    assert R.assemble_sparse(rows, spec.limit(0)).select("features.size").distinct().first()[0] == 0


def test_a_million_categories_assemble(spark):
    n = 1_000_000
    spec = spark.range(n).selectExpr("id + 1 AS position", "'' AS name", "'c' AS feature", "'v' || id AS category")
    spec = spec.unionByName(spark.createDataFrame([(n + 1, "", "c", R.UNKNOWN_CATEGORY)], SPEC))
    rows = spark.range(0, 3 * n, 1009).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'v7' ELSE 'v' || id END AS c")
    wrong = R.assemble_sparse(rows, spec).where(
        "features.size <> 1000001 OR features.indices <> array(CAST(CASE WHEN id % 3 = 0 THEN 7 "
        "WHEN id < 1000000 THEN id ELSE 1000000 END AS INT))"
    )
    assert wrong.count() == 0


def test_assembly_joins_its_rows_once(spark, sf, monkeypatch):
    from checks import queries_audit as Q

    calls, real = [], Q.cand
    monkeypatch.setattr(Q, "cand", lambda *a: calls.append(a) or real(*a))
    assert Q.feature_assembly(spark, sf).count() > 0
    assert len(calls) == 1


def test_fits_read_tasks_of_a_fixed_size(spark, monkeypatch):
    from plumbline.operators import models as M
    from plumbline.operators import ordering as O

    parts = []

    def fit(train, test, **_):
        parts.append(train.rdd.getNumPartitions())
        assert "other" not in train.columns
        return test.withColumn("model_score", F.lit(0.5)), None

    monkeypatch.setattr(O, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(M, "fit_score", fit)
    rows = spark.range(300).selectExpr("id", "id % 2 AS label", "id % 3 AS fold", "id * 1.0D AS x", "'o' AS other")
    assert M.out_of_fold(rows, label="label", features=["x"]).count() == 300
    assert parts == [30, 30, 30]


def test_gate_computes_the_comparison_once(spark, monkeypatch):
    from plumbline.operators import models as M

    written, real = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, label: written.append(label) or real(df, label))
    rows = [("ndcg_10", 0.1, 0.01), ("selection_overlap", 0.0, -0.1)]
    got = M.ranking_gate(spark.createDataFrame(rows, "metric string, delta double, ci95_lower double"))
    assert [r["passed"] for r in got.orderBy("check").collect()] == [True, True, False]
    assert written == ["primary"]
