"""Seven-row and collision fixtures of the decision tables."""

import pytest
from pyspark.sql import functions as F

from plumbline.fixed_values import PRE_STATE_FIELDS, PROHIBITED_FIELDS, SIGNATURE_FIELDS
from plumbline.operators import decisions as D
from plumbline.operators import ranking as R
from plumbline.plans.decision_tables import build_decision_tables

PLAIN = {
    "run_number": "1", "node_number": "1", "node_depth": "0", "root": "True",
    "sep_round_run": "1", "sep_round_global": "1", "lp_round_node": "1", "lp_round_run": "1",
    "lp_round_global": "1", "is_forced": "False", "is_applied": "False", "cut_name": "c",
}


def candidate(cut, score, index, step, **more):
    row = {f: "" for f in SIGNATURE_FIELDS} | PLAIN
    row |= {"cut_id": cut, "score": str(score), "original_index": str(index),
            "sep_round_node": str(step), "sep_round_global": str(step)}
    return row | {k: str(v) for k, v in more.items()}


def frame(spark, data, unit="u"):
    names = sorted(data[0])
    rows = [(unit, i, *[r[n] for n in names]) for i, r in enumerate(data)]
    schema = "unit string, _row bigint, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame(rows, schema)


def transitions(spark, steps, node="1", depth="0"):
    data = [
        {"run_number": "1", "node_number": node, "node_depth": depth, "sep_round_node": str(s),
         "lp_obj_val_post": "9", **{f: "1" for f in PRE_STATE_FIELDS}, "pre_lp_status": "optimal"}
        for s in steps
    ]
    return frame(spark, data)


@pytest.fixture
def assignment(spark):
    return spark.createDataFrame(
        [("u", "train", "A", "training_grouped")],
        "unit string, split string, official_group string, evaluation_stratum string",
    )


def build(spark, data, steps, assignment):
    return build_decision_tables(
        frame(spark, data), transitions(spark, steps), assignment,
        sequence=["_row"], state_sequence=["_row"],
    )


SEVEN = [
    candidate("10", 0.5, 5, 1, is_applied="True"),
    candidate("20", 0.9, 2, 1),
    candidate("10", 0.5, 1, 1, is_applied="True"),
    candidate("30", 2.0, -1, 1, is_forced="True", is_applied="True"),
    candidate("40", 0.8, 0, 2),
    candidate("50", 0.7, 1, 2),
    candidate("60", 0.6, 0, 3, node_number="2", node_depth="1", root="False"),
]


def test_seven_rows(spark, assignment):
    t = build(spark, SEVEN, [1, 2], assignment)
    first = t.candidates.where("decision_id = 'u|run=1|node=1|sep=1'").orderBy("score_rank_pre")
    got = first.collect()
    assert [(r["source_cut_id"], r["score_rank_pre"]) for r in got] == [("20", 1), ("10", 2)]
    ten = got[1]
    assert (ten["candidate_multiplicity"], ten["first_original_index"]) == (2, 1)
    assert ten["observed_logical_is_applied"] and not ten["source_cut_id_collision"]
    assert [r["score_rank_fraction_pre"] for r in got] == [0.0, 1.0]
    d = t.decisions.orderBy("sep_round_node").collect()
    assert [r["is_eligible"] for r in d] == [True, False]
    assert [r["is_first_in_run"] for r in d] == [True, False]
    c = t.counters.first()
    assert (c["root_rows"], c["forced_rows"], c["duplicate_occurrences"]) == (6, 1, 1)
    assert all(r["passed"] for r in t.checks.collect())


def test_collision_moves_eligibility_to_the_next_decision(spark, assignment):
    data = [
        candidate("10", 0.9, 0, 1, cut_name="first"),
        candidate("10", 0.8, 1, 1, cut_name="second", is_applied="True"),
        candidate("20", 0.7, 0, 2),
        candidate("30", 0.6, 1, 2),
    ]
    t = build(spark, data, [2], assignment)
    d = t.decisions.orderBy("sep_round_node").collect()
    assert [r["is_eligible"] for r in d] == [False, True]
    assert [r["pre_state_available"] for r in d] == [False, True]
    assert t.candidates.where("observed_label_ambiguous").count() == 2
    c = t.counters.first()
    assert (c["decisions_with_collision"], c["duplicate_occurrences"]) == (1, 0)


def test_outputs_hold_no_prohibited_or_later_fields(spark, assignment):
    t = build(spark, SEVEN, [1], assignment)
    names = set(t.candidates.columns) - {"observed_logical_is_applied"}
    assert not names & set(PROHIBITED_FIELDS)
    assert not [c for c in t.decisions.columns if c.endswith("_post") or c.startswith("delta_")]
    assert R.forbidden_columns(t.decisions) == []


def test_shuffled_input_gives_the_same_tables(spark, assignment):
    one = build(spark, SEVEN, [1, 2], assignment).candidates
    raw = frame(spark, SEVEN).repartition(5, "cut_id")
    two = build_decision_tables(
        raw, transitions(spark, [1, 2]), assignment, sequence=["_row"], state_sequence=["_row"]
    ).candidates
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))


def test_missing_id_and_root_disagreement(spark):
    raw = frame(spark, [candidate("", 1, 4, 1), candidate("x", 1, 5, 1, root="False")])
    kept, clash = D.root_rows(raw)
    assert kept.count() == 1 and clash.first()[0] == 1
    ids = D_typed(kept)
    assert [r["source_id"] for r in ids.collect()] == ["missing@4"]


def D_typed(raw):
    from plumbline.plans.decision_tables import typed_candidates

    return typed_candidates(raw, ["_row"])


def test_first_duplicate_state_wins(spark):
    states = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c")], "k int, at int, v string")
    got = D.attach_pre_state(
        spark.createDataFrame([(1,), (2,), (3,)], "k int"), states, key=["k"], fields=["v"],
        sequence=["at"],
    )
    assert sorted(map(tuple, got.collect())) == [(1, "a", True), (2, "c", True), (3, None, False)]
    assert D.duplicate_state_keys(states, ["k"]).first()[0] == 1


def test_contiguity_finds_a_returning_key(spark):
    data = [("f", 1, "a"), ("f", 2, "a"), ("f", 3, "b"), ("f", 4, "a"), ("h", 1, "a"), ("h", 2, "b")]
    df = spark.createDataFrame(data, "src string, at int, k string").withColumn("k2", F.col("k"))
    got = D.contiguity(df, source=["src"], key=["k"], sequence=["at"])
    assert {r["src"]: (r["islands"], r["distinct_keys"], r["contiguous"]) for r in got.collect()} == {
        "f": (3, 2, False), "h": (2, 2, True),
    }


def islands_by_force(data, flags):
    """{(source, key): runs} of (source, key) rows in order; rows without a flag break runs."""
    out, last = {}, None
    for (s, k), ok in zip(data, flags):
        if ok and (s, k) != last:
            out[s, k] = out.get((s, k), 0) + 1
        last = (s, k) if ok else None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_islands_of_blocks_merge(spark, seed):
    import random

    rng = random.Random(seed)
    data = [(s, f"k{rng.randrange(4)}") for s in ("a", "b") for _ in range(60) for _ in range(rng.randrange(3))]
    flags = [rng.random() < 0.9 for _ in data]
    rows, block = [], 0
    for i, ((s, k), ok) in enumerate(zip(data, flags)):
        block = i if i == 0 or s != data[i - 1][0] or rng.random() < 0.1 else block
        rows.append((s, k if ok else None, block, i))
    schema = "src string, k string, block bigint, at bigint"
    want = islands_by_force(data, flags)
    # As scans give them: parts of the file order, in any order and any number.
    cuts = sorted(rng.sample(range(len(rows)), 7))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    rng.shuffle(parts)
    frame = spark.createDataFrame(spark.sparkContext.parallelize([r for p in parts for r in p], 3), schema)
    got = D.key_islands(frame, source=["src"], key=F.col("k"), block="block", row="at")
    assert {(r["src"], r["key"]): r["islands"] for r in got.collect()} == want
    sorted_way = D.key_islands(frame.repartition(4), source=["src"], key=F.col("k"), sequence=["at"])
    assert {(r["src"], r["key"]): r["islands"] for r in sorted_way.collect()} == want
    rolled = D.contiguity_of_keys(got, ["src"]).collect()
    assert {r["src"]: r["islands"] for r in rolled} == {
        s: sum(n for (x, _), n in want.items() if x == s) for s in {x for x, _ in want}
    }
    assert D.key_islands(frame.limit(0), source=["src"], key=F.col("k"), block="block", row="at").count() == 0


def test_build_stops_on_a_returning_decision_and_reports_what_it_left_out(spark, assignment):
    back = [*SEVEN[:5], candidate("70", 0.1, 9, 1)]
    with pytest.raises(ValueError, match="come back.*u\\|1\\|1\\|1"):
        build(spark, back, [1], assignment)
    # A row of another node between two rows of a decision splits it as well.
    with pytest.raises(ValueError, match="come back"):
        build(spark, [SEVEN[0], SEVEN[6], SEVEN[1]], [1], assignment)
    with pytest.raises(ValueError, match="schema mismatch.*cut_id"):
        build_decision_tables(
            frame(spark, SEVEN).drop("cut_id"), transitions(spark, [1]), assignment, sequence=["_row"], state_sequence=["_row"]
        )
    odd = [*SEVEN, candidate("80", 0.1, 9, 4, root="False")]
    r = build(spark, odd, [1, 1, 2], assignment).report.first()
    assert (r["source_rows"], r["root_rows"], r["root_depth_disagreements"]) == (8, 6, 1)
    assert (r["malformed_rows"], r["repeated_state_keys"]) == (0, 1)
