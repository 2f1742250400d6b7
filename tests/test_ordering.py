"""Positions and running sums: both ways must agree, whatever the skew."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordering as O
from plumbline.operators.heuristics import diverse_order, diverse_top_k
from plumbline.operators.ordering import (
    hot_groups,
    percentiles,
    with_group_aggregates,
    with_positions,
)


@pytest.fixture
def skewed(spark):
    rng = random.Random(7)
    data = [("hot", rng.randrange(40), i, rng.randrange(5)) for i in range(900)]
    data += [(f"g{i % 50}", rng.randrange(40), i, rng.randrange(5)) for i in range(900, 1500)]
    data += [(None, rng.randrange(40), i, 1) for i in range(1500, 1900)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g string, v int, id bigint, w int")


def brute(data):
    out = {}
    groups = {}
    for r in data:
        groups.setdefault(r["g"], []).append(r)
    for members in groups.values():
        run = 0
        whole = sum(m["w"] for m in members)
        for place, m in enumerate(sorted(members, key=lambda m: (-m["v"], m["id"])), start=1):
            run += m["w"]
            out[m["id"]] = (place, run, whole)
    return out


@pytest.mark.parametrize("hot_rows", [None, 300, 100])
def test_positions_agree_with_brute_force(skewed, hot_rows):
    got = with_positions(
        skewed, ["g"], [F.col("v").desc(), "id"], running={"run": "w"}, totals={"whole": "w"},
        hot_rows=hot_rows,
    )
    seen = {r["id"]: (r["position"], r["run"], r["whole"]) for r in got.collect()}
    assert seen == brute(skewed.collect())


@pytest.mark.parametrize("hot_rows", [None, 200])
def test_global_positions(skewed, hot_rows):
    got = with_positions(
        skewed, [], ["v", "id"], running={"run": "w"}, totals={"t": "w"}, hot_rows=hot_rows
    ).collect()
    assert len(got) == 1900
    run = 0
    for place, r in enumerate(sorted(got, key=lambda r: (r["v"], r["id"])), start=1):
        run += r["w"]
        assert (r["position"], r["run"]) == (place, run)
    assert {r["t"] for r in got} == {run}


def test_hot_groups_names_only_the_large_ones(skewed):
    found = hot_groups(skewed, ["g"], 300)
    assert {(r["g"], r["_n"]) for r in found.collect()} == {("hot", 900), (None, 400)}
    assert hot_groups(skewed, ["g"], 5000) is None


def greedy_by_hand(rows, budget, limit):
    """rows: (index, score, vector, forced), in any order."""
    free = sorted((r for r in rows if not r[3]), key=lambda r: (-r[1], r[0]))
    top = max((r[1] for r in free), default=0)

    def near(a, b, allowed):
        if a is None or b is None:
            return False
        a, b = np.array(a), np.array(b)
        return abs((a * b).sum()) > allowed * np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())

    refs, picks = [r[2] for r in rows if r[3]], []
    for r in free:
        allowed = max(0.5, limit) if r[1] >= top else limit
        if len(picks) < budget and not any(near(r[2], x, allowed) for x in refs):
            picks.append(r)
            refs.append(r[2])
    rest = [r for r in free if not any(r is p for p in picks)]
    return [r[0] for r in picks + rest]


@pytest.mark.parametrize("hot_rows", [None, 20, 3])
def test_diverse_order_with_ties_nulls_and_repeats(spark, hot_rows):
    rng = random.Random(3)
    grid = [[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 2.0], [0.0, 0.0, 0.0], None]
    data = [
        (i % 3, i // 3 // (2 if i > 200 else 1), rng.randrange(6) / 4,
         rng.choice(grid) if i % 2 else [float(rng.randrange(-3, 4)) for _ in range(3)], i % 17 == 0)
        for i in range(240)
    ]
    df = spark.createDataFrame(
        data, "g int, id bigint, s double, vec array<double>, forced boolean"
    )
    args = dict(decision=["g"], index="id", score="s", vector="vec", budget=9, forced="forced",
                min_orthogonality=0.4)
    got = diverse_order(df, hot_rows=hot_rows, **args).collect()
    picks = diverse_top_k(df, hot_rows=hot_rows, **args).collect()
    assert len(picks) == 27
    for g in range(3):
        mine = [r["pick"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])]
        own = [(i, s, v, f) for k, i, s, v, f in data if k == g]
        ties = {(-s, i): [] for i, s, v, f in own}
        assert len(ties) == len({(i, s) for i, s, _, _ in own})
        want = greedy_by_hand(own, 9, 0.6)
        assert sorted(mine) == sorted(want) and mine[:9] == want[:9]
        assert [r["pick"] for r in sorted(picks, key=lambda r: r["place"]) if r["g"] == g] == mine[:9]


@pytest.mark.parametrize("hot_rows", [None, 300, 100])
def test_group_aggregates_agree_with_brute_force(skewed, hot_rows):
    got = with_group_aggregates(
        skewed, ["g"], {"top": F.max("v"), "n": F.count(F.lit(1))}, hot_rows=hot_rows
    ).collect()
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r["g"], []).append(r["v"])
    assert len(got) == 1900
    assert all((r["top"], r["n"]) == (max(groups[r["g"]]), len(groups[r["g"]])) for r in got)


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_percentiles_agree_with_numpy(skewed, hot_rows, spark):
    if hot_rows:
        spark.conf.set("spark.plumbline.hotGroupRows", str(hot_rows))
    try:
        got = percentiles(
            skewed, ["g"], "v", {"a": 0.25, "b": 0.9}, nearest_rank={"c": 0.95}
        ).collect()
    finally:
        spark.conf.unset("spark.plumbline.hotGroupRows")
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r["g"], []).append(r["v"])
    assert len(got) == len(groups)
    for r in got:
        v = sorted(groups[r["g"]])
        assert r["a"] == pytest.approx(np.quantile(v, 0.25))
        assert r["b"] == pytest.approx(np.quantile(v, 0.9))
        assert r["c"] == v[min(len(v) - 1, math.ceil(0.95 * len(v)) - 1)]


def test_more_rows_make_more_tasks(spark, monkeypatch):
    """Tasks keep their size: the session's 4 shuffle partitions don't grow with the rows."""
    monkeypatch.setattr(O, "ROWS_PER_TASK", 100)
    rows = spark.range(2000).selectExpr("id % 500 AS g", "id % 7 AS h", "id")
    assert O.deal(rows, ["g"], 90) is rows
    dealt = O.deal(rows, ["g"], 2000)
    assert dealt.rdd.getNumPartitions() == 20
    tasks = dealt.groupBy("g", "h").count().withColumn("p", F.spark_partition_id())
    assert tasks.select("p").distinct().count() > 10
    made = with_group_aggregates(rows, ["g", "h"], {"n": F.count(F.lit(1))}, dealt_by=["g"])
    assert made.rdd.getNumPartitions() == 20
    assert sorted(made.collect()) == sorted(with_group_aggregates(rows, ["g", "h"], {"n": F.count(F.lit(1))}).collect())


def test_candidates_run_in_tasks_of_a_fixed_size(spark, monkeypatch, sf):
    from checks.queries_ranking import logical_of
    from checks.views import occ

    monkeypatch.setattr(O, "ROWS_PER_TASK", 500)
    assert occ(spark, sf).rdd.getNumPartitions() >= 12
    assert logical_of(occ(spark, sf)).rdd.getNumPartitions() >= 8


def test_cells_add_values_in_the_order_of_events(spark, tmp_path):
    from checks.views import CELLS_SQL, pairs_cells

    values = [0.1, 0.7, 0.2, 29.27, 0.3, 72.91, 0.07, 27.02]
    rows = [(i, "2024-01-01", i // 3 % 2, "view", values[i % 8]) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr(
        "event_id", "ts::timestamp AS ts", "user_id", "event_type", "value"
    ).repartition(4, "value").write.parquet(f"{tmp_path}/events.parquet")
    added = {}
    for _, _, unit, _, value in rows:
        added[unit] = added.get(unit, 0.0) + value
    assert {r["unit"]: r["work"] for r in pairs_cells(spark, str(tmp_path)).collect()} == added
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect(config={"threads": 1})
    source = f"(SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id)"
    con.execute(f"CREATE TABLE events AS SELECT * FROM {source}")
    sql = dict(con.execute(f"WITH {CELLS_SQL} SELECT unit, work FROM cells").fetchall())
    assert sql == added


def test_sums_in_order_leave_large_groups_to_the_exact_sum(spark):
    from plumbline.functions import exprs as E

    rows = spark.createDataFrame(
        [(g, i, 0.1) for g, n in (("small", 3), ("large", 10)) for i in range(n)] + [("none", 0, None)],
        "g string, i long, v double",
    )
    got = O.sums_in_order(
        rows, ["g"], ["i"], "v", "s", {"n": F.count(F.lit(1))},
        exact=E.exact_sum("v"), dealt_by=["g"], hot_rows=5,
    )
    assert {tuple(r) for r in got.collect()} == {("small", 0.1 + 0.1 + 0.1, 3), ("large", 1.0, 10), ("none", None, 1)}


def test_decisions_meet_candidates_and_states_in_tasks_of_a_fixed_size(spark, monkeypatch, sf):
    """Joins of dealt frames don't fall back to the session's 4 shuffle partitions."""
    import __spark_entry__ as entry

    monkeypatch.setattr(O, "ROWS_PER_TASK", 500)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("decision_summary", "eligible_candidates"):
            plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
            shuffles = [line for line in plan.splitlines() if "ENSURE_REQUIREMENTS" in line]
            assert shuffles and not [line for line in shuffles if ", 4)" in line], name
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
