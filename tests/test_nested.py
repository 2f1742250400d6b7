"""Nested values: leakage paths, leaves and plan contracts."""

from __future__ import annotations

import json

from plumbline.operators import nested as J


def walk(value, path):
    """(path, key, value) of everything below, by plain recursion."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield f"{path}.{k}", k, v
            yield from walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield f"{path}[{i}]", None, v
            yield from walk(v, f"{path}[{i}]")


DEEP = [
    {"a": [{"b": [{"solving_time": 1}, {"x": "solving_time"}]}, [[{"outcome": {"outcome": None}}]]]},
    {"outcome": [1, 2], "z": {"final_status": {}}},
    {"fine": {"outcomes": "outcome", "list": ["final_status", [], {}]}},
    [1, {"final_dual_bound": "é \" ."}],
    7,
    {},
]


def test_forbidden_paths_equal_a_plain_walk(spark):
    data = [(i, json.dumps(v), "x", "y") for i, v in enumerate(DEEP)]
    data += [(90, None, "x", "y"), (91, "{broken", "x", "y"), (92, "", "x", "y"), (0, data[0][1], "x", "y")]
    df = spark.createDataFrame(data, "i int, t string, path string, `_row` string")
    got = J.forbidden_paths(df, "t")
    assert got.columns == ["i", "t", "_row", "path", "key"]
    want = [
        (i, p, k) for i, v in [*enumerate(DEEP), (0, DEEP[0])] for p, k, _ in walk(v, "context")
        if k in J.FORBIDDEN_CONTEXT_KEYS
    ] + [(91, "context", None), (92, "context", None)]
    assert sorted((r.i, r.path, r.key or "") for r in got.collect()) == sorted(
        (i, p, k or "") for i, p, k in want
    )
    assert J.forbidden_paths(df.limit(0), "t").count() == 0
    assert {r.key for r in J.forbidden_paths(df, "t", ["fine"]).where("key is not null").collect()} == {"fine"}


def test_leaves_equal_a_plain_walk(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(DEEP)], "i int, t string")
    got = {(r.i, r.path): json.loads(r.value) for r in J.leaves(df, "t").collect()}
    want = {
        (i, p): x for i, v in enumerate(DEEP) for p, x in [("$", v), *((p, x) for p, _, x in walk(v, "$"))]
        if x == [] or x == {} or not isinstance(x, (dict, list))
    }
    assert got == want


PLAN = "k int, arms array<string>, seeds array<int>, time_limit double, scope string, units array<struct<id:string>>"


def test_contract_differences(spark):
    base = (1, ["shadow", "active"], [1, 2], 300.0, "first-run-only", [("u1",), ("u2",)])
    plan = spark.createDataFrame([base, (None, *base[1:]), (3, *base[1:])], PLAN)
    parts = ["arms", "seeds", "time_limit", "scope", "units"]
    whole = plan.withColumn("time_limit", plan.time_limit.cast("int"))
    assert J.contract_differences(plan, whole, ["k"], parts).count() == 0
    assert J.contract_differences(plan.limit(0), plan.limit(0), ["k"], parts).count() == 0
    other = spark.createDataFrame(
        [(1, ["active", "shadow"], [1], 60.0, None, [("u2",), ("u1",)]), (None, *base[1:])], PLAN
    )
    got = J.contract_differences(plan, other, ["k"], parts).collect()
    assert {(r.path, r.planned, r.found) for r in got if r.k == 1} == {
        ("arms[0]", '"shadow"', '"active"'), ("arms[1]", '"active"', '"shadow"'), ("seeds[1]", "2", None),
        ("time_limit", "300", "60"), ("scope", '"first-run-only"', None),
        ("units[0].id", '"u1"', '"u2"'), ("units[1].id", '"u2"', '"u1"'),
    }
    assert {r.k for r in got} == {1, 3} and all(r.found is None for r in got if r.k == 3)
    assert sum(r.k == 3 for r in got) == 8


def test_forbidden_paths_write_no_levels(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a level was written")

    monkeypatch.setattr(J, "materialize", refuse)
    texts = ['{"a": [1, {"outcome": null}], "b": {"a": 1, "a": 2}}', '{"a": [[{"outcome": 1}]]}', "{", '{"a": NaN}', '"outcome"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = J.forbidden_paths(df, "t", ["outcome"], keep=["i"])
    assert got.columns == ["i", "path", "key"]
    assert sorted((r.i, r.path, r.key) for r in got.collect()) == [
        (0, "context", None), (1, "context.a[0][0].outcome", "outcome"), (2, "context", None), (3, "context", None)
    ]
