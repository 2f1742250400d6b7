"""Scalar rules that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import draws
from plumbline.functions import exprs as E


def value(spark, *cols, data=((1,),), schema="x int"):
    return spark.createDataFrame(list(data), schema).select(*cols).first()


@pytest.mark.parametrize(
    "text,flag,strict",
    [(" TRUE ", True, False), ("True", True, True), ("1", True, False), ("yes", True, False),
     ("t", False, False), ("", False, False), (None, False, False)],
)
def test_two_boolean_rules(spark, text, flag, strict):
    r = value(spark, E.flag("t"), E.exact_true("t"), data=[(text,)], schema="t string")
    assert tuple(r) == (flag, strict)


@pytest.mark.parametrize(
    "text,number", [("3.0", 3), ("-2.9", -2), ("x", None), (None, None)]
)
def test_integer_truncates(spark, text, number):
    assert value(spark, E.integer("t"), data=[(text,)], schema="t string")[0] == number


@pytest.mark.parametrize("text", ["inf", "-inf", "nan", "", "abc", None])
def test_bad_scores_sort_last(spark, text):
    assert value(spark, E.score("t"), data=[(text,)], schema="t string")[0] == -math.inf


def test_numeric_feature(spark):
    df = spark.createDataFrame([("",), ("nan",), ("inf",), ("2",), (None,), ("x",)], "t string")
    got = [r[0] for r in df.select(E.numeric_feature("t")).collect()]
    assert [g for g in got if not math.isnan(g)] == [2.0]


def test_family_key(spark):
    df = spark.createDataFrame([("supportcase33.mps.gz",), ("app1-2.mps.gz",)], "n string")
    assert [r[0] for r in df.select(E.family_key("n")).collect()] == ["supportcase", "app"]


@pytest.mark.parametrize(
    "a,b,same",
    [(1.0, 1.0 + 1e-10, True), (1.0, 1.0 + 1e-8, False), (math.nan, math.nan, True),
     (math.inf, math.inf, True), (math.inf, -math.inf, False), (0.0, 1e-10, True),
     (math.nan, 1.0, False), (None, None, True), (None, 1.0, False)],
)
def test_close_to(spark, a, b, same):
    r = value(spark, E.close_to("a", "b"), data=[(a, b)], schema="a double, b double")
    assert r[0] is same


def test_vector_summary(spark):
    s = value(spark, E.vector_summary("v"), data=[([1.0, -2.0],)], schema="v array<double>")[0]
    assert (s["nnz"], s["norm_l1"], s["std_abs"]) == (2, 3.0, 0.5)
    assert s["norm_l2"] == pytest.approx(math.sqrt(5))
    empty = value(spark, E.vector_summary("v"), data=[([],)], schema="v array<double>")[0]
    assert list(empty) == [0, 0, 0, 0, 0, 0, 0]


def test_array_helpers_ignore_bad_values(spark):
    data = [([1.0, None, math.nan, math.inf, 3.0], [True, None, False])]
    r = value(
        spark, E.finite_mean("v"), E.finite_min("v"), E.finite_max("v"), E.true_fraction("f"),
        E.safe_ratio(F.lit(1.0), F.lit(0.0)), data=data, schema="v array<double>, f array<boolean>",
    )
    assert tuple(r)[:4] == (2.0, 1.0, 3.0, 0.5) and math.isnan(r[4])


def log_cdf(k, n, p):
    return math.log(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


@pytest.mark.parametrize("k,n", [(0, 59), (1, 20), (7, 30), (29, 30), (30, 30), (0, 0)])
def test_binomial_upper_bound(spark, k, n):
    got = value(spark, E.binomial_upper_bound("k", "n"), data=[(k, n)], schema="k int, n int")[0]
    if n == 0:
        assert got is None
    elif k == n:
        assert got == 1.0
    else:
        assert log_cdf(k, n, got) == pytest.approx(math.log(0.05), abs=1e-9)
    if (k, n) == (0, 59):
        assert got == pytest.approx(1 - 0.05 ** (1 / 59)) and got < 0.05


def test_penalised_time(spark):
    r = value(
        spark, E.penalised_time(F.lit(True), F.lit(0.0), 100.0),
        E.penalised_time(F.lit(False), F.lit(3.0), 100.0),
    )
    assert tuple(r) == (1e-12, 200.0)


def test_starred_number(spark):
    df = spark.createDataFrame([("12.5*",), ("7",), ("-",)], "t string")
    assert [r[0] for r in df.select(E.starred_number("t")).collect()] == [12.5, 7.0, None]


def python_mix(h):
    for _ in range(2):
        h = ((h ^ (h >> 16)) * 73_244_475) % 2**32
    return h ^ (h >> 16)


def test_draws_match_plain_arithmetic(spark):
    df = spark.range(200).select("id", draws.mix32(F.col("id")).alias("m"))
    assert all(r["m"] == python_mix(r["id"]) for r in df.collect())
    assert df.select("m").distinct().count() == 200


def test_linear_score_moves_weight_without_incumbent(spark):
    w = {"distance": 0.5, "efficacy": 1.0, "integer": 0.1, "parallelism": 0.1}

    def run(incumbent, local):
        c = E.linear_score(
            F.lit(2.0), F.lit(3.0), F.lit(0.5), F.lit(1.0), incumbent=F.lit(incumbent),
            local=F.lit(local), pool=F.lit(True), weights=w,
        )
        return value(spark, c)[0]

    rest = 0.05 + 0.1 + 1e-4
    assert run(True, False) == pytest.approx(0.5 * 3 + 2 + rest)
    assert run(True, True) == pytest.approx(0.5 * 2 + 2 + rest)
    assert run(False, False) == pytest.approx(1.5 * 2 + rest)


def test_exact_bound_against_sums_of_the_binomial(spark):

    def tail(k, n, p):
        lg = math.lgamma
        terms = (lg(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1))
        return math.fsum(map(math.exp, terms))

    pairs = [(k, n) for n in (1, 2, 3, 10, 200, 1500) for k in {0, 1, n // 3, n // 2, n - 1, n} if k <= n]
    schema = "k long, n long"
    frame = spark.createDataFrame([*pairs, (10**7, 2 * 10**7), (None, 3), (2, None), (0, 0)], schema)
    got = {(r.k, r.n): r.p for r in frame.select("k", "n", E.binomial_upper_bound("k", "n").alias("p")).collect()}
    for k, n in pairs:
        if k == n:
            assert got[k, n] == 1.0
        else:
            assert tail(k, n, got[k, n]) == pytest.approx(0.05, rel=1e-9)
    # Half of very many: close to the normal bound.
    assert got[10**7, 2 * 10**7] == pytest.approx(0.5 + 1.6448536 * 0.5 / math.sqrt(2e7), abs=1e-7)
    assert got[None, 3] is got[2, None] is got[0, 0] is None


def test_exact_sum_does_not_hang_on_the_order_of_rows(spark):
    rows = [(k, v) for k, vs in {
        "tenths": [0.1] * 10, "mixed": [72.91, 0.07, 27.02], "none": [None], "large": [1e25, 1.0],
    }.items() for v in vs]
    got = spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(E.exact_sum("v").alias("s"))
    assert {r["k"]: r["s"] for r in got.collect()} == {"tenths": 1.0, "mixed": 100.0, "none": None, "large": 1e25}


def test_cells_sum_their_values_exactly(spark, tmp_path):
    from checks.views import pairs_cells

    rows = spark.range(10).selectExpr("timestamp'2024-01-01' AS ts", "7L AS user_id", "'view' AS event_type", "0.1D AS value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    (cell,) = pairs_cells(spark, str(tmp_path)).collect()
    assert (cell["work"], cell["time"]) == (1.0, 0.1)


def test_typed_parsing_equals_its_sql_on_odd_prices(spark, tmp_path):
    import duckdb

    from checks import queries_audit as Q
    from checks.verify import compare

    prices = [1.5, None, math.inf, -math.inf, math.nan, 1e22, -0.0]
    lines = [(i, i, n, 2.0, p) for i, p in enumerate(prices) for n in (*range(1, 8), None)]
    names = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert compare(Q.typed_parsing(spark, str(tmp_path)), con, Q.ORACLES["typed_parsing"]) == ("", len(lines))
