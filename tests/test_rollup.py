"""The audit roll-up against plain loops, with nulls, unknown units and empty tables."""

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators import precision as N
from plumbline.operators import quality as Q
from plumbline.operators import rollup as R
from plumbline.operators import sampling as W
from plumbline.plans import cohorts as C

BY = ("artifact", "queue", "status")
RECORDS = [
    ("u1", "a", "q1", "ok"), ("u1", "a", "q1", "ok"), ("u1", "b", "q2", "bad"), ("u2", "a", "q1", "ok"),
    ("u2", "a", None, "ok"), ("u3", "b", "q1", None), ("u4", None, None, None), ("zz", "a", "q1", "ok"),
    (None, "a", "q2", "ok"),
]
UNITS = [("u1", "g", True), ("u2", "g", True), ("u3", "", True), ("u4", None, False), ("u5", "h", True), ("u6", "h", None)]


def frames(spark, records=RECORDS, units=UNITS):
    return (
        spark.createDataFrame(records, "unit string, artifact string, queue string, status string"),
        spark.createDataFrame(units, "unit string, `group` string, active boolean"),
    )


def brute(records, units):
    known = {u: (g or f"={u}", bool(a)) for u, g, a in units}
    cohort = {u for u, (_, a) in known.items() if a}
    out = {("", None, None, None): set()}
    rows = {}
    for n in range(4):
        for cols in combinations(range(3), n):
            for i, r in enumerate(records):
                at = (",".join(BY[c] for c in cols), *[r[1 + c] if c in cols else None for c in range(3)])
                rows.setdefault(at, []).append(i)
    rows.setdefault(("", None, None, None), [])
    out = {}
    for at, members in rows.items():
        ids = [records[i][0] for i in members]
        mine = {u for u in ids if u in known}
        groups = [known[u][0] for u in mine]
        out[at] = (
            len(ids), sum(u not in known for u in ids), len(mine), len(mine & cohort), len(set(groups)),
            sum(groups.count(g) > 1 for g in set(groups)), len(cohort - mine),
        )
    return out


def told(df):
    names = ("rows", "unknown_rows", "units", "active_units", "groups", "repeated_groups", "unevaluated_units")
    got = [((r["level"], *[r[c] for c in BY]), tuple(r[n] for n in names)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_rollup_is_brute_force(spark):
    assert told(R.cohort_rollup(*frames(spark))) == brute(RECORDS, UNITS)
    split = [f.repartition(7) for f in frames(spark)]
    assert told(R.cohort_rollup(*split)) == brute(RECORDS, UNITS)


def test_rollup_of_empty_tables_and_clashing_columns(spark):
    assert told(R.cohort_rollup(*frames(spark, []))) == {("", None, None, None): (0, 0, 0, 0, 0, 0, 4)}
    assert told(R.cohort_rollup(*frames(spark, RECORDS, []))) == brute(RECORDS, [])
    records, units = frames(spark)
    extra = records.withColumns({"level": F.lit(1), "rows": F.lit(2), "group": F.lit("x"), "active": F.lit(True)})
    assert told(R.cohort_rollup(extra, units.withColumn("status", F.lit("s")))) == brute(RECORDS, UNITS)


def test_report_rows(spark):
    summary = spark.createDataFrame([("a", None, 3, True, None)], "arm string, split string, n int, ok boolean, r double")
    got = {r["measure"]: (r["artifact"], r["key"], r["value"]) for r in R.report_rows("x", summary, ["arm", "split"]).collect()}
    assert got == {"n": ("x", "a|", "3"), "ok": ("x", "a|", "true"), "r": ("x", "a|", None)}


def test_audit_rollup_job(spark):
    records, units = frames(spark)
    assigned = spark.createDataFrame(
        [("u1", "g", "train"), ("u2", "g", "test"), ("u3", "g", "test"), ("u4", "k", "test")],
        "unit string, cluster string, split string",
    )
    arms = spark.createDataFrame([("a", 2)], "arm string, wins int")
    done = C.audit_rollup(records, units, assigned, {"arms": (arms, ["arm"])})
    members = {(r["split"], r["member"]): (r["unit"], r["seen_in_training"]) for r in done.members.collect()}
    assert members == {("test", 1): ("u2", True), ("test", 2): ("u3", True)}
    report = {(r["artifact"], r["key"], r["measure"]): r["value"] for r in done.report.collect()}
    assert report["arms", "a", "wins"] == "2" and report["support", "test", "repeated_clusters"] == "1"
    assert report["rollup", "|||", "unevaluated_units"] == "1"


def test_future_design(spark):
    spread = spark.createDataFrame([("a", 0.2), ("b", 0.3)], "arm string, sigma double")
    support = spark.createDataFrame([(34, 24)], "clusters bigint, unseen_in_training bigint")
    got = {(r["quantity"], r["scenario"]): r["value"] for r in N.future_design(spread, support).collect()}
    basis = [got["basis", c] for c in ("superiority", "noninferiority", "safety")]
    assert got["superiority_and_safety", "units"] == max(basis[0], basis[2])
    need = got["dual_purpose", "units"]
    assert need == max(basis) == 234 and got["basis", "safety"] == 59
    assert (got["dual_purpose", "beyond_available"], got["dual_purpose", "beyond_unseen"]) == (200, 210)
    assert (got["dual_purpose", "runs_of_2_arms"], got["dual_purpose", "runs_of_3_arms"]) == (need * 6, need * 9)
    # nothing lacks where enough is there
    plenty = N.future_design(spread, spark.createDataFrame([(10_000, 10_000)], support.schema))
    assert plenty.where("scenario LIKE 'beyond%' AND value <> 0").isEmpty()


def test_fold_summary(spark):
    folds = spark.createDataFrame(
        [("a", 2, 6, 0), ("b", 1, 2, 1), ("c", 1, 2, 1)], "cluster string, units bigint, rows bigint, fold int"
    )
    got = {r["fold"]: tuple(r)[1:] for r in W.fold_summary(folds).collect()}
    assert got == {0: (1, 2, 6, 0.6), 1: (2, 2, 4, 0.4)}


def test_record_profile_tells_null_statuses_from_the_whole(spark):
    rows = [("optimal", 4), ("optimal", None), (None, 10), (None, 20)]
    df = spark.createDataFrame(rows, "native_status string, n_candidates bigint")
    got = {(r["whole"], r["status"]): tuple(r)[2:] for r in Q.record_profile(df).collect()}
    assert got == {
        (False, "optimal"): (2, 1, 4, 4, 4.0), (False, None): (2, 2, 10, 20, 15.0), (True, None): (4, 3, 4, 20, 34 / 3),
    }
