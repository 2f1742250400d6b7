"""Queries of operators that no other module exercises alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries_files import fresh
from checks.queries_models import oof_scores
from checks.views import RISK_SQL, UNITS_SQL, table, units
from plumbline.functions import exprs as E
from plumbline.operators import decisions as D
from plumbline.operators import nested as J
from plumbline.operators import quality as Q
from plumbline.operators import sampling as W
from plumbline.sources import files as S
from plumbline.sources import manifests as M

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "finite_aggregates",
    """WITH e AS (SELECT vec_id, list_filter(embedding, lambda x, i: (i - 1) % 7 <> 0) AS v,
  list_filter(embedding, lambda x, i: (i - 1) % 5 <> 0) AS f FROM embeddings)
SELECT vec_id, round(list_avg(list_transform(v, lambda x: x::DOUBLE)), 9) AS mean,
  list_min(v)::DOUBLE AS low, list_max(v)::DOUBLE AS high,
  round(len(list_filter(f, lambda x: x > 0)) / len(f)::DOUBLE, 9) AS positive FROM e""",
)
def finite_aggregates(spark, sf):
    holes = F.transform("embedding", lambda x, i: F.when(i % 7 == 0, F.lit(float("nan"))).otherwise(x))
    flags = F.transform("embedding", lambda x, i: F.when(i % 5 != 0, x > 0))
    return table(spark, sf, "embeddings").withColumn("v", holes).withColumn("f", flags).select(
        "vec_id", F.round(E.finite_mean("v"), 9).alias("mean"), E.finite_min("v").alias("low"),
        E.finite_max("v").alias("high"), F.round(E.true_fraction("f"), 9).alias("positive"),
    )


@query(
    "root_filter",
    """SELECT count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber = 1) AS root_rows,
  count(*) FILTER (WHERE (l_returnflag = 'R') <> (l_linenumber = 1)) AS root_depth_disagreements
FROM lineitem""",
)
def root_filter(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "True").otherwise("False").alias("root"),
        (F.col("l_linenumber") - 1).cast("string").alias("node_depth"),
    )
    root, clash = D.root_rows(rows)
    return clash.select(
        root.agg(F.count(F.lit(1))).scalar().alias("root_rows"), "root_depth_disagreements"
    )


@query(
    "leave_one_unit_out",
    f"""WITH {UNITS_SQL} SELECT unit, dense_rank() OVER (ORDER BY unit) AS fold, count(*) AS rows
FROM units GROUP BY unit""",
)
def leave_one_unit_out(spark, sf):
    folds = W.leave_one_out_folds(units(spark, sf).select("unit"))
    return folds.groupBy("unit", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "assignment_prefix",
    "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey, s_suppkey LIMIT 12",
)
def assignment_prefix(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return W.first_units(rows, ["s_nationkey", "s_suppkey"], 12)


@query(
    "union_of_sources",
    "SELECT o_orderstatus, count(*) AS records, max(o_orderkey) AS last_record FROM orders GROUP BY 1",
)
def union_of_sources(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    one = F.array(F.lit("active"), F.lit("native"))
    other = F.array(F.lit("native"), F.lit("active"))
    whole = Q.union_sources(
        [
            rows.where("o_custkey % 2 = 0").withColumn("arms", one),
            rows.where("o_custkey % 2 = 1").withColumn("arms", other),
        ],
        ["o_orderkey"],
    )
    return whole.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("records"), F.max("o_orderkey").alias("last_record")
    )


@query(
    "nested_projection",
    """SELECT l_orderkey, '[' || string_agg('{"line":' || l_linenumber || '}', ',' ORDER BY l_linenumber) || ']'
  AS lines FROM lineitem GROUP BY 1""",
)
def nested_projection(spark, sf):
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("context"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(item)).alias("lines")
    )
    return rows.select("l_orderkey", F.to_json(M.drop_nested("lines", "context")).alias("lines"))


@query(
    "report_sink",
    "SELECT l_returnflag AS flag, count(*) AS rows, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1",
)
def report_sink(spark, sf):
    report = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_linenumber").cast("long").alias("lines")
    )
    as_json, as_csv = fresh(spark, "report"), fresh(spark, "report")
    S.write_report(report, as_json)
    S.write_report(report, as_csv, "csv")
    schema = "flag string, rows long, lines long"
    told = spark.read.schema(schema).json(as_json)
    return told.intersect(spark.read.schema(schema).option("header", True).csv(as_csv))


@query(
    "file_hashes",
    """SELECT n_nationkey::BIGINT AS unit, sha256(n_name || chr(10)) AS sha256, (length(n_name) + 1)::BIGINT AS bytes
FROM nation""",
)
def file_hashes(spark, sf):
    path = fresh(spark, "names")
    names = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    names.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    prints = S.fingerprint(spark, {"names": [f"{path}/*/*.txt"]})
    unit = F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).cast("long")
    return prints.select(unit.alias("unit"), "sha256", "bytes")


@query(
    "oof_coverage",
    f"""WITH {RISK_SQL} SELECT count(*) AS rows, count(DISTINCT doc_id) AS documents,
  sum(label)::BIGINT AS positives, 3::BIGINT AS folds, true AS inside, true AS apart FROM risk""",
)
def oof_coverage(spark, sf):
    """What is certain of out-of-fold scores, whatever the trees: each row once, in one of
    three folds, a probability, and no unit in two folds."""
    scores = oof_scores(spark, sf)
    units = scores.groupBy("unit").agg(F.count_distinct("fold").alias("f")).agg(F.max("f") == 1)
    return scores.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents"),
        F.sum("label").cast("long").alias("positives"), F.count_distinct("fold").alias("folds"),
        F.bool_and((F.col("model_score") >= 0) & (F.col("model_score") <= 1)).alias("inside"),
    ).withColumn("apart", units.scalar())


@query(
    "forbidden_paths",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem)
SELECT l_orderkey, 'context.order.lines[' || i || '].solving_time' AS path, 'solving_time' AS key
FROM l WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, 'context.order.lines[' || i || '].more[0].outcome', 'outcome'
FROM l WHERE l_linenumber = 3""",
)
def forbidden_paths(spark, sf):
    """Contexts of four levels, of which some hold keys that only an outcome has."""
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("solving_time"),
        F.array(F.struct(F.when(F.col("l_linenumber") == 3, F.col("l_tax")).alias("outcome"),
                         F.lit("outcome").alias("word"))).alias("more"),
    )
    lines = F.array_sort(F.collect_list(line)).alias("lines")
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(lines)
    texts = orders.select(
        "l_orderkey", F.to_json(F.struct(F.struct("lines").alias("order"))).alias("context")
    )
    return J.forbidden_paths(texts, "context", keep=["l_orderkey"])


@query(
    "plan_differences",
    """WITH o AS (SELECT o_custkey AS unit, o_orderkey AS k,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS j FROM orders),
u AS (SELECT DISTINCT unit FROM o)
SELECT p.unit, 'units[' || p.i || '].id' AS path, p.k::VARCHAR AS planned, r.k::VARCHAR AS found
FROM o p JOIN o r ON p.unit = r.unit AND p.i = r.j WHERE p.k <> r.k
UNION ALL SELECT unit, 'arms[1]', '"active"', NULL FROM u WHERE unit % 5 = 0
UNION ALL SELECT unit, 'time_limit', '300', '60' FROM u WHERE unit % 7 = 0
UNION ALL SELECT unit, 'scope', '"first-run-only"', '"per-run"' FROM u WHERE unit % 11 = 0
UNION ALL SELECT unit, 'seeds[0]', NULL, '1' FROM u WHERE unit % 13 = 0
UNION ALL SELECT unit, 'seeds', '[]', NULL FROM u WHERE unit % 13 = 0""",
)
def plan_differences(spark, sf):
    """Plans that hold and plans broken in arms, limit, scope, seeds or order of units."""
    unit = F.col("o_custkey")
    by_key = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"))))
    by_date = F.array_sort(F.collect_list(F.struct("o_orderdate", F.col("o_orderkey").alias("id"))))
    both = table(spark, sf, "orders").groupBy(unit.alias("unit")).agg(
        by_key.alias("planned"), F.transform(by_date, lambda u: F.struct(u["id"].alias("id"))).alias("run")
    )
    arms, on = F.array(F.lit("shadow"), F.lit("active")), lambda n: F.col("unit") % n == 0
    none = F.array().cast("array<int>")
    plan = both.select(
        "unit", arms.alias("arms"), none.alias("seeds"), F.lit(300.0).alias("time_limit"),
        F.lit("first-run-only").alias("scope"), F.col("planned").alias("units"),
    )
    result = both.select(
        "unit", F.when(on(5), F.slice(arms, 1, 1)).otherwise(arms).alias("arms"),
        F.when(on(13), F.array(F.lit(1))).otherwise(none).alias("seeds"),
        F.when(on(7), 60).otherwise(300).alias("time_limit"),
        F.when(on(11), "per-run").otherwise("first-run-only").alias("scope"), F.col("run").alias("units"),
    )
    parts = ["arms", "seeds", "time_limit", "scope", "units"]
    return J.contract_differences(plan, result, ["unit"], parts)
