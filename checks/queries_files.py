"""Sources and sinks: rows go out to files and come back, or texts are parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.queries_ranking import rounded
from checks.views import (
    CELLS_SQL, PAIRED_SQL, SPLIT_SQL, cand, cand_sql, pairs_cells, split_of, table,
)
from plumbline.functions import exprs as E
from plumbline.operators import protocols as V
from plumbline.session import scratch_root
from plumbline.sources import files as S
from plumbline.sources import manifests as M
from plumbline.sources import trace as T
from plumbline.streaming import incremental as I

QUERIES, ORACLES = {}, {}
PLACE = r"split=([^/]+)/unit=([^/]+)/([^/]+)$"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fresh(spark, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


# Files are laid out per supplier nation: a few dozen folders at any scale.
NATION_SQL = """n AS (SELECT l.*, s_nationkey AS unit, CASE WHEN s_nationkey % 3 = 0 THEN 'train'
  WHEN s_nationkey % 3 = 1 THEN 'val' ELSE 'test' END AS split
  FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey)"""


def nation_split(unit):
    k = unit % 3
    return F.when(k == 0, "train").when(k == 1, "val").otherwise("test")


def nation_rows(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("unit"))
    rows = table(spark, sf, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.withColumn("split", nation_split(F.col("unit"))).drop("s_suppkey")


COLUMNS = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "note"]


def write_lines(spark, sf) -> str:
    """CSV lines; line number 7 lacks its last two fields, notes carry commas."""
    path = fresh(spark, "trace")
    start = F.concat_ws(",", "l_orderkey", "l_partkey", "l_linenumber")
    full = F.concat(start, F.lit(","), "l_returnflag", F.lit(',"a,b(""c"")"'))
    rows = nation_rows(spark, sf)
    rows.select(
        "split", "unit", F.when(F.col("l_linenumber") == 7, start).otherwise(full).alias("value")
    ).write.partitionBy("split", "unit").text(path)
    return path


@query(
    "trace_read",
    f"""WITH {NATION_SQL}
SELECT split, unit::VARCHAR AS unit, l_returnflag, 'a,b("c")' AS note, count(*) AS rows,
  sum(l_partkey)::BIGINT AS parts FROM n WHERE l_linenumber <> 7 GROUP BY ALL""",
)
def trace_read(spark, sf):
    rows = T.read_trace(
        spark, write_lines(spark, sf), "*.txt", COLUMNS, folders="split=*/unit=*", place=PLACE,
        header=False,
    )
    return rows.groupBy("split", "unit", "l_returnflag", "note").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(E.integer("l_partkey")).alias("parts")
    )


@query(
    "malformed_rows",
    f"""WITH {NATION_SQL}
SELECT split, count(*) AS rows, count(*) FILTER (l_linenumber = 7) AS malformed_rows,
  count(*) FILTER (l_linenumber <> 7) AS parsed_rows FROM n GROUP BY split""",
)
def malformed_rows(spark, sf):
    rows = T.read_trace(
        spark, write_lines(spark, sf), "*.txt", COLUMNS, malformed=True, folders="split=*/unit=*",
        place=PLACE, header=False,
    )
    return T.malformed_counts(rows, COLUMNS[0])


@query(
    "header_mismatches",
    f"""WITH {NATION_SQL} SELECT DISTINCT split, unit::VARCHAR AS unit, 'l_partkey,cost' AS header
FROM n WHERE unit % 9 = 2""",
)
def header_mismatches(spark, sf):
    path = fresh(spark, "headers")
    rows = nation_rows(spark, sf).select("split", "unit", "l_partkey", "l_quantity")
    out = lambda df: df.write.mode("append").option("header", True).partitionBy(
        "split", "unit").csv(path)
    out(rows.where("unit % 9 <> 2"))
    out(rows.where("unit % 9 = 2").withColumnRenamed("l_quantity", "cost"))
    head = T.headers(spark, path, "*.csv", folders="split=*/unit=*", place=PLACE)
    return T.header_mismatches(head).select("split", "unit", "header").distinct()


@query(
    "missing_files",
    f"""WITH {NATION_SQL}, w AS (SELECT DISTINCT split, unit::VARCHAR AS unit, unnest(['a', 'b', 'c']) AS file FROM n)
SELECT * FROM w WHERE (file = 'b' AND unit::INT % 4 = 0) OR (file = 'c' AND unit::INT % 7 = 0)""",
)
def missing_files(spark, sf):
    n = nation_rows(spark, sf).select("split", F.col("unit").cast("string").alias("unit")).distinct()
    files = n.withColumn("file", F.explode(F.array(*[F.lit(f) for f in "abc"])))
    u = F.col("unit").cast("int")
    gone = ((F.col("file") == "b") & (u % 4 == 0)) | ((F.col("file") == "c") & (u % 7 == 0))
    return T.missing_files(files.where(~gone), ["a", "b", "c"])


@query(
    "selector_statistics",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS calls,
  CASE WHEN o_orderstatus <> 'P' THEN 3::BIGINT END AS root_calls,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS selected,
  CASE WHEN o_orderstatus <> 'P' THEN 0::BIGINT END AS forced,
  CASE WHEN o_orderstatus <> 'P' THEN 9::BIGINT END AS filtered,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS runs FROM orders""",
)
def selector_statistics(spark, sf):
    line = F.concat(
        F.when(F.col("o_orderstatus") == "P", "  other").otherwise("  hybrid"),
        F.lit("   :   0.03  0.00 "), "o_custkey", F.lit("  3 "), "o_orderkey", F.lit(" 0 9 10\n"),
    )
    runs = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("  number of runs : "),
                                                       F.col("o_orderkey") % 5)).otherwise("")
    texts = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("Status: x\n"), line, runs).alias("value")
    )
    return T.selector_statistics(texts, "hybrid").select(
        "o_orderkey", *T.STATISTICS, T.number_of_runs("value").alias("runs")
    )


@query(
    "summary_objects",
    """SELECT o_orderstatus AS status, count(*) AS units, sum(CASE WHEN o_orderkey % 3 = 0 THEN 0
  ELSE o_custkey END)::BIGINT AS n_candidate_cuts FROM orders GROUP BY 1""",
)
def summary_objects(spark, sf):
    path = fresh(spark, "summaries")
    table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("n_candidate_cuts"),
    ).write.json(path)
    rows = spark.read.schema("status string, n_candidate_cuts bigint").json(path)
    return rows.na.fill(0).groupBy("status").agg(
        F.count(F.lit(1)).alias("units"), F.sum("n_candidate_cuts").alias("n_candidate_cuts")
    )


@query(
    "line_list",
    "SELECT DISTINCT c_name AS line, 1::BIGINT AS n FROM customer WHERE c_custkey % 3 <> 0",
)
def line_list(spark, sf):
    path = fresh(spark, "lines")
    k = F.col("c_custkey") % 3
    table(spark, sf, "customer").select(
        F.when(k == 0, "  # note").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("v")
    ).write.text(path)
    return T.read_lines(spark, path, comments=True).groupBy("line").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "metadata_contract",
    """SELECT c_custkey::VARCHAR AS unit, c_mktsegment AS grp, CASE WHEN c_custkey % 4 = 0 THEN ''
  ELSE c_name END AS note FROM customer""",
)
def metadata_contract(spark, sf):
    path = fresh(spark, "metadata")
    table(spark, sf, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("grp"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("note"),
    ).write.option("header", True).csv(path)
    return T.read_metadata(spark, path, ["unit", "grp"], "unit")


@query(
    "gzip_csv_read",
    "SELECT l_returnflag, count(*) AS rows, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY 1",
)
def gzip_csv_read(spark, sf):
    path = fresh(spark, "gz")
    table(spark, sf, "lineitem").select("l_partkey", "l_returnflag").write.option(
        "compression", "gzip").option("header", True).csv(path)
    rows = spark.read.schema(T.text_schema(["l_partkey", "l_returnflag"])).option("header", True)
    return rows.csv(path).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(E.integer("l_partkey")).alias("parts")
    )


@query(
    "record_lines",
    f"""WITH {CELLS_SQL} SELECT unit, seed, arm, complete, nodes FROM cells""",
)
def record_lines(spark, sf):
    path = fresh(spark, "records")
    label = F.struct("complete", "nodes")
    M.write_records(pairs_cells(spark, sf).select("unit", "seed", "arm", label.alias("label")), path)
    schema = "unit bigint, seed bigint, arm string, label struct<complete: boolean, nodes: bigint>"
    return M.read_records(spark, path, schema).select("unit", "seed", "arm", "label.*")


@query(
    "manifest_pairs",
    f"""WITH {PAIRED_SQL}
SELECT unit::VARCHAR AS unit, seed, arm, CASE WHEN native_complete THEN 'optimal' ELSE 'timelimit' END
  AS native_status, CASE WHEN treatment_complete THEN 'optimal' ELSE 'timelimit' END AS treatment_status,
  native_nodes, treatment_nodes, treatment_nodes % 2 AS interventions FROM paired""",
)
def manifest_pairs(spark, sf):
    """Each (unit, seed) block becomes one nested manifest text and is flattened
    again; a block holds one run per arm, so its text stays small."""
    c = pairs_cells(spark, sf)
    status = F.when(F.col("complete"), "optimal").otherwise("timelimit").alias("status")
    outcome = F.struct(status, "nodes", F.lit("inf").alias("primal_bound"))
    selector = F.struct((F.col("nodes") % 2).alias("interventions"))
    run = F.struct(outcome.alias("outcome"), selector.alias("selector"))
    native = F.col("arm") == "view"
    grouped = c.groupBy("unit", "seed").agg(
        F.first(F.when(native, outcome), ignorenulls=True).alias("native_outcome"),
        F.map_from_entries(F.collect_list(F.when(~native, F.struct("arm", run.alias("run"))))).alias(
            "actions"
        ),
    )
    pair = F.struct("seed", "native_outcome", "actions")
    unit = F.struct(F.col("unit").cast("string").alias("instance_id"), F.array(pair).alias("pairs"))
    path = fresh(spark, "manifests")
    grouped.where("native_outcome IS NOT NULL").select(
        F.to_json(F.struct(F.lit(200.0).alias("time_limit"), F.array(unit).alias("per_instance")))
    ).write.text(path)
    texts = spark.read.text(path).select(F.from_json("value", M.MANIFEST).alias("m")).select("m.*")
    return M.flat_manifest(texts).select(
        "unit", "seed", "arm",
        F.col("native.status").alias("native_status"),
        F.col("treatment.outcome.status").alias("treatment_status"),
        F.col("native.nodes").alias("native_nodes"),
        F.col("treatment.outcome.nodes").alias("treatment_nodes"),
        F.col("treatment.selector.interventions").alias("interventions"),
    )


@query(
    "canonical_hash",
    """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}')
  AS context_sha256 FROM documents""",
)
def canonical_hash(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", M.canonical_hash(["source", "doc_id", "lang"]).alias("context_sha256"))


@query(
    "ranking_store",
    f"""WITH {cand_sql()}
SELECT decision, l_partkey, score, label FROM cand WHERE split = 'val'""",
)
def ranking_store(spark, sf):
    path = fresh(spark, "ranking")
    c = cand(spark, sf).withColumn("subset", F.concat(F.lit("seen_"), "split"))
    S.write_ranking_dataset(c.select("decision", "l_partkey", "score", "label", "subset"), path)
    return S.read_ranking_dataset(spark, path, "seen_val").drop("subset")


@query(
    "partitioned_store",
    f"""WITH {cand_sql()} SELECT split, count(*) AS rows FROM cand GROUP BY split""",
)
def partitioned_store(spark, sf):
    path = fresh(spark, "table")
    S.write_table(cand(spark, sf).select("decision", "split"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def prints(spark, sf, changed: bool):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    text = F.when(k % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows = d.where(k % 7 != 0) if changed else d.where(k % 5 != 0)
    return rows.select(
        k.alias("path"), F.sha2(text if changed else F.col("text"), 256).alias("sha256"),
        F.length("text").cast("bigint").alias("bytes"),
    )


@query(
    "manifest_verification",
    """SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'unexpected'
  ELSE 'content-mismatch' END AS problem FROM documents
WHERE (doc_id % 7 = 0) <> (doc_id % 5 = 0) OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 = 0)""",
)
def manifest_verification(spark, sf):
    return S.verify(prints(spark, sf, False), prints(spark, sf, True))


@query(
    "tier_totals",
    """SELECT CASE WHEN i = 0 THEN 'all' ELSE lang END AS tier, count(*) AS files, sum(length(text))::BIGINT AS bytes
FROM documents, range(2) t(i) GROUP BY 1""",
)
def tier_totals(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(
        F.explode(F.array(F.lit("all"), "lang")).alias("tier"), F.length("text").alias("bytes")
    )
    return S.tier_totals(rows)


@query("file_fingerprints")
def file_fingerprints(spark, sf):
    return S.fingerprint(spark, {"facts": [f"{sf}/lineitem.parquet"], "all": [f"{sf}/*.parquet"]})


@query(
    "pending_sources",
    """SELECT 's' AS split, o_custkey AS unit, o_orderkey AS path, o_custkey AS length, o_orderdate AS "modificationTime",
  'r3' AS revision FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus = 'P'""",
)
def pending_sources(spark, sf):
    o = table(spark, sf, "orders").select(
        F.lit("s").alias("split"), F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("path"),
        F.col("o_custkey").alias("length"), F.col("o_orderdate").alias("modificationTime"),
        "o_orderstatus",
    )
    current = I.source_signatures(o, "r3")
    old = o.where("path % 3 <> 0").withColumn(
        "length", F.when(F.col("o_orderstatus") == "P", F.col("length") + 1)
        .otherwise(F.col("length"))
    )
    return I.pending(current, I.source_signatures(old, "r3"))
