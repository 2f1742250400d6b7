"""Role views over the given tables, as DataFrames and as SQL text.

``cand``  lineitem, orders and customer as candidates of decisions
``occ``   the same rows as raw occurrences with repeated and colliding ids
``pairs`` events as units x seeds x arms of a paired experiment
``risk``  labelled documents as scored risk rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.operators.ordering import deal, sums_in_order

_SCHEMAS: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One given table; its schema is read from the footer once per path."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


SEQ = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
# The price is unique inside an order, so it alone orders the occurrences.
OCC_SEQ = ["l_extendedprice"]


def split_of(c):
    r = c % 20
    return F.when(r.isin(13, 16, 17), "val").when(r.isin(15, 18, 19), "test").otherwise("train")


SPLIT_SQL = (
    "CASE WHEN {c} % 20 IN (13,16,17) THEN 'val' "
    "WHEN {c} % 20 IN (15,18,19) THEN 'test' ELSE 'train' END"
)
CLUSTER_SQL = "CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 'f' || (c_custkey // 2) END"


def units(spark, sf) -> DataFrame:
    """One row per unit with its split and cluster."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("unit"),
        F.when(F.col("c_nationkey") % 5 == 0, "")
        .otherwise(F.concat(F.lit("f"), F.floor(F.col("c_custkey") / 2).cast("string")))
        .alias("grp"),
        split_of(F.col("c_custkey")).alias("split"),
    )


UNITS_SQL = f"""units AS (
  SELECT c_custkey AS unit, {CLUSTER_SQL} AS grp, {SPLIT_SQL.format(c='c_custkey')} AS split
  FROM customer)"""


def cand_rows(spark, sf) -> int:
    """Rows that candidates, and what joins them, are dealt for."""
    return table(spark, sf, "lineitem").count()


def cand(spark, sf, *extra: str) -> DataFrame:
    """Candidates; the unit table joins in only when its columns are asked for.

    They are dealt by order, so what follows per decision runs in the tasks of the join."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    li = deal(li, ["l_orderkey"], cand_rows(spark, sf))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("unit"),
        F.year("o_orderdate").alias("run"),
        F.col("l_orderkey").alias("decision"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("second"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        split_of(F.col("o_custkey")).alias("split"),
        *SEQ,
        *extra,
    )


def cand_sql(*extra: str) -> str:
    more = "".join(f", {e}" for e in extra)
    return f"""cand AS (
  SELECT o_custkey AS unit, year(o_orderdate)::INT AS run, l_orderkey AS decision,
         l_extendedprice AS score, l_quantity AS second,
         (l_returnflag = 'R')::INT AS label, {SPLIT_SQL.format(c='o_custkey')} AS split,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice{more}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


RANKED_SQL = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY decision ORDER BY score DESC, l_linenumber,
           l_partkey, l_suppkey) AS baseline_rank FROM cand)"""


def occ(spark, sf) -> DataFrame:
    c = cand(spark, sf, "l_returnflag", "l_linestatus", "l_discount")
    return c.select(
        "unit", "run", "decision", "score", "split", *SEQ,
        (F.col("l_suppkey") % 4).cast("string").alias("source_id"),
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("signature"),
        (F.col("l_discount") >= 0.05).alias("applied"),
        (F.col("l_linenumber") == 7).alias("forced"),
    )


OCC_SQL = f"""{cand_sql('l_returnflag', 'l_linestatus', 'l_discount')},
occ AS (
  SELECT unit, run, decision, score, split, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         (l_suppkey % 4)::VARCHAR AS source_id, l_returnflag || '/' || l_linestatus AS signature,
         l_discount >= 0.05 AS applied, l_linenumber = 7 AS forced,
         l_extendedprice AS seq
  FROM cand),
logical AS (
  SELECT unit, run, decision, split, source_id, signature, count(*) AS multiplicity,
         arg_min(score, seq) AS score, bool_or(applied) AS observed_applied,
         bool_or(applied) = bool_and(applied) AS labels_consistent,
         min(seq) AS first_l_extendedprice
  FROM occ WHERE NOT forced GROUP BY ALL),
collided AS (
  SELECT *, count(*) OVER (PARTITION BY decision, source_id) > 1 AS id_collision FROM logical),
summary AS (
  SELECT o.unit, o.run, o.decision, o.split, o.n_candidate_occurrences, o.n_forced,
         coalesce(l.n_logical, 0) AS n_logical, coalesce(l.n_applied_logical, 0) AS n_applied_logical,
         coalesce(l.has_collision, false) AS has_collision, coalesce(l.n_collapsed, 0) AS n_collapsed,
         coalesce(l.n_inconsistent, 0) AS n_inconsistent,
         coalesce(l.n_collision_candidates, 0) AS n_collision_candidates,
         o.n_candidate_occurrences - coalesce(l.n_logical, 0) AS n_duplicate_occurrences
  FROM (SELECT unit, run, decision, split, count(*) FILTER (NOT forced) AS n_candidate_occurrences,
               count(*) FILTER (forced) AS n_forced FROM occ GROUP BY ALL) o
  LEFT JOIN (SELECT decision, count(*) AS n_logical,
               count(*) FILTER (observed_applied) AS n_applied_logical,
               bool_or(id_collision) AS has_collision,
               count(*) FILTER (multiplicity > 1) AS n_collapsed,
               count(*) FILTER (NOT labels_consistent) AS n_inconsistent,
               count(*) FILTER (id_collision) AS n_collision_candidates
             FROM collided GROUP BY decision) l USING (decision)),
decided AS (
  SELECT s.*, o_orderstatus <> 'P' AS pre_state_available,
         s.n_logical >= 2 AND NOT s.has_collision AND o_orderstatus <> 'P' AS usable
  FROM summary s JOIN orders ON o_orderkey = s.decision),
flagged AS (
  SELECT * EXCLUDE (usable), decision = min(decision) OVER (PARTITION BY unit, run) AS is_first_in_run,
         coalesce(usable AND decision = min(CASE WHEN usable THEN decision END)
           OVER (PARTITION BY unit, run), false) AS is_eligible
  FROM decided)"""


def scan_rows(spark, sf) -> DataFrame:
    """Raw candidate rows as the corpus scan sees them: one file, no joins."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("decision"),
        split_of(F.col("l_orderkey")).alias("split"),
        "l_extendedprice", "l_linenumber", "l_linestatus", "l_returnflag", "l_discount",
        (F.col("l_suppkey") % 4).alias("source_id"),
        (F.col("l_discount") >= 0.05).alias("applied"),
        (F.col("l_linenumber") == 7).alias("forced"),
    )


def pairs_cells(spark, sf) -> DataFrame:
    """(unit, seed, arm) cells: mean value as time, solved when no value passed 200.

    Values are added in the order of their events, as the SQL adds the file's rows when one
    thread reads them. Without event ids, and in cells too large for a task, they are summed
    exactly, so floors and ties of the cells hang neither on tasks nor on their number."""
    e = table(spark, sf, "events")
    origin = e.agg(F.min(F.to_date("ts"))).scalar()
    week = F.floor(F.date_diff(F.to_date("ts"), origin) / 7).cast("bigint")
    keys = ["unit", "seed", "arm"]
    order = [c for c in ("event_id", "ts", "value") if c in e.columns]
    rows = e.select(
        F.col("user_id").alias("unit"), week.alias("seed"), F.col("event_type").alias("arm"), *order
    )
    exact = E.exact_sum("value")
    measures = {
        "_values": F.count("value"), "complete": F.max("value") <= 200,
        "nodes": F.count(F.lit(1)), "peak": F.max("value"),
    }
    if "event_id" in order:
        cells = sums_in_order(
            rows, keys, order, "value", "work", measures, exact=exact, dealt_by=["unit", "seed"]
        )
    else:
        cells = rows.groupBy(*keys).agg(
            exact.alias("work"), *[c.alias(n) for n, c in measures.items()]
        )
    return cells.select(
        *keys, (F.col("work") / F.col("_values")).alias("time"), "complete", "nodes", "work",
        "peak", F.concat(F.lit("c"), (F.col("unit") % 20).cast("string")).alias("cluster"),
    )


CELLS_SQL = """cells AS (
  SELECT user_id AS unit,
         (date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // 7)::BIGINT AS seed,
         event_type AS arm, avg(value) AS time, max(value) <= 200 AS complete, count(*) AS nodes,
         sum(value) AS work, max(value) AS peak, 'c' || (user_id % 20) AS cluster
  FROM events GROUP BY ALL)"""

PAIRED_SQL = f"""{CELLS_SQL},
paired AS (
  SELECT t.unit, t.seed, t.arm, t.cluster, n.time AS native_time, t.time AS treatment_time,
         n.complete AS native_complete, t.complete AS treatment_complete,
         n.nodes AS native_nodes, t.nodes AS treatment_nodes, n.work AS native_work,
         t.work AS treatment_work, n.peak AS native_peak, t.peak AS treatment_peak,
         CASE WHEN n.complete THEN greatest(n.time, 1e-12::DOUBLE) ELSE 400::DOUBLE END AS native_cost,
         CASE WHEN t.complete THEN greatest(t.time, 1e-12::DOUBLE) ELSE 400::DOUBLE END AS treatment_cost
  FROM cells n JOIN cells t ON n.unit = t.unit AND n.seed = t.seed
  WHERE n.arm = 'view' AND t.arm <> 'view'),
costed AS (
  SELECT *, ln(treatment_cost / native_cost) AS log_ratio FROM paired)"""


def risk(spark, sf) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return lab.join(d, "doc_id").select(
        "doc_id",
        F.col("source").alias("unit"),
        F.col("lang").alias("action"),
        F.col("n_chars").cast("double").alias("score"),
        F.col("toxic").cast("bigint").alias("label"),
        "quality",
    )


RISK_SQL = """risk AS (
  SELECT doc_id, source AS unit, lang AS action, n_chars::DOUBLE AS score,
         toxic::BIGINT AS label, quality
  FROM labels JOIN documents USING (doc_id))"""
