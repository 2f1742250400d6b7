"""The audit roll-up, members of repeated clusters, the design of a study, fold totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries_pairs import ARM_STATS_SQL, CRIT, UNITS_OF_ARMS_SQL, costed
from checks.queries_ranking import rounded
from checks.queries_select import FOLD_SQL, POOL_SQL, cluster_folds, pool
from checks.views import table
from plumbline.operators import paired_stats as S
from plumbline.operators import precision as N
from plumbline.operators import rollup as R
from plumbline.operators import sampling as W
from plumbline.plans import cohorts as C

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Orders are records of their customers; a year is an artifact.
ROLLUP_SQL = f"""{POOL_SQL},
r AS (SELECT o_custkey AS unit, 'y' || year(o_orderdate) AS artifact, o_orderpriority AS queue,
    o_orderstatus AS status FROM orders),
k AS (SELECT r.*, CASE WHEN coalesce(grp, '') = '' THEN 'officially-ungrouped:' || r.unit ELSE grp END AS grp, split = 'train' AS active
  FROM r JOIN units USING (unit)),
g AS (SELECT grouping(artifact) AS ga, grouping(queue) AS gq, grouping(status) AS gs, artifact, queue, status, grp,
    count(*) AS n, count(DISTINCT unit) AS u, count(DISTINCT unit) FILTER (active) AS a
  FROM k GROUP BY GROUPING SETS ((artifact, queue, status, grp), (artifact, queue, grp), (artifact, status, grp),
    (queue, status, grp), (artifact, grp), (queue, grp), (status, grp), (grp))),
rollup AS (
  SELECT concat_ws(',', CASE WHEN ga = 0 THEN 'artifact' END, CASE WHEN gq = 0 THEN 'queue' END,
      CASE WHEN gs = 0 THEN 'status' END) AS level, artifact, queue, status, sum(n)::BIGINT AS rows,
    0::BIGINT AS unknown_rows, sum(u)::BIGINT AS units, sum(a)::BIGINT AS active_units, count(*) AS groups,
    count(*) FILTER (u > 1) AS repeated_groups,
    (SELECT count(*) FROM units WHERE split = 'train') - sum(a)::BIGINT AS unevaluated_units
  FROM g GROUP BY ga, gq, gs, artifact, queue, status)"""


def records(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("unit"),
        F.concat(F.lit("y"), F.year("o_orderdate").cast("string")).alias("artifact"),
        F.col("o_orderpriority").alias("queue"), F.col("o_orderstatus").alias("status"),
    )


def known(spark, sf):
    return pool(spark, sf).select("unit", F.col("grp").alias("group"), (F.col("split") == "train").alias("active"))


@query("audit_rollup", f"WITH {ROLLUP_SQL} SELECT * FROM rollup")
def audit_rollup(spark, sf):
    return R.cohort_rollup(records(spark, sf), known(spark, sf))


@query(
    "audit_report",
    f"""WITH {ROLLUP_SQL},
{ARM_STATS_SQL},
p AS (SELECT split, cluster, count(*) AS u FROM pool GROUP BY ALL),
t AS (SELECT DISTINCT cluster FROM pool WHERE split = 'train'),
support AS (SELECT split, sum(u)::BIGINT AS units, count(*) AS clusters, count(*) FILTER (u > 1) AS repeated_clusters,
  count(*) FILTER (cluster IN (FROM t)) AS seen_in_training, count(*) FILTER (cluster NOT IN (FROM t)) AS unseen_in_training,
  bool_and(cluster NOT IN (FROM t)) AS strictly_out_of_family FROM p GROUP BY split)
SELECT 'rollup' AS artifact, level || '|' || coalesce(artifact, '') || '|' || coalesce(queue, '') || '|' || coalesce(status, '') AS key,
  unnest(['rows', 'unknown_rows', 'units', 'active_units', 'groups', 'repeated_groups', 'unevaluated_units']) AS measure,
  unnest([rows, unknown_rows, units, active_units, groups, repeated_groups, unevaluated_units])::VARCHAR AS value FROM rollup
UNION ALL SELECT 'support', split, unnest(['units', 'clusters', 'repeated_clusters', 'seen_in_training', 'unseen_in_training',
    'strictly_out_of_family']),
  unnest([units::VARCHAR, clusters::VARCHAR, repeated_clusters::VARCHAR, seen_in_training::VARCHAR,
    unseen_in_training::VARCHAR, strictly_out_of_family::VARCHAR]) FROM support
UNION ALL SELECT 'arms', arm, unnest(['units', 'pairs', 'wins', 'ties', 'safety_failure_units', 'ratio_in_millionths']),
  unnest([units, pairs, wins, ties, safety_failure_units, round(ratio * 1000000)::BIGINT])::VARCHAR FROM stats""",
)
def audit_report(spark, sf):
    """The job over all tables: roll-up, support and the arms' statistics as one report."""
    arms = S.arm_statistics(S.unit_records(costed(spark, sf))).select(
        "arm", "units", "pairs", "wins", "ties", "safety_failure_units",
        F.round(F.col("ratio") * 1_000_000).cast("bigint").alias("ratio_in_millionths"),
    )
    done = C.audit_rollup(records(spark, sf), known(spark, sf), pool(spark, sf), {"arms": (arms, ["arm"])})
    return done.report


@query(
    "repeated_cluster_members",
    f"""WITH {POOL_SQL},
m AS (SELECT split, cluster, unit, row_number() OVER (PARTITION BY split, cluster ORDER BY unit) AS member,
    count(*) OVER (PARTITION BY split, cluster) AS n FROM pool)
SELECT split, cluster, member, unit, cluster IN (SELECT cluster FROM pool WHERE split = 'train') AS seen_in_training
FROM m WHERE n > 1""",
)
def repeated_cluster_members(spark, sf):
    return N.repeated_members(pool(spark, sf))


@query(
    "future_design",
    f"""WITH {UNITS_OF_ARMS_SQL},
s AS (SELECT max(sd) AS sigma FROM (SELECT arm, stddev_samp(mean_log_ratio) AS sd FROM unit_log GROUP BY arm)),
a AS (SELECT count(DISTINCT unit % 20) AS clusters, count(DISTINCT unit % 20) FILTER (unit % 20 NOT IN
    (SELECT user_id % 20 FROM events WHERE user_id % 50 = 0)) AS unseen
  FROM (SELECT DISTINCT user_id AS unit FROM events WHERE user_id % 50 <> 0)),
b AS (SELECT ceil(pow({CRIT}::DOUBLE * sigma / (0 - ln(1 - 0.1::DOUBLE)), 2))::BIGINT AS superiority,
    ceil(pow({CRIT}::DOUBLE * sigma / ln(1.05::DOUBLE), 2))::BIGINT AS noninferiority,
    ceil(ln(0.05::DOUBLE) / ln(0.95::DOUBLE))::BIGINT AS safety, clusters, unseen FROM s, a),
d AS (SELECT 'superiority_and_safety' AS quantity, greatest(superiority, safety) AS need, clusters, unseen FROM b
  UNION ALL SELECT 'dual_purpose', greatest(superiority, noninferiority, safety), clusters, unseen FROM b)
SELECT 'basis' AS quantity, unnest(['superiority', 'noninferiority', 'safety']) AS scenario,
  unnest([superiority, noninferiority, safety]) AS value FROM b
UNION ALL SELECT quantity, unnest(['units', 'beyond_available', 'beyond_unseen', 'runs_of_2_arms', 'runs_of_3_arms']),
  unnest([need, greatest(need - clusters, 0), greatest(need - unseen, 0), need * 6, need * 9]) FROM d""",
)
def future_design(spark, sf):
    spread = N.log_ratio_spread(S.unit_records(costed(spark, sf)))
    users = table(spark, sf, "events").select(F.col("user_id").alias("unit")).distinct()
    split = F.when(F.col("unit") % 50 == 0, "train").otherwise("test")
    support = N.cluster_support(users.select("unit", (F.col("unit") % 20).alias("cluster"), split.alias("split")))
    return N.future_design(spread, support.where("split = 'test'"))


@query(
    "fold_summary",
    f"""SELECT fold, count(*) AS clusters, sum(units)::BIGINT AS units, sum(rows)::BIGINT AS rows,
  round(sum(rows) / sum(sum(rows)) OVER (), 9) AS share FROM ({FOLD_SQL}) GROUP BY fold""",
)
def fold_summary(spark, sf):
    return rounded(W.fold_summary(cluster_folds(spark, sf)))
