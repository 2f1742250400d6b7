"""Cohorts, assignments and folds that depend only on keys and hashes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.draws import hash_key
from plumbline.operators.ordering import with_positions
from plumbline.session import materialize


def _texts(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("string") for c in columns]


def one_per_cluster(
    candidates: DataFrame, count: int, *, cluster: str, unit: str, key: str | None = None,
    order: Sequence[str] = (), excluded: DataFrame | None = None,
) -> DataFrame:
    """First unit of each cluster, then the first ``count`` clusters.

    The order is a keyed hash, or the given columns. A cluster is reduced to its
    minimum on the map side; the cut is a top-n. Raises when clusters run short.
    """
    pool = candidates if excluded is None else candidates.join(excluded, cluster, "left_anti")
    if key is not None:
        pool = pool.withColumn("_h", hash_key(F.lit(key), *_texts([cluster, unit])))
        order = ["_h", unit]
    order = [*order, *([] if unit in order else [unit])]
    firsts = pool.groupBy(cluster).agg(F.min(F.struct(*order)).alias("_f"))
    # at most `count` rows, written once: the check and the caller both read them
    chosen = materialize(firsts.select(cluster, "_f.*").orderBy(*order).limit(count), "sample")
    found = chosen.count()
    if found < count:
        raise ValueError(f"only {found} distinct clusters available; {count} required")
    return chosen.select(cluster, unit, *[c for c in order if c not in (unit, "_h")])


def equal_rank_bins(rows: DataFrame, order: Sequence[str], bins: int, *, out: str = "bin"):
    """Bin i covers the ranks from i*n//bins up to (i+1)*n//bins (not ntile)."""
    placed = with_positions(
        rows.withColumn("_one", F.lit(1)), [], list(order), position="_p", totals={"_n": "_one"}
    )
    index = F.floor((F.col("_p") * bins - 1) / F.col("_n")).cast("bigint")
    return placed.withColumn(out, index).drop("_p", "_n", "_one")


def stratified_cohort(
    candidates: DataFrame, *, cluster: str, unit: str, order: Sequence[str], leading: int = 30,
    bins: int = 10,
) -> DataFrame:
    """The first ``leading`` clusters, then one unused cluster from each rank bin.

    A bin can lose at most bins-1 clusters to earlier bins, so its first ``bins``
    clusters decide; that is at most bins*bins rows to settle one after another.
    """
    head = one_per_cluster(candidates, leading, cluster=cluster, unit=unit, order=order)
    used = head.select(cluster)
    rest = candidates.join(F.broadcast(used), cluster, "left_anti")  # `leading` rows
    binned = equal_rank_bins(rest, order, bins)
    order = [*order, *([] if unit in order else [unit])]
    firsts = binned.groupBy("bin", cluster).agg(F.min(F.struct(*order)).alias("_f"))
    near = with_positions(firsts, ["bin"], ["_f"], position="_r").where(F.col("_r") <= bins)
    taken: set = set()
    picks = []
    for row in near.orderBy("bin", "_r").collect():
        if row["bin"] in {p[0] for p in picks} or row[cluster] in taken:
            continue
        taken.add(row[cluster])
        picks.append((row["bin"], row[cluster], row["_f"][unit]))
    if len(picks) < bins:
        raise ValueError(f"only {len(picks)} of {bins} rank bins have an unused cluster")
    kinds = {f.name: f.dataType for f in candidates.schema.fields}
    schema = T.StructType(
        [
            T.StructField("bin", T.LongType()),
            T.StructField(cluster, kinds[cluster]),
            T.StructField(unit, kinds[unit]),
        ]
    )
    tail = candidates.sparkSession.createDataFrame(picks, schema)
    lead = head.select(
        F.lit(None).cast("bigint").alias("bin"), cluster, unit, F.lit("leading").alias("stratum")
    )
    return lead.unionByName(tail.withColumn("stratum", F.lit("rank_bins")))


def blocks(units: DataFrame, seeds: Sequence[int], *, unit: str = "unit") -> DataFrame:
    """Every unit with every planned seed; the seeds are a literal list."""
    return units.select(
        unit, F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])).alias("seed")
    )


# ---- balanced orders -------------------------------------------------------------
def all_orders(arms: Sequence[str]) -> list[list[str]]:
    return [list(p) for p in permutations(arms)]


def carryover_orders(arms: Sequence[str]) -> list[list[str]]:
    """Four rows in which each arm follows every other exactly once."""
    if len(arms) != 4:
        raise ValueError("the carry-over design has exactly four arms")
    base = (0, 1, 3, 2)  # fixed first row; the others are rotations
    return [[arms[(i + shift) % 4] for i in base] for shift in range(4)]


def alternating_orders(arms: Sequence[str]) -> list[list[str]]:
    return [list(arms), list(arms)[::-1]]


def balanced_schedule(
    block_rows: DataFrame, orders: Sequence[Sequence[str]], key: str, *,
    columns: Sequence[str] = ("unit", "seed"), divisible: bool = False,
) -> DataFrame:
    """Deal the orders in turn to blocks sorted by a keyed hash."""
    if divisible and block_rows.count() % len(orders):
        raise ValueError("blocks must be divisible by the number of arm orders")
    hashed = block_rows.withColumn("_h", hash_key(F.lit(key), *_texts(columns)))
    placed = with_positions(hashed, [], ["_h", *columns], position="_p")
    table = F.array(*[F.array(*[F.lit(a) for a in o]) for o in orders])
    row = F.pmod(F.col("_p") - 1, F.lit(len(orders)))
    return placed.select(
        *columns,
        row.cast("bigint").alias("design_row"),
        F.element_at(table, (row + 1).cast("int")).alias("arm_order"),
    )


def position_counts(schedule: DataFrame) -> DataFrame:
    return (
        schedule.select(F.posexplode("arm_order").alias("position", "arm"))
        .groupBy("arm", "position")
        .agg(F.count(F.lit(1)).alias("blocks"))
    )


def hashed_arm_order(block_rows: DataFrame, arms: Sequence[str], key: str, *,
                     columns: Sequence[str] = ("unit", "seed")) -> DataFrame:
    """Arms of each block sorted by their own hash; no shuffle."""
    keyed = F.array(
        *[
            F.struct(hash_key(F.lit(key), *_texts(columns), F.lit(a)).alias("h"),
                     F.lit(a).alias("arm"))
            for a in arms
        ]
    )
    return block_rows.withColumn("arm_order", F.transform(F.array_sort(keyed), lambda x: x["arm"]))


# ---- cohorts -------------------------------------------------------------------
def eligible_pool(
    candidates: DataFrame, development: DataFrame, *, unit: str = "unit", cluster: str = "cluster",
    status: str = "status", tags: str = "tags",
) -> DataFrame:
    """Easy, not tagged infeasible, and neither unit nor cluster in development."""
    fit = candidates.where(
        (F.col(status) == "easy") & ~F.array_contains(F.split(F.col(tags), r"\s+"), "infeasible")
    )
    return disjoint_from(fit, development, unit=unit, cluster=cluster)


def disjoint_from(rows: DataFrame, development: DataFrame, *, unit: str, cluster: str):
    seen_units = development.select(unit).distinct()
    seen_clusters = development.select(cluster).distinct()
    return rows.join(seen_units, unit, "left_anti").join(seen_clusters, cluster, "left_anti")


def assemble_pool(assignments: DataFrame, summaries: DataFrame, quality: DataFrame, *,
                  unit: str = "unit") -> DataFrame:
    """Training units that ran cleanly and have candidates, by (elapsed, unit)."""
    return (
        assignments.join(summaries.where("ok").select(unit, "elapsed"), unit)
        .join(quality.where("n_candidates > 0").select(unit, "n_candidates"), unit)
        .orderBy("elapsed", unit)
    )


def cohort_overlap(active: DataFrame, queues: DataFrame, *, unit: str = "unit",
                   queue: str = "queue") -> DataFrame:
    """Per active unit: the earlier queues it was in, joined by ``;``.

    Queue names are a small fixed set, so the list per unit stays short.
    """
    prior = queues.select(unit, queue).distinct().groupBy(unit).agg(
        F.array_join(F.array_sort(F.collect_set(queue)), ";").alias("prior_queues")
    )
    joined = active.join(prior, unit, "left")
    return joined.withColumn(
        "previously_evaluated", F.col("prior_queues").isNotNull()
    ).na.fill({"prior_queues": ""})


def overlap_by_queue(active: DataFrame, queues: DataFrame, *, unit: str = "unit",
                     queue: str = "queue") -> DataFrame:
    hit = queues.select(unit, queue).distinct().join(active.select(unit), unit, "left_semi")
    return hit.groupBy(queue).agg(F.count(F.lit(1)).alias("units"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, with the side; empty when the sets are equal."""
    a = left.distinct().exceptAll(right.distinct()).withColumn("only_in", F.lit("left"))
    b = right.distinct().exceptAll(left.distinct()).withColumn("only_in", F.lit("right"))
    return a.unionByName(b)


# ---- folds ---------------------------------------------------------------------
def _split_run(loads: list[list[int]], size: tuple[int, int], m: int) -> list[int]:
    """How many of m equal clusters each fold takes under least-loaded-first.

    Fold j would take its t-th cluster at load ``units_j + t*u``. All folds fill
    to a common level first (found by bisection); the few left over are dealt
    one by one.
    """
    u, r = size
    lo, hi = 0, max(x[0] for x in loads) + (m + 1) * u

    def taken(level: int) -> list[int]:
        return [max(0, -(-(level - x[0]) // u)) for x in loads]

    while lo < hi:
        mid = (lo + hi + 1) // 2
        if sum(taken(mid)) <= m:
            lo = mid
        else:
            hi = mid - 1
    counts = taken(lo)
    state = [[x[0] + c * u, x[1] + c * r] for x, c in zip(loads, counts)]
    for _ in range(m - sum(counts)):
        j = min(range(len(state)), key=lambda i: (state[i][0], state[i][1], i))
        counts[j] += 1
        state[j] = [state[j][0] + u, state[j][1] + r]
    return counts


MOST_SHAPES = 1_000_000


def cluster_folds(
    queries: DataFrame, folds: int, *, cluster: str = "cluster", unit: str = "unit",
    size: str = "n_candidates",
) -> DataFrame:
    """Cluster-disjoint folds: largest cluster first to the least loaded fold.

    Clusters are ordered by falling units, falling rows, then name. The greedy
    rule is sequential, but clusters of one (units, rows) shape are
    interchangeable: only the shapes pass through the driver, as an ordered
    stream of at most MOST_SHAPES, and Spark maps the clusters of each shape to the
    dealt folds.
    """
    if folds < 2:
        raise ValueError("at least two folds are required")
    spark = queries.sparkSession
    per_unit = queries.groupBy(cluster, unit).agg(F.sum(size).alias("_rows"))
    table = per_unit.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("units"), F.sum("_rows").cast("bigint").alias("rows")
    )
    table = materialize(table, "clusters")  # read for the shapes and for the names
    shapes = table.groupBy("units", "rows").agg(F.count(F.lit(1)).alias("m"))
    if shapes.limit(MOST_SHAPES + 1).count() > MOST_SHAPES:
        raise ValueError(f"more than {MOST_SHAPES} cluster shapes; round the sizes first")
    loads = [[0, 0] for _ in range(folds)]
    dealt, total = [], 0
    for s in shapes.orderBy(F.desc("units"), F.desc("rows")).toLocalIterator():
        counts = _split_run(loads, (s["units"], s["rows"]), s["m"])
        total += s["m"]
        for j, c in enumerate(counts):
            if c:
                dealt.append((s["units"], s["rows"], j, c, loads[j][0], loads[j][1]))
                loads[j] = [loads[j][0] + c * s["units"], loads[j][1] + c * s["rows"]]
    if total < folds:
        raise ValueError("fewer clusters than requested folds")
    plan = spark.createDataFrame(
        dealt, "units bigint, rows bigint, fold int, c bigint, u0 bigint, r0 bigint"
    )
    zero = F.lit(0).cast("bigint")
    slots = plan.withColumn("t", F.explode(F.sequence(zero, F.col("c") - 1))).select(
        "units", "rows", "fold",
        (F.col("u0") + F.col("t") * F.col("units")).alias("_u"),
        (F.col("r0") + F.col("t") * F.col("rows")).alias("_r"),
    )
    shape = ["units", "rows"]
    turns = with_positions(slots, shape, ["_u", "_r", "fold"], position="_p").select(
        *shape, "_p", "fold"
    )
    named = with_positions(table, shape, [cluster], position="_p")
    return named.join(turns, [*shape, "_p"]).select(cluster, "units", "rows", "fold")


def fold_summary(folds: DataFrame) -> DataFrame:
    """Per fold: clusters, units and rows, and its share of all rows."""
    per = folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("units").alias("units"), F.sum("rows").alias("rows")
    )
    return per.withColumn("share", F.col("rows") / folds.agg(F.sum("rows")).scalar())


def assign_folds(queries: DataFrame, folds: DataFrame, *, cluster: str = "cluster"):
    """Fold of every query; clusters left out of the folds get -1."""
    return queries.join(folds.select(cluster, "fold"), cluster, "left").na.fill({"fold": -1})


def leave_one_out_folds(rows: DataFrame, *, unit: str = "unit", out: str = "fold") -> DataFrame:
    """Rows with a fold for each unit, so that every unit is the test set once.

    Folds are numbered from 1 in unit order; a missing unit has no fold.
    """
    units = rows.select(F.col(unit).alias("_u")).where("_u IS NOT NULL").distinct()
    placed = with_positions(units, [], ["_u"], position=out)
    return rows.join(placed, rows[unit] == placed["_u"], "left").drop("_u")


def first_units(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order: the prefix of an assignment list."""
    return rows.orderBy(*order).limit(n)
