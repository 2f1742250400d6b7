"""Row positions and running sums that survive one group holding most rows.

``Window.partitionBy(group)`` sends a whole group to one task. That is right for
ordinary groups and wrong for a group that holds a third of the data. Here a
column-pruned probe finds such groups; they are range-partitioned on
(group, order), numbered inside each range, and shifted by the totals of the
ranges before it. Ordinary groups keep the plain window. Both ways give the
same numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

# Groups above this many rows are split over tasks.
DEFAULT_HOT_ROWS = 2_000_000
PROBE_BUCKETS = 65_536
HOT_ROWS_SETTING = "spark.plumbline.hotGroupRows"

# Rows that a task holds of a frame dealt by keys: more rows make more tasks, not larger ones.
ROWS_PER_TASK = 200_000

Order = Sequence["str | Column"]


def deal(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` of ``rows`` rows dealt by ``keys`` into tasks of a fixed size.

    The session's number of shuffle partitions is fixed, so its tasks grow with the input.
    Joins, groups and windows that follow on these keys keep the dealing. Small frames stay
    as they are.
    """
    if rows <= ROWS_PER_TASK:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_PER_TASK)), *keys)


def hot_row_limit(spark: SparkSession, hot_rows: int | None = None) -> int:
    return hot_rows or int(spark.conf.get(HOT_ROWS_SETTING, str(DEFAULT_HOT_ROWS)))


def hot_groups(
    df: DataFrame, group: Sequence[str], hot_rows: int | None = None,
    *, weight: Column | None = None, limit: int | None = None,
):
    """Keys with more rows than a task should hold, or ``None``.

    ``weight`` is counted instead of rows, up to ``limit``. The limit is fixed: it
    doesn't grow with the data, so no task ever holds more. Rows are first counted
    by hash bucket, so at most ``PROBE_BUCKETS`` partial rows leave each task; only
    the buckets that could hide a large group are counted by key. The keys are a
    table in the shared folder, a row for each ``limit`` rows at most.
    """
    limit = limit or hot_row_limit(df.sparkSession, hot_rows)
    if not group:
        return None
    amount = F.sum(F.lit(1) if weight is None else weight).cast("bigint").alias("_n")
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in group]), F.lit(PROBE_BUCKETS))
    sizes = df.groupBy(bucket.alias("_b")).agg(amount)
    crowded = [r["_b"] for r in sizes.where(F.col("_n") > limit).collect()]
    if not crowded:
        return None
    keys = df.where(bucket.isin(crowded)) if len(crowded) <= 1000 else df
    keys = materialize(keys.groupBy(*group).agg(amount).where(F.col("_n") > limit), "hot")
    return None if keys.isEmpty() else keys


def split_hot(df: DataFrame, group: Sequence[str], keys: DataFrame):
    """(ordinary rows, rows of the hot keys); null keys match null keys."""
    # Not hinted: few keys are broadcast by their size, many are joined by shuffle.
    named = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)])
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group)],
    )
    return df.join(named, same, "left_anti"), df.join(named, same, "left_semi")


def with_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Order,
    *,
    position: str = "position",
    running: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add the 1-based position inside ``group`` and inclusive running sums.

    ``running`` and ``totals`` map an output name to the summed column; totals
    are the sums over the whole group. ``order`` must be total inside the group.
    """
    group = list(group)
    running, totals = dict(running or {}), dict(totals or {})
    if group:
        keys = hot_groups(df, group, hot_rows)
        if keys is None:
            return _windowed(df, group, order, position, running, totals)
        cold, hot = split_hot(df, group, keys)
        hot_total = keys.agg(F.sum("_n")).first()[0]
        return _windowed(cold, group, order, position, running, totals).unionByName(
            _ranged(hot, group, order, position, running, totals, hot_total, hot_rows)
        )
    total = df.count()
    if total <= hot_row_limit(df.sparkSession, hot_rows):
        return _windowed(df, [], order, position, running, totals)
    return _ranged(df, [], order, position, running, totals, total, hot_rows)


def _windowed(df, group, order, position, running, totals):
    base = Window.partitionBy(*group).orderBy(*order)
    upto = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "*",
        F.row_number().over(base).cast("bigint").alias(position),
        *[F.sum(c).over(upto).alias(out) for out, c in running.items()],
        *[F.sum(c).over(Window.partitionBy(*group)).alias(out) for out, c in totals.items()],
    )


def _ranged(df, group, order, position, running, totals, total, hot_rows):
    spark = df.sparkSession
    per_task = hot_row_limit(spark, hot_rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // per_task))
    by = [F.col(c) for c in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    # Written once: range bounds come from a sample, so a recomputed shuffle
    # could cut the rows elsewhere than the totals below were taken.
    staged = materialize(
        df.repartitionByRange(parts, *by).withColumn("_rng_id", F.spark_partition_id()), "ranges"
    )
    local = _windowed(staged, [*group, "_rng_id"], order, position, running, {})
    before = Window.partitionBy(*group).orderBy("_rng_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged.groupBy(*group, "_rng_id").agg(
        F.count(F.lit(1)).alias("_rng_rows"),
        *[F.sum(c).alias(f"_rng_sum_{out}") for out, c in {**running, **totals}.items()],
    )
    whole = Window.partitionBy(*group)
    shifts = sums.select(
        *[F.col(c).alias(f"_rng_g{i}") for i, c in enumerate(group)],
        F.col("_rng_id").alias("_rng_at"),
        F.coalesce(F.sum("_rng_rows").over(before), F.lit(0)).alias("_rng_before"),
        *[
            F.coalesce(F.sum(f"_rng_sum_{out}").over(before), F.lit(0)).alias(f"_rng_before_{out}")
            for out in running
        ],
        *[F.sum(f"_rng_sum_{out}").over(whole).alias(out) for out in totals],
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_rng_g{i}")) for i, c in enumerate(group)],
        F.col("_rng_id") == F.col("_rng_at"),
    )
    kept = [c for c in df.columns]
    return local.join(shifts, same).select(
        *kept,
        (F.col(position) + F.col("_rng_before")).alias(position),
        *[(F.col(out) + F.col(f"_rng_before_{out}")).alias(out) for out in running],
        *totals,
    )


def with_group_aggregates(
    df: DataFrame, group: Sequence[str], aggregates: Mapping[str, Column],
    *, hot_rows: int | None = None, dealt_by: Sequence[str] | None = None,
    dealt_rows: int | None = None,
) -> DataFrame:
    """Add whole-group aggregates to every row, in one shuffle of the rows.

    ``dealt_by`` names columns of ``group`` by which the rows are dealt; later steps on
    these columns need no shuffle of their own. ``df`` is counted for it, unless
    ``dealt_rows`` says how many rows to deal for.
    Ordinary groups use a window. Groups too large for a task are aggregated
    with partial sums and come back through a join with one row per such group.
    A plain aggregate-and-join would run the input twice.
    """
    group = list(group)
    over = Window.partitionBy(*group)

    def windowed(part: DataFrame) -> DataFrame:
        return part.select("*", *[c.over(over).alias(n) for n, c in aggregates.items()])

    keys = hot_groups(df, group, hot_rows)
    rows = (dealt_rows or df.count()) if dealt_by else 0
    if keys is None:
        return windowed(deal(df, dealt_by, rows) if dealt_by else df)
    cold, hot = split_hot(df, group, keys)
    cold = deal(cold, dealt_by, rows) if dealt_by else cold
    named = [F.col(c).alias(f"_agg_g{i}") for i, c in enumerate(group)]
    totals = hot.groupBy(*named).agg(*[c.alias(n) for n, c in aggregates.items()])
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_agg_g{i}")) for i, c in enumerate(group)],
    )
    joined = hot.join(totals, same).select(*df.columns, *aggregates)
    return windowed(cold).unionByName(joined)


def sums_in_order(
    df: DataFrame, group: Sequence[str], order: Order, value: str, name: str,
    aggregates: Mapping[str, Column], *, exact: Column, dealt_by: Sequence[str],
    hot_rows: int | None = None,
) -> DataFrame:
    """(group, ``name``, ``aggregates``): ``value`` added up row by row in ``order``.

    Doubles round with every addition, so a sum is only told by its order; a plain sum takes
    the order in which partial sums come. ``order`` must be total inside the group and
    ``dealt_by`` are columns of ``group``. Groups too large for a task take the aggregate
    ``exact``, which must hang on no order.
    """
    group = list(group)

    def added(part: DataFrame) -> DataFrame:
        dealt = deal(part, dealt_by, part.count())
        upto = _windowed(dealt, group, order, "_at", {"_upto": value}, {})
        return upto.groupBy(*group).agg(
            F.max_by("_upto", "_at").alias(name), *[c.alias(n) for n, c in aggregates.items()]
        )

    keys = hot_groups(df, group, hot_rows)
    if keys is None:
        return added(df)
    cold, hot = split_hot(df, group, keys)
    whole = hot.groupBy(*group).agg(
        exact.alias(name), *[c.alias(n) for n, c in aggregates.items()]
    )
    return added(cold).unionByName(whole)


def order_key(columns: Sequence[str]) -> Column:
    """One column as it is, several as a struct: a plain column keeps the
    aggregate on the hash path, a struct needs the sort path."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    *,
    nearest_rank: Mapping[str, float] | None = None,
) -> DataFrame:
    """Exact percentiles per key, linear (``fractions``) or nearest-rank.

    The built-in exact percentile gathers a key's values in one buffer. Here
    equal values are counted first and the ranks come from running counts, so a
    key with most of the rows is spread over tasks. Nulls are ignored.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = with_positions(
        counted, list(keys), ["_v"], position="_p", running={"_upto": "_n"}, totals={"_all": "_n"}
    )

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= rank, F.col("_v")))

    aggs, outs = [F.max("_all").alias("_all")], []
    for name, q in fractions.items():
        low = F.floor(F.lit(q) * (F.col("_all") - 1))
        high = F.ceil(F.lit(q) * (F.col("_all") - 1))
        aggs += [at(low + 1).alias(f"_lo_{name}"), at(high + 1).alias(f"_hi_{name}")]
        place = F.lit(q) * (F.col("_all") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    for name, q in (nearest_rank or {}).items():
        rank = F.greatest(F.ceil(F.lit(q) * F.col("_all")), F.lit(1))
        aggs.append(at(rank).alias(name))
        outs.append(F.col(name))
    return placed.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def first_by(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str]):
    """First row of each group as one aggregate: partial minima leave each task,
    never the group."""
    keyed = F.min_by(F.struct(*columns), order_key(order)).alias("_first")
    return df.groupBy(*group).agg(keyed).select(*group, "_first.*")
