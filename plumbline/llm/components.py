"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import ROWS_PER_TASK
from plumbline.session import materialize


def components(
    links: DataFrame, a: str = "a", b: str = "b", *, task_rows: int = ROWS_PER_TASK
) -> DataFrame:
    """(id, label): the smallest id reachable from each id that is in a link.

    Alternates large-star and small-star rounds: each id hangs its larger, then its
    smaller neighbours on its least one, until nothing moves. Every round is one
    aggregate and one join of the links and is written to the shared folder; the
    number of rounds grows with the logarithm of the longest chain. An id with very
    many links is pre-aggregated, and the join may split it. Links that fit a task
    (``task_rows``) take a round in one task, as a round has eight shuffles else, each
    of as many tasks as the session has shuffle partitions.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    edges = links.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct()
    edges = materialize(edges, "star")
    mark = _mark(edges)
    while True:
        # No round has more links than the one before.
        star = _star_of_few if mark[0] <= task_rows else _star
        edges = materialize(star(edges), "star")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)


def _star(edges: DataFrame) -> DataFrame:
    """A round over the links (u, v), u > v."""
    # Large star: larger neighbours of u go to the least neighbour of u (or u).
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()
    # Small star: of u's smaller neighbours all go to the least one, and u too.
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _star_of_few(edges: DataFrame) -> DataFrame:
    """The round of ``_star`` in one task, where windows need no shuffle."""
    least = F.min("v").over(Window.partitionBy("u"))

    def ends(*pairs):
        return F.explode(F.array(*[F.struct(x.alias("u"), y.alias("v")) for x, y in pairs]))

    u, v, m = F.col("u"), F.col("v"), F.col("m")
    both = edges.coalesce(1).select(ends((u, v), (v, u)).alias("_e")).select("_e.*")
    large = both.withColumn("m", F.least(least, u)).where("v > u").select(v.alias("u"), m.alias("v"))
    large = large.distinct().withColumn("m", least)
    moved = large.select(ends((v, m), (u, m)).alias("_e")).select("_e.*")
    return moved.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the links."""
    code = F.xxhash64("u", "v")
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(code.cast("decimal(38,0)")), F.bit_xor(code)).first()
    )
