"""Cluster bootstrap with deterministic draws.

``replicates`` draws n of n items slot by slot: slot s of replicate r takes item
``mix(seed, r, s) mod n`` in name order, which any SQL engine can repeat. The grid
of draws is generated where it is used, in chunks, and joined to the items by
position, so replicates x items rows are made.

``multinomial_replicates`` draws from the same distribution by counts. Items stand
in blocks; a replicate's n draws are split binomially between halves of the blocks,
halves of halves and so on, each split drawn from (seed, node of the tree). Every
block finds its counts by walking from the root, so no draw is ever a row and only
a row per replicate and block leaves a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import draws
from plumbline.operators.ordering import with_positions
from plumbline.session import materialize

SLOT_CHUNK = 65_536
# Items at or below this count, with keys of at most this many bytes, are broadcast
# (about 25 MB and the keys); more are shuffled.
BROADCAST_ITEMS = 500_000
BROADCAST_KEY_BYTES = 1 << 25
BLOCK_ITEMS = 65_536


def _wanted(items, keys, item, numerator, denominator, state: Column) -> DataFrame:
    return items.select(
        *keys,
        F.col(item).alias("_item"),
        F.expr(numerator).alias("_num") if isinstance(numerator, str) else numerator.alias("_num"),
        (F.lit(1.0) if denominator is None else F.col(denominator)
         if isinstance(denominator, str) else denominator).cast("double").alias("_den"),
        state.alias("_seed"),
    )


def replicates(
    items: DataFrame,
    *,
    keys: Sequence[str],
    item: str,
    numerator: "Column | str",
    denominator: "Column | str | None" = None,
    count: int,
    seed: "Column | int",
) -> DataFrame:
    """(keys..., replicate, estimate): sum of numerators over sum of denominators.

    With no denominator the estimate is the plain mean of the drawn items. With
    per-cluster sums and counts it is the pooled mean of drawn clusters.
    """
    if count <= 0:
        raise ValueError("bootstrap replicates must be positive")
    spark = items.sparkSession
    state = seed if isinstance(seed, Column) else F.lit(seed).cast("bigint")
    wanted = _wanted(items, keys, item, numerator, denominator, state)
    # Item rows are needed by the sizes, the positions and the size check.
    wanted = materialize(wanted, "bootstrap-items")
    placed = with_positions(wanted, list(keys), ["_item"], position="_at").select(
        *keys, (F.col("_at") - 1).alias("_draw"), "_num", "_den"
    )
    text = F.octet_length(F.to_json(F.struct(*keys))) if keys else F.lit(0)
    held, key_bytes = wanted.agg(F.count(F.lit(1)), F.sum(text)).first()
    if held <= BROADCAST_ITEMS and (key_bytes or 0) <= BROADCAST_KEY_BYTES:
        placed = F.broadcast(placed)
    else:
        # The draws look as small as the chunks that they are unfolded from; without the hint
        # all of them would be collected for a broadcast.
        placed = placed.hint("shuffle_hash")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = wanted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_seed").alias("_seed")
    )
    last = F.lit(count - 1).cast("bigint")
    zero, step = F.lit(0).cast("bigint"), F.lit(SLOT_CHUNK).cast("bigint")
    chunks = (
        sizes.withColumn("_base", draws.mix32(F.pmod("_seed", F.lit(draws.WORD))))
        .withColumn("replicate", F.explode(F.sequence(zero, last)))
        .withColumn("_from", F.explode(F.sequence(zero, F.col("_n") - 1, step)))
        .repartition(parts, *keys, "replicate", "_from")
        .withColumn("_state", draws.mix_with(F.col("_base"), F.col("replicate")))
    )
    upto = F.least(F.col("_from") + step, F.col("_n")) - 1
    slots = chunks.select(
        *keys, "replicate", "_n", "_state", F.explode(F.sequence(F.col("_from"), upto)).alias("_s")
    )
    drawn = slots.select(
        *keys,
        "replicate",
        (draws.mix_with(F.col("_state"), F.col("_s")) % F.col("_n")).alias("_draw"),
    )
    return (
        drawn.join(placed, [*keys, "_draw"])
        .groupBy(*keys, "replicate")
        .agg((F.sum("_num") / F.sum("_den")).alias("estimate"))
    )


def _generator(seed: int, low: int, high: int) -> np.random.Generator:
    """The random stream of one node of the tree over blocks [low, high)."""
    counter = np.array([0, 0, low, high], dtype=np.uint64)
    return np.random.Generator(np.random.Philox(key=seed % (1 << 64), counter=counter))


def block_draws(seed: int, count: int, items: int, block: int, size: int) -> np.ndarray:
    """How many of its ``items`` draws each of ``count`` replicates takes from one block.

    Blocks hold ``size`` items, the last one the rest. Splits above the block are
    drawn alike by whoever asks, so the counts of all blocks sum to ``items``.
    """
    drawn = np.full(count, items, dtype=np.int64)
    low, high = 0, -(-items // size)
    while high - low > 1:
        middle = (low + high) // 2
        whole = min(high * size, items) - low * size
        left = _generator(seed, low, high).binomial(drawn, (middle - low) * size / whole)
        if block < middle:
            drawn, high = left, middle
        else:
            drawn, low = drawn - left, middle
    return drawn


def item_counts(seed: int, count: int, items: int, block: int, size: int):
    """For each replicate, how often each item of the block is drawn."""
    width = min((block + 1) * size, items) - block * size
    within = _generator(seed, block, block + 1)
    for drawn in block_draws(seed, count, items, block, size):
        yield np.bincount(within.integers(0, width, drawn), minlength=width)


def multinomial_replicates(
    items: DataFrame,
    *,
    keys: Sequence[str],
    item: str,
    numerator: "Column | str",
    denominator: "Column | str | None" = None,
    count: int,
    seed: "Column | int",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(keys..., replicate, drawn, estimate), as ``replicates`` but by counts.

    ``drawn`` is the number of draws, which is the number of the key's items. A
    missing numerator or denominator adds nothing to its sum; a sum of denominators
    of 0 gives a null estimate. A seed column must be constant within its key. The
    counts depend on seed, item order and ``block_items`` alone, not on partitions.
    """
    if count <= 0:
        raise ValueError("bootstrap replicates must be positive")
    state = seed if isinstance(seed, Column) else F.lit(seed).cast("bigint")
    wanted = _wanted(items, keys, item, numerator, denominator, state)
    placed = with_positions(
        wanted.withColumn("_one", F.lit(1)), list(keys), ["_item"], position="_at",
        totals={"_items": "_one"},
    )
    blocks = placed.select(
        *keys,
        F.floor((F.col("_at") - 1) / block_items).cast("bigint").alias("_block"),
        "_at",
        F.col("_items").cast("bigint").alias("_items"),
        F.coalesce(F.col("_num").cast("double"), F.lit(0.0)).alias("_num"),
        F.coalesce("_den", F.lit(0.0)).alias("_den"),
        F.col("_seed").cast("bigint").alias("_seed"),
    )

    def drawn_sums(part: pa.Table) -> pa.Table:
        part = part.sort_by("_at")
        first = part.slice(0, 1).to_pydict()
        values = np.column_stack([part["_num"].to_numpy(), part["_den"].to_numpy()])
        sums = np.empty((count, 3))
        draw = item_counts(first["_seed"][0], count, first["_items"][0], first["_block"][0], block_items)
        for r, times in enumerate(draw):
            # A value that is not drawn adds nothing, be it infinite or not a number.
            taken = np.flatnonzero(times)
            sums[r, :2] = times[taken] @ values[taken]
            sums[r, 2] = times.sum()
        same = {k: pa.array(first[k] * count, part.schema.field(k).type) for k in keys}
        return pa.table(same | {
            "replicate": pa.array(range(count), pa.int64()), "_n": pa.array(sums[:, 0]),
            "_d": pa.array(sums[:, 1]), "_t": pa.array(sums[:, 2].astype(np.int64)),
        })

    made = [("replicate", T.LongType()), ("_n", T.DoubleType()), ("_d", T.DoubleType()), ("_t", T.LongType())]
    schema = T.StructType(
        [blocks.schema[k] for k in keys] + [T.StructField(n, t, True) for n, t in made]
    )
    sums = blocks.groupBy(*keys, "_block").applyInArrow(drawn_sums, schema)
    return sums.groupBy(*keys, "replicate").agg(
        F.sum("_t").alias("drawn"),
        F.try_divide(F.sum("_n"), F.sum("_d")).alias("estimate"),
    )


def interval(
    drawn: DataFrame, *, keys: Sequence[str], confidence: float = 0.95, geometric: bool = False
) -> DataFrame:
    """Two-sided percentile interval per key; geometric exponentiates first."""
    tail = (1.0 - confidence) / 2.0
    value = F.exp("estimate") if geometric else F.col("estimate")
    return drawn.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("replicates"),
        F.percentile(value, F.lit(tail)).alias("lower"),
        F.percentile(value, F.lit(1.0 - tail)).alias("upper"),
    )


def upper_percentile(drawn: DataFrame, *, keys: Sequence[str], confidence: float) -> DataFrame:
    return drawn.groupBy(*keys).agg(
        F.percentile(F.exp("estimate"), F.lit(confidence)).alias("upper_one_sided")
    )


def delta_interval(drawn: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Interval of a mean difference and the share of replicates above zero."""
    return drawn.groupBy(*keys).agg(
        F.percentile("estimate", F.lit(0.025)).alias("ci95_lower"),
        F.percentile("estimate", F.lit(0.975)).alias("ci95_upper"),
        F.avg((F.col("estimate") > 0).cast("double")).alias("probability_positive"),
    )


def cluster_sums(values: DataFrame, *, keys: Sequence[str], cluster: str, value: str) -> DataFrame:
    """Sufficient statistics of a cluster: drawing clusters needs no unit rows."""
    return values.groupBy(*keys, cluster).agg(
        F.sum(value).alias("value_sum"), F.count(F.lit(1)).cast("double").alias("value_count")
    )


def action_seed(seed: int, arm: "Column | str", suffix: str = "") -> Column:
    name = F.col(arm) if isinstance(arm, str) else arm
    return draws.name_seed(seed, F.concat(name, F.lit(suffix)) if suffix else name)
