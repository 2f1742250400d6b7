"""Candidate occurrences to decision and candidate tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.operators.ordering import (
    first_by,
    order_key,
    with_group_aggregates,
    with_positions,
)
from plumbline.session import materialize


def root_rows(rows: DataFrame, *, root: str = "root", depth: str = "node_depth"):
    """(rows at depth 0 that are flagged root, one-row count of disagreements)."""
    is_root, top = E.flag(root), E.integer(depth) == 0
    clash = rows.agg(F.count_if(is_root != top).cast("bigint").alias("root_depth_disagreements"))
    return rows.where(is_root & top), clash


def collapse_duplicates(
    occurrences: DataFrame,
    *,
    decision: Sequence[str],
    source_id: str,
    signature: str,
    applied: str,
    sequence: Sequence[str],
    carry: Sequence[str] = (),
    dealt_rows: int | None = None,
) -> DataFrame:
    """One row per (decision, source id, signature).

    The representative is the earliest occurrence, the label is true when any
    occurrence was applied, and an id with two signatures inside a decision is
    a collision. Only partial aggregates of the occurrences are shuffled. The
    collapsed rows are written once, because every later step reads them again
    and would otherwise repeat the scan of the occurrences. They come back dealt by
    ``decision`` for ``dealt_rows`` rows (their own, if not given).
    """
    ids = [*decision, source_id]
    at = order_key(sequence)
    kinds = dict(occurrences.dtypes)
    plain = all(kinds[c] in ("int", "bigint", "double", "float", "boolean") for c in carry)
    if plain:  # fixed-width buffers: hash aggregation
        carried = [F.min_by(c, at).alias(f"_carry_{c}") for c in carry]
        shown = [F.col(f"_carry_{c}").alias(c) for c in carry]
    else:
        carried = [F.min_by(F.struct(*carry), at).alias("_carry")]
        shown = [F.col(f"_carry.{c}").alias(c) for c in carry]
    logical = occurrences.groupBy(*ids, signature).agg(
        F.count(F.lit(1)).alias("multiplicity"),
        F.min(at).alias("_first"),
        F.bool_or(applied).alias("observed_applied"),
        (F.bool_or(applied) == F.bool_and(applied)).alias("labels_consistent"),
        *carried,
    )
    logical = with_group_aggregates(
        materialize(logical, "logical", compression="zstd"), ids, {"_versions": F.count(F.lit(1))},
        dealt_by=decision, dealt_rows=dealt_rows,
    )
    if len(sequence) == 1:
        first = [F.col("_first").alias(f"first_{sequence[0]}")]
    else:
        first = [F.col(f"_first.{c}").alias(f"first_{c}") for c in sequence]
    return logical.select(
        *ids, signature, "multiplicity", *first, "observed_applied", "labels_consistent",
        (F.col("_versions") > 1).alias("id_collision"), *shown,
    )


def decision_summary(
    occurrences: DataFrame, logical: DataFrame, *, decision: Sequence[str], forced: str
) -> DataFrame:
    """Counts per decision over raw occurrences and over collapsed candidates."""
    raw = occurrences.groupBy(*decision).agg(
        F.count_if(~F.col(forced)).alias("n_candidate_occurrences"),
        F.count_if(F.col(forced)).alias("n_forced"),
    )
    kept = logical.groupBy(*decision).agg(
        F.count(F.lit(1)).alias("n_logical"),
        F.count_if("observed_applied").alias("n_applied_logical"),
        F.bool_or("id_collision").alias("has_collision"),
        F.count_if(F.col("multiplicity") > 1).alias("n_collapsed"),
        F.count_if(~F.col("labels_consistent")).alias("n_inconsistent"),
        F.count_if("id_collision").alias("n_collision_candidates"),
    )
    zero = {c: 0 for c in kept.columns if c.startswith("n_")}
    joined = raw.join(kept, list(decision), "left").na.fill(zero).na.fill({"has_collision": False})
    return joined.withColumn(
        "n_duplicate_occurrences", F.col("n_candidate_occurrences") - F.col("n_logical")
    )


def attach_pre_state(
    decisions: DataFrame,
    states: DataFrame,
    *,
    key: Sequence[str],
    fields: Sequence[str],
    sequence: Sequence[str],
) -> DataFrame:
    """Left join the state before each decision; the first of duplicate keys wins."""
    first = first_by(states, key, sequence, fields).withColumn("_seen", F.lit(True))
    joined = decisions.join(first, list(key), "left")
    return joined.withColumn("pre_state_available", F.coalesce("_seen", F.lit(False))).drop("_seen")


def duplicate_state_keys(states: DataFrame, key: Sequence[str]) -> DataFrame:
    counted = states.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.sum(F.col("_n") - 1).cast("bigint").alias("duplicate_state_keys"))


def score_rank(
    candidates: DataFrame, *, decision: Sequence[str], score: str, ties: Sequence[str]
) -> DataFrame:
    """Rank by falling score inside a decision, with the rank as a share of the field."""
    order = [F.col("_score").desc(), *[F.col(t) for t in ties]]
    ranked = with_positions(
        candidates.select("*", E.score(score).alias("_score"), F.lit(1).alias("_one")),
        decision,
        order,
        position="score_rank",
        totals={"_field": "_one"},
    )
    spread = F.greatest(F.col("_field") - 1, F.lit(1))
    return ranked.withColumn("score_rank_fraction", (F.col("score_rank") - 1) / spread).drop(
        "_field", "_score", "_one"
    )


def run_flags(
    decisions: DataFrame,
    *,
    run: Sequence[str],
    sequence: Sequence[str],
    has_state: str = "pre_state_available",
) -> DataFrame:
    """First decision of each run, and the one decision a policy may use.

    Usable means two or more candidates, no id collision and a known state; the
    first usable decision of the run is the eligible one. Both are per-run
    minima over the decision table, which is written once before.
    """
    usable = (F.col("n_logical") >= 2) & ~F.col("has_collision") & F.col(has_state)
    at = order_key(sequence)
    whole = with_group_aggregates(
        materialize(decisions, "decisions", compression="zstd"),
        run,
        {"_first": F.min(at), "_first_usable": F.min(F.when(usable, at))},
        dealt_by=run,
    )
    return (
        whole.withColumn("is_first_in_run", at == F.col("_first"))
        .withColumn("is_eligible", usable & F.coalesce(at == F.col("_first_usable"), F.lit(False)))
        .drop("_first", "_first_usable")
    )


def duplicate_occurrences(
    rows: DataFrame, *, decision: Sequence[str], source_id: str, applied: str,
    sequence: Sequence[str],
) -> DataFrame:
    """Per decision: repeats of an id after its first row, and how many were applied."""
    per_id = rows.groupBy(*decision, source_id).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(applied).alias("_applied"),
        F.min_by(F.col(applied).cast("int"), order_key(sequence)).alias("_first_applied"),
    )
    return per_id.groupBy(*decision).agg(
        F.sum("_n").alias("rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.sum(F.col("_applied") - F.col("_first_applied")).alias("duplicate_applied_rows"),
    )


def contiguity(
    rows: DataFrame, *, source: Sequence[str], key: Sequence[str], sequence: Sequence[str]
) -> DataFrame:
    """Per source: islands of equal key in file order against distinct keys.

    More islands than keys means a key came back after another one, which the
    table builder treats as an error. The predecessor is found by joining dense
    positions, so one long file is not one task.
    """
    numbered = with_positions(rows.select(*source, *key, *sequence), source, sequence)
    # three readers below: the rows, their predecessors and the distinct keys
    numbered = materialize(numbered.select(*source, *key, "position"), "numbered")
    prior = numbered.select(
        *source,
        (F.col("position") + 1).alias("position"),
        *[F.col(c).alias(f"_prior_{c}") for c in key],
    )
    joined = numbered.join(prior, [*source, "position"], "left")
    changed = F.lit(False)
    for c in key:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_prior_{c}"))
    islands = joined.groupBy(*source).agg(F.count_if(changed).alias("islands"))
    keys = numbered.select(*source, *key).distinct().groupBy(*source).agg(
        F.count(F.lit(1)).alias("distinct_keys")
    )
    return islands.join(keys, list(source)).withColumn(
        "contiguous", F.col("islands") == F.col("distinct_keys")
    )


def islands(
    rows: DataFrame, *, source: Sequence[str], block: str, row: str, key: Column
) -> DataFrame:
    """(source, block, start, place, key, rows): runs of equal key, as tasks meet them.

    ``row`` numbers the rows of a file block in order. A range is what a task reads of one
    (source, ``block``) without a gap in ``row``; ``start`` is its first number and ``place``
    counts its runs, so no sort or shuffle is needed. Rows of a null key break a run.
    """
    names = [f"_s{i}" for i in range(len(source))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (source..., block, key) of the open run
        start = place = n = after = 0

        def told(done):
            return pa.RecordBatch.from_pylist(
                [dict(zip([*names, "block", "key"], at)) | {"start": s, "place": p, "rows": k} for at, s, p, k in done],
                schema,
            )

        for batch in batches:
            if not len(batch):
                continue
            number = batch.column(len(names) + 2).to_numpy()
            kept = batch.select([*names, "block", "key"])
            codes = [pc.fill_null(c.dictionary_encode().indices, -1).to_numpy() for c in kept.columns]
            changed = np.ones(len(batch), dtype=bool)
            changed[1:] = number[1:] != number[:-1] + 1
            for c in codes:
                changed[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(changed)
            sizes = np.diff(starts, append=len(batch)).tolist()
            done = []
            for values, first, size in zip(kept.take(pa.array(starts)).to_pylist(), number[starts].tolist(), sizes):
                at = tuple(values.values())
                follows = last is not None and at[:-1] == last[:-1] and first == after
                if follows and at == last:
                    n += size
                else:
                    if last is not None:
                        done.append((last, start, place, n))
                    start, place = (start, place + 1) if follows else (first, 0)
                    last, n = at, size
                after = first + size
            if done:
                yield told(done)
        yield told([] if last is None else [(last, start, place, n)])

    schema = pa.schema(
        [*[(c, pa.string()) for c in names], ("block", pa.int64()), ("key", pa.string()),
         ("start", pa.int64()), ("place", pa.int64()), ("rows", pa.int64())]
    )
    pruned = rows.select(
        *[F.col(c).cast("string").alias(n) for c, n in zip(source, names)],
        F.col(block).cast("bigint").alias("block"), key.cast("string").alias("key"),
        F.col(row).cast("bigint").alias("row"),
    )
    kinds = ", ".join(f"{n} string" for n in names)
    found = pruned.mapInArrow(
        run, f"{kinds}, block bigint, key string, start bigint, place bigint, rows bigint"
    )
    return found.withColumnsRenamed(dict(zip(names, source)))


def key_islands(
    rows: DataFrame, *, source: Sequence[str], key: Column, block: str | None = None,
    row: str | None = None, sequence: Sequence[str] = (),
) -> DataFrame:
    """(source, key, islands) of every key that isn't null: its runs in file order.

    The ranges that tasks read are summaries that merge: two neighbouring ranges share a
    run when one ends with the key that the other begins with. Without ``block`` and
    ``row`` the rows are first dealt to sorted ranges of ``sequence``. Sources come back
    as texts.
    """
    source = list(source)
    if block is None or row is None:
        block, row = "_range", "_at"
        kept = rows.select(*source, *sequence, key.cast("string").alias("_key"))
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        kept = kept.repartitionByRange(parts, *source, *sequence).sortWithinPartitions(*source, *sequence)
        rows = kept.withColumn(block, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id())
        key = F.col("_key")
    found = materialize(
        islands(rows, source=source, block=block, row=row, key=key), "islands", compression="zstd"
    )
    ends = found.groupBy(*source, "block", "start").agg(
        F.min_by("key", "place").alias("_first"), F.max_by("key", "place").alias("_last")
    )
    before = F.lag("_last").over(Window.partitionBy(*source).orderBy("block", "start"))
    joined = ends.withColumn("_before", before).where("_before = _first")
    runs = found.where("key IS NOT NULL").select(*source, "key", F.lit(1).alias("_n"))
    merged = joined.select(*source, F.col("_first").alias("key"), F.lit(-1).alias("_n"))
    return runs.unionByName(merged).groupBy(*source, "key").agg(F.sum("_n").alias("islands"))


def contiguity_of_keys(counted: DataFrame, source: Sequence[str]) -> DataFrame:
    """``key_islands`` rolled up to (source, islands, distinct_keys, contiguous)."""
    return counted.groupBy(*source).agg(
        F.sum("islands").alias("islands"), F.count(F.lit(1)).alias("distinct_keys")
    ).withColumn("contiguous", F.col("islands") == F.col("distinct_keys"))


def build_counters(decisions: DataFrame) -> DataFrame:
    """One row of totals over the decision table."""
    n = F.count(F.lit(1))
    eligible = F.col("is_eligible")
    return decisions.agg(
        n.alias("decisions"),
        F.sum(F.col("n_candidate_occurrences") + F.col("n_forced")).alias("root_rows"),
        F.sum("n_candidate_occurrences").alias("optional_rows"),
        F.sum("n_forced").alias("forced_rows"),
        F.sum("n_logical").alias("logical_candidates"),
        F.sum("n_duplicate_occurrences").alias("duplicate_occurrences"),
        F.count_if(F.col("n_collapsed") > 0).alias("decisions_with_duplicates"),
        F.count_if("has_collision").alias("decisions_with_collision"),
        F.sum("n_collision_candidates").alias("collision_candidates"),
        F.sum("n_applied_logical").alias("applied_labels"),
        F.sum("n_inconsistent").alias("inconsistent_candidates"),
        F.count_if("pre_state_available").alias("decisions_with_state"),
        F.count_if(eligible).alias("eligible_decisions"),
        F.coalesce(F.sum(F.when(eligible, F.col("n_logical"))), F.lit(0)).alias(
            "eligible_candidates"
        ),
        F.count_if(eligible & ~F.col("pre_state_available")).alias("eligible_without_state"),
        F.count_if(eligible & F.col("has_collision")).alias("eligible_with_collision"),
    )


def accounting_checks(
    counters: DataFrame, source_rows: DataFrame, candidate_rows: DataFrame
) -> DataFrame:
    """Check rows: every row of the source is accounted for exactly once."""
    totals = counters.select(
        "*",
        source_rows.agg(F.count(F.lit(1))).scalar().alias("_source"),
        candidate_rows.agg(F.count(F.lit(1))).scalar().alias("_written"),
    )
    checks = {
        "root_rows_match_source": F.col("root_rows") == F.col("_source"),
        "root_equals_optional_plus_forced": F.col("root_rows")
        == F.col("optional_rows") + F.col("forced_rows"),
        "optional_equals_logical_plus_duplicates": F.col("optional_rows")
        == F.col("logical_candidates") + F.col("duplicate_occurrences"),
        "written_equals_logical": F.col("_written") == F.col("logical_candidates"),
        "eligible_not_above_decisions": F.col("eligible_decisions") <= F.col("decisions"),
        "eligible_have_state": F.col("eligible_without_state") == 0,
        "eligible_have_no_collision": F.col("eligible_with_collision") == 0,
        "labels_not_above_candidates": F.col("applied_labels") <= F.col("logical_candidates"),
    }
    from plumbline.operators.gates import check_rows

    return check_rows(totals, checks)


def protocol_totals(
    decisions: DataFrame, *, split: str = "split", stratum: str = "stratum"
) -> DataFrame:
    """Overlapping protocol totals: training rows count in all three protocols,
    evaluation rows in the one of their stratum."""
    train = F.array(F.lit("family_ood"), F.lit("seen_family"), F.lit("officially_ungrouped"))
    own = F.array(
        F.when(F.col(stratum) == "unseen_family", "family_ood").otherwise(F.col(stratum))
    )
    return (
        decisions.withColumn(
            "protocol", F.explode(F.when(F.col(split) == "train", train).otherwise(own))
        )
        .groupBy("protocol", split)
        .agg(
            F.count(F.lit(1)).alias("decisions"),
            F.count_if("is_eligible").alias("eligible_decisions"),
            F.sum("n_logical").alias("logical_candidates"),
        )
    )
