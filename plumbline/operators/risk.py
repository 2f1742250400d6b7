"""Risk features of an action, and threshold-free and threshold metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.operators.heuristics import swap_pairs
from plumbline.operators.ordering import with_positions

# ---- fixed values: feature layout of a risk row ----------------------------
STATE_FIELDS = (
    "lp_rows",
    "lp_cols",
    "lp_iterations_total",
    "lp_iterations_node",
    "lp_count",
    "separation_rounds_node",
    "gap",
    "processed_nodes",
    "total_nodes",
    "cuts_applied",
    "candidate_cuts",
    "forced_cuts",
    "native_selected_cuts",
)
PAIR_FIELDS = (
    "efficacy",
    "obj_parallelism",
    "cutoff_distance",
    "nnz",
    "n_int_cols",
    "coeff_norm_l2",
    "coeff_max_abs",
    "coeff_std_abs",
)
PAIR_FLAGS = ("is_integral", "is_local", "in_global_cutpool")
GROUP_FIELDS = ("efficacy", "obj_parallelism", "nnz")
ACTIONS = {"boundary-swap": "swap_0", "boundary-swap-2": "swap_1", "efficacy-promote": "promote"}


def _nan(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(E.NAN))


def _clean(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(E.is_finite(n), n)


def candidate_rows(contexts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested contexts to one row per candidate with its position (from 1)."""
    return contexts.select(
        *keys, F.col("solver_state").alias("state"), F.posexplode("candidates").alias("_i", "c")
    ).select(*keys, "state", (F.col("_i") + 1).cast("bigint").alias("position"), "c.*")


def action_features(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per context and applicable action with its 67 features.

    Only what is known before the action is read. ``rows`` has a ``state``
    struct, ``position`` and the candidate columns. Group aggregates are partial
    on the map side; a context with very many candidates is not gathered.
    """
    k = F.col("budget_")
    rows = rows.withColumn("budget_", F.col("state.native_selected_cuts").cast("bigint"))
    sides = {"selected": F.col("position") <= k, "unselected": F.col("position") > k}
    extra = [F.first("state").alias("state")]
    for side, member in sides.items():
        for f in GROUP_FIELDS:
            v = F.when(member, _clean(F.col(f)))
            extra += [F.avg(v).alias(f"{side}_{f}_mean"), F.max(v).alias(f"{side}_{f}_max")]
        extra.append(F.min(F.when(member, _clean(F.col("efficacy")))).alias(f"{side}_efficacy_min"))
        for f, out in (("is_integral", "integral"), ("in_global_cutpool", "global_pool")):
            flag = F.when(member & F.col(f).isNotNull(), F.col(f).cast("double"))
            extra.append(F.avg(flag).alias(f"{side}_{out}_fraction"))
    per = swap_pairs(
        rows, decision=keys, position="position", budget="budget_", metric="efficacy",
        carry=[*PAIR_FIELDS, *PAIR_FLAGS], extra=extra,
    )
    n = F.col("n_candidates")
    s = F.col("state")
    common = [_nan(_clean(s[f])).alias(f"state_{f}") for f in STATE_FIELDS]
    common += [
        E.safe_ratio(F.col("budget"), n).alias("state_selected_fraction"),
        E.safe_ratio(n, s["lp_rows"]).alias("state_candidates_per_lp_row"),
        E.safe_ratio(s["lp_rows"], s["lp_cols"]).alias("state_lp_rows_per_col"),
        E.safe_ratio(s["lp_iterations_total"], s["lp_rows"]).alias("state_lp_iterations_per_row"),
    ]
    groups = [c for c in per.columns if c.startswith(("selected_", "unselected_"))]
    common += [_nan(F.col(c)).alias(c) for c in groups]
    shaped = per.select(
        *keys,
        *common,
        n.alias("_n"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(a).alias("action"), F.col(p).alias("pair"))
                    for a, p in ACTIONS.items()
                ]
            )
        ).alias("x"),
    ).where(F.col("x.pair").isNotNull())
    out, into = F.col("x.pair.removed"), F.col("x.pair.added")
    pair = []
    for f in PAIR_FIELDS:
        a, b = _clean(out[f]), _clean(into[f])
        pair += [
            _nan(a).alias(f"removed_{f}"),
            _nan(b).alias(f"added_{f}"),
            _nan(b - a).alias(f"delta_{f}"),
        ]

    def truth(c: Column) -> Column:
        return F.coalesce(c.cast("boolean"), F.lit(False)).cast("double")

    pair += [(truth(into[f]) - truth(out[f])).alias(f"delta_{f}") for f in PAIR_FLAGS]
    pair += [
        E.safe_ratio(out["at"] - 1, F.col("_n")).alias("removed_rank_fraction"),
        E.safe_ratio(into["at"] - 1, F.col("_n")).alias("added_rank_fraction"),
    ]
    pair += [
        (F.col("x.action") == a).cast("double").alias(f"action_{a.replace('-', '_')}")
        for a in ACTIONS
    ]
    named = [c for c in shaped.columns if c not in (*keys, "_n", "x")]
    return shaped.select(*keys, F.col("x.action").alias("action"), *named, *pair)


# ---- metrics -----------------------------------------------------------------
def score_blocks(rows: DataFrame, *, score: str, label: str, keys: Sequence[str] = ()):
    """Distinct scores from high to low with running and total counts.

    Equal scores form one block, so the running sums pass over distinct scores.
    """
    blocks = rows.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    return with_positions(
        blocks, list(keys), [F.col(score).desc()], position="block",
        running={"pos_upto": "pos", "n_upto": "n"}, totals={"pos_all": "pos", "n_all": "n"},
    )


def ranking_quality(blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Prevalence, tie-aware average precision and ROC AUC."""
    neg = F.col("n") - F.col("pos")
    neg_all = F.col("n_all") - F.col("pos_all")
    below = neg_all - (F.col("n_upto") - F.col("pos_upto"))
    ap = F.sum(F.col("pos_upto") / F.col("n_upto") * F.col("pos"))
    wins = F.sum(F.col("pos") * (below + F.lit(0.5) * neg))
    p, q = F.max("pos_all"), F.max(neg_all)
    return blocks.groupBy(*keys).agg(
        F.max("n_all").alias("rows"),
        p.alias("positives"),
        (p / F.max("n_all")).alias("prevalence"),
        (ap / F.nullif(p, F.lit(0))).alias("average_precision"),
        (wins / F.nullif(p * q, F.lit(0))).alias("roc_auc"),
    )


def threshold_table(
    blocks: DataFrame, *, score: str, keys: Sequence[str] = (), fractions=(0.05, 0.10, 0.20)
) -> DataFrame:
    """Abstaining at the top 5/10/20 % and at full recall of the positives.

    The threshold is a block boundary, so its counts are the running counts
    there: no second pass over the rows.
    """
    at = F.struct(
        F.col(score).alias("threshold"), "n_upto", "pos_upto", "n_all", "pos_all"
    )
    entries, aggs = [], []
    for f in fractions:
        need = F.greatest(F.lit(1), F.ceil(F.col("n_all") * F.lit(f)))
        name = f"top_{int(f * 100)}_percent"
        aggs.append(
            F.min(F.when(F.col("n_upto") >= need, F.struct("block", at.alias("at")))).alias(name)
        )
        entries.append(name)
    aggs.append(
        F.max(F.when(F.col("pos") > 0, F.struct("block", at.alias("at")))).alias("full_recall")
    )
    entries.append("full_recall")
    rows = [
        F.struct(F.lit(e).alias("rule"), F.col(f"{e}.at").alias("at")) for e in entries
    ]
    long = blocks.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows)))
    neg = F.col("at.n_all") - F.col("at.pos_all")
    return long.select(
        *keys,
        "rule",
        F.col("at.threshold").alias("threshold"),
        F.col("at.n_upto").alias("abstained_rows"),
        (F.col("at.pos_upto") / F.nullif("at.pos_all", F.lit(0))).alias("unsafe_recall"),
        ((F.col("at.n_upto") - F.col("at.pos_upto")) / F.nullif(neg, F.lit(0))).alias(
            "safe_abstention_rate"
        ),
    )


def leave_one_unit_out_prior(rows: DataFrame, *, unit: str, action: str, label: str,
                             out: str = "prior") -> DataFrame:
    """Smoothed positive rate of the action over all other units."""
    own = rows.groupBy(unit, action).agg(
        F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n")
    )
    whole = own.groupBy(action).agg(F.sum("_p").alias("_pa"), F.sum("_n").alias("_na"))
    prior = own.join(whole, action).select(
        unit,
        action,
        ((F.col("_pa") - F.col("_p") + 1.0) / (F.col("_na") - F.col("_n") + 2.0)).alias(out),
    )
    return rows.join(prior, [unit, action])


def structural_baselines(rows: DataFrame, *, unit: str, action: str, label: str,
                         candidates: str, selected: str) -> DataFrame:
    """Long (baseline, score, label): constant, two counts and the action prior."""
    rate = rows.agg(F.avg(F.col(label).cast("double"))).scalar()
    prior = leave_one_unit_out_prior(rows, unit=unit, action=action, label=label)
    entries = [
        F.struct(F.lit(n).alias("baseline"), c.cast("double").alias("score"))
        for n, c in (
            ("constant_prevalence", rate),
            ("candidate_count", F.col(candidates)),
            ("selected_count", F.col(selected)),
            ("action_prior", F.col("prior")),
        )
    ]
    return prior.select(F.col(label).alias("label"), F.inline(F.array(*entries)))


def risk_gate(model: DataFrame, thresholds: DataFrame, baselines: DataFrame,
              baseline_thresholds: DataFrame) -> DataFrame:
    """Six checks of a risk model against prevalence and structural baselines."""
    from plumbline.operators.gates import check_rows

    def at(frame, rule, c):
        return frame.where(F.col("rule") == rule).agg(F.min(c)).scalar()

    one = model.select(
        "*",
        at(thresholds, "top_20_percent", "unsafe_recall").alias("top20"),
        at(thresholds, "full_recall", "safe_abstention_rate").alias("cost"),
        baselines.agg(F.max("average_precision")).scalar().alias("best_ap"),
        at(baseline_thresholds, "full_recall", "safe_abstention_rate").alias("best_cost"),
    )
    return check_rows(
        one,
        {
            "average_precision_at_least_twice_prevalence": F.col("average_precision")
            >= 2 * F.col("prevalence"),
            "roc_auc_at_least_0_75": F.col("roc_auc") >= 0.75,
            "top_20_percent_recalls_all_unsafe": F.col("top20") == 1.0,
            "full_recall_abstains_at_most_20_percent_safe": F.col("cost") <= 0.20,
            "average_precision_exceeds_all_structural_baselines": F.col("average_precision")
            > F.col("best_ap"),
            "full_recall_cost_beats_all_structural_baselines": F.col("cost") < F.col("best_cost"),
        },
    )
