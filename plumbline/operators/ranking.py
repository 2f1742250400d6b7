"""Ranking datasets and per-query ranking metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import PROHIBITED_FIELDS, TOP_K_CAPTURE, UNKNOWN_CATEGORY
from plumbline.functions import exprs as E
from plumbline.operators.ordering import deal, percentiles, with_group_aggregates, with_positions
from plumbline.session import materialize

SEALED = "sealed"
# Columns of these types need no parsing.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


# ---- eligibility and joins ----------------------------------------------
def eligible_decisions(decisions: DataFrame) -> DataFrame:
    """Keep eligible decisions; raise when one breaks the eligibility rule."""
    kept = decisions.where("is_eligible")
    broken = kept.where(
        ~F.col("pre_state_available") | F.col("has_collision") | (F.col("n_logical") < 2)
    )
    if not broken.isEmpty():
        raise ValueError("an eligible decision lacks state, has a collision or one candidate")
    return kept


def candidates_of(
    candidates: DataFrame, decisions: DataFrame, *, decision: str = "decision_id",
    columns: Sequence[str] = (), rows: int | None = None,
) -> DataFrame:
    """Candidates of the chosen decisions, with decision columns attached.

    ``rows``, an upper bound of the candidates, has them dealt into tasks of a fixed size."""
    if rows:
        candidates = deal(candidates, [decision], rows)
    return candidates.join(decisions.select(decision, *columns), decision)


def candidate_count_check(
    candidates: DataFrame, decisions: DataFrame, *, expected: str = "n_logical"
) -> DataFrame:
    """One row: candidates found against candidates promised by the decisions."""
    found = candidates.agg(F.count(F.lit(1)).alias("found"))
    promised = decisions.agg(F.coalesce(F.sum(expected), F.lit(0))).scalar()
    return found.select("found", promised.alias("expected")).withColumn(
        "passed", F.col("found") == F.col("expected")
    )


# ---- feature contract ----------------------------------------------------
def numeric_audit(
    rows: DataFrame, features: Sequence[str], booleans: Sequence[str] = ()
) -> DataFrame:
    """Count, missing, non-finite, range and usefulness per feature, in one pass.

    All features are aggregated side by side (one row per task leaves the map
    side) and only the single result row is turned into feature rows.
    """
    kinds = dict(rows.dtypes)
    entries, aggs = [], []
    for i, f in enumerate(features):
        if kinds[f] in NUMBERS and f not in booleans:
            number = F.col(f).cast("double")
        else:
            raw = F.coalesce(F.col(f).cast("string"), F.lit(""))
            if f in booleans:
                raw = F.when(raw == "", "").otherwise(F.when(E.flag(raw), "1").otherwise("0"))
            number = F.when(raw != "", raw.try_cast("double"))
        finite = F.when(E.is_finite(number), number)
        aggs += [
            F.count_if(number.isNull()).alias(f"m{i}"),
            F.count_if(number.isNotNull() & ~E.is_finite(number)).alias(f"n{i}"),
            F.min(finite).alias(f"lo{i}"),
            F.max(finite).alias(f"hi{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.col("_rows").alias("rows"),
                F.col(f"m{i}").alias("missing"),
                F.col(f"n{i}").alias("nonfinite"),
                F.col(f"lo{i}").alias("minimum"),
                F.col(f"hi{i}").alias("maximum"),
                F.coalesce(F.col(f"lo{i}") < F.col(f"hi{i}"), F.lit(False)).alias("informative"),
            )
        )
    return rows.agg(F.count(F.lit(1)).alias("_rows"), *aggs).select(F.inline(F.array(*entries)))


def category_counts(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, rows) with blanks counted as the empty text."""
    long = rows.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value"),
                    )
                    for f in features
                ]
            )
        ).alias("e")
    )
    return long.groupBy("e.feature", "e.value").agg(F.count(F.lit(1)).alias("rows"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """Sorted values per categorical feature plus the unknown bucket; features
    with fewer than two values are dropped."""
    named = counts.where(F.col("value") != "").select("feature", "value")
    kept = named.groupBy("feature").agg(F.count(F.lit(1)).alias("values")).where("values >= 2")
    numbered = with_positions(named.join(kept, "feature"), ["feature"], ["value"])
    unknown = kept.select(
        "feature", F.lit(UNKNOWN_CATEGORY).alias("value"), (F.col("values") + 1).alias("position")
    )
    return numbered.select("feature", "value", "position").unionByName(unknown)


def encoded_features(
    audits: Sequence[DataFrame], vocab: DataFrame, numeric_order: Sequence[str],
    categorical_order: Sequence[str],
) -> DataFrame:
    """The fitted contract as rows (position, name, feature, category)."""
    audit = audits[0]
    for other in audits[1:]:
        audit = audit.unionByName(other)
    place = F.array(*[F.lit(f) for f in [*numeric_order, *categorical_order]])
    numeric = audit.where("informative").select(
        "feature", F.lit(None).cast("string").alias("category"), F.lit(0).alias("_slot")
    )
    categorical = vocab.select("feature", F.col("value").alias("category"),
                               F.col("position").cast("int").alias("_slot"))
    rows = numeric.unionByName(categorical).withColumn("_at", F.array_position(place, F.col("feature")))
    name = F.when(F.col("category").isNull(), F.col("feature")).otherwise(
        F.concat_ws("==", "feature", "category")
    )
    return with_positions(rows.withColumn("name", name), [], ["_at", "_slot"]).select(
        "position", "name", "feature", "category"
    )


# A plan holds an expression per column of the matrix.
MOST_COLUMNS = 4096


def assemble(
    rows: DataFrame, contract: DataFrame, booleans: Sequence[str] = (), *, out: str = "features"
) -> DataFrame:
    """Numeric values (missing is NaN) and one-hot categories as a float array.

    The contract is a schema: its rows are the columns of the matrix, of which
    there may be MOST_COLUMNS.
    """
    spec = contract.orderBy("position").limit(MOST_COLUMNS + 1).collect()
    if len(spec) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} matrix columns; drop features of many categories")
    known: dict[str, list[str]] = {}
    for r in spec:
        if r["category"] is not None and r["category"] != UNKNOWN_CATEGORY:
            known.setdefault(r["feature"], []).append(r["category"])
    kinds = dict(rows.dtypes)
    cells = []
    for r in spec:
        f = r["feature"]
        if r["category"] is None:
            if kinds[f] in NUMBERS and f not in booleans:
                number = F.col(f).cast("double")
                cells.append(F.when(E.is_finite(number), number).otherwise(F.lit(E.NAN)))
            else:
                cells.append(E.numeric_feature(f, f in booleans))
            continue
        value = F.coalesce(F.col(f).cast("string"), F.lit(""))
        unseen = ~value.isin(*known[f])
        hit = unseen if r["category"] == UNKNOWN_CATEGORY else value == r["category"]
        cells.append(hit.cast("double"))
    return rows.withColumn(out, F.array(*[c.cast("float") for c in cells]))


def assemble_sparse(
    rows: DataFrame, contract: DataFrame, booleans: Sequence[str] = (), *, out: str = "features"
) -> DataFrame:
    """The same matrix as ``assemble`` as a struct of size, indices (from 0) and values.

    Categories come in by a join with the contract for each categorical feature, so the
    plan grows with the features and not with their categories, and a row holds a cell
    per feature at most. Cells of 0 are left out; missing numbers are NaN.
    """
    spec = materialize(contract, "contract")
    size, unseen_at = spec.agg(
        F.max("position"),
        F.map_from_entries(F.collect_list(F.when(
            F.col("category") == UNKNOWN_CATEGORY, F.struct("feature", "position")
        ))),
    ).first()
    numeric = spec.where("category IS NULL").select("feature", "position").collect()
    known = spec.where(F.col("category").isNotNull() & (F.col("category") != UNKNOWN_CATEGORY))
    coded = [r["feature"] for r in spec.where("category IS NOT NULL").select("feature").distinct().collect()]
    kinds = dict(rows.dtypes)
    wide = rows.select(F.struct("*", F.lit(0).alias("_")).alias("_row"))
    cell = lambda at, value: F.struct(
        (at - 1).cast("int").alias("at"), value.cast("float").alias("value")
    )
    cells = []
    for r in numeric:
        f = r["feature"]
        number = F.col("_row")[f].cast("double")
        if kinds[f] in NUMBERS and f not in booleans:
            number = F.when(E.is_finite(number), number).otherwise(F.lit(E.NAN))
        else:
            number = E.numeric_feature(F.col("_row")[f], f in booleans)
        cells.append(cell(F.lit(r["position"]), number))
    for i, f in enumerate(sorted(coded)):
        index = known.where(F.col("feature") == f).select(
            F.col("category").alias(f"_c{i}"), F.col("position").alias(f"_p{i}")
        )
        value = F.coalesce(F.col("_row")[f].cast("string"), F.lit(""))
        wide = wide.withColumn(f"_v{i}", value).join(index, F.col(f"_v{i}") == F.col(f"_c{i}"), "left")
        at = F.coalesce(F.col(f"_p{i}"), F.lit((unseen_at or {}).get(f)).cast("int"))
        cells.append(F.when(at.isNotNull(), cell(at, F.lit(1.0))))
    held = F.array(*cells) if cells else F.array().cast("array<struct<at:int,value:float>>")
    told = F.array_sort(F.filter(held, lambda c: c.isNotNull() & ((c["value"] != 0) | F.isnan(c["value"]))))
    return wide.select(
        *[F.col("_row")[c].alias(c) for c in rows.columns if c != out], told.alias("_told")
    ).select(
        *[c for c in rows.columns if c != out],
        F.struct(
            F.lit(size or 0).cast("int").alias("size"), F.col("_told.at").alias("indices"),
            F.col("_told.value").alias("values"),
        ).alias(out),
    )


def forbidden_columns(df: DataFrame, prohibited: Sequence[str] = PROHIBITED_FIELDS) -> list[str]:
    """Paths of prohibited names anywhere in the schema, nested fields included."""
    found: list[str] = []

    def walk(dtype, path: str) -> None:
        for field in getattr(dtype, "fields", []) or []:
            here = f"{path}.{field.name}" if path else field.name
            if field.name in prohibited:
                found.append(here)
            walk(field.dataType, here)
        for part in ("elementType", "valueType", "keyType"):
            if hasattr(dtype, part):
                walk(getattr(dtype, part), f"{path}[]")

    walk(df.schema, "")
    return found


def forbid_columns(df: DataFrame, prohibited: Sequence[str] = PROHIBITED_FIELDS) -> DataFrame:
    found = forbidden_columns(df, prohibited)
    if found:
        raise ValueError(f"prohibited fields: {found}")
    return df


def forbidden_json_keys(rows: DataFrame, text: str, prohibited: Sequence[str]) -> DataFrame:
    """(row columns, key) for every prohibited key at any depth of a JSON text.

    Keys are read from the text itself: a quoted name followed by a colon, with
    string values removed first so that they cannot look like keys.
    """
    strings = r'"(?:[^"\\]|\\.)*"'
    values_gone = F.regexp_replace(F.col(text), rf"([:\[,]\s*){strings}(?!\s*:)", r'$1 ""')
    keys = F.regexp_extract_all(values_gone, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    hits = F.array_intersect(keys, F.array(*[F.lit(p) for p in prohibited]))
    return rows.select(*rows.columns, F.explode(hits).alias("forbidden_key"))


def select_subset(df: DataFrame, contract: Sequence[str], keep: Sequence[str],
                  dropped: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """Keep named features in frozen order; every feature must be accounted for."""
    loose = sorted(set(contract) - set(keep) - set(dropped))
    unknown = sorted((set(keep) | set(dropped)) - set(contract))
    if loose or unknown:
        raise ValueError(f"unaccounted features: {loose}, unknown features: {unknown}")
    return df.select(*others, *[c for c in contract if c in set(keep)])


# ---- weights and profiles -------------------------------------------------
def unit_balanced_weights(
    queries: DataFrame, *, unit: str = "unit",
    weights: "Mapping[str, Column | str | None] | None" = None,
) -> DataFrame:
    """Weights so that every unit counts equally and the mean weight is one.

    ``weights`` maps an output column to the condition of active queries (None
    is all of them); inactive queries get zero and do not count. The query table
    is written once: the per-unit counts and the totals both read it.
    """
    weights = {"query_weight": None} if weights is None else dict(weights)
    on = {n: F.lit(True) if c is None else E.col(c) for n, c in weights.items()}
    queries = materialize(queries, "queries")
    marked = with_group_aggregates(
        queries, [unit], {f"_mine_{n}": F.count_if(c) for n, c in on.items()}
    )
    per_unit = queries.groupBy(unit).agg(*[F.count_if(c).alias(n) for n, c in on.items()])
    totals = per_unit.agg(
        F.struct(
            *[
                F.struct(F.sum(n).alias("queries"), F.count_if(F.col(n) > 0).alias("units")).alias(n)
                for n in weights
            ]
        )
    )
    out = marked.withColumn("_t", totals.scalar())
    for n, c in on.items():
        share = F.col(f"_t.{n}.queries") / F.nullif(
            F.col(f"_t.{n}.units") * F.col(f"_mine_{n}"), F.lit(0)
        )
        out = out.withColumn(n, F.when(c, share).otherwise(F.lit(0.0)))
    return out.drop("_t", *[f"_mine_{n}" for n in weights])


def weight_balance(weighted: DataFrame, *, unit: str = "unit", weight: str = "query_weight"):
    """Spread of the total weight per unit."""
    per_unit = weighted.where(F.col(weight) > 0).groupBy(unit).agg(F.sum(weight).alias("_w"))
    return per_unit.agg(
        F.count(F.lit(1)).alias("units"),
        F.min("_w").alias("min_weight"),
        F.max("_w").alias("max_weight"),
        (F.max("_w") - F.min("_w") <= F.lit(1e-6)).alias("balanced"),
    )


def concentration(queries: DataFrame, keys: Sequence[str], *, unit: str = "unit",
                  size: str = "n_candidates") -> DataFrame:
    """How unevenly candidates are spread over units, per subset.

    Units are ranked by size; the top shares are sums of the largest units,
    which takes a short list per subset and never the unit table.
    """
    per_unit = queries.groupBy(*keys, unit).agg(
        F.sum(size).alias("_c"), F.count(F.lit(1)).alias("_q")
    )
    totals = per_unit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("_q").alias("queries"),
        F.sum("_c").alias("candidates"),
        F.sum(F.col("_c").cast("double") * F.col("_c")).alias("_squares"),
    )
    top = top_units(per_unit, keys, unit=unit, size="_c", n=10)
    shares = top.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("place") <= k, F.col("_c"))).alias(f"_top{k}") for k in (1, 5, 10)]
    )
    names = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "max": 1.0}
    quantiles = percentiles(queries, keys, size, {f"size_{n}": q for n, q in names.items()})
    joined = totals.join(shares, list(keys)).join(quantiles, list(keys))
    return joined.select(
        *keys,
        "units",
        "queries",
        "candidates",
        *[f"size_{n}" for n in names],
        *[(F.col(f"_top{k}") / F.col("candidates")).alias(f"top_{k}_share") for k in (1, 5, 10)],
        (F.col("candidates").cast("double") * F.col("candidates") / F.col("_squares")).alias(
            "effective_units"
        ),
    )


def top_units(per_unit: DataFrame, keys: Sequence[str], *, unit: str, size: str, n: int):
    """The n largest units per key. Every salt keeps its own n first, so the
    final ranking sees at most salts x n rows per key."""
    from pyspark.sql import Window

    order = [F.col(size).desc(), F.col(unit)]
    salted = per_unit.withColumn("_salt", F.pmod(F.xxhash64(unit), F.lit(512)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    short = salted.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
    ranked = short.withColumn("place", F.row_number().over(final).cast("bigint"))
    return ranked.where(F.col("place") <= n).drop("_salt", "_r")


def label_profile(
    queries: DataFrame, keys: Sequence[str], *, subset: str, size: str = "n_candidates",
    positives: str = "n_positives",
) -> DataFrame:
    """Label statistics; sealed (test) subsets report the word instead of numbers."""
    p, n = F.col(positives), F.col(size)
    sealed = F.col(subset).endswith("_test")
    stats = queries.groupBy(*keys).agg(
        F.sum(p).alias("positives"),
        F.sum(n).alias("_n"),
        F.count_if(p == 0).alias("zero_positive_queries"),
        F.count_if(p == n).alias("all_positive_queries"),
        F.count_if((p > 0) & (p < n)).alias("effective_queries"),
    )
    shown = [
        F.when(~sealed, F.col(c)).alias(c)
        for c in ("positives", "zero_positive_queries", "all_positive_queries", "effective_queries")
    ]
    return stats.select(
        *keys,
        F.when(sealed, SEALED).otherwise("open").alias("label_statistics"),
        *shown,
        F.when(~sealed, F.col("positives") / F.col("_n")).alias("positive_rate"),
    )


def top_k_capture(
    ranked: DataFrame, keys: Sequence[str], *, rank: str, label: str, ks=TOP_K_CAPTURE
):
    y = F.col(label).cast("bigint")
    sums = ranked.groupBy(*keys).agg(
        F.sum(y).alias("positives"),
        *[F.coalesce(F.sum(F.when(F.col(rank) <= k, y)), F.lit(0)).alias(f"top_{k}") for k in ks],
    )
    recalls = [(F.col(f"top_{k}") / F.nullif(F.col("positives"), F.lit(0))).alias(f"recall_{k}")
               for k in ks]
    return sums.select("*", *recalls)


# ---- metrics ---------------------------------------------------------------
def query_metrics(
    rows: DataFrame,
    *,
    query: Sequence[str],
    score: str,
    baseline_rank: str,
    label: str,
    carry: Sequence[str] = (),
    ks: Sequence[int] = (1, 5, 10, 20),
) -> DataFrame:
    """NDCG, recall, average precision and selection overlap per effective query.

    Rows are numbered by falling score with the baseline rank as tie-break; all
    metrics are then sums, combined on the map side. Queries with one label only
    are left out.
    """
    y = F.col(label).cast("bigint")
    ordered = with_positions(
        rows.select(*query, *carry, score, baseline_rank, y.alias("_y")),
        query,
        [F.col(score).desc(), F.col(baseline_rank)],
        position="_r",
        running={"_hits": "_y"},
        totals={"_p": "_y"},
    )
    return metrics_of_ranked(ordered, query=query, carry=carry, ks=ks)


def metrics_of_ranked(ordered, *, query, carry=(), ks=(1, 5, 10, 20)) -> DataFrame:
    """Metrics from rows that carry rank ``_r``, label ``_y``, running hits
    ``_hits`` and the query's positives ``_p``."""
    gain = F.col("_y") / F.log2(F.col("_r") + 1)
    hit = F.col("_y") == 1
    sums = (
        ordered.groupBy(*query, *carry)
        .agg(
            F.count(F.lit(1)).alias("n_candidates"),
            F.sum("_y").alias("n_positives"),
            *[F.sum(F.when(F.col("_r") <= k, gain)).alias(f"_dcg{k}") for k in ks],
            *[F.sum(F.when(F.col("_r") <= k, F.col("_y"))).alias(f"_top{k}") for k in ks],
            F.sum(F.when(hit, F.col("_hits") / F.col("_r"))).alias("_ap"),
            F.count_if(hit & (F.col("_r") <= F.col("_p"))).alias("_within"),
        )
        .where((F.col("n_positives") > 0) & (F.col("n_positives") < F.col("n_candidates")))
    )

    def ideal(k: int) -> Column:
        last = F.least(F.col("n_positives"), F.lit(k).cast("bigint"))
        return F.aggregate(
            F.sequence(F.lit(1).cast("bigint"), last),
            F.lit(0.0),
            lambda a, i: a + F.lit(1.0) / F.log2(i + 1),
        )

    return sums.select(
        *query,
        *carry,
        "n_candidates",
        "n_positives",
        *[(F.col(f"_dcg{k}") / ideal(k)).alias(f"ndcg_{k}") for k in ks],
        *[(F.col(f"_top{k}") / F.col("n_positives")).alias(f"recall_{k}") for k in ks],
        (F.col("_ap") / F.col("n_positives")).alias("average_precision"),
        (F.col("_within") / F.col("n_positives")).alias("selection_overlap"),
    )


METRICS = (
    "ndcg_1", "ndcg_5", "ndcg_10", "ndcg_20",
    "recall_1", "recall_5", "recall_10", "recall_20",
    "average_precision", "selection_overlap",
)


def unit_means(metrics: DataFrame, *, unit: str = "unit", names: Sequence[str] = METRICS):
    return metrics.groupBy(unit).agg(
        F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in names]
    )


def unit_equal_mean(metrics: DataFrame, *, unit: str = "unit", names: Sequence[str] = METRICS):
    """Mean within each unit, then mean over units."""
    return unit_means(metrics, unit=unit, names=names).agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("queries").alias("queries"),
        *[F.avg(m).alias(m) for m in names],
    )


def anchored_score(rows: DataFrame, *, query: Sequence[str], score: str, baseline_rank: str,
                   out: str = "anchored_score") -> DataFrame:
    """Lift the baseline's first choice above every other score of its query."""
    whole = with_group_aggregates(
        rows, query, {"_top": F.max(score), "_firsts": F.count_if(F.col(baseline_rank) == 1)}
    )
    lifted = F.col("_top") + F.greatest(F.abs(F.col("_top")), F.lit(1.0))
    guarded = F.when(F.col("_firsts") == 1, lifted).otherwise(
        F.raise_error(F.lit("expected one rank-1 candidate per query")).cast("double")
    )
    return whole.withColumn(
        out, F.when(F.col(baseline_rank) == 1, guarded).otherwise(F.col(score))
    ).drop("_top", "_firsts")


def anchor_faults(rows: DataFrame, *, query: Sequence[str], baseline_rank: str) -> DataFrame:
    """Queries without exactly one baseline first choice."""
    firsts = rows.groupBy(*query).agg(
        F.count_if(F.col(baseline_rank) == 1).alias("first_choices")
    )
    return firsts.where(F.col("first_choices") != 1)


def unit_deltas(baseline: DataFrame, model: DataFrame, *, unit: str = "unit",
                names: Sequence[str] = METRICS) -> DataFrame:
    """Long (unit, metric, baseline, model, delta) over units both sides scored."""
    long = []
    for side, frame in (("baseline", baseline), ("model", model)):
        means = unit_means(frame, unit=unit, names=names)
        long.append(
            means.unpivot([unit], list(names), "metric", side)
        )
    return long[0].join(long[1], [unit, "metric"]).withColumn(
        "delta", F.col("model") - F.col("baseline")
    )
