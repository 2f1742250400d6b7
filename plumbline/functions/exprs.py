"""Scalar expressions: typed parsing, identities, outcome rules, array summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.fixed_values import (
    ADAPTIVE_WEIGHTS,
    CLOSE_TOLERANCE,
    COMPLETE_STATUSES,
    ORIGIN_NAMES,
    POOL_BONUS,
    TRUE_WORDS,
    UNKNOWN_CATEGORY,
)

NAN = float("nan")
INF = float("inf")


def col(c: "Column | str") -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- parsing ------------------------------------------------------------
def flag(text) -> Column:
    """Lenient boolean: trimmed, any case; everything else is false."""
    return F.coalesce(F.lower(F.trim(col(text).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def exact_true(text) -> Column:
    """Strict boolean of the raw scan: the text ``True`` and nothing else."""
    return F.coalesce(col(text) == "True", F.lit(False))


def integer(text) -> Column:
    """``"3.0"`` is 3; truncates towards zero."""
    return col(text).try_cast("double").try_cast("bigint")


def is_finite(number) -> Column:
    n = col(number)
    return n.isNotNull() & ~F.isnan(n) & (F.abs(n) != F.lit(INF))


def score(text) -> Column:
    """Missing, unparsable and every non-finite score (also +inf) sort last."""
    number = col(text).try_cast("double")
    return F.when(is_finite(number), number).otherwise(F.lit(-INF))


def numeric_feature(text, boolean: bool = False) -> Column:
    """Feature value; blank, unparsable and non-finite become NaN."""
    raw = F.coalesce(col(text).cast("string"), F.lit(""))
    number = flag(raw).cast("double") if boolean else raw.try_cast("double")
    return F.when((raw != "") & is_finite(number), number).otherwise(F.lit(NAN))


def blank(text) -> Column:
    return F.coalesce(col(text).cast("string"), F.lit("")) == ""


def starred_number(text) -> Column:
    """``"12.5*"`` is 12.5; anything unparsable is null."""
    return F.regexp_replace(col(text), r"\*+$", "").try_cast("double")


# ---- names and identities ------------------------------------------------
def unit_stem(name, linear_too: bool = False) -> Column:
    pattern = r"(?i)\.(mps|lp)(\.gz)?$" if linear_too else r"\.mps(\.gz)?$"
    return F.regexp_replace(col(name), pattern, "")


def family_key(name) -> Column:
    """Heuristic family: letters of the name's pieces, digits dropped."""
    stem = F.regexp_replace(F.lower(col(name)), r"\.mps(\.gz)?$", "")
    pieces = F.transform(F.split(stem, "[-_]"), lambda p: F.regexp_replace(p, r"\d+", ""))
    return F.array_join(F.filter(pieces, lambda p: p != ""), "-")


def decision_id(unit, run, node, step) -> Column:
    return F.concat(
        col(unit),
        F.lit("|run="), col(run).cast("string"),
        F.lit("|node="), col(node).cast("string"),
        F.lit("|sep="), col(step).cast("string"),
    )


def content_signature(fields: Sequence["Column | str"]) -> Column:
    """Hash of the raw texts as a compact JSON array; missing is the empty text."""
    texts = [F.coalesce(col(f).cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.to_json(F.array(*texts)), 256)


def logical_id(decision, source_id, signature) -> Column:
    return F.sha2(
        F.concat(
            col(decision),
            F.lit("|source_cut_id="), col(source_id),
            F.lit("|signature="), col(signature),
        ),
        256,
    )


def filled_id(source_id, index) -> Column:
    return F.when(
        blank(source_id), F.concat(F.lit("missing@"), col(index).cast("string"))
    ).otherwise(col(source_id).cast("string"))


def cluster_key(group, unit, prefix: str = "officially-ungrouped:") -> Column:
    named = F.nullif(F.trim(col(group)), F.lit(""))
    return F.coalesce(named, F.concat(F.lit(prefix), col(unit).cast("string")))


def subset_name(split, stratum) -> Column:
    part = (
        F.when(col(stratum) == "unseen_family", "official_group_ood")
        .when(col(stratum) == "seen_family", "seen_family")
        .when(col(stratum) == "officially_ungrouped", "officially_ungrouped")
    )
    tail = F.when(col(split) == "val", "val").otherwise("test")
    return F.when(col(split) == "train", "train").otherwise(F.concat_ws("_", part, tail))


def origin_name(code) -> Column:
    named = F.when(F.lit(False), F.lit(""))
    for key, value in ORIGIN_NAMES.items():
        named = named.when(col(code) == key, value)
    return named.otherwise(F.lit(UNKNOWN_CATEGORY))


# ---- outcomes ------------------------------------------------------------
def close_to(left, right) -> Column:
    """Equal within 1e-9 relative or absolute; NaN equals NaN, infinities by sign.
    Two nulls count as equal values, one null never does."""
    a, b = col(left), col(right)
    nan_a, nan_b = F.isnan(a), F.isnan(b)
    inf_any = (F.abs(a) == F.lit(INF)) | (F.abs(b) == F.lit(INF))
    near = F.abs(a - b) <= F.greatest(
        F.lit(CLOSE_TOLERANCE) * F.greatest(F.abs(a), F.abs(b)), F.lit(CLOSE_TOLERANCE)
    )
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(nan_a | nan_b, nan_a & nan_b)
        .when(inf_any, a == b)
        .otherwise(near)
    )


def is_complete(status) -> Column:
    return F.coalesce(col(status).isin(*COMPLETE_STATUSES), F.lit(False))


def penalised_time(complete, seconds, limit) -> Column:
    """Solved runs keep their time (at least 1e-12), others cost twice the limit."""
    floor = F.greatest(col(seconds).cast("double"), F.lit(1e-12))
    return F.when(col(complete), floor).otherwise(2 * _double(limit))


def exact_sum(value) -> Column:
    """Aggregate: the sum of doubles as decimals, the same in any order of the rows. Up to ten
    decimals it is free of rounding; beside a value too large or not finite it is the plain sum."""
    v = col(value)
    exact = v.try_cast("decimal(28,10)")
    return F.when(F.count(exact) == F.count(v), F.sum(exact).cast("double")).otherwise(F.sum(v))


def _double(value) -> Column:
    return F.lit(float(value)) if isinstance(value, (int, float)) else col(value).cast("double")


def relative_saving(control, treatment) -> Column:
    c, t = col(control), col(treatment)
    return F.when(c != 0, (c - t) / F.nullif(c, F.lit(0.0)))


def relative_change(control, treatment) -> Column:
    c, t = col(control), col(treatment)
    return F.when(c != 0, (t - c) / F.nullif(F.abs(c), F.lit(0.0)))


def outcome_class(native_complete, treatment_complete) -> Column:
    n, t = col(native_complete), col(treatment_complete)
    return (
        F.when(n & t, "both_complete")
        .when(n, "native_complete_treatment_incomplete")
        .when(t, "native_incomplete_treatment_complete")
        .otherwise("both_incomplete")
    )


def parity_class(passed, exercised, native_status, treatment_status) -> Column:
    same_limit = ~is_complete(native_status) & (col(native_status) == col(treatment_status))
    return (
        F.when(col(passed), "passed")
        .when(~col(exercised), "callback_not_exercised")
        .when(same_limit, "both_arms_same_incomplete_limit_status")
        .otherwise("structural_mismatch")
    )


# ---- candidate scores ----------------------------------------------------
def zero_if_nan(number) -> Column:
    return F.coalesce(F.nanvl(col(number), F.lit(0.0)), F.lit(0.0))


def integer_support(integer_columns, nonzeros) -> Column:
    return F.when(col(nonzeros) > 0, col(integer_columns) / col(nonzeros)).otherwise(F.lit(0.0))


def linear_score(
    efficacy, distance, parallelism, support, *, incumbent, local, pool, weights
) -> Column:
    """Weighted sum of the candidate's qualities.

    With an incumbent the distance term is the larger of distance and efficacy
    (efficacy alone for local rows); without one its weight moves to efficacy.
    """
    e = zero_if_nan(efficacy)
    reach = F.when(col(local), e).otherwise(F.greatest(zero_if_nan(distance), e))
    directed = col(incumbent) & F.lit(weights["distance"] > 0.0)
    lead = F.when(
        directed, F.lit(weights["distance"]) * reach + F.lit(weights["efficacy"]) * e
    ).otherwise(F.lit(weights["distance"] + weights["efficacy"]) * e)
    return (
        lead
        + F.lit(weights["parallelism"]) * zero_if_nan(parallelism)
        + F.lit(weights["integer"]) * col(support)
        + F.when(col(pool), F.lit(POOL_BONUS)).otherwise(F.lit(0.0))
    )


def log_square_share(value, maximum) -> Column:
    v, m = col(value), col(maximum)
    usable = is_finite(v) & is_finite(m) & (v > 0) & (m > 0)
    share = F.log1p(F.when(usable, v)) / F.log1p(F.when(usable, m))
    return F.coalesce(share * share, F.lit(0.0))


def adaptive_score(
    efficacy, efficacy_max, distance, distance_max, parallelism, support, *, incumbent, pool
) -> Column:
    w = ADAPTIVE_WEIGHTS
    e = log_square_share(efficacy, efficacy_max)
    d = log_square_share(distance, distance_max)
    lead = F.when(col(incumbent), F.lit(w["efficacy"]) * e + F.lit(w["distance"]) * d).otherwise(
        F.lit(w["efficacy"] + w["distance"]) * e
    )
    return (
        lead
        + F.lit(w["integer"]) * col(support)
        + F.lit(w["parallelism"]) * col(parallelism)
        + F.when(col(pool), F.lit(POOL_BONUS)).otherwise(F.lit(0.0))
    )


# ---- arrays --------------------------------------------------------------
def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def vector_summary(vector) -> Column:
    """nnz, norms and spread of the stored entries' absolute values; population
    deviation; zeros for an empty list."""
    v = F.coalesce(F.transform(col(vector), lambda x: F.abs(x.cast("double"))), F.array())
    v = v.cast("array<double>")
    n = F.size(v)
    some = n > 0
    mean = _total(v) / F.nullif(n, F.lit(0))
    spread = F.aggregate(
        v,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).alias("n"),
                 F.lit(0.0).alias("m"), F.lit(0.0).alias("m2")),
        # running mean and squared deviation: one pass, no cancellation
        lambda a, x: F.struct(
            (a["s"] + x).alias("s"),
            (a["q"] + x * x).alias("q"),
            (a["n"] + 1).alias("n"),
            (a["m"] + (x - a["m"]) / (a["n"] + 1)).alias("m"),
            (a["m2"] + (x - a["m"]) * (x - (a["m"] + (x - a["m"]) / (a["n"] + 1)))).alias("m2"),
        ),
    )
    zero = F.lit(0.0)
    return F.struct(
        n.cast("bigint").alias("nnz"),
        _total(v).alias("norm_l1"),
        F.sqrt(spread["q"]).alias("norm_l2"),
        F.when(some, F.array_max(v)).otherwise(zero).alias("max_abs"),
        F.when(some, F.array_min(v)).otherwise(zero).alias("min_abs"),
        F.when(some, mean).otherwise(zero).alias("mean_abs"),
        F.when(some, F.sqrt(spread["m2"] / F.nullif(n, F.lit(0)))).otherwise(zero).alias("std_abs"),
    )


def finite_values(values) -> Column:
    return F.filter(
        F.transform(col(values), lambda x: x.try_cast("double")), lambda x: is_finite(x)
    )


def finite_mean(values) -> Column:
    v = finite_values(values)
    return F.when(F.size(v) > 0, _total(v) / F.nullif(F.size(v), F.lit(0))).otherwise(F.lit(NAN))


def finite_min(values) -> Column:
    return F.coalesce(F.array_min(finite_values(values)), F.lit(NAN))


def finite_max(values) -> Column:
    return F.coalesce(F.array_max(finite_values(values)), F.lit(NAN))


def true_fraction(flags) -> Column:
    known = F.filter(col(flags), lambda x: x.isNotNull())
    hits = F.size(F.filter(known, lambda x: x))
    return F.when(F.size(known) > 0, hits / F.nullif(F.size(known), F.lit(0))).otherwise(F.lit(NAN))


def safe_ratio(numerator, denominator) -> Column:
    """NaN when the numerator is not finite or the denominator is zero;
    a missing denominator is NaN too."""
    a, b = col(numerator).try_cast("double"), col(denominator).try_cast("double")
    return F.when(is_finite(a) & is_finite(b) & (b != 0), a / F.nullif(b, F.lit(0.0))).otherwise(
        F.lit(NAN)
    )


# ---- exact binomial bound ------------------------------------------------
# Coefficients of Lanczos' approximation of the gamma function for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        total = total + c / (x + i)
    t = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(total)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, two terms a step (Lentz); the
    number of steps grows with the root of the larger parameter."""
    tiny = F.lit(1e-300)

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / away(1.0 + even * acc["d"])
        c = away(1.0 + even / acc["c"])
        return F.struct(
            (acc["h"] * c * d).alias("h"), c.alias("c"), d.alias("d"),
            (-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))).alias("odd"),
        )

    def both(acc: Column, m: Column) -> Column:
        # The middle is bound once: an expression used twice would be worked out twice.
        more = F.element_at(F.transform(F.array(step(acc, m)), last), 1)
        return F.when(acc["done"], acc).otherwise(more)

    def last(mid: Column) -> Column:
        d = 1.0 / away(1.0 + mid["odd"] * mid["d"])
        c = away(1.0 + mid["odd"] / mid["c"])
        return F.struct(
            (mid["h"] * c * d).alias("h"), c.alias("c"), d.alias("d"), (F.abs(c * d - 1.0) < 1e-16).alias("done")
        )

    d = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(d.alias("h"), F.lit(1.0).alias("c"), d.alias("d"), F.lit(False).alias("done"))
    most = (100 + 3 * F.sqrt(F.greatest(a, b))).cast("int")
    steps = F.transform(F.sequence(F.lit(1), most), lambda m: m.cast("double"))
    return F.aggregate(steps, start, both)["h"]


def binomial_upper_bound(failures, trials, confidence: float = 0.95, steps: int = 30) -> Column:
    """One-sided exact (Clopper-Pearson) upper bound.

    It is the p at which the incomplete beta function I_p(k + 1, n - k) reaches the
    confidence: a fixed number of Newton steps, halved where one would leave the bracket.
    Null without trials, 1 when every trial failed, closed form for none.
    """
    k, n = col(failures).cast("bigint"), col(trials).cast("bigint")
    alpha = 1.0 - confidence
    # Parameters of a row that needs no search are harmless ones.
    plain = n.isNull() | k.isNull() | (k <= 0) | (k >= n)
    a = F.when(plain, 2.0).otherwise((k + 1).cast("double"))
    b = F.when(plain, 2.0).otherwise((n - k).cast("double"))
    z = 1.6448536269514722  # only where the search begins
    rate = (a - 1) / (a + b - 1)
    size = a + b - 1
    begin = (rate + z * z / (2 * size) + z * F.sqrt(rate * (1 - rate) / size + z * z / (4 * size * size))) / (
        1 + z * z / size
    )

    def search(v: Column) -> Column:
        a, b = v["a"], v["b"]

        def newton(acc: Column, _i: Column) -> Column:
            p = acc["p"]
            low = p < (a + 1) / (a + b + 2)
            front = F.exp(v["beta"] + a * F.log(p) + b * F.log1p(-p))
            fraction = _beta_fraction(F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, p).otherwise(1 - p))
            own = F.struct(p.alias("p"), acc["lo"].alias("lo"), acc["hi"].alias("hi"), low.alias("low"),
                           front.alias("front"), fraction.alias("f"))
            return F.when(acc["done"], acc).otherwise(F.element_at(F.transform(F.array(own), moved), 1))

        def moved(w: Column) -> Column:
            p = w["p"]
            # Distance to the confidence; in the upper half from the tail, which keeps its digits.
            gap = F.when(w["low"], w["front"] * w["f"] / a - confidence).otherwise(alpha - w["front"] * w["f"] / b)
            lo, hi = F.when(gap < 0, p).otherwise(w["lo"]), F.when(gap < 0, w["hi"]).otherwise(p)
            slope = w["front"] / (p * (1 - p))
            nxt = p - gap / F.nullif(slope, F.lit(0.0))
            inside = (nxt > lo) & (nxt < hi)
            done = F.coalesce((gap == 0) | (F.abs(nxt - p) <= 1e-12 * p), F.lit(False))
            return F.struct(
                F.when(done, p).when(F.coalesce(inside, F.lit(False)), nxt).otherwise((lo + hi) / 2).alias("p"),
                lo.alias("lo"), hi.alias("hi"), done.alias("done"),
            )

        start = F.struct(v["begin"].alias("p"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton)["p"]

    beta = log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    given = F.struct(a.alias("a"), b.alias("b"), beta.alias("beta"), begin.alias("begin"))
    found = F.element_at(F.transform(F.array(given), search), 1)
    return (
        F.when(k.isNull() | n.isNull() | (n == 0), F.lit(None).cast("double"))
        .when(k == n, F.lit(1.0))
        .when(k == 0, 1.0 - F.pow(F.lit(alpha), 1.0 / F.nullif(n, F.lit(0)).cast("double")))
        .otherwise(found)
    )
