"""URL filter: host and path rules first, then logistic regression on hashed n-grams.

All of it is DataFrame work inside the JVM. The model learns from a small labelled
table of URLs (at most SAMPLE rows): the character n-grams of host and path, hashed
to BUCKETS counts. Scoring is one expression per URL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000  # most labelled URLs in the fit
BUCKETS = 1 << 12
SIZES = (3, 4)

Rule = tuple[str, str, str]  # verdict, host, path prefix


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(host and path prefix of the longest fitting rule, its verdict); null without one.

    The rules are a short list given by the caller and become one expression.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))

    def fits(rule: Rule) -> Column:
        own = (host == rule[1]) | host.endswith("." + rule[1])
        return own & path.startswith(rule[2])

    def first(value) -> Column:
        empty = F.lit(None).cast("string")
        return reduce(lambda e, r: F.when(fits(r), value(r)).otherwise(e), reversed(ordered), empty)

    return first(lambda r: r[1] + r[2]), first(lambda r: r[0])


def grams_of(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host$`` and of the path, marked by where they stand.

    Digits are one class: page numbers say nothing of the page.
    """

    def cut(text: Column, mark: str, n: int) -> Column:
        last = F.length(text) - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, n)))

    h = F.concat(F.lit("^"), F.regexp_replace(host, "[0-9]", "0"), F.lit("$"))
    p = F.concat(F.regexp_replace(path, "[0-9]+", "0"), F.lit("$"))
    return F.concat(*[cut(h, "h", n) for n in SIZES], *[cut(p, "p", n) for n in SIZES])


def _hashed(grams: str, out: str) -> HashingTF:
    return HashingTF(numFeatures=BUCKETS, inputCol=grams, outputCol=out, binary=True)


def learn(labelled: DataFrame, *, url: str = "url", label: str = "label") -> LogisticRegressionModel:
    """Model from rows of a URL and a label 1 (allow) or 0 (block).

    Of more than SAMPLE rows those with the smallest hash of the URL are learned
    from. Rows without URL or label count for nothing; with one class only the
    model says that class.
    """
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isin(0, 1))
    rows = rows.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(SAMPLE)
    rows = rows.select("label", grams_of(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"))
    return LogisticRegression(
        featuresCol="x", labelCol="label", regParam=1e-3, maxIter=50, tol=1e-9
    ).fit(_hashed("grams", "x").transform(rows))


def judged(
    pages: DataFrame, model: LogisticRegressionModel | None, rules: list[Rule], *, url: str = "url"
) -> DataFrame:
    """``pages`` with host, path, rule, allow_score and verdict (allow or block); columns
    of these names are replaced.

    A null URL, or one without ``://``, has empty host and path and is judged by the
    model like any other; without a model such a row is allowed.
    """
    made = ("host", "path", "rule", "verdict", "allow_score")
    keep = [pages[c] for c in pages.columns if c not in made]
    # The row as one column: no name in it can clash with the model's.
    rows = pages.select(
        F.struct(*keep, F.lit(0).alias("_")).alias("_row"),
        host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_by_rule", verdict)
    score = F.lit(1.0)
    if model is not None:
        rows = rows.withColumn("_grams", grams_of(F.col("host"), F.col("path")))
        rows = model.transform(_hashed("_grams", model.getFeaturesCol()).transform(rows))
        score = vector_to_array(F.col(model.getProbabilityCol()))[1]
    rows = rows.withColumn("allow_score", score)
    said = F.when(F.col("allow_score") >= 0.5, "allow").otherwise("block")
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in pages.columns if c not in made],
        "host", "path", "rule", F.coalesce("_by_rule", said).alias("verdict"), "allow_score",
    )
