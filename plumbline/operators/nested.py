"""Nested values as rows: JSON texts taken apart level by level inside the JVM.

Where only keys count, texts are walked in one pass. Else a text becomes a VARIANT, and each pass explodes the containers of one level, so
the number of passes is the nesting depth, whatever the number of rows. Levels are
written to the shared folder: none is parsed or exploded twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import FORBIDDEN_CONTEXT_KEYS
from plumbline.session import materialize


def _levels(rows: DataFrame, value: Column, root: str) -> list[DataFrame]:
    """A frame per depth of (_row, _path, _key, _value); the first holds the roots.

    A key is null below arrays and at the root; the root's value is null where the
    text can't be parsed. All columns of ``rows`` are kept in the struct ``_row``.
    """
    spark = rows.sparkSession
    whole = F.struct(*[rows[c] for c in rows.columns], F.lit(0).alias("_"))
    level = materialize(
        rows.select(
            whole.alias("_row"), F.lit(root).alias("_path"), F.lit(None).cast("string").alias("_key"),
            value.alias("_value"),
        ), "nodes",
    )
    out = [level]
    while len(out) == 1 or not level.select("_path").isEmpty():
        step = F.when(
            F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
        ).otherwise(F.concat(F.lit("."), "key"))
        parts = level.where(F.col("_value").isNotNull()).select("_row", "_path", "_value")
        below = parts.lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        level = materialize(
            below.select(
                "_row", F.concat("_path", step).alias("_path"), F.col("key").alias("_key"),
                F.col("value").alias("_value"),
            ), "nodes",
        )
        out.append(level)
    return out


def forbidden_paths(
    rows: DataFrame, text: str, keys: Sequence[str] = FORBIDDEN_CONTEXT_KEYS, *, root: str = "context",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """(columns of ``rows``, path, key): every object key of ``keys``, at any depth.

    Paths read ``context.a[0].b``. Only keys count, not values. A text that is no
    JSON, or repeats a key in an object, can't be cleared and is told with the root as
    its path and a null key. Null texts hold nothing. ``path`` and ``key`` replace
    columns of these names. ``keep`` names the columns that come back, all by default.

    Keys need no values, so a text is walked where it is read, in one pass: no level is written.
    """
    kept = [c for c in (rows.columns if keep is None else keep) if c not in ("path", "key")]
    wanted = frozenset(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, names = [], [], []
            for i, value in enumerate(batch.column(len(kept)).to_pylist()):
                for path, key in _forbidden(value, wanted, root):
                    at.append(i)
                    paths.append(path.encode("utf-8", "replace").decode())
                    names.append(key)
            columns = batch.take(pa.array(at, pa.int64())).columns[: len(kept)]
            found = [pa.array(paths, pa.string()), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *found], names=[*kept, "path", "key"])

    schema = rows.select(*kept).schema.add("path", "string").add("key", "string")
    given = rows.where(F.col(text).isNotNull()).select(*kept, F.col(text).alias("_text"))
    return given.mapInArrow(run, schema)


def _object(pairs: list) -> dict:
    made = dict(pairs)
    if len(made) < len(pairs):
        raise ValueError("a key is repeated")
    return made


def _refuse(constant: str):
    raise ValueError(f"{constant} is no JSON")


def _forbidden(text: str, keys: frozenset[str], root: str) -> list[tuple[str, str | None]]:
    """(path, key) of the ``keys`` in one text; (root, None) where it can't be parsed."""
    try:
        value = json.loads(text, object_pairs_hook=_object, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return [(root, None)]
    found, open_ = [], [(root, value)]
    while open_:
        path, value = open_.pop()
        if isinstance(value, dict):
            found += [(f"{path}.{k}", k) for k in value if k in keys]
            open_ += [(f"{path}.{k}", v) for k, v in value.items() if isinstance(v, (dict, list))]
        elif isinstance(value, list):
            open_ += [(f"{path}[{i}]", v) for i, v in enumerate(value) if isinstance(v, (dict, list))]
    return found


def leaves(rows: DataFrame, text: str, *, root: str = "$") -> DataFrame:
    """(columns of ``rows``, path, value): scalars and empty containers as JSON texts."""
    levels = _levels(rows, F.try_parse_json(F.col(text)), root)
    every = reduce(DataFrame.unionAll, levels).withColumn("_json", F.to_json("_value"))
    inner = F.col("_json").rlike(r"^[\[{]") & ~F.col("_json").isin("[]", "{}")
    kept = [F.col("_row")[c].alias(c) for c in rows.columns if c not in ("path", "value")]
    return every.where(F.col("_json").isNotNull() & ~inner).select(
        *kept, F.col("_path").alias("path"), F.col("_json").alias("value")
    )


def contract_differences(
    plan: DataFrame, result: DataFrame, keys: Sequence[str], parts: Sequence[str]
) -> DataFrame:
    """(keys..., path, planned, found) wherever a result departs from its plan.

    ``parts`` are columns of both frames, nested ones too: arms, seeds, limits, scope,
    units. Places of arrays are part of the path, so order counts; numbers are equal
    by value (300 and 300.0). What one side lacks is null there. A null part and a
    missing one are alike; null keys meet null keys; keys must not repeat.
    """
    def told(side: DataFrame, name: str) -> DataFrame:
        text = F.to_json(F.struct(*parts))
        got = leaves(side.select(*keys, text.alias("_text")), "_text", root="").drop("_text")
        # The root holds the parts themselves: an empty one says nothing.
        got = got.where(F.col("path") != "")
        return got.select(*keys, F.substring("path", 2, 1 << 30).alias("path"), F.col("value").alias(name))

    left, right = told(plan, "planned"), told(result, "found")
    on = [left[c].eqNullSafe(right[c]) for c in (*keys, "path")]
    numbers = F.col("planned").rlike("^[-0-9]") & F.col("found").rlike("^[-0-9]")
    by_value = F.col("planned").cast("double") == F.col("found").cast("double")
    same = F.coalesce(
        (F.col("planned") == F.col("found")) | (numbers & by_value), F.lit(False)
    )
    joined = left.join(right, reduce(lambda a, b: a & b, on), "full_outer").where(~same)
    # A path is never null, so it tells which side a row has.
    on_left = left["path"].isNotNull()
    return joined.select(
        *[F.when(on_left, left[c]).otherwise(right[c]).alias(c) for c in (*keys, "path")],
        "planned", "found",
    )
