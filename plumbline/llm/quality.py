"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A document of label 1 is preferred to one of label 0. The score is linear in the
features of the text; its weights minimise the logistic loss on the feature
differences of pairs (P[good before bad] = sigmoid(score(good) - score(bad))).
A quantile of the training documents' scores then is the threshold: the share of
label 0 among them. The reported score is the sigmoid of the distance to it.

The fit uses a bounded sample of labelled documents: at most SAMPLE of each
label, those with the smallest hash of their id. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import Words, slices

SAMPLE = 6000  # labelled documents of each label in the fit
PAIRS = 40  # partners of each document of the rarer label
STEPS = 60
RIDGE = 1e-3

# Classes of bytes whose shares are features.
_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r",
    b".", b",", b"!?", b"#*$%&@^~_=+", b"|", b"<>{}[]()\\/;", b"'\"`:-",
]
_CLASS = np.full(256, len(_CLASSES), dtype=np.uint8)
for _k, _b in enumerate(_CLASSES):
    _CLASS[list(_b)] = _k
_CLASS[0x80:] = len(_CLASSES) + 1
_KINDS = len(_CLASSES) + 2
WIDTH = 2 * _KINDS + 9


def features(texts: pa.Array) -> np.ndarray:
    """A row of WIDTH numbers for each text; null and empty texts give the same row."""
    words = Words(texts)
    n = len(texts)
    size = np.diff(words.texts)
    kinds = _CLASS[words.data]
    owner = np.repeat(np.arange(n, dtype=np.int64) * _KINDS, size)
    shares = np.bincount(owner + kinds, minlength=n * _KINDS).reshape(n, _KINDS)
    shares = shares / np.maximum(size, 1)[:, None]
    count = words.counts
    many = np.maximum(count, 1)
    of, hashes, lengths = words.owner, words.hashes, words.ends - words.starts

    def per(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=n) / many

    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    top = hashes >> np.uint64(1)
    order = np.lexsort((top, of))
    new = np.ones(len(order))
    new[1:] = (top[order][1:] != top[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], weights=new, minlength=n) / np.sqrt(many)
    first, last = kinds[words.starts], kinds[words.ends - 1]
    odd = (last == 7) | (last == 8)
    shout = (first == 1) & (kinds[np.minimum(words.starts + 1, words.ends - 1)] == 1) & (lengths > 1)
    lone = lengths == 1
    extra = np.stack(
        [
            per(again), distinct / np.sqrt(many), per(lengths) / 10, per(odd), per(shout),
            per(lone), np.log1p(count) / 10, per(lengths > 15), (count == 0).astype(float),
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(shares), np.minimum(20 * shares, 1.0), extra], axis=1)


def fit(good: np.ndarray, bad: np.ndarray, *, pairs: int = PAIRS) -> np.ndarray:
    """Weights and, last, the threshold; rows of ``good`` are preferred to rows of ``bad``.

    Pairs are dealt in rounds, each document of the larger side in turn against
    the other side, shifted by one stretch a round: no draw is involved.
    """
    if not len(good) or not len(bad):
        return np.zeros(WIDTH + 1)
    center = np.concatenate([good, bad]).mean(axis=0)
    spread = np.concatenate([good, bad]).std(axis=0) + 1e-6
    a, b = (good - center) / spread, (bad - center) / spread
    few = min(len(a), len(b))
    turns = min(pairs, max(len(a), len(b)))
    i = np.tile(np.arange(few), turns)
    j = (i * turns + np.repeat(np.arange(turns), few)) % max(len(a), len(b))
    d = a[i] - b[j] if len(a) <= len(b) else a[j] - b[i]
    w = np.zeros(WIDTH)
    for _ in range(STEPS):  # Newton's method on a strictly convex loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = RIDGE * w - (p[:, None] * d).mean(axis=0)
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(WIDTH)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w = w / spread
    low, high = np.sort(bad @ w), np.sort(good @ w)
    # The quantile of all scores at the share of label 0 lies among the scores of
    # both sides where they overlap, and in the middle of the gap where they don't.
    scores = np.sort(np.concatenate([low, high]))
    cut = float(scores[len(low) - 1] + scores[min(len(low), len(scores) - 1)]) / 2
    return np.append(w, cut)


def training_features(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """(label, row) of the bounded sample; ``labels`` holds doc_id and label."""
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    known = labels.select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
    known = known.where("label IN (0, 1) AND _id IS NOT NULL").dropDuplicates(["_id"])
    # Two short lists of ids, at most SAMPLE each, fixed by hash.
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = known.where("label = 0").orderBy(*order).limit(SAMPLE)
    picked = picked.unionByName(known.where("label = 1").orderBy(*order).limit(SAMPLE))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), "_id")  # at most 2 * SAMPLE ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(0)):
                got = features(part).astype(np.float64)
                row = pa.FixedSizeListArray.from_arrays(pa.array(got.reshape(-1)), WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, len(part)), batch.column(2).slice(at, len(part)),
                     row.cast(pa.list_(pa.float64()))],
                    names=["_id", "label", "row"],
                )

    return rows.select("text", "_id", "label").mapInArrow(
        run, "_id long, label int, row array<double>"
    )


def learn(docs: DataFrame, labels: DataFrame, **names: str) -> np.ndarray:
    """The model of ``fit``; what comes to the driver is the bounded sample's features."""
    got = training_features(docs, labels, **names).toPandas().sort_values("_id", kind="stable")
    rows = np.array(got["row"].tolist()).reshape(-1, WIDTH)
    label = got["label"].to_numpy()
    return fit(rows[label == 1], rows[label == 0])


def _scores(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    w, cut, got = model[:-1], float(model[-1]), [np.zeros(0)]
    for _, part in slices(texts.cast(pa.string())):
        got.append(1 / (1 + np.exp(-np.clip(features(part) @ w - cut, -30, 30))))
    return np.concatenate(got)


def accepted(docs: DataFrame, model: np.ndarray, *, text: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, that score 0.5 or more."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), model) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def scored(
    docs: DataFrame, model: np.ndarray, *, text: str = "text", score: str = "score"
) -> DataFrame:
    """``docs`` with the score of each whole text, from 0 to 1; a null text is an empty one.

    A column named like ``score`` is replaced; rows that repeat are scored each.
    """
    docs = docs.drop(score)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array(_scores(batch.column(at), model), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*names, score])

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, `{score}` double")
