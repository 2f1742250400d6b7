"""Substring deduplication by FM-indexes of shards.

A window is WINDOW consecutive words. Its anchor is the least hash of its short word
sequences, so equal windows have equal anchors wherever they stand. Runs of windows
with one anchor are passages; passages whose anchor stands in several documents are
dealt to shards by anchor, each distinct passage once. A shard indexes its passages in
an FM-index and streams them through it: backward search gives at each place the
longest match, and the rows of a match of WINDOW words give the smallest document that
holds the window. A document loses the words of windows that a smaller one holds.

An anchor of very many passages (a common line in many contexts) is not searched as
one group: its passages are cut into single windows, which are dealt by content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.fm_index import FMIndex
from plumbline.llm.membership import membership, thinned
from plumbline.llm.words import _BACK, _BASE, Words, _power, grams, mixed, release, slices
from plumbline.session import materialize

WINDOW = 50
ANCHOR_WORDS = 8
RUN = 128  # most windows of a passage
SHARD_WORDS = 300_000
HOT_PASSAGES = 20_000  # of an anchor


def _sums(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _power(_BASE, np.arange(len(hashes)), len(hashes)), out=out[1:])
    return out


def _content(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words ``start:end``."""
    got = (sums[end] - sums[start]) * _power(_BACK, start, len(sums))
    return mixed(got ^ (end - start).astype(np.uint64))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` consecutive values from each place on."""
    n, have = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * have <= width:
        values = np.minimum(values[: len(values) - have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[width - have : width - have + n])


def passages(words: Words, window: int):
    """(text, start, windows, anchor, content, mark) of all passages; starts count words of
    their text, ``mark`` is a short hash of the whole text."""
    hashes = words.hashes
    least = least_of(grams(hashes, ANCHOR_WORDS), window - ANCHOR_WORDS + 1)
    first, counts = words.first[:-1], words.counts
    valid = np.zeros(len(least) + 1, dtype=bool)
    owner = words.owner
    if len(least):
        left = (words.first[1:][owner] - np.arange(len(owner)))[: len(least)]
        valid[:-1] = left >= window
    new = valid.copy()
    same = np.zeros(len(least) + 1, dtype=bool)
    if len(least) > 1:
        same[1:-1] = (least[1:] == least[:-1]) & (owner[1 : len(least)] == owner[: len(least) - 1])
    new &= ~same
    start = np.flatnonzero(new)
    # The end of a passage is the next start or the end of the valid stretch.
    stop = np.flatnonzero(valid[:-1] & ~(valid[1:] & same[1:])) + 1
    size = stop - start
    parts = -(-size // RUN)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(start, parts) + k * RUN
    size = np.minimum(RUN, np.repeat(stop, parts) - begin)
    sums = _sums(hashes)
    text = owner[begin] if len(begin) else np.zeros(0, dtype=np.int64)
    content = _content(sums, begin, begin + size + window - 1)
    whole = _content(sums, first, first + counts)
    mark = (whole >> np.uint64(33)).astype(np.int32)
    return text, begin - first[text], size, least[begin], content, mark[text], sums, begin


def _passage_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, part in slices(batch.column(1)):
                text, start, size, anchor, content, mark, _, _ = passages(Words(part), window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at + text]), pa.array(mark), pa.array(start.astype(np.int32)),
                        pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)),
                        pa.array(content.view(np.int64)),
                    ],
                    names=["doc_id", "mark", "start", "windows", "anchor", "content"],
                )

    return docs.mapInArrow(
        run, "doc_id long, mark int, start int, windows int, anchor long, content long"
    )


def _joined(docs: DataFrame, lists: DataFrame, bits) -> DataFrame:
    """Documents with their list; a text is told from others of its id by its mark."""
    return thinned(docs, bits, "doc_id").join(lists, "doc_id")


def _single_windows(docs: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """Passages of hot anchors, cut into windows: (doc_id, mark, start, windows, anchor, content)."""
    spark = docs.sparkSession
    lists = hot.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("list"))
    bits = spark.sparkContext.broadcast(membership(hot, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, text, mark, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = Words(pa.array([text], pa.large_string()))
                sums, n = _sums(words.hashes), len(words.starts)
                whole = _content(sums, np.array([0]), np.array([n]))
                if (whole >> np.uint64(33)).astype(np.int32)[0] != mark:
                    continue
                at = np.concatenate([np.arange(s["start"], s["start"] + s["windows"]) for s in spans])
                anchor = np.repeat([s["anchor"] for s in spans], [s["windows"] for s in spans])
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(k, d)), pa.array(np.full(k, mark, np.int32)),
                        pa.array(at.astype(np.int32)), pa.array(np.ones(k, np.int32)),
                        pa.array(anchor.astype(np.int64)),
                        pa.array(_content(sums, at, at + window).view(np.int64)),
                    ],
                    names=["doc_id", "mark", "start", "windows", "anchor", "content"],
                )

    return _joined(docs, lists, bits).select("doc_id", "text", "mark", "list").mapInArrow(
        run, "doc_id long, mark int, start int, windows int, anchor long, content long"
    )


def _texts_of(docs: DataFrame, distinct: DataFrame, window: int) -> DataFrame:
    """(anchor, content, doc_id, windows, deal, text) of distinct passages, from one document each."""
    spark = docs.sparkSession
    lists = distinct.groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("start", "windows", "anchor", "content", "deal")).alias("list")
    )
    bits = spark.sparkContext.broadcast(membership(distinct, "doc_id"))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, text, mark, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = Words(pa.array([text], pa.large_string()))
                whole = _content(_sums(words.hashes), np.array([0]), np.array([len(words.starts)]))
                if (whole >> np.uint64(33)).astype(np.int32)[0] != mark:
                    continue
                data = words.data.tobytes()
                for s in spans:
                    a, b = s["start"], s["start"] + s["windows"] + window - 2
                    body = data[words.starts[a] : words.ends[b]].decode()
                    rows.append((s["anchor"], s["content"], d, s["windows"], s["deal"], body))
            if rows:
                anchor, content, doc, n, deal, body = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor, pa.int64()), pa.array(content, pa.int64()),
                        pa.array(doc, pa.int64()), pa.array(n, pa.int32()), pa.array(deal, pa.int64()),
                        pa.array(body, pa.string()),
                    ],
                    names=["anchor", "content", "doc_id", "windows", "deal", "text"],
                )

    found = _joined(docs, lists, bits).select("doc_id", "text", "mark", "list")
    return found.mapInArrow(run, "anchor long, content long, doc_id long, windows int, deal long, text string")


def smallest_holders(texts: pa.Array, docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each passage and each of its windows the smallest document with that window."""
    words = Words(texts)
    hashes = words.hashes
    codes = np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1
    # A separator stands behind every passage.
    n = len(texts)
    text = np.zeros(len(codes) + n, dtype=np.int64)
    place = np.arange(len(codes)) + words.owner
    text[place] = codes
    index = FMIndex(text, window)
    owner = np.zeros(len(text), dtype=np.int64)
    owner[place] = words.owner
    holder = np.minimum.reduceat(docs[owner[index.suffixes]], index.group_start)
    starts, ends = words.first[:-1] + np.arange(n), words.first[1:] + np.arange(n)
    matched, row = index.statistics(text, starts, ends)
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        stop = b - window + 1
        assert (matched[a:stop] == window).all()
        out.append(holder[index.group[row[a:stop]]])
    return out


def removed_spans(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, start, end): stretches of words, counted from 0, that windows of
    smaller documents cover. ``docs`` holds doc_id and text."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    spark = docs.sparkSession
    rows = materialize(_passage_rows(docs, window), "passages")
    anchors = rows.groupBy("anchor").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")
    )
    anchors = materialize(anchors.where("a <> b").select("anchor", "n"), "anchors")
    bits = spark.sparkContext.broadcast(membership(anchors, "anchor"))  # of fixed size
    shared = materialize(thinned(rows, bits, "anchor").join(anchors, "anchor"), "shared")
    key = ["anchor", "content", "windows"]
    cold = shared.where(F.col("n") <= HOT_PASSAGES).drop("n")
    hot = shared.where(F.col("n") > HOT_PASSAGES).drop("n")
    where = F.min(F.struct("doc_id", "mark", "start")).alias("w")
    # A shard holds all passages of an anchor, or all windows of a content if the anchor is hot.
    distinct = cold.groupBy(*key).agg(where).select(*key, "w.*", F.col("anchor").alias("deal"))
    if not hot.isEmpty():
        single = materialize(_single_windows(docs, hot, window), "windows")
        cold = cold.select(single.columns).unionByName(single)
        several = single.groupBy(*key).agg(where, F.max("doc_id").alias("last"))
        several = several.where("w.doc_id <> last").select(*key, "w.*", F.col("content").alias("deal"))
        distinct = distinct.unionByName(several)
    distinct = materialize(distinct, "distinct")
    words = distinct.agg(F.sum(F.col("windows") + window - 1)).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array(group["text"].tolist(), pa.large_string())
        found = smallest_holders(texts, group["doc_id"].to_numpy(), window)
        release()
        return pd.DataFrame(
            {
                "anchor": group["anchor"], "content": group["content"], "windows": group["windows"],
                "holders": [x.astype("<i8").tobytes() for x in found],
            }
        )

    shard = F.pmod(F.xxhash64("deal"), F.lit(shards))
    searched = (
        _texts_of(docs, distinct, window).withColumn("shard", shard)
        .groupBy("shard").applyInPandas(search, "anchor long, content long, windows int, holders binary")
    )
    searched = materialize(searched, "holders")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((4, 0), dtype=np.int64)]
            for d, mark, start, holders in zip(*(c.to_pylist() for c in batch.columns)):
                lost = np.flatnonzero(np.frombuffer(holders, "<i8") < d)
                if len(lost):
                    cut = np.flatnonzero(np.diff(lost) > 1)
                    a = lost[np.concatenate([[0], cut + 1])] + start
                    b = lost[np.concatenate([cut, [len(lost) - 1]])] + start + window
                    out.append(np.stack([np.full(len(a), d), np.full(len(a), mark), a, b]))
            d, mark, a, b = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(d), pa.array(mark.astype(np.int32)),
                    pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                ],
                names=["doc_id", "mark", "start", "end"],
            )

    return cold.join(searched, key).select("doc_id", "mark", "start", "holders").mapInArrow(
        spans, "doc_id long, mark int, start int, end int"
    )


def without_repeats(
    docs: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; ``kept`` is the words that stay,
    joined by one blank.

    A null or empty text has no words. A row without doc_id is neither compared nor
    changed. Rows that repeat a doc_id are compared with smaller ids only, not with
    each other. An empty table gives no rows.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    spans = materialize(removed_spans(source, window=window), "spans")
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct("mark", "start", "end")).alias("list"))
    bits = spark.sparkContext.broadcast(membership(spans, "doc_id"))  # of fixed size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for at, part in slices(batch.column(1)):
                words = Words(part)
                n = words.counts
                gone = np.zeros(len(words.starts), dtype=bool)
                sums = None
                for i in range(len(part)):
                    if not lists[at + i]:
                        continue
                    sums = _sums(words.hashes) if sums is None else sums
                    a, b = words.first[i], words.first[i + 1]
                    mark = int((_content(sums, np.array([a]), np.array([b])) >> np.uint64(33))[0])
                    for s in lists[at + i]:
                        if np.int32(mark) == s["mark"]:
                            gone[a + s["start"] : a + s["end"]] = True
                removed = np.bincount(words.owner, weights=gone, minlength=len(part)).astype(np.int64)
                kept = []
                data = words.data.tobytes()
                for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    body = data[words.texts[i] : words.texts[i + 1]].split()
                    if removed[i]:
                        body = [w for w, g in zip(body, gone[a:b].tolist()) if not g]
                    kept.append(b" ".join(body).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()),
                        pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    kinds = "doc_id long, n_words long, n_removed long, kept string"
    empty = F.lit(None).cast("array<struct<mark: int, start: int, end: int>>")
    clean = thinned(source, bits, "doc_id", inside=False).withColumn("list", empty)
    hit = thinned(source, bits, "doc_id").join(lists, "doc_id", "left")
    return clean.mapInArrow(cut, kinds).unionByName(hit.select("doc_id", "text", "list").mapInArrow(cut, kinds))
