"""N-gram Jaccard self-join by set-relation skipping, and the components of its links.

Sets of word shingles link when their Jaccard similarity reaches num / den. Equal
sets are one set. The rest is an exact prefix-filter join whose index lists are
skipped through, rather than read, in three ways:

* by position: shingles are ordered by a count that all texts share, rare ones
  first. Two sets that first meet at places i and j of their orders differ in at
  least i + j shingles, so a list's entries that stand too far back are skipped by
  blocks, as are sizes that don't fit.
* by relation: each entry carries the parities of its set's shingles over buckets
  (few bits, exact). Differing parities bound the symmetric difference from below,
  and most pairs that meet by a common passage are skipped on it.
* by derived answers: in a long list each set first asks only for the first and the
  last similar set before it. Sets linked so far share their answers: in the second
  turn only pairs of different components are asked, so a group of near copies doesn't
  pair up within itself. All such pairs are asked, which makes the components exact.

Where the links themselves are asked for (``jaccard_pairs``, ``with_link_counts``), no
answer is derived: every similar pair of every list is verified.

Candidates are verified on whole sets. The counts are one table of fixed size
(COUNTERS), summed over all texts; they order the shingles and decide nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.membership import may_hold, membership
from plumbline.llm.words import Words, mixed, shingle_sets, slices
from plumbline.session import materialize

COUNTERS = 1 << 21
PIECE = 1 << 16  # counters in one row
LIST_BLOCK = 64
LIST_LIMIT = 50_000  # entries that a task holds of one list; longer lists are split
PAIR_BATCH = 1 << 20  # pairs that a task holds before it gives them out
SHORT_LIST = 32  # sets; in such a list all similar pairs are told at once


def _sets(batch_column: pa.Array, size: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    for at, part in slices(batch_column):
        for i, s in enumerate(shingle_sets(Words(part, lower), size)):
            yield at + i, s


def _fingerprint(hashes: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that stand for the set, wherever sets are told apart."""
    with np.errstate(over="ignore"):
        return hashes.sum(dtype=np.uint64), mixed(hashes).sum(dtype=np.uint64)


def parity(hashes: np.ndarray, num: int, den: int) -> bytes:
    """Parities of the set over buckets, whose number is a power of two that follows
    the size: four for each shingle that may differ."""
    most = 2 * len(hashes) * (den - num) // num + 1
    bits = 64
    while bits < 4 * most:
        bits *= 2
    held = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(held.astype(np.uint8)).tobytes()


def _fold(x: np.ndarray, to: int) -> np.ndarray:
    """Parity bytes of fewer buckets: bucket b of a larger table falls to b modulo the smaller."""
    while x.shape[-1] > to:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def most_difference(a, b, num: int, den: int):
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (den - num) // (den + num)


def prefix_length(n: int, num: int, den: int) -> int:
    """Shingles of a set of n of which a linked set must hold one."""
    return n - -(-num * n // den) + 1


def _profile(docs: DataFrame, size: int, num: int, den: int, lower: bool) -> DataFrame:
    """One pass: per document the size and fingerprint of its set; per task the counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.uint32)

        def count(held: list) -> None:
            if held:
                place = (np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int64)
                some, n = np.unique(place, return_counts=True)
                total[some] += n.astype(np.uint32)
                held.clear()

        for batch in batches:
            rows, held, signs = [], [], []
            for _, s in _sets(batch.column(1), size, lower):
                rows.append((len(s), *_fingerprint(s)))
                signs.append(parity(s, num, den))
                held.append(s)
                if len(held) >= 512:
                    count(held)
            count(held)
            n, a, b = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0),) * 3
            k = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()),
                    pa.array(a.astype(np.uint64).view(np.int64)),
                    pa.array(b.astype(np.uint64).view(np.int64)),
                    pa.array(np.full(k, -1), pa.int32()), pa.array(signs, pa.binary()),
                ],
                names=_PROFILE,
            )
        pieces = [total[i : i + PIECE] for i in range(0, COUNTERS, PIECE)]
        k = len(pieces)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                pa.nulls(k, pa.int64()), pa.array(np.arange(k), pa.int32()),
                pa.array([_press(x) for x in pieces], pa.binary()),
            ],
            names=_PROFILE,
        )

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, piece int, data binary")


_PROFILE = ["doc_id", "n", "f1", "f2", "piece", "data"]


def _press(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpress(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PIECE, dtype=np.int64)
    for x in group["data"]:
        total += _unpress(x)
    total = np.minimum(total, (1 << 32) - 1)
    return pd.DataFrame({"piece": [group["piece"].iloc[0]], "data": [_press(total)]})


def _entries(
    docs: DataFrame, counters, size: int, num: int, den: int, lower: bool, common: bool = False
) -> DataFrame:
    """(token, id, f1, f2, n, pos): the prefix of every document's set; ``f1`` and ``f2`` are
    the set's fingerprint, as in the profile. ``common`` gives only shingles that may be in over LIST_LIMIT
    sets, as their counter tells; the counter of any other is a bound of its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ranks by powers of a quarter: equal counts, and nearly equal ones, go by hash.
        ranks = (4 * np.log2(counters.value.astype(np.float32) + 1)).astype(np.uint8)
        for batch in batches:
            ids, out = batch.column(0).to_numpy(), []
            for i, s in _sets(batch.column(1), size, lower):
                n = len(s)
                if not n:
                    continue
                f1, f2 = _fingerprint(s)
                rank = ranks[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
                order = (rank << np.uint64(56)) | (mixed(s + np.uint64(1)) >> np.uint64(8))
                p = min(n, prefix_length(n, num, den))
                first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                first = first[np.argsort(order[first])]
                if common:
                    first = first[counters.value[(s[first] & np.uint64(COUNTERS - 1)).astype(np.int64)] > LIST_LIMIT]
                out.append((s[first], ids[i], f1, f2, n, len(first)))
            if not out:
                continue
            times = np.array([x[5] for x in out])
            if not times.sum():
                continue
            columns = [
                np.concatenate([x[0] for x in out]).view(np.int64),
                np.repeat(np.array([x[1] for x in out], dtype=np.int64), times),
                np.repeat(np.array([x[2] for x in out], dtype=np.uint64), times).view(np.int64),
                np.repeat(np.array([x[3] for x in out], dtype=np.uint64), times).view(np.int64),
                np.repeat(np.array([x[4] for x in out], dtype=np.int32), times),
                np.arange(times.sum(), dtype=np.int32)
                - np.repeat(np.cumsum(times) - times, times).astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_ENTRY)

    return docs.mapInArrow(run, "token long, id long, f1 long, f2 long, n int, pos int")


_ENTRY = ["token", "id", "f1", "f2", "n", "pos"]


def _lists(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole lists of rows sorted by token, several at a time, as arrays."""
    rest: list[pa.RecordBatch] = []

    def arrays(parts):
        t = pa.Table.from_batches(parts)
        return {c: t.column(c).combine_chunks() for c in columns}

    for batch in batches:
        if not len(batch):
            continue
        token = batch.column("token").to_numpy()
        cut = int(np.flatnonzero(token != token[-1])[-1]) + 1 if token[0] != token[-1] else 0
        if cut:
            yield arrays([*rest, batch.slice(0, cut)])
            rest = [batch.slice(cut)]
        elif rest and rest[-1].column("token")[0].as_py() != token[0]:
            yield arrays(rest)
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield arrays(rest)


def _split(entries: DataFrame, long_lists: DataFrame) -> DataFrame:
    """Entries with the long lists cut into blocks, and a list for every two blocks of one.

    ``long_lists`` holds (token, blocks). Every two entries of a list meet again, and no
    list is longer than two blocks.
    """
    own = F.pmod(F.xxhash64("id", "f1"), F.col("blocks"))
    rows = entries.join(long_lists, "token", "left").withColumn("_own", own)
    other = F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("_other", F.explode(F.coalesce(other, F.array(F.lit(0).cast("long")))))
    cell = F.xxhash64("token", F.least("_own", "_other"), F.greatest("_own", "_other"))
    token = F.when(F.col("blocks").isNull(), F.col("token")).otherwise(cell)
    return rows.withColumn("token", token).select(*_ENTRY)


def _shared(entries: DataFrame) -> DataFrame:
    """(token, id, n, pos, long): entries of the lists that hold more than one set.

    Equal sets stand in the same lists and go by their smallest document. ``long``
    lists have more than SHORT_LIST sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _lists(batches, _ENTRY):
            token, ids, f1, f2, n, pos = (rows[c].to_numpy() for c in _ENTRY)
            order = np.lexsort((ids, f2, f1, token))
            t, x, y = token[order], f1[order], f2[order]
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            keep = order[new]
            _, place, count = np.unique(t[new], return_inverse=True, return_counts=True)
            count = count[place]
            keep, count = keep[count > 1], count[count > 1]
            if len(keep):
                columns = [token[keep], ids[keep], n[keep], pos[keep], count > SHORT_LIST]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["token", "id", "n", "pos", "long"]
                )

    ordered = entries.repartition("token").sortWithinPartitions("token")
    return ordered.mapInArrow(run, "token long, id long, n int, pos int, long boolean")


def _candidates(lists: DataFrame, num: int, den: int, everything: bool) -> DataFrame:
    """(a, b) of sets in one list that may link; labels differ. Of rows
    (token, id, n, pos, parity, label). Of long lists, unless ``everything`` is asked
    for, only the first and the last similar set before each."""
    names = ["token", "id", "n", "pos", "parity", "label"]

    def of_list(ids, n, pos, parities, label):
        order = np.lexsort((ids, n))
        ids, n, pos, label = ids[order], n[order].astype(np.int64), pos[order].astype(np.int64), label[order]
        sizes = np.array([len(parities[i]) for i in order])
        table = {
            w: np.stack([_fold(np.frombuffer(parities[i], np.uint8), w) for i in order])
            if w == sizes.min()
            else None
            for w in {int(sizes.min())}
        }
        bits = table[int(sizes.min())] if sizes.max() <= 2 * sizes.min() else None
        low = np.searchsorted(n, -(-num * n // den))  # smallest size that fits
        edges = np.arange(0, len(n), LIST_BLOCK)
        least = np.minimum.reduceat(pos, edges)
        for x in range(1, len(n)):
            a = int(low[x])
            if a >= x:
                continue
            first, last = a // LIST_BLOCK, (x - 1) // LIST_BLOCK
            allowed = int(most_difference(n[x], n[x], num, den))
            blocks = np.arange(first, last + 1)
            blocks = blocks[least[blocks] + pos[x] <= allowed]
            hits = []
            for k in blocks.tolist():
                span = slice(max(a, k * LIST_BLOCK), min(x, (k + 1) * LIST_BLOCK))
                most = most_difference(n[span], n[x], num, den)
                fit = (pos[span] + pos[x] <= most) & (label[span] != label[x])
                if not fit.any():
                    continue
                place = np.flatnonzero(fit) + span.start
                if bits is not None:
                    apart = np.bitwise_count(bits[place] ^ bits[x]).sum(axis=1)
                else:
                    own = np.frombuffer(parities[order[x]], np.uint8)
                    apart = []
                    for y in place:
                        other = np.frombuffer(parities[order[y]], np.uint8)
                        w = min(len(own), len(other))
                        apart.append(int(np.bitwise_count(_fold(own, w) ^ _fold(other, w)).sum()))
                    apart = np.array(apart)
                place = place[apart <= most_difference(n[place], n[x], num, den)]
                if len(place):
                    hits.append(place)
                    if not everything and len(hits) == 1:
                        hits = [place[:1]]
            if hits:
                found = np.concatenate(hits)
                if not everything:
                    found = np.unique(found[[0, -1]])
                yield ids[found], np.full(len(found), ids[x])

    def of_short(token, ids, n, pos, parities, label):
        """All similar pairs of many short lists at once: rows that stand d apart."""
        order = np.lexsort((ids, n, token))
        token, ids, n, pos, label = (x[order] for x in (token, ids, n, pos, label))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        width = np.array([len(parities[i]) for i in order])
        table, place = {}, np.zeros(len(order), dtype=np.int64)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            place[own] = np.arange(len(own))
            data = b"".join([parities[i] for i in order[own]])
            table[w] = np.frombuffer(data, np.uint8).reshape(len(own), w)
        live = np.arange(len(token))
        for d in range(1, len(token)):
            live = live[live + d < len(token)]
            live = live[token[live] == token[live + d]]
            if not len(live):
                break
            a, b = live, live + d
            most = most_difference(n[a], n[b], num, den)
            fit = (num * n[b] <= den * n[a]) & (pos[a] + pos[b] <= most) & (label[a] != label[b])
            a, b, most = a[fit], b[fit], most[fit]
            for wa in np.unique(width[a]).tolist():
                for wb in np.unique(width[b[width[a] == wa]]).tolist():
                    some = (width[a] == wa) & (width[b] == wb)
                    w = min(wa, wb)
                    x = _fold(table[wa][place[a[some]]], w)
                    y = _fold(table[wb][place[b[some]]], w)
                    near = np.bitwise_count(x ^ y).sum(axis=1) <= most[some]
                    yield ids[a[some][near]], ids[b[some][near]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _lists(batches, names):
            token, ids, n, pos, label = (
                rows[c].to_numpy(zero_copy_only=False) for c in ("token", "id", "n", "pos", "label")
            )
            parities = rows["parity"].to_pylist()
            cuts = np.flatnonzero(np.diff(token)) + 1
            left, right, held = [], [], 0

            def told():
                u, v = np.concatenate(left), np.concatenate(right)
                pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
                left.clear()
                right.clear()
                return pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"]
                )

            sizes = np.diff(np.concatenate([[0], cuts, [len(token)]]))
            short = np.flatnonzero(np.repeat(sizes <= 4 * SHORT_LIST, sizes))
            some = [parities[i] for i in short]
            for u, v in of_short(token[short], ids[short], n[short], pos[short], some, label[short]):
                left.append(u)
                right.append(v)
                held += len(u)
                if held >= PAIR_BATCH:
                    yield told()
                    held = 0
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(token)]):
                if b - a <= 4 * SHORT_LIST or (label[a:b] == label[a]).all():
                    continue
                for u, v in of_list(ids[a:b], n[a:b], pos[a:b], parities[a:b], label[a:b]):
                    left.append(u)
                    right.append(v)
                    held += len(u)
                    if held >= PAIR_BATCH:
                        yield told()
                        held = 0
            if left:
                yield told()

    ordered = lists.select(*names).repartition("token").sortWithinPartitions("token")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _whole_sets(docs: DataFrame, ids: DataFrame, size: int, lower: bool) -> DataFrame:
    """(id, hashes) of the documents of ``ids``; a filter of fixed size thins out the
    others before they are cut into words."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(membership(ids, "id"))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(may_hold(bits.value, batch.column(0))))
            sets = [s.astype("<u8").tobytes() for _, s in _sets(some.column(1), size, lower)]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"]
            )

    found = docs.mapInArrow(run, "id long, hashes binary")
    return found.join(ids, "id", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_links(
    docs: DataFrame, *, size: int, least: tuple[int, int], lower: bool, doc_id: str, text: str,
    every: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(profile, links): a row per document with its set's size and representative, and
    verified links (a, b) between representatives: all of them if ``every`` is asked for,
    or else enough to give all components."""
    spark = docs.sparkSession
    num, den = least
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = materialize(_profile(source, size, num, den, lower), "profile")
    table = np.zeros((COUNTERS // PIECE, PIECE), dtype=np.uint32)
    pieces = seen.where("piece >= 0").select("piece", "data")
    for r in pieces.groupBy("piece").applyInPandas(_summed, "piece int, data binary").collect():
        table[r["piece"]] = _unpress(bytes(r["data"]))
    counters = spark.sparkContext.broadcast(table.reshape(-1))  # 4 * COUNTERS bytes at any size
    profile = seen.where("piece = -1").select("doc_id", "n", "f1", "f2")
    sets = seen.where("piece = -1 AND n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(
        F.min("doc_id").alias("id"), F.first("data").alias("parity")
    )
    sets = materialize(sets, "sets")
    known = source.where("doc_id IS NOT NULL")
    entries = _entries(known, counters, size, num, den, lower)
    if (table > LIST_LIMIT).any():
        lists = _entries(known, counters, size, num, den, lower, common=True).groupBy("token")
        lists = lists.agg(F.ceil(F.count(F.lit(1)) / LIST_LIMIT).alias("blocks")).where("blocks > 1")
        lists = materialize(lists, "long")
        entries = entries if lists.isEmpty() else _split(entries, lists)
    shared = materialize(_shared(entries), "lists")

    def linked(lists: DataFrame, label, everything: bool) -> DataFrame:
        lists = lists.join(sets.select("id", "parity"), "id").withColumn("label", label)
        pairs = materialize(_candidates(lists, num, den, everything), "pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        whole = _whole_sets(known, materialize(ids, "ids"), size, lower)
        return materialize(_verified(pairs, whole, num, den), "links")

    links = linked(shared, F.col("id"), every)
    if every:
        return profile.join(sets.drop("parity"), ["f1", "f2"], "left"), links
    labels = materialize(components(links), "labels")
    rest = shared.where("long").join(labels, "id", "left")
    more = linked(rest, F.coalesce("label", "id"), True)
    return profile.join(sets.drop("parity"), ["f1", "f2"], "left"), links.unionByName(more)


def jaccard_pairs(
    docs: DataFrame, *, size: int = 5, least: tuple[int, int] = (80, 100), lower: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(a, b) of all links between different sets, a < b, each once.

    A set goes by its smallest doc_id, ``set_id`` of ``jaccard_components``. In a group
    of n near copies that all link these are n * (n - 1) / 2 rows.
    """
    return jaccard_links(
        docs, size=size, least=least, lower=lower, doc_id=doc_id, text=text, every=True
    )[1]


def with_link_counts(
    docs: DataFrame, *, size: int = 5, least: tuple[int, int] = (80, 100), lower: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, n_links) of every row: with how many other rows it links, those
    of an equal set among them. A row without words has none, one without doc_id null."""
    profile, links = jaccard_links(
        docs, size=size, least=least, lower=lower, doc_id=doc_id, text=text, every=True
    )
    rows = materialize(profile, "profile")
    copies = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    both = links.select(F.col("a").alias("id"), F.col("b").alias("_o"))
    both = both.union(links.select("b", "a"))
    near = both.join(copies.select(F.col("id").alias("_o"), "c"), "_o").groupBy("id").agg(F.sum("c").alias("_near"))
    counts = copies.join(near, "id", "left").select(
        "id", (F.col("c") - 1 + F.coalesce("_near", F.lit(0))).alias("_links")
    )
    n_links = F.when(F.col("n") > 0, F.col("_links")).otherwise(F.lit(0))
    return rows.join(counts, "id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), n_links).cast("long").alias("n_links"),
    )


def jaccard_components(
    docs: DataFrame, *, size: int = 5, least: tuple[int, int] = (80, 100), lower: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) of every row.

    Sets of ``size``-word shingles link when den * intersection >= num * union, with
    ``least`` = (num, den). ``component_id`` is the smallest doc_id reachable; a text
    without words, and a null one, has an empty set and is alone. ``set_id`` is the
    smallest doc_id with the same set. A row without doc_id keeps its size and has no
    component. Rows that repeat a doc_id count each with its own text, but a set goes by
    its smallest doc_id, so sets of one such id are one. Hashes of 64 bits stand for
    shingles, of 128 bits for sets.
    """
    profile, links = jaccard_links(
        docs, size=size, least=least, lower=lower, doc_id=doc_id, text=text
    )
    labels = materialize(components(links), "labels").withColumnRenamed("label", "_label")
    set_id = F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("doc_id"))
    rows = profile.withColumn("set_id", F.when(F.col("doc_id").isNotNull(), set_id)).drop("id", "f1", "f2")
    rows = rows.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("_label", "set_id").alias("component_id"), "set_id",
    )


