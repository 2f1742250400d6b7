"""Each operator over small odd tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import (
    exact_dedup,
    jaccard_join,
    mixing,
    packing,
    quality,
    queries,
    secret_scan,
    substring_dedup,
    token_files,
    topk,
    url_filter,
)
from plumbline.llm.components import components
from plumbline.llm.words import Words, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n))


LONG = prose(1, 30_000)
ODD = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "a"), (5, "one two", "b"),
    (6, LONG, "b"), (7, LONG, None), (8, prose(2, 80), "a"), (9, prose(2, 80), "a"),
    (9, prose(2, 80), "a"), (9, prose(3, 70), "a"), (10, "one  two", "b"), (11, "One two", "b"),
    (12, "a\x1cb é \U0001f600 <|endoftext|> x", "a"), (None, "one two", "a"), (None, None, None),
    (13, prose(2, 80) + " tail", "a"), (14, "head " + prose(2, 80), "a"), (15, LONG + " end", "b"),
    (16, "hello \0world again \0, a\0b", "a"),
]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_exact_duplicates(documents):
    got = exact_dedup.exact_duplicates(documents(ODD)).collect()
    groups = defaultdict(list)
    for d, t, _ in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = []
    for norm, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        for d in ids:
            want.append((d, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(documents(ODD).limit(0)).count() == 0


def test_hash_collisions_are_verified_by_bytes(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    got = exact_dedup.exact_duplicates(documents([(1, "ab"), (2, "cd"), (3, "ab"), (4, "e")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [
        (1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True),
    ]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_files_round_trip(spark, documents, tmp_path, name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    folder = str(tmp_path / "files")
    token_files.token_file_set(documents(ODD), path, folder)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    start, want = 0, defaultdict(list)
    for d, t, _ in ODD:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want[d].append(ids)
    last = None
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids)
        want[r.doc_id].remove(ids)
        assert last is None or last <= (-1 if r.doc_id is None else r.doc_id)
        start, last = start + len(ids), -1 if r.doc_id is None else r.doc_id
    assert not any(want.values())
    token_files.token_file_set(documents(ODD).limit(0), path, str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_packed_documents(documents, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = ODD + [(100 + i, prose(i, 5 + 37 * i % 300), "a") for i in range(60)]
    got = packing.packed_documents(documents(docs), path, tokens=256).collect()
    bins, total = defaultdict(list), 0
    whole = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        total += r.length
        assert len(r.ids) == 4 * r.length
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-total // 256) * 1.05 + 1
    for d, t, _ in docs[len(ODD) :] + [ODD[5], ODD[1]]:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(whole[d])
        assert [p for p, *_ in parts] == list(range(len(parts)))
        assert np.frombuffer(b"".join(x for *_, x in parts), "<u4").tolist() == ids
    assert packing.packed_documents(documents(docs).limit(0), path).count() == 0


def components_by_force(docs, size, num, den, lower):
    sets = {}
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, (d, t, *_) in enumerate(docs):
        w = WORD.findall((t or "").translate(table) if lower else t or "")
        some = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else set()
        sets[i] = (d, some or ({tuple(w)} if w else set()))
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and None not in (sets[i][0], sets[j][0]):
                if den * len(a & b) >= num * len(a | b):
                    label[root(i)] = root(j)
    least = {}
    for i in sets:
        if sets[i][0] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), sets[i][0])
    return [(sets[i][0], len(sets[i][1]), least.get(root(i))) for i in sets]


@pytest.mark.parametrize(
    ("size", "num", "lower", "limit"), [(3, 90, True, None), (5, 80, False, None), (3, 90, True, 7)]
)
def test_jaccard_components(documents, monkeypatch, size, num, lower, limit):
    if limit:  # long lists are split, and few count as short
        monkeypatch.setattr(jaccard_join, "LIST_LIMIT", limit)
        monkeypatch.setattr(jaccard_join, "SHORT_LIST", 1)
    rng = random.Random(size)
    base = [prose(50 + k, 60).split() for k in range(3)]
    docs = [r for r in ODD if r[0] != 9]
    for i in range(120):
        words = list(base[i % 3])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"w{rng.randrange(9)}"
        docs.append((200 + i, "a common line of words " * (i % 2) + " ".join(words), "a"))
    got = rows_of(
        jaccard_join.jaccard_components(documents(docs), size=size, least=(num, 100), lower=lower)
        .select("doc_id", "n_shingles", "component_id")
    )
    key = lambda r: tuple(map(str, r))
    want = components_by_force(docs, size, num, 100, lower)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r[2] for r in want}) < len(docs) - 30
    assert jaccard_join.jaccard_components(documents(docs).limit(0)).count() == 0


def test_sets_that_agree_in_31_bits_keep_their_links(documents):
    base = [f"b{k}" for k in range(90)]
    docs = [(i, " ".join([*base[:45], f"w{i}", *base[45:]])) for i in (17, 84382, 28404, 88724)]
    sums = [
        int(s.sum(dtype=np.uint64)) >> 33
        for s in shingle_sets(Words(pa.array([t for _, t in docs], pa.large_string()), True), 3)
    ]
    assert sums[0] == sums[1] != sums[2] == sums[3]
    found = jaccard_join.jaccard_components(documents(docs), size=3, least=(90, 100), lower=True)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict.fromkeys((17, 84382, 28404, 88724), 17)


@pytest.mark.parametrize("batch", [1 << 20, 50])
def test_all_links_of_a_large_group(documents, monkeypatch, batch):
    monkeypatch.setattr(jaccard_join, "PAIR_BATCH", batch)
    base = prose(50, 60).split()
    docs = [(i, " ".join([*base[:30], f"w{i}", *base[30:], f"v{i % 7}"])) for i in range(150)]
    docs += [(500 + i, docs[i][1]) for i in range(5)] + [(600, None), (601, prose(9, 40)), (None, docs[0][1])]
    words = {d: t.split() for d, t in docs if t and d is not None}
    sets = {d: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for d, w in words.items()}
    alike = {d: [e for e in sets if e != d and 10 * len(sets[d] & sets[e]) >= 8 * len(sets[d] | sets[e])] for d in sets}
    names = {"size": 3, "least": (8, 10)}
    pairs = sorted(rows_of(jaccard_join.jaccard_pairs(documents(docs), **names)))
    assert pairs == [(a, b) for a in range(150) for b in sorted(alike[a]) if a < b < 150] and len(pairs) > 10_000
    got = {r.doc_id: r.n_links for r in jaccard_join.with_link_counts(documents(docs), **names).collect()}
    assert got == {**{d: len(x) for d, x in alike.items()}, 600: 0, None: None}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_without_repeats(documents, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_PASSAGES", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 2000)
    shared = prose(77, 70)
    docs = list(ODD) + [(30 + i, f"{prose(300 + i, 20)} {shared} {prose(400 + i, i)}", "a") for i in range(9)]
    docs += [(50, "x " * 200, "a"), (51, "x " * 130 + "y", "a"), (52, prose(77, 49), "a")]
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t, *_ in docs]
    for d, w in words:
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, d), d)
    want = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        want.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    key = lambda r: tuple(map(str, r))
    got = rows_of(substring_dedup.without_repeats(documents(docs)))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.without_repeats(documents(docs).limit(0)).count() == 0


def test_cold_passages_go_by_anchor_beside_a_hot_one(documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_PASSAGES", 3)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 200)
    shared = prose(77, 70)
    docs = [(i, f"{prose(300 + i, 20)} {shared}", "a") for i in range(9)]
    for i in range(30):  # one window, and several that begin with it
        pair = [prose(500 + i, 50), f"{prose(500 + i, 50)} {prose(600 + i, 6)}"]
        docs += [(100 + 2 * i + k, t, "a") for k, t in enumerate(pair if i % 2 else pair[::-1])]
    got = {r.doc_id: r.n_removed for r in substring_dedup.without_repeats(documents(docs)).collect()}
    assert [got[i] for i in range(9)] == [0] + [70] * 8
    assert [got[100 + i] for i in range(60)] == [0, 50] * 30


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "BINS", 8)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], "x") for i in range(90)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5], "x") for i in range(20)]
    rows += [(300, None, "x"), (301, [0.1, None, 0.2, 0.3], "x"), (302, [float("nan")] * 4, "x"),
             (303, [float("inf")] * 4, "x"), (None, [0.0] * 4, "x"), (304, [], "x"), (310, [0.0] * 4, None),
             (320, [1.0, 2.0], "x"), (330, [1.0, -2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = rows_of(topk.top_k(df, df.where("vec_id % 10 = 0"), 5))
    ok = [
        (i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    want = []
    for q, a in ok:
        if q % 10 == 0:
            scores = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_few_links_take_no_shuffle_a_round(spark):
    """A round of a few links has one task, not eight shuffles, with the labels of other rounds."""
    draw = random.Random(5)
    pairs = [(draw.randrange(600), draw.randrange(600)) for _ in range(400)]
    pairs += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(300)]
    links = spark.createDataFrame(pairs, "a long, b long")
    least = {x: x for p in pairs for x in p if p[0] != p[1]}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if a != b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    tasks = {}
    try:
        for k, v in zip(held, ("40", "false")):
            spark.conf.set(k, v)
        for limit in (0, 200_000):
            spark.sparkContext.setJobGroup(f"components-{limit}", "components")
            got = components(links, task_rows=limit).collect()
            assert {r["id"]: r["label"] for r in got} == least and len(got) == len(least)
            tracker = spark.sparkContext.statusTracker()
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"components-{limit}")]
            stages = {i for j in jobs for i in j.stageIds}
            tasks[limit] = sum(tracker.getStageInfo(i).numTasks for i in stages if tracker.getStageInfo(i))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in held.items():
            spark.conf.set(k, v)
    assert tasks[200_000] < 300 < 1000 < tasks[0]


@pytest.mark.parametrize("size", [60.0, 3e5])
def test_top_k_of_large_components(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 8)
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-size, size) for _ in range(6)]) for i in range(40)]
    rows += [(50, [2e12, 0.0, 0.0, 1e-9, 0.0, 0.0]), (52, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    scores = {q: {i: sum(a * b for a, b in zip(v, whole[q])) for i, v in whole.items() if i != q} for q in whole if q % 13 == 0}
    if size > 100:
        assert max(abs(s) for x in scores.values() for s in x.values()) >= 1 << 63
        with pytest.raises(Exception, match="range of a long"):
            topk.top_k(df, df.where("vec_id % 13 = 0"), 3).collect()
        return
    got = topk.top_k(df, df.where("vec_id % 13 = 0"), 3)
    want = [(q, k + 1, i, s) for q, x in scores.items()
            for k, (s, i) in enumerate(sorted(((s, i) for i, s in x.items()), key=lambda p: (-p[0], p[1]))[:3])]
    assert sorted(rows_of(got)) == sorted(want)


def test_quality(spark, documents):
    rng = random.Random(9)
    good = [(i, prose(i, rng.randint(20, 90)).capitalize() + ".") for i in range(120)]
    bad = [(200 + i, " ".join(w + "!!" for w in prose(i, 40).upper().split())) for i in range(40)]
    docs = documents(good + bad + [(None, None), (900, ""), (901, LONG)])
    labels = spark.createDataFrame(
        [(i, 1) for i in range(0, 120, 2)] + [(200 + i, 0) for i in range(0, 40, 2)] + [(0, 1), (None, 1), (5, None)],
        "doc_id long, label int",
    )
    model = quality.learn(docs, labels)
    got = quality.scored(docs, model).select("doc_id", "score").collect()
    assert len(got) == 163 and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id is not None and r.doc_id < 300:
            assert (r.score >= 0.5) == (r.doc_id < 200)
    assert quality.accepted(docs, model).columns == docs.columns
    assert np.isfinite(quality.learn(docs.limit(0), labels)).all()
    assert (quality.learn(docs, labels) == model).all()


def test_secrets(documents):
    secret = "".join(random.Random(3).choices(secret_scan.ENCODINGS["base62"], k=48))
    docs = [
        (1, None), (2, ""), (3, f"é key {secret} end"), (4, "x " * 50 + 'API_KEY = "abcDEF123456"'),
        (5, "AKIA" + "A1" * 8 + " deadbeefdeadbeef0"), (6, LONG), (6, LONG), (7, "Averyveryverylongwordofletters"),
        (None, f"password:{secret}"),
    ]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.find_secrets(documents(docs)).collect()}
    assert got[3] == [("random", 6, 54)]
    assert got[4] == [("assign", 100, 124 - 1)] and got[7] == got[6] == got[1] == []
    assert got[5] == [("access", 0, 20), ("hex", 21, 38)]
    assert got[None] == [("assign", 0, 57)]
    assert secret_scan.find_secrets(documents(docs).limit(0)).count() == 0


def test_secrets_in_paths_of_mixed_separators(documents):
    rng = random.Random(5)
    key, other = ("".join(rng.choices(secret_scan.ENCODINGS["base62"], k=48)) for _ in range(2))
    docs = [
        (1, f"see https://hooks.example.com/svc-a/T0AB/{key} now"), (2, f"in a_b/c-d/{other}_old/x+y"),
        (3, LONG), (4, "at com/svc-a/some_path/that-is_only/words+and/more-words_than/keys"),
        (5, f"my-key/{key[:15]}/{key[15:30]}+{key[30:]}"),
    ]
    rows = secret_scan.find_secrets(documents(docs)).collect()
    text = dict(docs)
    got = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "random"] for r in rows}
    assert got[1] == [key] and any(other in x for x in got[2]) and got[3] == got[4] == []
    assert any(key[30:] in x for x in got[5])


def test_url_filter(spark):
    urls = [
        "http://A.Example.org/es/x?q=/en", "https://example.org/en/12", "http://notexample.org/es/",
        "http://x.com/fr/1", "http://x.com", "http://m.casino-win.example.net/en/4", "no scheme", None, "",
        "ftp://quiet.example.net#frag/en", "http://www.library.example.net/en/7", "http:///p", "://h\n/p",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)],
                                  "page_id long, url string, probability string, rule string")
    model = url_filter.learn(queries.labelled_urls(spark))
    got = {r.page_id: r for r in url_filter.judged(pages, model, queries.URL_RULES).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 4, 6, 7, 9, 11, 12)] == [
        ("a.example.org", "/es/x"), ("x.com", ""), ("", ""), ("", ""), ("quiet.example.net", ""),
        ("", "/p"), ("h\n", "/p"),
    ]
    assert [got[i].rule for i in range(6)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", None, None]
    assert [got[i].verdict for i in range(6)] == ["block", "block", "allow", "allow", got[4].verdict, "block"]
    assert got[10].verdict == "allow" and got[0].probability == "x"
    assert url_filter.judged(pages.limit(0), model, queries.URL_RULES).count() == 0


def test_url_filter_on_hosts_held_out(spark):
    """Each host is judged by a model that saw none of its URLs."""
    labelled = queries.labelled_urls(spark)
    host = F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^.]*)\.", 1)
    fold = F.pmod(F.crc32(host), F.lit(3))
    right = {0: [0, 0], 1: [0, 0]}
    for k in range(3):
        model = url_filter.learn(labelled.where(fold != k))
        said = url_filter.judged(labelled.where(fold == k), model, [])
        for r in said.groupBy("label", "verdict").count().collect():
            right[r.label][0] += r["count"] * ((r.verdict == "allow") == bool(r.label))
            right[r.label][1] += r["count"]
    assert right[1][0] >= 0.9 * right[1][1] and right[0][0] >= 0.5 * right[0][1]


def test_mixture(documents):
    docs = [(i % 150, "t", "abc"[(i > 60) + (i > 160)]) for i in range(200)] + [(None, None, None)] * 3
    got = mixing.mixed(documents(docs), block_rows=4).collect()
    assert len(got) == 203
    spots = sorted((r.slot, r.place) for r in got)
    assert len(set(spots)) == 203 and {s for s, _ in spots} == set(range(spots[-1][0] + 1))
    again = mixing.in_mixed_order(documents(docs), block_rows=4)
    assert again.columns == documents(docs).columns and again.count() == 203
    assert mixing.in_mixed_order(documents(docs).limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(documents(docs), {"a": 1.0})


def test_sequences_follow_the_mixture(spark, documents, tmp_path, monkeypatch):
    """Read by number, sequences hold the documents of one stretch of the order after another."""
    import corpus_pipeline
    from plumbline.llm import packing

    monkeypatch.setattr(packing, "GROUP", 60)
    docs = [(i, prose(i % 7, 90 + i % 50), "ab"[i % 2]) for i in range(240)]
    documents(docs).write.parquet(f"{tmp_path}/docs")
    mixed = corpus_pipeline.mixing_stage(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
    mixed.write.parquet(f"{tmp_path}/mixed")
    order = {}
    for f in sorted((tmp_path / "mixed").glob("part-*")):
        order |= {r.doc_id: len(order) + k for k, r in enumerate(spark.read.parquet(str(f)).coalesce(1).collect())}
    got = corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{tmp_path}/mixed"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got if r.piece == 0) == list(range(240))
    first = {}
    for r in got:
        first[r.sequence_id] = min(first.get(r.sequence_id, 240), order[r.doc_id])
    assert [first[s] for s in sorted(first)] == sorted(first.values())
    assert len(first) <= 1.2 * sum(r.length for r in got) / 2048 + 1


def test_pipeline_decides_by_row(spark, documents, tmp_path):
    """Repeated and missing ids with different texts: one row of each group stays, no text is lost."""
    import corpus_pipeline

    x, y, z = prose(41, 60), prose(42, 60), prose(43, 60)
    docs = [
        (1, x, "a"), (5, x, "a"), (5, x + " tail", "b"), (5, y, "a"), (5, y, "a"), (5, y.replace(" ", "  "), "b"),
        (None, z, "a"), (None, z, "a"), (None, y, "a"), (None, prose(44, 60), "a"), (7, z + " end", None), (3, None, "a"),
        (2, "", "b"), (2, " ", "b"), (2, "one", "b"),
    ]
    documents(docs).write.parquet(f"{tmp_path}/docs")
    frame = spark.read.parquet(f"{tmp_path}/docs")
    order = lambda r: (r[0] is None, r[0] or 0)

    def kept_by_force(rows, same):
        groups = []
        for r in rows:
            hit = [g for g in groups if any(same(r[1] or "", q[1] or "") for q in g)]
            groups = [g for g in groups if g not in hit] + [[r] + [q for g in hit for q in g]]
        return groups

    def alike(a, b):
        one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.split(), b.split()))
        return bool(one and two) and 10 * len(one & two) >= 8 * len(one | two)

    squeezed = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    for stage, same in ((corpus_pipeline.exact_stage, lambda a, b: squeezed(a) == squeezed(b)), (corpus_pipeline.near_stage, alike)):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        groups = kept_by_force([(d, t) for d, t, _ in docs], same)
        assert len(got) == len(groups)
        for g in groups:
            own = [r for r in got if r in g]
            assert len(own) == 1 and order(own[0]) == min(map(order, g))


def test_pipeline_stages(spark, documents, tmp_path):
    import corpus_pipeline

    labels = [(i, int(i % 3 > 0), 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = [(i, prose(i, 60) if i % 3 else prose(i, 60).upper(), "s") for i in range(60)]
    docs += [(100 + i, prose(i, 60) + f" z{i}", None) for i in range(1, 9)] + [(120, prose(1, 60), "s")] * 2
    docs += [(None if d is None else 1000 + d, *rest) for d, *rest in ODD]
    frame = documents(docs)
    empty = frame.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        assert stage(spark, empty, str(tmp_path)).count() == 0
        if k < 4:
            assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in frame.select("doc_id").collect()}
        if name == "quality":
            assert not ids & set(range(0, 60, 3)) and set(range(1, 60, 3)) <= ids
        if name == "exact":
            assert 120 not in ids and 1 in ids
        if name == "near":
            assert 101 not in ids and 104 not in ids and 1 in ids
    assert zlib.crc32(b"") == 0 and frame.where("length < 1").count() == 0
